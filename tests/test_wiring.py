"""Rules that readers and sinks follow: ids of files without one, spacings, windows, searches, writers' own entry."""

import datetime
import json
import xml.etree.ElementTree as ET

import pytest
import synthetic

from lumaframe.api import Library
from lumaframe.sinks import ome
from lumaframe.streaming import ingest


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("wiring")
    data = synthetic.pixels((1, 2, 1, 6, 5))
    (folder / "noname.lof").write_bytes(synthetic.lof(synthetic.image_xml("one", "", "m", data.shape, data.nbytes, synthetic.CONFOCAL), data.tobytes()))
    (folder / "top.xlef").write_text('<Element Name="top" UniqueID="t"><Children><Reference File="sub.xlcf" UUID="s"/></Children></Element>')
    (folder / "sub.xlcf").write_text('<Element Name="sub" UniqueID="s"><Children><Reference File="top.xlef" UUID="t"/></Children></Element>')
    return folder


@pytest.fixture(scope="module")
def library(spark, folder):
    with Library(spark, str(folder)) as library:
        yield library


def test_file_without_an_id(library, folder):
    row = library.images().first()
    xml = library.found.where("path LIKE '%.lof'").first().xml
    n = len(row.path) + len(xml) + row.MemorySize + sum(map(ord, row.path))
    digits = f"{n:032x}"
    assert row.uuid == "-".join((digits[:8], digits[8:12], digits[12:16], digits[16:20], digits[20:]))
    assert row.scale_x == pytest.approx(row.xres2) and row.xres2 == pytest.approx(row.xres * 1e6)


def test_search_through_links(library):
    top = next(r.path for r in library.found.collect() if r.path.endswith("top.xlef"))
    assert [(r.depth, r.name) for r in library.search(top, "s").collect()] == [(1, "sub")]
    assert library.search(top, "nobody").count() == 0


def test_writers_entry(library, tmp_path):
    uuid = library.images().first().uuid
    assert library.write(uuid, str(tmp_path), "ome-zarr", colour=True) is None
    path = library.write(uuid, str(tmp_path), "ome-zarr", colour=False)
    channels = json.load(open(f"{path}/.zattrs"))["omero"]["channels"]
    assert [c["window"]["start"] for c in channels] == [0, 3000] and [c["window"]["end"] for c in channels] == [4, 3004]  # of every twentieth row
    assert library.write("nobody", str(tmp_path), "ome-tiff") is None


def test_description_of_light_and_place():
    image = {
        "xs": 4, "ys": 4, "channels": 2, "filterblock": ["HyD 1 500-551", "L5"], "detector_types": ["HyD 1", "PMT 2"], "detector_offsets": [0.5, None], "zoom": 2.0, "exposure_times_s": [0.1, 0.2], "temperature_c": 37.0, "co2_percent": 5.0,
        "stage_pos_x_m": 1e-3, "stage_pos_y_m": 2e-3, "annotations": [{"a": 1}, {}, {"b": "x"}],
    }
    top = ET.fromstring(ome.ome_xml(image, original="<x/>"))
    find = lambda name: top.findall(f".//{{*}}{name}")
    assert [(f.get("ID"), f.get("Type")) for f in find("Filter")] == [("Filter:0", "BandPass"), ("Filter:1", None)]
    assert (find("TransmittanceRange")[0].get("CutIn"), find("TransmittanceRange")[0].get("CutOut")) == ("500", "551")
    assert [r.get("ID") for r in find("EmissionFilterRef")] == ["Filter:0", "Filter:1"]
    assert (find("DetectorSettings")[0].get("Offset"), find("DetectorSettings")[0].get("Zoom")) == ("0.5", "2")
    assert [p.get("ExposureTime") for p in find("Plane")] == ["0.1", "0.2"]
    assert (find("ImagingEnvironment")[0].get("Temperature"), find("ImagingEnvironment")[0].get("CO2Percent")) == ("37", "0.05")
    assert find("StageLabel")[0].get("X") == "1000"
    assert [m.get("K") for m in find("M")] == ["a", "b"] and [r.get("ID") for r in find("AnnotationRef")] == ["Annotation:0", "Annotation:1", "Annotation:2"]
    assert len(find("XMLAnnotation")) == 1


def test_times_of_jobs(spark):
    at = datetime.datetime(2024, 5, 6, 7, 8, 9, 250000)
    rows = [(1, at, at + datetime.timedelta(seconds=4.2)), (2, at, at + datetime.timedelta(seconds=3723)), (3, at, None)]
    got = ingest.timed(spark.createDataFrame(rows, "job int, began timestamp_ntz, ended timestamp_ntz")).orderBy("job").select("at", "took").collect()
    assert [tuple(r) for r in got] == [("2024-05-06 07:08:09", "4.2s"), ("2024-05-06 07:08:09", "1h 2m 3s"), ("2024-05-06 07:08:09", None)]
