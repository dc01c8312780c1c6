"""Previews by plane and channel, their cache, streams of chunks, time stamps and settings as the library gives them."""

import base64

import numpy as np
import pytest
import synthetic
from pyspark.sql import functions as F

from lumaframe.api import Library
from lumaframe.operators import metadata
from lumaframe.sinks import preview, zarr
from lumaframe.sinks.preview_cache import PreviewCache
from lumaframe.sources import containers, pixels


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("views")
    data = synthetic.pixels((2, 3, 2, 7, 9))
    scanner = "".join(f'<ScannerSettingRecord Identifier="{k}" Variant="{v}"/>' for k, v in (("SystemType", "TCS SP5"), ("dblZoom", "2.5"), ("csScanMode", "xyz")))
    camera = '<WideFieldChannelConfigurator CameraName="cam"><WideFieldChannelInfo FluoCubeName="L5" ContrastingMethodName="FLUO"/></WideFieldChannelConfigurator><ATLCameraSettingDefinition ObjectiveName="PL 10x/0.3" NumericalAperture="0.3"/>'
    stamps = "<TimeStampList>1d5a0f3b2c4e800 2</TimeStampList>"
    stack = np.ascontiguousarray(data.transpose(0, 2, 1, 3, 4)).tobytes()
    for name, settings in (("new", synthetic.CONFOCAL + stamps), ("old", scanner), ("wide", camera + '<TimeStampList><TimeStamp HighInteger="30000000" LowInteger="5"/></TimeStampList>')):
        xml = synthetic.image_xml(name, f"{name}-id", "m", data.shape, data.nbytes, settings)
        (folder / f"{name}.lif").write_bytes(synthetic.lif(xml, [("m", stack)]))
    with Library(spark, str(folder)) as library:
        yield library


def test_settings_through_the_library(library):
    rows = {r.name: r for r in library.images().collect()}
    assert (rows["old"].SystemTypeName, rows["old"].zoom, rows["old"].mic_type) == ("TCS SP5", 2.5, "IncohConfMicr")
    wide = rows["wide"]
    assert (wide.mic_type2, wide.camera_name, wide.filterblock, wide.excitation, wide.contrasts[0], wide.illuminations[0], wide.acquisition_mode) == ("camera", "cam", ["L5", "Unknown", "Unknown"], [480.0], "Fluorescence", "Epifluorescence", "WideField")
    assert rows["old"].emission == [500.0] * 3 and rows["new"].emission == [526.0, 610.0, 500.0]
    micros = lambda high, low: ((high << 32) + low - 116444736000000000) // 10
    at = {r.name: r.t for r in library.images().select("name", F.unix_micros("experiment_time").alias("t")).collect()}
    assert at["wide"] == micros(30000000, 5) and at["new"] == (0x1D5A0F3B2C4E800 - 116444736000000000) // 10 and at["old"] > 1_600_000_000_000_000
    assert rows["new"].summary.startswith("Name: new\nSize: 9 x 7 x 2 pixels\nChannels: 3\nTimes: 2\nPixel: 1.12 µm\nDate: ")
    reasons = metadata.reject_reason(library.images().withColumn("Position", F.when(F.col("name") != "old", F.col("Position")))).select("name", "reject_reason").collect()
    assert dict(reasons) == {"new": None, "old": "missing Position", "wide": None}


def test_chosen_planes(library):
    wide = library.image("new-id")
    first = preview.previews(wide, 7, plane={"t": 0, "z": 0, "s": 0}, channels=[1]).first().png
    a = synthetic.pixels((2, 3, 2, 7, 9))[0, 1, 0]
    assert first == preview.encode_png(preview.render([a], [0x00FF00], 7))
    url = preview.as_base64(preview.previews(wide, 4)).first().url
    assert base64.b64decode(url.split(",")[1]).startswith(b"\x89PNG")
    assert [h for h, df in preview.progressive(wide) if not df.isEmpty()] == [200]


def test_cache(library, spark, tmp_path):
    """The two things the former cache was tested for: nothing is drawn twice, and the oldest goes."""
    folder = str(tmp_path / "cache")
    cache = PreviewCache(spark, folder, capacity=2)
    first = {r.uuid: r.png for r in cache.get(library.image("new-id"), 5).collect()}
    both = {r.uuid: r.png for r in cache.get(library.images().where("name <> 'wide'"), 5).collect()}
    assert set(both) == {"new-id", "old-id"} and both["new-id"] == first["new-id"]
    assert spark.read.parquet(cache.log).where("kind = 'put'").count() == 2  # the first was not drawn again
    cache.capacity = 1
    cache.get(library.image("old-id"), 5).collect()
    assert [r.uuid for r in cache.entries().collect()] == ["old-id"]


def test_chunks_as_a_stream(library, spark, tmp_path):
    bands = pixels.chunks(pixels.planes(library.image("new-id")))
    bands.write.parquet(str(tmp_path / "bands"))
    stream = spark.readStream.schema(pixels.CHUNKS).parquet(str(tmp_path / "bands"))
    zarr.append_chunks(stream, str(tmp_path / "z"), str(tmp_path / "c")).awaitTermination(90)
    assert len(list((tmp_path / "z" / "0").iterdir())) == 12


def test_broken_marks(spark, tmp_path):
    body = synthetic.image_xml("alone", "u", "m", (1, 1, 1, 2, 2), 8)
    raw = synthetic.lof(body, b"12345678")
    at = raw.index(b"\x2a\x02\x00\x00\x00")
    (tmp_path / "a.lof").write_bytes(raw[:at] + b"\x2b" + raw[at + 1 :])
    assert containers.containers(spark, str(tmp_path)).first().problem == "no mark before the major version"
