"""Mosaics, orientation and the description of converted images, through the library, against numpy."""

import json
import xml.etree.ElementTree as ET

import numpy as np
import pytest
import synthetic

from lumaframe.api import Library
from lumaframe.sinks import tiff, zarr


def tile_xml(fields, step, flips=""):
    return f'<Attachment Name="TileScanInfo" {flips}>' + "".join(f'<Tile FieldX="{x}" FieldY="{y}" PosX="{x * step[0]}" PosY="{y * step[1]}"/>' for x, y in fields) + "</Attachment>"


def mosaic_file(folder, name, shape, fields, step, dtype="<u2", rgb=False, flips=""):
    """A file with one tiled image; (tiles, channels, rows, columns[, samples]) in a random pattern."""
    c, y, x = shape
    rng = np.random.default_rng(len(name))
    data = rng.integers(1, 250, (len(fields), c, y, x, *([3] if rgb else []))).astype(dtype)
    bits = 8 * np.dtype(dtype).itemsize
    xml = synthetic.image_xml(name, f"{name}-id", "m1", (1, 3 if rgb else c, 1, y, x), data.nbytes, tiles=tile_xml(fields, step, flips), bits=bits)
    one = data[0].nbytes
    if rgb:
        for k in range(3):
            xml = xml.replace('ChannelTag="0"', f'ChannelTag="{k + 1}"', 1)
        xml = xml.replace(f'DimID="1" NumberOfElements="{x}" Length="{x * 1e-6}" Unit="m" BytesInc="1"', f'DimID="1" NumberOfElements="{x}" Length="{x * 1e-6}" Unit="m" BytesInc="3"')
    xml = xml.replace("</Dimensions>", f'<DimensionDescription DimID="10" NumberOfElements="{len(fields)}" Length="0" Unit="" BytesInc="{one}"/></Dimensions>')
    (folder / f"{name}.lif").write_bytes(synthetic.lif(xml, [("m1", data.tobytes())]))
    return data


def pasted(data, fields, overlap=(0.0, 0.0), turn=lambda a: a):
    first = turn(data[0, 0])
    h, w = first.shape[:2]
    nx, ny = max(f[0] for f in fields) + 1, max(f[1] for f in fields) + 1
    size = [n if k == 1 else int((k - 1) * (n * (1 - o)) + n) for n, k, o in ((h, ny, overlap[1]), (w, nx, overlap[0]))]
    out = np.zeros((data.shape[1], *size, *first.shape[2:]), data.dtype)
    for tile, (fx, fy) in zip(data, fields, strict=True):
        y, x = int(fy * (h * (1 - overlap[1]))), int(fx * (w * (1 - overlap[0])))
        for c, plane in enumerate(tile):
            part = turn(plane)[: size[0] - y, : size[1] - x]
            out[c, y : y + part.shape[0], x : x + part.shape[1]] = part
    return out


GRID = [(x, y) for y in range(2) for x in range(3)]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("mosaics")
    size = (9 * 10 / 9 * 1e-6, 7 * 8 / 7 * 1e-6)  # a tile's sides in metres: n pixels at length / (n - 1)
    data = {
        "plain": mosaic_file(folder, "plain", (2, 8, 10), GRID, (10 * 10e-6 / 9, 8 * 8e-6 / 7)),
        "over": mosaic_file(folder, "over", (1, 300, 400), GRID, (400 * 400e-6 / 399 * 0.9, 300 * 300e-6 / 299 * 0.8)),
        "colour": mosaic_file(folder, "colour", (1, 8, 10), GRID, (10 * 10e-6 / 9, 8 * 8e-6 / 7), "|u1", True),
        "turned": mosaic_file(folder, "turned", (1, 8, 10), GRID, (10 * 10e-6 / 9, 8 * 8e-6 / 7), flips='FlipX="1" FlipY="1"'),
    }
    assert size
    with Library(spark, str(folder)) as library:
        yield library, data, tmp_path_factory.mktemp("out")


def test_mosaics(made):
    library, data, out = made
    want = {
        "plain": pasted(data["plain"], GRID),
        "over": pasted(data["over"], GRID, (0.1, 0.2)),
        "colour": pasted(data["colour"], GRID),
        "turned": pasted(data["turned"], GRID, turn=lambda a: a[::-1, ::-1]),
    }
    for name, canvas in want.items():
        path = json.loads(library.convert(f"{name}-id", str(out), "ome-zarr"))[0]["full_path"]
        got = zarr.read_zarr(path)[0, :, 0]
        assert (got == (canvas[0].transpose(2, 0, 1) if name == "colour" else canvas)).all(), name
    for name in ("plain", "over", "colour"):
        path = json.loads(library.convert(f"{name}-id", str(out), "ome-tiff"))[0]["full_path"]
        planes = tiff.read_tiff(path)
        assert len(planes) == len(want[name]) and all((p[0] == c).all() for p, c in zip(planes, want[name], strict=True)), name


def test_description(made, spark, tmp_path):
    library, _, _ = made
    result = json.loads(library.convert("plain-id", str(tmp_path / "a"), "zarr", other_folder=str(tmp_path / "b"), with_metadata=True, with_xml=True))[0]
    assert sorted(p.name for p in (tmp_path / "b").iterdir()) == sorted(p.name for p in (tmp_path / "a").iterdir())
    values = result["keyvalues"][0]
    assert json.loads(values["image_metadata_json"])["dimensions"]["s"] == 6 and "<ImageDescription>" in values["image_xml"]
    assert values["channel_display_white_values"] == [58982, 58982] and values["channel_display_black_values"] == [6554, 6554]
    top = ET.fromstring((tmp_path / "a" / "plain_plain.ome.zarr" / "OME" / "METADATA.ome.xml").read_text())
    ns = {"o": "http://www.openmicroscopy.org/Schemas/OME/2016-06"}
    pixels = top.find("o:Image/o:Pixels", ns)
    assert (pixels.get("SizeX"), pixels.get("SizeY"), pixels.get("SizeC"), pixels.get("Type")) == ("30", "16", "2", "uint16")
    assert [c.get("Color") for c in pixels.findall("o:Channel", ns)] == ["-16776961", "8388863"]
    shown = json.loads((tmp_path / "a" / "plain_plain.ome.zarr" / ".zattrs").read_text())["omero"]["channels"]
    assert [(c["label"], c["color"]) for c in shown] == [("dye 0", "ff0000"), ("dye 1", "008000")]


def test_swapped_axes(spark, tmp_path):
    data = np.random.default_rng(3).integers(0, 999, (2, 9, 7)).astype("<u2")  # planes as stored: 9 rows of 7
    settings = synthetic.CONFOCAL.replace('FlipX="0" FlipY="1" SwapXY="0"', 'FlipX="1" FlipY="0" SwapXY="1"')
    xml = synthetic.image_xml("turn", "turn-id", "m1", (1, 2, 1, 7, 9), data.nbytes, settings)
    (tmp_path / "turn.lif").write_bytes(synthetic.lif(xml, [("m1", data.tobytes())]))
    with Library(spark, str(tmp_path)) as library:
        path = json.loads(library.convert("turn-id", str(tmp_path / "out"), "zarr"))[0]["full_path"]
        assert (zarr.read_zarr(path)[0, :, 0] == data[:, :, ::-1].transpose(0, 2, 1)).all()
        path = json.loads(library.convert("turn-id", str(tmp_path / "out")))[0]["full_path"]
    raw = open(path, "rb").read()
    top = ET.fromstring(raw[raw.index(b"<?xml") : raw.index(b"</OME>") + 6])
    ns = {"o": "http://www.openmicroscopy.org/Schemas/OME/2016-06"}
    one = top.find("o:Instrument", ns)
    assert [x.get("Wavelength") for x in one.findall("o:Laser", ns)] == ["488", "561"]
    assert [(x.get("Model"), x.get("Type"), x.get("Gain")) for x in one.findall("o:Detector", ns)] == [("HyD 1", "Other", "10")]
    assert one.find("o:Objective", ns).attrib == {"ID": "Objective:0", "Model": "HC PL APO 63x/1.40 OIL", "NominalMagnification": "63", "LensNA": "1.4", "Immersion": "Oil"}
    channel = top.findall("o:Image/o:Pixels/o:Channel", ns)[0]
    assert {k: channel.get(k) for k in ("ExcitationWavelength", "EmissionWavelength", "AcquisitionMode", "IlluminationType", "PinholeSize")} == {"ExcitationWavelength": "488", "EmissionWavelength": "526", "AcquisitionMode": "LaserScanningConfocalMicroscopy", "IlluminationType": "Epifluorescence", "PinholeSize": "95"}
    assert top.find(".//o:OriginalMetadata", ns).text.startswith("<Element")


def test_links_and_names(spark, tmp_path):
    data = synthetic.pixels((1, 1, 1, 6, 5))
    body = synthetic.image_xml("linked", "l-1", "m", data.shape, data.nbytes)
    (tmp_path / "a.lof").write_bytes(synthetic.lof(body, data.tobytes()))
    (tmp_path / "a.xlif").write_text(body.replace('MemoryBlockID="m"/>', 'MemoryBlockID="m"><Block File="a.lof"/></Memory>'))
    (tmp_path / "project.xlef").write_text('<Element Name="p" UniqueID="p"><Children><Reference File="folder.xlcf" UUID="f"/></Children></Element>')
    (tmp_path / "folder.xlcf").write_text('<Element Name="f" UniqueID="f"><Children><Reference File="a.xlif" UUID="l-1"/><Reference File="project.xlef" UUID="p"/></Children></Element>')
    with Library(spark, str(tmp_path)) as library:
        rows = [(r.path.rsplit("/", 1)[1], r.uuid, r.name) for r in library.every_image().collect()]
        assert rows == [("a.xlif", "l-1", "project_folder_linked")]
        row = library.images().where("path LIKE '%.xlif'").first()
        assert row.pixel_path.endswith("a.lof") and (row.Position, row.xs, row.channels) == (62, 5, 1)
        path = json.loads(library.convert("l-1", str(tmp_path / "out"), "zarr", always=True))[0]["full_path"]
        assert (zarr.read_zarr(path) == data).all()
