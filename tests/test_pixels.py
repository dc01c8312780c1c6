"""Pixels, previews and sinks against numpy."""

import json
import struct
import zlib

import numpy as np
import pytest
import synthetic

from lumaframe.api import Library
from lumaframe.operators import images, linked
from lumaframe.sinks import preview, tiff, zarr
from lumaframe.sources import containers, pixels
from lumaframe.streaming import ingest


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("library")


@pytest.fixture(scope="module")
def data(folder):
    return synthetic.example(folder)


@pytest.fixture(scope="module")
def library(spark, folder, data):
    return Library(spark, str(folder))


def test_pixels(library, data):
    rows = pixels.pixels(pixels.chunks(pixels.planes(library.image("u-1")))).collect()
    got = np.zeros(data.shape, int)
    for r in rows:
        got[r.t, r.c, r.z, r.y, r.x] = r.v
    assert len(rows) == data.size and (got == data).all()


def test_strided_stats(library, data):
    got = {r.c: (r.vmin, r.vmax) for r in library.stats(0.5).where("uuid = 'u-1'").collect()}
    middle = data[1, :, 1, ::2]
    assert got == {c: (int(middle[c].min()), int(middle[c].max())) for c in range(3)}


def wide_image(tmp_path, spark):
    data = synthetic.pixels((1, 2, 1, 700, 1030))
    xml = synthetic.image_xml("big", "b-1", "m1", data.shape, data.nbytes)
    (tmp_path / "big.lif").write_bytes(synthetic.lif(xml, [("m1", data.tobytes())]))
    return Library(spark, str(tmp_path)), data


def half(a):
    ys, xs = np.arange(0, a.shape[0], 2), np.arange(0, a.shape[1], 2)
    n = np.minimum(2, a.shape[0] - ys)[:, None] * np.minimum(2, a.shape[1] - xs)[None]
    return np.rint(np.add.reduceat(np.add.reduceat(a.astype(float), ys, 0), xs, 1) / n).astype(a.dtype)


def test_zarr_and_tiff(spark, tmp_path):
    library, data = wide_image(tmp_path, spark)
    out = json.loads(library.convert("b-1", str(tmp_path / "out"), "ome-zarr"))
    path = out[0]["full_path"]
    small = [half(data[0, c, 0]) for c in range(2)]
    assert (zarr.read_zarr(path) == data).all()
    assert (zarr.read_zarr(path, 1)[0, :, 0] == np.array(small)).all()
    sets = json.load(open(f"{path}/.zattrs"))["multiscales"][0]["datasets"]
    assert len(sets) == 3 and sets[1]["coordinateTransformations"][0]["scale"][4] == pytest.approx(2 * 1030 / 1029)
    assert out[0]["keyvalues"][0]["channel_mins"] == [int(data[0, c, 0, ::10].min()) for c in range(2)]
    path = json.loads(library.convert("b-1", str(tmp_path / "out")))[0]["full_path"]
    planes = tiff.read_tiff(path)
    assert len(planes) == 2
    for c in range(2):
        assert (planes[c][0] == data[0, c, 0]).all() and (planes[c][1] == small[c]).all() and (planes[c][2] == half(small[c])).all()
    assert b"SizeC=&quot;2" in open(path, "rb").read() or b'SizeC="2"' in open(path, "rb").read()
    assert library.convert("nothing", str(tmp_path)) == "[]"


def test_single_container(spark, library, data, tmp_path):
    out = json.loads(library.convert("u-1", str(tmp_path), "lif"))
    again = Library(spark, out[0]["full_path"])
    row = again.image("u-1").first()
    assert (row.xs, row.ys, row.channels, row.MemorySize) == (9, 7, 3, data.nbytes)
    rows = pixels.pixels(pixels.chunks(pixels.planes(again.image("u-1")))).collect()
    assert sum(r.v for r in rows) == int(data.astype(int).sum())


def test_preview(library):
    rows = {r.uuid: r.png for r in library.previews(4).collect()}
    assert set(rows) == {"u-1", "u-9", "MemBlock_2"}
    assert rows["u-1"].startswith(b"\x89PNG") and struct.unpack(">II", rows["u-1"][16:24]) == (5, 4)


def test_render():
    plane = np.zeros((4, 4), np.uint8)
    plane[0, 0] = 200
    rgb = preview.render([plane], [0xFF0000], 4)
    assert rgb[0, 0].tolist() == [255, 0, 0] and rgb[1:].max() == 0
    raw = preview.encode_png(rgb)
    at = raw.index(b"IDAT")
    (n,) = struct.unpack(">I", bytes(raw[at - 4 : at]))
    assert len(zlib.decompress(raw[at + 4 : at + 4 + n])) == 4 * 13
    assert preview.area_resize(np.arange(16.0).reshape(4, 4), 2, 2).tolist() == [[2.5, 4.5], [10.5, 12.5]]


def test_linked(library, folder):
    top = next(r.path for r in library.found.collect() if r.path.endswith("top.xlef"))
    got = linked.reach(containers.links(library.nodes), top).collect()
    assert sorted((r.path.rsplit("/", 1)[1].replace("%20", " "), r.depth) for r in got) == [("gone.xlif", 1), ("sub one.xlcf", 1), ("top.xlef", 0)]
    rows = linked.list_links(library.nodes, containers.links(library.nodes), top).collect()
    assert [(r.uuid, r.name) for r in rows] == [("s", "sub"), ("g", None)]


def test_resolve_pixels(spark, tmp_path):
    data = synthetic.pixels((1, 1, 1, 6, 5))
    body = synthetic.image_xml("linked", "l-1", "m", data.shape, data.nbytes)
    (tmp_path / "a.lof").write_bytes(synthetic.lof(body, data.tobytes()))
    (tmp_path / "a.xlif").write_text(body.replace('MemoryBlockID="m"/>', 'MemoryBlockID="m"><Block File="a.lof"/></Memory>'))
    library = Library(spark, str(tmp_path))
    row = linked.resolve_pixels(library.nodes, library.found).first()
    assert row.uuid == "l-1" and row.pixel_path.endswith("/a.lof") and (row.Position, row.MemorySize) == (62, 60)


def test_stream(spark, folder, data, tmp_path):
    describe = lambda files: images.elements(containers.xml_nodes(containers.parse(files)))
    for _ in range(2):  # nothing new the second time
        assert ingest.ingest(spark, str(folder), str(tmp_path / "t"), str(tmp_path / "c"), describe, "*.lif").awaitTermination(90)
    assert sorted(r.uuid for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["MemBlock_2", "f-1", "root", "u-1"]
    lines = spark.createDataFrame([("Converting: 45.5% done",), ("hello",)], "value string")
    assert [(r.percent, r.phase) for r in ingest.progress(lines).collect()] == [(45.5, "Converting")]


def test_command_line(spark, folder, data, tmp_path, capsys):
    from lumaframe.__main__ import main

    assert main(["list", str(folder)]) == 0 and len(capsys.readouterr().out.splitlines()) == 3
    assert main(["preview", str(folder), "--uuid", "u-9", "--out", str(tmp_path), "--height", "4"]) == 0
    assert (tmp_path / "u-9_h4.png").read_bytes().startswith(b"\x89PNG")
    assert main(["convert", str(folder), "--uuid", "none", "--out", str(tmp_path)]) == 1
