"""Tiled files: written by many tasks as by one, read by ranges, validated."""

import json
import os
import struct

import numpy as np
import pytest
import synthetic
from pyspark.sql import functions as F

from lumaframe.api import Library
from lumaframe.functions import codecs
from lumaframe.sinks import tiff, zarr
from lumaframe.sources import pixels, stores, tiff_source


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tiled")
    data = synthetic.pixels((1, 2, 2, 700, 1030))
    xml = synthetic.image_xml("big", "b-1", "m1", data.shape, data.nbytes, synthetic.CONFOCAL.replace('FlipY="1"', 'FlipY="0"'))
    (folder / "big.lif").write_bytes(synthetic.lif(xml, [("m1", np.ascontiguousarray(data.transpose(0, 2, 1, 3, 4)).tobytes())]))
    with Library(spark, str(folder)) as library:
        library.images().cache()
        yield library, data


@pytest.fixture(scope="module")
def image(library):
    return library[0].image("b-1").first().asDict(True)


def levels_of(library):
    return tiff.pyramid(pixels.chunks(pixels.planes(library.image("b-1"))), 1030, 700)


def one_writer(path, levels, image, packing):
    """The same file, tile after tile by one hand."""
    plan = tiff.Plan(image, len(levels), codecs.PACKINGS[packing], None)
    bands = sorted((plan.row(r.asDict(), k), pixels.array_of(r)) for k, df in enumerate(levels) for r in df.collect())
    with open(path, "w+b") as file:
        file.write(bytes(16))
        rows = []
        for _, a in bands:
            tiles = plan.pack(a)
            rows.append((file.tell(), [len(t) for t in tiles]))
            file.write(b"".join(tiles))
        plan.write_directories(file, iter(rows))


@pytest.mark.parametrize("packing", ["deflate", "lzw"])
def test_many_writers_write_as_one(library, image, tmp_path, packing, monkeypatch):
    monkeypatch.setattr(tiff, "GROUPS", 3)  # several groups of offsets
    levels = levels_of(library[0])
    got = tiff.write_tiff(levels, image, str(tmp_path / "many.tiff"), packing=packing).first()
    one_writer(tmp_path / "one.tiff", levels, image, packing)
    same = (tmp_path / "many.tiff").read_bytes()
    assert same == (tmp_path / "one.tiff").read_bytes() and got.bytes == len(same)
    assert sorted(os.listdir(tmp_path)) == ["many.tiff", "one.tiff"]  # neither parts nor staged tiles stay
    planes = tiff.read_tiff(str(tmp_path / "many.tiff"))
    assert len(planes) == 4 and all((planes[2 * c + z][0] == library[1][0, c, z]).all() for c in range(2) for z in range(2))
    with stores.Ranges() as ranges:
        tags = [t for _, _, t in tiff_source.walk(ranges, str(tmp_path / "many.tiff"))]
    assert tags[0][tiff_source.XML] == tags[0][tiff_source.DESCRIPTION] and tags[0][tiff_source.PREDICTOR] == (2,)
    assert tags[1][tiff_source.KIND] == (1,) and tiff_source.KIND not in tags[0]


def test_no_task_takes_all_tiles(library, image, tmp_path, spark):
    """Of the jobs that carry pixels none has one task for all; the one that has writes directories from numbers."""
    levels = levels_of(library[0])
    plan = tiff.Plan(image, len(levels), codecs.PACKINGS["none"], None)
    assert plan.rows == 4 * (2 + 1 + 1)
    spark.sparkContext.setJobGroup("tiles", "")
    tiff.write_tiff(levels, image, str(tmp_path / "a.tiff"), packing="none")
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("tiles") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert any(s is not None and s.numTasks > 1 for s in stages)


def test_second_try_stores(library, image, tmp_path):
    def broken(raw):
        raise MemoryError("no room for a table")

    levels = levels_of(library[0])
    with pytest.raises(Exception, match="no room"):
        tiff.write_tiff(levels, image, str(tmp_path / "x.tiff"), packing=codecs.Packing(5, True, broken))
    assert os.listdir(tmp_path) == []
    tiff.write_or_store(levels, image, str(tmp_path / "x.tiff"), packing=codecs.Packing(5, True, broken))
    with stores.Ranges() as ranges:
        assert {t[tiff_source.COMPRESSION] for _, _, t in tiff_source.walk(ranges, str(tmp_path / "x.tiff"))} == {(1,)}
    assert (tiff.read_tiff(str(tmp_path / "x.tiff"))[0][0] == library[1][0, 0, 0]).all()


def test_small_tiles_and_validation(spark, library, tmp_path):
    """Through the library: tiles are no larger than they need to be, and what was written holds."""
    data = synthetic.pixels((1, 1, 1, 40, 70))
    (tmp_path / "s.lif").write_bytes(synthetic.lif(synthetic.image_xml("s", "s-1", "m", data.shape, data.nbytes), [("m", data.tobytes())]))
    with Library(spark, str(tmp_path)) as small:
        path = json.loads(small.convert("s-1", str(tmp_path), compression="lzw"))[0]["full_path"]
        array = json.loads(small.convert("s-1", str(tmp_path), "ome-zarr"))[0]["full_path"]
    found = tiff_source.directories(spark, [path])
    row = found.first()
    assert (row.tile_w, row.tile_l, row.compression, row.predictor) == (80, 48, 5, 2)
    assert (tiff.read_tiff(path)[0][0] == data[0, 0, 0]).all()
    assert [tuple(r)[1:] for r in tiff_source.validate(found).collect()] == [(1, [], [])]
    meta = json.load(open(f"{array}/0/.zarray"))
    assert meta["compressor"] == {"id": "blosc", "cname": "zstd", "clevel": 5, "shuffle": 1, "blocksize": 0}
    assert (zarr.read_zarr(array)[0, 0, 0] == data[0, 0, 0]).all()
    assert open(f"{array}/0/0.0.0.0.0", "rb").read()[:4] == bytes([2, 1, 0x91, 2])


def test_tiles_by_ranges(spark, library, image, tmp_path):
    tiff.write_tiff(levels_of(library[0]), image, str(tmp_path / "v.tiff"))
    found = tiff_source.directories(spark, [str(tmp_path / "v.tiff")])
    assert found.groupBy("level").count().orderBy("level").collect() == [(0, 4), (1, 4), (2, 4)]
    tiles = tiff_source.read_tiles(tiff_source.tile_places(found).where("plane = 3 AND level = 0")).collect()
    out = np.zeros((700, 1030), np.uint16)
    for r in tiles:
        out[r.y : r.y + r.h, r.x : r.x + r.w] = np.frombuffer(r.data, r.dtype).reshape(r.h, r.w)
    assert len(tiles) == 6 and (out == library[1][0, 1, 1]).all()
    (good,) = tiff_source.validate(found).collect()
    assert good.planes == 4 and good.errors == [] and good.warnings == []


def test_broken_files(spark, library, image, tmp_path):
    tiff.write_tiff(levels_of(library[0]), image, str(tmp_path / "ok.tiff"))
    raw = (tmp_path / "ok.tiff").read_bytes()
    place = next(iter(tiff_source.tile_places(tiff_source.directories(spark, [str(tmp_path / "ok.tiff")])).where("plane = 1 AND level = 0 AND number = 2").collect()))
    torn = bytearray(raw)
    torn[place.offset : place.offset + 20] = b"\xff" * 20
    (tmp_path / "torn.tiff").write_bytes(torn)
    (tmp_path / "short.tiff").write_bytes(raw[:-3000])
    (tmp_path / "other.tiff").write_bytes(b"MM\0*" + bytes(100))
    (tmp_path / "none.tiff").write_bytes(b"")
    (tmp_path / "size.tiff").write_bytes(raw.replace(b'SizeX="1030"', b'SizeX="1031"').replace(b'SizeZ="2"', b'SizeZ="3"'))
    names = ["ok", "torn", "short", "other", "none", "size"]
    got = {os.path.basename(r.path)[:-5]: r for r in tiff_source.validate(tiff_source.directories(spark, [str(tmp_path / f"{n}.tiff") for n in names])).collect()}
    assert got["ok"].errors == []
    assert len(got["torn"].errors) == 1 and got["torn"].errors[0].startswith("plane 1 level 0: tile 2")
    assert any("file ends" in e or "no directory" in e for e in got["short"].errors)
    assert "not a little-endian BigTIFF" in got["other"].errors and got["none"].errors
    assert "planes: 6 described, 4 found" in got["size"].errors and "size: 1031x700 described, 1030x700 found" in got["size"].errors


def test_file_larger_than_the_heap(spark, tmp_path):
    """Six gigabytes with holes: only directories and the tiles asked for are read."""
    path, size, side = tmp_path / "huge.tiff", 6 * 2**30, 512
    image = {"xs": side * 4, "ys": side * 4, "channels": 1, "zs": 1, "ts": 1, "channelResolution": [16]}
    plan = tiff.Plan(image, 1, codecs.PACKINGS["none"], None)
    tile = side * side * 2
    rows = [(16 + (size // 8) * k, [tile] * 4) for k in range(4)]
    with open(path, "w+b") as file:
        file.truncate(size)
        for at, _ in rows:
            file.seek(at + tile)
            file.write(struct.pack("<H", 77) * (side * side))
        plan.write_directories(file, iter(rows))
    found = tiff_source.directories(spark, [str(path)])
    assert found.first().file_size > size
    assert tiff_source.validate(found).first().errors == []
    total = tiff_source.read_tiles(tiff_source.tile_places(found)).select("y", "x", F.expr("hex(substring(data, 1, 2))").alias("v")).collect()
    assert {(r.y // side, r.x // side): r.v for r in total if r.v != "0000"} == {(k, 1): "4D00" for k in range(4)}
