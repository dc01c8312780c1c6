"""What is kept up as things arrive: levels of arrays, the cache of previews, jobs on a stream."""

import json
import os
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumaframe.functions import codecs
from lumaframe.sinks import preview, zarr
from lumaframe.sinks.preview_cache import PreviewCache
from lumaframe.sources import pixels
from lumaframe.streaming import ingest, jobs

SHAPE = (1, 2, 1, 1300, 1100)


def half(a):
    ys, xs = np.arange(0, a.shape[0], 2), np.arange(0, a.shape[1], 2)
    n = np.minimum(2, a.shape[0] - ys)[:, None] * np.minimum(2, a.shape[1] - xs)[None]
    return np.rint(np.add.reduceat(np.add.reduceat(a.astype(float), ys, 0), xs, 1) / n).astype(a.dtype)


def band_rows(data, which):
    rows = []
    for c, y0 in which:
        part = np.ascontiguousarray(data[0, c, 0, y0 : y0 + 512])
        rows.append(("u", 0, c, 0, 0, y0, part.shape[0], part.shape[1], 1, 1, "<u2", bytearray(part.tobytes())))
    return rows


def check_levels(path, data, have):
    shown = np.zeros_like(data)
    for c, y0 in have:
        shown[0, c, 0, y0 : y0 + 512] = data[0, c, 0, y0 : y0 + 512]
    for c in range(2):
        want = shown[0, c, 0]
        for level in range(3):
            assert (zarr.read_zarr(path, level)[0, c, 0] == want).all(), (c, level)
            want = half(want)


def test_levels_follow_a_stream(spark, tmp_path):
    data = np.random.default_rng(3).integers(0, 65536, SHAPE).astype("<u2")
    image = {"xs": 1100, "ys": 1300, "channels": 2, "zs": 1, "ts": 1, "channelResolution": [16, 16]}
    path, have = str(tmp_path / "a.zarr"), []
    batches = [[(0, 0), (1, 1024)], [(0, 512)], [(0, 1024), (1, 0), (1, 512), (0, 0)]]
    assert zarr.describe_array(path, image) == 3
    for n, which in enumerate(batches):
        spark.createDataFrame(band_rows(data, which), pixels.CHUNKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        before = {f"{d}/{n}": os.stat(f"{d}/{n}").st_ino for d, _, names in os.walk(path) for n in names}
        stream = spark.readStream.schema(pixels.CHUNKS).parquet(str(tmp_path / "in"))
        zarr.append_chunks(stream, path, str(tmp_path / "c")).awaitTermination(120)
        have += which
        check_levels(path, data, have)
        if n == 0:
            assert [(r.level, r.total, r.written, r.percent) for r in zarr.status(spark, path).collect()] == [("0", 18, 6, 33.3), ("1", 8, 4, 50.0), ("2", 2, 2, 100.0)]
        after = {f"{d}/{n}": os.stat(f"{d}/{n}").st_ino for d, _, names in os.walk(path) for n in names}
        rewritten = {os.path.relpath(f, path) for f, inode in after.items() if before.get(f) != inode}
        dirty = {(0, 0, c, 0, y0 // 512, x) for c, y0 in which for x in range(3)}
        for level in (1, 2):
            dirty |= {(level, 0, c, 0, y // 2, x // 2) for k, _, c, _, y, x in dirty if k == level - 1}
        assert rewritten == {f"{k}/{'.'.join(map(str, at))}" for k, *at in dirty}


def test_whole_array_and_its_levels(spark, tmp_path):
    data = np.random.default_rng(5).integers(0, 4000, SHAPE).astype("<u2")
    image = {"xs": 1100, "ys": 1300, "channels": 2, "zs": 1, "ts": 1, "channelResolution": [16, 16]}
    every = [(c, y) for c in range(2) for y in (0, 512, 1024)]
    for compressor in ("blosc", "zlib"):
        path = str(tmp_path / compressor)
        assert zarr.write_zarr(spark.createDataFrame(band_rows(data, every), pixels.CHUNKS).repartition(3), image, path, compressor=compressor) == 2 * (9 + 4 + 1)
        check_levels(path, data, every)
        assert json.load(open(f"{path}/2/.zarray"))["shape"] == [1, 2, 1, 325, 275]
    frame = open(f"{tmp_path}/blosc/0/0.0.0.0.0", "rb").read()
    assert codecs.blosc_decode(frame) == np.ascontiguousarray(data[0, 0, 0, :512, :512]).tobytes()


@pytest.fixture()
def drawn(monkeypatch, spark):
    """Previews without pixels, so that the cache alone is seen: what is drawn is noted."""
    seen = []

    def fake(wide, height, **options):
        seen.extend(r.uuid for r in wide.select("uuid").collect())
        return wide.select("uuid", F.lit(height).alias("height"), F.concat(F.lit("png of "), "uuid").cast("binary").alias("png"))

    monkeypatch.setattr(preview, "previews", fake)
    return seen


def wide_of(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "uuid string")


@pytest.mark.parametrize("hits", [True, False])
def test_oldest_entry_leaves_with_its_file(spark, tmp_path, drawn, hits):
    ticks = iter(range(1, 1000))
    cache = PreviewCache(spark, str(tmp_path), capacity=3, hits=hits, clock=lambda: next(ticks))
    for name in "abc":
        assert [bytes(r.png) for r in cache.get(wide_of(spark, name), 24).collect()] == [f"png of {name}".encode()]
    cache.get(wide_of(spark, "a"), 24).collect()  # a use, or not
    cache.get(wide_of(spark, "d"), 24).collect()
    held = {r.uuid for r in cache.entries().collect()}
    assert held == ({"a", "c", "d"} if hits else {"b", "c", "d"})
    assert sum(n.endswith(".png") for n in os.listdir(tmp_path)) == 3
    assert drawn == ["a", "b", "c", "d"]
    assert len(cache.get(wide_of(spark, "b" if hits else "a"), 24).collect()) == 1 and drawn[-1] == ("b" if hits else "a")
    assert len(cache.get(wide_of(spark, *"vwxyz"), 24).collect()) == 5  # more than the capacity, whole
    cache.get(wide_of(spark, "v"), 24).collect()
    assert sum(n.endswith(".png") for n in os.listdir(tmp_path)) == 3


def test_keys_and_compaction(spark, tmp_path, drawn):
    cache = PreviewCache(spark, str(tmp_path), capacity=10, most_files=4)
    for height in (24, 100, 24):
        cache.get(wide_of(spark, "a"), height).collect()
    cache.get(wide_of(spark, "a"), 24, plane={"z": 1}).collect()
    assert drawn == ["a", "a", "a"] and cache.entries().count() == 3
    for _ in range(4):
        cache.get(wide_of(spark, "a"), 24).collect()
    assert cache.log.endswith(("log-1", "log-2")) and cache.entries().count() == 3
    assert PreviewCache(spark, str(tmp_path), version="2").get(wide_of(spark, "a"), 24).count() == 1
    assert drawn[3:] == ["a"]


def lines(spark, folder, n, rows):
    spark.createDataFrame(pd.DataFrame(rows, columns=["uuid", "job_id", "n", "value"])).coalesce(1).write.mode("append").json(f"{folder}/in")


def run(spark, folder, until, **options):
    """What is new in the table once it has ``until`` rows in all."""
    stream = spark.readStream.schema("uuid string, job_id bigint, n bigint, value string").json(f"{folder}/in")
    table = lambda: sorted(tuple(r) for r in spark.read.schema(jobs.EVENTS).option("recursiveFileLookup", "true").parquet(f"{folder}/out").collect()) if os.path.isdir(f"{folder}/out") else []
    before = table()
    query = jobs.Jobs(spark).follow(jobs.events(stream, **options), f"{folder}/out", f"{folder}/c")
    end = time.time() + 200
    while len(table()) < until and time.time() < end and query.isActive:
        time.sleep(0.5)
    time.sleep(1)
    query.stop()
    assert query.exception() is None
    return sorted(set(table()) - set(before))


def test_newest_job_wins(spark, tmp_path):
    lines(spark, tmp_path, 0, [("a", 1, 1, "Reading: 10% done"), ("b", 7, 1, "hello"), ("a", 1, 2, "Reading: 20% done"), ("a", 2, 1, "start")])
    assert run(spark, tmp_path, 5) == [
        ("a", 1, 1, "progress", "Reading: 10% done"), ("a", 1, 2, "progress", "Reading: 20% done"), ("a", 1, 3, "end", "superseded"), ("a", 2, 1, "log", "start"), ("b", 7, 1, "log", "hello"),
    ]
    lines(spark, tmp_path, 1, [("a", 1, 3, "late: 90%"), ("a", 2, 2, '["result"]'), ("a", 2, 3, "after its end"), ("b", 7, 2, "Error: no file"), (None, 1, 1, "nobody's")])
    assert run(spark, tmp_path, 9) == [("a", 2, 2, "result", '["result"]'), ("a", 2, 3, "end", ""), ("b", 7, 2, "error", "Error: no file"), ("b", 7, 3, "end", "")]
    lines(spark, tmp_path, 2, [("b", 8, 1, "again"), ("b", 7, 9, "late"), ("a", 1, 4, "late")])
    assert run(spark, tmp_path, 10) == [("b", 8, 1, "log", "again")]


def test_silent_job_ends(spark, tmp_path):
    lines(spark, tmp_path, 0, [("a", 1, 1, "start")])
    assert run(spark, tmp_path, 2, idle=50) == [("a", 1, 1, "log", "start"), ("a", 1, 2, "end", "no line for 50 ms")]


def test_older_work_is_stopped(spark):
    slow = lambda: spark.range(0, 8, 1, 8).mapInPandas(lambda it: (time.sleep(60) or b for b in it), "id bigint").count()
    done = []
    running = jobs.Jobs(spark)
    began = time.time()
    old = running.start("a", 1, slow)
    other = running.start("b", 1, lambda: done.append(spark.range(5).count()))
    time.sleep(3)
    new = running.start("a", 2, lambda: done.append(spark.range(7).count()))
    for thread in (old, other, new):
        thread.join(50)
        assert not thread.is_alive()
    assert time.time() - began < 55 and sorted(done) == [5, 7]
    assert ingest.cancel(spark, "nothing runs under this") is None
