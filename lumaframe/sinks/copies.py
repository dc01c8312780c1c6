"""Files copied by ranges and compared afterwards: many tasks copy one large file, and a broken range costs itself alone."""

from __future__ import annotations

import os
import time
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.operators import tree
from lumaframe.sources import stores

#: Bytes in a range, and bytes that a task holds at once.
RANGE, PIECE = 256 << 20, 4 << 20
PLAN = "source string, target string, offset bigint, size bigint, crc bigint, problem string"
_KINDS = pa.schema([("source", pa.string()), ("target", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("crc", pa.int64()), ("problem", pa.string())])


def plan(spark: SparkSession, source: str, target: str, size: int = RANGE, store: str | None = None) -> DataFrame:
    """(source, target, offset, size): the ranges of a file, or of all files below a folder; an empty file has one empty range. Only names and lengths are looked at."""
    system, name = stores.find(source, store)
    info = system.get_file_info(name)
    if info.type == fs.FileType.Directory:
        found = [(f.path, f"{target}/{os.path.relpath(f.path, name)}", f.size) for f in system.get_file_info(fs.FileSelector(name, recursive=True)) if f.is_file]
    elif info.is_file:
        found = [(name, target, info.size)]
    else:
        raise FileNotFoundError(source)
    head = source[: len(source) - len(name)] if source.endswith(name) else ""
    files = spark.createDataFrame([(head + a, b, n) for a, b, n in found], "source string, target string, total bigint")
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("total") - 1, F.lit(0)), F.lit(size).cast("bigint")))
    return files.select("source", "target", "total", starts.alias("offset")).select("source", "target", "offset", F.least(F.lit(size), F.col("total") - F.col("offset")).alias("size"))


def _each(rows: DataFrame, work: Callable[[dict, stores.Ranges], int], store: str | None) -> DataFrame:
    """Each range with the checksum that ``work`` gives, or what went wrong."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with stores.Ranges(store) as ranges:
            for b in batches:
                out = []
                for r in b.to_pylist():
                    row = {k: r[k] for k in ("source", "target", "offset", "size")} | {"crc": None, "problem": None}
                    try:
                        row["crc"] = work(r, ranges)
                    except OSError as e:
                        row["problem"] = str(e)
                    out.append(row)
                yield pa.RecordBatch.from_pylist(out, schema=_KINDS)

    return rows.select("source", "target", "offset", "size").repartition("target", "offset").mapInArrow(run, PLAN)


def _pieces(path: str, at: int, size: int, ranges: stores.Ranges) -> Iterator[tuple[int, bytes]]:
    for first in range(at, at + size, PIECE):
        n = min(PIECE, at + size - first)
        raw = ranges.read(path, first, n)
        if len(raw) < n:
            raise OSError(f"{path} ends before {first + n}")
        yield first, raw


def put(rows: DataFrame, store: str | None = None) -> DataFrame:
    """Copy ranges into ``target`` + ".part", which all tasks write to; the checksums of what was read."""

    def copy(r: dict, ranges: stores.Ranges) -> int:
        os.makedirs(os.path.dirname(r["target"]), exist_ok=True)
        handle, crc = os.open(f"{r['target']}.part", os.O_WRONLY | os.O_CREAT), 0
        try:
            for at, raw in _pieces(r["source"], r["offset"], r["size"], ranges):
                crc, left = zlib.crc32(raw, crc), memoryview(raw)
                while len(left):
                    done = os.pwrite(handle, left, at)
                    at, left = at + done, left[done:]
            os.fsync(handle)
        finally:
            os.close(handle)
        return crc

    return _each(rows, copy, store)


def broken(copied: DataFrame) -> DataFrame:
    """The ranges whose target doesn't hold what was read: each is read again from the target, by whatever task, and compared."""

    def check(r: dict, ranges: stores.Ranges) -> int:
        crc = 0
        for _, raw in _pieces(f"{r['target']}.part", r["offset"], r["size"], ranges):
            crc = zlib.crc32(raw, crc)
        return crc

    again = _each(copied, check, None).select(F.col("target").alias("_t"), F.col("offset").alias("_o"), F.col("crc").alias("_crc"), F.col("problem").alias("_problem"))
    joined = copied.join(again, (copied["target"] == again["_t"]) & (copied["offset"] == again["_o"]))
    return joined.where(~F.col("crc").eqNullSafe(F.col("_crc")) | F.col("problem").isNotNull() | F.col("_problem").isNotNull()).select("source", "target", "offset", "size", F.coalesce("problem", "_problem", F.lit("other bytes")).alias("problem"))


def _finish(rows: DataFrame) -> DataFrame:
    """Cut each whole file to its length and give it its name; (target, bytes)."""
    files = rows.groupBy("target").agg(F.max(F.col("offset") + F.col("size")).alias("bytes"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for target, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if os.path.exists(f"{target}.part"):  # else an earlier run of this task did it
                    os.truncate(f"{target}.part", n)
                    os.replace(f"{target}.part", target)
            yield b

    return files.mapInArrow(name, "target string, bytes bigint")


def copy(spark: SparkSession, source: str, target: str, size: int = RANGE, tries: int = 10, wait: Callable[[int], float] = lambda n: 60.0 * n, store: str | None = None) -> int:
    """Copy a file, or all files below a folder, over what is there; the number of bytes. The target is a path that every executor mounts.

    Ranges that fail or don't compare are copied again, ``tries`` times in all with ``wait(n)`` seconds after the n-th;
    what is broken then is an error, and the target keeps its former content.
    """
    rows = left = tree.settled(plan(spark, source, target, size, store))
    for n in range(1, tries + 1):
        left = tree.settled(broken(tree.settled(put(left, store))))
        if left.isEmpty():
            return tree.settled(_finish(rows)).agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        if n < tries:
            time.sleep(wait(n))
    worst = left.first()
    raise OSError(f"{worst.target} could not be copied: {worst.problem} at {worst.offset}")
