"""A cache of previews that stays small: files of its entries, and a log of what was put, met and dropped.

Entries are PNG files in a folder that every executor mounts. The log is appended to and merged when it is read: an entry's last
line says whether it is there, its latest time when it was used. Beyond the capacity the entries unused for
longest leave, with their files. A log of many files is written anew, and a pointer file switches to the new one.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.operators import tree
from lumaframe.sinks import preview

LOG = "key string, uuid string, height int, file string, kind string, at bigint"
_KINDS = pa.schema([("key", pa.string()), ("uuid", pa.string()), ("height", pa.int32()), ("file", pa.string()), ("kind", pa.string()), ("at", pa.int64())])


class PreviewCache:
    """``hits``: whether a use makes an entry young again; without, entries leave by their age. ``version`` changes all keys."""

    def __init__(self, spark: SparkSession, folder: str, capacity: int = 100, version: str = "1", hits: bool = True, most_files: int = 64, clock: Callable[[], int] = time.time_ns) -> None:
        self.spark, self.folder, self.capacity, self.version, self.hits, self.most_files, self.clock = spark, folder, capacity, version, hits, most_files, clock
        os.makedirs(folder, exist_ok=True)

    @property
    def log(self) -> str:
        """The log's folder in its present generation."""
        try:
            with open(f"{self.folder}/CURRENT") as file:
                return f"{self.folder}/{file.read().strip()}"
        except FileNotFoundError:
            return f"{self.folder}/log-0"

    def entries(self) -> DataFrame:
        """(key, uuid, height, file, used) of the entries that are there."""
        if not os.path.isdir(self.log):
            return self.spark.createDataFrame([], LOG).select("key", "uuid", "height", "file", F.col("at").alias("used"))
        used = F.max("at") if self.hits else F.max(F.when(F.col("kind") == "put", F.col("at")))
        last = self.spark.read.schema(LOG).parquet(self.log).groupBy("key", "uuid", "height", "file").agg(F.max_by("kind", "at").alias("kind"), used.alias("used"))
        return last.where("kind <> 'drop'").drop("kind")

    def _note(self, rows: DataFrame, kind: str) -> None:
        rows.select("key", "uuid", "height", "file", F.lit(kind).alias("kind"), F.lit(self.clock()).cast("bigint").alias("at")).write.mode("append").parquet(self.log)

    def get(self, wide: DataFrame, height: int = 256, **options) -> DataFrame:
        """(uuid, height, png) of each image (options as in ``preview.previews``): from the cache, and what it lacks is drawn and added.

        Entries asked for here stay until a later call, even beyond the capacity.
        """
        said = json.dumps({k: v for k, v in options.items() if k != "store"}, sort_keys=True)
        taken = F.coalesce(F.col("experiment_time").cast("string"), F.lit("")) if "experiment_time" in wide.columns else F.lit("")
        key = F.sha1(F.concat_ws("|", "uuid", F.lit(height).cast("string"), F.lit(self.version), taken, F.lit(said)))
        wanted = wide.withColumn("_key", key)
        keys = tree.settled(wanted.select("_key", F.col("uuid").alias("_uuid")).distinct())
        before = tree.settled(self.entries())
        lacking = wanted.join(before.select(F.col("key").alias("_key")), "_key", "left_anti")
        met = before.join(keys, before["key"] == keys["_key"], "left_semi")
        if self.hits and not met.isEmpty():
            self._note(met, "hit")
        if not lacking.isEmpty():
            drawn = preview.previews(lacking.drop("_key"), height, **options)
            self._put(drawn.join(keys, drawn["uuid"] == keys["_uuid"]).select(F.col("_key").alias("key"), "uuid", "height", "png"))
        self._evict(keys)
        self._compact()
        now = self.entries()
        mine = now.join(keys, now["key"] == keys["_key"], "left_semi").select("uuid", "height", "file")
        return mine.mapInArrow(_read, "uuid string, height int, png binary")

    def _put(self, drawn: DataFrame) -> None:
        """Write the files where they are drawn, then say so in the log: a file without a line is overwritten by the next that draws it."""
        folder, at = self.folder, self.clock()

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for r in b.to_pylist():
                    file = f"{folder}/{r['key']}.png"
                    with open(f"{file}.part", "wb") as out:
                        out.write(r["png"])
                    os.replace(f"{file}.part", file)
                    rows.append({k: r[k] for k in ("key", "uuid", "height")} | {"file": file, "kind": "put", "at": at})
                yield pa.RecordBatch.from_pylist(rows, schema=_KINDS)

        drawn.mapInArrow(write, LOG).write.mode("append").parquet(self.log)

    def _evict(self, asked: DataFrame) -> None:
        """Drop what is beyond the capacity, longest unused first. What is ranked is the cache's content: its capacity and what was just asked for."""
        held = self.entries()
        old = held.orderBy(F.desc("used"), "key").offset(self.capacity)
        gone = tree.settled(old.join(asked, old["key"] == asked["_key"], "left_anti"))  # as it is before the log says so
        if not gone.isEmpty():
            self._note(gone, "drop")
            gone.select("file").mapInArrow(_remove, "file string").count()

    def _compact(self) -> None:
        """Write the log anew without what is gone, once it has many files."""
        old = self.log
        if not os.path.isdir(old) or sum(n.endswith(".parquet") for n in os.listdir(old)) <= self.most_files:
            return
        new = f"log-{int(old.rsplit('-', 1)[1]) + 1}"
        self.entries().select("key", "uuid", "height", "file", F.lit("put").alias("kind"), F.col("used").alias("at")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{new}")
        with open(f"{self.folder}/CURRENT.part", "w") as file:
            file.write(new)
        os.replace(f"{self.folder}/CURRENT.part", f"{self.folder}/CURRENT")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        png = []
        for file in b.column(2).to_pylist():
            with open(file, "rb") as f:
                png.append(f.read())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(png, pa.binary())], ["uuid", "height", "png"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for file in b.column(0).to_pylist():
            try:
                os.remove(file)
            except FileNotFoundError:  # by an earlier run of this task
                pass
        yield b
