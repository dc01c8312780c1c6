"""Tiled BigTIFF with a pyramid, one file for each image, written by all tasks at once.

Rows of tiles are packed where bands are made and staged beside the file, each with its size. Prefix sums in two
levels (within groups of rows, and over the groups, of which there are at most ``GROUPS``) give each row of tiles
its offset. Then tasks write their rows into the file where they belong, and one small task, which sees
sizes only, writes the directories and gives the file its name. A task that runs again writes the same bytes to the same place.
"""

from __future__ import annotations

import logging
import os
import shutil
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumaframe.functions.codecs import PACKINGS, Packing, unpack_tile
from lumaframe.sinks.ome import ome_xml
from lumaframe.sources import stores
from lumaframe.sources.pixels import BAND, array_of, halve
from lumaframe.sources.tiff_source import ASCII, BITS, COMPRESSION, COUNTS, DESCRIPTION, FORMS, KIND, LENGTH, LONG, LONG8, OFFSETS, PHOTOMETRIC, PLANAR, PREDICTOR, SAMPLES, SHORT, SUB, TILE_L, TILE_W, WIDTH, XML, row_of, walk

log = logging.getLogger(__name__)

#: Bytes before the first tile.
HEADER = 16
#: Most groups of rows whose sums the driver adds up, and most rows of tiles whose offsets are sent to all tasks.
GROUPS, SENT = 4096, 1_000_000


def directory(tags: list[tuple[int, int, list | bytes]], at: int, after: int) -> bytes:
    """A directory that stands at ``at``, with the values that don't fit in it behind it."""
    body, extra = struct.pack("<Q", len(tags)), b""
    start = at + 8 + 20 * len(tags) + 8
    for tag, kind, values in sorted(tags, key=lambda t: t[0]):
        raw = values if kind == ASCII else struct.pack(f"<{len(values)}{FORMS[kind]}", *values)
        n = len(raw) if kind == ASCII else len(values)
        if len(raw) <= 8:
            body += struct.pack("<HHQ", tag, kind, n) + raw.ljust(8, b"\0")
        else:
            body += struct.pack("<HHQQ", tag, kind, n, start + len(extra))
            extra += raw + b"\0" * (-len(raw) % 8)
    return body + struct.pack("<Q", after) + extra


class Plan:
    """What an image's file looks like: its levels, the rows of tiles in their order, and the tags of a directory."""

    def __init__(self, image: dict, levels: int, packing: Packing, original: str | None) -> None:
        self.packing = packing
        self.samples = 3 if image.get("isrgb") else 1
        self.dtype = "<u2" if max(image.get("channelResolution") or [8]) > 8 else "|u1"
        self.count = 1 if self.samples == 3 else image.get("channels") or 1
        self.slices = image.get("zs") or 1
        self.planes = (image.get("ts") or 1) * self.count * self.slices
        self.sizes = [(image["xs"], image["ys"])]
        for _ in range(levels - 1):
            self.sizes.append((-(-self.sizes[-1][0] // 2), -(-self.sizes[-1][1] // 2)))
        self.tile_w, self.tile_h = (image.get(k) or BAND for k in ("tile_w", "tile_h"))
        self.bands = [-(-h // BAND) for _, h in self.sizes]
        self.description = ome_xml(image, original=original).encode() + b"\0"

    def row(self, r: dict, level: int) -> int:
        """The number of a band's row of tiles: plane by plane, level by level."""
        plane = (r["t"] * self.count + r["c"]) * self.slices + r["z"]
        return plane * sum(self.bands) + sum(self.bands[:level]) + r["y0"] // BAND

    @property
    def rows(self) -> int:
        return self.planes * sum(self.bands)

    def pack(self, a: np.ndarray) -> list[bytes]:
        out = []
        for x in range(0, a.shape[1], self.tile_w):
            tile = np.zeros((self.tile_h, self.tile_w, self.samples), self.dtype)
            part = a[:, x : x + self.tile_w].reshape(len(a), -1, self.samples)
            tile[: part.shape[0], : part.shape[1]] = part
            out.append(self.packing.tile(tile))
        return out

    def tags(self, level: int, offsets: list[int], sizes: list[int]) -> list:
        w, h = self.sizes[level]
        out = [(WIDTH, LONG8, [w]), (LENGTH, LONG8, [h]), (BITS, SHORT, [np.dtype(self.dtype).itemsize * 8] * self.samples), (COMPRESSION, SHORT, [self.packing.number]), (PHOTOMETRIC, SHORT, [2 if self.samples == 3 else 1])]
        out += [(SAMPLES, SHORT, [self.samples]), (PLANAR, SHORT, [1]), (TILE_W, LONG8, [self.tile_w]), (TILE_L, LONG8, [self.tile_h]), (OFFSETS, LONG8, offsets), (COUNTS, LONG8, sizes)]
        return out + ([(PREDICTOR, SHORT, [2])] if self.packing.differences else []) + ([(KIND, LONG, [1])] if level else [])

    def write_directories(self, file, rows: Iterator[tuple[int, list[int]]]) -> None:
        """Append all directories, smaller levels before their plane's own, and link them; ``rows``: each row's offset and tile sizes, in order."""
        last = 8
        file.seek(0)
        file.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0))
        place = lambda: file.seek(0, os.SEEK_END) + file.write(b"\0" * (-file.tell() % 8))
        for plane in range(self.planes):
            held = []
            for level in range(len(self.sizes)):
                offsets, sizes = [], []
                for _ in range(self.bands[level]):
                    at, own = next(rows)
                    offsets += (at + np.cumsum([0, *own[:-1]])).tolist()
                    sizes += own
                held.append(self.tags(level, offsets, sizes))
            subs = []
            for tags in held[1:]:
                subs.append(place())
                file.write(directory(tags, subs[-1], 0))
            own = held[0] + ([(SUB, LONG8, subs)] if subs else []) + ([(DESCRIPTION, ASCII, self.description), (XML, ASCII, self.description)] if plane == 0 else [])
            at = place()
            file.write(directory(own, at, 0))
            file.seek(last)
            file.write(struct.pack("<Q", at))
            last = at + 8 + 20 * len(own)


def with_offsets(sizes: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """((row, sizes, offset), end of the last): where each row of tiles begins. Sums within a group are a window, sums of groups are few enough for the driver."""
    group = F.floor(F.col("row") / -(-rows // GROUPS)).cast("int")
    own = sizes.withColumns({"size": F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b), "grp": group})
    sums = sorted((r.grp, r.n) for r in own.groupBy("grp").agg(F.sum("size").alias("n")).collect())  # GROUPS rows at most
    starts = np.cumsum([HEADER, *(n for _, n in sums)]).tolist()
    base = sizes.sparkSession.createDataFrame([(g, at) for (g, _), at in zip(sums, starts, strict=False)], "grp int, base bigint")
    before = F.sum("size").over(W.partitionBy("grp").orderBy("row").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    return own.withColumn("before", before).join(F.broadcast(base), "grp").select("row", "sizes", (F.col("base") + F.col("before")).alias("offset")), starts[-1]


def write_tiff(levels: list[DataFrame], image: dict, path: str, original: str | None = None, packing: str | Packing = "deflate") -> DataFrame:
    """Write one image's levels to one file on a folder that every executor mounts; (file, bytes) of it.

    ``packing``: "deflate" or "lzw", both over horizontal differences, or "none". The description stands in
    its usual place and, whole, under a private tag.
    """
    spark = levels[0].sparkSession
    plan = Plan(image, len(levels), PACKINGS[packing] if isinstance(packing, str) else packing, original)
    stage, part = f"{path}.{uuid.uuid4().hex}.tiles", f"{path}.{uuid.uuid4().hex}.part"

    def cut(level: int):
        def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    tiles = plan.pack(array_of(r))
                    yield pa.RecordBatch.from_pylist([{"row": plan.row(r, level), "sizes": [len(t) for t in tiles], "raw": b"".join(tiles)}], schema=pa.schema([("row", pa.int64()), ("sizes", pa.list_(pa.int64())), ("raw", pa.binary())]))

        return rows_of

    every = None
    for k, df in enumerate(levels):
        rows = df.mapInArrow(cut(k), "row bigint, sizes array<bigint>, raw binary")
        every = rows if every is None else every.unionByName(rows)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle = os.open(part, os.O_WRONLY | os.O_CREAT)
        n = 0
        try:
            for b in batches:
                for at, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    left = memoryview(raw.as_buffer())
                    while len(left):
                        done = os.pwrite(handle, left, at)
                        at, left, n = at + done, left[done:], n + done
            os.fsync(handle)
        finally:
            os.close(handle)
        yield pa.RecordBatch.from_pydict({"bytes": pa.array([n], pa.int64())})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        with open(part, "r+b") as file:
            file.truncate(end)  # what an earlier run of this task may have left
            plan.write_directories(file, rows)
        os.replace(part, path)
        yield pa.RecordBatch.from_pylist([{"file": path, "bytes": os.path.getsize(path)}], schema=pa.schema([("file", pa.string()), ("bytes", pa.int64())]))

    try:
        every.write.parquet(stage)
        staged = spark.read.parquet(stage)
        offsets, end = with_offsets(staged.select("row", "sizes"), plan.rows)
        near = F.broadcast(offsets.select("row", "offset")) if plan.rows <= SENT else offsets.select("row", "offset")
        staged.select("row", "raw").join(near, "row").select("offset", "raw").mapInArrow(put, "bytes bigint").agg(F.sum("bytes")).collect()
        ordered = offsets.repartition(1).sortWithinPartitions("row").select("offset", "sizes")  # numbers alone
        done = ordered.mapInArrow(finish, "file string, bytes bigint").collect()
    finally:
        shutil.rmtree(stage, ignore_errors=True)
        if os.path.exists(part):
            os.remove(part)
    return spark.createDataFrame(done, "file string, bytes bigint")


def write_or_store(levels: list[DataFrame], image: dict, path: str, original: str | None = None, packing: str | Packing = "deflate") -> DataFrame:
    """As ``write_tiff``; where the packing fails, a second try stores tiles as they are. What fails then is raised."""
    try:
        return write_tiff(levels, image, path, original, packing)
    except PySparkException as e:
        if packing == "none":
            raise
        log.warning("%s: tiles are stored unpacked, as packing them failed: %s", path, str(e).splitlines()[-1:])
        return write_tiff(levels, image, path, original, "none")


def pyramid(bands: DataFrame, w: int, h: int, most: int = 8) -> list[DataFrame]:
    """All levels, each made from the one before, which is kept on the executors' disks until the caller lets go of it."""
    levels = [bands]
    while max(w, h) > BAND and len(levels) < most:
        levels[-1].persist(StorageLevel.DISK_ONLY)
        levels.append(halve(levels[-1]))
        w, h = -(-w // 2), -(-h // 2)
    return levels


def read_tiff(path: str) -> list[list[np.ndarray]]:
    """For each plane its levels, for small files; see ``tiff_source`` for others."""
    planes: list[list[np.ndarray]] = []
    with stores.Ranges() as ranges:
        for plane, level, tags in walk(ranges, path):
            r = row_of(path, plane, level, tags, 0)
            dtype, across = "<u2" if r["bits"] > 8 else "|u1", -(-r["width"] // r["tile_w"])
            out = np.zeros((-(-r["length"] // r["tile_l"]) * r["tile_l"], across * r["tile_w"], r["samples"]), dtype)
            for i, (at, size) in enumerate(zip(r["offsets"], r["sizes"], strict=True)):
                y, x = i // across * r["tile_l"], i % across * r["tile_w"]
                out[y : y + r["tile_l"], x : x + r["tile_w"]] = unpack_tile(ranges.read(path, at, size), r["compression"], r["predictor"], (r["tile_l"], r["tile_w"], r["samples"]), dtype)
            out = out[: r["length"], : r["width"]]
            if level == 0:
                planes.append([])
            planes[-1].append(out if r["samples"] > 1 else out[:, :, 0])
    return planes
