"""Chunked arrays in the Zarr v2 layout with a multiscales record; every task writes the chunk files of its own bands, and levels are kept up chunk by chunk."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumaframe.functions import scalar
from lumaframe.functions.codecs import blosc_decode, blosc_encode
from lumaframe.operators import browse, tree
from lumaframe.sinks.ome import ome_xml
from lumaframe.sources.pixels import BAND, array_of
from lumaframe.streaming import ingest


# How an array's record names its compressor.
COMPRESSORS = {"blosc": {"id": "blosc", "cname": "zstd", "clevel": 5, "shuffle": 1, "blocksize": 0}, "zlib": {"id": "zlib", "level": 5}}


def level_count(w: int, h: int, side: int = BAND) -> int:
    n = 1
    while max(w, h) > side:
        w, h, n = -(-w // 2), -(-h // 2), n + 1
    return n


def packed(raw: bytes, size: int, compressor: str) -> bytes:
    return blosc_encode(raw, size) if compressor == "blosc" else zlib.compress(raw, 5)


def unpacked(raw: bytes, compressor: str) -> bytes:
    return blosc_decode(raw) if compressor == "blosc" else zlib.decompress(raw)


#: What is said of each chunk written.
WRITTEN_DDL = "t int, c int, z int, y int, x int, file string, bytes bigint"
WRITTEN = pa.schema([(k, pa.int32()) for k in "tczyx"] + [("file", pa.string()), ("bytes", pa.int64())])


def put_chunk(name: str, tile: np.ndarray, compressor: str) -> dict:
    """Write a chunk's file; a task that runs again leaves the same file."""
    raw = packed(tile.tobytes(), tile.itemsize, compressor)
    os.makedirs(os.path.dirname(name), exist_ok=True)
    with open(f"{name}.part", "wb") as file:
        file.write(raw)
    os.replace(f"{name}.part", name)
    return {"file": name, "bytes": len(raw)}


def chunk_files(bands: DataFrame, path: str, level: int, compressor: str = "blosc") -> DataFrame:
    """Write each band as its chunks; (t, c, z, y, x, file, bytes) of what was written. The folder is one that every executor mounts."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                a = array_of(r)
                for k, plane in enumerate([a] if a.ndim == 2 else np.moveaxis(a, 2, 0)):
                    for x in range(0, r["w"], BAND):
                        tile = np.zeros((BAND, min(BAND, max(r["w"], 1))), r["dtype"])
                        part = plane[:, x : x + BAND]
                        tile[: part.shape[0], : part.shape[1]] = part
                        at = {"t": r["t"], "c": r["c"] + k, "z": r["z"], "y": r["y0"] // BAND, "x": x // BAND}
                        rows.append(at | put_chunk(f"{path}/{level}/{'.'.join(map(str, at.values()))}", tile, compressor))
            yield pa.RecordBatch.from_pylist(rows, schema=WRITTEN)

    return bands.mapInArrow(write, WRITTEN_DDL)


def child_means(path: str, level: int, meta: dict, compressor: str, at: tuple[int, ...], shape: tuple[int, int]) -> np.ndarray:
    """A chunk of a level from the four below it: means of 2 x 2 pixels, as far as the edge lets them reach, half to even. ``shape``: (h, w) of the level below."""
    t, c, z, y, x = at
    ch, cw = meta["chunks"][3:]
    h, w = (min(2 * n, size - 2 * n * k) for n, size, k in ((ch, shape[0], y), (cw, shape[1], x)))
    below = np.zeros((h, w), meta["dtype"])
    for i in range(2):
        for j in range(2):
            try:
                with open(f"{path}/{level - 1}/{t}.{c}.{z}.{2 * y + i}.{2 * x + j}", "rb") as file:
                    tile = np.frombuffer(unpacked(file.read(), compressor), meta["dtype"]).reshape(ch, cw)
            except FileNotFoundError:  # not there yet: the fill value
                continue
            part = below[i * ch : (i + 1) * ch, j * cw : (j + 1) * cw]
            part[...] = tile[: part.shape[0], : part.shape[1]]
    ys, xs = np.arange(0, h, 2), np.arange(0, w, 2)
    total = np.add.reduceat(np.add.reduceat(below.astype(np.float64), ys, 0), xs, 1)
    n = np.minimum(2, h - ys)[:, None] * np.minimum(2, w - xs)[None, :]
    out = np.zeros((ch, cw), meta["dtype"])
    out[: len(ys), : len(xs)] = np.rint(total / n)
    return out


def above(changed: DataFrame, *same: str) -> DataFrame:
    """The chunks of the next level that lie above those that changed, each once."""
    half = lambda c: F.floor(F.col(c) / 2).cast(changed.schema[c].dataType).alias(c)
    return changed.select(*same, half("y"), half("x")).distinct()


def parents(changed: DataFrame, path: str, level: int) -> DataFrame:
    """(t, c, z, y, x, file, bytes): the chunks of a level above those that changed, each made anew from the four below it."""
    with open(f"{path}/{level - 1}/.zarray") as file:
        meta = json.load(file)
    compressor, shape = meta["compressor"]["id"], tuple(meta["shape"][3:])
    dirty = above(changed, "t", "c", "z")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                at = tuple(r[k] for k in "tczyx")
                rows.append(r | put_chunk(f"{path}/{level}/{'.'.join(map(str, at))}", child_means(path, level, meta, compressor, at, shape), compressor))
            yield pa.RecordBatch.from_pylist(rows, schema=WRITTEN)

    return dirty.mapInArrow(make, WRITTEN_DDL)


def keep_up(written: DataFrame, path: str, levels: int) -> int:
    """Write a level's chunks, and then of each level above only the parents of what changed; the number of chunk files written."""
    files = 0
    for level in range(levels):
        changed = tree.settled(written if level == 0 else parents(changed, path, level))
        files += changed.count()
    return files


def append_chunks(stream: DataFrame, path: str, checkpoint: str, image: dict | None = None, compressor: str = "blosc") -> StreamingQuery:
    """Write bands that arrive as a stream, and keep all levels of an array up with them; a batch that runs again leaves the same files.

    ``image`` describes the array, if it isn't described yet; without either only level 0 is written.
    """
    if image is not None:
        describe_array(path, image, None, compressor)
    held = f"{path}/0/.zarray"
    levels = 1
    if os.path.exists(held):
        with open(held) as file:
            meta = json.load(file)
        levels, compressor = level_count(meta["shape"][4], meta["shape"][3]), meta["compressor"]["id"]
    return stream.writeStream.foreachBatch(lambda bands, _: keep_up(chunk_files(bands, path, 0, compressor), path, levels)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def omero(image: dict, dtype: str) -> dict:
    """How a viewer shows the channels: labels, colours, and as their window what was measured (``windows``), or the range of the type."""
    top, n = (65535 if dtype == "<u2" else 255), len(image.get("labels") or []) or image.get("channels") or 1
    pick = lambda k, i, d: (image.get(k) or [])[i] if i < len(image.get(k) or []) else d
    shown = [(image.get("windows") or {}).get(i, (0, top)) for i in range(n)]
    channels = [{"label": pick("labels", i, f"Channel {i + 1}"), "color": pick("colours", i, "ffffff"), "active": True, "window": {"min": 0, "max": top, "start": low, "end": high}} for i, (low, high) in enumerate(shown)]
    return {"id": 1, "name": image.get("save_child_name"), "version": "0.5", "channels": channels, "rdefs": {"model": "color" if n > 1 else "greyscale"}}


def describe_array(path: str, image: dict, original: str | None = None, compressor: str = "blosc") -> int:
    """Write the records of an array and its levels; the number of levels."""
    w, h = image["xs"], image["ys"]
    shape = [image.get("ts") or 1, image.get("channels") or 1, image.get("zs") or 1]
    dtype = "<u2" if max(image.get("channelResolution") or [8]) > 8 else "|u1"
    x, y = image.get("scale_x") or 1.0, image.get("scale_y") or image.get("scale_x") or 1.0
    z = next((v for v in (image.get("zres2"), (image.get("zres") or 0) * 1e6) if v and v > 0), min(x, y))
    scale = [image.get("tres") or 1.0, 1.0, z, y, x]
    sets, chunk = [], [1, 1, 1, BAND, min(BAND, w)]
    for level in range(level_count(w, h)):
        array = {"zarr_format": 2, "shape": [*shape, h, w], "chunks": chunk, "dtype": dtype, "compressor": COMPRESSORS[compressor], "fill_value": 0, "order": "C", "filters": None, "dimension_separator": "."}
        os.makedirs(f"{path}/{level}", exist_ok=True)
        with open(f"{path}/{level}/.zarray", "w") as file:
            json.dump(array, file)
        sets.append({"path": str(level), "coordinateTransformations": [{"type": "scale", "scale": [*scale[:3], scale[3] * 2**level, scale[4] * 2**level]}]})
        w, h = -(-w // 2), -(-h // 2)
    axes = [{"name": "t", "type": "time", "unit": "second"}, {"name": "c", "type": "channel"}] + [{"name": n, "type": "space", "unit": "micrometer"} for n in "zyx"]
    with open(f"{path}/.zgroup", "w") as file:
        json.dump({"zarr_format": 2}, file)
    with open(f"{path}/.zattrs", "w") as file:
        json.dump({"multiscales": [{"version": "0.4", "name": image.get("save_child_name"), "axes": axes, "datasets": sets}], "omero": omero(image, dtype), "leica": json.loads(image.get("keyvalues") or "{}")}, file)
    os.makedirs(f"{path}/OME", exist_ok=True)
    with open(f"{path}/OME/METADATA.ome.xml", "w") as file:
        file.write(ome_xml(image, tiff=False, original=original))
    return len(sets)


def write_zarr(bands: DataFrame, image: dict, path: str, original: str | None = None, compressor: str = "blosc") -> int:
    """Write one image's bands, pyramid and description to ``path``; the number of chunk files. Each level is made from the chunks below it.

    ``compressor``: "blosc" (zstd over shuffled bytes) or "zlib".
    """
    levels = describe_array(path, image, original, compressor)
    return keep_up(chunk_files(bands, path, 0, compressor), path, levels)


def status(spark: SparkSession, path: str) -> DataFrame:
    """(level, total, written, bytes, percent) of an array: how much of each level is there, levels in their order."""
    with open(f"{path}/.zattrs") as file:
        names = [s["path"] for s in json.load(file)["multiscales"][0]["datasets"]]
    shapes = []
    for name in names:
        with open(f"{path}/{name}/.zarray") as file:
            meta = json.load(file)
        shapes.append((name, [-(-n // c) for n, c in zip(meta["shape"], meta["chunks"], strict=True)]))
    due = spark.createDataFrame(shapes, "level string, grid array<int>")
    due = due.select("level", F.explode(F.sequence(F.lit(1), F.aggregate("grid", F.lit(1), lambda a, n: a * n))).alias("chunk"))
    there = browse.files(spark, path).where(F.col("name").rlike("^[0-9]+([.][0-9]+){4}$")).select(F.substring_index("dir", "/", -1).alias("level"), F.col("length").alias("bytes"))
    return ingest.chunk_progress(due, there, ["level"]).orderBy(scalar.numeric_order(F.col("level")))


def read_zarr(path: str, level: int = 0) -> np.ndarray:
    """A whole level, for small arrays."""
    with open(f"{path}/{level}/.zarray") as file:
        meta = json.load(file)
    out = np.zeros(meta["shape"], meta["dtype"])
    for name in os.listdir(f"{path}/{level}"):
        if name[0] == ".":
            continue
        t, c, z, y, x = map(int, name.split("."))
        with open(f"{path}/{level}/{name}", "rb") as file:
            tile = np.frombuffer(unpacked(file.read(), meta["compressor"]["id"]), meta["dtype"]).reshape(meta["chunks"][3:])
        y, x = y * meta["chunks"][3], x * meta["chunks"][4]
        part = out[t, c, z, y : y + tile.shape[0], x : x + tile.shape[1]]
        part[...] = tile[: part.shape[0], : part.shape[1]]
    return out
