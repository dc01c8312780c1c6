"""Tiled BigTIFF files as tables: directories walked by ranged reads, tiles read where they are needed.

A file's chain of directories is a few kB a plane, whatever the tiles weigh. It becomes rows (one for
each plane and level), these become rows of tiles with their places, and tasks read, unpack and check tiles one by one.
"""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.functions import codecs
from lumaframe.sources import stores

# Fixed values of the file format: tags, the types of their values, and these types' forms.
KIND, WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, SAMPLES, PLANAR, PREDICTOR, TILE_W, TILE_L, OFFSETS, COUNTS, SUB, XML = 254, 256, 257, 258, 259, 262, 270, 277, 284, 317, 322, 323, 324, 325, 330, 65000
ASCII, SHORT, LONG, LONG8, IFD8 = 2, 3, 4, 16, 18
FORMS = {1: "B", ASCII: "s", SHORT: "H", LONG: "I", 13: "I", LONG8: "Q", IFD8: "Q"}

DIRECTORIES = "path string, plane int, level int, width bigint, length bigint, samples int, bits int, compression int, predictor int, tile_w int, tile_l int, offsets array<bigint>, sizes array<bigint>, description string, file_size bigint, problem string"
TILES = "path string, plane int, level int, y int, x int, h int, w int, samples int, dtype string, data binary, problem string"


def directory_at(ranges: stores.Ranges, path: str, at: int) -> tuple[dict[int, tuple | bytes], int]:
    """(values by tag, place of the next directory)."""

    def read(place: int, size: int) -> bytes:
        raw = ranges.read(path, place, size)
        if len(raw) < size:
            raise ValueError(f"file ends within {size} bytes from {place}")
        return raw

    (n,) = struct.unpack("<Q", read(at, 8))
    if n > 65535:
        raise ValueError(f"no directory at {at}")
    body, tags = read(at + 8, 20 * n + 8), {}
    for i in range(n):
        tag, kind, count = struct.unpack_from("<HHQ", body, 20 * i)
        form = FORMS.get(kind)
        if form is None:
            continue
        size = count * struct.calcsize(form)
        raw = body[20 * i + 12 : 20 * i + 12 + size] if size <= 8 else read(struct.unpack_from("<Q", body, 20 * i + 12)[0], size)
        tags[tag] = raw if kind == ASCII else struct.unpack(f"<{count}{form}", raw)
    return tags, struct.unpack_from("<Q", body, 20 * n)[0]


def walk(ranges: stores.Ranges, path: str) -> Iterator[tuple[int, int, dict]]:
    """(plane, level, values by tag) of all directories: each plane's own and those of its smaller levels."""
    mark, version, size, _, at = struct.unpack("<2sHHHQ", ranges.read(path, 0, 16).ljust(16, b"\0"))
    if (mark, version, size) != (b"II", 43, 8):
        raise ValueError("not a little-endian BigTIFF")
    plane, seen = 0, set()
    while at:
        if at in seen:
            raise ValueError(f"the chain of directories comes back to {at}")
        seen.add(at)
        tags, at = directory_at(ranges, path, at)
        yield plane, 0, tags
        for level, sub in enumerate(tags.get(SUB, ()), 1):
            yield plane, level, directory_at(ranges, path, sub)[0]
        plane += 1


def row_of(path: str, plane: int, level: int, tags: dict, size: int) -> dict:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    text = lambda tag: tags[tag].rstrip(b"\0").decode("utf-8", "replace") if tag in tags else None
    out = {"path": path, "plane": plane, "level": level, "width": one(WIDTH, 0), "length": one(LENGTH, 0), "samples": one(SAMPLES, 1), "bits": one(BITS, 1), "compression": one(COMPRESSION, 1), "predictor": one(PREDICTOR, 1)}
    out |= {"tile_w": one(TILE_W, 0), "tile_l": one(TILE_L, 0), "offsets": list(tags.get(OFFSETS, ())), "sizes": list(tags.get(COUNTS, ())), "description": text(DESCRIPTION), "file_size": size, "problem": None}
    return out


def directories(spark: SparkSession, paths: list[str] | DataFrame, store: str | None = None) -> DataFrame:
    """One row for each plane and level of each file; a file that can't be walked to its end has a last row with a problem."""
    files = paths if isinstance(paths, DataFrame) else spark.createDataFrame([(p,) for p in paths], "path string")
    names = [f.split()[0] for f in DIRECTORIES.split(", ")]
    numbers = {"plane", "level", "samples", "bits", "compression", "predictor", "tile_w", "tile_l"}
    kinds = {n: pa.int32() if n in numbers else pa.list_(pa.int64()) if n in ("offsets", "sizes") else pa.string() if n in ("path", "description", "problem") else pa.int64() for n in names}

    def list_them(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with stores.Ranges(store) as ranges:
            for b in batches:
                for path in b.column(0).to_pylist():
                    size = 0
                    try:
                        size = ranges.size(path)
                        for plane, level, tags in walk(ranges, path):
                            yield pa.RecordBatch.from_pylist([row_of(path, plane, level, tags, size)], schema=pa.schema(kinds))
                    except (ValueError, OSError, struct.error) as e:
                        yield pa.RecordBatch.from_pylist([dict.fromkeys(names) | {"path": path, "file_size": size, "problem": str(e)}], schema=pa.schema(kinds))

    return files.select("path").mapInArrow(list_them, DIRECTORIES)


def tile_places(found: DataFrame) -> DataFrame:
    """One row for each tile: what its directory says, its number in it, offset and size."""
    each = found.where("problem IS NULL").select("path", "plane", "level", "width", "length", "samples", "bits", "compression", "predictor", "tile_w", "tile_l", F.posexplode(F.arrays_zip("offsets", "sizes")).alias("number", "at"))
    return each.select("*", F.col("at.offsets").alias("offset"), F.col("at.sizes").alias("size")).drop("at")


def read_tiles(places: DataFrame, store: str | None = None) -> DataFrame:
    """The pixels of tiles, cut at the image's edge; a tile that can't be read has a problem and no pixels."""
    kinds = pa.schema([("path", pa.string())] + [(n, pa.int32()) for n in ("plane", "level", "y", "x", "h", "w", "samples")] + [("dtype", pa.string()), ("data", pa.binary()), ("problem", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with stores.Ranges(store) as ranges:
            for b in batches:
                for r in b.to_pylist():
                    dtype, across = "<u2" if r["bits"] > 8 else "|u1", -(-r["width"] // r["tile_w"])
                    y, x = r["number"] // across * r["tile_l"], r["number"] % across * r["tile_w"]
                    h, w = min(r["tile_l"], r["length"] - y), min(r["tile_w"], r["width"] - x)
                    out = {k: r[k] for k in ("path", "plane", "level", "samples")} | {"y": y, "x": x, "h": h, "w": w, "dtype": dtype, "data": None, "problem": None}
                    try:
                        tile = codecs.unpack_tile(ranges.read(r["path"], r["offset"], r["size"]), r["compression"], r["predictor"], (r["tile_l"], r["tile_w"], r["samples"]), dtype)
                        out["data"] = tile[:h, :w].tobytes()
                    except Exception as e:  # noqa: BLE001 whatever a broken tile makes its codec say
                        out["problem"] = f"tile {r['number']}: {e}"
                    yield pa.RecordBatch.from_pylist([out], schema=kinds)

    return places.repartition("path", "plane", "level", "number").mapInArrow(read, TILES)


def described(found: DataFrame) -> DataFrame:
    """(path, sizes, channels and planes that the description speaks of, problem) of each file's first directory."""
    kinds = "path string, sx bigint, sy bigint, expected bigint, size_c bigint, data_blocks bigint, channels bigint, problem string"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                row = dict.fromkeys(("sx", "sy", "expected", "size_c", "data_blocks", "channels", "problem")) | {"path": path}
                try:
                    pixels = ET.fromstring(text or "").find(".//{*}Pixels")
                    if pixels is None:
                        row["problem"] = "no pixels in the description"
                    else:
                        size = {a: int(pixels.get(f"Size{a}") or 1) for a in "XYZCT"}
                        colour = any(c.get("SamplesPerPixel", "1") != "1" for c in pixels.findall("{*}Channel"))
                        row |= {"sx": size["X"], "sy": size["Y"], "size_c": 1 if colour else size["C"], "expected": size["Z"] * size["T"] * (1 if colour else size["C"]), "data_blocks": len(pixels.findall("{*}TiffData")), "channels": len(pixels.findall("{*}Channel"))}
                except (ET.ParseError, ValueError) as e:
                    row["problem"] = f"description: {e}" if text else "no description"
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), *((n, pa.int64()) for n in ("sx", "sy", "expected", "size_c", "data_blocks", "channels")), ("problem", pa.string())]))

    return found.where("plane = 0 AND level = 0").select("path", "description").mapInArrow(parse, kinds)


def validate(found: DataFrame, store: str | None = None, unpack: bool = True) -> DataFrame:
    """(path, planes, errors, warnings) of each file: whether its directories, its description and its tiles fit together.

    Errors: directories that can't be walked; a number of planes other than the description's; other sizes; tiles
    too few, outside the file, above one another or not to be unpacked (``unpack``); smaller levels that
    aren't halves. Warnings: channels without a description.
    """
    say = lambda condition, *text: F.when(condition, F.concat(*(t if isinstance(t, Column) else F.lit(t) for t in text)))
    number = lambda c: F.col(c).cast("string")
    said = described(found).withColumnRenamed("problem", "unsaid")
    walked = found.groupBy("path").agg(F.count(F.when(F.col("level") == 0, 1)).alias("planes"), F.max(F.when((F.col("plane") == 0) & (F.col("level") == 0), F.col("width"))).alias("width"), F.max(F.when((F.col("plane") == 0) & (F.col("level") == 0), F.col("length"))).alias("length"), F.max("problem").alias("broken"))
    files = walked.join(said, "path", "left")
    errors = F.array(
        F.col("broken"), F.col("unsaid"), say(F.col("expected") != F.col("planes"), "planes: ", number("expected"), " described, ", number("planes"), " found"),
        say(F.col("data_blocks") != F.col("planes"), "plane places: ", number("data_blocks"), " described, ", number("planes"), " found"), say((F.col("sx") != F.col("width")) | (F.col("sy") != F.col("length")), "size: ", number("sx"), "x", number("sy"), " described, ", number("width"), "x", number("length"), " found"),
    )
    whole = files.select("path", "planes", errors.alias("errors"), F.array(say(F.col("size_c") != F.col("channels"), "channels: ", number("size_c"), " of ", number("channels"), " described")).alias("warnings"))
    at = F.concat(F.lit("plane "), number("plane"), F.lit(" level "), number("level"), F.lit(": "))
    want = F.ceil(F.col("width") / F.col("tile_w")) * F.ceil(F.col("length") / F.col("tile_l"))
    base = found.where("level = 0").select(F.col("path").alias("_p"), F.col("plane").alias("_n"), F.col("width").alias("_w"), F.col("length").alias("_l"))
    levels = found.where("problem IS NULL").join(base, (F.col("path") == F.col("_p")) & (F.col("plane") == F.col("_n")))
    half = lambda side: F.ceil(F.col(side) / F.call_function("shiftleft", F.lit(1), F.col("level")))
    by_level = levels.select("path", F.explode(F.array(say(F.size("offsets") != want, at, "tiles: ", F.size("offsets").cast("string"), " of ", want.cast("string")), say((half("_w") != F.col("width")) | (half("_l") != F.col("length")), at, "not a half of the level before"))).alias("error"))
    places = tile_places(found).join(found.groupBy(F.col("path").alias("_f")).agg(F.max("file_size").alias("_size")), F.col("path") == F.col("_f"))
    outside = places.where((F.col("offset") < 16) | (F.col("offset") + F.col("size") > F.col("_size"))).select("path", F.concat(at, F.lit("a tile outside the file")).alias("error"))
    every = by_level.unionByName(outside)
    if unpack:
        every = every.unionByName(read_tiles(tile_places(found), store).where("problem IS NOT NULL").select("path", F.concat(at, F.col("problem")).alias("error")))
    listed = every.where("error IS NOT NULL").groupBy("path").agg(F.array_sort(F.collect_set("error")).alias("more"))
    out = whole.join(listed, "path", "left")
    return out.select("path", "planes", F.array_compact(F.concat("errors", F.coalesce("more", F.array().cast("array<string>")))).alias("errors"), F.array_compact("warnings").alias("warnings"))
