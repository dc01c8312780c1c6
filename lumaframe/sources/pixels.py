"""Pixels of images as rows of bands: a plane is found by adding up its increments, and only the rows asked for are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.sources import stores

BAND = 512
#: Bytes from one row to the next up to which both are read at once.
NEAR = 8192
CHUNKS = "uuid string, t int, c int, z int, s int, y0 int, h int, w int, step int, samples int, dtype string, data binary"
CHUNK_KINDS = pa.schema(
    [("uuid", pa.string())] + [(k, pa.int32()) for k in ("t", "c", "z", "s", "y0", "h", "w", "step", "samples")] + [("dtype", pa.string()), ("data", pa.binary())]
)


def planes(wide: DataFrame, centre: bool = False, stored: bool = False) -> DataFrame:
    """One row for each plane of each image with its byte offset; with ``centre`` only the middle time, slice and tile.

    Images whose memory block isn't in the file have no planes. ``stored``: extents are exchanged where
    the settings say that axes are swapped, as such planes lie in the file. Pixels of linked images lie
    in ``pixel_path``. A column ``step`` goes along.
    """
    path = F.coalesce("pixel_path", "path") if "pixel_path" in wide.columns else F.col("path")
    swap = F.coalesce(F.col("swapxy"), F.lit(0)) != 0 if stored and "swapxy" in wide.columns else F.lit(False)
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    steps = lambda n, c: F.array(F.floor(one(c) / 2).cast("int")) if centre else F.sequence(F.lit(0), one(c) - 1)
    df = wide.select("*", F.when(F.coalesce("isrgb", F.lit(False)), 3).otherwise(1).alias("samples"))
    count = F.when(F.col("samples") == 3, 1).otherwise(one("channels"))
    df = df.withColumn("c", F.explode(F.sequence(F.lit(0), count - 1)))
    for n, c in (("t", "ts"), ("z", "zs"), ("s", "tiles")):
        df = df.withColumn(n, F.explode(F.when(one(c) > 1, steps(n, c)).otherwise(F.array(F.lit(0)))))
    own = F.coalesce(F.get("channelbytesinc", F.col("c")), F.lit(0))
    offset = F.col("Position") + F.col("t") * F.col("tbytesinc") + F.col("s") * F.col("tilebytesinc") + F.col("z") * F.col("zbytesinc") + F.when(F.col("samples") == 3, F.lit(0)).otherwise(own)
    bits = F.coalesce(F.array_max("channelResolution"), F.lit(8))
    w, rows = F.when(swap, F.col("ys")).otherwise(F.col("xs")), F.when(swap, F.col("xs")).otherwise(F.col("ys"))
    more = ["step"] if "step" in wide.columns else []
    return df.select(path.alias("path"), "uuid", "t", "c", "z", "s", w.alias("w"), rows.alias("rows"), "samples", offset.alias("offset"), F.when(bits > 8, "<u2").otherwise("|u1").alias("dtype"), *more).where("offset IS NOT NULL")


def read_band(ranges: stores.Ranges, r: dict, step: int, band: int) -> dict | None:
    """The band of a plane that begins at row y0, every step-th row of it; nothing if the stride has none of its rows.

    Rows that are far apart are read one by one, others with what lies between them.
    """
    line = r["w"] * r["samples"] * np.dtype(r["dtype"]).itemsize
    first = -(-r["y0"] // step) * step
    lines = range(first, min(r["y0"] + band, r["rows"]), step)
    if not lines:
        return None
    if step == 1 or step * line < NEAR:
        size = (lines[-1] - first + 1) * line
        raw = ranges.read(r["path"], r["offset"] + first * line, size).ljust(size, b"\0")
        raw = raw if step == 1 else b"".join(raw[(y - first) * line : (y - first + 1) * line] for y in lines)
    else:
        raw = b"".join(ranges.read(r["path"], r["offset"] + y * line, line).ljust(line, b"\0") for y in lines)
    return {k: r[k] for k in ("uuid", "t", "c", "z", "s", "w", "samples", "dtype")} | {"y0": first // step, "h": len(lines), "step": step, "data": raw}


def chunks(wanted: DataFrame, step: int = 1, band: int = BAND, store: str | None = None) -> DataFrame:
    """Bands of ``band`` rows of every plane, every step-th row of them; rows that the file lacks read as zero.

    Files are read by ranges from wherever they lie (see ``stores``). Reading is dealt out by band, and the
    stride is taken before anything is read. Where ``wanted`` has a column ``step``, each plane has its own.
    """
    rows = wanted.withColumn("y0", F.explode(F.sequence(F.lit(0), F.col("rows") - 1, F.lit(band))))
    rows = rows.repartition(F.col("uuid"), "t", "c", "z", "s", "y0").select("path", "uuid", "t", "c", "z", "s", "y0", "w", "rows", "samples", "offset", "dtype", F.col("step") if "step" in wanted.columns else F.lit(step).alias("step"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with stores.Ranges(store) as ranges:
            for b in batches:
                for r in b.to_pylist():
                    if (out := read_band(ranges, r, r["step"], band)) is not None:
                        yield pa.RecordBatch.from_pylist([out], schema=CHUNK_KINDS)

    return rows.mapInArrow(read, CHUNKS)


def array_of(row) -> np.ndarray:
    """A chunk row's pixels: (h, w), or (h, w, samples)."""
    out = np.frombuffer(row["data"], row["dtype"])
    return out.reshape((row["h"], row["w"]) if row["samples"] == 1 else (row["h"], row["w"], row["samples"]))


def pixels(bands: DataFrame) -> DataFrame:
    """(uuid, t, c, z, s, y, x, v): bands as rows of pixels; a colour image's samples are its channels."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                a = array_of(r)
                a = a[:, :, None] if a.ndim == 2 else a
                y, x, k = (i.ravel() for i in np.indices(a.shape))
                same = lambda v, n=a.size: pa.array(np.full(n, v, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["uuid"]] * a.size), same(r["t"]), pa.array((k + r["c"]).astype(np.int32)), same(r["z"]), same(r["s"]), pa.array((y + r["y0"]).astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(a.ravel().astype(np.int32))],
                    ["uuid", "t", "c", "z", "s", "y", "x", "v"],
                )

    return bands.mapInArrow(explode, "uuid string, t int, c int, z int, s int, y int, x int, v int")


def channel_stats(wide: DataFrame, share: float = 0.1, store: str | None = None) -> DataFrame:
    """(uuid, c, vmin, vmax) of every round(1 / share)-th row of the middle plane: each band gives its own, Spark the rest."""
    step = max(1, round(1 / share))

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                a = array_of(r)
                for k, part in enumerate([a] if a.ndim == 2 else np.moveaxis(a, 2, 0)):
                    rows.append({"uuid": r["uuid"], "c": r["c"] + k, "vmin": int(part.min()), "vmax": int(part.max())})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("uuid", pa.string()), ("c", pa.int32()), ("vmin", pa.int32()), ("vmax", pa.int32())]))

    found = chunks(planes(wide, True), step, store=store).mapInArrow(extremes, "uuid string, c int, vmin int, vmax int")
    return found.groupBy("uuid", "c").agg(F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"))


def halve(bands: DataFrame) -> DataFrame:
    """The next pyramid level: means of 2 x 2 pixels, as far as the edge lets them reach, half to even.

    Two neighbouring bands make one of the next level, so a group holds two bands.
    """

    def mean(rows):
        rows = rows.sort_values("y0")
        first = rows.iloc[0]
        parts = [array_of(r) for _, r in rows.iterrows()]
        a = np.concatenate(parts).astype(np.float64)
        a = a[:, :, None] if a.ndim == 2 else a
        h, w = a.shape[:2]
        ys, xs = np.arange(0, h, 2), np.arange(0, w, 2)
        total = np.add.reduceat(np.add.reduceat(a, ys, 0), xs, 1)
        n = np.minimum(2, h - ys)[:, None, None] * np.minimum(2, w - xs)[None, :, None]
        out = np.rint(total / n).astype(first["dtype"])
        row = {k: [first[k]] for k in ("uuid", "t", "c", "z", "s", "step", "samples", "dtype")} | {"y0": [int(first["y0"]) // 2], "h": [out.shape[0]], "w": [out.shape[1]], "data": [out.tobytes()]}
        return type(rows)(row)[[f.name for f in CHUNK_KINDS]]

    pair = F.floor(F.col("y0") / (2 * BAND)).alias("pair")
    return bands.groupBy("uuid", "t", "c", "z", "s", pair).applyInPandas(mean, CHUNKS)
