"""Operators over pixels held as rows (group columns, y, x, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strided_minmax(pixels: DataFrame, by: list[str], step: int) -> DataFrame:
    """Minimum and maximum of every step-th row: the rows are filtered before anything is grouped."""
    return pixels.where(F.col("y") % step == 0).groupBy(*by).agg(F.min("v").alias("vmin"), F.max("v").alias("vmax"), F.count(F.lit(1)).alias("n"))


def downsample2(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Half the size: the mean of each 2 x 2 block, as far as the edge lets it reach, half to even."""
    half = lambda c: F.floor(F.col(c) / 2).cast("long").alias(c)
    return pixels.groupBy(*by, half("y"), half("x")).agg(F.rint(F.avg("v")).cast("long").alias("v"))


def percentile_bounds(pixels: DataFrame, by: list[str], low: float = 0.0001, high: float = 0.999) -> DataFrame:
    return pixels.groupBy(*by).agg(F.percentile("v", F.lit(low)).alias("lo"), F.percentile("v", F.lit(high)).alias("hi"))


def stretch(pixels: DataFrame, by: list[str], top: int = 255, **bounds: float) -> DataFrame:
    """Values between the percentile bounds on the scale 0 to ``top``, cut off, not rounded."""
    edges = percentile_bounds(pixels, by, **bounds)
    share = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
    return pixels.join(edges, by).withColumn("v", F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * top).cast("long")).drop("lo", "hi")


def project(pixels: DataFrame, over: list[str]) -> DataFrame:
    """The greatest value along the axes left out of ``over``."""
    return pixels.groupBy(*over).agg(F.max("v").alias("v"))


def blend(pixels: DataFrame, colours: dict[str, Column], at: list[str], top: int = 255) -> DataFrame:
    """Channels weighted by their colours and added: one output column for each colour, cut at ``top``."""
    return pixels.groupBy(*at).agg(*[F.least(F.floor(F.sum(F.col("v") * w) / 255).cast("long"), F.lit(top).cast("long")).alias(name) for name, w in colours.items()])


def orient(pixels: DataFrame, height: Column, width: Column, flip_y: bool, flip_x: bool, swap: bool) -> DataFrame:
    """Flips, then a transposition if the axes are swapped."""
    y = height - 1 - F.col("y") if flip_y else F.col("y")
    x = width - 1 - F.col("x") if flip_x else F.col("x")
    y, x = (x, y) if swap else (y, x)
    return pixels.withColumns({"y": y.cast("long"), "x": x.cast("long")})


def canvas(fields: int, size: int, overlap: float) -> int:
    """Length of a mosaic's side."""
    return size if fields <= 1 else int((fields - 1) * size * (1 - overlap) + size)


def stitch(pixels: DataFrame, tile: str, field_x: Column, field_y: Column, size: tuple[int, int], overlap: float, fields: tuple[int, int], by: list[str] | None = None) -> DataFrame:
    """Tiles (height, width in ``size``) on one canvas; where they overlap the later tile shows."""
    height, width = size
    x = F.floor(field_x * width * (1 - overlap)).cast("long") + F.col("x")
    y = F.floor(field_y * height * (1 - overlap)).cast("long") + F.col("y")
    rows, cols = canvas(fields[0], height, overlap), canvas(fields[1], width, overlap)
    placed = pixels.withColumns({"_y": y, "_x": x}).where((F.col("_y") < rows) & (F.col("_x") < cols))
    return placed.groupBy(*(by or []), F.col("_y").alias("y"), F.col("_x").alias("x")).agg(F.max_by("v", tile).alias("v"))


def chunk_stats(pixels: DataFrame, by: list[str], side: int) -> DataFrame:
    key = lambda c: F.floor(F.col(c) / side).cast("long").alias(f"chunk_{c}")
    return pixels.groupBy(*by, key("y"), key("x")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.min("v").alias("vmin"), F.max("v").alias("vmax"))


def plane_ordinal(t: Column, c: Column, z: Column, channels: int, slices: int) -> Column:
    """A plane's number when z runs fastest, then channels, then time."""
    return (t * channels + c) * slices + z
