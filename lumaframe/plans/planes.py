"""Array queries over the virtual plane stack (channel, row, column, value) made of ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumaframe.functions import scalar
from lumaframe.operators import array


def plane_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c = label, y = rank of vec_id in its label from 0, x = array position, v = a 16-bit value."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    y = (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).cast("long")
    rows = rows.select(F.col("label").cast("long").alias("c"), y.alias("y"), "embedding")
    return rows.select("c", "y", F.posexplode("embedding").alias("x", "e")).select(
        "c", "y", F.col("x").cast("long").alias("x"), F.floor((F.col("e").cast("double") + 1) * 32767).cast("long").alias("v")
    )


STACK_SQL = """
WITH r AS (SELECT CAST(label AS BIGINT) AS c, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS y, embedding FROM embeddings),
px AS (SELECT c, CAST(y AS BIGINT) AS y, CAST(i - 1 AS BIGINT) AS x, CAST(floor((CAST(embedding[i] AS DOUBLE) + 1) * 32767) AS BIGINT) AS v
  FROM r, range(1, 65) AS t(i))
"""
BOUNDS_SQL = "q AS (SELECT c, quantile_cont(v, 0.0001) AS lo, quantile_cont(v, 0.999) AS hi FROM px GROUP BY c)"

#: Colour weights of a channel.
RED, GREEN, BLUE = (lambda: F.col("c") * 25 % 256), (lambda: (255 - F.col("c") * 25) % 256), (lambda: F.col("c") * 83 % 256)
#: The mosaic: channels as tiles, in rows of four.
ACROSS, OVERLAP = 4, 0.1


def channel_minmax_strided(spark, sf_dir):
    return array.strided_minmax(plane_stack(spark, sf_dir), ["c"], 10)


def downsample2_mean(spark, sf_dir):
    return array.downsample2(plane_stack(spark, sf_dir), ["c"])


def percentile_bounds(spark, sf_dir):
    found = array.percentile_bounds(plane_stack(spark, sf_dir), ["c"])
    return found.select("c", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def contrast_stretch(spark, sf_dir):
    return array.stretch(plane_stack(spark, sf_dir), ["c"]).select("c", "y", "x", "v")


def z_max_projection(spark, sf_dir):
    return array.project(plane_stack(spark, sf_dir), ["y", "x"])


def channel_blend(spark, sf_dir):
    eight = plane_stack(spark, sf_dir).withColumn("v", F.floor(F.col("v") / 256).cast("long"))
    return array.blend(eight, {"red": RED(), "green": GREEN(), "blue": BLUE()}, ["y", "x"])


def flip_transpose(spark, sf_dir):
    px = plane_stack(spark, sf_dir)
    size = px.groupBy("c").agg((F.max("y") + 1).alias("h"))
    return array.orient(px.join(size, "c"), F.col("h"), F.lit(64), True, False, True).select("c", "y", "x", "v")


def mosaic_stitch(spark, sf_dir):
    """All rows of all channels: the tiles' height and number follow from the data."""
    px = plane_stack(spark, sf_dir)
    size = px.agg((F.max("y") + 1).alias("h"), F.max("c").alias("c")).first()
    fields = (int(size.c or 0) // ACROSS + 1, ACROSS)
    return array.stitch(px, "c", F.col("c") % ACROSS, F.floor(F.col("c") / ACROSS), (int(size.h or 0), 64), OVERLAP, fields)


def chunk_index(spark, sf_dir):
    return array.chunk_stats(plane_stack(spark, sf_dir), ["c"], 16)


def display_scale_12bit(spark, sf_dir):
    return plane_stack(spark, sf_dir).select("c", "y", "x", scalar.display_level(F.col("v") / F.lit(65535.0), 12).alias("v"))


def rgb_interleave(spark, sf_dir):
    """Three channels as one array of samples for each pixel, and its bytes' order reversed."""
    px = plane_stack(spark, sf_dir).where("c < 3").groupBy("y", "x").agg(*[F.max(F.when(F.col("c") == k, F.col("v"))).alias(n) for k, n in enumerate("rgb")])
    return px.select("y", "x", F.concat_ws(",", *[F.col(n).cast("string") for n in "bgr"]).alias("bgr"))


def centre_slice(spark, sf_dir):
    """The middle row of each channel."""
    px = plane_stack(spark, sf_dir)
    size = px.groupBy("c").agg(F.floor((F.max("y") + 1) / 2).cast("long").alias("middle"))
    return px.join(size, "c").where("y = middle").select("c", "y", "x", "v")


QUERIES = {
    f.__name__: f
    for f in (channel_minmax_strided, downsample2_mean, percentile_bounds, contrast_stretch, z_max_projection, channel_blend, flip_transpose, mosaic_stitch, chunk_index, display_scale_12bit, rgb_interleave, centre_slice)
}
SQL = {
    "channel_minmax_strided": STACK_SQL + "SELECT c, min(v) AS vmin, max(v) AS vmax, count(*) AS n FROM px WHERE y % 10 = 0 GROUP BY c",
    "downsample2_mean": STACK_SQL + "SELECT c, y // 2 AS y, x // 2 AS x, CAST(round_even(avg(v), 0) AS BIGINT) AS v FROM px GROUP BY c, y // 2, x // 2",
    "percentile_bounds": STACK_SQL + "SELECT c, round(quantile_cont(v, 0.0001), 6) AS lo, round(quantile_cont(v, 0.999), 6) AS hi FROM px GROUP BY c",
    "contrast_stretch": STACK_SQL + "," + BOUNDS_SQL + " SELECT c, y, x, CAST(trunc(least(greatest((v - lo) / (hi - lo), 0.0), 1.0) * 255) AS BIGINT) AS v FROM px JOIN q USING (c)",
    "z_max_projection": STACK_SQL + "SELECT y, x, max(v) AS v FROM px GROUP BY y, x",
    "channel_blend": STACK_SQL
    + "SELECT y, x, "
    + ", ".join(f"CAST(least(floor(sum(v // 256 * ({w})) / 255), 255) AS BIGINT) AS {n}" for n, w in (("red", "c * 25 % 256"), ("green", "(255 - c * 25) % 256"), ("blue", "c * 83 % 256")))
    + " FROM px GROUP BY y, x",
    "flip_transpose": STACK_SQL + "SELECT c, x AS y, max(y) OVER (PARTITION BY c) - y AS x, v FROM px",
    "mosaic_stitch": STACK_SQL
    + """, n AS (SELECT max(y) + 1 AS h, max(c) // 4 + 1 AS rows FROM px),
p AS (SELECT c, v, CAST(floor(c // 4 * h * CAST(0.9 AS DOUBLE)) AS BIGINT) + y AS yy, CAST(floor(c % 4 * 64 * CAST(0.9 AS DOUBLE)) AS BIGINT) + x AS xx, CASE WHEN rows <= 1 THEN h ELSE floor((rows - 1) * h * CAST(0.9 AS DOUBLE) + h) END AS tall FROM px, n)
SELECT yy AS y, xx AS x, arg_max(v, c) AS v FROM p WHERE yy < tall AND xx < floor(3 * 64 * CAST(0.9 AS DOUBLE) + 64) GROUP BY yy, xx""",
    "chunk_index": STACK_SQL + "SELECT c, y // 16 AS chunk_y, x // 16 AS chunk_x, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, min(v) AS vmin, max(v) AS vmax FROM px GROUP BY c, y // 16, x // 16",
    "display_scale_12bit": STACK_SQL + "SELECT c, y, x, CAST(CASE WHEN v / 65535.0 > 1 THEN least(round_even(v / 65535.0, 0), 4095) ELSE round_even(v / CAST(65535 AS DOUBLE) * 4095, 0) END AS BIGINT) AS v FROM px",
    "rgb_interleave": STACK_SQL + "SELECT y, x, concat_ws(',', max(CASE WHEN c = 2 THEN v END), max(CASE WHEN c = 1 THEN v END), max(CASE WHEN c = 0 THEN v END)) AS bgr FROM px WHERE c < 3 GROUP BY y, x",
    "centre_slice": STACK_SQL + ", s AS (SELECT c, (max(y) + 1) // 2 AS middle FROM px GROUP BY c) SELECT c, y, x, v FROM px JOIN s USING (c) WHERE y = middle",
}
