"""Joins and windows that the metadata needs and SQL has no single word for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nearest_lower(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, alias: str) -> DataFrame:
    """As-of join: for each left row the ``value`` of the last right row of its group with ``at`` not above its own.

    Both sides are put together and sorted once by (by, at), so there is no inequality join; a
    right row with the same ``at`` counts. Of right rows with one ``at`` the greatest value does.
    """
    last = right.groupBy(*by, at).agg(F.max(value).alias(alias)).withColumn("_right", F.lit(0))
    both = left.withColumn("_right", F.lit(1)).unionByName(last, allowMissingColumns=True)
    found = F.last(alias, ignorenulls=True).over(W.partitionBy(*by).orderBy(at, "_right").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn(alias, found).where("_right = 1").drop("_right")


def least_gap(rows: DataFrame, by: list[str], value: str, alias: str, eps: float = 1e-7) -> DataFrame:
    """The least distance above ``eps`` between two values of a group: neighbours in sorted order give it, no pairs are made."""
    ordered = W.partitionBy(*by).orderBy(value)
    gap = F.col(value) - F.lag(value).over(ordered)
    gaps = rows.select(*by, value).distinct().withColumn("_gap", gap)
    return gaps.groupBy(*by).agg(F.min(F.when(F.col("_gap") > eps, F.col("_gap"))).alias(alias))


def first_match(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], key: str, order: str, alias: str) -> DataFrame:
    """For each left row the least ``order`` of the right rows that match in any of the column pairs: one equi-join for each pair."""
    hits = None
    for own, other in pairs:
        lowest = right.groupBy(F.col(other).alias("_v")).agg(F.min(order).alias("_first"))
        one = left.join(lowest, left[own] == lowest["_v"]).select(F.col(key).alias("_key"), "_first")
        hits = one if hits is None else hits.unionByName(one)
    best = hits.groupBy("_key").agg(F.min("_first").alias(alias))
    return left.join(best, left[key] == best["_key"], "left").drop("_key")


def keep_latest(rows: DataFrame, by: list[str], newest: list[Column], k: int) -> DataFrame:
    """Rows beyond the k newest of each group: what a cache of k entries evicts."""
    return rows.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(*newest))).where(F.col("_rank") > k)


def canonical(rows: DataFrame, column: str, names: DataFrame, name: str, alias: str, default: str = "Other") -> DataFrame:
    """A column spelt as a list of names spells it, whatever its case and space; ``default`` where it isn't there."""
    known = names.select(F.lower(F.trim(F.col(name))).alias("_low"), F.col(name).alias("_name")).dropDuplicates(["_low"])
    low = F.lower(F.trim(F.col(column)))
    return rows.join(known, low == known["_low"], "left").withColumn(alias, F.coalesce("_name", F.lit(default))).drop("_low", "_name")


def semi_join_if_any(rows: DataFrame, active: DataFrame, column: str, other: str) -> DataFrame:
    """Rows whose value is active, or whose value is null; all rows where nothing is active."""
    names = active.select(F.col(other).alias("_a")).distinct()
    any_active = names.agg((F.count(F.lit(1)) > 0).alias("_any"))
    joined = rows.join(F.broadcast(any_active)).join(names, F.col(column) == F.col("_a"), "left")
    return joined.where(F.col("_a").isNotNull() | F.col(column).isNull() | ~F.col("_any")).drop("_a", "_any")


def overlay(left: DataFrame, right: DataFrame, key: tuple[str, str], columns: dict[str, str]) -> DataFrame:
    """Left rows with each listed column replaced by the right side's, where it has one."""
    other = right.select(F.col(key[1]).alias("_k"), *[F.col(c).alias(f"_{own}") for own, c in columns.items()])
    joined = left.join(other, left[key[0]] == other["_k"], "left")
    return joined.withColumns({own: F.coalesce(f"_{own}", own) for own in columns}).drop("_k", *[f"_{own}" for own in columns])


def all_notes(*lists: Column) -> Column:
    """Several lists in one, in their order; a list that isn't there adds nothing."""
    return F.concat(*(F.coalesce(a, F.array().cast("array<string>")) for a in lists))


def drop_repeats(rows: DataFrame, by: list[str], order: list[str], column: str) -> DataFrame:
    """Rows whose value differs from the one before in their group."""
    before = F.lag(column).over(W.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col(column))).drop("_before")


def compare(left: DataFrame, right: DataFrame, key: str, value: str, tolerance: float = 1e-9) -> DataFrame:
    """(key, status): same, different, missing or extra."""
    a, b = left.select(F.col(key).alias("_a"), F.col(value).alias("_va")), right.select(F.col(key).alias("_b"), F.col(value).alias("_vb"))
    joined = a.join(b, a["_a"] == b["_b"], "full")
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.abs(F.col("_va") - F.col("_vb")) <= tolerance, "same").otherwise("different")
    return joined.select(F.coalesce("_a", "_b").alias(key), status.alias("status"))
