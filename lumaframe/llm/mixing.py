"""Mixing sources to target weights: subset-sum budget fitting on exact document lengths.

Each source gets a word budget. Whole passes over the source come first; what remains of the budget
is fitted with documents counted by exact length: a systematic sample over the lengths comes near
it, and a bounded-knapsack dynamic programme over the lengths still to be had closes the gap. Which
documents of a length are taken follows a seeded hash.
"""

from __future__ import annotations

import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumaframe.llm.common import SPACE_CLASS, cut, free_names

#: Sources in code-point order weigh so much, over and over.
WEIGHTS = (5, 2, 1)
#: The mix's size in words, against all words there are.
SHARE = 1.5
#: No source gives more than this many times its words.
MOST = 2
SEED = 17
#: Documents of one source and length are ranked in so many separate ranges of their hash.
RANGES = 64
#: The dynamic programme is left this many documents of mean length to choose, so that it has sums to choose from.
RESERVE = 12


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null and sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(key, source_size) with target: the fill level at which weights share ``share`` of all words, none above its cap.

    Handing the excess of capped sources to the others by weight, again and again, ends at the level
    L where the sum of min(cap, L * weight) is the whole; sorted by cap / weight, the first source
    that stays below its cap gives L. The table has one row per source.
    """
    place = F.row_number().over(W.orderBy("key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    df = sources.withColumn("_w", weight).withColumn("_cap", most * F.col("source_size").cast("double"))
    by_level = W.orderBy(F.col("_cap") / F.col("_w"), "key")
    upto = by_level.rowsBetween(W.unboundedPreceding, 0)
    everything = W.partitionBy(F.lit(0))
    whole = share * F.sum("source_size").over(everything).cast("double")
    capped = F.sum("_cap").over(upto) - F.col("_cap")
    open_weight = F.sum("_w").over(everything) - F.sum("_w").over(upto) + F.col("_w")
    df = df.withColumn("_level", (whole - capped) / open_weight)
    level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("_level").alias("level")))).over(everything)
    df = df.withColumn("_fill", level["level"])
    return df.select("key", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_fill"), F.lit(0.0)) * F.col("_w")).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """How many documents of each length to take so that their words come to ``budget``, or as near below as can be.

    A systematic sample with a seeded start comes within about the longest document of the budget
    less RESERVE mean documents; if it goes beyond, seeded lengths are put back. The rest is filled by dynamic programming over the lengths
    still to be had: ``first[s]`` is the item that first reached the sum s, so a sum's items can be
    followed back.
    """
    order = np.argsort(lengths, kind="stable")
    total = int((lengths * counts).sum())
    if total == 0 or budget <= 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    rng = np.random.default_rng(seed)
    rate = Fraction(max(0, budget - RESERVE * total // max(1, int(counts.sum()))), total)
    start = Fraction(int(rng.integers(1 << 20)), 1 << 20)
    ends = np.array([(int(c) * rate.numerator * start.denominator + start.numerator * rate.denominator) // (rate.denominator * start.denominator) for c in np.cumsum(counts[order])], np.int64)
    take = np.zeros(len(lengths), np.int64)
    take[order] = np.diff(ends, prepend=0)
    left = budget - int((take * lengths).sum())
    mixed = rng.permutation(len(lengths))
    for i in mixed:
        if left >= 0:
            break
        if take[i] and lengths[i]:
            back = min(int(take[i]), -(left // int(lengths[i])))
            take[i] -= back
            left += back * int(lengths[i])
    for i in mixed[np.argsort(-lengths[mixed], kind="stable")]:  # far from the budget: long documents first
        if left <= 2 * int(lengths.max()) + RESERVE * total // int(counts.sum()):
            break
        more = min(int(counts[i] - take[i]), left // int(lengths[i]) if lengths[i] else 0)
        take[i] += more
        left -= more * int(lengths[i])
    reached = np.zeros(left + 1, bool)
    reached[0] = True
    first = np.full(left + 1, -1, np.int64)
    items: list[tuple[int, int]] = []
    for i in mixed:
        if reached[left]:
            break
        length, have, lot = int(lengths[i]), int(counts[i] - take[i]), 1
        if length == 0:
            continue
        have = min(have, left // length)
        while have > 0 and not reached[left]:  # 1, 2, 4, ... copies: every number of copies up to what there is
            n = min(lot, have)
            weight = n * length
            new = np.zeros(left + 1, bool)
            new[weight:] = reached[: left + 1 - weight] & ~reached[weight:]
            first[new] = len(items)
            items.append((int(i), n))
            reached |= new
            have -= n
            lot *= 2
    s = int(np.flatnonzero(reached)[-1])
    while s > 0:
        i, n = items[first[s]]
        take[i] += n
        s -= n * int(lengths[i])
    return take


def plan(lengths: DataFrame, seed: int = SEED) -> DataFrame:
    """(key, size, n, source_size, target) with passes and extra: whole passes, and how many of the n get one more.

    A group holds one row for each distinct length in a source, however many documents it has.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ignore_index=True)
        total, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        passes = int(target // total) if total else 0
        budget = round(target) - passes * total
        own = zlib.crc32(rows["key"].iloc[0].encode()) ^ seed
        rows["passes"] = passes
        rows["extra"] = fit(rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), budget, own) if budget > 0 else 0
        return rows[["key", "size", "source_size", "target", "passes", "extra"]]

    return lengths.groupBy("key").applyInPandas(one, "key string, size bigint, source_size bigint, target double, passes bigint, extra bigint")


def mix(documents: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words that the mix takes of each document, repeats counted.

    A null text has size 0 and is never taken; a null source is a source of its own, last in order.
    Rows that share a doc_id are ranked side by side. An empty table gives no rows. A document is
    taken 0, 1, ... ``most`` times, whole. The choice depends on doc_id, source, size and seed only.
    """
    sized = documents.select(F.col(doc_id).alias("doc_id"), source_key(F.col(source)).alias("key"), words(F.col(text)).alias("size"))
    sized = sized.withColumn("_h", F.xxhash64(F.col("doc_id"), F.lit(seed)))
    sized = cut(sized.withColumn("_range", F.pmod(F.shiftright("_h", 48), F.lit(RANGES))))
    by_range = cut(sized.groupBy("key", "size", "_range").agg(F.count(F.lit(1)).alias("n")))
    by_length = by_range.groupBy("key", "size").agg(F.sum("n").alias("n"))
    sources = by_length.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    aims = targets(sources, weights, share, most)
    planned = plan(by_length.join(aims, "key"), seed)
    before = F.sum("n").over(W.partitionBy("key", "size").orderBy("_range").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    quotas = by_range.withColumn("_before", before).join(planned, ["key", "size"]).select("key", "size", "_range", "source_size", "target", "passes", (F.col("extra") - F.col("_before")).alias("_quota"))
    rank = F.row_number().over(W.partitionBy("key", "size", "_range").orderBy("_h", "doc_id"))
    chosen = sized.join(quotas, ["key", "size", "_range"]).withColumn("_rank", rank)
    times = F.col("passes") + (F.col("_rank") <= F.col("_quota")).cast("long")
    return chosen.select("doc_id", "size", "source_size", "target", (times * F.col("size")).alias("taken"))


def apply_mix(documents: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """``documents`` as the mix takes them: each row as often as it is taken, all columns as they were.

    The decision is made once for each row (told apart by doc_id, source and text).
    """
    own, key, total, often, copy = free_names(documents, "_row_key", "_key", "_total", "_times", "_copy")
    marked = documents.withColumn(own, F.xxhash64(F.col(doc_id), F.col(source), F.col(text)))
    taken = mix(marked, text, source, own, **options).where("taken > 0")
    times = taken.groupBy(F.col("doc_id").alias(key)).agg(F.sum((F.col("taken") / F.col("size")).cast("long")).alias(total))
    joined = marked.join(times, marked[own] == times[key])
    alike = W.partitionBy(own)
    number = F.row_number().over(alike.orderBy(F.lit(0)))
    rows = F.count(F.lit(1)).over(alike)
    times = F.floor(F.col(total) / rows) + (number <= F.col(total) % rows).cast("long")
    joined = joined.withColumn(often, times).where(F.col(often) > 0)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(often).cast("int")))).select(*documents.columns)
