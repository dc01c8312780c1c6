"""What a set of filters removes in every order, from signed parity sums (Walsh-Hadamard).

A document's failures are a mask of k bits. For each part and label, the sums of (-1)^|mask and s| over all
2^k masks s are taken in one aggregation, and the transform turns them back, without a rest, into the number of
documents with each mask. All orders of the filters, and each filter's Shapley value, follow from
these counts alone, so the work on documents doesn't depend on the number of orders.

Defined results: a null text is empty, a null lang is the part "". A document without a doc_id has no
label, and equals no smaller doc_id's text; equal rows count as often as they stand there. Of several
labels of one doc_id the greatest counts. Other columns of either table are not read. An empty table has no parts, and no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
LABELS = ("good", "toxic")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A to D: under 200 words; fewer than half of them distinct; over 3 % capitals; a sign of ``#$%&*|``."""
    n = F.size(words(text))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [n < 200, 100 * F.size(F.array_distinct(words(text))) < 50 * n, 100 * capitals > 3 * F.length(text), text.rlike("[#$%&*|]")]


def mask(failures: list[Column]) -> Column:
    """Bit i is set where filter i fails."""
    return reduce(add, (F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures)))


def failures(documents: DataFrame) -> DataFrame:
    """(doc_id, part, mask, copies): a row for each distinct (doc_id, part, text), with the number of equal rows.

    E is the copy filter: it fails where a smaller doc_id has the same text. The first doc_id of each
    text is found by an aggregation over digests and joined by (digest, doc_id), so that a text which
    very many documents share makes no large group on either side.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), mask(text_failures(text)).alias("own"))
    rows = rows.groupBy("doc_id", "part", "digest", "own").agg(F.count(F.lit(1)).alias("copies"))
    first = rows.groupBy(F.col("digest").alias("_digest")).agg(F.min("doc_id").alias("_first"))
    joined = rows.join(first, (rows["digest"] == first["_digest"]) & (rows["doc_id"] == first["_first"]), "left")
    copy = F.col("_first").isNull() & F.col("doc_id").isNotNull()
    return joined.select("doc_id", "part", (F.col("own") + F.when(copy, 16).otherwise(0)).alias("mask"), "copies")


def parity(masks: Column, s: int | Column) -> Column:
    """1 where a mask shares an even number of bits with ``s``, else -1."""
    shared = masks.bitwiseAND(s)
    return F.lit(1) - 2 * F.bit_count(shared).bitwiseAND(1)


def whole(a: Column, b: Column) -> Column:
    """a / b, where b goes into a; null where b is zero."""
    return F.call_function("div", a, F.nullif(b.cast("long"), F.lit(0).cast("long")))


def spectra(masks: DataFrame, labels: DataFrame, bits: int = len(FILTERS)) -> DataFrame:
    """(part, good, toxic, sums): the 2^bits signed parity sums of each part and label."""
    said = labels.groupBy(F.col("doc_id").alias("_doc")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    joined = masks.join(said, masks["doc_id"] == said["_doc"], "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in LABELS]
    sums = [F.sum(F.col("copies") * parity(F.col("mask"), s)).alias(f"h{s}") for s in range(1 << bits)]
    return joined.groupBy("part", *flags).agg(*sums).select("part", *LABELS, F.array(*(f"h{s}" for s in range(1 << bits))).alias("sums"))


def cells(sums: DataFrame, bits: int = len(FILTERS)) -> DataFrame:
    """(part, n, good, toxic): arrays of counts by mask; the transform is its own inverse but for the factor 2^bits."""
    every = F.sequence(F.lit(0), F.lit((1 << bits) - 1))

    def at(m: Column) -> Column:
        signed = F.zip_with("sums", every, lambda h, s: h * parity(m, s))
        return F.aggregate(signed, F.lit(0).cast("long"), lambda a, b: a + b)

    back = sums.select("part", *LABELS, F.transform(every, lambda m: whole(at(m), F.lit(1 << bits))).alias("counts"))
    spread = back.select("part", *LABELS, F.posexplode("counts").alias("mask", "count"))
    weigh = lambda c: F.sum(F.when(c, F.col("count")).otherwise(0)).alias("n")
    by_mask = spread.groupBy("part", "mask").agg(F.sum("count").alias("n"), *(weigh(F.col(c)).alias(c) for c in LABELS))
    held = by_mask.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("mask", "n", *LABELS))).alias("cells"))
    return held.select("part", *(F.col(f"cells.{c}").alias(c) for c in ("n", *LABELS)))


def orders(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step; every figure is a sum of cells that the step's masks choose."""
    k = len(filters)
    steps = counts.select("*", F.explode(F.array(*(F.lit("".join(p)) for p in permutations(filters)))).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    place = lambda letter: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(filters), letter) - 1)
    letter = lambda i: F.call_function("substring", F.col("filter_order"), i, F.lit(1))
    own = place(letter(F.col("step")))
    before = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0), lambda a, i: a + F.when(i < F.col("step"), place(letter(i))).otherwise(0))
    steps = steps.withColumns({"own": own, "before": before})

    def total(values: str, chosen) -> Column:
        picked = F.transform(values, lambda n, m: F.when(chosen(m), n).otherwise(0).cast("long"))
        return F.aggregate(picked, F.lit(0).cast("long"), lambda a, b: a + b)

    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    removed = lambda m: fails(m) & ~gone(m)
    # a document that fails j filters is removed by each of them in k! / j orders
    share = F.transform("n", lambda n, m: F.when(fails(m), whole(n * factorial(k), F.bit_count(m))).otherwise(0).cast("long"))
    return steps.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"), total("n", removed).alias("removed"), total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("n", lambda m: m == F.col("own")).alias("unique_fails"), total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("long"), lambda a, b: a + b).alias("shapley"),
    )


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Every order of the five filters over whole texts, by part: (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    return orders(cells(spectra(failures(documents), labels)))
