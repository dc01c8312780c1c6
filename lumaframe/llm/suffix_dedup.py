"""Suffix-array deduplication: every byte covered by a 100-byte string that also starts earlier is removed.

The repeats are found by sorting positions by pairs of ranks at growing lengths, as prefix doubling
builds a suffix array, and dropping positions as soon as their rank is unique:

1. Sampled positions are ranked by the 37 bytes that follow. A position is sampled when its 37-gram
   has the least fingerprint among the 64 of a 100-byte window, so each window names one sampled
   position, and equal windows name the same place. A sampled position with a unique rank drops out
   with all windows that name it: none of them can occur elsewhere.
2. The others are sorted by the pair (rank, rank of their reach), the reach being the text of all
   windows that name them, about 130 bytes. In a class of equal pairs the first stays and all the
   windows of the rest are repeats.
3. Where positions share a rank but not their reach (the ends of a repeated passage), the windows of
   the first of each class are taken eight by eight: the rank is now that of the 93 bytes that the
   eight windows share, paired with the rank of their reach, and sorted again: unique ranks drop
   out, all but the first of equal pairs are repeats.
4. Of what is left, each window is ranked by its own 100 bytes; the first of each class stays.

Ranks are 64-bit fingerprints, so equal strings have equal ranks on every executor without a number
being handed out; a class's first position is what a sort by (pair, doc_id, position) puts first.
Each task sends on only the first of the classes that it sees itself and marks the rest as repeats
there and then: however often a passage occurs, a class gets a row per Arrow batch at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumaframe.llm.common import mix64, text_bytes, written

LENGTH = 100
GRAM = 37
#: Grams in a window; a power of two.
GRAMS = 64
#: Neighbouring windows that are ranked together before each is ranked alone.
TOGETHER = 8
#: Window starts that are looked at together.
SLICE = 1 << 19
#: Most keys of documents that are sent to all tasks; a key takes some 100 bytes there.
SENT = 1_000_000
#: Stands for a null doc_id, and sorts first.
NULL_ID = -(1 << 63)

_ODD = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size, made = max(n, SLICE + LENGTH + 1), []
        for factor in (_ODD, pow(_ODD, -1, 1 << 64)):
            row = np.full(size, factor, np.uint64)
            row[0] = 1
            made.append(np.cumprod(row, dtype=np.uint64))
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


class Fingerprints:
    """Fingerprints of any stretch of a byte array: prefix sums of a polynomial modulo 2**64."""

    def __init__(self, raw: np.ndarray) -> None:
        self.up, down = powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * down[:-1], out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        return mix64((self.sums[length:] - self.sums[:-length]) * self.up[: len(self.sums) - length])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.up[start])


def samples(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(rank, reach rank, first window, windows, sampled position) of each sampled position in the documents that ``raw`` holds end to end.

    ``starts`` are the documents' offsets in ``raw``, with its length at the end. Windows are named
    by their start in ``raw``.
    """
    inside = np.zeros(len(raw) + 1, np.int8)
    long = np.flatnonzero(np.diff(starts) >= LENGTH)
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, starts[long + 1] - LENGTH + 1, -1)
    inside = np.cumsum(inside, dtype=np.int8)[:-1].view(bool)
    low = np.uint64((1 << 20) - 1)
    found: list[tuple[np.ndarray, ...]] = []
    for s in range(0, len(raw) - LENGTH + 1, SLICE):
        part = raw[s : s + SLICE + LENGTH - 1]
        prints = Fingerprints(part)
        rank = prints.all(GRAM)
        key = (rank & ~low) | np.arange(len(rank), dtype=np.uint64)
        step = 1
        while step < GRAMS:  # the least of 1, 2, 4, ... neighbours; the leftmost of equal ones
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        at = (key & low).astype(np.int64)
        ok = inside[s : s + len(at)]
        turn = np.flatnonzero((at[1:] != at[:-1]) | (ok[1:] != ok[:-1])) + 1
        first = np.concatenate([[0], turn])
        end = np.concatenate([turn, [len(at)]])
        first, end = first[ok[first]], end[ok[first]]
        reach = prints.of(first, end + LENGTH - 1) ^ mix64((at[first] - first + (end - first) * 4096).astype(np.uint64))
        found.append((rank[at[first]], reach, first + s, end - first, at[first] + s))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64) for _ in range(3)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def known_repeats(a: np.ndarray, b: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which rows are repeats of an earlier row here: same pair (a, b), later (doc, place). Rows come in that order."""
    both = a ^ (b * np.uint64(_ODD))
    order = np.argsort(both, kind="stable")
    a, b, doc, place = a[order], b[order], doc[order], place[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    out = np.zeros(len(order), bool)
    out[order] = (doc != doc[first]) | (place != place[first])
    return out


#: ``place`` is the first of ``n`` windows of a document; they name the position ``place + ahead``. Its upper half is the
#: text's tag, so that of rows with one doc_id each text has places of its own, and equal texts have the same ones.
PAIRS = "r1 bigint, r2 bigint, doc bigint, place bigint, n tinyint, ahead tinyint, again boolean"


def pairs(r1: np.ndarray, r2: np.ndarray, doc: np.ndarray, place: np.ndarray, n: np.ndarray, ahead: np.ndarray, more: dict | None = None) -> pa.RecordBatch:
    """Rows of PAIRS, and of the columns in ``more``. A row known to be a repeat gets a rank of its own, so that it meets no other."""
    again = known_repeats(r1, r2, doc, place)
    r1 = np.where(again, mix64(doc.astype(np.uint64) * np.uint64(_ODD) + place.astype(np.uint64)), r1)
    arrays = [pa.array(x) for x in (r1.view(np.int64), np.where(again, 0, r2).view(np.int64), doc, place.astype(np.int64), n.astype(np.int8), ahead.astype(np.int8), again)]
    more = more or {}
    return pa.RecordBatch.from_arrays([*arrays, *more.values()], ["r1", "r2", "doc", "place", "n", "ahead", "again", *more])


def in_order(b: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of (key, text, tag, ...) by key and tag."""
    ids, tags = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
    sorted_already = (ids[1:] > ids[:-1]) | ((ids[1:] == ids[:-1]) & (tags[1:] >= tags[:-1]))
    return b if sorted_already.all() else b.take(pa.array(np.lexsort((tags, ids))))


def tagged(documents: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(key, text, tag): the doc_id, or the least number for null, the text, or the empty one, and 31 bits of its hash, 32 bits up."""
    body = F.coalesce(F.col(text), F.lit(""))
    tag = F.shiftleft(F.xxhash64(body).bitwiseAND(F.lit(0x7FFFFFFF).cast("bigint")), 32)
    return documents.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NULL_ID)).alias("key"), body.alias("text"), tag.alias("tag"))


def apart(texts: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(the texts that may have a key, the others): so that only the first are shuffled to what a key has.

    Keys (doc, _tag) are sent to all tasks if they are ``SENT`` at most; of more, all texts are taken for the first.
    """
    if keys.count() > SENT:
        return texts, None
    near = F.broadcast(keys.select("doc", "_tag"))
    met = (texts["key"] == near["doc"]) & (texts["tag"] == near["_tag"])
    return texts.join(near, met, "left_semi"), texts.join(near, met, "left_anti")


def tag_of(place: str) -> Column:
    return F.shiftleft(F.shiftright(place, 32), 32)


def sampled(texts: DataFrame) -> DataFrame:
    """Step 1's rows: sampled positions with rank and reach rank; ``place`` and ``n`` give their windows."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in map(in_order, batches):
            raw, starts = text_bytes(b.column(1))
            rank, reach, first, n, at = samples(raw, starts)
            doc = np.searchsorted(starts, first, side="right") - 1
            yield pairs(rank, reach, b.column(0).to_numpy()[doc], first - starts[doc] + b.column(2).to_numpy()[doc], n, at - first)

    return texts.mapInArrow(find, PAIRS)


def sort_by_pair(rows: DataFrame) -> DataFrame:
    """PAIRS sorted by rank, pair and position: ``alone`` (nothing else has the rank), ``split`` (others with the rank
    have another second rank), ``first`` (no equal pair stands earlier)."""
    within_rank = W.partitionBy("r1").orderBy("r2", "doc", "place")
    whole = W.partitionBy("r1").orderBy("r2", "doc", "place").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    pair = W.partitionBy("r1", "r2").orderBy("doc", "place")
    return (
        rows.withColumn("_low", F.first("r2").over(whole))
        .withColumn("_high", F.last("r2").over(whole))
        .withColumn("_alone", F.lag(F.lit(1)).over(within_rank).isNull() & F.lead(F.lit(1)).over(within_rank).isNull())
        .withColumn("_doc", F.first("doc").over(pair))
        .withColumn("_place", F.first("place").over(pair))
        .select(*[c for c in rows.columns if c != "r2"], F.col("_alone").alias("alone"), (F.col("_low") != F.col("_high")).alias("split"), ((F.col("doc") == F.col("_doc")) & (F.col("place") == F.col("_place"))).alias("first"))
    )


def split_cells(place: np.ndarray, n: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows cut where their distance to the sampled position is a multiple of TOGETHER:
    (first window, windows, start of the text that all windows of a full run share)."""
    low, high = (ahead - n + 1) // TOGETHER, ahead // TOGETHER
    cells = np.repeat(np.arange(len(n)), high - low + 1)
    k = np.arange(len(cells)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[cells]
    at = (place + ahead)[cells]
    first = at - np.minimum(TOGETHER * k + TOGETHER - 1, ahead[cells])
    last = at - np.maximum(TOGETHER * k, (ahead - n + 1)[cells])
    return first, last - first + 1, at - TOGETHER * k


EIGHTS = PAIRS + ", ranks array<bigint>"


def eights(texts: DataFrame, cells: DataFrame) -> DataFrame:
    """Step 3's rows: the windows of the given (doc, place, n, ahead) by eights, with each window's own rank."""

    def ranked(raw: np.ndarray, place: np.ndarray, n: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, ...]:
        first, count, core = split_cells(place, n, ahead)
        windows = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        prints = Fingerprints(raw)
        reach = prints.of(first, first + count + LENGTH - 1) ^ mix64(((core - first) * 4096 + count).astype(np.uint64))
        return prints.of(core, core + LENGTH - TOGETHER + 1), reach, first, count, core - first, prints.of(windows, windows + LENGTH)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in map(in_order, batches):
            ids, tags = b.column(0).to_numpy(), b.column(2).to_numpy()
            found: list[tuple[np.ndarray, ...]] = []
            size = 0

            def close() -> pa.RecordBatch:
                r1, r2, first, count, ahead, ranks, doc = (np.concatenate(x) for x in zip(*found, strict=True))
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(count)]).astype(np.int32), ranks.view(np.int64))
                found.clear()
                return pairs(r1, r2, doc, first, count, ahead, {"ranks": lists})

            for i in range(b.num_rows):
                raw, _ = text_bytes(b.column(1).slice(i, 1))
                own = b.column(3)[i].values
                place, n, ahead = (own.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
                place -= tags[i]
                order = np.argsort(place, kind="stable")
                place, n, ahead = place[order], n[order], ahead[order]
                done = 0
                while done < len(place):  # the cells within one stretch of the text at a time
                    low = int(place[done])
                    until = int(np.searchsorted(place, low + SLICE))
                    part = slice(done, until)
                    got = ranked(raw[low : int(place[until - 1] + n[until - 1]) + LENGTH - 1], place[part] - low, n[part], ahead[part])
                    found.append((got[0], got[1], got[2] + low + tags[i], *got[3:], np.full(len(got[0]), ids[i])))
                    size += len(got[0])
                    done = until
                if size > SLICE // TOGETHER:
                    yield close()
                    size = 0
            if found:
                yield close()

    per_doc = written(cells.groupBy("doc", tag_of("place").alias("_tag")).agg(F.collect_list(F.struct("place", "n", "ahead")).alias("cells")))
    texts, _ = apart(texts, per_doc)
    joined = texts.join(per_doc, (texts["key"] == per_doc["doc"]) & (texts["tag"] == per_doc["_tag"])).select("key", "text", "tag", "cells")
    return joined.mapInArrow(rank, EIGHTS)


def singles(runs: DataFrame) -> DataFrame:
    """Step 4's rows: each window of step 3's open rows with its own rank, paired with the rank it shared."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r1, doc, place, n = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            n = n.astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            at = place[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            order = np.lexsort((at, doc[row]))
            ranks = b.column(4).flatten().to_numpy()[order].view(np.uint64)
            row = row[order]
            yield pairs(ranks, r1[row].view(np.uint64), doc[row], at[order], np.ones(len(row)), np.zeros(len(row)))

    return runs.select("r1", "doc", "place", "n", "ranks").mapInArrow(deal, PAIRS)


def open_rows(ranked: DataFrame) -> DataFrame:
    """The first of each class of equal pairs, where others share its rank: some of its windows may yet be repeats."""
    return ranked.where("NOT again AND first AND split")


def repeats(ranked: DataFrame) -> DataFrame:
    """Byte runs (doc, place, until) that the rows known to be repeats cover."""
    return ranked.where("again OR NOT first").select("doc", "place", (F.col("place") + F.col("n") + (LENGTH - 1)).alias("until"))


KEPT = "doc_id bigint, n_bytes bigint, spans array<struct<start:int,end:int>>, kept binary"


def dedup(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: n_bytes, the maximal removed byte runs (original offsets), and the bytes kept.

    Texts are whole and read as UTF-8 bytes; a null text is empty. Texts under 100 bytes stay as
    they are. Null doc_ids sort first. Of rows that share a doc_id, those with equal texts are one
    document (a string is not earlier than itself at the same start, and all lose the same runs); others are
    documents of their own, in the order of their texts' hashes. An empty table gives no rows. Other columns are not read.
    """
    texts = tagged(documents, text, doc_id)
    ranked = written(sort_by_pair(sampled(texts)).where("again OR NOT alone"))
    by_eights = written(sort_by_pair(eights(texts, open_rows(ranked).select("doc", "place", "n", "ahead"))).where("again OR NOT alone"))
    last = sort_by_pair(singles(open_rows(by_eights)))
    found = repeats(ranked).unionByName(repeats(by_eights)).unionByName(repeats(last))
    span = F.struct((F.col("place") - tag_of("place")).alias("place"), (F.col("until") - tag_of("place")).alias("until"))
    runs = written(found.groupBy("doc", tag_of("place").alias("_tag")).agg(F.collect_list(span).alias("runs")))
    some, others = apart(texts, runs)
    joined = some.join(runs, (some["key"] == runs["doc"]) & (some["tag"] == runs["_tag"]), "left").select("key", "text", "runs")
    if others is not None:
        joined = joined.unionByName(others.select("key", "text", F.lit(None).cast(runs.schema["runs"].dataType).alias("runs")))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes, spans, kept = b.column(0).to_pylist(), [], [], []
            for i in range(b.num_rows):
                raw, _ = text_bytes(b.column(1).slice(i, 1))
                sizes.append(len(raw))
                own = b.column(2)[i].values
                if own is None or not len(raw):
                    spans.append([])
                    kept.append(raw.tobytes())
                    continue
                start, end = (own.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, np.minimum(start, len(raw)), 1)
                np.add.at(edge, np.minimum(end, len(raw)), -1)
                gone = np.concatenate([[0], (np.cumsum(edge)[:-1] > 0).astype(np.int8), [0]])
                turn = np.diff(gone)
                spans.append([{"start": x, "end": y} for x, y in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), strict=True)])
                kept.append(raw[gone[1:-1] == 0].tobytes())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            arrays = [pa.array([None if k == NULL_ID else k for k in keys], pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(remove, KEPT)
