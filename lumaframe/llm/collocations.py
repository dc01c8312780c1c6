"""Phrases of two and three words that stand together more often than their parts would have it.

Occurrences are held as vertical lists: for each segment of the corpus (some MB of text of one language) and each word,
the sorted positions where it stands. A position is a word's number in its segment, with one number left out
wherever a piece or a document ends, so neighbours in a piece, and only they, differ by one. The length of a
phrase's list, summed over segments, is its exact frequency. A frequent phrase is extended by merge-joining the
positions behind it with the postings of the next word; only what is frequent (words, then pairs) is extended, as
nothing that holds a rare part can be frequent.

On Spark: segments are made by the tasks that read the texts and written once. Words are counted over all segments and
numbered; the numbers go back to the segments by a join, so no task needs the whole vocabulary. Each segment sends one
row for each of its distinct pairs; pairs are summed, and those that are frequent go back to the segments that have
them, where they are extended to triples. A pair's rows are at most one for each segment, so no key has more.

Defined results: A-Z are lower-cased; texts are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words
``[^\\x20\\x09]+``; a null text is empty, a null lang is ``und``; equal rows count as often as they stand there. A very long text
is cut at a piece's end into several segments, which changes no count. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumaframe.llm.common import text_bytes, written

#: Lower-cases A-Z; a tab is a space, and whatever ends a piece is a line feed.
_FOLD = np.array([c + 32 if 0x41 <= c <= 0x5A else 0x20 if c == 9 else 0x0A if c in b".,;:!?" or 0x0A <= c <= 0x0D else c for c in range(256)], np.uint8)

#: Bytes of text in a segment, and how many numbers a word's bucket leaves for the others.
SEGMENT, BUCKETS = 12_000_000, 1024

_SEGMENTS = "segment bigint, lang string, words array<string>, sizes array<int>, positions binary"
_LISTS = "segment bigint, ids binary, sizes binary, positions binary"


def squeeze(values: np.ndarray) -> bytes:
    return pa.compress(values.astype(np.int32).tobytes(), "zstd", asbytes=True) if len(values) else b""


def swell(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, 4 * n, "zstd", asbytes=True), np.int32) if n else np.zeros(0, np.int32)


def vertical(raw: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, occurrences of each, positions sorted by word and then place) of texts that stand end to end."""
    folded = _FOLD[raw]
    word = (folded != 0x20) & (folded != 0x0A)
    edge = np.zeros(len(raw) + 1, bool)  # a text begins here
    edge[starts] = True
    before = np.concatenate([[False], word[:-1]]) & ~edge[:-1]
    begin = np.flatnonzero(word & ~before)
    after = np.concatenate([word[1:], [False]]) & ~edge[1:]
    size = np.flatnonzero(word & ~after) + 1 - begin
    breaks = np.cumsum((folded == 0x0A) | edge[:-1], dtype=np.int32)[begin] if len(begin) else np.zeros(0, np.int32)
    # breaks without a word between them count once
    place = np.arange(len(begin)) + np.concatenate([[0], np.cumsum(np.diff(breaks) > 0)])[: len(begin)]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    coded = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(folded[word].tobytes())).dictionary_encode()
    code = np.asarray(coded.indices, np.int32)
    return coded.dictionary, np.bincount(code, minlength=len(coded.dictionary)), place[np.argsort(code, kind="stable")]


def gaps(positions: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each list's first position, then its differences."""
    out = np.diff(positions, prepend=0)
    first = np.cumsum(sizes) - sizes
    out[first[sizes > 0]] = positions[first[sizes > 0]]
    return out


def ungapped(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps, dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    return total - np.repeat(np.where(first > 0, total[np.maximum(first - 1, 0)], 0), sizes)


def cut_places(raw: np.ndarray, most: int) -> list[int]:
    """Where to cut a text so that parts are about ``most`` bytes: behind the first end of a piece after so many."""
    places, at = [0], 0
    while len(raw) - at > most:
        found = np.flatnonzero(_FOLD[raw[at + most :]] == 0x0A)
        if not len(found):
            break
        at += most + int(found[0]) + 1
        places.append(at)
    return [*places, len(raw)]


def segments(documents: DataFrame, most: int = SEGMENT) -> DataFrame:
    """(segment, lang, words, sizes, positions): the vertical lists of every segment, each of one language and of about ``most`` bytes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}

        def close(lang: str) -> pa.RecordBatch:
            nonlocal number
            parts = held.pop(lang)
            size.pop(lang)
            starts = np.cumsum([0, *(len(p) for p in parts)])
            words, sizes, positions = vertical(np.concatenate(parts), starts)
            number += 1
            row = {"segment": pa.array([number - 1]), "lang": pa.array([lang]), "words": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())), "sizes": pa.array([sizes.astype(np.int32)]), "positions": pa.array([squeeze(gaps(positions, sizes))])}
            return pa.RecordBatch.from_arrays(list(row.values()), list(row))

        for b in batches:
            raw, starts = text_bytes(b.column(1))
            for i, lang in enumerate(b.column(0).to_pylist()):
                text = raw[starts[i] : starts[i + 1]]
                places = cut_places(text, most)
                for a, z in zip(places, places[1:], strict=False):
                    if z > a:
                        held.setdefault(lang, []).append(text[a:z].copy())
                        size[lang] = size.get(lang, 0) + z - a
                        if size[lang] >= most or sum(size.values()) >= 2 * most:
                            yield close(max(size, key=size.get))
        for lang in list(held):
            yield close(lang)

    return documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(make, _SEGMENTS)


def numbered(words: DataFrame) -> DataFrame:
    """``words`` with an id of their own, the same in every run: a rank within a bucket and the bucket's number."""
    bucket = F.pmod(F.xxhash64("lang", "word"), F.lit(BUCKETS))
    rank = F.row_number().over(W.partitionBy("_bucket").orderBy("lang", "word"))
    return words.withColumn("_bucket", bucket).withColumn("id", (rank - 1).cast("long") * BUCKETS + F.col("_bucket")).drop("_bucket")


def renamed(parts: DataFrame, places: DataFrame) -> DataFrame:
    """(segment, ids, sizes, positions): the lists of frequent words alone, by their ids. ``places``: (of, place in that segment's lists, id)."""

    def name(segment: pa.Table, ids: pa.Table) -> pa.Table:
        out = {"segment": [], "ids": [], "sizes": [], "positions": []}
        for row in segment.to_pylist():
            sizes = np.array(row["sizes"], np.int64)
            positions = ungapped(swell(row["positions"], int(sizes.sum())), sizes)
            new = np.full(len(sizes), -1, np.int64)
            new[np.asarray(ids["place"], np.int64)] = np.asarray(ids["id"], np.int64)
            if new.max(initial=-1) >= 1 << 32:
                raise ValueError("more frequent words than 32 bits number")
            keep = new >= 0
            own = positions[np.repeat(keep, sizes)]
            out["segment"].append(row["segment"])
            out["ids"].append(new[keep].astype(np.uint32).tobytes())
            out["sizes"].append(sizes[keep].astype(np.int32).tobytes())
            out["positions"].append(squeeze(gaps(own, sizes[keep])))
        return pa.table({"segment": pa.array(out["segment"], pa.int64()), **{k: pa.array(out[k], pa.binary()) for k in ("ids", "sizes", "positions")}})

    return parts.select("segment", "sizes", "positions").groupBy("segment").cogroup(places.groupBy("of")).applyInArrow(name, _LISTS)


def postings(ids: bytes, sizes: bytes, positions: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(positions, words), sorted by position."""
    n = np.frombuffer(sizes, np.int32).astype(np.int64)
    place = ungapped(swell(positions, int(n.sum())), n)
    order = np.argsort(place)
    return place[order], np.repeat(np.frombuffer(ids, np.uint32), n)[order]


def extended(ends: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): occurrences i that end at ``ends`` with the postings j that stand right behind them; a merge of sorted positions."""
    at = np.searchsorted(places, ends + 1)
    hit = at < len(places)
    hit[hit] = places[at[hit]] == ends[hit] + 1
    return np.flatnonzero(hit), at[hit]


def pair_lists(place: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, pairs): where frequent words are followed by frequent words."""
    i, j = extended(place, place)
    return place[i], word[i].astype(np.int64) << 32 | word[j].astype(np.int64)


def pair_counts(lists: DataFrame) -> DataFrame:
    """(pair, segment, n): the list length of every pair of a segment. A pair is its first word's id, 32 bits up, and its second's."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                segment, *row = (c[i].as_py() for c in b.columns)
                pairs, n = np.unique(pair_lists(*postings(*row))[1], return_counts=True)
                for first in range(0, len(pairs), 500_000):
                    part = slice(first, first + 500_000)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[part]), pa.array(np.full(len(pairs[part]), segment, np.int64)), pa.array(n[part].astype(np.int32))], ["pair", "segment", "n"])

    return lists.mapInArrow(count, "pair bigint, segment bigint, n int")


def triple_counts(lists: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, last, n): list lengths, by segment, of triples whose two pairs are frequent. ``pairs``: (of, pair), the frequent ones of each segment."""

    def extend(segment: pa.Table, frequent: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        known = np.sort(np.asarray(frequent["pair"], np.int64))
        for row in segment.to_pylist():
            place, pair = pair_lists(*postings(row["ids"], row["sizes"], row["positions"]))
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            keep = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            place, pair = place[keep], pair[keep]
            i, j = extended(place, place)  # a pair and the pair that begins with its second word
            out.append((pair[i], pair[j] & 0xFFFFFFFF))
        first = np.concatenate([a for a, _ in out]) if out else np.zeros(0, np.int64)
        last = np.concatenate([b for _, b in out]) if out else np.zeros(0, np.int64)
        order = np.lexsort((last, first))
        first, last = first[order], last[order]
        edge = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (last[1:] != last[:-1])])) if len(first) else np.zeros(0, np.int64)
        n = np.diff(np.concatenate([edge, [len(first)]]))
        return pa.table({"pair": first[edge], "last": last[edge], "n": n.astype(np.int64)})

    return lists.groupBy("segment").cogroup(pairs.groupBy("of")).applyInArrow(extend, "pair bigint, last bigint, n bigint")


def high(pair: Column) -> Column:
    return F.shiftrightunsigned(pair, 32)


def low(pair: Column) -> Column:
    return pair.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (l * r)) in decimals of 38 digits, which hold the product of any counts below 10^16."""
    wide = lambda c: c.cast("decimal(16,0)")
    million = F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", (wide(a) * million) * wide(a), wide(left) * wide(right)).cast("long")


def collocations(documents: DataFrame, least: int = 10, most: int = 2000, inside: int = 50, segment: int = SEGMENT) -> DataFrame:
    """Each language's ``most`` best phrases of two or three words: (lang, rank, phrase, a, l, r, n, score).

    Phrases stand at least ``least`` times (a). l and r are the frequencies of the two parts at the cut where the score is
    lowest, n is the number of all words. A pair within a frequent triple that has at least ``inside`` per cent of its
    occurrences is left out.
    """
    parts = written(segments(documents, segment))
    vocabulary = parts.select("segment", "lang", F.posexplode(F.arrays_zip("words", "sizes")).alias("place", "w")).select("segment", "lang", "place", F.col("w.words").alias("word"), F.col("w.sizes").cast("long").alias("n"))
    totals = parts.groupBy("lang").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n"))
    words = written(numbered(vocabulary.groupBy("lang", "word").agg(F.sum("n").alias("a")).where(F.col("a") >= least)))
    places = vocabulary.join(words, ["lang", "word"]).select(F.col("segment").alias("of"), "place", "id")
    lists = written(renamed(parts, places))

    counted = pair_counts(lists).withColumn("a", F.sum("n").over(W.partitionBy("pair"))).where(F.col("a") >= least)
    held = written(counted.select("segment", "pair", "a"))  # by segment, the frequent pairs alone
    pairs = held.groupBy("pair").agg(F.first("a").alias("a"))
    triples = triple_counts(lists, held.select(F.col("segment").alias("of"), "pair")).groupBy("pair", "last").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    triples = written(triples)

    by_id = lambda end: words.select(F.col("id").alias(f"id{end}"), F.col("word").alias(f"word{end}"), F.col("a").alias(f"a{end}"), *([F.col("lang")] if end == 1 else []))
    two = pairs.withColumns({"id1": high(F.col("pair")), "id2": low(F.col("pair"))}).join(by_id(1), "id1").join(by_id(2), "id2")
    # a triple's two pairs with their share of it
    first = triples.select(F.col("pair"), F.col("a").alias("longer"))
    second = triples.select((F.shiftleft(low(F.col("pair")), 32) + F.col("last")).alias("pair"), F.col("a").alias("longer"))
    longer = first.unionByName(second).groupBy("pair").agg(F.max("longer").alias("longer"))
    two = two.join(longer, "pair", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    two = two.select("lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("a1").alias("l"), F.col("a2").alias("r"), score(F.col("a"), F.col("a1"), F.col("a2")).alias("score"))

    three = triples.withColumns({"id1": high(F.col("pair")), "id2": low(F.col("pair")), "id3": F.col("last"), "rest": F.shiftleft(low(F.col("pair")), 32) + F.col("last")})
    three = three.join(pairs.select("pair", F.col("a").alias("a12")), "pair").join(pairs.select(F.col("pair").alias("rest"), F.col("a").alias("a23")), "rest")
    three = three.join(by_id(1), "id1").join(by_id(2), "id2").join(by_id(3), "id3")
    cuts = F.array(*(F.struct(score(F.col("a"), F.col(x), F.col(y)).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, (x, y) in enumerate((("a1", "a23"), ("a12", "a3")))))
    three = three.withColumn("cut", F.array_min(cuts)).select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))

    ranked = best(written(two.unionByName(three)), most)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def best(candidates: DataFrame, most: int) -> DataFrame:
    """Each language's ``most`` first by score, then a, then phrase, with their ``rank``.

    Scores are counted in steps of about one per cent, and only the steps that are needed for so many rows
    are ranked, so a language's candidates don't meet in one task.
    """
    step = F.floor(F.log2(F.col("score") + 1) * 64).cast("long")
    placed = candidates.withColumn("step", step)
    above = F.sum("rows").over(W.partitionBy("of").orderBy(F.desc("down")).rowsBetween(W.unboundedPreceding, -1))
    steps = placed.groupBy(F.col("lang").alias("of"), F.col("step").alias("down")).agg(F.count(F.lit(1)).alias("rows"))
    needed = steps.withColumn("above", F.coalesce(above, F.lit(0))).where(F.col("above") < most)
    kept = placed.join(needed, (placed["lang"] == needed["of"]) & (placed["step"] == needed["down"]), "left_semi").drop("step")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= most)
