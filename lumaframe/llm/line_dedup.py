"""Substring deduplication by hashing lines, paragraphs or phrases.

Units are normalised and hashed where they stand; the digests are grouped over all documents, the
earliest occurrence by (rank, place) stays, and the others are removed. Offsets are those of the
original text.

A repeated passage seldom begins and ends with a line: it starts inside one, runs over line ends,
and may be wrapped elsewhere. So besides lines and paragraphs there are units that follow the words
alone: a text is cut after a word where a hash of this word and the next one says so, one place in
CUT, and from each cut a unit reaches to the first cut that is at least MIN_WORDS words away. Wherever
a passage stands, its inner cuts are the same, so its units are; that they overlap covers the passage
from its first cut to its last. Stretches as long as a unit don't repeat by chance.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumaframe.llm.common import WORD_TABLE, column_bytes, mix64, text_bytes
from lumaframe.llm.suffix_dedup import NULL_ID, Fingerprints, in_order, known_repeats, powers, tag_of, tagged
from lumaframe.llm.words import bounds

#: A phrase has at least this many words; so has a line or paragraph that may be removed.
MIN_WORDS = 20
#: One word in so many ends a stretch between cuts.
CUT = 6
#: Texts are cut up in groups of about so many bytes.
GROUP_BYTES = 4_000_000
LINE = re.compile(rb"\n")
PARAGRAPH = re.compile(rb"\n[\x20\x09-\x0D]*\n")

#: ``start`` has the text's tag in its upper half.
UNITS = "key bigint, start bigint, until int, d1 bigint, d2 bigint, again boolean"
KEPT = "doc_id bigint, n_words bigint, n_removed bigint, n_chars bigint, spans array<struct<start:int,end:int>>, kept string"
_LANES = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]

#: From a group's bytes, its texts' offsets and its words' (begin, end, first by text): the units as (first word, last word + 1, first byte, last byte + 1).
Units = Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def cut_number(word: bytes) -> int:
    """24 bits of a word's MD5; two neighbours' numbers say whether there is a cut between them."""
    return int(hashlib.md5(word, usedforsecurity=False).hexdigest()[:6], 16)


def phrases(min_words: int = MIN_WORDS, cut: int = CUT) -> Units:
    """Overlapping stretches of at least ``min_words`` words between content-defined cuts; each takes along what stands before the next word."""

    def find(plain: np.ndarray, starts: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        if not len(begin):
            return (np.zeros(0, np.int64),) * 4
        coded = pa.array(Fingerprints(plain).of(begin, end)).dictionary_encode()
        number = np.asarray(coded.indices, np.int64)
        where = np.empty(len(coded.dictionary), np.int64)
        where[number[::-1]] = np.arange(len(number) - 1, -1, -1)  # where each distinct word stands first
        body = plain.tobytes()
        g = np.fromiter((cut_number(body[a:b]) for a, b in zip(begin[where].tolist(), end[where].tolist(), strict=True)), np.int64, len(where))[number]
        after = (g + 7 * np.append(g[1:], 0)) % cut == 0
        after[first[1:][first[1:] > first[:-1]] - 1] = True  # a text's last word
        ends = np.flatnonzero(after) + 1
        s = np.concatenate([[0], ends[:-1]])
        last = first[np.searchsorted(first, s, side="right")]  # where the unit's text ends
        s = s[s + min_words <= last]
        e = ends[np.searchsorted(ends, s + min_words)]
        of = np.searchsorted(first, s, side="right")
        until = np.where(e < first[of], begin[np.minimum(e, len(begin) - 1)], starts[of])
        return s, e, begin[s], until

    return find


def pieces(ends: re.Pattern[bytes], min_words: int = MIN_WORDS) -> Units:
    """Lines or paragraphs with at least ``min_words`` words (and one); each takes the line end after it along."""

    def find(plain: np.ndarray, starts: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, ...]:
        low, high, body = [], [], raw.tobytes()
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            at = a
            for m in ends.finditer(body, a, b):
                low.append(at)
                high.append(m.start())
                at = m.end()
            low.append(at)
            high.append(b)
        low, high = np.array(low, np.int64), np.array(high, np.int64)
        s, e = np.searchsorted(begin, low), np.searchsorted(begin, high)
        keep = e - s >= max(1, min_words)
        s, e, low, high = s[keep], e[keep], low[keep], high[keep]
        limit = starts[np.searchsorted(starts, low, side="right")]
        takes = (high < limit) & (np.append(raw, 0)[high] == 0x0A)
        return s, e, low, high + takes

    find.wants_raw = True
    return find


def unit_rows(texts: DataFrame, units: Units) -> DataFrame:
    """(key, start, until, d1, d2, again) of every unit.

    Of equal units in one Arrow batch only the first is compared further; the others are marked and
    get digests of their own, so a digest that stands in every document has a row per batch.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in map(in_order, batches):
            raw, offsets = text_bytes(b.column(1))
            keys = b.column(0).to_numpy(zero_copy_only=False)
            found, at = [], 0
            while at < len(keys):
                last = min(len(keys), max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP_BYTES)) - 1))
                part, starts = raw[offsets[at] : offsets[last]], offsets[at : last + 1] - offsets[at]
                plain, begin, end, first = bounds(part, starts)
                s, e, low, high = units(plain, starts, begin, end, first, *([part] if hasattr(units, "wants_raw") else []))
                doc = np.searchsorted(starts, low, side="right") - 1
                words = Fingerprints(plain).of(begin, end)
                lanes = []
                for c in _LANES:
                    up, down = powers(len(words) + 1)
                    sums = np.zeros(len(words) + 1, np.uint64)
                    np.cumsum(mix64(words ^ c) * down[:-1], out=sums[1:])
                    lanes.append(mix64((sums[e] - sums[s]) * up[s] + (e - s).astype(np.uint64)))
                found.append((doc + at, low - starts[doc], high - starts[doc], *lanes))
                at = last
            if not found:
                continue
            doc, start, until, d1, d2 = (np.concatenate(x) for x in zip(*found, strict=True))
            start = start + b.column(2).to_numpy()[doc]
            again = known_repeats(d1, d2, keys[doc], start)
            own = mix64(keys[doc].astype(np.int64).view(np.uint64) * _LANES[0] + start.astype(np.uint64))
            d1, d2 = np.where(again, own, d1), np.where(again, mix64(own), d2)
            arrays = [pa.array(keys[doc]), pa.array(start.astype(np.int64)), pa.array(until.astype(np.int32)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(again)]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "start", "until", "d1", "d2", "again"])

    return texts.mapInArrow(find, UNITS)


def dedup(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", units: Units | None = None) -> DataFrame:
    """Per document: n_words, n_removed (words), n_chars, the removed runs (offsets in the original text, in characters) and the text kept.

    ``units``: ``phrases()`` (as when None), ``pieces(LINE)`` or ``pieces(PARAGRAPH)``. Units are compared
    by their words in lower case, through two 64-bit hashes. Documents are ranked by doc_id, a whole
    number, null first. Overlapping and touching removed units make one run. Null and empty texts keep
    an empty text; a text shorter than a unit stays whole. Of rows that share a doc_id, those with equal
    texts are one document (a unit is not earlier than itself at the same place, and all lose the same places); others
    are documents of their own, in the order of their texts' hashes. An empty table gives no rows. Further columns are ignored, whatever their names.

    A digest's rows are ranked in one task: at most one row for each Arrow batch that holds it.
    """
    units = units or phrases()
    texts = tagged(documents, text, doc_id)
    place = F.rank().over(W.partitionBy("d1", "d2").orderBy("key", "start"))
    gone = unit_rows(texts, units).withColumn("_place", place).where("again OR _place > 1")
    runs = gone.groupBy(F.col("key").alias("_key"), tag_of("start").alias("_tag")).agg(F.collect_list(F.struct((F.col("start") - tag_of("start")).cast("int").alias("start"), "until")).alias("runs"))
    joined = texts.join(runs, (texts["key"] == runs["_key"]) & (texts["tag"] == runs["_tag"]), "left").select("key", "text", "runs")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        count = lambda raw: len(raw.translate(WORD_TABLE).split())
        for b in batches:
            n_words, n_removed, n_chars, spans, kept = [], [], [], [], []
            for body, own in zip(column_bytes(b.column(1)), b.column(2), strict=True):
                found: list[list[int]] = []
                if own.values is not None and len(own.values):
                    low, high = (own.values.field(k).to_numpy(zero_copy_only=False) for k in range(2))
                    for start, until in sorted(set(zip(low.tolist(), high.tolist(), strict=True))):
                        if found and found[-1][1] >= start:
                            found[-1][1] = max(found[-1][1], until)
                        else:
                            found.append([start, until])
                left, at, chars, mine, words = [], 0, 0, [], 0
                for start, until in found:
                    left.append(body[at:start].decode())
                    cut = body[start:until]
                    chars += len(left[-1])
                    size = len(cut.decode())
                    words += count(cut)
                    mine.append({"start": chars, "end": chars + size})
                    chars, at = chars + size, until
                left.append(body[at:].decode())
                n_words.append(count(body))
                n_removed.append(words)
                n_chars.append(chars + len(left[-1]))
                spans.append(mine)
                kept.append("".join(left))
            ids = pa.array([None if k == NULL_ID else k for k in b.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (n_words, n_removed, n_chars)), pa.array(spans, kind), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "n_chars", "spans", "kept"])

    return joined.mapInArrow(remove, KEPT)
