"""Benchmark decontamination with a distributed positional inverted index.

The index is split by document into segments, as search engines do: a segment lists, for each
term, the positions at which it stands in the segment's documents. The phrases of the benchmark
(windows of 13 words) are searched segment by segment: the list of a phrase's rarest term gives
candidate starts, and the lists of its other terms, shifted by their offsets in the phrase, are
intersected with them from the second rarest on, until all have been met. Where some words may be
missing, the lists of as many of the rarest terms as one more than that give the candidates, for one
of those must have been met.

Terms that the benchmark does not use are in no list, so the index grows with the matter it is
asked about; the number of documents in which a term stands orders the terms by rarity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.common import WORD_TABLE, column_bytes, cut, free_names

WINDOW = 13
#: A proximity match has this many of a phrase's words, each within SLOP words of its place; for a shorter phrase both are scaled.
NEAR_WORDS = 10
SLOP = 2
#: Words of a segment; one longer document is a segment of its own.
SEGMENT_WORDS = 500_000
#: Benchmark words that are searched for at once; a larger benchmark is searched in blocks.
BLOCK_WORDS = 300_000
#: Candidates that are looked at together.
STEP = 1 << 18

SEGMENTS = "doc_ids array<bigint>, doc_starts array<int>, terms binary, list_starts binary, positions binary"


def nearness(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words that may be missing, words that each may be off its place) for phrases of these lengths."""
    return length * (WINDOW - NEAR_WORDS) // WINDOW, (2 * length * SLOP + WINDOW) // (2 * WINDOW)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


@dataclass
class Phrases:
    """The distinct windows of some benchmark items; all lengths are in words."""

    terms: dict[bytes, int] = field(default_factory=dict)
    words: list[list[int]] = field(default_factory=list)
    items: list[list] = field(default_factory=list)

    @classmethod
    def of(cls, items: list[tuple], window: int = WINDOW) -> Phrases:
        """From (item_id, text) pairs: every run of ``window`` words, or all words of a shorter item that has any."""
        out, known = cls(), {}
        for item, text in items:
            ids = [out.terms.setdefault(w, len(out.terms)) for w in words_of((text or "").encode())]
            if not ids:
                continue
            for i in range(max(1, len(ids) - window + 1)):
                key = tuple(ids[i : i + window])
                if key not in known:
                    known[key] = len(out.words)
                    out.words.append(list(key))
                    out.items.append([])
                owners = out.items[known[key]]
                if not owners or owners[-1] != item:
                    owners.append(item)
        return out

    def by_rarity(self, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(terms, offsets, length) by phrase, each row from its rarest term to its most frequent; -1 pads."""
        n = len(self.words)
        terms, offsets = np.full((n, WINDOW), -1, np.int32), np.zeros((n, WINDOW), np.int32)
        for i, ids in enumerate(self.words):
            order = sorted(range(len(ids)), key=lambda j: (often[ids[j]], j))
            terms[i, : len(ids)] = [ids[j] for j in order]
            offsets[i, : len(ids)] = order
        return terms, offsets, np.array([len(w) for w in self.words], np.int32)


def index(documents: DataFrame, terms: dict[bytes, int], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The positional index of all whole texts over the given terms: one row per segment.

    ``doc_starts`` are the documents' first positions in the segment, with the segment's length at
    the end; ``positions`` holds the terms' lists one after the other, ascending, from
    ``list_starts``. A null text has no words.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, runs, size = [], [0], [], 0

        def close() -> pa.RecordBatch:
            nonlocal ids, starts, runs, size
            at = np.concatenate(runs) if runs else np.zeros(0, np.int32)
            places = np.flatnonzero(at >= 0).astype(np.int32)
            found = at[places]
            order = np.argsort(found, kind="stable")
            present, first = np.unique(found[order], return_index=True)
            values = [[ids], [starts], [present.astype("<i4").tobytes()], [np.append(first, len(found)).astype("<i4").tobytes()], [places[order].astype("<i4").tobytes()]]
            types = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["doc_ids", "doc_starts", "terms", "list_starts", "positions"])
            ids, starts, runs, size = [], [0], [], 0
            return out

        get = terms.get
        for rows in batches:
            for key, body in zip(rows.column(0).to_pylist(), column_bytes(rows.column(1)), strict=True):
                words = words_of(body)
                if ids and size + len(words) > SEGMENT_WORDS:
                    yield close()
                ids.append(key)
                runs.append(np.fromiter((get(w, -1) for w in words), np.int32, len(words)))
                size += len(words)
                starts.append(size)
        if ids:
            yield close()

    return documents.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(build, SEGMENTS)


def postings(segments: DataFrame) -> DataFrame:
    """The index as rows (term, doc_id, position), for whoever wants to join it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                s = Segment(*(b.column(j)[i].as_py() for j in range(5)))
                doc = np.searchsorted(s.doc_starts, s.positions, side="right") - 1
                term = np.repeat(s.terms, np.diff(s.list_starts))
                yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(s.doc_ids, pa.int64()).take(pa.array(doc)), pa.array(s.positions - s.doc_starts[doc], pa.int32())], ["term", "doc_id", "position"])

    return segments.mapInArrow(rows, "term int, doc_id bigint, position int")


def term_counts(segments: DataFrame) -> DataFrame:
    """(term, n): in how many documents each indexed term stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for b in batches:
            for i in range(b.num_rows):
                s = Segment(*(b.column(j)[i].as_py() for j in range(5)))
                doc = np.searchsorted(s.doc_starts, s.positions, side="right") - 1
                term = np.repeat(np.arange(len(s.terms)), np.diff(s.list_starts))
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
                for t, n in zip(s.terms.tolist(), np.bincount(term[new], minlength=len(s.terms)).tolist(), strict=True):
                    total[t] = total.get(t, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    return segments.mapInArrow(count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


class Segment:
    """One segment's lists, with a phrase search over them."""

    def __init__(self, doc_ids: list[int | None], doc_starts: list[int], terms: bytes, list_starts: bytes, positions: bytes) -> None:
        self.doc_ids = doc_ids
        self.doc_starts = np.array(doc_starts, np.int64)
        self.terms, self.list_starts, self.positions = (np.frombuffer(x, "<i4") for x in (terms, list_starts, positions))
        self._at: np.ndarray | None = None

    @property
    def at(self) -> np.ndarray:
        """The term at each position, -1 for terms without a list, with a margin of -1 at both ends."""
        if self._at is None:
            self._at = np.full(int(self.doc_starts[-1]) + 4 * WINDOW, -1, np.int32)
            self._at[2 * WINDOW + self.positions] = np.repeat(self.terms, np.diff(self.list_starts))
        return self._at

    def candidates(self, terms: np.ndarray, offsets: np.ndarray, rank: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrase, start) arrays: the lists of each phrase's ``rank``-th rarest term less their offsets, in steps."""
        slot = np.full(int(max(terms[:, rank].max(initial=-1), self.terms.max(initial=-1))) + 2, -1, np.int64)
        slot[self.terms] = np.arange(len(self.terms))
        which = slot[terms[:, rank]]
        phrase = np.flatnonzero(which >= 0)
        n = np.diff(self.list_starts)[which[phrase]].astype(np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        for a in range(0, total, STEP):
            k = np.arange(a, min(total, a + STEP))
            p = np.searchsorted(ends, k, side="right")
            place = self.list_starts[which[phrase[p]]] + (k - (ends[p] - n[p]))
            yield phrase[p], self.positions[place].astype(np.int64) - offsets[phrase[p], rank]

    def met(self, terms: np.ndarray, place: np.ndarray, slop: int | np.ndarray, doc: np.ndarray | None = None) -> np.ndarray:
        """Whether each term stands within ``slop`` words of its place, and in that document where one is given."""
        out = np.zeros(len(place), bool)
        most = int(np.max(slop, initial=0))
        for slip in range(-most, most + 1):
            here = (self.at[2 * WINDOW + place + slip] == terms) & (abs(slip) <= slop)
            if doc is not None:
                here &= (place + slip >= self.doc_starts[doc]) & (place + slip < self.doc_starts[doc + 1])
            out |= here
        return out

    def nearby(self, terms: np.ndarray, offsets: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Proximity matches, exact ones among them, as (phrase, start, document).

        A match is found from the rarest of its terms that it has. Where that is the k-th, k words
        are missing already. Before the anchor's own slip is settled, other words may be off by twice the slop.
        """
        allowed, slop = nearness(length)
        out = []
        for k in range(int(allowed.max(initial=0)) + 1):
            usable = np.where((allowed >= k) & (length > k), terms[:, k], -1)
            some = np.flatnonzero(usable >= 0)
            for own, start in self.candidates(terms[some], offsets[some], k):
                p, s = some[own], start
                missed = np.full(len(p), k, np.int64)
                for j in range(k + 1, WINDOW):
                    missed += (length[p] > j) & ~self.met(terms[p, j], s + offsets[p, j], 2 * SLOP)
                    stay = missed <= allowed[p]
                    p, s, missed = p[stay], s[stay], missed[stay]
                d = np.searchsorted(self.doc_starts, s + offsets[p, k], side="right") - 1
                for slip in range(-SLOP, SLOP + 1):
                    fits = abs(slip) <= slop[p]
                    q, r, e = p[fits], s[fits] + slip, d[fits]
                    missed = np.zeros(len(q), np.int64)
                    for j in range(WINDOW):
                        missed += (length[q] > j) & ~self.met(terms[q, j], r + offsets[q, j], slop[q], e)
                        stay = missed <= allowed[q]
                        q, r, e, missed = q[stay], r[stay], e[stay], missed[stay]
                    out.append(np.stack([q, r, e]))
        found = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((3, 0), np.int64)
        return found[0], found[1], found[2]

    def search(self, terms: np.ndarray, offsets: np.ndarray, length: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Exact matches and proximity matches (those that aren't exact), each as (phrase, start, document)."""
        none = (np.zeros(0, np.int64),) * 3
        if not len(self.positions) or not len(terms):
            return none, none
        at, margin, exact = self.at, 2 * WINDOW, []
        for phrase, start in self.candidates(terms, offsets):
            doc = np.searchsorted(self.doc_starts, start + offsets[phrase, 0], side="right") - 1
            fits = (start >= self.doc_starts[doc]) & (start + length[phrase] <= self.doc_starts[doc + 1])
            p, s, d = phrase[fits], start[fits], doc[fits]
            for j in range(1, WINDOW):
                here = (length[p] <= j) | (at[margin + s + offsets[p, j]] == terms[p, j])
                p, s, d = p[here], s[here], d[here]
            exact.append((p, s, d))
        p, s, d = (np.concatenate(x) for x in zip(*exact, strict=True)) if exact else none
        q, r, e = self.nearby(terms, offsets, length)
        size = np.int64(len(at) + 1)
        only = ~np.isin(q * size + r, p * size + s)
        return (p, s, d), (q[only], r[only], e[only])


MATCHES = "doc_id bigint, n_words bigint, hit_from array<int>, hit_to array<int>, items array<string>, near_items array<string>"


def search(segments: DataFrame, phrases: Phrases) -> DataFrame:
    """One row per document: its number of words, the hit word runs, the items met exactly and those met nearby only."""
    often = np.zeros(len(phrases.terms), np.int64)
    for r in term_counts(segments).collect():  # as many rows as the phrases have terms, at most
        often[r.term] = r.n
    terms, offsets, length = phrases.by_rarity(often)
    owners = [[str(i) for i in x if i is not None] for x in phrases.items]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                seg = Segment(*(b.column(j)[i].as_py() for j in range(5)))
                (p, s, d), (q, _, e) = seg.search(terms, offsets, length)
                step = np.zeros(int(seg.doc_starts[-1]) + 1, np.int64)
                np.add.at(step, s, 1)
                np.add.at(step, s + length[p], -1)
                hit = np.cumsum(step)[:-1] > 0
                doc_of = np.searchsorted(seg.doc_starts, np.arange(len(hit))[hit], side="right") - 1
                found: dict[int, set[str]] = {}
                near: dict[int, set[str]] = {}
                for into, ps, docs in ((found, p, d), (near, q, e)):
                    for doc, w in set(zip(docs.tolist(), ps.tolist(), strict=True)):
                        into.setdefault(doc, set()).update(owners[w])
                runs: dict[int, tuple[list[int], list[int]]] = {}
                for d in np.unique(doc_of).tolist():
                    own = np.diff(np.concatenate([[0], hit[seg.doc_starts[d] : seg.doc_starts[d + 1]].astype(np.int8), [0]]))
                    runs[d] = (np.flatnonzero(own == 1).tolist(), np.flatnonzero(own == -1).tolist())
                n = len(seg.doc_ids)
                cols = [
                    pa.array(seg.doc_ids, pa.int64()),
                    pa.array(np.diff(seg.doc_starts)),
                    pa.array([runs.get(d, ([], []))[0] for d in range(n)], pa.list_(pa.int32())),
                    pa.array([runs.get(d, ([], []))[1] for d in range(n)], pa.list_(pa.int32())),
                    pa.array([sorted(found.get(d, ())) for d in range(n)], pa.list_(pa.string())),
                    pa.array([sorted(near.get(d, set()) - found.get(d, set())) for d in range(n)], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "hit_from", "hit_to", "items", "near_items"])

    return segments.mapInArrow(look, MATCHES)


def list_blocks(benchmark: DataFrame, block_words: int) -> int:
    """How many blocks of about ``block_words`` words, and eight times as many bytes, the benchmark makes, in whatever script."""
    words, size = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.octet_length("text")
    total = benchmark.agg(F.sum(F.greatest(words, F.ceil(size / 8)))).first()[0] or 0
    return -(-int(total) // block_words) or 1


def block_items(benchmark: DataFrame, block: int, blocks: int) -> list[tuple]:
    """The (item_id, text) rows of one block, which the driver holds alone."""
    part = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else benchmark
    return [(r.item_id, r.text) for r in part.select("item_id", "text").collect()]


def merge(left: list[tuple[int, int]], right: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(left + right):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def contamination(documents: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, hits (word runs inside an occurring window), items, near_items.

    doc_ids are whole numbers. Null texts have no words; null doc_ids come back as null; rows that share a doc_id each have
    their row. Items without words match nothing. What an item without an item_id hits is hit, but it has no name to be listed; rows
    that share an item_id are one item with several texts. An empty benchmark or table gives rows without
    hits, or none. Each block of the benchmark is indexed and searched over all documents; with more
    than one block, what the blocks found in a document is put together and joined to its rows.
    """
    blocks = list_blocks(benchmark, block_words)
    own = F.col(doc_id).cast("bigint")
    key = own if blocks == 1 else F.xxhash64(F.col(doc_id), F.col(text))
    slim = documents.select(key.alias("doc_id"), F.col(text).alias("text"))
    found = None
    for k in range(blocks):
        phrases = Phrases.of(block_items(benchmark, k, blocks), window)
        one = search(cut(index(slim, phrases.terms, "text", "doc_id")), phrases)
        found = one if found is None else found.unionByName(one)
    if blocks > 1:
        found = found.groupBy("doc_id").agg(
            F.max("n_words").alias("n_words"),
            F.flatten(F.collect_list("hit_from")).alias("hit_from"),
            F.flatten(F.collect_list("hit_to")).alias("hit_to"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"),
        )
        rows = documents.select(own.alias("_own"), key.alias("_key"))
        found = rows.join(found, rows["_key"] == found["doc_id"]).drop("doc_id", "_key").withColumnRenamed("_own", "doc_id")
    found = found.select("doc_id", "n_words", "hit_from", "hit_to", "items", "near_items")

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pydict()
            runs = [merge(list(zip(x, y, strict=True)), []) if x else [] for x, y in zip(rows["hit_from"], rows["hit_to"], strict=True)]
            n_hit = [sum(y - x for x, y in r) for r in runs]
            digest = [hashlib.sha256(",".join(i).encode()).hexdigest() for i in rows["items"]]
            cols = [
                pa.array(rows["doc_id"], pa.int64()),
                pa.array(rows["n_words"], pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array([[{"start": x, "end": y} for x, y in r] for r in runs], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                pa.array(rows["items"], pa.list_(pa.string())),
                pa.array(rows["near_items"], pa.list_(pa.string())),
                pa.array(digest, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_hit", "hits", "items", "near_items", "items_sha256"])

    out = found.mapInArrow(tidy, "doc_id bigint, n_words bigint, n_hit bigint, hits array<struct<start:int,end:int>>, items array<string>, near_items array<string>, items_sha256 string")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def filter_documents(documents: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``documents`` that are not contaminated, all columns as they were; rows are told apart by doc_id and text."""
    key = F.xxhash64(F.col(doc_id), F.col(text))
    (own,) = free_names(documents, "_row_key")
    marked = documents.withColumn(own, key)
    dirty = contamination(marked, benchmark, text, own).where("contaminated").select(F.col("doc_id").alias("_dirty")).distinct()
    return marked.join(dirty, marked[own] == dirty["_dirty"], "left_anti").drop(own)
