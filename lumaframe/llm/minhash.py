"""Near-duplicates by DartMinHash signatures and banded joining, with an exact check of every link.

A document is the set of its shingles of five words. Each shingle owns a region of the plane weight
x rank, as wide as its weight; darts fall into regions at rate one per unit of area, where a hash of
the shingle says, so a shingle gets the same darts in every document. A dart also names one of the
signature's coordinates. A document looks at the darts of its shingles in order of rank, as far as
needed to give every coordinate one, and the earliest per coordinate is its signature: two
documents agree in a coordinate with the probability of their weighted Jaccard similarity. As ranks
need to be looked at only up to about K log K over the document's weight, the cost for each shingle
does not grow with the number of coordinates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumaframe.llm.common import cut, empty, free_names, mix64, text_bytes, written
from lumaframe.llm.components import connected_components
from lumaframe.llm.suffix_dedup import Fingerprints
from lumaframe.llm.words import bounds

SHINGLE = 5
SIMILARITY = 0.8
#: Coordinates are joined in bands of ROWS: at a similarity of 0.8 a pair shares no band once in 300,000 pairs.
BANDS, ROWS = 24, 4
#: Texts are worked on in groups of about so many bytes.
GROUP_BYTES = 600_000
#: A hot bucket's rows are dealt to this many keys.
SALTS = 16
#: Members, and heads they are compared with, that one task holds together.
MEMBERS, HEADS = 1000, 500
#: In its k-th round a bucket's members are compared with its first 8**k - 1.
MORE = 8
#: Buckets beyond this size are put together by their first member when pairs across components are looked for.
LARGE = 32

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def word_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word by document): the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    plain, begin, end, first = bounds(raw, starts)
    return Fingerprints(plain).of(begin, end), first


def shingles(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, its document, and two digests by document): a text of one to four words is one shingle.

    Equal digests mean equal word sequences. Shingles come with repeats, in order of the text.
    """
    words, first = word_hashes(raw, starts)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(words)) - first[doc]
    value = words * _C[0] + at.astype(np.uint64) * _C[1]
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix64(value ^ c), dtype=np.uint64)]) for c in _C[2:]]
    digests = [mix64(s[first[1:]] - s[first[:-1]] + n.astype(np.uint64)) for s in sums]
    whole = at + SHINGLE <= n[doc]
    start = np.flatnonzero(whole | ((n[doc] < SHINGLE) & (at == 0)))
    out = np.zeros(len(start), np.uint64)
    short = ~whole[start]
    for j in range(SHINGLE):
        there = at[start] + j < n[doc[start]] if short.any() else slice(None)
        out[there] = mix64(out[there] * _C[0] + words[start[there] + j if short.any() else start + j] + np.uint64(j))
    return out, doc[start], *digests


class Darts:
    """Throws darts into the regions of weighted elements."""

    def __init__(self, coordinates: int) -> None:
        self.k = coordinates
        self.area = coordinates * np.log(coordinates) + 2 * coordinates

    def signatures(self, element: np.ndarray, owner: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
        """An array (n, coordinates): the earliest dart by coordinate; the largest integer where an owner has no element.

        A dart is a 64-bit integer, its rank in the upper bits. Weights are positive integers (ones if
        None): a weight of w is w regions of width one, so unequal weights share the lesser one's darts.
        """
        if weight is not None:
            layer = np.concatenate([np.arange(w) for w in weight]) if len(weight) else np.zeros(0, np.int64)
            element, owner = mix64(np.repeat(element, weight) + layer.astype(np.uint64) * _C[2]), np.repeat(owner, weight)
        out = np.full(n * self.k, np.iinfo(np.uint64).max, np.uint64)
        reach = self.area / np.maximum(np.bincount(owner, minlength=n), 1)
        low, high, cell = 0.0, 1 / 16, 0
        while len(element):
            self.throw(element, owner, low, high, cell, out)
            low, high, cell = high, 2 * high, cell + 1
            more = reach > low
            more |= (out.reshape(n, self.k) == np.iinfo(np.uint64).max).any(axis=1)
            keep = more[owner]
            if not keep.all():
                element, owner = element[keep], owner[keep]
        return out.reshape(n, self.k)

    def throw(self, element: np.ndarray, owner: np.ndarray, low: float, high: float, cell: int, out: np.ndarray) -> None:
        """The darts with ranks from ``low`` to ``high``: as many for each element as a Poisson law with that mean says."""
        seed = mix64(element + np.uint64((cell + 1) * int(_C[1]) & 0xFFFFFFFFFFFFFFFF))
        mean = high - low
        odds, law = np.exp(-mean), []
        i, total = 0, 0.0
        while total < 1 - 1e-13 and i < 20 * mean + 60:
            total += odds
            law.append(min(total, 1.0))
            i += 1
            odds *= mean / i
        chance = (seed >> np.uint64(11)).astype(np.float64) * 2.0**-53
        some = np.flatnonzero(chance > law[0])
        count = np.searchsorted(np.array(law), chance[some])
        from_ = np.repeat(some, count)
        order = np.arange(len(from_)) - np.repeat(np.cumsum(count) - count, count)
        dart = mix64(seed[from_] ^ (order.astype(np.uint64) + np.uint64(1)) * _C[2])
        rank = low + (dart >> np.uint64(24)).astype(np.float64) * 2.0**-40 * mean
        key = (rank * 2.0**28).astype(np.uint64) << np.uint64(24) | (dart & np.uint64(0xFFFFFF))
        coordinate = (mix64(dart + _C[3]) % np.uint64(self.k)).astype(np.int64)
        np.minimum.at(out, owner[from_] * self.k + coordinate, key)


def text_groups(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about GROUP_BYTES bytes."""
    raw, ends = text_bytes(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + GROUP_BYTES)) - 1)
        last = min(max(last, first + 1), len(column))
        yield first, raw[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def signed(texts: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, name, gone, d1, d2, bands) for (node, text, name, gone): digests of the word sequence, and one hash for each band of the signature.

    A text without words has no bands, and digests of its own.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        darts = Darts(bands * rows)
        for b in batches:
            for first, raw, starts in text_groups(b.column(1)):
                n = len(starts) - 1
                element, owner, d1, d2 = shingles(raw, starts)
                found = darts.signatures(element, owner, n)
                has = np.bincount(owner, minlength=n) > 0
                value = np.zeros((n, bands), np.uint64)
                for j in range(rows):
                    value = mix64(value * _C[0] + found[:, j::rows] + np.uint64(j))
                node = b.column(0).slice(first, n)
                own = mix64(node.to_numpy().astype(np.int64).view(np.uint64) + _C[1])
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(has, bands, 0))]).astype(np.int32), value[has].reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays([node, b.column(2).slice(first, n), b.column(3).slice(first, n), pa.array(np.where(has, d1, own).view(np.int64)), pa.array(np.where(has, d2, own).view(np.int64)), lists], ["node", "name", "gone", "d1", "d2", "bands"])

    return texts.mapInArrow(sign, "node bigint, name bigint, gone boolean, d1 bigint, d2 bigint, bands array<bigint>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, shingles): each text's distinct shingles as ascending 32-bit hashes, packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, raw, starts in text_groups(b.column(1)):
                element, owner, _, _ = shingles(raw, starts)
                ends = np.searchsorted(owner, np.arange(len(starts)))
                short = (element >> np.uint64(32)).astype("<u4")
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(starts) - 1), pa.array([np.unique(short[x:y]).tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["node", "shingles"])

    return texts.mapInArrow(pack, "node bigint, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, alike) of the pairs whose shingle sets have at least this Jaccard similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            alike = np.zeros(b.num_rows)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    alike[i] = -1.0
                    continue
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                alike[i] = shared / (len(both) - shared)
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(alike)], ["a", "b", "alike"])
            yield out.filter(pa.array(alike >= similarity - 1e-9))

    left, right = (sets.select(F.col("node").alias(f"_{k}"), F.col("shingles").alias(f"{k}_set")) for k in "ab")
    joined = pairs.join(right, pairs["b"] == right["_b"]).join(left, pairs["a"] == left["_a"])
    return joined.select("a", "b", "a_set", "b_set").mapInArrow(check, "a bigint, b bigint, alike double")


def stand_in(text: Column) -> Column:
    """A negative number for a row without a doc_id, made of its text."""
    return -F.abs(F.shiftright(F.xxhash64(text), 1)) - 1


def numbers(text: str, doc_id: str) -> tuple[Column, Column]:
    """(name, node) of a row: its doc_id or what stands in for one, and a hash that tells rows apart by name and text."""
    body = F.coalesce(F.col(text), F.lit(""))
    name = F.coalesce(F.col(doc_id).cast("bigint"), stand_in(body))
    return name, F.xxhash64(name, body)


def salted(node: str) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(SALTS)).cast("int")


def all_salts() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")


def unsettled(groups: DataFrame, labels: DataFrame, done: int) -> DataFrame:
    """The rows of groups that lie in more than one component and have members beyond the first ``done`` + 1, with
    components, and the number of parts that a group's members are dealt to."""
    named = labels.select(F.col("node").alias("_node"), "component")
    placed = groups.join(named, groups["rep"] == named["_node"], "left").withColumn("component", F.coalesce("component", "rep")).drop("_node")
    mixed = placed.groupBy("group").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.count(F.lit(1)).alias("_n"))
    open_ = mixed.where((F.col("_low") != F.col("_high")) & (F.col("_n") > done + 1)).select("group", F.ceil(F.col("_n") / MEMBERS).cast("int").alias("parts"), all_salts())
    return placed.withColumn("_salt", salted("rep")).join(open_, ["group", "_salt"]).drop("_salt")


def compared(members: DataFrame, heads: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the links between heads and later members of other components, by groups, parts of their members and blocks of their heads.

    Both sides have rep, component, size, alike, own (shingles of their own), shingles, and the keys
    group, part and block. A task counts the shingles that each pair shares and gives only links: no
    pair is a row. It holds at most about MEMBERS members and HEADS heads.
    """

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros((2, 0), np.int64)]
        if left.num_rows and right.num_rows:
            col = lambda t, k: t.column(k).to_numpy()
            sets = [np.frombuffer(x.as_buffer(), "<u4") for x in left.column("shingles")]
            owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            value = np.concatenate(sets)
            order = np.argsort(value, kind="stable")
            value, owner = value[order], owner[order]
            size, alike, part, own, rep = (col(left, k) for k in ("size", "alike", "component", "own", "rep"))
            for h in range(right.num_rows):
                mine = np.frombuffer(right.column("shingles")[h].as_buffer(), "<u4")
                first, last = np.searchsorted(value, mine), np.searchsorted(value, mine, side="right")
                n = last - first
                at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                shared = np.bincount(owner[at], minlength=len(sets))
                hs, ha, hc, ho, hr = (right.column(k)[h].as_py() for k in ("size", "alike", "component", "own", "rep"))
                later = (own > ho) | ((own == ho) & (rep > hr))
                near = (part != hc) & later & (np.abs(alike - ha) <= 1 - similarity + 1e-9)
                hit = np.flatnonzero(near & (shared >= similarity * (size + hs - shared) - 1e-9))
                out.append(np.stack([np.minimum(rep[hit], hr), np.maximum(rep[hit], hr)]))
        found = np.concatenate(out, axis=1)
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    keys = ("group", "part", "block")
    return members.groupBy(*keys).cogroup(heads.groupBy(*keys)).applyInArrow(count, "a bigint, b bigint").distinct()


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links: those of a graph whose nodes are the components so far."""
    ends = links
    for k in "ab":
        named = labels.select(F.col("node").alias("_node"), F.col("component").alias("_c"))
        ends = ends.join(named, ends[k] == named["_node"], "left").withColumn(k, F.coalesce("_c", k)).select("a", "b")
    merged = connected_components(ends).select(F.col("node").alias("_old"), F.col("component").alias("_new"))
    single = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").withColumn("component", F.col("node"))
    both = labels.unionByName(single)
    return written(both.join(merged, both["component"] == merged["_old"], "left").select("node", F.coalesce("_new", "component").alias("component")))


def shared_shingles(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """(rep, size, common) for the documents in ``rows``: shingles, and those that a document of another component has.

    Two documents of different components share at most the lesser ``common``, which bounds their
    similarity, also after components have grown; a collision of two shingles' hashes only raises
    the bound.
    """
    reps = rows.select(F.col("rep").alias("_rep"), "component").distinct()
    own = sets.join(reps, sets["node"] == reps["_rep"]).select("node", "shingles", "component")

    def spread_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [np.frombuffer(x.as_buffer(), "<i4") for x in b.column(1)]
            sizes = [len(x) for x in parts]
            arrays = [pa.array(np.repeat(b.column(k).to_numpy(), sizes)) for k in (0, 2)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.concatenate(parts))], ["node", "component", "shingle"])

    each = own.mapInArrow(spread_out, "node bigint, component bigint, shingle int")
    several = each.groupBy("shingle").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low <> _high").select("shingle")
    common = each.join(several, "shingle", "left_semi").groupBy(F.col("node").alias("_node")).agg(F.count(F.lit(1)).alias("common"))
    size = (F.length("shingles") / 4).cast("long")
    return own.join(common, own["node"] == common["_node"]).select(F.col("node").alias("rep"), size.alias("size"), "common")


def classes(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, copy_of): one row per document; documents linked by near-duplicate pairs share a class.

    A class is named by its least doc_id; ``copy_of`` is the least doc_id with the same words. Every
    pair of different texts that shares a band and has the similarity counts as a link:

    * Copies (equal word sequences) are put together first, and one stands for all.
    * In each bucket of a band, all members are compared with the first. Those links give components.
    * Buckets whose members are not all in one component are looked at again, with their first 7,
      63, 511, ... members against later ones of other components, until each is in one component or
      all its pairs across components have been dealt with. Members with the fewest shingles of
      their own come first: they lie in the middle of a group, so most others join them at once.
      Members go that share too few shingles with any other component for a link. Heads and members
      meet in blocks of bounded size, in which the shingles of each pair are counted and only links
      are given. Large buckets with the same first member are dealt with together. So no pair that
      could join two components is left out, and no pair but a link becomes a row.

    Links are verified on 32-bit hashes of the shingles: two shingles of a pair fall together by chance
    once in 4 billion. doc_ids are whole numbers.

    Null and empty texts, and texts without words, are in a class of their own. A null doc_id stays
    null; its row is known by a hash of its text, as a negative class id. Rows that share a doc_id
    but not a text are documents of their own, whose classes may have one name; ``row_id`` tells
    them apart, and ``stays`` is the row_id of the class's first document. An empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    name, node = numbers(text, doc_id)
    texts = documents.select(node.alias("node"), body.alias("text"), name.alias("name"), F.col(doc_id).isNull().alias("gone"))
    known = cut(signed(texts))
    texts = texts.select("node", "text")
    copies = known.groupBy("d1", "d2").agg(F.min("node").alias("rep"), F.min(F.struct("name", "node")).alias("first"), F.first("bands").alias("bands"))
    copies = cut(copies)
    rows = copies.select("rep", F.posexplode("bands").alias("band", "hash"))
    buckets = rows.groupBy("band", "hash").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = buckets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    members = rows.withColumn("_salt", salted("rep")).join(dealt, ["band", "hash", "_salt"]).select("band", "hash", "lead", "n", "rep")
    members = cut(members)
    wanted = members.select(F.col("rep").alias("_rep")).distinct()
    sets = cut(shingle_sets(texts.join(wanted, texts["node"] == wanted["_rep"], "left_semi").dropDuplicates(["node"])))
    led = written(verified(members.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct(), sets, 0.0))
    labels = connected_components(led.where(F.col("alike") >= similarity - 1e-9).select("a", "b"))
    group = F.when(F.col("n") > LARGE, F.xxhash64(F.lit(-1), "lead")).otherwise(F.xxhash64("band", "hash"))
    groups = members.where("n > 2 AND rep <> lead").select(group.alias("group"), "lead", "rep").distinct()
    groups = written(groups.join(led, (groups["lead"] == led["a"]) & (groups["rep"] == led["b"])).select("group", "rep", "alike"))
    first = written(unsettled(groups, labels, 0))
    if not empty(first):
        # a document that shares too few of its shingles with any other component is in no link that matters
        shared = shared_shingles(sets, first).where(F.col("common") >= similarity * F.col("size") - 1e-9)
        groups = written(groups.join(shared, "rep").withColumn("own", F.col("size") - F.col("common")))
    own_sets = sets.select(F.col("node").alias("rep"), "shingles")
    done, upto = 0, MORE - 1
    while not empty(first):
        still = written(unsettled(groups, labels, done))
        if empty(still):
            break
        at = F.row_number().over(W.partitionBy("group").orderBy("own", "rep"))
        heads = written(still.withColumn("_at", at).where(F.col("_at") <= upto).where(F.col("_at") > done).withColumn("block", F.floor((F.col("_at") - done - 1) / HEADS).cast("int")))
        columns = ("rep", "component", "size", "alike", "own", "shingles", "group", "part", "block")
        blocks = heads.groupBy("group").agg((F.max("block") + 1).alias("_blocks"))
        part = F.pmod(F.xxhash64("rep", F.lit("part")), F.col("parts")).cast("int")
        members = still.join(blocks, "group").withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        heads = heads.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        members, heads = (t.join(own_sets, "rep").select(*[F.col(c).alias(c) for c in columns]) for t in (members, heads))
        fresh = written(compared(members, heads, similarity))
        done, upto = upto, MORE * (upto + 1) - 1
        if not empty(fresh):
            labels = joined_labels(labels, fresh)
    salts = all_salts()
    linked = labels.join(copies.select("rep", "first"), labels["node"] == F.col("rep"))
    leads = linked.groupBy("component").agg(F.min("first").alias("lead")).select("component", "lead", salts)
    placed = labels.withColumn("_salt", salted("node")).join(leads, ["component", "_salt"]).select(F.col("node").alias("_node"), "lead")
    reps = copies.select("d1", "d2", "rep", "first", salts)
    reps = reps.join(placed, reps["rep"] == placed["_node"], "left").select("d1", "d2", "_salt", F.col("first.name").alias("copy_of"), F.coalesce("lead", "first").alias("lead"))
    named = known.select("node", "name", "gone", "d1", "d2", salted("node").alias("_salt"))
    out = named.join(reps, ["d1", "d2", "_salt"])
    return out.select(F.when(~F.col("gone"), F.col("name")).alias("doc_id"), F.col("lead.name").alias("class_id"), "copy_of", F.col("node").alias("row_id"), F.col("lead.node").alias("stays"))


def filter_documents(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each class, that with the least doc_id, all columns as they were; of rows equal in doc_id and text one stays."""
    (own,) = free_names(documents, "_node")
    named = documents.withColumn(own, numbers(text, doc_id)[1])
    stay = classes(documents, text, doc_id).where("row_id = stays").select(F.col("row_id").alias("_stay")).distinct()
    return named.join(stay, named[own] == stay["_stay"], "left_semi").dropDuplicates([own]).drop(own)
