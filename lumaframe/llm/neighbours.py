"""Nearest neighbours by counting collisions: sorted projections, windows around the query, virtual rehashing.

Vectors are brought to length one, where the nearest by cosine are the nearest by distance. Each of many
random projections of a block of vectors is a sorted array. Around a query's own projection a window of half-width
``WIDTH`` * R is cut out of each array; what lies in it collides with the query. A vector at distance R collides
with a known probability p, so vectors with fewer collisions than p allows for are passed over, and the
others are verified: their cosine is computed from the original values in double precision. The radius R then
grows by ``GROWTH`` and the windows widen on both sides (a larger bucket of the same hash, so nothing is
hashed again), until R reaches the distance of the last neighbour wanted. At the greatest radius all vectors are verified.

How far windows must grow is known early, as every query first meets a bounded sample (``SAMPLE`` vectors,
whose nearest are verified too and are the first neighbours found). The sample sets where to begin and end;
every vector is in the arrays, and whatever is nearer than the sample's neighbours is found by collisions.

On Spark: equal vectors become one class (all its rows have the same cosine with everything, and of those only
the k + 1 smallest ids can be among a query's k). Queries and classes are dealt out to cells (query block, vector group);
a task takes the queries of a cell, streams its vectors through in blocks of ``BLOCK``, and gives k + 1 classes for each query.
So a task holds one block of queries and one of vectors, and a query has ``GROUPS`` short lists to merge, whatever the table's size.

Defined results: vectors that are null, empty, zero, or hold nulls or non-finite numbers take no part, nor do rows without
vec_id. Of rows that share a vec_id the least vector counts. Only vectors of equal length are compared. Of
equal cosines the smaller vec_id comes first. Fewer candidates than k are all returned; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumaframe.llm.common import spread, written

#: Projections, half-width of a window per radius, standard deviations of the count that are allowed for.
PROJECTIONS, WIDTH, SLACK = 128, 1.4, 2.2
#: Least radius and growth of the radius.
RADIUS, GROWTH = 0.02, 1.1
#: Vectors in the sample, queries in a block, vectors in a block of sorted arrays, vector groups of a query block.
SAMPLE, QUERIES, BLOCK, GROUPS = 2048, 4096, 16384, 12

#: Steps from a query's first window to the widest that its sample's neighbours leave to be searched.
STEPS = 7

RADII = RADIUS * GROWTH ** np.arange(int(np.ceil(np.log(2.0 / RADIUS) / np.log(GROWTH))) + 1)
#: Of this many projections of a vector at the radius, so many fall into the window with the probability that SLACK says.
_P = 2 * NormalDist().cdf(WIDTH) - 1
THRESHOLD = int(np.floor(PROJECTIONS * _P - SLACK * np.sqrt(PROJECTIONS * _P * (1 - _P))))


def projections(dim: int, seed: int = 0) -> np.ndarray:
    """(dim, PROJECTIONS) random directions, in orthogonal groups of at most ``dim``; lengths are such that a distance d projects to d on average of squares."""
    rng, parts = np.random.default_rng([seed, dim]), []
    while sum(p.shape[1] for p in parts) < PROJECTIONS:
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        parts.append(q * np.sign(np.diag(r)) * np.sqrt(dim))
    return np.concatenate(parts, 1)[:, :PROJECTIONS]


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, lengths): each vector times a power of two, so that no square overflows or vanishes."""
    _, power = np.frexp(np.abs(vectors).max(1, initial=0.0))
    out = np.ldexp(vectors, -power[:, None])
    return out, np.sqrt((out * out).sum(1))


def cosines(q: np.ndarray, ql: float, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Row by row, so that equal vectors have equal cosines wherever they stand."""
    return np.clip((rows * q).sum(1) / (ql * lengths), -1.0, 1.0)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def reach(scores: np.ndarray, k: int) -> float:
    """The distance of the k-th neighbour found; the greatest there is, where there are fewer."""
    return float(np.sqrt(max(0.0, 2 - 2 * scores[k - 1]))) if len(scores) >= k else RADII[-1]


def growing(bound: float) -> np.ndarray:
    """Radii from about half a bound until it is passed; always so many."""
    last = int(min(np.searchsorted(RADII, bound), len(RADII) - 1))
    return RADII[np.maximum(np.arange(last - STEPS + 1, last + 1), 0)]


class Block:
    """The sorted projections of some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lengths: np.ndarray, directions: np.ndarray) -> None:
        self.ids, self.vectors, self.lengths = ids, vectors, lengths
        values = ((vectors / lengths[:, None]) @ directions).T
        self.order = np.argsort(values, 1)
        self.sorted = np.take_along_axis(values, self.order, 1)

    def windows(self, projected: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) of the windows at each query's radii: (queries, radii, projections)."""
        begin = np.empty((*radii.shape, PROJECTIONS), np.int32)
        end = np.empty_like(begin)
        for i in range(PROJECTIONS):
            at = projected[:, i, None]
            begin[:, :, i] = np.searchsorted(self.sorted[i], at - WIDTH * radii)
            end[:, :, i] = np.searchsorted(self.sorted[i], at + WIDTH * radii, "right")
        return begin, end

    def search(self, q: np.ndarray, length: float, radii: np.ndarray, begin: np.ndarray, end: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of what is known and what collides; ``begin`` and ``end``: the query's windows at ``radii``."""
        n = len(self.ids)
        counts, seen = np.zeros(n, np.int64), np.zeros(n, bool)
        a = b = None
        for radius, lo, hi in zip(radii, begin, end, strict=True):
            if radius >= RADII[-1]:
                found = np.flatnonzero(~seen)
            else:
                if a is None:
                    parts = [self.order[i, lo[i] : hi[i]] for i in range(PROJECTIONS)]
                else:
                    parts = [self.order[i, lo[i] : a[i]] for i in range(PROJECTIONS)] + [self.order[i, b[i] : hi[i]] for i in range(PROJECTIONS)]
                a, b = lo, hi
                counts += np.bincount(np.concatenate(parts), minlength=n)
                found = np.flatnonzero((counts >= THRESHOLD) & ~seen)
            if len(found):
                seen[found] = True
                own = cosines(q, length, self.vectors[found], self.lengths[found])
                fresh = ~np.isin(self.ids[found], ids)
                ids, scores = best(np.concatenate([ids, self.ids[found][fresh]]), np.concatenate([scores, own[fresh]]), k)
            if radius >= reach(scores, k):
                break
        return ids, scores


def sound(v: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def classes(vectors: DataFrame, k: int, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """((class_id, v, ids), (vec_id, v)): distinct vectors with their k + 1 smallest vec_ids, and the rows that take part. The smallest id is the class's name.

    Ranks up to a bound are taken within each task before anything is shuffled, so that a vector which
    very many rows share sends k + 1 rows a task.
    """
    rows = vectors.select("vec_id", F.transform(vector, lambda x: x.cast("double") + F.lit(0.0)).alias("v")).where(F.col("vec_id").isNotNull() & sound(F.col("v")))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    nth = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    held = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    groups = held.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return groups.select(F.get("ids", F.lit(0)).alias("class_id"), "v", "ids"), rows


def _matrix(column: pa.Array) -> np.ndarray:
    """Equal-length lists of doubles as rows."""
    flat = column.flatten()
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0), kind))


def seeded(queries: DataFrame, sample: list, k: int) -> DataFrame:
    """(class_id, v, near, scores): each query class with the k + 1 nearest classes of the sample (of its own length)."""
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r.v), []).append(r)
    known = {d: (np.array([r.class_id for r in rs], np.int64), *scaled(np.array([r.v for r in rs], np.float64))) for d, rs in by_dim.items()}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, scores = [], []
            for v in b.column(1):
                q, length = scaled(np.array([v.as_py()], np.float64))
                if len(q[0]) in known:
                    ids, rows, lengths = known[len(q[0])]
                    i, s = best(ids, cosines(q[0], length[0], rows, lengths), k + 1)
                else:
                    i, s = np.zeros(0, np.int64), np.zeros(0)
                near.append(i)
                scores.append(s)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(near, pa.int64()), _lists(scores, pa.float64())], ["class_id", "v", "near", "scores"])

    return queries.select("class_id", "v").mapInArrow(meet, "class_id bigint, v array<double>, near array<bigint>, scores array<double>")


def collide(queries: DataFrame, every: DataFrame, k: int, blocks: int, seed: int = 0) -> DataFrame:
    """(query, class_id, score): for each query class and vector group the k + 1 nearest classes found."""
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dim = F.size("v").alias("dim")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("near", "array<bigint>"), ("scores", "array<double>"))]
    # a cell's name holds the vectors' length, the block of queries and the group of vectors
    left = queries.select(dim, F.pmod(F.xxhash64("class_id"), F.lit(blocks)).alias("block"), upto(GROUPS).alias("grp"), F.lit(0).alias("kind"), "class_id", "v", "near", "scores")
    right = every.select(dim, upto(blocks).alias("block"), F.pmod(F.xxhash64("class_id", F.lit(1)), F.lit(GROUPS)).alias("grp"), F.lit(1).alias("kind"), "class_id", "v", *none)
    cells = left.unionByName(right).repartition(max(spread(every), 4 * blocks * GROUPS), "dim", "block", "grp").sortWithinPartitions("dim", "block", "grp", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: tuple | None = None
        asked: dict = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def scan() -> None:
            """Let the queries meet the vectors that are held."""
            if held and asked["q"]:
                rows, lengths = scaled(np.concatenate([v for _, v in held]))
                block = Block(np.concatenate([i for i, _ in held]), rows, lengths, asked["directions"])
                step = 256
                for first in range(0, len(asked["q"]), step):
                    qs = asked["q"][first : first + step]
                    radii = np.stack([growing(reach(s, k + 1)) for _, s in asked["found"][first : first + step]])
                    begin, end = block.windows(np.stack([q / length for _, q, length in qs]) @ asked["directions"], radii)
                    for j, (_, q, length) in enumerate(qs):
                        asked["found"][first + j] = block.search(q, length, radii[j], begin[j], end[j], *asked["found"][first + j], k + 1)
            held.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            scan()
            if asked.get("q"):
                sizes = [len(i) for i, _ in asked["found"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([c for c, _, _ in asked["q"]], sizes).astype(np.int64)), pa.array(np.concatenate([i for i, _ in asked["found"]])), pa.array(np.concatenate([s for _, s in asked["found"]]))],
                    ["query", "class_id", "score"],
                )

        for b in batches:
            keys = np.stack([np.asarray(b.column(i), np.int64) for i in range(4)], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]]), strict=True):
                if lo == hi:
                    continue
                own, kind, part = tuple(keys[lo, :3]), keys[lo, 3], b.slice(lo, hi - lo)
                if own != cell:
                    yield from flush()
                    cell = own
                    asked = {"q": [], "found": [], "directions": projections(int(own[0]), seed)}
                vectors, ids = _matrix(part.column(5)), np.asarray(part.column(4), np.int64)
                if kind == 0:
                    rows, lengths = scaled(vectors)
                    asked["q"] += zip(ids, rows, lengths, strict=True)
                    asked["found"] += [(np.array(i, np.int64), np.array(s, np.float64)) for i, s in zip(part.column(6).to_pylist(), part.column(7).to_pylist(), strict=True)]
                else:
                    for first in range(0, len(ids), BLOCK):
                        held.append((ids[first : first + BLOCK], vectors[first : first + BLOCK]))
                        if sum(len(i) for i, _ in held) >= BLOCK:
                            scan()
        yield from flush()

    return cells.mapInArrow(run, "query bigint, class_id bigint, score double")


def nearest(vectors: DataFrame, asked: Column, k: int = 5, vector: str = "embedding", seed: int = 0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows found for each row that ``asked`` (a condition on vec_id) picks."""
    found, rows = classes(vectors, k, vector)
    every = written(found)
    picked = written(rows.where(asked).join(every.select("v", "class_id"), "v").select(F.col("vec_id").alias("query_id"), "class_id"))
    wanted = every.join(picked.select("class_id").distinct(), "class_id", "left_semi")
    blocks = max(1, -(-picked.select("class_id").distinct().count() // QUERIES))
    sample = every.select("class_id", "v").orderBy(F.xxhash64("class_id", F.lit(seed)), "class_id").limit(SAMPLE).collect()  # of a fixed size
    pairs = collide(seeded(wanted, sample, k), every, k, blocks, seed).distinct()
    few = pairs.withColumn("nth", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "class_id"))).where(F.col("nth") <= k + 1).drop("nth")
    members = few.join(every.select("class_id", "ids"), "class_id").groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    out = picked.join(members, picked["class_id"] == members["query"])
    ids = F.flatten(F.transform("near", lambda c: F.transform(c["ids"], lambda i: F.struct((-c["score"]).alias("s"), i.alias("id")))))
    top = F.slice(F.array_sort(F.filter(ids, lambda p: p["id"] != F.col("query_id"))), 1, k)
    return out.select("query_id", F.posexplode(top).alias("at", "p")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("p.id").alias("vec_id"), (-F.col("p.s")).alias("score"))
