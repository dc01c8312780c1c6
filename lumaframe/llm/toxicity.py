"""Toxicity by maximum-scoring segments of token log-odds.

Labelled documents give each word a log-odds score under Dirichlet priors: a word's rates are drawn
towards those of its stem (its first letters), and a stem's towards the corpus. A linear-time scan
(Ruzzo and Tompa) then finds all maximal-scoring segments of a text's words. By Karlin and
Altschul's extreme-value law, chance alone gives K n exp(-lambda S) segments of score S or more in n
words; that calibrates segments of texts of any length, their sum statistic puts all of a text's
segments together, and a logistic curve fitted to labelled documents that the scores have not seen
turns this evidence into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.common import cut, top_rows
from lumaframe.llm.words import numbered

#: At most about so many labelled rows are learned from, chosen by a hash of doc_id; all are taken where there are no more.
MAX_LABELLED = 200_000
#: At most so many words and so many stems keep scores, the surest first; they are sent to every task.
MAX_WORDS, MAX_STEMS = 60_000, 20_000
STEM = 4
MIN_DOCS = 5
#: Strength of the Dirichlet priors, in documents.
PRIOR = 50.0
#: Scores surer than this many standard deviations are kept.
SURE = 3.5
#: Taken off every score, so that chance segments stay short.
DRIFT = 0.05
#: Scores this near zero are left out: they are many, and add up by chance in long texts.
LEAST = 2.0
CLIP = (-1.0, 8.0)
#: Passages with fewer chance segments than this in their text are reported.
SIGNIFICANT = 0.01
THRESHOLD = 0.3
#: Texts are looked at in groups of about so many bytes.
GROUP_BYTES = 8_000_000
FOLDS = 4
HELD_OUT = 2
#: Of the folds not held out, this one fits the calibration, the others the scores.
CALIBRATION = 3


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def slices(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows with about GROUP_BYTES bytes, as (first row, texts)."""
    sizes = np.array(pc.fill_null(pc.binary_length(column), 0), np.int64)
    ends, first = np.cumsum(sizes), 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + GROUP_BYTES)))
        yield first, column.slice(first, last - first)
        first = last


def word_counts(labelled: DataFrame) -> DataFrame:
    """(word, toxic, clean): in how many of the labelled documents (text, toxic) each word stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in slices(b.column(0)):
                label = np.array(b.column(1).slice(first, len(texts)), np.int64)
                words, number, starts = numbered(texts)
                doc = np.repeat(np.arange(len(texts)), np.diff(starts))
                pair = np.unique(doc * len(words) + number)
                toxic = label[pair // max(1, len(words))] == 1
                one, zero = (np.bincount(pair[keep] % max(1, len(words)), minlength=len(words)) for keep in (toxic, ~toxic))
                used = np.flatnonzero(one + zero)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(used)).cast(pa.string()), pa.array(one[used]), pa.array(zero[used])], ["word", "toxic", "clean"])

    return labelled.select("text", "toxic").mapInArrow(count, "word string, toxic bigint, clean bigint").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


@dataclass
class Scores:
    """Log-odds of words and stems, bounded in number, and the law of chance segments."""

    words: dict[str, float]
    stems: dict[str, float]
    rate: float = 1.0
    scale: float = 0.1
    slope: float = 1.0
    offset: float = 0.0

    def of(self, word: str) -> float:
        found = self.words.get(word)
        if found is None:
            found = self.stems.get(word[:STEM], 0.0)
        return found - DRIFT

    def text_scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(score of each word of the texts in order, first word by text)."""
        words, number, starts = numbered(column)
        each = np.fromiter(map(self.of, words.to_pylist()), np.float64, len(words))
        return each[number], starts

    def expected(self, score: float, n: int) -> float:
        """Segments of this score or more that chance gives in n words."""
        return self.scale * max(n, 1) * float(np.exp(-self.rate * score))

    def evidence(self, found: list[float], n: int) -> float:
        """The surprise of a text of n words with segments of these scores: minus the log of its chance, -20 without any segment.

        One segment's is minus the log of its expectation. Several together may surprise more than the
        best alone: the sum T of r normalised scores has a chance of about exp(-T) T^(r-1) / (r! (r-1)!)
        where T is large against r. The most surprising r counts.
        """
        if not found:
            return -20.0
        ground = float(np.log(self.scale * max(n, 1)))
        total, best, fact = 0.0, -np.inf, 0.0
        for r, score in enumerate(sorted(found, reverse=True), 1):
            value = self.rate * score - ground
            if r > 1 and value <= 0:
                break
            total += value
            if r > 1:
                fact += float(np.log(r * (r - 1)))  # of r! (r - 1)!
            if r == 1:
                best = total
            elif total >= r * (r + 1):
                best = max(best, total - (r - 1) * float(np.log(total)) + fact)
        return float(np.clip(best, -20.0, 60.0))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.offset, -500, 500)))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in one pass over the positive scores."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    held: list[tuple[int, int, float, float]] = []  # start, end, total before, total after
    before: list[int] = []  # for each held segment, the nearest one to its left with a lower total before it
    for at in np.flatnonzero(scores > 0).tolist():
        new = (at, at + 1, float(total[at]), float(total[at + 1]))
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= new[2]:
                j = before[j]
            if j < 0 or held[j][3] >= new[3]:
                held.append(new)
                before.append(j)
                break
            new = (held[j][0], new[1], held[j][2], new[3])
            del held[j:], before[j:]
    return [(a, b, r - l) for a, b, l, r in held]


def learn_scores(labelled: DataFrame) -> Scores:
    """Scores from (text, toxic); at most MAX_WORDS + MAX_STEMS of them reach the driver."""
    n = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    docs = (n.get(1, 0), n.get(0, 0))
    everything = sum(docs) + 1
    counts = cut(word_counts(labelled).where(F.col("toxic") + F.col("clean") >= MIN_DOCS))
    long = F.length("word") > STEM
    stems = counts.groupBy(F.substring("word", 1, STEM).alias("stem")).agg(F.sum("toxic").alias("s1"), F.sum("clean").alias("s0"), F.max(long.cast("int")).alias("long"))

    def odds(one: Column, zero: Column, p1: Column, p0: Column) -> tuple[Column, Column]:
        a, b = one + p1, zero + p0
        value = F.log(a / (docs[0] + PRIOR)) - F.log(b / (docs[1] + PRIOR))
        return value, value / F.sqrt(1 / a + 1 / b)

    # a stem counts once for each of its words in a document, so its counts can pass the number of documents
    prior = PRIOR * (F.col("s1") + F.col("s0")) / everything
    value, sure = odds(F.col("s1"), F.col("s0"), prior, prior)
    stems = stems.withColumn("stem_odds", value).withColumn("stem_sure", sure)
    share = (F.col("toxic") + F.col("clean") + 1.0) / (F.col("s1") + F.col("s0") + 1.0)
    lift = F.exp(F.when(F.abs("stem_sure") >= SURE, F.col("stem_odds")).otherwise(0.0) / 2)
    base = PRIOR * (F.col("s1") + F.col("s0")) / everything * share
    value, sure = odds(F.col("toxic"), F.col("clean"), base * lift, base / lift)
    words = counts.join(stems, F.substring("word", 1, STEM) == stems["stem"]).withColumn("odds", value).withColumn("sure", sure)
    telling = (F.abs("stem_sure") >= SURE) & (F.abs("stem_odds") >= LEAST)
    wanted = words.where(((F.abs("sure") >= SURE) & (F.abs("odds") >= LEAST)) | telling).withColumn("_s", F.greatest(F.abs("sure"), F.abs("stem_sure")))
    kept_words = top_rows(wanted, "_s", MAX_WORDS)[0].select("word", "odds").collect()
    kept_stems = top_rows(stems.where(telling & (F.col("long") == 1)).withColumn("_s", F.abs("stem_sure")), "_s", MAX_STEMS)[0].select("stem", "stem_odds").collect()
    clip = lambda x: min(max(x, CLIP[0]), CLIP[1])
    return Scores({r.word: clip(r.odds) for r in kept_words}, {r.stem: clip(r.stem_odds) for r in kept_stems})


FOUND = "doc_id bigint, n_words bigint, best double, evidence double, n_segments bigint, passages array<struct<start:int,end:int,score:double,expected:double>>"


def scan(documents: DataFrame, scores: Scores) -> DataFrame:
    """For (doc_id, text): the number of words, the best segment's score, the evidence of all segments together, and every passage that chance hardly explains."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
        for b in batches:
            for first, texts in slices(b.column(1)):
                each, starts = scores.text_scores(texts)
                n = np.diff(starts)
                some = np.add.reduceat(np.concatenate([(each > 0).astype(np.int64), [0]]), starts[:-1]) * (n > 0)
                best, count, passages = np.zeros(len(n)), np.zeros(len(n), np.int64), [[] for _ in n]
                evidence = np.full(len(n), -20.0)
                for i in np.flatnonzero(some).tolist():
                    found = segments(each[starts[i] : starts[i + 1]])
                    best[i], count[i] = max(s for _, _, s in found), len(found)
                    evidence[i] = scores.evidence([s for _, _, s in found], int(n[i]))
                    likely = [(x, y, s, scores.expected(s, int(n[i]))) for x, y, s in found]
                    passages[i] = [{"start": x, "end": y, "score": s, "expected": e} for x, y, s, e in likely if e <= SIGNIFICANT]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(n)), pa.array(n), pa.array(best), pa.array(evidence), pa.array(count), pa.array(passages, kind)], ["doc_id", "n_words", "best", "evidence", "n_segments", "passages"])

    return documents.select("doc_id", "text").mapInArrow(look, FOUND)


def chance(labelled: DataFrame, scores: Scores) -> tuple[float, float]:
    """(lambda, K) of segments in clean labelled texts: lambda makes the mean of exp(lambda score) one; K makes the
    expected number of positive segments that of the maximal segments seen."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros(256, np.int64)
        seen, n = 0, 0
        for b in batches:
            for _, texts in slices(b.column(0)):
                each, starts = scores.text_scores(texts)
                bins += np.bincount(np.clip(np.round((each + 2) * 20), 0, 255).astype(np.int64), minlength=256)
                n += len(each)
                for i in range(len(texts)):
                    own = each[starts[i] : starts[i + 1]]
                    seen += len(segments(own)) if (own > 0).any() else 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(258)), pa.array(np.concatenate([bins, [seen, n]]))], ["bin", "n"])

    rows = labelled.where("toxic = 0").select("text").mapInArrow(tally, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    got = {r.bin: r.n for r in rows}
    n, seen = got.pop(257, 0), got.pop(256, 0)
    if not n or not seen:
        return 1.0, 0.01
    value = np.array([k / 20 - 2 for k in got])
    share = np.array(list(got.values()), np.float64) / n
    low, high = 1e-3, 8.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (share * np.exp(middle * value)).sum() < 1 else (low, middle)
    typical = float((value * share)[value > 0].sum() / max(share[value > 0].sum(), 1e-12))
    return low, float(np.clip((seen + 0.5) / n * np.exp(low * typical), 1e-4, 1.0))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the logistic curve with the least loss, by damped Newton steps with a weak prior; no negative slope."""

    def loss(w: np.ndarray) -> float:
        z = w[0] * x + w[1]
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + 0.5e-3 * (w @ w))

    w = np.array([0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -30, 30)))
        grad = np.array([((p - y) * x).sum(), (p - y).sum()]) + 1e-3 * w
        v = p * (1 - p)
        hess = np.array([[(v * x * x).sum(), (v * x).sum()], [(v * x).sum(), v.sum()]]) + 1e-3 * np.eye(2)
        step, size, now = np.linalg.solve(hess, grad), 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return max(float(w[0]), 0.0), float(w[1])


def learn(documents: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", max_labelled: int = MAX_LABELLED) -> Scores:
    """Scores and calibration from the labelled documents outside the held-out fold.

    The labels taken are at most about ``max_labelled`` rows, which bounds what is broadcast and what
    the driver fits; rows without a label, and labels without a document, teach nothing. Of several labels of one doc_id
    the greatest counts, once; other columns of ``labels`` aren't read.
    """
    own = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).where(fold(F.col(doc_id)) != HELD_OUT).select(F.col(doc_id).cast("bigint").alias("_id"), F.col(label).cast("bigint").alias("toxic"))
    own = own.groupBy("_id").agg(F.max("toxic").alias("toxic"))  # one label for each doc_id
    n = own.count()
    if n > max_labelled:
        own = own.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(max_labelled / n * (1 << 30)))
    slim = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    labelled = slim.join(F.broadcast(own), slim["doc_id"] == own["_id"]).select("doc_id", "text", "toxic", fold(F.col("doc_id")).alias("_fold"))
    scores = learn_scores(labelled.where(F.col("_fold") != CALIBRATION))
    fresh = labelled.where(F.col("_fold") == CALIBRATION)
    scores.rate, scores.scale = chance(fresh, scores)
    rows = scan(fresh, scores).select("doc_id", "evidence").join(F.broadcast(own), F.col("doc_id") == own["_id"]).select("evidence", "toxic").toPandas()
    if rows["toxic"].nunique() == 2:
        scores.slope, scores.offset = logistic(rows["evidence"].to_numpy(np.float64), rows["toxic"].to_numpy(np.float64))
    else:
        scores.slope, scores.offset = 1.0, -5.0
    return scores


def score_documents(documents: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """Per document: held_out, score (the probability of the label), predicted, n_words, and the significant passages (word offsets).

    Only the text enters a score. Null and empty texts have no words and get the score of a text
    without any toxic word. Rows that share a doc_id are scored one by one; a null doc_id is never
    held out. Without labels of both kinds scores stay low.
    """
    scores = learn(documents, labels, text, doc_id, label)
    slim = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    found = scan(slim, scores)
    score = 1 / (1 + F.exp(-(F.lit(scores.slope) * F.col("evidence") + F.lit(scores.offset))))
    out = found.withColumn("score", score)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_words", "passages")
