"""Collocations, neighbours and the filter audit against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from lumaframe.llm import collocations, filter_audit, neighbours

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def low(s: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def brute_phrases(rows, least, most):
    one, two, three = Counter(), Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low(text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            for k, c in ((1, one), (2, two), (3, three)):
                for i in range(len(w) - k + 1):
                    c[lang, *w[i : i + k]] += 1
    out = []
    total = Counter()
    for (lang, _), n in one.items():
        total[lang] += n
    kept3 = {p: a for p, a in three.items() if a >= least}
    for p, a in [*two.items(), *three.items()]:
        lang, *w = p
        if a < least:
            continue
        if len(w) == 2 and any(100 * b >= 50 * a and (q[1:3] == p[1:] or q[2:4] == p[1:]) and q[0] == lang for q, b in kept3.items()):
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = (lang, *w[:k]), (lang, *w[k:])
            le, ri = ((one, two)[len(x) - 2][x] for x in (left, right))
            cuts.append((a * a * 1_000_000 // (le * ri), k, le, ri))
        s, _, le, ri = min(cuts)
        out.append((lang, s, a, " ".join(w), le, ri))
    ranked = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[1], -o[2], o[3].encode()))[:most]
        ranked += [(lang, i + 1, o[3], o[2], o[4], o[5], total[lang], o[1]) for i, o in enumerate(own)]
    return sorted(ranked)


@pytest.fixture(scope="module")
def phrase_rows():
    rng = random.Random(3)
    vocabulary = ["The", "the", "cat", "sat", "ÄÖ", "äö", "x\x01y", "日本", "#", "a"]
    rows = [(None, "en"), ("", None), ("one", "de"), ("the the the the the the the the the the the the the", "fr"), ("a" * 5000, "en")]
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        rows.append((rng.choice(["", " ", "\t"]) + "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]) for w in words), rng.choice(["en", "en", None, "und", ""])))
    return rows


@pytest.mark.parametrize("segment", [collocations.SEGMENT, 300])
def test_collocations(spark, phrase_rows, segment):
    """Whole and in many small segments: cuts of the corpus, and of long texts, change nothing."""
    df = spark.createDataFrame([(t, g, 1, 2) for t, g in phrase_rows], "text string, lang string, pair int, segment int").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(df, 5, 20, segment=segment).collect())
    assert got == brute_phrases(phrase_rows, 5, 20)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, None, 0), (2, " . ", "en", "s", 3)], DOCS)).count() == 0


def test_scores_pass_64_bits(spark):
    from pyspark.sql import functions as F

    a, le, ri = 9_999_999_999_999, 10**13 + 3, 10**13 + 7
    got = spark.createDataFrame([(a, le, ri)], "a bigint, l bigint, r bigint").select(collocations.score(F.col("a"), F.col("l"), F.col("r"))).first()[0]
    assert got == a * a * 1_000_000 // (le * ri)


def brute_near(rows, k):
    own = {}
    for i, v in rows:
        if i is None or v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        if i not in own or list(v) < list(own[i]):
            own[i] = [float(x) for x in v]
    out = {}
    for q in own:
        if q % 50 == 0:
            a = np.array(own[q])
            scores = [(-float(np.clip(a @ np.array(v) / np.sqrt((a @ a) * (np.array(v) @ np.array(v))), -1, 1)), i) for i, v in own.items() if i != q and len(v) == len(a)]
            out[q] = sorted(scores)[:k]
    return out


def check_near(got, want, k, least=0.9):
    hit = total = 0
    for q, best in want.items():
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, len(best) + 1))
        assert all(a[2] >= b[2] for a, b in zip(mine, mine[1:], strict=False))
        hit += len({m[1] for m in mine} & {b[1] for b in best})
        total += len(best)
    assert {r.query_id for r in got} == {q for q, b in want.items() if b}
    assert hit >= least * total


def test_neighbours_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (50, None), (100, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, []), (150, [1.0, 2.0, 3.0]), (7, [1e-30, 1e-30]), (8, [-1.0, 0.0]), (0, [1.0, 0.0]), (9, [0.0, 5.0]), (9, [1.0, 1.0]), (200, [1.0, 0.0]), (10, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, class_id int")
    got = neighbours.nearest(df, df["vec_id"] % 50 == 0, 3).collect()
    want = brute_near(rows, 3)
    for q, best in want.items():
        assert sorted((r.rank, r.vec_id) for r in got if r.query_id == q) == [(n + 1, i) for n, (_, i) in enumerate(best)]
    assert {r.query_id for r in got} == {0, 200}
    assert neighbours.nearest(df.limit(0), df["vec_id"] % 50 == 0).count() == 0


def test_neighbours_recall(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((9000, 32)).astype(np.float32)
    base[3000:6000] = base[0] + 0.05 * rng.standard_normal((3000, 32))  # a hot group of near copies
    base[6000:7000] = base[1]  # and of equal rows
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), __import__("pyspark").sql.functions.expr("vec_id % 50 = 0")).collect()
    check_near(got, brute_near(rows, 5), 5)


def test_windows_pass_most_by():
    """At the last neighbour's distance few of the vectors reach the threshold, and nearly all of those within it do."""
    rng = np.random.default_rng(1)
    v = rng.standard_normal((4000, 64))
    lengths = np.sqrt((v * v).sum(1))
    directions = neighbours.projections(64)
    block = neighbours.Block(np.arange(4000), v, lengths, directions)
    verified, found = 0, 0
    for i in range(40):
        cosine = v @ v[i] / (lengths * lengths[i])
        fifth = np.sqrt(2 - 2 * np.sort(cosine)[-6])
        begin, end = block.windows((v[i] / lengths[i])[None] @ directions, np.array([[fifth]]))
        counts = np.bincount(np.concatenate([block.order[p, begin[0, 0, p] : end[0, 0, p]] for p in range(neighbours.PROJECTIONS)]), minlength=4000)
        assert all(counts[j] == (np.abs((v[j] / lengths[j] - v[i] / lengths[i]) @ directions) <= neighbours.WIDTH * fifth).sum() for j in range(0, 4000, 400))
        verified += (counts >= neighbours.THRESHOLD).sum()
        found += (counts[np.argsort(cosine)[-6:]] >= neighbours.THRESHOLD).sum()
    assert verified < 0.25 * 40 * 4000
    assert found > 0.95 * 40 * 6


def brute_audit(rows, labels):
    said = {}
    for i, q, t in labels:
        g, x = said.get(i, (False, False))
        said[i] = (g or q == 1, x or t == 1)
    docs, out = [], []
    for i, text, lang in rows:
        text = text or ""
        w = [x for x in re.split("[ \t-\r]+", text) if x]
        fails = "".join(c for c, f in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text),
            i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)), strict=True) if f)
        docs.append((lang or "", fails, *(said.get(i, (False, False)) if i is not None else (False, False))))
    for part in {d[0] for d in docs}:
        own, shapley, figures = [d for d in docs if d[0] == part], Counter(), []
        for order in permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                kept = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                figures.append((part, "".join(order), step + 1, len(kept), len(gone), sum(f in d[1] for d in own) - len(gone), sum(d[1] == f for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone), f))
                left = kept
        out += [(*x[:9], shapley[x[9]]) for x in figures]
    return sorted(out)


def test_filter_audit(spark):
    rng = random.Random(7)
    texts = [None, "", "A" * 50, "x # y", *("".join(rng.choice(["ab ", "cd ", "EF ", "g\n", "é ", "$"]) for _ in range(rng.choice([3, 150, 400]))) for _ in range(12)), " ".join(f"w{i}" for i in range(300)), " ".join(f"w{i} %" for i in range(300))]
    rows = [(rng.choice([None, *range(1, 40)]), rng.choice(texts), rng.choice(["en", "de", "", None])) for _ in range(90)]
    rows += rows[:5]  # repeated rows
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(1, 30), 3, 4, None]]
    df = spark.createDataFrame([(i, t, g, "s", 1, 2) for i, t, g in rows], "doc_id bigint, text string, lang string, source string, _first int, mask int")
    said = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = filter_audit.audit(df, said)
    assert sorted(tuple(r) for r in got.select(names).collect()) == brute_audit(rows, labels)
    assert filter_audit.audit(df.limit(0), said).count() == 0


def test_spectra_turn_back(spark):
    rng = random.Random(2)
    rows = [(i, "p", rng.randrange(32), rng.randrange(1, 4)) for i in range(200)]
    masks = spark.createDataFrame(rows, "doc_id bigint, part string, mask int, copies bigint")
    sums = filter_audit.spectra(masks, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    want = [sum(c for _, _, m, c in rows if m == k) for k in range(32)]
    assert sums.first()["sums"][0] == sum(want)
    assert filter_audit.cells(sums).first()["n"] == want
