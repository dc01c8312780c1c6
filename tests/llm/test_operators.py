"""The training-data operators against brute force, on small tables with every awkward case."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import compare

from lumaframe.llm import decontamination, language_model, license_scan, line_dedup, minhash, mixing, quality_rules, queries, suffix_dedup, token_files, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, start int, key string, n long"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def awkward():
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "délta", "eps", "zeta's", "eta.", "θ", "#tag", "<b>", "MIT", "License", "42"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", ",", "x", "y", str(rng.randrange(90))]) for _ in range(n))
    base = prose(150)
    near = base.split()
    near[20], near[100] = "changed", "altered"
    line = prose(30)
    texts = [
        base, base, " ".join(near), None, "", " \n\t ", "one", "two words", line, f"{prose(60)}\n{line}\n{prose(20)}", f"{line}\n{line}\n\n  \n{line}",
        "a b c " * 400, "same " * 3000, prose(4000), "Released under the MIT License.\nCC-BY cc by", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-3.0-only WITH Classpath-exception-2.0\ngnu general\npublic LICENSE",
        base.upper(), "x" * 99, "y" * 100, "z" * 250, "  double  spaces \x0b here\x1cthere  ", "日本語 テキスト é́ 😀 <|endoftext|>",
    ]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), 1, "k", 2) for i, t in enumerate(texts)]
    rows += [(0, base, "en", "s0", len(base), 1, "k", 2), (None, "a row without id " * 9, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    compare(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)


def brute_units(text, kind):
    """(words, first character, last character + 1) of each unit, by definition."""
    found = [(m.start(), m.end()) for m in WORD.finditer(low(text))]
    words = [low(text[a:b]) for a, b in found]
    if kind != "phrases":
        out, at = [], 0
        ends = [*re.finditer("\n" if kind == "lines" else "\n[\x20\x09-\x0D]*\n", text), None]
        for m in ends:
            stop = m.start() if m else len(text)
            own = [w for (a, _), w in zip(found, words, strict=True) if at <= a < stop]
            if len(own) >= line_dedup.MIN_WORDS:
                out.append((tuple(own), at, stop + (m is not None)))
            at = m.end() if m else stop
        return out
    g = [int(hashlib.md5(w.encode()).hexdigest()[:6], 16) for w in words]
    cuts = [i + 1 for i in range(len(g)) if i + 1 == len(g) or (g[i] + 7 * g[i + 1]) % line_dedup.CUT == 0]
    out = []
    for s in [0, *cuts[:-1]] if g else []:
        if e := next((c for c in cuts if c - s >= line_dedup.MIN_WORDS), None):
            out.append((tuple(words[s:e]), found[s][0], found[e][0] if e < len(g) else len(text)))
    return out


def brute_line_dedup(rows, kind):
    seen, want = {}, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        gone = np.zeros(len(text) + 1, bool)
        runs = []
        for words, a, b in brute_units(text, kind):
            if seen.setdefault(words, (doc, a)) != (doc, a):
                gone[a:b] = True
                runs.append((a, b))
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
        removed = sum(len(WORD.findall(low(text[a:b]))) for a, b in spans)
        want.append((doc is None, doc, len(WORD.findall(low(text))), removed, spans, "".join(c for c, g in zip(text, gone, strict=False) if not g)))
    return want


@pytest.mark.parametrize("kind", ["phrases", "lines", "paragraphs"])
def test_line_dedup(spark, docs, nothing, kind):
    units = {"phrases": None, "lines": line_dedup.pieces(line_dedup.LINE), "paragraphs": line_dedup.pieces(line_dedup.PARAGRAPH)}[kind]
    rng = random.Random(9)
    prose = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(500)}" for _ in range(n))
    passage, line, block = prose(60), prose(24), f"{prose(12)}\n{prose(15)}"
    wrapped = passage.replace(" ", "\n", 9).upper()
    more = [(100 + i, f"{prose(40)} {p} {prose(33)}\n{q}\n\n{block}\n \n{prose(9)}", *[None] * 6) for i, (p, q) in enumerate([(passage, line), (wrapped, line), (f"{passage} {passage}", prose(8)), (prose(60), f"{line}.")])]
    table = docs.unionByName(spark.createDataFrame(more, docs.schema))
    got = [(r.doc_id is None, r.doc_id, r.n_words, r.n_removed, [tuple(s) for s in r.spans], r.kept) for r in line_dedup.dedup(table, units=units).collect()]
    want = brute_line_dedup([(r[0], r[1] or "") for r in [*awkward(), *more]], kind)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    removed = {x[1]: x[3] for x in want}
    assert removed[1] > 0 and (removed[101] >= 50 if kind == "phrases" else removed[101] > 0)
    assert line_dedup.dedup(nothing, units=units).count() == 0


def test_suffix_dedup(docs, nothing):
    got = {(r.doc_id, r.n_bytes, tuple(tuple(s) for s in r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.dedup(docs).collect()}
    first, want = {}, set()
    rows = sorted({(r[0], r[1]) for r in awkward()}, key=lambda r: (r[0] is not None, r[0] or 0))
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if first.setdefault(raw[p : p + 100], (doc, p)) != (doc, p):
                gone[p : p + 100] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        spans = tuple(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
        want.add((doc, len(raw), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    assert got == want
    assert suffix_dedup.dedup(nothing).count() == 0


def test_language_model(spark, docs, nothing):
    for table in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = [(r.doc_id, (r.text or "").encode().lower().split() + [b"\n"]) for r in table.collect()]
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        counts = Counter(w for i, t in rows if not held(i) for w in t)
        n, v = sum(counts.values()), len(counts)
        want = sorted((i is None, i, held(i), len(t), sum(counts[w] > 0 for w in t), round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 5)) for i, t in rows)
        found = language_model.score_documents(table).collect()
        assert sorted((r.doc_id is None, r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in found) == want
        assert {r.train_tokens for r in found} == {n}
        assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    assert language_model.score_documents(nothing).count() == 0


def test_language_model_spreads_one(spark):
    """The model's probabilities of all words, known or not, add up to one; its gradient is that of its loss."""
    head = [("a", 50), ("\n", 20), ("b", 7), ("é", 3)] + [(f"w{i}", 2) for i in range(1500)]
    voc = language_model.Vocabulary(head, {0: (4, 6), 3: (1, 1)})
    model = language_model.Model(voc)
    rng = np.random.default_rng(1)
    model.p = {k: (x + rng.normal(0, 0.3, x.shape)).astype(np.float64) for k, x in model.p.items()}
    h = rng.normal(0, 1, (1, language_model.STATE))
    total = 0.0
    for w, n in head:
        i = np.array([voc.of(w)])
        total += 10 ** (model.log10(h, i)[0] + voc.shares(i, np.array([n]))[0])
    for kind in range(language_model.KINDS):
        words, tokens = voc.beyond.get(kind, (0, 0))
        i = np.array([(voc.own_classes + kind) * language_model.CLASS_WORDS])
        mass = voc.mass[voc.own_classes + kind]
        total += 10 ** model.log10(h, i)[0] * (tokens + 0.5 * words + 0.5) / mass
    spare = sum(10 ** model.log10(h, np.array([i]))[0] for i in range(language_model.FREQUENT) if i not in voc.number.values())
    empty = [k for k in range(voc.own_classes + language_model.KINDS, voc.classes) if voc.mass[k] == 0.5]
    spare += sum(10 ** model.log10(h, np.array([k * language_model.CLASS_WORDS]))[0] for k in empty)
    assert total + spare == pytest.approx(1.0, abs=1e-3)
    words, targets = rng.integers(0, 40, (2, 5)), rng.integers(0, 40, (2, 5))
    loss = lambda: model.loss_and_gradient(words, targets, np.ones((2, 5), bool), np.zeros((2, language_model.STATE)))
    _, grad, _ = loss()
    for k, at in (("U", (3, 4)), ("U", (2, 20)), ("E", (int(words[0, 0]), 1)), ("C", (2, 0)), ("b", (5,))):
        old = model.p[k][at]
        model.p[k][at] = old + 1e-3
        up = loss()[0]
        model.p[k][at] = old - 1e-3
        down = loss()[0]
        model.p[k][at] = old
        assert (up - down) / 2e-3 / 10 == pytest.approx(grad[k][at], rel=0.05, abs=2e-3)


def brute_segments(scores):
    """Ruzzo and Tompa by definition: the best segment (shortest, leftmost), then the same on both its sides."""
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a = -best[2]
    b = a - best[1]
    left, right = brute_segments(scores[:a]), brute_segments(scores[b:])
    return left + [(a, b, best[0])] + [(x + b, y + b, s) for x, y, s in right]


def test_segments():
    rng = np.random.default_rng(3)
    for _ in range(200):
        scores = rng.integers(-40, 40, rng.integers(0, 14)) + rng.random(1) * 1e-3
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(scores)]
        assert got == [(a, b, round(s, 6)) for a, b, s in brute_segments(scores.tolist())]


def test_evidence_of_several_segments():
    scores = toxicity.Scores({}, {}, rate=0.8, scale=0.05)
    one = scores.evidence([20.0], 400)
    assert one == pytest.approx(-math.log(scores.expected(20.0, 400)))
    assert scores.evidence([20.0, 1.0], 400) == one  # a segment that chance explains adds nothing
    two = 2 * one
    assert scores.evidence([20.0, 20.0], 400) == pytest.approx(two - math.log(two) + math.log(2))
    assert scores.evidence([], 400) == -20.0 and scores.evidence([1e6] * 50, 1) == 60.0


def test_toxicity(spark, docs, nothing):
    labels = spark.createDataFrame([(i, 1, int(i in (0, 2))) for i in range(15)] + [(None, 1, 1), (900, 0, None)], "doc_id bigint, quality int, toxic int")
    found = toxicity.score_documents(docs, labels).collect()
    assert len(found) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert toxicity.score_documents(nothing, labels).count() == 0
    assert toxicity.score_documents(docs, labels.limit(0)).count() == docs.count()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    found = toxicity.score_documents(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))).where("held_out").toPandas()
    both = found.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    caught = both[both.toxic == 1].predicted.mean()
    assert caught > 0.8 and both[both.toxic == 0].predicted.mean() < 0.05


def test_mixing(docs, nothing):
    rows = [r.asDict() for r in mixing.mix(docs).collect()]
    again = [r.asDict() for r in mixing.mix(docs.repartition(2)).collect()]
    order = lambda x: sorted(x, key=repr)
    assert order(rows) == order(again)
    source = {}
    for r in awkward():
        source.setdefault(r[3], []).append((r[0], len(SPACED.findall(r[1] or ""))))
    names = sorted((s for s in source if s is not None)) + [None]
    size = {s: sum(n for _, n in source[s]) for s in names}
    weight = dict(zip(names, itertools.cycle((5, 2, 1))))
    target, free, left = {}, set(names), 1.5 * sum(size.values())
    while True:
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
        free -= set(over)
        left = 1.5 * sum(size.values()) - sum(target.values())
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    assert sorted((r["source_size"], round(r["target"], 6)) for r in rows) == sorted((size[s], round(target[s], 6)) for s in names for _ in source[s])
    for s in names:
        taken = sum(r["taken"] for r in rows if (r["source_size"], round(r["target"], 6)) == (size[s], round(target[s], 6)))
        assert taken <= 2 * size[s]
    assert all(r["size"] == 0 and r["taken"] == 0 or r["taken"] % r["size"] == 0 and r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix(nothing).count() == 0
    kept = mixing.apply_mix(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["taken"] // r["size"] for r in rows if r["size"])


def test_fit_is_best():
    rng = np.random.default_rng(2)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 60, 6))
        counts = rng.integers(1, 5, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 1))
        take = mixing.fit(lengths, counts, budget, 1)
        assert (take >= 0).all() and (take <= counts).all()
        sums = {sum(x) for x in itertools.product(*[[n * k for k in range(c + 1)] for n, c in zip(lengths.tolist(), counts.tolist(), strict=True)])}
        best = max(s for s in sums if s <= budget)
        assert best - int((take * lengths).sum()) <= lengths.max()


def test_decontamination(spark, docs, nothing):
    text = {r[0]: r[1] for r in awkward()}
    long = text[13].split()
    bench = [(1, " ".join(long[50:90])), (2, "two WORDS"), (3, ""), (4, None), (5, " ".join(long[300:312])), (12, " ".join(long[70:95])), (6, "no such words in any document at all here " * 3), (1, " ".join(long[50:90]))]
    table = spark.createDataFrame(bench, "item_id bigint, text string")
    windows = {}
    for item, body in bench:
        w = WORD.findall(low(body))
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    want = []
    for doc, body in ((r[0], r[1]) for r in awkward()):
        w, hit, items = WORD.findall(low(body)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    items |= owners
        want.append((doc is None, doc, len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w)))
    for block in (10**6, 40):
        found = decontamination.contamination(docs, table, block_words=block)
        assert sorted((r.doc_id is None, r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in found.collect()) == sorted(want)
    assert decontamination.contamination(nothing, table).count() == 0
    assert decontamination.contamination(docs, table.limit(0)).where("n_hit > 0").count() == 0
    dirty = {x[1] for x in want if x[5]}
    kept = decontamination.filter_documents(docs, table)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in awkward()} - dirty


def test_decontamination_ids_and_scripts(spark):
    docs = spark.createDataFrame([(-1, "one two three"), (None, "one two"), (5, "日本語 の 文")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "one two"), (2, "日本語 の " * 40)], "item_id bigint, text string")
    found = decontamination.contamination(docs, bench).collect()
    assert sorted(((r.doc_id, r.n_hit) for r in found), key=repr) == [(-1, 2), (5, 0), (None, 2)]
    assert decontamination.list_blocks(bench, 20) >= 4


def test_proximity(spark):
    words = [f"w{i}" for i in range(13)]
    moved = words[:4] + ["other"] + words[4:]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(moved)), (3, " ".join(words[::-1]))], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id bigint, text string")
    found = {r.doc_id: (r["items"], r.near_items) for r in decontamination.contamination(docs, bench).collect()}
    assert found == {1: (["7"], []), 2: ([], ["7"]), 3: ([], [])}


def test_license_scan(docs, nothing):
    rows = license_scan.scan(docs, ways=True).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = next(x[1] for x in awkward() if x[0] == r.doc_id)
        w = WORD.findall(low(text))
        places = sorted((i, label) for phrase, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None)
        assert r.base_labels == sorted({label for _, label in places}) and set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    tagged = next(r for r in rows if r.doc_id == 15)
    assert sorted(map(tuple, tagged.choices)) == [("apache", "gpl"), ("gpl", "mit")]
    assert license_scan.scan(nothing).count() == 0


def test_license_expressions():
    assert license_scan.postfix("MIT OR Apache-2.0 AND BSD-3-Clause") == ["MIT", "Apache-2.0", "BSD-3-Clause", "and", "or"]
    assert license_scan.postfix("(MIT or GPL-2.0+) and ISC trailing words") == ["MIT", "GPL-2.0+", "or", "ISC", "and"]
    assert license_scan.postfix("and MIT") == [] and license_scan.postfix("") == []
    assert license_scan.choices(license_scan.postfix("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT")) == [frozenset({"gpl"}), frozenset({"mit"})]


def shingle_set(text, doc):
    w = WORD.findall(low(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset([("alone", doc, text)])


def brute_classes(rows):
    sets = {}
    for doc, text in rows:
        sets.setdefault(doc, shingle_set(text, doc))
    owner = {d: d for d in sets}

    def top(d):
        while owner[d] != d:
            d = owner[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            owner[y] = x
    return {d: top(d) for d in sets}


def test_minhash(spark, docs, nothing):
    rows = [(r[0], r[1]) for r in awkward() if r[0] is not None]
    want = brute_classes(rows)
    found = minhash.classes(docs).collect()
    assert len(found) == docs.count()
    assert {r.doc_id: r.class_id for r in found if r.doc_id is not None} == want
    assert minhash.classes(nothing).count() == 0
    kept = minhash.filter_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))


def test_minhash_large_groups(spark):
    """Chains, stars and unlinked members of one bucket: the components are those of all pairs."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(150):
        own = list(base)
        for j in rng.sample(range(100), rng.choice([0, 1, 2, 3, 4, 6])):
            own[j] = f"e{i}-{j}".replace("-", "x")
        rows.append((i, " ".join(own)))
    chain = list(base[::-1])
    for i in range(150, 190):
        chain[(3 * i) % 100] = f"c{i}"
        rows.append((i, " ".join(chain)))
    found = minhash.classes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.doc_id: r.class_id for r in found.collect()} == brute_classes(rows)


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    element = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    a, b = rng.integers(0, 5, 60), rng.integers(0, 5, 60)
    darts = minhash.Darts(2048)
    sign = darts.signatures(np.concatenate([element, element]), np.repeat([0, 1], 60), 2, np.concatenate([a, b]))
    assert (sign[0] == sign[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.05)


@pytest.mark.parametrize("weak", [False, True])
def test_quality_rules(docs, nothing, weak, monkeypatch):
    if weak:  # many windows of different words share a hash
        monkeypatch.setattr(quality_rules, "window_hash", lambda a, b, c: quality_rules.F.shiftleft(quality_rules.F.length(a).cast("long"), 60))
    rows = quality_rules.host_quality(docs).collect()
    assert len(rows) == docs.count()
    want = Counter()
    for r in awkward():
        text = r[1] or ""
        w = SPACED.findall(text)
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[(r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert not any(r.kept and r.base_failed for r in rows)
    assert quality_rules.host_quality(nothing).count() == 0
    assert quality_rules.filter_documents(docs).columns == docs.columns


def test_bad_host_goes(spark):
    rows = [(i, "w " * 10 if i % 10 else " ".join(f"w{j}" for j in range(60)), "bad") for i in range(200)] + [(i, " ".join(f"w{j}" for j in range(60)), "good") for i in range(200, 400)]
    kept = quality_rules.host_quality(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).where("kept")
    assert {r.doc_id for r in kept.collect()} == set(range(200, 400))


def test_token_files(spark, docs, nothing, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    want, at = [], 0
    marked = [(200 + i, t, *[None] * 6) for i, t in enumerate(["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y z  end", "a <|endoftext| > b"])]
    assert tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    docs = docs.unionByName(spark.createDataFrame(marked, docs.schema))
    rows = sorted([*awkward(), *marked], key=lambda r: (r[0] is not None, r[0] or 0))
    for r in rows:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    key = lambda r: (r[1], r[0] is None, r[0])
    found = token_files.round_trip(docs, path, str(tmp_path / "tokens"))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)
    assert token_files.round_trip(nothing, path, str(tmp_path / "none")).count() == 0


def test_other_tokenizers_encode_whole_texts(spark, docs, tmp_path):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    vocab = {w: i for i, w in enumerate(["?", "end", "alpha", "beta", "one", "two", "words", "same"])}
    tokenizer = Tokenizer(models.WordLevel(vocab, unk_token="?"))
    tokenizer.normalizer, tokenizer.pre_tokenizer = normalizers.Lowercase(), pre_tokenizers.Whitespace()
    tokenizer.save(str(tmp_path / "words.json"))
    token_files.write_tokens(docs, str(tmp_path / "out"), str(tmp_path / "words.json"), end_id=1)
    want = sorted(((r[0] is None, r[0], len(ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes())) for r in awkward() for ids in [tokenizer.encode(r[1] or "").ids]), key=repr)
    found = token_files.read_tokens(spark, str(tmp_path / "out")).collect()
    assert sorted(((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_crc32) for r in found), key=repr) == want


def test_variable_length_code():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (2 ** rng.uniform(0, 32, n)).astype(np.uint32)
        control, data = token_files.encode_ranks(ranks)
        assert len(control) == -(-n // 4)
        assert (token_files.decode_ranks(control, data, n) == ranks).all()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, last = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, last, SF).cache()
        assert out.columns == columns, name
        assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in last.select("doc_id").collect()}
        last = out
    result = corpus_pipeline.run(spark, SF)
    assert Counter(r.doc_id for r in result.collect()) == Counter(r.doc_id for r in last.select("doc_id").collect())
