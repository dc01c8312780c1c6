"""Proximity matches against brute force, with the rarest words replaced, moved or missing everywhere."""

from __future__ import annotations

import random

from lumaframe.llm import decontamination as d


def brute(doc, phrase):
    missing, slop = 3 * len(phrase) // 13, (4 * len(phrase) + 13) // 26
    for start in range(-len(phrase), len(doc) + 1):
        met = sum(any(0 <= start + j + e < len(doc) and doc[start + j + e] == w for e in range(-slop, slop + 1)) for j, w in enumerate(phrase))
        if met >= len(phrase) - missing:
            return True
    return False


def test_rarest_words_replaced(spark):
    rng = random.Random(6)
    common = [f"c{i}" for i in range(40)]
    items = {}
    for i, n in enumerate([13, 13, 14, 20, 30, 2, 4, 5, 8, 9, 12]):
        words = rng.choices(common, k=n)
        for j in range(0, n, 7):
            words[j] = f"rare{i}x{j}"
        items[i] = words
    docs = {0: items[0][1:], 1: ["other", *items[1][1:]], 2: [], 3: rng.choices(common, k=300)}
    for k in range(4, 70):
        words = list(items[k % len(items)])
        for _ in range(rng.randrange(5)):
            j = rng.randrange(len(words))
            words[j : j + 1] = rng.choice([[], ["other"], [words[j], "more"], ["more", "over", words[j]]])
            words = words or ["none"]
        docs[k] = rng.choices(common, k=rng.randrange(4)) + words + rng.choices(common, k=rng.randrange(4))
    want = {}
    for key, doc in docs.items():
        exact, near = set(), set()
        for item, words in items.items():
            for i in range(max(1, len(words) - d.WINDOW + 1)):
                phrase = words[i : i + d.WINDOW]
                if any(doc[a : a + len(phrase)] == phrase for a in range(len(doc))):
                    exact.add(str(item))
                if brute(doc, phrase):
                    near.add(str(item))
        want[key] = (sorted(exact), sorted(near - exact))
    assert want[0] == ([], ["0"]) and want[1] == ([], ["1"])
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id bigint, text string").coalesce(2)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id bigint, text string")
    assert {r.doc_id: (r["items"], r.near_items) for r in d.contamination(table, bench).collect()} == want
