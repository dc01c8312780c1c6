"""Licence expressions with many ways to meet them."""

from __future__ import annotations

import itertools

from lumaframe.llm import license_scan


def test_no_way_is_left_out(spark):
    pairs = [("apache-2.0", "zlib")] + [(f"a{i}", f"b{i}") for i in range(6)]
    text = "SPDX-License-Identifier: " + " AND ".join(f"({a} OR {b})" for a, b in pairs)
    many = "SPDX-License-Identifier: " + " AND ".join(f"(x{i} OR y{i} WITH except-{i})" for i in range(40))
    names = [("apache", "zlib"), *pairs[1:]]
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = license_scan.scan(docs, ways=True).first()
    assert row.labels == sorted(itertools.chain(*names))
    assert sorted(row.choices) == sorted(sorted(x) for x in itertools.product(*names))
    row = license_scan.scan(spark.createDataFrame([(1, many)], "doc_id bigint, text string")).first()
    assert row.labels == sorted(f"{k}{i}" for k in "xy" for i in range(40)) and row.choices is None


def shorter_and_shorter(text):
    """The longest beginning that is an expression, by trying every beginning with a recursive reader."""
    tokens, at = [], 0
    while m := license_scan._TOKEN.match(text, at):
        tokens.append(m[1])
        at = m.end()

    def read(own, rank=1):
        if rank == 4:
            if own and own[0] == "(":
                order, rest = read(own[1:])
                return (order, rest[1:]) if order and rest and rest[0] == ")" else (None, own)
            return ([own[0]], own[1:]) if own and own[0] not in "()" and own[0].lower() not in license_scan._RANK else (None, own)
        order, rest = read(own, rank + 1)
        while order and rest and license_scan._RANK.get(rest[0].lower()) == rank:
            right, rest_ = read(rest[1:], rank + 1)
            if right is None:
                return None, own
            order, rest = [*order, *right, rest[0].lower()], rest_
        return order, rest

    for n in range(len(tokens), 0, -1):
        order, rest = read(tokens[:n])
        if order and not rest:
            return order
    return []


def test_longest_beginning():
    import random

    rng = random.Random(3)
    for _ in range(3000):
        text = " ".join(rng.choice(["MIT", "GPL-2.0", "and", "OR", "with", "(", ")", "isc", "zlib"]) for _ in range(rng.randrange(12)))
        assert license_scan.postfix(text) == shorter_and_shorter(text), text
    long = "(" * 20000 + "MIT and " * 20000
    assert license_scan.postfix(long) == []


def test_expressions_are_evaluated():
    """Against all truth assignments: what meets an expression, and what it can't be met without."""
    import random

    names = ["mit", "isc", "zlib", "apache-2.0", "gpl-3.0"]
    families = [license_scan.family(n) for n in names]
    rng = random.Random(9)

    def grow(depth):
        if depth == 0 or rng.random() < 0.2:
            name = rng.choice(names)
            return (name + rng.choice(["", "", " WITH some-exception"]), lambda on, f=license_scan.family(name): f in on)
        (a, f), (b, g), word = grow(depth - 1), grow(depth - 1), rng.choice(["AND", "OR"])
        return f"({a}) {word} ({b})", (lambda on: f(on) and g(on)) if word == "AND" else (lambda on: f(on) or g(on))

    for _ in range(400):
        text, truth = grow(3)
        order = license_scan.postfix(text)
        for k in range(1 << 5):
            on = {f for i, f in enumerate(families) if k >> i & 1}
            assert license_scan.met(order, on) == truth(on), (text, on)
        assert license_scan.needed(order) == {f for f in families if not truth(set(families) - {f})}, text
    assert not license_scan.met([], families) and license_scan.needed([]) == set()


def test_and_differs_from_or(spark):
    texts = ["SPDX-License-Identifier: MIT AND GPL-3.0-only.", "SPDX-License-Identifier: MIT OR GPL-3.0-only.", "SPDX-License-Identifier: MIT.", "no tag", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.labels, r.needed, r.permitted) for r in license_scan.scan(docs).collect()}
    assert got == {0: (["gpl", "mit"], ["gpl", "mit"], False), 1: (["gpl", "mit"], [], True), 2: (["mit"], ["mit"], True), 3: ([], [], None), 4: ([], [], None)}
