"""Licence scans: Aho-Corasick over words for identifier tags and notice phrases, shunting-yard for licence expressions."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.common import WORD_TABLE, column_bytes

#: The contract's phrases (fixed values).
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases, as their licences word them, and what they stand for.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: Families of licence identifiers by their beginnings; the longest that fits counts.
FAMILIES = ["agpl", "apache", "bsd", "cc-by", "cc-by-nc", "cc-by-nd", "cc-by-sa", "cc0", "epl", "gpl", "isc", "lgpl", "mit", "mpl", "unlicense"]
#: Families that ask for little more than their notice to be kept.
PERMISSIVE = ("apache", "bsd", "cc0", "isc", "mit", "unlicense", "zlib")
#: How sure one finding of each kind makes us.
SURE = {"tag": 0.9, "base": 0.8, "notice": 0.6}

_EXPRESSION = re.compile(rb"spdx-license-identifier[ \t]*:[ \t]*([^\n\r]*)", re.IGNORECASE)
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9.+:-]+)")
_RANK = {"with": 3, "and": 2, "or": 1}


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, phrases in (("notice", NOTICES), ("base", BASE), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            out.add_word(f" {phrase} ", (kind, label, phrase.count(" ") + 1, len(phrase) + 2))
    out.make_automaton()
    return out


def family(identifier: str) -> str:
    name = identifier.lower().rstrip("+.:")  # a sentence's end is no part of it
    fits = [f for f in FAMILIES if name == f or name.startswith(f + "-")]
    return max(fits, key=len) if fits else name


def postfix(text: str) -> list[str]:
    """The longest beginning of ``text`` that is a licence expression, in postfix order (shunting-yard).

    One pass: wherever an operand or a bracket has closed everything that was open, the beginning so
    far is an expression, and its order is what was put out plus the operators still held.
    """
    out: list[str] = []
    held: list[str] = []
    best: tuple[int, list[str]] = (0, [])  # operands and operators put out by then, operators held then
    operand, brackets, at = True, 0, 0  # an operand or an opening bracket comes next
    while m := _TOKEN.match(text, at):
        token, word, at = m[1], m[1].lower(), m.end()
        if (word in _RANK or token == ")") == operand or (token == ")" and not brackets):
            break
        if word in _RANK:
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[word]:
                out.append(held.pop())
            held.append(word)
            operand = True
        elif token == "(":
            held.append(token)
            brackets += 1
        elif token == ")":
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            brackets -= 1
        else:
            out.append(token)
            operand = False
        if not operand and not brackets:
            best = (len(out), held[::-1])  # at most one operator of each rank is held here
    return out[: best[0]] + best[1]


def choices(order: list[str]) -> list[frozenset[str]]:
    """All ways in which an expression can be met: each a set of licences that all hold. n clauses may make 2**n of them."""
    stack: list[list[frozenset[str]]] = []
    for token in order:
        if token == "with":
            stack.pop()  # an exception leaves its licence's family as it is
        elif token == "and":
            right, left = stack.pop(), stack.pop()
            stack.append(sorted({a | b for a in left for b in right}, key=sorted))
        elif token == "or":
            right, left = stack.pop(), stack.pop()
            stack.append(sorted({*left, *right}, key=sorted))
        else:
            stack.append([frozenset([family(token)])])
    return stack[-1] if stack else []


def operands(order: list[str]) -> set[str]:
    """The licences that an expression in postfix order names, without exceptions."""
    stack: list[set[str]] = []
    for token in order:
        if token == "with":
            stack.pop()
        elif token in ("and", "or"):
            right = stack.pop()
            stack[-1] |= right
        else:
            stack.append({family(token)})
    return stack[-1] if stack else set()


def met(order: list[str], allowed: Collection[str]) -> bool:
    """Whether licences of the families allowed are enough for an expression in postfix order."""
    stack: list[bool] = []
    for token in order:
        if token == "with":
            stack.pop()
        elif token in ("and", "or"):
            right = stack.pop()
            stack[-1] = stack[-1] and right if token == "and" else stack[-1] or right
        else:
            stack.append(family(token) in allowed)
    return bool(stack) and stack[-1]


def needed(order: list[str]) -> set[str]:
    """The licences without which an expression can't be met, whatever else holds: of a choice those that both sides need."""
    stack: list[set[str]] = []
    for token in order:
        if token == "with":
            stack.pop()
        elif token in ("and", "or"):
            right = stack.pop()
            stack[-1] = stack[-1] | right if token == "and" else stack[-1] & right
        else:
            stack.append({family(token)})
    return stack[-1] if stack else set()


SCAN = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, labels array<string>, "
    "findings array<struct<kind:string,label:string,word:bigint>>, expressions array<string>, needed array<string>, permitted boolean, choices array<array<string>>, score double"
)


def scan(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", ways: bool = False, allowed: Collection[str] = PERMISSIVE) -> DataFrame:
    """One row per document with every finding, its labels, and the licence expressions behind its tags.

    Words are compared, so punctuation and case don't matter and a phrase may run over line ends.
    Null text: no words, no labels. Rows that share a doc_id, and null doc_ids, each have their own
    row. Labels have all licences that the expressions name. ``needed`` has those that every way to meet an expression
    takes, and ``permitted`` says whether licences of the families ``allowed`` meet all expressions; it is null where there
    are none. Both take one pass over an expression. ``choices`` has all ways, however many, and is null unless ``ways`` is set.
    Other columns are not read; a text of any length is searched in one pass. An empty table gives no rows. Nothing is shuffled.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        kind = pa.schema(
            [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string()))]
            + [("findings", pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("word", pa.int64())]))), ("expressions", pa.list_(pa.string())), ("needed", pa.list_(pa.string())), ("permitted", pa.bool_()), ("choices", pa.list_(pa.list_(pa.string()))), ("score", pa.float64())]
        )
        for b in batches:
            rows = []
            for key, body in zip(b.column(0).to_pylist(), column_bytes(b.column(1)), strict=True):
                words = body.translate(WORD_TABLE).split()
                line = " " + b" ".join(words).decode("latin-1") + " "
                findings, n_words, last, at = [], len(words), 0, 0
                for end, (what, label, _, length) in machine.iter(line):
                    start = end - length + 1
                    if start < at:
                        last, at = 0, 0
                    last, at = last + line.count(" ", at, start), start
                    findings.append({"kind": what, "label": label, "word": last})
                findings.sort(key=lambda f: (f["word"], f["kind"], f["label"]))
                base = [f for f in findings if f["kind"] == "base"]
                expressions = [m[1].decode("utf-8", "replace").strip() for m in _EXPRESSION.finditer(body)] if any(f["kind"] == "tag" for f in findings) else []
                orders = [postfix(x) for x in expressions]
                labels = {f["label"] for f in findings if f["label"]} | {x for o in orders for x in operands(o)}
                doubt = 1.0
                for f in findings:
                    doubt *= 1 - (SURE[f["kind"]] if f["kind"] != "tag" or any(orders) else 0.0)
                starts = [f["word"] for f in base]
                rows.append(
                    {
                        "doc_id": key,
                        "n_words": n_words,
                        "n_base": len(base),
                        "first_word": min(starts, default=None),
                        "last_word": max(starts, default=None),
                        "base_labels": sorted({f["label"] for f in base}),
                        "labels": sorted(labels),
                        "findings": findings,
                        "expressions": expressions,
                        "needed": sorted({x for o in orders for x in needed(o)}),
                        "permitted": all(met(o, allowed) for o in orders if o) if any(orders) else None,
                        "choices": [sorted(c) for o in orders for c in choices(o)] if ways else None,
                        "score": 1 - doubt,
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return documents.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(look, SCAN)
