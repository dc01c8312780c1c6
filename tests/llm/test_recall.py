"""Near-duplicate classes: every row whose id is divisible by 50, against all rows."""

from __future__ import annotations

import re

from lumaframe.llm import minhash
from lumaframe.llm.common import table


def shingles(text: str) -> frozenset:
    words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def test_recall_of_pairs(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = {r.doc_id: shingles(r.text) for r in docs.select("doc_id", "text").collect()}
    # half the ids are queries, so that some have near copies at this small size
    pairs = [(q, d) for q, a in rows.items() if q % 2 == 0 or q % 50 == 0 for d, b in rows.items() if d != q and a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)]
    of = {r.doc_id: r.class_id for r in minhash.classes(docs).collect()}
    assert len(pairs) > 40
    assert sum(of[q] == of[d] for q, d in pairs) >= 0.9 * len(pairs)
