"""Pieces of texts that are encoded alone: ids are those of whole texts, and a word is encoded once whatever stands around it."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lumaframe.llm import queries, token_files


@pytest.fixture
def encoder() -> token_files.Encoder:
    return token_files.Encoder(queries.tokenizer_path())


def same_as_whole(encoder: token_files.Encoder, texts: list[str]) -> None:
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    found = encoder.documents(pa.array(texts, pa.large_string()))
    for text, ids, whole in zip(texts, found, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == whole.ids, repr(text)


class Counted:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, inner: Tokenizer) -> None:
        self.inner, self.characters = inner, 0

    def __getattr__(self, name: str):
        return getattr(self.inner, name)

    def encode_batch_fast(self, texts: list[str], **options):
        self.characters += sum(map(len, texts))
        return self.inner.encode_batch_fast(texts, **options)


def test_a_word_is_encoded_once_whatever_stands_around_it(encoder):
    small, large = [f"{a}{b}ra" for a in "bcdfgk" for b in "aeiouü"], [f"{a}{b}ne" for a in "LMNPRS" for b in "aeiouö"]
    texts = [f"{a} {b}.\n{c} — {a}, „{b}“!" for a in small for b, c in zip(small, large[::-1], strict=True)] + [f"{a}?\n{b}" for a in large for b in large]
    encoder.tokenizer, encoder.words = Counted(encoder.tokenizer), Counted(encoder.words)
    same_as_whole(encoder, texts)
    assert encoder.tokenizer.characters + encoder.words.characters < 10 * sum(map(len, small + large))  # of 30 times as many in the texts
    before = encoder.tokenizer.characters + encoder.words.characters
    same_as_whole(encoder, texts)
    assert encoder.tokenizer.characters + encoder.words.characters == before


def test_pieces_have_the_ids_of_whole_texts(encoder, monkeypatch):
    same_as_whole(encoder, [])
    same_as_whole(encoder, ["", ""])
    same_as_whole(encoder, ["a ", " b", "c  ", "", "d\n", "e", "\n", "\n\n", ".", " ", "x"])
    letters = [chr(c) for c in (*range(0x80, 0x590), *range(0x1680, 0x1690), *range(0x2000, 0x2070), *range(0x3000, 0x3010), 0x180E, 0xFEFF)]
    same_as_whole(encoder, [f"a {c}b{c}.x {c}, {c}\nA\n{c}\n\n{c}\n b  {c}" for c in letters])
    rng = random.Random(1)
    some = [*" \n  \n\t\r\x0b.,'\"-!a bZ9s0té×÷ßÖäöñЯж中あ한\x85\xa0  　—“…«»﻿​́²Ⅷªạक😀", "'s", "'ll", " the", " word", "<|endoftext|>"]
    monkeypatch.setattr(token_files, "MEMO_PIECES", 300, raising=False)
    monkeypatch.setattr(token_files, "KEPT_PIECES", 100, raising=False)
    for _ in range(6):
        same_as_whole(encoder, ["".join(rng.choices(some, k=rng.randrange(40))) for _ in range(1000)])
