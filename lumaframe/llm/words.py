"""Texts as arrays of word numbers, batch by batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lumaframe.llm.common import WORD_TABLE, text_bytes

_PLAIN = np.frombuffer(WORD_TABLE, np.uint8)
#: Lower-cases A-Z; white space (0x09 to 0x0D) becomes a space, and nothing else is changed.
_SPACED = np.array([c + 32 if 0x41 <= c <= 0x5A else 0x20 if 0x09 <= c <= 0x0D else c for c in range(256)], np.uint8)


def numbered(column: pa.Array, plain: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the number of each word of the texts in order, first word by text with the total at the end).

    ``plain``: words are runs of ASCII letters, digits and non-ASCII characters; else runs of
    anything but ASCII white space. A-Z are lower-cased in both. Null texts have no words.
    """
    raw, starts = text_bytes(column)
    text = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer((_PLAIN if plain else _SPACED)[raw].tobytes()))
    lists = pc.split_pattern(text, " ")
    ends = np.asarray(lists.offsets, np.int64)
    coded = lists.flatten().dictionary_encode()
    number = np.asarray(coded.indices, np.int64)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty < 0:
        return coded.dictionary, number, ends - ends[0]
    real = number != empty
    upto = np.concatenate([[0], np.cumsum(real)])
    return coded.dictionary, number[real], upto[ends - ends[0]]


def bounds(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes in lower case with spaces between words, begin and end of each plain word, first word by text with the total at the end).

    ``raw`` holds the texts end to end, ``starts`` their offsets with the length at the end.
    """
    plain = _PLAIN[raw]
    word = np.zeros(len(raw) + 2, bool)
    word[1:-1] = plain != 0x20
    edge = np.zeros(len(raw) + 1, bool)  # a text begins here
    edge[starts] = True
    begin = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1]))
    end = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1
    return plain, begin, end, np.searchsorted(begin, starts)
