"""Token-id output: frequency-ranked ids in a byte-aligned variable-length code.

The file format is a Parquet folder of blocks. A block holds whole documents in ascending doc_id
order: their ids (ranks, the most frequent token being 0) as little-endian bytes, one to four each,
in ``data``, and two bits per id with its length less one, four ids to a byte, in ``control``.
``<path>/ranks`` maps ranks to token ids. Decoding looks the control bytes up in a table of 256 rows.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import itertools
import json
import os
import re
import threading
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumaframe.llm.common import shared_path, spread, text_bytes

#: Ids of a block; a longer document is a block of its own.
BLOCK_TOKENS = 1 << 20
#: Texts are encoded in groups of about so many bytes.
GROUP_BYTES = 14_000_000
#: A worker remembers the ids of so many pieces, or so many bytes of them; beyond that it keeps the KEPT_PIECES that it met last, of LONGEST_KEPT bytes at most.
MEMO_PIECES = 1_000_000
MEMO_BYTES = 48_000_000
KEPT_PIECES = 600_000
LONGEST_KEPT = 64
#: Bytes of words that go to the tokenizer's model as one text.
CALL_BYTES = 20_000
#: A worker process without a task forgets its tokenizer and memo after so long.
IDLE_SECONDS = 3.0
END_ID = 2

BLOCKS = "part int, block int, doc_ids array<bigint>, id_null array<boolean>, n_tokens array<int>, before bigint, total bigint, control binary, data binary"

#: Lengths of the four ids that a control byte describes.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.uint8)

#: Staged bytes for each task that writes blocks, at most about.
PART_BYTES = 256_000_000

#: Letters of two bytes that every version of Unicode has as letters: Latin and Cyrillic.
_LETTERS = "À-ÖØ-öø-ɏЀ-ѿ"
#: Pieces that are one word to the tokenizer's pattern.
_PLAIN = f"^ [A-Za-z{_LETTERS}]+$"

#: Kinds of byte pairs, by first + 256 * second: a cut before the first, one before the second, and either if what stands beside the pair allows it.
BEFORE, BETWEEN, PERHAPS_BEFORE, PERHAPS_BETWEEN = 1, 2, 3, 4


def pair_kinds() -> np.ndarray:
    visible, signs = range(0x21, 0x7F), [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]
    out = np.zeros((256, 256), np.uint8)  # by second, then first
    out[visible, 0x20] = BEFORE
    out[0x80:, 0x20] = PERHAPS_BEFORE
    out[0x0A, visible] = BETWEEN
    out[np.ix_(signs, [c for c in visible if c not in signs])] = BETWEEN
    out[[0x0A, *signs], 0x80:] = PERHAPS_BETWEEN
    return out.reshape(-1)


def two_bytes(known: Callable[[str], bool]) -> np.ndarray:
    """For first + 256 * second: whether these bytes begin a character of the first 65,536, and ``known`` holds for all characters that they begin."""
    out, bad = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
    for c in (*range(0x80, 0xD800), *range(0xE000, 0x10000)):
        raw = chr(c).encode()
        (out if known(chr(c)) else bad)[raw[0] + 256 * raw[1]] = True
    return out & ~bad


PAIR_KINDS = pair_kinds()
#: What begins with these bytes is no white space, and no format or control character either.
SOLID = two_bytes(lambda c: unicodedata.category(c)[0] in "LMNPS")
LETTER = two_bytes(lambda c: re.match(f"[{_LETTERS}]", c) is not None)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of an array of unsigned 32-bit integers."""
    ranks = ranks.astype("<u4", copy=False)
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    padded[: len(code)] = code
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= code[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n integers that ``encode_ranks`` wrote."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[starts].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for j in (1, 2, 3):
        longer = np.flatnonzero(lengths > j)
        out[longer] |= raw[starts[longer] + j].astype(np.uint32) << np.uint32(8 * j)
    return out


def byte_letters() -> np.ndarray:
    """The visible character that stands for each byte in byte-level BPE vocabularies: its own, or the next free one from 256."""
    out, free = np.zeros(256, "<u4"), 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[b] = b
        else:
            out[b], free = free, free + 1
    return out


def cuttable(description: dict, added: list[str]) -> bool:
    """Whether texts may be cut before spaces: byte-level BPE with its usual pattern, as the tokenizer's JSON says, and no added token with a space."""
    model, first = description["model"], description.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    usual = first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True)
    return plain and usual and not any(description.get(k) for k in ("normalizer", "truncation", "padding")) and not any(" " in t for t in added)


def vocabulary_size(tokenizer) -> int:
    return max(tokenizer.get_vocab().values(), default=-1) + 1


def cuts(raw: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where pieces of texts start that a byte-level BPE tokenizer encodes one by one as it encodes the text.

    ``raw`` are the texts' bytes, ``ends`` their n + 1 offsets, ``whole`` says which texts stay in one piece.
    The tokenizer's pattern always ends a match at these places, and what it matches before them does not change
    if the text ends there: before a space that no white space follows; between a letter or digit and an ASCII
    sign; before a line feed that no white space precedes; and after it, if it is alone. A piece that can't be cut is only longer.
    """
    n = len(raw)
    starts = ends[:-1][np.diff(ends) > 0]
    if not n:
        return starts
    kinds = np.empty(n - 1, np.uint8)
    for odd in (0, 1):
        kinds[odd::2] = PAIR_KINDS[raw[odd : odd + (n - odd) // 2 * 2].view("<u2")]
    kinds[starts[1:] - 1] = 0  # one byte of a text, one of the next
    at = np.flatnonzero(kinds)
    kind = kinds[at]
    asked = np.flatnonzero(kind == PERHAPS_BEFORE)
    one, two, three = (raw.take(at[asked] + j, mode="clip") for j in (1, 2, 3))
    dash = (one == 0xE2) & (two == 0x80) & (three >= 0x90) & (three <= 0xA7)  # dashes, quotes, dots: spaces begin with the same two bytes
    kind[asked] = np.where(SOLID[one + two.astype(np.uint16) * np.uint16(256)] | dash, BEFORE, 0)
    asked = np.flatnonzero(kind == PERHAPS_BETWEEN)
    kind[asked] = np.where(LETTER[raw[at[asked] - 1] + raw[at[asked]].astype(np.uint16) * np.uint16(256)], BETWEEN, 0)
    at, kind = at[kind > 0], kind[kind > 0]
    at += kind == BETWEEN
    after = at[raw[at] == 0x0A] + 1
    after = after[after < n]
    after = after[(raw[after] > 0x20) & (raw[after] < 0x7F)]
    if whole.any():
        at, after = (x[~whole[np.searchsorted(ends[1:], x, "right")]] for x in (at, after))
    begin = np.zeros(n, bool)
    begin[at] = begin[after] = begin[starts] = True
    return np.flatnonzero(begin)


class Encoder:
    """A byte-level BPE tokenizer that encodes each distinct piece of a batch once and remembers the last ones it met.

    Texts are cut where ``cuts`` says; those that hold one of the tokenizer's added tokens are
    encoded whole. With any other kind of tokenizer all texts are encoded whole.

    The memo is an Arrow array of pieces, with a start and a length in one array of ids for each. A
    batch's pieces are looked up by a dictionary that begins with the memo's.
    """

    _loaded: dict[str, Encoder] = {}
    _idle: threading.Timer | None = None

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Tokenizer(self.tokenizer.model)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cuts = cuttable(json.loads(self.tokenizer.to_str()), self.added)
        self.letters = byte_letters()
        space = chr(self.letters[0x20])
        self.words.pre_tokenizer = pre_tokenizers.Split(space, "merged_with_next")  # takes words spelt in byte letters
        self.size = vocabulary_size(self.tokenizer)
        self.begins = np.zeros(self.size, bool)  # ids of tokens that begin with a space
        for token, i in self.tokenizer.get_vocab().items():
            self.begins[i] = token.startswith(space)
        self.known = pa.array([], pa.large_binary())
        self.ids, self.at, self.n, self.met = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.batches = 0

    @classmethod
    def load(cls, path: str) -> Encoder:
        if cls._idle:
            cls._idle.cancel()
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    @classmethod
    def rest(cls) -> None:
        """A task has ended: if no other comes to this worker soon, its memory is given back to the executor."""
        cls._idle = threading.Timer(IDLE_SECONDS, cls.forget)
        cls._idle.daemon = True
        cls._idle.start()

    @classmethod
    def forget(cls) -> None:
        cls._loaded.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call, nothing is lost
            ctypes.CDLL(None).malloc_trim(0)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def spaced(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of pieces that are a space and letters.

        They need no look at the tokenizer's pattern and go to its model side by side, many to a
        call: each begins where a token begins with a space.
        """
        raw, ends = text_bytes(pieces)
        calls = np.unique(np.searchsorted(ends, np.arange(0, len(raw), CALL_BYTES)))
        texts = [self.letters[raw[a:b]].tobytes().decode("utf-32-le") for a, b in itertools.pairwise([*ends[calls].tolist(), len(raw)])]
        ids = np.concatenate([np.zeros(0, "<u4"), *(np.array(e.ids, "<u4") for e in self.words.encode_batch_fast(texts, add_special_tokens=False))])
        starts = np.flatnonzero(self.begins[ids])
        assert len(starts) == len(pieces)
        return ids, np.diff(starts, append=len(ids))

    def learn(self, known: pa.Array) -> None:
        """Take a dictionary that begins with the pieces known so far, and encode the others."""
        new = known.slice(len(self.known)).cast(pa.large_string())
        plain = pc.match_substring_regex(new, _PLAIN)
        ids, lengths = self.spaced(new.filter(plain))
        others = self.whole(new.filter(pc.invert(plain)).to_pylist())
        plain = plain.to_numpy(zero_copy_only=False)
        n = np.zeros(len(new), np.int32)
        n[plain], n[~plain] = lengths, np.fromiter(map(len, others), np.int32, len(others))
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        at = np.zeros(len(new), np.int64)
        at[order] = len(self.ids) + np.cumsum(n[order]) - n[order]
        self.known, self.ids = known, np.concatenate([self.ids, ids, *others])
        self.at, self.n, self.met = np.concatenate([self.at, at]), np.concatenate([self.n, n]), np.concatenate([self.met, np.zeros(len(new), np.int32)])

    def shrink(self) -> None:
        """Keep the pieces that were met last, where the memo has grown too large."""
        if len(self.known) <= MEMO_PIECES and self.known.nbytes <= MEMO_BYTES:
            return
        short = np.flatnonzero(np.asarray(pc.binary_length(self.known)) <= LONGEST_KEPT)
        keep = np.sort(short[np.argsort(-self.met[short], kind="stable")[:KEPT_PIECES]])
        self.ids, self.known = self.ids[spans(self.at[keep], self.n[keep])], self.known.take(pa.array(keep))
        self.n, self.met = self.n[keep], self.met[keep]
        self.at = np.cumsum(self.n, dtype=np.int64) - self.n

    def documents(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text, whole."""
        if not self.cuts:
            return self.whole(column.to_pylist())
        whole = np.zeros(len(column), bool)
        for token in self.added:
            whole |= pc.match_substring(column, token).to_numpy(zero_copy_only=False).astype(bool)
        raw, ends = text_bytes(column)
        starts = cuts(raw, ends, whole)
        if not len(starts):
            return [self.ids[:0]] * len(column)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(raw)])
        coded = pa.chunked_array([self.known, pieces]).dictionary_encode().chunks[-1]
        self.learn(coded.dictionary)
        number = np.asarray(coded.indices)
        self.batches += 1
        self.met[number] = self.batches
        n = self.n[number]
        first = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[np.searchsorted(starts, ends)]
        ids = self.ids[spans(self.at[number], n)]
        self.shrink()
        return [ids[a:b] for a, b in itertools.pairwise(first.tolist())]


def spans(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each ``at`` on, ``n`` of them, one span after the other."""
    ends = np.cumsum(n, dtype=np.int64)
    out = np.repeat(at - (ends - n), n)
    out += np.arange(len(out))
    return out


def groups(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of runs of rows with about GROUP_BYTES bytes; null reads as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    ends = np.cumsum(np.asarray(pc.binary_length(column), np.int64))
    first = 0
    while first < len(column):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + GROUP_BYTES)))
        yield first, column.slice(first, last - first)
        first = last


def planes(ids: np.ndarray, width: int) -> bytes:
    """The ids' lowest bytes, then their second bytes, and so on: bytes of one kind stand together and pack well."""
    return ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T[:width].tobytes()


def unplanes(raw: bytes, width: int) -> np.ndarray:
    kinds = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros(kinds.shape[1], np.uint32)
    for j in range(width):
        out |= kinds[j].astype(np.uint32) << np.uint32(8 * j)
    return out


def encoded(documents: DataFrame, tokenizer: str, width: int, end_id: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids): each whole text's ids and the end id, in ``width`` planes."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(tokenizer)
        tail = np.array([end_id], "<u4")
        for rows in batches:
            for first, texts in groups(rows.column(1)):
                packed = [planes(np.concatenate([found, tail]), width) for found in encoder.documents(texts)]
                yield pa.RecordBatch.from_arrays([rows.column(0).slice(first, len(packed)), pa.array(packed, pa.binary())], ["doc_id", "ids"])
            pa.default_memory_pool().release_unused()
        Encoder.rest()

    return documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text)).mapInArrow(encode, "doc_id bigint, ids binary")


def id_counts(staged: DataFrame, width: int, size: int) -> DataFrame:
    """(id, n): how often each token id occurs in all documents; at most as many rows as the vocabulary has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(size, np.int64), [], 0
        for rows in batches:
            for raw in rows.column(0):
                held.append(unplanes(raw.as_buffer(), width))
                n += len(held[-1])
                if n > BLOCK_TOKENS:
                    total += np.bincount(np.concatenate(held), minlength=size)
                    held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["id", "n"])

    return staged.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encode every whole text, append ``end_id``, and write the blocks and the rank table to ``path``.

    Texts are encoded once, into a staging table beside the blocks that is taken away at the end;
    its ids are counted (which fixes the ranks), sorted by doc_id and written as blocks. What the
    driver holds is the rank table, bounded by the vocabulary. Null text: only the end id. Null
    doc_id: sorts first. Rows that share a doc_id are written one after the other, in the order of a
    hash of their ids. doc_ids are whole numbers. Ids are those of ``encode(text, add_special_tokens=False)``:
    the tokenizer's added tokens are recognised where a text holds them. Byte-level BPE tokenizers are
    sped up; others give the same ids as they would alone, text by text.
    """
    from tokenizers import Tokenizer

    spark = documents.sparkSession
    size = max(vocabulary_size(Tokenizer.from_file(tokenizer)), end_id + 1)
    width = next(w for w in (1, 2, 3, 4) if size <= 1 << 8 * w)
    encoded(documents, tokenizer, width, end_id, text, doc_id).withColumn("tie", F.xxhash64("ids")).write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(f"{path}/staging")
    staged = spark.read.schema("doc_id bigint, ids binary, tie bigint").parquet(f"{path}/staging")
    often = np.zeros(size, np.int64)
    for r in id_counts(staged, width, size).collect():
        often[r.id] = r.n
    by_rank = np.argsort(-often, kind="stable").astype(np.uint32)
    rank_of = np.empty(size, np.uint32)
    rank_of[by_rank] = np.arange(size, dtype=np.uint32)
    spark.createDataFrame(list(zip(range(size), by_rank.tolist(), strict=True)), "rank int, id int").coalesce(1).write.mode("overwrite").parquet(f"{path}/ranks")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        block, before, ids, held, size = 0, 0, [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal block, before, ids, held, size
            control, data = encode_ranks(rank_of[np.concatenate(held)])
            known = [-1 if i is None else i for i in ids]
            row = [[part], [block], [known], [[i is None for i in ids]], [[len(h) for h in held]], [before], [size], [control], [data]]
            types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["part", "block", "doc_ids", "id_null", "n_tokens", "before", "total", "control", "data"])
            block, before, ids, held, size = block + 1, before + size, [], [], 0
            return out

        for rows in batches:
            for key, raw in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                ids.append(key)
                held.append(unplanes(raw.as_buffer(), width))
                size += len(held[-1])
                if size >= BLOCK_TOKENS:
                    yield close()
        if held:
            yield close()

    # the tie lets a doc_id that many rows share, or null, be dealt to several tasks, and fixes the order of its rows
    parts = max(spread(staged), -(-int(often.sum()) * width // PART_BYTES))
    ordered = staged.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
    ordered.mapInArrow(write, BLOCKS).write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(f"{path}/blocks")
    staging = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/staging")
    staging.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(staging, True)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files at ``path``.

    A part's first token is found from the parts' totals: one row for each written part, whose
    number the writer sets, so that table is small and is broadcast.
    """
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    by_rank = np.array([r.id for r in spark.read.schema("rank int, id int").parquet(f"{path}/ranks").orderBy("rank").collect()], "<u4")
    totals = blocks.groupBy("part").agg(F.sum("total").alias("total"))
    base = totals.select(F.col("part").alias("_part"), (F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("total")).alias("base"))
    placed = blocks.join(F.broadcast(base), blocks["part"] == base["_part"]).select((F.col("base") + F.col("before")).alias("first"), "doc_ids", "id_null", "n_tokens", "control", "data")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in range(rows.num_rows):
                first, doc_ids, id_null, lengths, control, data = (rows.column(j)[row].as_py() for j in range(6))
                ends = np.cumsum(lengths)
                ids = by_rank[decode_ranks(control, data, int(ends[-1]))]
                starts = ends - lengths
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                doc = pa.array([None if gone else i for i, gone in zip(doc_ids, id_null, strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays([doc, pa.array(first + starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(documents: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the documents' tokens to ``path`` (by default a shared folder) and read them back."""
    path = path or shared_path(documents.sparkSession, "tokens")
    write_tokens(documents, path, tokenizer)
    return read_tokens(documents.sparkSession, path)
