"""Codecs against worked examples and round trips."""

import struct

import numpy as np
import pyarrow as pa
import pytest

from lumaframe.functions import codecs


def bits(*codes):
    text = "".join(f"{c:0{w}b}" for c, w in codes)
    text += "0" * (-len(text) % 8)
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))


def test_lzw_worked_example():
    # 7 7 7 8 8 7 7 6 6: 7 alone, then "77", 8, 8, "77", 6, 6, with entries 258 = 77, 259 = 777, 260 = 78... as they arise
    raw = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    want = bits((256, 9), (7, 9), (258, 9), (8, 9), (8, 9), (258, 9), (6, 9), (6, 9), (257, 9))
    assert codecs.lzw_encode(raw) == want
    assert codecs.lzw_decode(want) == raw
    assert codecs.lzw_encode(b"") == bits((256, 9), (257, 9)) and codecs.lzw_decode(codecs.lzw_encode(b"")) == b""


def test_lzw_grows_with_entry_511():
    """All pairs differ, so each byte makes an entry: code 254 after the first makes entry 511, and the next has ten bits."""
    raw = bytes(i % 256 if i < 256 else (i * 3 + 1) % 256 for i in range(300))
    packed = codecs.lzw_encode(raw)
    text = "".join(f"{b:08b}" for b in packed)
    codes = [int(text[9 * i : 9 * i + 9], 2) for i in range(255)]
    assert codes[0] == 256 and codes[1:] == list(raw[:254])
    assert int(text[9 * 255 : 9 * 255 + 10], 2) == raw[254]
    assert codecs.lzw_decode(packed) == raw


@pytest.mark.parametrize("kind", ["random", "flat", "ramp", "few", "long"])
@pytest.mark.parametrize("name", ["lzw", "deflate", "none"])
@pytest.mark.parametrize("dtype", ["|u1", "<u2"])
def test_tiles_come_back(kind, name, dtype):
    rng = np.random.default_rng(4)
    shape = (64, 48) if kind != "long" else (96, 128, 3)
    tile = {"random": lambda: rng.integers(0, 256, shape), "flat": lambda: np.full(shape, 200), "ramp": lambda: np.indices(shape).sum(0) * 7, "few": lambda: rng.integers(0, 3, shape), "long": lambda: rng.integers(0, 65536, shape)}[kind]().astype(dtype)
    packing = codecs.PACKINGS[name]
    raw = packing.tile(tile)
    assert (codecs.unpack_tile(raw, packing.number, 2 if packing.differences else 1, tile.shape, dtype) == tile).all()


def test_ramp_is_flat_after_differences():
    tile = (np.indices((16, 64)).sum(0) * 900).astype("<u2")
    assert (codecs.differences(tile)[:, 1:] == 900).all()
    assert len(codecs.PACKINGS["lzw"].tile(tile)) < tile.nbytes / 6


@pytest.mark.parametrize("size", [1, 2, 4])
@pytest.mark.parametrize("n", [0, 1, 3, 1000, 600_001])
def test_blosc_frames_come_back(size, n):
    rng = np.random.default_rng(n)
    for raw in (rng.integers(0, 256, n, dtype=np.uint8).tobytes(), (np.arange(n) // 50).astype(np.uint8).tobytes()):
        assert codecs.blosc_decode(codecs.blosc_encode(raw, size)) == raw


def test_blosc_header_and_blocks():
    raw = np.arange(200_000, dtype="<u2").tobytes()
    frame = codecs.blosc_encode(raw, 2)
    version, inner, flags, size, n, block, total = struct.unpack_from("<BBBBIII", frame)
    assert (version, inner, size, n, total) == (2, 1, 2, 400_000, len(frame))
    assert flags == 0b10010001  # zstd, blocks in one stream, bytes shuffled
    starts = struct.unpack_from("<2i", frame, 16)
    assert block == 1 << 18 and starts[0] == 24
    (packed,) = struct.unpack_from("<i", frame, starts[0])
    mixed = pa.Codec("zstd").decompress(frame[28 : 28 + packed], block, asbytes=True)
    half = block // 2
    assert mixed[:half] == raw[:block:2] and mixed[half:] == raw[1:block:2]
    noise = np.random.default_rng(0).integers(0, 256, 999, dtype=np.uint8).tobytes()
    stored = codecs.blosc_encode(noise, 1)
    assert stored[2] & 2 and stored[16:] == noise and len(stored) == 16 + 999
