"""How chunks of pixels are packed: LZW and horizontal differences for tiles, Blosc frames for chunked arrays."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Fixed values of the LZW form that tiled files use: codes of 9 to 12 bits, most significant bit first.
CLEAR, END, FIRST, FULL = 256, 257, 258, 4094


def lzw_encode(raw: bytes) -> bytes:
    """LZW codes of a byte string. A code becomes one bit longer once the table holds the last that fits; a full table is cleared."""
    codes, widths = [CLEAR], [9]
    table: dict[int, int] = {}
    free, width, limit = FIRST, 9, 512
    if raw:
        known = raw[0]
        for byte in memoryview(raw)[1:]:
            key = known << 8 | byte
            longer = table.get(key)
            if longer is not None:
                known = longer
                continue
            codes.append(known)
            widths.append(width)
            table[key] = free
            free += 1
            known = byte
            if free == FULL:
                codes.append(CLEAR)
                widths.append(width)
                table.clear()
                free, width, limit = FIRST, 9, 512
            elif free == limit:
                width += 1
                limit *= 2
        codes.append(known)
        widths.append(width)
        free += 1
        if free == limit and width < 12:
            width += 1
    codes.append(END)
    widths.append(width)
    n = np.array(widths, np.uint16)
    bits = np.unpackbits((np.array(codes, np.uint16) << (16 - n)).astype(">u2").view(np.uint8)).reshape(-1, 16)
    return np.packbits(bits[np.arange(16) < n[:, None]]).tobytes()


def lzw_decode(packed: bytes) -> bytes:
    """The bytes of LZW codes, up to the end code or the last whole one."""
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, before = list(single), [], b""
    held, bits, width = 0, 0, 9
    for byte in packed:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == CLEAR:
            table, before, width = list(single), b"", 9
            continue
        if code == END:
            break
        if not before:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else before + before[:1]
            table.append(before + entry[:1])
        out.append(entry)
        before = entry
        at = len(table) + 1  # the writer is one entry ahead
        width = 9 if at < 512 else 10 if at < 1024 else 11 if at < 2048 else 12
    return b"".join(out)


def differences(tile: np.ndarray) -> np.ndarray:
    """Each pixel less the one before it in its row, sample by sample, modulo the type's range."""
    out = tile.copy()
    out[:, 1:] -= tile[:, :-1]
    return out


def summed(tile: np.ndarray) -> np.ndarray:
    return np.cumsum(tile, 1, dtype=tile.dtype)


@dataclass(frozen=True)
class Packing:
    """A tile compression: its number in the file, whether rows are held as differences, and how bytes are packed."""

    number: int
    differences: bool
    pack: Callable[[bytes], bytes]

    def tile(self, tile: np.ndarray) -> bytes:
        return self.pack((differences(tile) if self.differences else tile).tobytes())


def deflate(raw: bytes) -> bytes:
    return zlib.compress(raw, 6)


def plain(raw: bytes) -> bytes:
    return raw


# The numbers are fixed values of the file format.
PACKINGS = {"lzw": Packing(5, True, lzw_encode), "deflate": Packing(8, True, deflate), "none": Packing(1, False, plain)}
_UNPACK = {5: lzw_decode, 8: zlib.decompress, 1: plain}


def unpack_tile(raw: bytes, number: int, predictor: int, shape: tuple[int, ...], dtype: str) -> np.ndarray:
    if number not in _UNPACK:
        raise ValueError(f"no way to read compression {number}")
    out = np.frombuffer(_UNPACK[number](raw), dtype).reshape(shape)
    return summed(out) if predictor == 2 else out


# Fixed values of the Blosc frame.
VERSION, ZSTD_VERSION, SHUFFLED, STORED, UNSPLIT, ZSTD = 2, 1, 0x01, 0x02, 0x10, 4 << 5
#: Bytes that are shuffled and packed together.
BLOCK = 1 << 18


def shuffled(raw: np.ndarray, size: int) -> np.ndarray:
    """All first bytes of the elements, then all second ones, and so on; what is no whole element stays behind them."""
    whole = len(raw) // size * size
    return np.concatenate([raw[:whole].reshape(-1, size).T.ravel(), raw[whole:]])


def unshuffled(raw: np.ndarray, size: int) -> np.ndarray:
    whole = len(raw) // size * size
    return np.concatenate([raw[:whole].reshape(size, -1).T.ravel(), raw[whole:]])


def blosc_encode(raw: bytes, size: int, level: int = 5) -> bytes:
    """A Blosc frame of zstd blocks over shuffled bytes; ``size``: bytes of an element. What doesn't shrink is stored."""
    data, codec = np.frombuffer(raw, np.uint8), pa.Codec("zstd", compression_level=level)
    block = max(size, min(len(raw), BLOCK) // size * size)
    parts = []
    for at in range(0, len(raw), block):
        mixed = shuffled(data[at : at + block], size).tobytes() if size > 1 else raw[at : at + block]
        packed = codec.compress(mixed, asbytes=True)
        parts.append(packed if len(packed) < len(mixed) else mixed)
    head = 16 + 4 * len(parts)
    total = head + sum(4 + len(p) for p in parts)
    if total >= len(raw) + 16:
        return struct.pack("<BBBBIII", VERSION, ZSTD_VERSION, ZSTD | UNSPLIT | STORED, size, len(raw), block, len(raw) + 16) + raw
    starts = np.cumsum([head, *(4 + len(p) for p in parts[:-1])]).astype("<i4")
    flags = ZSTD | UNSPLIT | (SHUFFLED if size > 1 else 0)
    return struct.pack("<BBBBIII", VERSION, ZSTD_VERSION, flags, size, len(raw), block, total) + starts.tobytes() + b"".join(struct.pack("<i", len(p)) + p for p in parts)


def blosc_decode(frame: bytes) -> bytes:
    """The bytes of a frame of zstd blocks that aren't split by streams."""
    _, _, flags, size, n, block, _ = struct.unpack_from("<BBBBIII", frame)
    if flags & STORED:
        return frame[16 : 16 + n]
    if flags & 0xE0 != ZSTD or not flags & UNSPLIT:
        raise ValueError(f"no way to read frames with flags {flags:#x}")
    starts = struct.unpack_from(f"<{-(-n // block)}i", frame, 16) if n else ()
    out, codec = [], pa.Codec("zstd")
    for k, at in enumerate(starts):
        (packed,) = struct.unpack_from("<i", frame, at)
        own, want = frame[at + 4 : at + 4 + packed], min(block, n - k * block)
        raw = own if packed == want else codec.decompress(own, want, asbytes=True)
        out.append(unshuffled(np.frombuffer(raw, np.uint8), size).tobytes() if flags & SHUFFLED and size > 1 else raw)
    return b"".join(out)
