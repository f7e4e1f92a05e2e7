"""Vectorised work on the UTF-8 bytes of a batch of texts: words, lines and 64-bit hashes of byte or word ranges.

Hashes are polynomial modulo 2**64 over a fixed random table of bytes, so that the hash of any range comes from two prefix
sums; a final mix spreads the bits. Everything is a pure function of the bytes, the same in every task and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x5851F42D4C957F2F
INVERSE = pow(BASE, -1, 2**64)
BYTE_HASH = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=U64)

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the task's life."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16) + (n >> 3), base, U64)
        held[0] = 1
        _powers[base] = held = np.cumprod(held, dtype=U64)
    return held[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE**i, one longer than values."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * _power(BASE, len(values)), out=out[1:])
    return out


def range_hash(prefixes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each range, whatever its place."""
    return mix((prefixes[ends] - prefixes[starts]) * _power(INVERSE, len(prefixes))[starts] + (ends - starts).astype(U64))


def byte_prefix(data: np.ndarray) -> np.ndarray:
    return prefix(BYTE_HASH[data])


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = pc.fill_null(column, pa.scalar(b"" if wide == pa.large_binary() else "", wide))
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over runs of whole texts of about `most` bytes, one longer text alone."""
    yield from cut_texts(*raw(column), most)


def cut_texts(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    row = 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags in each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def per_text_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of numbers in each text, added in double precision text by text."""
    out = np.zeros(len(offsets) - 1)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(values.astype(np.float64), offsets[:-1][full])
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and where each text's words begin among them (one longer than the texts)."""
    solid = ~WHITE[data]
    begins, finishes = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    finishes[:-1] &= ~solid[1:]
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    begins[first], finishes[last] = solid[first], solid[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, of_text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows inside the texts, and where each text's windows begin among them."""
    counts = np.diff(of_text)
    room = np.maximum(counts - n + 1, 0)
    at = np.zeros(len(room) + 1, np.int64)
    np.cumsum(room, out=at[1:])
    starts = np.arange(at[-1]) + np.repeat(of_text[:-1] - at[:-1], room)
    return range_hash(prefix(hashes), starts, starts + n), at
