"""Array operations on columns of texts: bytes, words and their hashes.

Everything works on the UTF-8 bytes of many texts at once; a word is a run of
bytes that a 256-entry table marks. Hashes have 64 bits: a polynomial over the
bytes, times the inverse power of the start, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
#: Bytes that are worked on at once; a longer text is one piece.
PIECE = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White-space tokens: all but space and 0x09-0x0D.
TOKEN = np.ones(256, bool)
TOKEN[[0x20, 9, 10, 11, 12, 13]] = False
#: Alphanumeric tokens of lower-cased text: digits, a-z and every byte of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse."""
    if len(_powers[0]) <= n:
        size = max(n + 1, PIECE + 64)
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each row starts and ends; nulls are empty."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    valid, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1 + column.offset)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    starts, ends = at[:-1], at[1:]
    if column.null_count:
        ends = np.where(column.is_valid().to_numpy(zero_copy_only=False), ends, starts)
    return buf, starts, ends


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """first row, last row, bytes, starts and ends within them, for consecutive rows of up to ``limit`` bytes."""
    buf, starts, ends = column_bytes(column)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + limit, "right")))
        lo = starts[i]
        yield i, j, buf[lo : ends[j - 1]], starts[i:j] - lo, ends[i:j] - lo
        i = j


def words(buf: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of marked bytes; runs end with their row."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    is_in = inside[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[starts] = True
    edge = is_in.copy()
    edge[1:] &= ~is_in[:-1] | first[1:-1]
    ends = is_in.copy()
    ends[:-1] &= ~is_in[1:] | first[1:-1]
    ws, we = np.flatnonzero(edge), np.flatnonzero(ends) + 1
    return ws, we, np.searchsorted(starts, ws, "right") - 1


def span_hashes(buf: np.ndarray, ws: np.ndarray, we: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    up, down = powers(len(buf))
    total = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * up[: len(buf)], out=total[1:])
    return mix64((total[we] - total[ws]) * down[ws] + (we - ws).astype(U64) * U64(0xD6E8FEB86659FD93))


def counts_by_row(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, starts and ends of some texts."""
    return column_bytes(pa.array([t or "" for t in texts], pa.string()))
