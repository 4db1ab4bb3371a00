"""Vectorised word splitting and hashing shared by the operators on text.

Both word classes are closed under UTF-8 bytes: white space and the ASCII
separators never occur inside a multi-byte character, so splitting bytes gives
the same words as splitting characters.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

#: Texts are worked through in slices of about this many bytes, whatever the size of an Arrow batch: word hashes take up to sixty times as much.
SLICE_BYTES = 500_000
#: And of so many rows at most.
SLICE_ROWS = 1 << 16

_U = np.uint64
try:
    _libc = ctypes.CDLL(None)
    _libc.malloc_trim  # noqa: B018
except (OSError, TypeError, AttributeError):  # not glibc
    _libc = None
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _lut(is_sep) -> np.ndarray:
    return np.array([not is_sep(b) for b in range(256)])


#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower case
ALNUM = _lut(lambda b: b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F)
#: `[^\x20\x09-\x0D]+`
NON_SPACE = _lut(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, _U)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, bytes, offsets) for runs of rows of about `limit` bytes. A null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n, i + SLICE_ROWS)
        yield i, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
    trim()


def trim() -> None:
    """Gives free memory back to the system: Python workers live on beside those of other stages, and hold what they once took."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def words(raw: np.ndarray, offsets: np.ndarray, keep: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte and 64-bit hash of every word, and the number of words before each document (one more entry than documents)."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    inside = keep[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    start[cuts] = inside[cuts]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    end[cuts - 1] = inside[cuts - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = _power(n + 1)
    total = np.empty(n + 1, _U)
    total[0] = 0
    np.cumsum((LOWER[raw].astype(_U) + _U(1)) * up[:n], out=total[1:])
    h = mix((total[e] - total[s]) * down[s] + (e - s).astype(_U))
    return s, e, h, np.searchsorted(s, offsets)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= _U(0xD6E8FEB86659FD93)
        acc += h[j : j + n]
    return mix(acc)


def sliding(a: np.ndarray, w: int, op=np.minimum) -> np.ndarray:
    """op over each run of w entries, by doubling."""
    done, out = 1, a
    while done < w:
        step = min(done, w - done)
        out = op(out[: len(out) - step], out[step:])
        done += step
    return out


def lower(text: str) -> str:
    """Lower-cases A-Z only."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER_BYTES).decode("utf-8", "surrogatepass")


_LOWER_BYTES = LOWER.tobytes()
