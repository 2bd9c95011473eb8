"""Vectorised text kernels on Arrow buffers: words, 64-bit word hashes and shingles of whole texts.

Words are the runs ``[^\\x20\\x09-\\x0D]+``; bytes above 0x7F never match that class, so UTF-8 bytes do as well
as code points. Texts are never cut: long ones are hashed in word-aligned chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_M = np.uint64(0x9E3779B97F4A7C15)
_MINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHUNK = 1 << 17
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _M + np.uint64(seed)) | np.uint64(1)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after another, and their n + 1 bounds; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunks at all
        column = pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def spans(buf: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside``, broken at text bounds, and each text's range of them (n + 1)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    before = np.empty(len(buf), bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[bounds[:-1][bounds[:-1] < len(buf)]] = False
    after = np.empty(len(buf), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def words(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans(buf, bounds, ~SPACE[buf])


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: a polynomial from prefix sums, then mixed."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + _CHUNK, "right")), i + 1)
        base, size = int(starts[i]), int(ends[j - 1] - starts[i])
        if not _POWERS or len(_POWERS[0]) < size:
            n = max(size, _CHUNK)
            up, down = np.full(n, _M), np.full(n, _MINV)
            up[0] = down[0] = 1
            _POWERS[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((buf[base : base + size].astype(np.uint64) + np.uint64(1)) * _POWERS[0][:size], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * _POWERS[1][s]
        i = j
    if len(_POWERS) and len(_POWERS[0]) > 8 * _CHUNK:
        _POWERS.clear()
    return mix(out)


def shingles(h: np.ndarray, ranges: np.ndarray, k: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, text by text, and each text's range; fewer words make one shingle of all."""
    c = constants(k, seed)
    n = np.diff(ranges)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out_bounds = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(int(out_bounds[-1]), np.uint64)
    if len(h) >= k:
        full = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            full += h[i : i + len(full)] * c[i]
        full = mix(full)
        owner = np.repeat(np.arange(len(n)), count)
        place = np.arange(len(out)) - out_bounds[:-1][owner] + ranges[:-1][owner]
        whole = n[owner] >= k
        out[whole] = full[place[whole]]
    for t in np.flatnonzero((n > 0) & (n < k)):
        w = h[ranges[t] : ranges[t + 1]]
        out[out_bounds[t]] = mix(np.array([(w * c[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))], np.uint64))[0]
    return out, out_bounds
