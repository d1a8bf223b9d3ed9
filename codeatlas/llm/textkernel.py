"""Vectorised word and shingle hashing over Arrow string batches.

Everything works on UTF-8 bytes. A word is a run of bytes other than 0x20 and 0x09 to 0x0D, A-Z
lower-cased. Its hash is a polynomial in its bytes modulo 2**64 (got from prefix sums, so that a
whole slice of documents costs a few numpy passes), then mixed. Memory follows the slice, at most
`SLICE` bytes unless a single word is longer; documents longer than a slice are cut between words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_K1, _K2, _K3 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[str(base)] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U(30)
    x *= _K1
    x ^= x >> U(27)
    x *= _K2
    x ^= x >> U(31)
    return x


def _hashes(buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of `buf` and the start of each word; no word crosses a position in `cuts`."""
    solid = ~SPACE[buf]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = cuts[(cuts > 0) & (cuts < len(buf))]
    first[inner] |= solid[inner]
    last[inner - 1] |= solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        return np.empty(0, np.uint64), start
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((LOWER[buf].astype(np.uint64) + U(1)) * _power(_P, len(buf)), out=total[1:])
    value = (total[end] - total[start]) * _power(_PINV, len(buf))[start]
    return mix(value + (end - start).astype(np.uint64) * _K3), start


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """One long text in slices that end between words."""
    at = 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data):
            back = np.flatnonzero(SPACE[data[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
                break
            end = min(end + SLICE, len(data))
        yield data[at:end]
        at = end


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return off, raw


def slices(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of at most SLICE bytes, or one longer row alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE, "right")) - 1)
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, hashes, bounds): rows i to j; the words of row i + k are hashes[bounds[k]:bounds[k + 1]]."""
    off, raw = string_buffers(column)
    for i, j in slices(off):
        data, cuts = raw[off[i] : off[j]], off[i : j + 1] - off[i]
        if j == i + 1 and len(data) > SLICE:
            got = np.concatenate([_hashes(p, np.empty(0, np.int64))[0] for p in _pieces(data)])
            yield i, j, got, np.array([0, len(got)])
        else:
            got, start = _hashes(data, cuts)
            yield i, j, got, np.searchsorted(start, cuts, "left")


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n words of one document, in order; with fewer words, of the whole sequence."""
    k = min(n, len(hashes))
    if not k:
        return np.empty(0, np.uint64)
    out = np.full(len(hashes) - k + 1, k, dtype=np.uint64)
    for t in range(k):
        out = mix(out * _K3 + hashes[t : len(hashes) - k + 1 + t])
    return out


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row."""
    for i, j, got, bounds in words(column):
        if len(got) >= n:
            window = np.full(len(got) - n + 1, n, dtype=np.uint64)
            for t in range(n):
                window = mix(window * _K3 + got[t : len(got) - n + 1 + t])
        else:
            window = np.empty(0, np.uint64)
        for k in range(j - i):
            a, b = bounds[k], bounds[k + 1]
            own = window[a : b - n + 1] if b - a >= n else shingles(got[a:b], n)
            yield i + k, np.unique(own)
