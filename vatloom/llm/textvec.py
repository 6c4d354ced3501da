"""Words and shingles of whole texts as 64-bit hashes, computed on Arrow arrays with numpy.

Words are runs of bytes other than ASCII white space, with A-Z lower-cased. Work goes through
``pieces`` of whole texts, so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 4 << 20
_B, _B_INV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finalizer of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_LOWER_BYTE = _BYTE[_LOWER]


def _power(base: np.uint64, n: int) -> np.ndarray:
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        size = max(n, PIECE_BYTES + 1)
        got = np.full(size, base, np.uint64)
        got[0] = 1
        got = np.cumprod(got, dtype=np.uint64)
        if size <= 4 * PIECE_BYTES:
            _powers[int(base)] = got
    return got[:n]


def pieces(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of whole texts of about ``most`` bytes together, one text at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        done = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, done + most, side="right")))
        yield start, texts.slice(start, end - start)
        start = end


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a text array; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def word_bounds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of words, and the first word (n + 1) of each row."""
    offsets, data = raw(texts)
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # a new text begins here
    edge[offsets] = True
    before = np.concatenate([[False], solid])[: len(data)] & ~edge[: len(data)]
    starts = np.flatnonzero(solid & ~before)
    after = np.concatenate([solid[1:], [False]])[: len(data)] & ~edge[1:]
    ends = np.flatnonzero(solid & ~after) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """First word (n + 1) of each row and the hash of every word."""
    data, starts, ends, rows = word_bounds(texts)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER_BYTE[data] * _power(_B, len(data)), dtype=np.uint64, out=sums[1:])
    inverse = _power(_B_INV, len(data) + 1)
    return rows, mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """First shingle (n + 1) of each row and the hash of every k-word shingle; a row of fewer words has its whole sequence."""
    rows, words = word_hashes(texts)
    n = np.diff(rows)
    coef = [np.uint64(pow(0xC2B2AE3D27D4EB4F, j, 1 << 64)) for j in range(k)]
    flat = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    for j in range(k):
        flat += words[j : len(words) - k + 1 + j] * coef[j]
    per = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out_rows = np.concatenate([[0], np.cumsum(per)])
    full = n >= k
    first = np.repeat(rows[:-1] - out_rows[:-1], per)
    at = first + np.arange(out_rows[-1])
    long_rows = np.repeat(full, per)
    out = np.zeros(out_rows[-1], np.uint64)
    out[long_rows] = flat[at[long_rows]]
    for r in np.flatnonzero((n > 0) & ~full):
        w = words[rows[r] : rows[r + 1]]
        out[out_rows[r]] = (w * np.array(coef[: len(w)], np.uint64)).sum(dtype=np.uint64) ^ np.uint64(n[r])
    return out_rows, mix(out)


def shingle_sets(texts: pa.Array, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for _, piece in pieces(texts):
        rows, h = shingle_hashes(piece, k)
        out += [np.unique(h[a:b]) for a, b in zip(rows[:-1], rows[1:])]
    return out
