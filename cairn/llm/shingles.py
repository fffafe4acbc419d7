"""Sets of hashed two-word shingles, and their min-max signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cairn.llm.common import Words, mix64, word_hash

_ONE = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows' sets, ascending and on end, and their offsets.

    A set has the distinct two-word shingles of the words in lower case (A-Z only); with one word
    that word alone; nothing without words.
    """
    w = Words(pc.ascii_lower(text))
    if not len(w.codes):
        return np.zeros(0, np.uint64), np.zeros(len(w.offsets), np.int64)
    h = word_hash(w.distinct)[w.codes]
    rows, n = w.rows, np.diff(w.offsets)
    pair = mix64(mix64(h[:-1] * _ONE + np.uint64(1)) + h[1:])
    inside = rows[:-1] == rows[1:]
    single = np.flatnonzero(n == 1)
    all_h = np.concatenate([pair[inside], mix64(h[w.offsets[single]] ^ _ONE)])
    all_r = np.concatenate([rows[:-1][inside], single])
    order = np.lexsort((all_h, all_r))
    all_h, all_r = all_h[order], all_r[order]
    new = np.ones(len(all_h), bool)
    new[1:] = (all_h[1:] != all_h[:-1]) | (all_r[1:] != all_r[:-1])
    all_h, all_r = all_h[new], all_r[new]
    return all_h, np.searchsorted(all_r, np.arange(len(n) + 1))


def signatures(sets: np.ndarray, offsets: np.ndarray, permutations: int, seed: int = 1) -> np.ndarray:
    """The minimum and the maximum of each nonempty row under each permutation: rows x 2 * permutations."""
    rng = np.random.default_rng(seed)
    rows = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, 2 * permutations), np.uint64)
    if not len(rows):
        return out
    starts = offsets[rows]
    for k in range(permutations):
        a, b = rng.integers(0, 1 << 64, 2, dtype=np.uint64)
        x = (sets ^ b) * (a | np.uint64(1))
        x ^= x >> np.uint64(32)
        x *= _ONE
        out[rows, 2 * k] = np.minimum.reduceat(x, starts)
        out[rows, 2 * k + 1] = np.maximum.reduceat(x, starts)
    return out


def band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit hash for each band of ``rows`` values, the band's number mixed in."""
    bands = signature.shape[1] // rows
    out = np.zeros((len(signature), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(signature), b + 1, np.uint64)
        for v in range(rows):
            h = mix64(h * _ONE + signature[:, b * rows + v])
        out[:, b] = h
    return out
