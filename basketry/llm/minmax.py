"""Min-max signatures of shingle sets, over whole batches of texts."""

from __future__ import annotations

import numpy as np

from .shared import mix64, rolled, span_hashes, word_spans

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of all texts, sorted within each text, and the bounds of the texts.

    A-Z are lower-cased. A text with fewer than ``k`` words, but at least one,
    has its whole sequence as one shingle.
    """
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    data = _FOLD[data]
    starts, ends, counts = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    texts = np.repeat(np.arange(n), counts)
    first = np.cumsum(counts) - counts
    runs = rolled(words, k)
    inside = texts[: len(runs)] == texts[k - 1 :] if len(runs) else np.zeros(0, bool)
    hashes, owners = [runs[inside]], [texts[: len(runs)][inside]]
    for c in range(1, k):
        short = np.flatnonzero(counts == c)
        if len(short):
            hashes.append(mix64(rolled(words, c)[first[short]] + np.uint64(c)))
            owners.append(short)
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(n + 1))


def permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    mask = rng.integers(0, 2**64, count, dtype=np.uint64)
    factor = rng.integers(0, 2**64, count, dtype=np.uint64) | np.uint64(1)
    return mask, factor


def min_max(h: np.ndarray, bounds: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Minimum and maximum of each set under ``count`` permutations: a row of ``2 * count`` values per set.

    Empty sets have rows of zeros.
    """
    mask, factor = permutations(count, seed)
    out = np.zeros((len(bounds) - 1, 2 * count), dtype=np.uint32)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if not len(full):
        return out
    at = bounds[full]
    for p in range(count):
        v = (((h ^ mask[p]) * factor[p]) >> np.uint64(32)).astype(np.uint32)
        out[full, 2 * p] = np.minimum.reduceat(v, at)
        out[full, 2 * p + 1] = np.maximum.reduceat(v, at)
    return out


def set_hashes(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set; zero for empty sets."""
    out = np.zeros((2, len(bounds) - 1), dtype=np.uint64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        sizes = (bounds[1:] - bounds[:-1])[full].astype(np.uint64)
        for i, salt in enumerate((0x51ED270B, 0x9FB21C65)):
            sums = np.add.reduceat(mix64(h + np.uint64(salt)), bounds[full])
            out[i, full] = mix64(sums + sizes * np.uint64(0x9E3779B97F4A7C15))
    return out[0], out[1]


def band_hashes(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit hash per band of ``rows`` values, different for each band."""
    bands = signatures.shape[1] // rows
    parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
    for r in range(rows):
        out = mix64(out + parts[:, :, r] + np.uint64(r + 1))
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    return len(np.intersect1d(a, b, assume_unique=True))
