"""Words of a text as 64-bit hashes, and what is built on them: n-grams and MinHash bands."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers (fixed values: splitmix64 and the golden ratio).
GOLDEN, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
PAD = 0xD1B54A32D192ED03


class WordHashes(dict):
    """word -> 64-bit hash; what one worker remembers is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(hashes of all words, words of each text, digest of each text's words). Words are split at ASCII white space."""
    words = [t.split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(texts))
    flat = np.fromiter((_hashes[w] for ws in words for w in ws), np.uint64, int(sizes.sum()))
    return flat, sizes, [xxhash.xxh3_128_digest(b" ".join(ws)) for ws in words]


def shingle_hashes(flat: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all n-word shingles, shingles of each text). A text of 1 to n-1 words has one shingle, all of its words."""
    short = (sizes > 0) & (sizes < n)
    if short.any():
        ends = np.cumsum(sizes)
        fill = np.where(short, n - sizes, 0)
        flat = np.insert(flat, np.repeat(ends, fill), np.uint64(PAD))
        sizes = sizes + fill
    if len(flat) < n:
        return np.zeros(0, np.uint64), np.zeros(len(sizes), np.int64)
    m = len(flat) - n + 1
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = (h ^ flat[k : k + m]) * GOLDEN
        h ^= h >> np.uint64(29)
    starts = np.cumsum(sizes) - sizes
    count = np.maximum(sizes - n + 1, 0)
    # Positions of shingles that lie inside one text.
    inside = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    return mixed(h[inside]), count


def bands_and_rows(threshold: float, recall: float, most_hashes: int = 100) -> tuple[int, int]:
    """(bands, rows): as many rows as the hashes allow such that a pair at the threshold shares a band with this probability."""
    best = (most_hashes, 1)
    for rows in range(1, 20):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best


def band_hashes(shingles: np.ndarray, count: np.ndarray, bands: int, rows: int, seed: int = 1) -> np.ndarray:
    """[text, band] as int64; rows of texts without shingles are meaningless."""
    rng = np.random.default_rng(seed)
    multiply = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    add = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    out = np.zeros((len(count), bands), np.uint64)
    full = np.flatnonzero(count)
    if len(full):
        starts = (np.cumsum(count) - count)[full]
        for k in range(bands * rows):
            least = np.minimum.reduceat((shingles ^ add[k]) * multiply[k], starts)
            b = k // rows
            out[full, b] = mixed(out[full, b] * GOLDEN + least)
    return out.view(np.int64)
