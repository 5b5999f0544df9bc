"""Word shingles as 64-bit numbers, MinHash samples and odd sketches."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import xxhash

# Words of usual length remembered per Python worker; at this number the memory is emptied.
MAX_REMEMBERED, USUAL_LENGTH = 250_000, 64
# Shingles handled at once when MinHash samples are drawn.
CHUNK = 1 << 16


class WordHashes(dict):
    """64-bit hash by word (bytes)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_REMEMBERED:
            self.clear()
        found = xxhash.xxh64_intdigest(word)
        if len(word) <= USUAL_LENGTH:
            self[word] = found
        return found


HASHES = WordHashes()


def _odd_numbers(count: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, count, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct shingles of the whole text.

    A-Z are lower-cased; words are maximal runs of other than space and control
    characters 9 to 13. A text with fewer words than ``size`` is one shingle, one
    without words has none.
    """
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    numbers = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    factors = _odd_numbers(width, 1000 + width)
    total = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        total += numbers[i : len(numbers) - width + 1 + i] * factors[i]
    return np.unique(mix(total))


def set_digest(shingles: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def minhashes(sets: list[np.ndarray], samples: int) -> np.ndarray:
    """``samples`` MinHash values of every (non-empty) set, one row per set."""
    out = np.empty((len(sets), samples), np.uint64)
    factors, start = _odd_numbers(samples, 77), 0
    while start < len(sets):
        stop, size = start + 1, len(sets[start])
        while stop < len(sets) and size + len(sets[stop]) <= CHUNK:
            size += len(sets[stop])
            stop += 1
        values = np.concatenate(sets[start:stop])
        first = np.cumsum([0, *map(len, sets[start : stop - 1])])
        scaled = np.empty_like(values)
        for k, factor in enumerate(factors):
            np.multiply(values, factor, out=scaled)
            out[start:stop, k] = np.minimum.reduceat(scaled, first)
        start = stop
    return out


def odd_sketches(samples: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps (rows of bytes): every MinHash sample flips one bit, chosen by its value and its place."""
    place = np.arange(samples.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bit = (mix(samples + place) % np.uint64(bits)).astype(np.int64)
    flips = np.zeros((len(samples), bits), np.int64)
    np.add.at(flips, (np.arange(len(samples))[:, None], bit), 1)
    return np.packbits((flips & 1).astype(np.uint8), axis=1)


def band_keys(samples: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band of consecutive samples."""
    rows = samples.shape[1] // bands
    grouped = samples[:, : bands * rows].reshape(len(samples), bands, rows)
    factors = _odd_numbers(rows, 55)
    number = np.arange(bands, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    return mix((grouped * factors).sum(axis=2, dtype=np.uint64) + number)


def estimated_similarity(differing: np.ndarray | int, samples: int, bits: int) -> np.ndarray:
    """Jaccard similarity from the number of differing bits of two odd sketches.

    With s samples in n bits the symmetric difference of the sample sets is about
    -n/2 * ln(1 - 2z/n) for z differing bits, and each unequal sample adds two to it.
    """
    share = np.minimum(2 * np.asarray(differing, dtype=float) / bits, 1 - 1e-9)
    return 1 + bits / (4 * samples) * np.log1p(-share)
