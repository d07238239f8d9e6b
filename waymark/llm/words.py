"""Words `[^\\x20\\x09-\\x0D]+` of whole texts, A-Z lower-cased, as 64-bit numbers in numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import shared

#: Entries of a worker's cache of word hashes before it starts anew.
CACHE = 100_000


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > CACHE:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_HASHES = WordHash()
shared.CACHES.append(_HASHES)


def hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column, and the number of words of each text (null: none)."""
    get, parts, counts = _HASHES.__getitem__, [], []
    for text in column.cast(pa.binary()).to_pylist():
        words = text.lower().split() if text else ()  # of bytes: ASCII letters, ASCII white space
        counts.append(len(words))
        parts.append(np.fromiter(map(get, words), np.uint64, len(words)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array(counts, np.int64)


def odd_constants(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the sum's low bits over all 64 (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gapped(words: np.ndarray, offsets: list[int], seed: int) -> np.ndarray:
    """A hash of the words at each start plus the offsets; starts too near the end are left out."""
    n = len(words) - max(offsets)
    total = np.full(max(n, 0), seed * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    if n > 0:
        for at, factor in zip(offsets, odd_constants(seed, len(offsets)), strict=True):
            total += words[at : at + n] * factor
    return mixed(total)


def words_of_eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes at every place of `data`, as a number."""
    out = np.empty(max(len(data) - 7, 0), np.uint64)
    for r in range(min(8, len(out))):
        own = data[r : r + (len(data) - r) // 8 * 8]
        out[r::8] = np.frombuffer(own.tobytes(), "<u8")
    return out
