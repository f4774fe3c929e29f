"""Minimal perfect hash of a bounded set of keys, built and read with numpy.

Level by level, keys are hashed into a bit array of about twice their number; a key that is alone at its bit is settled
there, the others go to the next level. A key's number is the rank of its bit, so n keys get the numbers 0 .. n - 1.
Fingerprints stored by number tell keys that were never put in.
"""

from __future__ import annotations

import struct

import numpy as np
import xxhash

MAGIC = b"NTMPH001"
GAMMA = 2.0
LEVELS = 48
SPAN = 8  # 64-bit words for each stored rank


def hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes for places and a 32-bit fingerprint for every key."""
    raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").reshape(-1, 2).astype(np.uint64)
    mark = np.array([xxhash.xxh32_intdigest(k, 7) for k in keys], np.uint32)
    return raw[:, 0], raw[:, 1] | np.uint64(1), mark


def _places(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    x = h1 + np.uint64(level) * h2
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)


class PerfectHash:
    """Numbers of keys. `sizes` has the bits of each level, `words` the bit arrays one after the other."""

    def __init__(self, n: int, sizes: np.ndarray, words: np.ndarray):
        self.n, self.sizes, self.words = n, sizes, words
        ones = np.bitwise_count(words).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(ones.reshape(-1, SPAN).sum(axis=1))])

    @classmethod
    def build(cls, keys: list[bytes]) -> PerfectHash:
        """Raises if two keys are equal."""
        h1, h2, _ = hashes(keys)
        sizes, arrays = [], []
        while len(h1):
            if len(sizes) == LEVELS:
                raise ValueError("keys of a perfect hash must differ")
            size = -(-int(max(64 * SPAN, GAMMA * len(h1))) // (64 * SPAN)) * 64 * SPAN
            at = _places(h1, h2, len(sizes), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            arrays.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            rest = ~alone[at]
            h1, h2 = h1[rest], h2[rest]
        return cls(len(keys), np.array(sizes, np.uint64), np.concatenate(arrays) if arrays else np.zeros(0, "<u8"))

    def numbers(self, keys: list[bytes]) -> np.ndarray:
        """The number of every key, or -1 where no level has it. A key that was not put in may get any number."""
        h1, h2, _ = hashes(keys)
        out, base, open_ = np.full(len(keys), -1, np.int64), 0, np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            bit = _places(h1[open_], h2[open_], level, size).astype(np.int64) + base
            hit = self.words[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1) == 1
            out[open_[hit]] = self._rank(bit[hit])
            open_, base = open_[~hit], base + size
        return out

    def _rank(self, bit: np.ndarray) -> np.ndarray:
        word, span = bit >> 6, (bit >> 6) // SPAN
        total = self.ranks[span].copy()
        for k in range(SPAN - 1):  # whole words before the bit's
            before = span * SPAN + k
            total += np.where(before < word, np.bitwise_count(self.words[before]), 0)
        below = self.words[word] & ((np.uint64(1) << (bit & 63).astype(np.uint64)) - np.uint64(1))
        return total + np.bitwise_count(below)

    def to_bytes(self) -> bytes:
        return MAGIC + struct.pack("<QII", self.n, len(self.sizes), len(self.words)) + self.sizes.astype("<u8").tobytes() + self.words.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[PerfectHash, int]:
        """The hash and the bytes it took."""
        if data[:8] != MAGIC:
            raise ValueError("not a perfect hash")
        n, levels, words = struct.unpack_from("<QII", data, 8)
        at = 24 + 8 * levels
        return cls(n, np.frombuffer(data, "<u8", levels, 24), np.frombuffer(data, "<u8", words, at)), at + 8 * words
