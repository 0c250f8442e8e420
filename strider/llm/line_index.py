"""A sharded minimal perfect hash over line hashes, with fingerprint and count arrays.

A line's key is its stripped, ASCII-lower-cased form; its hash has 128 bits, (hi, lo). `hi`
picks the shard and the slot; `lo` is the fingerprint that the slot must show. The hash of a
shard is a cascade of bit arrays: a key takes the slot that it alone hashes to, the others go
to the next level. A slot's rank among the set bits is the key's index in both arrays, so a
key costs 8 bytes of fingerprint, 4 of count and about half a byte of bits.
"""

from __future__ import annotations

import io

import numpy as np

GAMMA, MAX_LEVELS = 2.0, 40
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) of x, another one for each seed."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shard:
    """One shard: levels of bits with their ranks, fingerprints and counts by rank."""

    def __init__(self, bits: list[np.ndarray], ranks: list[np.ndarray], prints: np.ndarray, counts: np.ndarray):
        self.bits, self.ranks, self.prints, self.counts = bits, ranks, prints, counts

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray, counts: np.ndarray) -> Shard:
        """hi must be distinct (two keys that share hi and differ in lo can't both be told apart
        by slot; the caller routes them by a mixed hash)."""
        bits, ranks, base = [], [], 0
        index = np.zeros(len(hi), np.int64)
        left = np.arange(len(hi))
        for level in range(MAX_LEVELS):
            if not len(left):
                break
            m = max(64, int(GAMMA * len(left)))
            at = (mix(hi[left], level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            rank = base + np.cumsum(alone, dtype=np.int64) - 1
            won = alone[at]
            index[left[won]] = rank[at[won]]
            bits.append(np.packbits(alone, bitorder="little"))
            ranks.append((base + np.concatenate([[0], np.cumsum(np.add.reduceat(alone, np.arange(0, m, 512)))])).astype(np.int64)[:-1])
            base += int(alone.sum())
            left = left[~won]
        if len(left):
            raise ValueError("line hashes are not distinct")
        prints, numbers = np.zeros(len(hi), np.uint64), np.zeros(len(hi), np.uint32)
        prints[index], numbers[index] = lo, np.minimum(counts, 0xFFFFFFFF)
        return cls(bits, ranks, prints, numbers)

    def counts_of(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The count of each probed key; 0 where the shard doesn't have it."""
        out, left = np.zeros(len(hi), np.int64), np.arange(len(hi))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks)):
            if not len(left):
                break
            m = max(64, int(GAMMA * self._sizes[level]))
            at = (mix(hi[left], level) % np.uint64(m)).astype(np.int64)
            is_set = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            won, slot = left[is_set], at[is_set]
            if len(won):
                block = slot >> 9
                padded = self._padded[level]
                rows = padded[block]  # 64 bytes of bits for each probe
                inside = (slot & 511).astype(np.int64)
                masks = _MASKS[inside]
                index = ranks[block] + _POP[rows & masks].sum(axis=1, dtype=np.int64)
                same = self.prints[index] == lo[won]
                out[won[same]] = self.counts[index[same]]
            left = left[~is_set]
        return out

    @property
    def _sizes(self) -> list[int]:
        if not hasattr(self, "_n"):
            n, self._n, self._padded = len(self.prints), [], []
            for bits in self.bits:
                self._n.append(n)
                n -= int(_POP[bits].sum(dtype=np.int64))
                self._padded.append(np.pad(bits, (0, -len(bits) % 64)).reshape(-1, 64))
        return self._n

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, prints=self.prints, counts=self.counts, **{f"b{i}": b for i, b in enumerate(self.bits)}, **{f"r{i}": r for i, r in enumerate(self.ranks)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, blob: bytes) -> Shard:
        z = np.load(io.BytesIO(blob))
        n = sum(k[0] == "b" for k in z.files)
        return cls([z[f"b{i}"] for i in range(n)], [z[f"r{i}"] for i in range(n)], z["prints"], z["counts"])


_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Of the 64 bytes of a block, the bits before each of its 512 positions.
_MASKS = np.packbits(np.tril(np.ones((512, 512), np.uint8), -1), axis=1, bitorder="little")
