"""A minimal perfect hash over 128-bit keys, built and probed with whole arrays.

Keys are placed level by level: at each level a key hashes to a bit of an array
about ``GAMMA`` times as large as the keys left; a key alone on its bit is
placed, the others go on to the next level. The slot of a key is the rank of its
bit among all set bits. Keys still left after ``LEVELS`` levels are listed.
"""

import struct

import numpy as np

GAMMA, LEVELS, WORD = 2, 24, 64


def mixed(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of both halves of the keys (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = a + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30)) ^ b) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27)) ^ (b << np.uint64(1))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    def __init__(self, levels: list, rest: np.ndarray):
        self.levels, self.rest = levels, rest  # rest: keys as pairs, sorted by the first half
        below = 0
        self.ranks = []
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(below + np.cumsum(ones) - ones)
            below += int(ones.sum())
        self.placed = below

    def __len__(self) -> int:
        return self.placed + len(self.rest)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, levels_at_most: int = LEVELS) -> "PerfectHash":
        """a, b: the halves of distinct keys, uint64."""
        levels = []
        for seed in range(levels_at_most):
            if not len(a):
                break
            size = -(-GAMMA * len(a) // WORD) * WORD
            at = (mixed(a, b, seed) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = ~alone[at]
            a, b = a[left], b[left]
        rest = np.stack([a, b], axis=1) if len(a) else np.empty((0, 2), np.uint64)
        return cls(levels, rest[np.lexsort((rest[:, 1], rest[:, 0]))])

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that was not built in, some slot or -1."""
        found = np.full(len(a), -1, np.int64)
        todo = np.arange(len(a))
        for seed, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(todo):
                return found
            at = (mixed(a[todo], b[todo], seed) % np.uint64(len(bits) * WORD)).astype(np.int64)
            word, bit = at // WORD, (at % WORD).astype(np.uint64)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            under = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            found[todo[hit]] = (ranks[word] + np.bitwise_count(under))[hit]
            todo = todo[~hit]
        if len(self.rest) and len(todo):
            listed = {(int(x), int(y)): i for i, (x, y) in enumerate(self.rest)}
            found[todo] = [listed.get((int(x), int(y)), -1 - self.placed) + self.placed for x, y in zip(a[todo], b[todo])]
        return found

    def to_bytes(self) -> bytes:
        head = struct.pack(f"<{len(self.levels) + 2}q", len(self.levels), len(self.rest), *map(len, self.levels))
        return head + b"".join(x.tobytes() for x in self.levels) + self.rest.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple["PerfectHash", int]:
        """The hash and the number of bytes it took."""
        n, rest = struct.unpack_from("<2q", data)
        sizes = struct.unpack_from(f"<{n}q", data, 16)
        at, levels = 16 + 8 * n, []
        for k in sizes:
            levels.append(np.frombuffer(data, np.uint64, k, at))
            at += 8 * k
        return cls(levels, np.frombuffer(data, np.uint64, 2 * rest, at).reshape(rest, 2)), at + 16 * rest


class LineIndex:
    """Fingerprint, document count and first document of each key, in the slots of a perfect hash.

    A fingerprint of 64 bits tells whether a probed key was built in; slot and
    fingerprint depend on all 128 bits of a key.
    """

    def __init__(self, keys: PerfectHash, prints: np.ndarray, counts: np.ndarray, firsts: np.ndarray):
        self.keys, self.prints, self.counts, self.firsts = keys, prints, counts, firsts

    @classmethod
    def build(cls, a, b, counts, firsts) -> "LineIndex":
        keys = PerfectHash.build(a, b)
        at = keys.slots(a, b)
        arrays = [np.empty(len(a), kind) for kind in (np.uint64, np.uint32, np.int64)]
        arrays[0][at] = mixed(b, a, LEVELS)
        arrays[1][at] = np.minimum(counts, 2**32 - 1)
        arrays[2][at] = firsts
        return cls(keys, *arrays)

    def probe(self, a, b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each key: whether it is held, its count and its first document."""
        if not len(self.keys):
            return np.zeros(len(a), bool), np.zeros(len(a), np.uint32), np.zeros(len(a), np.int64)
        at = self.keys.slots(a, b)
        held = (at >= 0) & (self.prints[at] == mixed(b, a, LEVELS))
        return held, self.counts[at], self.firsts[at]

    def to_bytes(self) -> bytes:
        return self.keys.to_bytes() + self.prints.tobytes() + self.counts.tobytes() + self.firsts.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "LineIndex":
        keys, at = PerfectHash.from_bytes(data)
        arrays, n = [], len(keys)
        for kind in (np.uint64, np.uint32, np.int64):
            arrays.append(np.frombuffer(data[at : at + n * np.dtype(kind).itemsize], kind))
            at += n * np.dtype(kind).itemsize
        return cls(keys, *arrays)
