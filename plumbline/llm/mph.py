"""A minimal perfect hash over 64-bit keys, kept as plain arrays that answer whole batches.

Every level is a bit array about as long as the keys still to be placed. A key whose bit no other key
shares is placed there; the others go to the next level. A key's number is the count of bits set before
its own, so the numbers of n keys are 0 to n - 1 and index the value arrays.
"""

from __future__ import annotations

import io

import numpy as np

LEVELS = 48


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build(keys: np.ndarray, marks: np.ndarray, values: dict[str, np.ndarray]) -> bytes:
    """Arrays for ``keys``; ``marks`` are second hashes by which strange keys are told apart.

    Keys that agree in all 64 bits can't be placed; they follow at the end and are found by both hashes.
    """
    place = np.full(len(keys), -1, np.int64)
    left, done, words, sizes = np.arange(len(keys)), 0, [], []
    for level in range(LEVELS):
        if not len(left):
            break
        size = -(-max(64, len(left) * 3 // 2) // 64) * 64
        at = (_mix(keys[left], level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        sizes.append(size)
        rank = done + np.cumsum(alone) - 1
        placed = alone[at]
        place[left[placed]] = rank[at[placed]]
        done += int(alone.sum())
        left = left[~placed]
    place[left] = done + np.arange(len(left))
    order = np.argsort(place)
    out = io.BytesIO()
    np.savez(out, words=np.concatenate(words) if words else np.empty(0, "<u8"), sizes=np.array(sizes, np.int64), rest=keys[left],
             marks=marks[order], **{f"v_{k}": v[order] for k, v in values.items()})
    return out.getvalue()


class Table:
    """The arrays of one shard, ready to be probed."""

    def __init__(self, blob: bytes):
        arrays = np.load(io.BytesIO(blob))
        self.words, self.sizes, self.marks, self.rest = (arrays[k] for k in ("words", "sizes", "marks", "rest"))
        self.values = {k[2:]: arrays[k] for k in arrays.files if k.startswith("v_")}
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.late: dict[int, list[int]] = {}
        for i, key in enumerate(self.rest.tolist()):
            self.late.setdefault(key, []).append(len(self.marks) - len(self.rest) + i)

    def find(self, keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for keys that are not in the table."""
        place = np.full(len(keys), -1, np.int64)
        left, first = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = (_mix(keys[left], level) % np.uint64(size)).astype(np.int64)
            word, bit = first + (at >> 6), (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            place[left[hit]] = self.before[word[hit]] + np.bitwise_count(below)
            left, first = left[~hit], first + size // 64
        known = place >= 0
        known[known] = self.marks[place[known]] == marks[known]
        place[~known] = -1
        if self.late:
            for i in np.flatnonzero(~known).tolist():
                for at in self.late.get(int(keys[i]), ()):
                    if self.marks[at] == marks[i]:
                        place[i] = at
        return place
