"""A cuckoo filter as a numpy table: buckets of four 16-bit fingerprints, filled, searched and emptied for whole arrays of hashes at once.

A hash names a fingerprint and two buckets, each found from the other one and the fingerprint, so entries can move without their keys. A fingerprint is stored once for
every key inserted; taking a key out takes one copy, which leaves the others. What finds no place after many moves goes to a stash that is searched as well: no key is lost.
"""

from __future__ import annotations

import numpy as np

from codehist.llm.vectors import mixed

SLOTS, LOAD, MOVES = 4, 0.85, 200


def _rank(groups: np.ndarray) -> np.ndarray:
    """How many equal values stand before each."""
    order = np.argsort(groups, kind="stable")
    ordered = groups[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(groups) else np.zeros(0, np.int64)
    rank = np.arange(len(groups)) - np.repeat(first, np.diff(np.append(first, len(groups))))
    out = np.empty(len(groups), np.int64)
    out[order] = rank
    return out


class Cuckoo:
    def __init__(self, table: np.ndarray, stash: np.ndarray | None = None):
        self.table = table
        self.stash = np.zeros(0, np.uint64) if stash is None else stash

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        return cls(np.zeros((int(keys / (SLOTS * LOAD)) + 2, SLOTS), np.uint16))

    @classmethod
    def read(cls, slots: bytes, stash: bytes) -> Cuckoo:
        return cls(np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy(), np.frombuffer(stash, np.uint64).copy())

    def written(self) -> tuple[bytes, bytes]:
        return self.table.tobytes(), self.stash.tobytes()

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return (mixed(mark.astype(np.uint64)).astype(np.int64) % len(self.table) - bucket) % len(self.table)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = np.maximum((hashes >> np.uint64(48)).astype(np.uint16), np.uint16(1))
        first = ((hashes & np.uint64(0xFFFFFFFF)) % np.uint64(len(self.table))).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _named(self, mark: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Bucket and fingerprint as one number, the same from either bucket."""
        return (np.minimum(first, second).astype(np.uint64) << np.uint64(16)) | mark.astype(np.uint64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        mark, first, second = self._places(hashes)
        found = ((self.table[first] == mark[:, None]) | (self.table[second] == mark[:, None])).any(axis=1)
        return found | np.isin(self._named(mark, first, second), self.stash) if len(self.stash) else found

    def _settle(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Fills free slots; which of the entries found none."""
        rank = _rank(bucket)
        nth = np.cumsum(self.table[bucket] == 0, axis=1)
        fits = nth[:, -1] > rank
        k = np.flatnonzero(fits)
        self.table[bucket[k], (nth[k] == rank[k][:, None] + 1).argmax(axis=1)] = mark[k]
        return ~fits

    def add(self, hashes: np.ndarray) -> None:
        mark, bucket, second = self._places(hashes)
        left = self._settle(bucket, mark)
        mark, bucket = mark[left], second[left]
        moves = np.random.default_rng(len(hashes))
        for _ in range(MOVES):
            left = self._settle(bucket, mark)
            mark, bucket = mark[left], bucket[left]
            if not len(mark):
                return
            # one entry of each full bucket takes another's slot, which goes on to its other bucket
            one = np.unique(bucket, return_index=True)[1]
            slot = moves.integers(0, SLOTS, len(one))
            out = self.table[bucket[one], slot]
            self.table[bucket[one], slot] = mark[one]
            mark[one], bucket[one] = out, self._other(bucket[one], out)
        self.stash = np.append(self.stash, self._named(mark, bucket, self._other(bucket, mark)))

    def remove(self, hashes: np.ndarray) -> None:
        """Every hash must have been added, and is taken out once for each time it is given."""
        mark, first, second = self._places(hashes)
        rank = _rank(self._named(mark, first, second))
        for r in range(int(rank.max(initial=-1)) + 1):
            k = np.flatnonzero(rank == r)
            for bucket in (first, second):
                here = self.table[bucket[k]] == mark[k][:, None]
                hit = here.any(axis=1)
                self.table[bucket[k][hit], here[hit].argmax(axis=1)] = 0
                k = k[~hit]
            for name in self._named(mark[k], first[k], second[k]):
                at = np.flatnonzero(self.stash == name)[:1]
                self.stash = np.delete(self.stash, at)
