"""A cuckoo filter: 16-bit fingerprints, four to a bucket, with deletion."""

from __future__ import annotations

import numpy as np

from ledgerloom.llm.text import U, mix

SLOTS = 4
KICKS = 500
FULL = 0.85


def _spread(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint (never 0) and both buckets of each 64-bit key."""
    h = mix(key.astype(np.uint64))
    mark = (h >> U(48)).astype(np.uint16)
    mark[mark == 0] = 1
    one = h & U(buckets - 1)
    return mark, one, one ^ (mix(mark.astype(np.uint64)) & U(buckets - 1))


class CuckooFilter:
    """Membership with few false hits and no misses; a key may be held several times."""

    def __init__(self, buckets: int = 16, table: np.ndarray | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 16
        while buckets * SLOTS * FULL < keys:
            buckets *= 2
        return cls(buckets)

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, "<u2").reshape(-1, SLOTS).copy()
        return cls(len(table), table)

    def dump(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = _spread(keys, self.buckets)
        held = (self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])
        return held.any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """False when the table is too full: the caller builds a larger one from the exact counts."""
        for mark, one, two in zip(*(x.tolist() for x in _spread(keys, self.buckets)), strict=True):
            if not self._put(mark, one, two):
                return False
        return True

    def _put(self, mark: int, one: int, two: int) -> bool:
        for bucket in (one, two):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        bucket = two
        for kick in range(KICKS):
            slot = (kick * 7 + mark) % SLOTS
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket ^= int(mix(np.array([mark], np.uint64))[0]) & (self.buckets - 1)
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Only keys that were inserted may be deleted."""
        for mark, one, two in zip(*(x.tolist() for x in _spread(keys, self.buckets)), strict=True):
            for bucket in (one, two):
                at = np.flatnonzero(self.table[bucket] == mark)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break


def build(keys: np.ndarray) -> CuckooFilter:
    f = CuckooFilter.sized(len(keys))
    while not f.insert(keys):
        f = CuckooFilter(f.buckets * 2)
    return f
