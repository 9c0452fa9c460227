"""A cuckoo filter over 64-bit keys, with inserts, look-ups and deletions of whole numpy arrays."""

from __future__ import annotations

import numpy as np

SLOTS = 4
LOAD = 0.9
_KICKS = 500


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of a multiply-and-shift hash)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _rank_within(groups: np.ndarray) -> np.ndarray:
    """Position of each element among equal elements."""
    order = np.argsort(groups, kind="stable")
    ordered = groups[order]
    first = np.searchsorted(ordered, ordered, "left")
    rank = np.empty(len(groups), np.int64)
    rank[order] = np.arange(len(groups)) - first
    return rank


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key lies in one of two buckets.

    Keys are inserted at most once each and only inserted keys are deleted; then a look-up never
    misses a key, and says "perhaps" for an absent one about once in ten thousand times.
    """

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        """An empty filter with room for this many keys."""
        buckets = 1
        while buckets * SLOTS * LOAD < max(keys, 1):
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @property
    def capacity(self) -> int:
        return int(self.table.size * LOAD)

    @property
    def items(self) -> int:
        return int(np.count_nonzero(self.table))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mixed = _mixed(keys)
        prints = (mixed >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = mixed & self.mask
        return prints, first.astype(np.int64), self._other(first.astype(np.int64), prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return (bucket.astype(np.uint64) ^ (_mixed(prints) & self.mask)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(keys)
        return ((self.table[first] == prints[:, None]) | (self.table[second] == prints[:, None])).any(axis=1)

    def _put(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Put prints into free slots of their buckets; True where that worked."""
        free = self.table[bucket] == 0
        rank = _rank_within(bucket)
        fits = rank < free.sum(axis=1)
        slot = (np.cumsum(free, axis=1) == (rank + 1)[:, None]).argmax(axis=1)
        self.table[bucket[fits], slot[fits]] = prints[fits]
        return fits

    def insert(self, keys: np.ndarray) -> None:
        """Insert keys that are not in the filter; grows nothing, so the room must be there."""
        prints, first, second = self._places(keys)
        left = ~self._put(first, prints)
        prints, bucket = prints[left], second[left]
        chance = np.random.default_rng(len(keys))
        for _ in range(_KICKS):
            if not len(prints):
                return
            left = ~self._put(bucket, prints)
            prints, bucket = prints[left], bucket[left]
            if not len(prints):
                return
            # One waiting print per full bucket takes the place of a random one, which moves on.
            turn = _rank_within(bucket) == 0
            at, slot = bucket[turn], chance.integers(SLOTS, size=int(turn.sum()))
            evicted = self.table[at, slot]
            self.table[at, slot] = prints[turn]
            prints = np.concatenate((prints[~turn], evicted))
            bucket = np.concatenate((bucket[~turn], self._other(at, evicted)))
        raise OverflowError("the filter is too full; build it anew with more room")

    def delete(self, keys: np.ndarray) -> None:
        """Remove keys that were inserted before."""
        prints, first, second = self._places(keys)
        gone = self._clear(first, prints)
        self._clear(second[~gone], prints[~gone])

    def _clear(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        same = self.table[bucket] == prints[:, None]
        rank = _rank_within(bucket.astype(np.int64) * 65536 + prints)
        found = rank < same.sum(axis=1)
        slot = (np.cumsum(same, axis=1) == (rank + 1)[:, None]).argmax(axis=1)
        self.table[bucket[found], slot[found]] = 0
        return found


def filled(keys: np.ndarray, room: int = 0) -> CuckooFilter:
    """A filter that holds these distinct keys, with room for ``room``; it takes twice the room where chance wants it."""
    room = max(room, len(keys))
    while True:
        made = CuckooFilter.sized(room)
        try:
            made.insert(keys)
            return made
        except OverflowError:
            room = made.capacity + 1
