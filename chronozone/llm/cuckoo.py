"""Cuckoo filters over 16-byte keys, with inserts and deletions in whole arrays."""

from __future__ import annotations

import numpy as np

SLOTS, LOAD = 4, 0.85


def _split(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and 16-bit non-zero tag of keys given as an (n, 2) array of unsigned longs."""
    tag = (keys[:, 1] >> np.uint64(48)).astype(np.uint16)
    return keys[:, 0], np.where(tag == 0, np.uint16(1), tag)


class CuckooFilter:
    """A table of ``buckets`` (a power of two) times four 16-bit tags; a tag lies in one of two buckets.

    ``contains`` has no false negatives for keys that were inserted and not deleted; false positives are about
    8 in 65,536 at full load.  ``delete`` takes out one copy of a key's tag, so deleting only what was inserted keeps the
    others found.
    """

    def __init__(self, expected: int = 0, data: bytes | None = None):
        if data is not None:
            self.table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        else:
            need = max(1, int(expected / (SLOTS * LOAD)) + 1)
            self.table = np.zeros((1 << (need - 1).bit_length(), SLOTS), np.uint16)

    @property
    def mask(self) -> np.uint64:
        return np.uint64(len(self.table) - 1)

    def _other(self, bucket: np.ndarray, tag: np.ndarray) -> np.ndarray:
        return (bucket ^ (tag.astype(np.uint64) * np.uint64(0x5BD1E995))) & self.mask

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h, tag = _split(keys)
        one = h & self.mask
        return (self.table[one] == tag[:, None]).any(1) | (self.table[self._other(one, tag)] == tag[:, None]).any(1)

    def insert(self, keys: np.ndarray, rounds: int = 400) -> bool:
        """Insert keys; False, with the table unchanged, if they don't fit (build a larger one from the exact table)."""
        before, rng = self.table.copy(), np.random.default_rng(len(self.table))
        h, tag = _split(keys)
        at = h & self.mask
        for _ in range(rounds):
            if not len(at):
                return True
            order = np.argsort(at, kind="stable")
            at, tag = at[order], tag[order]
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            free = (self.table[at] == 0).sum(1)
            fits = rank < free
            # the rank-th free slot of a bucket
            slot = np.argsort(self.table[at[fits]] != 0, axis=1, kind="stable")[np.arange(int(fits.sum())), rank[fits]]
            self.table[at[fits], slot] = tag[fits]
            at, tag, rank, free = at[~fits], tag[~fits], rank[~fits], free[~fits]
            # in a full bucket one waiting key takes a slot, and what was there goes on to its other bucket
            kick = np.zeros(len(at), bool)
            kick[np.unique(at, return_index=True)[1]] = True
            kick &= (self.table[at] != 0).all(1)
            where = rng.integers(0, SLOTS, len(at))
            out = self.table[at[kick], where[kick]]
            self.table[at[kick], where[kick]], tag[kick] = tag[kick], out
            at = self._other(at, tag)
        self.table = before
        return False

    def delete(self, keys: np.ndarray) -> int:
        """Take one copy of each key's tag out; the number of keys that were found."""
        h, tag = _split(keys)
        found = 0
        for one, two, t in zip((h & self.mask).tolist(), self._other(h & self.mask, tag).tolist(), tag.tolist()):
            for bucket in (one, two):
                slot = np.flatnonzero(self.table[bucket] == t)
                if len(slot):
                    self.table[bucket, slot[0]] = 0
                    found += 1
                    break
        return found

    def to_bytes(self) -> bytes:
        return self.table.tobytes()


def build(keys: np.ndarray) -> CuckooFilter:
    """A filter with all keys, grown until they fit."""
    expected = len(keys)
    while True:
        made = CuckooFilter(expected)
        if made.insert(keys):
            return made
        expected = max(8, expected * 2)
