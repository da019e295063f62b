"""A cuckoo filter: approximate membership with insertion and deletion."""

from __future__ import annotations

import struct

import numpy as np

SLOTS = 4
MAX_KICKS = 200


class Full(Exception):
    """An insertion found no place; the owner of the keys has to resize."""


def _scatter(fp: int, mask: int) -> int:
    return (fp * 0x5BD1E995) & mask


class CuckooFilter:
    """16-bit fingerprints in buckets of four; ``key`` is any integer below 2**64 that is already well mixed.

    A key that was inserted is always found; another key is found with a probability of about 8 / 65536.  Inserting
    one key twice stores it twice, so deletions mirror insertions.
    """

    def __init__(self, capacity: int):
        self.buckets = 1 << max(1, (max(1, capacity) * 100 // (SLOTS * 84)).bit_length())
        self.table = [0] * (self.buckets * SLOTS)
        self.live = 0

    def _place(self, key: int) -> tuple[int, int, int]:
        mask = self.buckets - 1
        fp = (key & 0xFFFF) or 1
        a = (key >> 16) & mask
        return fp, a, a ^ _scatter(fp, mask)

    def __contains__(self, key: int) -> bool:
        fp, a, b = self._place(key)
        t = self.table
        return fp in t[a * SLOTS : a * SLOTS + SLOTS] or fp in t[b * SLOTS : b * SLOTS + SLOTS]

    def insert(self, key: int) -> None:
        fp, a, b = self._place(key)
        t, mask = self.table, self.buckets - 1
        for at in (a, b):
            for i in range(at * SLOTS, at * SLOTS + SLOTS):
                if not t[i]:
                    t[i] = fp
                    self.live += 1
                    return
        trail, at = [], a if fp & 1 else b
        for kick in range(MAX_KICKS):
            i = at * SLOTS + (fp + kick) % SLOTS
            trail.append((i, t[i]))
            fp, t[i] = t[i], fp
            at ^= _scatter(fp, mask)
            for j in range(at * SLOTS, at * SLOTS + SLOTS):
                if not t[j]:
                    t[j] = fp
                    self.live += 1
                    return
        for i, old in reversed(trail):  # leave it as it was
            t[i] = old
        raise Full(f"{self.live} keys in {len(t)} slots")

    def delete(self, key: int) -> bool:
        """Remove one copy of an inserted key.  Deleting a key that was never inserted may harm another."""
        fp, a, b = self._place(key)
        for at in (a, b):
            for i in range(at * SLOTS, at * SLOTS + SLOTS):
                if self.table[i] == fp:
                    self.table[i] = 0
                    self.live -= 1
                    return True
        return False

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """Membership of many uint64 keys at once."""
        return View(self.to_bytes()).probe(keys)

    @classmethod
    def of(cls, keys, capacity: int = 0) -> CuckooFilter:
        """A filter of stored keys; it grows until all of them have a place."""
        keys = list(keys)
        size = max(len(keys), capacity, 8)
        while True:
            out = cls(size)
            try:
                for k in keys:
                    out.insert(k)
                return out
            except Full:
                size *= 2

    def to_bytes(self) -> bytes:
        return struct.pack("<II", self.buckets, self.live) + np.array(self.table, "<u2").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls.__new__(cls)
        out.buckets, out.live = struct.unpack_from("<II", data)
        out.table = np.frombuffer(data, "<u2", offset=8).tolist()
        return out


class View:
    """A filter that is only read, from its bytes."""

    def __init__(self, data: bytes):
        self.buckets = struct.unpack_from("<I", data)[0]
        self.table = np.frombuffer(data, "<u2", offset=8).reshape(self.buckets, SLOTS)

    def probe(self, keys: np.ndarray) -> np.ndarray:
        mask = np.uint64(self.buckets - 1)
        fp = keys & np.uint64(0xFFFF)
        fp[fp == 0] = 1
        a = (keys >> np.uint64(16)) & mask
        b = a ^ ((fp * np.uint64(0x5BD1E995)) & mask)
        f = fp.astype(np.uint16)[:, None]
        return (self.table[a.astype(np.int64)] == f).any(1) | (self.table[b.astype(np.int64)] == f).any(1)
