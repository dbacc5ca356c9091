"""A cuckoo filter: approximate membership in two bytes a key, with deletion."""

from __future__ import annotations

from array import array

SLOTS, KICKS = 4, 500


class Full(Exception):
    """No slot was found; make the filter anew with more buckets."""


class CuckooFilter:
    """Keys are digests of 16 bytes. Every key added is found; others are found with a chance of about 1 in 8,000."""

    def __init__(self, buckets: int, cells: bytes | None = None):
        self.buckets = 1 << max(1, (buckets - 1).bit_length())
        self.cells = array("H", cells if cells is not None else bytes(2 * SLOTS * self.buckets))

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        buckets = max(2, len(keys) * 10 // (9 * SLOTS) + 1)
        while True:
            made = cls(buckets)
            try:
                for k in keys:
                    made.add(k)
                return made
            except Full:
                buckets = made.buckets * 2

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(len(data) // (2 * SLOTS), data)

    def dump(self) -> bytes:
        return self.cells.tobytes()

    def _spots(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:10], "big") or 1
        one = int.from_bytes(key[:8], "big") & (self.buckets - 1)
        return mark, one, self._other(one, mark)

    def _other(self, spot: int, mark: int) -> int:
        return (spot ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def _put(self, spot: int, mark: int) -> bool:
        for i in range(spot * SLOTS, spot * SLOTS + SLOTS):
            if not self.cells[i]:
                self.cells[i] = mark
                return True
        return False

    def add(self, key: bytes) -> None:
        mark, one, two = self._spots(key)
        if self._put(one, mark) or self._put(two, mark):
            return
        spot = one
        for k in range(KICKS):
            i = spot * SLOTS + (k * 7 + mark) % SLOTS
            mark, self.cells[i] = self.cells[i], mark
            spot = self._other(spot, mark)
            if self._put(spot, mark):
                return
        raise Full

    def remove(self, key: bytes) -> bool:
        """Only keys that were added may be removed."""
        mark, *spots = self._spots(key)
        for spot in spots:
            for i in range(spot * SLOTS, spot * SLOTS + SLOTS):
                if self.cells[i] == mark:
                    self.cells[i] = 0
                    return True
        return False

    def __contains__(self, key: bytes) -> bool:
        mark, one, two = self._spots(key)
        cells, one, two = self.cells, one * SLOTS, two * SLOTS
        return mark in cells[one : one + SLOTS] or mark in cells[two : two + SLOTS]
