"""Gaps of positions as Column expressions; variable-length and little-endian integers as bytes."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


def gaps(positions: Column) -> Column:
    """First position, then differences."""
    return F.transform(positions, lambda p, i: p - F.when(i > 0, F.get(positions, i - 1)).otherwise(0))


def from_gaps(deltas: Column) -> Column:
    """Positions by running sums."""
    start = F.array().cast("array<int>")
    return F.aggregate(deltas, start, lambda acc, d: F.concat(acc, F.array((F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + d).cast("int"))))


def varint(n: int) -> bytes:
    """Seven bits a byte, the lowest first, the high bit on all but the last."""
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


class Reader:
    """Reads the binary index's integers, floats and strings from bytes; short input raises ``ValueError``."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the index file ends too soon")
        self.at += n
        return self.data[self.at - n : self.at]

    def fixed(self, kind: str):
        return struct.unpack(f"<{kind}", self.take(struct.calcsize(f"<{kind}")))[0]

    def varint(self) -> int:
        value = shift = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    def string(self) -> str:
        return self.take(self.fixed("Q")).decode("utf-8", "replace")
