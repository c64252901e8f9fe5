"""MurmurHash3 (x86, 32 bits) of UTF-8 text as a column expression, with the buckets of hashing vectorisers that use it.

Spark's own ``hash`` has another rule for the last bytes, so its numbers differ. Products are cut in halves of 16 bits, as a product of two
32-bit numbers does not fit a long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the algorithm: multipliers of blocks, the addend of a round, multipliers at the end.
C1, C2, ADD, END1, END2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35
_MASK = 0xFFFFFFFF


def _with(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.transform(F.array(x), f)[0]


def _times(x: Column, c: int) -> Column:
    low = x.bitwiseAND(0xFFFF) * F.lit(c)
    high = (F.shiftright(x, 16) * F.lit(c)).bitwiseAND(0xFFFF)
    return (low + F.shiftleft(high, 16)).bitwiseAND(_MASK)


def _turned(x: Column, r: int) -> Column:
    return _with(x, lambda v: F.shiftleft(v, r).bitwiseAND(_MASK).bitwiseOR(F.shiftright(v, 32 - r)))


def _mixed(k: Column) -> Column:
    return _times(_turned(_times(k, C1), 15), C2)


def _number(digits: Column, start: Column, size: int) -> Column:
    """``size`` bytes from hexadecimal digits, the first byte least."""
    parts = [F.substring(digits, start + 2 * i, F.lit(2)) for i in reversed(range(size))]
    return F.conv(F.concat(*parts), 16, 10).cast("long")


def murmur3(text: Column, seed: int = 0) -> Column:
    """The hash as a signed integer (long); null for null."""

    def whole(digits: Column) -> Column:
        n = F.length(digits) / 2
        blocks = F.floor(n / 4)
        places = F.when(blocks > 0, F.sequence(F.lit(0).cast("long"), F.greatest(blocks - 1, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))

        def step(h: Column, i: Column) -> Column:
            k = _mixed(_number(digits, (i * 8 + 1).cast("int"), 4))
            return (_turned(h.bitwiseXOR(k), 13) * 5 + ADD).bitwiseAND(_MASK)

        h = F.aggregate(places, F.lit(seed).cast("long"), step)
        at, left = (blocks * 8 + 1).cast("int"), n - blocks * 4
        tail = F.lit(0).cast("long")
        for size in (1, 2, 3):
            tail = F.when(left == size, _mixed(_number(digits, at, size))).otherwise(tail)
        h = h.bitwiseXOR(tail).bitwiseXOR(n.cast("long"))
        h = _with(h, lambda v: _times(v.bitwiseXOR(F.shiftright(v, 16)), END1))
        h = _with(h, lambda v: _times(v.bitwiseXOR(F.shiftright(v, 13)), END2))
        h = _with(h, lambda v: v.bitwiseXOR(F.shiftright(v, 16)))
        return _with(h, lambda v: F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v))

    return _with(F.hex(F.encode(text, "UTF-8")), whole)


def murmur_bucket(token: Column, dimensions: int) -> Column:
    """Position of a token in a hashed vector: the hash without its sign."""
    return F.pmod(F.abs(murmur3(token)), F.lit(dimensions)).cast("int")
