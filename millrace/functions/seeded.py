"""64-bit mixing of ids and seeded waits, in column expressions that wrap around without ANSI errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Increment and multipliers of SplitMix64.
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_M = 0xFFFFFFFF


def _halves(x: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(x, 32), x.bitwiseAND(_M)


def _joined(high: Column, low: Column) -> Column:
    return F.shiftleft(high.bitwiseAND(_M), 32).bitwiseOR(low.bitwiseAND(_M))


def plus(x: Column, c: int) -> Column:
    """x + c modulo 2^64."""
    high, low = _halves(x)
    s = low + (c & _M)
    return _joined(high + (c >> 32) + F.shiftright(s, 32), s)


def times(x: Column, c: int) -> Column:
    """x * c modulo 2^64: the low half is multiplied in two steps of 16 bits, so no product passes 2^49."""
    high, low = _halves(x)

    def steps(a: Column, by: int) -> tuple[Column, Column]:
        lower, upper = a.bitwiseAND(0xFFFF) * by, F.shiftright(a, 16) * by
        s = lower + F.shiftleft(upper.bitwiseAND(0xFFFF), 16)
        return F.shiftright(s, 32) + F.shiftright(upper, 16), s.bitwiseAND(_M)

    over, least = steps(low, c & _M)
    return _joined(over + steps(high, c & _M)[1] + steps(low, c >> 32)[1], least)


def _folded(x: Column, by: int) -> Column:
    return x.bitwiseXOR(F.shiftrightunsigned(x, by))


def mix64(x: Column) -> Column:
    """One round of SplitMix64 over a bigint, as the bigint of the same bits."""
    x = plus(x.cast("bigint"), STEP)
    return _folded(times(_folded(times(_folded(x, 30), FIRST), 27), SECOND), 31)


def xorshift(seed: Column) -> Column:
    s = seed.cast("bigint").bitwiseOR(1)
    s = s.bitwiseXOR(F.shiftleft(s, 13))
    s = _folded(s, 7)
    return s.bitwiseXOR(F.shiftleft(s, 17))


def unsigned_mod(x: Column, n: Column) -> Column:
    """The bits of x as an unsigned number, modulo n below 2^31."""
    high, low = _halves(x)
    return ((high % n) * (F.lit(1 << 32) % n) + low) % n


def jittered_wait(failures: Column, seed: Column, first_ms: int, most_ms: int) -> Column:
    """A wait that doubles with each failure up to a ceiling; the seed picks a value from its upper half."""
    times_doubled = F.least(F.greatest(failures - 1, F.lit(0)), F.lit(16)).cast("int")
    capped = F.least(F.lit(first_ms).cast("bigint") * F.element_at(F.array(*[F.lit(1 << k) for k in range(17)]), times_doubled + 1), F.lit(most_ms).cast("bigint"))
    half = F.floor(capped / 2)
    return half + unsigned_mod(xorshift(seed), capped - half + 1)
