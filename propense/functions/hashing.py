"""A seeded uniform draw per row that gives the same value in every engine and every retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A prime below 2**31, so that products stay within 64 bits, and multipliers.
PRIME = 2147483647
FIRST = 48271
SECOND = 69621


def draw(seed: int, *keys: Column) -> Column:
    """A number in [0, PRIME) from up to two integer keys, mixed by two squarings."""
    first, *rest = [F.pmod(k.cast("bigint"), F.lit(PRIME)) for k in keys]
    total = first * FIRST + F.lit(seed)
    for key in rest:
        total = total + key * SECOND
    once = total % PRIME
    twice = (once * once + once + FIRST) % PRIME
    return (twice * twice + once * SECOND + SECOND) % PRIME
