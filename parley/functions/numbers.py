"""Rules over one number, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into two parts whose products with a small power of ten are exact.
SPLIT = float(1 << 26)
EXACT = 32_768.0


def round_binary(value: Column, digits: int) -> Column:
    """``value`` rounded to ``digits`` (up to 4) by its exact binary value, half to even.

    Spark's ``round`` works on the shortest decimal text, where 0.5055 is a tie; its binary value lies below one. Beyond
    ``EXACT`` the products are not exact any more, and the decimal text decides.
    """
    scale = 10**digits
    top = F.floor(value * SPLIT) / SPLIT
    below = F.floor(value * scale)
    # is twice the scaled value above, at or below the odd number between two neighbours?
    to_middle, rest = 2 * below + 1 - top * (2 * scale), (value - top) * (2 * scale)
    up = (rest > to_middle) | ((rest == to_middle) & (F.pmod(below, F.lit(2)) == 1))
    exact = (below + up.cast("int")) / F.lit(float(scale))
    return F.when(F.abs(value) <= EXACT, exact).otherwise(F.round(value, digits))
