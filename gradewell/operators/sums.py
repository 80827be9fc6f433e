"""Sums of doubles that are the same to the last bit however the rows are laid out.

A double is cut into parts by adding and taking off a large constant: the first
part is a whole multiple of a unit so coarse that the sum of all rows' parts needs
no rounding, the next part the same of what is left, and so on. Every partial sum
is then exact, so tasks may add them up in any order. How coarse the units must be
follows from the number of rows and a bound on the values, which one scan gives.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.columns import as_number

# Bits of the largest value below which nothing is added up any more.
KEPT_BITS = 64
# Columns per aggregate of the first scan.
RANGES_PER_PASS = 200


def units(bound: float, rows: int) -> list[float]:
    """The constants that cut values of at most `bound` into parts, `rows` of which add up without rounding."""
    if not bound or not math.isfinite(bound):
        return []
    spare = max(rows, 1).bit_length() + 1
    top = math.frexp(bound)[1]  # bound <= 2 ** top
    constants, have = [], 0
    while have < KEPT_BITS:
        exponent = top - have + spare
        if not -900 < exponent < 1000:
            break
        constants.append(1.5 * 2.0**exponent)
        have += 52 - spare
    return constants


def exact_sum(value: Column, bound: float, rows: int) -> Column:
    """An aggregate: the sum of `value` over at most `rows` rows, of which none is beyond `bound` in size."""
    sums, left = [], value
    for constant in units(bound, rows):
        part = (left + F.lit(constant)) - F.lit(constant)
        sums.append(F.sum(part))
        left = left - part
    return reduce(add, reversed(sums)) if sums else F.sum(value * F.lit(0.0))


def ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, float | None, float | None]]:
    """name -> (values present, smallest, largest) of numeric columns, from one scan for every RANGES_PER_PASS."""
    found = {}
    for low in range(0, len(columns), RANGES_PER_PASS):
        names = list(columns[low : low + RANGES_PER_PASS])
        narrow = df.select(*[as_number(df, c).alias(f"x{i}") for i, c in enumerate(names)])
        row = narrow.agg(*[f(f"x{i}").alias(f"{k}{i}") for i in range(len(names)) for k, f in (("n", F.count), ("a", F.min), ("b", F.max))]).first()
        found |= {c: (row[f"n{i}"], row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(names)}
    return found


def middle(span: tuple[int, float | None, float | None]) -> float | None:
    """Half way between the ends, null where there are none or they are not finite."""
    _, low, high = span
    if low is None or not math.isfinite(low) or not math.isfinite(high):
        return None
    return low / 2.0 + high / 2.0


