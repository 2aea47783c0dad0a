"""Ranges of arrival numbers with about equally many rows, however the numbers are spread.

Numbers may be dense or leave gaps of any size (a packet's lines, for example, leave room for 2^20). So ranges are cut at quantiles
of the numbers that are there, not at fixed widths: a range bounds what one window, and so one task, has to hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one range, and the most ranges of one input.
RANGE_ROWS, MOST_RANGES = 1_000_000, 4096


def range_ends(df: DataFrame, column: str = "seq", rows: int = RANGE_ROWS, most: int = MOST_RANGES) -> list[int]:
    """The last numbers of all ranges but the last one; one aggregate over ``column`` that comes down to one row.

    Where the cuts lie decides how even ranges are, never what comes out of an operator.
    """
    steps = [k / most for k in range(1, most)]
    found = df.agg(F.count(column).alias("n"), F.percentile_approx(column, steps, 4 * most).alias("at")).first()
    parts = min(most, -(-found["n"] // rows))
    return sorted({found["at"][most * k // parts - 1] for k in range(1, parts)})


def range_of(number: Column, ends: list[int]) -> Column:
    """Which range ``number`` lies in, from 0 on: a binary search in the literal ``ends``."""
    if not ends:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(ends).bit_length()))]
    known = F.lit(ends)
    # Past the end of the array the comparison is null, and the step isn't taken.
    return F.aggregate(
        F.lit(steps), F.lit(0), lambda place, step: F.when(F.get(known, place + step - 1) < number, place + step).otherwise(place)
    )
