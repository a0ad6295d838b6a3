"""Comparison of series held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dtw(x: str, y: str) -> Column:
    """Dynamic time warping cost of two arrays of doubles: sum of absolute differences along the best path.

    One fold over x holds one row of the cost table; a nested fold over y builds
    the next. Two empty series cost 0, one empty series costs infinity.
    """
    inf = F.lit(float("inf"))
    first = F.concat(F.array(F.lit(0.0)), F.transform(F.col(y), lambda _: inf))

    def next_row(row: Column, v: Column) -> Column:
        start = F.array(inf)
        cells = F.transform(F.col(y), lambda w, j: F.struct(F.abs(v - w).alias("c"), F.least(F.get(row, j), F.get(row, j + 1)).alias("b")))
        return F.aggregate(cells, start, lambda acc, e: F.concat(acc, F.array(e["c"] + F.least(e["b"], F.element_at(acc, -1)))))

    return F.element_at(F.aggregate(F.col(x), first, next_row), -1)
