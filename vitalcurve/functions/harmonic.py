"""Sums of reciprocals over a run of integers, in closed form.

The tie-corrected hazard step for d deaths among n at risk is
``1/n + 1/(n-1) + ... + 1/(n-d+1)``. Below ``_HEAD`` the terms are added one by
one; above it the asymptotic series of the digamma and trigamma functions is
used, written on differences so nothing cancels. The cost per row is therefore
constant however many deaths fall on one day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEAD = 32


def _run(n: Column, d: Column, term: Callable, tail: Callable) -> Column:
    low = n - d
    top_of_head = F.least(n, F.lit(_HEAD))
    head = F.when(
        low < top_of_head,
        F.aggregate(
            F.sequence(low + 1, top_of_head),
            F.lit(0.0),
            lambda acc, k: acc + term(k.cast("double")),
        ),
    ).otherwise(F.lit(0.0))
    start = F.greatest(low, F.lit(_HEAD))
    a = (start + 1).cast("double")
    b = (n + 1).cast("double")
    rest = F.when(n > start, tail(a, b)).otherwise(F.lit(0.0))
    # sequence(x, x-1) counts down, so runs without a term must not reach it.
    return F.when(d > 0, head + rest).when(d == 0, F.lit(0.0))


def reciprocal_sum(n: Column, d: Column) -> Column:
    """Sum of 1/k for k in (n-d, n]; n and d are bigint columns, 0 <= d <= n."""

    def tail(a: Column, b: Column) -> Column:
        gap = b - a
        return (
            F.log1p(gap / a)
            + gap / (2 * a * b)
            + (a**-2 - b**-2) / 12
            - (a**-4 - b**-4) / 120
            + (a**-6 - b**-6) / 252
        )

    return _run(n, d, lambda k: F.lit(1.0) / k, tail)


def reciprocal_square_sum(n: Column, d: Column) -> Column:
    """Sum of 1/k^2 for k in (n-d, n]."""

    def tail(a: Column, b: Column) -> Column:
        gap = b - a
        return (
            gap / (a * b)
            + gap * (a + b) / (2 * a * a * b * b)
            + (a**-3 - b**-3) / 6
            - (a**-5 - b**-5) / 30
            + (a**-7 - b**-7) / 42
        )

    return _run(n, d, lambda k: F.lit(1.0) / (k * k), tail)
