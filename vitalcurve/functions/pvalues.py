"""Tail probabilities of Student's t and Fisher's F.

Spark has no such built-in, so this is the one place that leaves the JVM: an
Arrow UDF over rows that are already one per group.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The functions below travel with the job: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# From this parameter on the integral is taken by quadrature, whose cost does not grow.
_LARGE = 1e4
# Parts of the range of the integral, nodes and weights in each, and how far (in logarithms) the tail is followed.
_PARTS, _REACH = 64, 50.0
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(32)


def _log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated forwards."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 100_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for coefficient in (even, odd):
            d = 1.0 + coefficient * d
            c = 1.0 + coefficient / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return value
    return math.nan  # not settled: null in the table, rather than a value that may be wrong


def regularized_beta(a: float, b: float, x: float, y: float) -> float:
    """I_x(a, b); ``y`` is 1 - x, passed apart so that it keeps its precision."""
    if any(math.isnan(v) for v in (a, b, x, y)):
        return math.nan
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    if math.isinf(a) or math.isinf(b):
        return math.nan
    if max(a, b) > _LARGE:
        return _beta_tail(b, a, y, x, upper=True) if b <= a else _beta_tail(a, b, x, y, upper=False)
    front = math.exp(a * _log(x, y) + b * _log(y, x) - _log_beta(a, b))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, y) / b


def _stirling_rest(z: float) -> float:
    """What Stirling's formula lacks of the logarithm of the gamma function."""
    if z < 16:
        return math.lgamma(z) - ((z - 0.5) * math.log(z) - z + 0.5 * math.log(2 * math.pi))
    w = 1 / (z * z)
    return (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w / 1680))) / z


def _exp_rest(s: np.ndarray) -> np.ndarray:
    """exp(s) - 1 - s without cancellation."""
    near = s * s * (1 / 2 + s * (1 / 6 + s * (1 / 24 + s * (1 / 120 + s * (1 / 720 + s / 5040)))))
    return np.where(np.abs(s) < 0.02, near, np.expm1(s) - s)


def _log_rest(z: np.ndarray) -> np.ndarray:
    """z - log(1 + z) without cancellation."""
    near = z * z * (1 / 2 - z * (1 / 3 - z * (1 / 4 - z * (1 / 5 - z * (1 / 6 - z * (1 / 7 - z / 8))))))
    return np.where(np.abs(z) < 0.01, near, z - np.log1p(z))


def _beta_tail(p: float, q: float, x: float, y: float, upper: bool) -> float:
    """Probability that a beta variable with p <= q exceeds x (``upper``) or does not; ``y`` is 1 - x.

    Integrates over s, the logit of the variable less that of its mean. There
    the density is its value at 0, which Stirling's formula gives, times
    exp(-D(s)) with D = p (e^s - 1 - s) - (p + q) (z - log(1 + z)) for
    z = (e^s - 1) p / (p + q): no term cancels, however large p and q are.
    """
    n = p + q
    share = p / n
    start = math.log(x) - math.log(y) - (math.log(p) - math.log(q))

    def depth(s: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            found = p * _exp_rest(s) - n * _log_rest(share * np.expm1(s))
        return np.where(np.isnan(found), np.inf, found)

    # As far as it matters: beyond the start, and the mean if that lies behind it.
    sign = 1.0 if upper else -1.0
    most = depth(np.array([0.0 if sign * start < 0 else start]))[0]
    if not most < 700:
        return 0.0
    width = 1 / math.sqrt(p)
    begin = max(start * sign, -_far(lambda d: depth(np.array([-sign * d]))[0], width, most)) * sign
    origin = max(sign * begin, 0.0)
    end = sign * (origin + _far(lambda d: depth(np.array([sign * (origin + d)]))[0], width, most))
    edges = np.linspace(begin, end, _PARTS + 1)
    half = (edges[1:] - edges[:-1])[:, None] / 2
    points = (edges[1:] + edges[:-1])[:, None] / 2 + half * _NODES
    area = abs(float((np.exp(-depth(points)) * _WEIGHTS * half).sum()))
    top = 0.5 * (math.log(p) + math.log(q) - math.log(n) - math.log(2 * math.pi))
    return min(1.0, math.exp(top + _stirling_rest(n) - _stirling_rest(p) - _stirling_rest(q)) * area)


def _far(depth, step: float, least: float) -> float:
    """A distance at which ``depth`` exceeds ``least`` by the reach, not much more than needed."""
    far = step
    while depth(far) < least + _REACH:
        far *= 1.3
    return far


def _log(x: float, one_minus_x: float) -> float:
    return math.log1p(-one_minus_x) if one_minus_x < 0.5 else math.log(x)


@F.pandas_udf(T.DoubleType())
def _regularized_beta(
    batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]],
) -> Iterator[pd.Series]:
    for a, b, x, y in batches:
        rows = zip(*(s.to_numpy(dtype=np.float64, na_value=np.nan) for s in (a, b, x, y)))
        # NaN leaves as null.
        yield pd.Series([regularized_beta(*row) for row in rows], dtype="float64")


def student_t_two_sided(t: Column, dof: Column) -> Column:
    """P(|T| >= |t|). An infinite t gives 0; null or NaN gives null."""
    square = t * t
    p = _regularized_beta(
        dof / 2.0,
        F.lit(0.5),
        F.try_divide(dof, dof + square),
        F.try_divide(square, dof + square),
    )
    return F.when(F.abs(t) == F.lit(float("inf")), F.lit(0.0)).otherwise(p)


def fisher_f_upper(f: Column, d1: Column, d2: Column) -> Column:
    """P(F >= f). An infinite f gives 0; null or NaN gives null."""
    total = d2 + d1 * f
    p = _regularized_beta(
        d2 / 2.0,
        d1 / 2.0,
        F.try_divide(d2, total),
        F.try_divide(d1 * f, total),
    )
    return F.when(f == F.lit(float("inf")), F.lit(0.0)).otherwise(p)
