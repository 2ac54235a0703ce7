"""Approximate quantiles and counts of units from states that are stored and merged.

A state is a sketch in one binary value per group: tasks build one each, the
shuffle merges them, and states of different days, files or regions merge later
without the rows they came from. The size of a state is bounded by its
parameter, whatever the group holds. The exact forms (``exact_quantiles``,
``median_survival``) remain the default; these are for groups whose distinct
values are too many to shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contract import PANEL, PanelSpec
from ..functions.columns import all_present, as_long, as_text, require_columns

QUANTILE_SIZE = 400
COUNT_BITS = 12


def quantile_rank_error(size: int = QUANTILE_SIZE) -> float:
    """How far the rank of an approximate quantile is off, as a share of the group, in 99 of 100 cases."""
    # The published error of this sketch (KLL), one-sided, at 99 % confidence.
    return 2.296 / size**0.9723


def unit_count_error(bits: int = COUNT_BITS) -> float:
    """Relative standard error of a count from merged states."""
    # Fixed value: the published error of a merged HyperLogLog sketch.
    return 1.04 / 2 ** (bits / 2)


def quantile_states(df: DataFrame, keys: Sequence[str], value: str, size: int = QUANTILE_SIZE) -> DataFrame:
    """Per key group: ``n``, ``low``, ``high`` and ``state``, a mergeable sketch of the values.

    ``size`` (8 to 65,535) sets the rank error (``quantile_rank_error``) and the
    bytes of a state, some 12 per unit of it. Null and NaN values are left out,
    and so are rows with a null key. A group of fewer values than ``size`` is
    held whole.
    """
    if not 8 <= size <= 65_535:
        raise ValueError("size must be between 8 and 65535")
    require_columns(df, *keys, value)
    v = F.col("_v")
    points = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(all_present([*keys, "_v"]) & ~F.isnan("_v"))
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
        F.kll_sketch_agg_double(v, size).alias("state"),
    )


def merge_quantile_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One state per key group from any number of stored ones; ``keys`` may be fewer than those they were made by."""
    require_columns(states, *keys, "n", "low", "high", "state")
    return states.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.kll_merge_agg_double("state").alias("state"),
    )


def quantiles_of_states(states: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Per row: ``n``, ``low``, ``high`` and ``q0``, ``q1``, ... for ``probs``; the values are ones that occurred."""
    require_columns(states, *keys, "n", "low", "high", "state")
    if not all(0 <= p <= 1 for p in probs):
        raise ValueError("probabilities must be between 0 and 1")
    quantiles = [F.kll_sketch_get_quantile_double("state", F.lit(float(p))).alias(f"q{i}") for i, p in enumerate(probs)]
    return states.select(*keys, "n", "low", "high", *quantiles)


def approximate_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], size: int = QUANTILE_SIZE
) -> DataFrame:
    """As ``exact_quantiles`` without moments, from sketches: one map-side combined aggregate, a row per task and group shuffled."""
    return quantiles_of_states(quantile_states(df, keys, value, size), keys, probs)


def _countable(df: DataFrame, name: str) -> Column:
    whole = isinstance(df.schema[name].dataType, T.IntegerType | T.LongType | T.StringType | T.BinaryType)
    return F.col(name) if whole else F.col(name).cast("string")


def unit_count_states(
    df: DataFrame, group: str, by_day: bool = True, bits: int = COUNT_BITS, spec: PanelSpec = PANEL
) -> DataFrame:
    """Per group and day: ``units``, a mergeable sketch of its distinct units, and ``null_unit``, whether one is null.

    States of single days merge to any range of days. A null group or day is a
    group or day of its own. ``by_day=False``: one state per group.
    """
    if not 4 <= bits <= 21:
        raise ValueError("bits must be between 4 and 21")
    require_columns(df, spec.unit, group, *([spec.time] if by_day else []))
    day = [as_long(df, spec.time).alias(spec.time)] if by_day else []
    rows = df.select(as_text(df, group).alias(group), *day, _countable(df, spec.unit).alias("_unit"))
    return rows.groupBy(group, *([spec.time] if by_day else [])).agg(
        F.hll_sketch_agg("_unit", bits).alias("units"), F.max(F.col("_unit").isNull()).alias("null_unit")
    )


def merge_unit_counts(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One state per key group; merged states may differ in bits, the fewest count."""
    require_columns(states, *keys, "units", "null_unit")
    return states.groupBy(*keys).agg(F.hll_union_agg("units", True).alias("units"), F.max("null_unit").alias("null_unit"))


def unit_counts(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per row ``n_units``, about the number of distinct units; a null unit counts as one."""
    require_columns(states, *keys, "units", "null_unit")
    count = F.hll_sketch_estimate("units") + F.col("null_unit").cast("bigint")
    return states.select(*keys, count.alias("n_units"))
