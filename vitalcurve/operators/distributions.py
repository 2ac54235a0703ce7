"""Distribution of one metric per unit by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contract import CRITICAL_DAY, PANEL, PanelSpec
from ..functions.columns import is_finite, keep_groups
from .quantiles import exact_quantiles, exact_quantiles_of
from .reductions import metric_per_unit, steepest_decline_per_unit
from .summaries import UnitSummary

Wanted = Sequence | DataFrame | None


def distribution_points(
    df: DataFrame | UnitSummary,
    metric: str,
    group: str,
    wanted: Wanted = None,
    spec: PanelSpec = PANEL,
) -> DataFrame:
    """(unit, metric, group). The filter acts on a unit's first group, not on rows."""
    return keep_groups(metric_per_unit(df, metric, group, spec), group, wanted)


def distribution_box(
    df: DataFrame | UnitSummary,
    metric: str,
    group: str,
    wanted: Wanted = None,
    spec: PanelSpec = PANEL,
) -> DataFrame:
    """Count, extremes, exact quartiles and 1.5 IQR fences per group. NaN is left out."""
    points = distribution_points(df, metric, group, wanted, spec)
    reach = 1.5 * (F.col("q2") - F.col("q0"))
    return (
        exact_quantiles(points, [group], metric, (0.25, 0.5, 0.75), moments=False)
        .select(
            group,
            "n",
            F.col("low").alias("minimum"),
            F.col("q0").alias("q1"),
            F.col("q1").alias("median"),
            F.col("q2").alias("q3"),
            F.col("high").alias("maximum"),
            (F.col("q0") - reach).alias("lower_fence"),
            (F.col("q2") + reach).alias("upper_fence"),
        )
        .orderBy(group)
    )


def distribution_histogram(
    df: DataFrame,
    metric: str,
    group: str,
    width: float,
    start: float = 0.0,
    wanted: Wanted = None,
    spec: PanelSpec = PANEL,
) -> DataFrame:
    """Units per group and bin [start + bin * width, start + (bin + 1) * width); values that are not finite have none."""
    if not width > 0:
        raise ValueError("width must be positive")
    points = distribution_points(df, metric, group, wanted, spec)
    v = F.col(metric).cast("double")
    bin_no = F.floor((v - start) / width)
    return (
        points.filter(is_finite(v))
        .groupBy(F.col(group), bin_no.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(group, "bin", (F.col("bin") * width + start).alias("bin_start"), "n")
        .orderBy(group, "bin")
    )


def critical_period_stats(
    df: DataFrame | UnitSummary, group: str | None = None, spec: PanelSpec = PANEL
) -> DataFrame:
    """Mean, exact median and deviation of the steepest-decline day and size by group.

    A unit whose changes are all NaN counts with its day, not with its size.
    """
    group = group or spec.density
    units = steepest_decline_per_unit(df, group, spec).select(
        group, F.col(CRITICAL_DAY).cast("double").alias(CRITICAL_DAY), "max_decline"
    )
    stats = exact_quantiles_of(units, [group], [CRITICAL_DAY, "max_decline"], (0.5,))
    day, size = F.col(CRITICAL_DAY), F.col("max_decline")
    return stats.select(
        group,
        day["n"].alias("n_units"),
        day["mean"].alias("mean_critical_day"),
        day["q0"].alias("median_critical_day"),
        day["sd"].alias("sd_critical_day"),
        size["mean"].alias("mean_max_decline"),
        size["q0"].alias("median_max_decline"),
        size["sd"].alias("sd_max_decline"),
    ).orderBy(group)
