"""Curves over time by group, and the per-unit lines behind them.

Group curves are one map-side combined aggregate on (group, day), so a group
that holds a third of the rows costs no more than its number of days. Small
curve tables come sorted; row-level results do not, sort them at the edge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import contract as C
from ..contract import PANEL, PanelSpec
from ..functions.columns import (
    all_present,
    as_double,
    as_long,
    as_text,
    clamp,
    keep_groups,
    require_columns,
    standard_error,
)
from .sketches import unit_count_states, unit_counts

Wanted = Sequence | DataFrame | None


def _clean(df: DataFrame, group: str, measure: str, spec: PanelSpec, wanted: Wanted) -> DataFrame:
    require_columns(df, spec.time, measure, group)
    rows = keep_groups(df, group, wanted).select(
        as_text(df, group).alias(group),
        as_long(df, spec.time).alias(spec.time),
        as_double(df, measure).alias(measure),
    )
    return rows.filter(all_present(rows.columns))


def _banded(
    rows: DataFrame,
    group: str,
    measure: str,
    spec: PanelSpec,
    band: str,
    floor: float | None = None,
    ceiling: float | None = None,
    min_count: int | None = None,
) -> DataFrame:
    cells = rows.groupBy(group, spec.time).agg(
        F.avg(measure).alias("mean"),
        F.stddev_samp(measure).alias("sd"),
        F.count(F.lit(1)).alias("n"),
    )
    if min_count is not None:
        cells = cells.filter(F.col("n") >= min_count)
    cells = cells.withColumn("se", standard_error(F.col("sd"), F.col("n")))
    upper = clamp(F.col("mean") + F.col(band), floor if ceiling is not None else None, ceiling)
    lower = clamp(F.col("mean") - F.col(band), floor, ceiling)
    spread = ["sd", "n"] if band == "sd" else ["sd", "n", "se"]
    return cells.select(
        group, spec.time, "mean", *spread, upper.alias("upper"), lower.alias("lower")
    )


def survival_curve(
    df: DataFrame, group: str, wanted: Wanted = None, spec: PanelSpec = PANEL
) -> DataFrame:
    """Mean survival by group and day with a band of one sample deviation inside 0-100."""
    rows = _clean(df, group, spec.survival, spec, wanted)
    return _banded(rows, group, spec.survival, spec, "sd", 0, 100).orderBy(group, spec.time)


def remaining_curve(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Mean remaining count by "housing - density" and day; lower band not below 0."""
    require_columns(df, spec.time, spec.remaining, spec.housing, spec.density)
    unknown = F.lit(C.MISSING_GROUP)
    group = "housing_density_group"
    labelled = df.withColumn(
        group,
        F.concat(
            F.coalesce(as_text(df, spec.housing), unknown),
            F.lit(" - "),
            F.coalesce(as_text(df, spec.density), unknown),
        ),
    )
    rows = _clean(labelled, group, spec.remaining, spec, None)
    return _banded(rows, group, spec.remaining, spec, "sd", floor=0).orderBy(group, spec.time)


def rate_change_curve(
    df: DataFrame,
    group: str | None = None,
    wanted: Wanted = None,
    min_count: int | None = None,
    spec: PanelSpec = PANEL,
) -> DataFrame:
    """Mean daily change by group and day with a band of one standard error.

    ``min_count`` drops cells with fewer rows (3 in the view by density).
    """
    group = group or spec.genotype_housing
    rows = _clean(df, group, spec.change, spec, wanted)
    cells = _banded(rows, group, spec.change, spec, "se", min_count=min_count)
    return cells.orderBy(group, spec.time)


def worst_day(
    df: DataFrame,
    group: str | None = None,
    wanted: Wanted = None,
    min_count: int = 3,
    spec: PanelSpec = PANEL,
) -> DataFrame:
    """Per group the day of the lowest mean change among cells of enough rows."""
    group = group or spec.density
    rows = _clean(df, group, spec.change, spec, wanted)
    cells = _banded(rows, group, spec.change, spec, "se", min_count=min_count)
    return (
        cells.groupBy(group)
        .agg(F.min(F.struct("mean", spec.time)).alias("_low"))
        .select(
            group,
            F.col("_low").getField(spec.time).alias("worst_day"),
            F.col("_low.mean").alias("worst_mean_change"),
        )
        .orderBy("worst_day", group)
    )


def median_survival(
    df: DataFrame,
    group: str,
    wanted: Wanted = None,
    threshold: float = 50.0,
    spec: PanelSpec = PANEL,
    unit_bits: int | None = None,
) -> DataFrame:
    """First day on which the group mean is at or below the threshold, and the unit count.

    ``median_day`` is null for a group that stays above it; ``median_day_text``
    then reads "> Max Day". Groups without any mean are left out. Nulls are not
    dropped first: a null group is a row of its own, with 0 units.

    ``unit_bits`` counts the units approximately, by sketches of that size (see
    ``unit_count_states``): the exact count shuffles every (group, unit) pair.
    """
    require_columns(df, spec.unit, spec.time, spec.survival, group)
    rows = keep_groups(df, group, wanted).select(
        F.col(spec.unit),
        as_text(df, group).alias(group),
        as_long(df, spec.time).alias("t"),
        as_double(df, spec.survival).alias("v"),
    )
    means = rows.groupBy(group, "t").agg(F.avg("v").alias("m"))
    reached = means.groupBy(group).agg(
        F.min(F.when(F.col("m") <= threshold, F.col("t"))).alias("median_day"),
        F.min("m").alias("_lowest"),
    )
    if unit_bits is not None:
        states = unit_count_states(rows, group, by_day=False, bits=unit_bits, spec=spec)
        units = unit_counts(states, [group]).withColumnRenamed("n_units", "_units")
    else:
        units = rows.groupBy(group).agg(
            # A null unit counts as one value.
            (
                F.count_distinct(spec.unit) + F.max(F.col(spec.unit).isNull().cast("bigint"))
            ).alias("_units")
        )
    day_text = F.when(F.col("_lowest") > threshold, C.NEVER_REACHED).otherwise(
        F.col("median_day").cast("string")
    )
    return (
        reached.filter(F.col("_lowest").isNotNull())
        .join(units, group, "left")
        .select(
            group,
            F.coalesce("_units", F.lit(0).cast("bigint")).alias("n_units"),
            "median_day",
            day_text.alias("median_day_text"),
        )
        .orderBy(group)
    )


def _lines(rows: DataFrame, group: str, measure: str, spec: PanelSpec) -> DataFrame:
    """Every row of a unit under each group the unit occurs in.

    The pairs are an aggregate of a few rows per unit; a unit with very many
    rows is split by the adaptive skew join.
    """
    pairs = (
        rows.groupBy(F.col(spec.unit).alias("_unit"), F.col(group).alias("_group"))
        .agg(F.min(spec.time).alias("_first"))
        .filter(all_present(["_unit", "_group", "_first"]))
    )
    return rows.join(pairs, F.col(spec.unit) == F.col("_unit")).select(
        spec.unit, F.col("_group").alias(group), spec.time, measure
    )


def unit_curves(
    df: DataFrame, group: str, wanted: Wanted = None, spec: PanelSpec = PANEL
) -> DataFrame:
    """Survival line of every unit, labelled with its group.

    Rows are filtered by group first; a unit that occurs in two groups has all
    its rows under both. A (unit, group) pair without any known day is left out.
    """
    require_columns(df, spec.unit, spec.time, spec.survival, group)
    rows = keep_groups(df, group, wanted).select(
        F.col(spec.unit),
        as_text(df, group).alias(group),
        as_long(df, spec.time).alias(spec.time),
        as_double(df, spec.survival).alias(spec.survival),
    )
    return _lines(rows, group, spec.survival, spec)


def cumulative_events(
    df: DataFrame, group: str, wanted: Wanted = None, spec: PanelSpec = PANEL
) -> DataFrame:
    """Cumulative count line of every unit; rows with a null are dropped before pairing."""
    require_columns(df, spec.unit, spec.time, spec.cumulative, group)
    rows = keep_groups(df, group, wanted).select(
        F.col(spec.unit),
        as_text(df, group).alias(group),
        as_long(df, spec.time).alias(spec.time),
        as_double(df, spec.cumulative).alias(spec.cumulative),
    )
    return _lines(rows.filter(all_present(rows.columns)), group, spec.cumulative, spec)


def faceted_curves(
    df: DataFrame,
    facet: str | None = None,
    color: str | None = None,
    densities: Wanted = None,
    housings: Wanted = None,
    spec: PanelSpec = PANEL,
) -> DataFrame:
    """Survival lines keyed by facet and colour under two group filters."""
    facet, color = facet or spec.density, color or spec.housing
    if {facet, color} != {spec.density, spec.housing}:
        raise ValueError(
            f"facet and color must be {spec.density!r} and {spec.housing!r} in either order"
        )
    require_columns(df, spec.unit, spec.time, spec.survival, facet, color)
    rows = keep_groups(keep_groups(df, spec.density, densities), spec.housing, housings)
    rows = rows.select(
        F.col(spec.unit),
        as_text(df, facet).alias(facet),
        as_text(df, color).alias(color),
        as_long(df, spec.time).alias(spec.time),
        as_double(df, spec.survival).alias(spec.survival),
    )
    return rows.filter(all_present(rows.columns))
