"""One row per unit: last value, first groups, steepest decline, latest rows.

"Last" and "first" are the greatest and smallest ``(time, value...)`` struct of
the unit, so they need neither a window nor a sort by the caller, combine on the
map side however many rows a unit has, and are the same on every run even where
a day occurs twice. A null time sorts before every known one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import contract as C
from ..contract import PANEL, PanelSpec
from ..functions.columns import all_present, as_double, as_long, as_text, require_columns
from .summaries import UnitSummary


def _first_row(time: Column, *fields: Column) -> Column:
    return F.min(F.struct(time.alias("t"), *fields))


def final_per_unit(
    df: DataFrame | UnitSummary,
    groups: Sequence[str],
    spec: PanelSpec = PANEL,
    value: str | None = None,
    name: str = C.FINAL_SURVIVAL,
    with_time: bool = False,
) -> DataFrame:
    """Value on the last row of each unit (null included) and its first-row groups.

    Where the last day occurs twice the greater value wins.
    """
    if isinstance(df, UnitSummary):
        if value not in (None, df.spec.survival):
            raise ValueError("a summary has the final survival alone")
        return df.final(groups, name, with_time)
    value = value or spec.survival
    require_columns(df, spec.unit, spec.time, value, *groups)
    t = as_long(df, spec.time)
    per_unit = df.groupBy(F.col(spec.unit)).agg(
        F.max(F.struct(t.alias("t"), as_double(df, value).alias("v"))).alias("_last"),
        _first_row(t, *(as_text(df, g).alias(g) for g in groups)).alias("_first"),
    )
    extra = [F.col("_last.t").alias(spec.time)] if with_time else []
    return per_unit.select(
        spec.unit,
        *extra,
        F.col("_last.v").alias(name),
        *(F.col("_first").getField(g).alias(g) for g in groups),
    )


def steepest_decline_per_unit(
    df: DataFrame | UnitSummary, group: str, spec: PanelSpec = PANEL
) -> DataFrame:
    """Day and size of the most negative change of each unit, and its first group.

    Rows with a null in unit, group, day or change are left out first. Of equal
    declines the earliest day wins; NaN is greater than every number.
    """
    if isinstance(df, UnitSummary):
        return df.decline(group)
    require_columns(df, spec.unit, group, spec.time, spec.change)
    rows = df.select(
        F.col(spec.unit),
        as_long(df, spec.time).alias("t"),
        as_double(df, spec.change).alias("v"),
        as_text(df, group).alias(group),
    )
    rows = rows.filter(all_present(rows.columns))
    return (
        rows.groupBy(spec.unit)
        .agg(
            F.min(F.struct("v", "t")).alias("_low"),
            F.min(F.struct("t", group)).alias("_first"),
        )
        .select(
            spec.unit,
            F.col("_low.t").alias(C.CRITICAL_DAY),
            F.col("_low.v").alias("max_decline"),
            F.col("_first").getField(group).alias(group),
        )
    )


def first_metric_per_unit(
    df: DataFrame, metric: str, group: str, spec: PanelSpec = PANEL
) -> DataFrame:
    """Metric and group on the first row of each unit.

    A distributed table has no file order, so "first" is by time.
    """
    require_columns(df, spec.unit, spec.time, metric, group)
    return (
        df.groupBy(F.col(spec.unit))
        .agg(
            _first_row(
                as_long(df, spec.time),
                as_double(df, metric).alias("m"),
                as_text(df, group).alias("g"),
            ).alias("_first")
        )
        .select(
            spec.unit,
            F.col("_first.m").alias(metric),
            F.col("_first.g").alias(group),
        )
    )


def metric_per_unit(
    df: DataFrame | UnitSummary, metric: str, group: str, spec: PanelSpec = PANEL
) -> DataFrame:
    """(unit, metric, group) with nulls dropped.

    ``final_survival_rate`` and ``critical_day`` are computed from the panel even
    if a column of that name exists; any other metric is read from its column.
    """
    if metric == C.FINAL_SURVIVAL:
        points = final_per_unit(df, [group], spec)
    elif metric == C.CRITICAL_DAY:
        points = steepest_decline_per_unit(df, group, spec).drop("max_decline")
    elif isinstance(df, UnitSummary):
        raise ValueError(f"a summary has {C.FINAL_SURVIVAL!r} and {C.CRITICAL_DAY!r} alone")
    else:
        points = first_metric_per_unit(df, metric, group, spec)
    return points.filter(all_present([metric, group]))


def latest_rows(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """All rows on the last day of their unit, ties kept.

    Rows of the first rank from the last day back. Spark keeps that rank within
    each task before it shuffles, so of a unit of many rows only those on the
    last day that a task has seen leave it, and a panel that is partitioned by
    unit is not shuffled at all.
    """
    require_columns(df, spec.unit, spec.time)
    rows = df.withColumn(spec.time, as_long(df, spec.time)).filter(F.col(spec.time).isNotNull())
    last_first = Window.partitionBy(spec.unit).orderBy(F.col(spec.time).desc())
    return rows.withColumn("_rank", F.rank().over(last_first)).filter(F.col("_rank") == 1).drop("_rank")
