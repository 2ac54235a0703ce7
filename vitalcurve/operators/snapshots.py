"""Comparisons on one row per unit in time: final level, scatter and trend."""

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
    is_finite,
    keep_groups,
    pearson,
    require_columns,
    standard_error,
)
from .reductions import latest_rows

Wanted = Sequence | DataFrame | None
# A trend needs more variation than this on both axes.
_LEAST_DEVIATION = 1e-6


def _final_rows(df: DataFrame, spec: PanelSpec) -> DataFrame:
    require_columns(df, spec.unit, spec.time, spec.survival, spec.genotype, spec.housing)
    rows = df.select(
        F.col(spec.unit),
        as_long(df, spec.time).alias(spec.time),
        as_text(df, spec.genotype).alias(spec.genotype),
        as_text(df, spec.housing).alias(spec.housing),
        as_double(df, spec.survival).alias(spec.survival),
    )
    # The latest row is chosen first: a unit whose latest row has a null drops out.
    return latest_rows(rows, spec).filter(
        all_present([spec.survival, spec.genotype, spec.housing])
    )


def final_level(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Mean, deviation and standard error of the latest survival by genotype and housing."""
    return (
        _final_rows(df, spec)
        .groupBy(spec.genotype, spec.housing)
        .agg(
            F.avg(spec.survival).alias("mean"),
            F.stddev_samp(spec.survival).alias("sd"),
            F.count(F.lit(1)).alias("n"),
        )
        .withColumn("se", standard_error(F.col("sd"), F.col("n")))
        .orderBy(spec.genotype, spec.housing)
    )


def final_points(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """The latest rows behind ``final_level``, for the two known housings."""
    points = _final_rows(df, spec).select(spec.unit, spec.genotype, spec.housing, spec.survival)
    return keep_groups(points, spec.housing, [C.HOUSED_TOGETHER, C.HOUSED_ALONE])


def scatter(
    df: DataFrame,
    day: int | None = None,
    per_fish: bool = True,
    wanted: Wanted = None,
    spec: PanelSpec = PANEL,
) -> DataFrame:
    """Density against survival on one day, or on the latest row of each unit.

    x is ``volume_per_fish``, or ``fish_density`` if ``per_fish`` is false. Rows
    with a null in x, survival, genotype or initial count are left out after the
    latest row is chosen.
    """
    x = spec.volume_per_unit if per_fish else spec.crowding
    require_columns(df, spec.unit, spec.time, spec.survival, spec.genotype, spec.initial, x)
    carried = [n for n in (spec.water, spec.housing, spec.density) if n in df.columns]
    rows = df.select(
        F.col(spec.unit),
        as_long(df, spec.time).alias(spec.time),
        as_double(df, x).alias(x),
        as_double(df, spec.survival).alias(spec.survival),
        as_text(df, spec.genotype).alias(spec.genotype),
        as_long(df, spec.initial).alias(spec.initial),
        *carried,
    )
    rows = rows.filter(F.col(spec.time) == day) if day is not None else latest_rows(rows, spec)
    return keep_groups(rows, spec.genotype, wanted).filter(
        all_present([x, spec.survival, spec.genotype, spec.initial])
    )


def linear_trend(
    df: DataFrame,
    day: int | None = None,
    per_fish: bool = True,
    wanted: Wanted = None,
    spec: PanelSpec = PANEL,
) -> DataFrame:
    """Least-squares line over all finite scatter points, as one row.

    Slope, intercept, R and the line ends (clamped to 0-100) are null with fewer
    than two points or without variation on both axes.
    """
    x = spec.volume_per_unit if per_fish else spec.crowding
    points = scatter(df, day, per_fish, wanted, spec).select(
        F.col(x).alias("x"), F.col(spec.survival).alias("y")
    )
    sums = points.filter(is_finite(F.col("x")) & is_finite(F.col("y"))).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("y", "x").alias("_slope"),
        F.regr_intercept("y", "x").alias("_intercept"),
        pearson("x", "y").alias("_r"),
        F.stddev_pop("x").alias("_sx"),
        F.stddev_pop("y").alias("_sy"),
        F.min("x").alias("_x_low"),
        F.max("x").alias("_x_high"),
    )
    varied = (
        (F.col("n") > 1) & (F.col("_sx") > _LEAST_DEVIATION) & (F.col("_sy") > _LEAST_DEVIATION)
    )

    def line(at: str):
        return clamp(F.col("_slope") * F.col(at) + F.col("_intercept"), 0, 100)

    return sums.select(
        "n",
        F.when(varied, F.col("_slope")).alias("slope"),
        F.when(varied, F.col("_intercept")).alias("intercept"),
        F.when(varied, F.col("_r")).alias("r"),
        F.when(varied, F.col("_x_low")).alias("x_low"),
        F.when(varied, line("_x_low")).alias("y_at_x_low"),
        F.when(varied, F.col("_x_high")).alias("x_high"),
        F.when(varied, line("_x_high")).alias("y_at_x_high"),
    )
