"""Hypothesis tests on per-unit values, from sufficient statistics of one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import contract as C
from ..contract import PANEL, PanelSpec
from ..functions.columns import all_present, is_finite
from ..functions.pvalues import fisher_f_upper, student_t_two_sided
from .reductions import final_per_unit, metric_per_unit
from .summaries import UnitSummary

_INFINITY = float("inf")


def welch_ttest(
    df: DataFrame | UnitSummary,
    stratum: str | None = None,
    factor: str | None = None,
    levels: tuple[str, str] = (C.HOUSED_TOGETHER, C.HOUSED_ALONE),
    with_p: bool = True,
    spec: PanelSpec = PANEL,
) -> DataFrame:
    """Unequal-variance t-test of the final survival between two levels, per stratum.

    ``n_a``/``mean_a`` belong to the first level. With fewer than two values on a
    side t and p are null and the note says so. Zero variance on both sides gives
    an infinite t for different means and a null one for equal means. NaN values
    are left out. With fewer than two units in all there is no row.
    """
    stratum, factor = stratum or spec.genotype, factor or spec.housing
    units = final_per_unit(df, [stratum, factor], spec, name="_v")
    units = units.filter(all_present([spec.unit, "_v", stratum, factor]))

    def side(k: int) -> list[Column]:
        v = F.when((F.col(factor) == levels[k]) & ~F.isnan("_v"), F.col("_v"))
        tag = "ab"[k]
        return [
            F.count(v).alias(f"n_{tag}"),
            F.avg(v).alias(f"mean_{tag}"),
            F.var_samp(v).alias(f"_var_{tag}"),
        ]

    strata = units.groupBy(stratum).agg(F.count(F.lit(1)).alias("_units"), *side(0), *side(1))
    # One row per stratum from here on.
    strata = strata.withColumn("_all", strata.agg(F.sum("_units")).scalar())
    share_a = F.try_divide(F.col("_var_a"), F.col("n_a"))
    share_b = F.try_divide(F.col("_var_b"), F.col("n_b"))
    square = share_a + share_b
    gap = F.col("mean_a") - F.col("mean_b")
    testable = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    t = F.when(
        testable,
        F.when(square > 0, F.try_divide(gap, F.sqrt(square)))
        .when(gap > 0, _INFINITY)
        .when(gap < 0, -_INFINITY),
    )
    dof = F.when(
        testable,
        F.try_divide(
            square * square,
            F.try_divide(share_a * share_a, F.col("n_a") - 1)
            + F.try_divide(share_b * share_b, F.col("n_b") - 1),
        ),
    )
    out = (
        strata.filter(F.col("_all") >= 2)
        .withColumns({"t_statistic": t, "dof": dof})
        .select(
            stratum,
            F.lit(f"{levels[0]} vs {levels[1]}").alias("comparison"),
            "n_a",
            "n_b",
            "mean_a",
            "mean_b",
            "t_statistic",
            "dof",
        )
    )
    if with_p:
        p = F.col("p_value")
        note = (
            F.when(~testable, C.NOTE_INSUFFICIENT)
            .when(p.isNull(), C.NOTE_NAN)
            .when(p < C.SIGNIFICANCE_LEVEL, C.NOTE_SIGNIFICANT)
            .otherwise(C.NOTE_NOT_SIGNIFICANT)
        )
        out = out.withColumn(
            "p_value", student_t_two_sided(F.col("t_statistic"), F.col("dof"))
        ).withColumn("note", note)
    return out.orderBy(stratum)


def one_way_anova(
    df: DataFrame | UnitSummary,
    metric: str = C.FINAL_SURVIVAL,
    group: str | None = None,
    with_p: bool = True,
    spec: PanelSpec = PANEL,
) -> DataFrame:
    """F test of a per-unit metric over groups; the result is repeated on every group row.

    Groups with fewer than two finite values keep their row (n, mean, deviation
    with divisor n) but do not enter F. Without two usable groups F is null. No
    variance inside groups gives an infinite F for different means, else null.
    The conclusion names the group column.
    """
    group = group or spec.density
    units = metric_per_unit(df, metric, group, spec)
    v = F.col(metric).cast("double")
    finite = F.when(is_finite(v), v)
    groups = units.groupBy(group).agg(
        F.count(finite).alias("n"),
        F.avg(finite).alias("mean"),
        F.stddev_pop(finite).alias("sd"),
        F.var_pop(finite).alias("_var"),
    )
    # The totals are one row, whatever the number of groups: tasks combine them first.
    # Between groups: each combines count, mean and squares as a weighted variance does.
    used = F.col("n") >= 2
    n, mean = F.when(used, F.col("n")), F.when(used, F.col("mean"))
    first = groups.agg(
        F.count(n).alias("_k"),
        F.sum(n).alias("_n"),
        F.try_divide(F.sum(n * mean), F.sum(n)).alias("_grand"),
        F.sum(n * F.col("_var")).alias("_inside"),
        (F.max(mean) - F.min(mean)).alias("_spread"),
    )
    total = first.select(F.struct(*first.columns).alias("_all")).scalar()
    groups = groups.withColumn("_all", total).select("*", "_all.*")
    offset = mean - F.col("_grand")
    between = groups.agg(F.sum(n * offset * offset)).scalar()
    groups = groups.withColumn("_between", between)
    performed = F.col("_k") >= 2
    between = F.try_divide(F.col("_between"), F.col("_k") - 1)
    inside = F.try_divide(F.col("_inside"), F.col("_n") - F.col("_k"))
    f = F.when(
        performed,
        F.when(inside > 0, F.try_divide(between, inside)).when(F.col("_spread") > 0, _INFINITY),
    )
    out = groups.withColumns(
        {
            "dof_between": F.when(performed, F.col("_k") - 1),
            "dof_within": F.when(performed, F.col("_n") - F.col("_k")),
            "f_statistic": f,
        }
    ).select(group, "n", "mean", "sd", "f_statistic", "dof_between", "dof_within")
    if with_p:
        p = F.col("p_value")
        name = "density" if group == spec.density else group
        conclusion = (
            F.when(F.col("dof_between").isNull(), C.ANOVA_SKIPPED)
            .when(p.isNull(), C.ANOVA_NAN)
            .when(p < C.SIGNIFICANCE_LEVEL, C.ANOVA_SIGNIFICANT.format(name))
            .otherwise(C.ANOVA_NOT_SIGNIFICANT.format(name))
        )
        out = out.withColumn(
            "p_value",
            fisher_f_upper(
                F.col("f_statistic"),
                F.col("dof_between").cast("double"),
                F.col("dof_within").cast("double"),
            ),
        ).withColumn("conclusion", conclusion)
    return out.orderBy(group)
