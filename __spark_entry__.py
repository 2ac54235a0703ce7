"""

All queries read ``part`` and ``lineitem`` as a survival panel (see
``vitalcurve/plans/line_item_panel.py``) and run over the whole of it. Queries
named ``dirty_*`` run on the same panel as text with faults, after
standardising. Doubles that come out of an aggregate are rounded to 6 places on
both sides, because the order of summation differs between engines. Before that
both sides add the same 1e-9: a value that lies halfway between two roundings,
such as 25/128, would otherwise go up or down by its last bit.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

import vitalcurve as vc  # noqa: E402
from vitalcurve.plans import clean_panel, dirty_panel  # noqa: E402

try:  # the subpackage may be left out
    from vitalcurve.llm.queries import ORACLES as _LLM_ORACLES  # noqa: E402
    from vitalcurve.llm.queries import QUERIES as _LLM_QUERIES  # noqa: E402
except ModuleNotFoundError as missing:
    if not (missing.name or "").startswith("vitalcurve.llm"):
        raise
    _LLM_ORACLES, _LLM_QUERIES = {}, {}

Query = Callable[[SparkSession, str], DataFrame]
_SMOKE_DIR = "/root/testdata/sf0.001"
_PLACES = 6
_NUDGE = 1e-9


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *(
            F.round(F.col(f.name) + _NUDGE, _PLACES).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else f.name
            for f in df.schema.fields
        )
    )


def _clean(op: Callable[[DataFrame], DataFrame], rounded: bool = True) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = op(clean_panel(spark, sf_dir))
        return _rounded(out) if rounded else out

    return run


def _dirty(op: Callable[[DataFrame], DataFrame], rounded: bool = True) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = op(vc.standardise_panel(dirty_panel(spark, sf_dir)))
        return _rounded(out) if rounded else out

    return run


# Arguments shared by a query and its SQL.
_TWO_GROUPS = ["Brand#1 (Beaker)", "Brand#2 (Dish)"]
_TWO_DENSITIES = ["low", "high"]
_TWO_GENOTYPES = ["Brand#1", "Brand#2", "Brand#3"]
_DAY = "days_since_fertilization"
_LOW_THRESHOLD = 20.0
_GROUP_NAMES = {"density_category": "density", "housing": "housing"}


def _quantiles_within_error(panel: DataFrame) -> DataFrame:
    """Sketches by group and day, merged over the days; the ranks of their quantiles counted on all rows.

    One quantile in a hundred may miss the stated error, so three times as much is allowed.
    """
    group, value, probs = "density_category", "survival_rate", (0.05, 0.25, 0.5, 0.75, 0.95)
    states = vc.merge_quantile_states(vc.quantile_states(panel, [group, _DAY], value), [group])
    found = vc.quantiles_of_states(states, [group], probs)
    rows = panel.select(group, F.col(value).alias("_v")).filter("_v IS NOT NULL AND NOT isnan(_v)").join(found, group)
    error = 3 * vc.quantile_rank_error()
    ranks = [(F.avg((F.col("_v") < F.col(q)).cast("int")), F.avg((F.col("_v") <= F.col(q)).cast("int"))) for q in (f"q{i}" for i in range(len(probs)))]
    inside = F.lit(True)
    for p, (below, up_to) in zip(probs, ranks):
        inside = inside & (below <= p + error) & (up_to >= p - error)
    return rows.groupBy(group, "n").agg(inside.alias("within_error"))


def _sketched_units_within_error(panel: DataFrame) -> DataFrame:
    """Median survival with units counted by sketches, against the exact count; four standard errors are allowed."""
    group = "density_category"
    exact = vc.median_survival(panel, group).select(F.col(group).alias("_group"), F.col("n_units").alias("_exact"))
    about = vc.median_survival(panel, group, unit_bits=12).join(exact, F.col(group).eqNullSafe(F.col("_group")))
    off = F.abs(F.col("n_units") - F.col("_exact"))
    return about.select(group, "median_day", "median_day_text", (off <= 1 + 4 * vc.unit_count_error(12) * F.col("_exact")).alias("within_error"))


def _summary(panel: DataFrame) -> vc.UnitSummary:
    """States of the early days merged with those of the late ones."""
    early = F.coalesce(F.col(_DAY) < 25, F.lit(False))
    return vc.unit_summary(panel.filter(early)).merge(vc.unit_summary(panel.filter(~early)))


def _by_cross_and_genotype(df: DataFrame) -> DataFrame:
    return df.withColumn("cross_genotype", F.concat_ws(" / ", "cross_id", "genotype"))


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: survival curves by density on the smallest tables."""
    return queries()["cohort_curve_sd"](spark, _SMOKE_DIR)


def queries() -> dict[str, Query]:
    """One entry per operator and variant; each takes (spark, sf_dir)."""
    return _LLM_QUERIES | {
        # Ingest and tables
        "standardise_panel": _dirty(lambda p: p, rounded=False),
        "group_options": _clean(lambda p: vc.group_options(p, "genotype_housing")),
        "dirty_group_options": _dirty(lambda p: vc.group_options(p, "density_category")),
        "panel_preview": _clean(vc.panel_preview, rounded=False),
        "stats_table": _clean(lambda p: vc.stats_table(vc.welch_ttest(p)), rounded=False),
        "stats_table_critical_period": _clean(
            lambda p: vc.stats_table(vc.critical_period_stats(p)), rounded=False
        ),
        "stats_table_as_text": _clean(
            lambda p: vc.stats_table(vc.welch_ttest(p), as_text=True), rounded=False
        ),
        "conversion_faults": lambda spark, sf_dir: vc.conversion_faults(dirty_panel(spark, sf_dir)),
        # Curves
        "cohort_curve_sd": _clean(lambda p: vc.survival_curve(p, "density_category")),
        "cohort_curve_sd_filtered": _clean(
            lambda p: vc.survival_curve(p, "genotype_housing", _TWO_GROUPS)
        ),
        "cohort_curve_sd_no_group": _clean(lambda p: vc.survival_curve(p, "density_category", [])),
        "cohort_curve_sd_wanted_table": _clean(
            lambda p: vc.survival_curve(p, "genotype", p.filter("vol_water_total >= 490").select("genotype").distinct())
        ),
        "dirty_cohort_curve_sd": _dirty(lambda p: vc.survival_curve(p, "density_category")),
        "remaining_curve": _clean(vc.remaining_curve),
        "dirty_remaining_curve": _dirty(vc.remaining_curve),
        "rate_change_se": _clean(vc.rate_change_curve),
        "rate_change_min_n": _clean(
            lambda p: vc.rate_change_curve(_by_cross_and_genotype(p), "cross_genotype", min_count=3)
        ),
        "group_worst_day": _clean(vc.worst_day),
        "median_survival": _clean(lambda p: vc.median_survival(p, "density_category")),
        "median_survival_threshold": _clean(
            lambda p: vc.median_survival(p, "genotype_housing", threshold=_LOW_THRESHOLD)
        ),
        "dirty_median_survival": _dirty(lambda p: vc.median_survival(p, "density_category")),
        "dirty_median_survival_sketched_units": _dirty(_sketched_units_within_error),
        "unit_curves": _clean(lambda p: vc.unit_curves(p, "genotype_housing"), rounded=False),
        "dirty_unit_curves": _dirty(lambda p: vc.unit_curves(p, "density_category"), rounded=False),
        "cumulative_events": _clean(
            lambda p: vc.cumulative_events(p, "density_category", _TWO_DENSITIES), rounded=False
        ),
        "dirty_cumulative_events": _dirty(
            lambda p: vc.cumulative_events(p, "density_category"), rounded=False
        ),
        "faceted_curves": _clean(
            lambda p: vc.faceted_curves(p, densities=_TWO_DENSITIES, housings=["Dish"]),
            rounded=False,
        ),
        # Per-unit values
        "unit_final_value": _dirty(
            lambda p: vc.final_per_unit(p, ["genotype", "density_category"]), rounded=False
        ),
        "unit_critical_day": _dirty(
            lambda p: vc.steepest_decline_per_unit(p, "density_category"), rounded=False
        ),
        "unit_time_to_event": _clean(vc.unit_time_to_event, rounded=False),
        "dirty_unit_time_to_event": _dirty(vc.unit_time_to_event, rounded=False),
        # Distributions
        "distribution_points": _clean(
            lambda p: vc.distribution_points(p, "final_survival_rate", "genotype"), rounded=False
        ),
        "distribution_points_critical_day": _clean(
            lambda p: vc.distribution_points(p, "critical_day", "cross_id"), rounded=False
        ),
        "distribution_points_column": _dirty(
            lambda p: vc.distribution_points(p, "volume_per_fish", "density_category", ["low", "mid"]),
            rounded=False,
        ),
        "distribution_box": _clean(
            lambda p: vc.distribution_box(p, "final_survival_rate", "density_category")
        ),
        "distribution_box_critical_day": _clean(
            lambda p: vc.distribution_box(p, "critical_day", "genotype")
        ),
        "distribution_histogram": _clean(
            lambda p: vc.distribution_histogram(p, "final_survival_rate", "housing", 5.0)
        ),
        "critical_period_stats": _clean(vc.critical_period_stats),
        "dirty_critical_period_stats": _dirty(vc.critical_period_stats),
        "approximate_quantiles": _clean(_quantiles_within_error),
        # From merged states of units
        "distribution_box_from_summary": _clean(
            lambda p: vc.distribution_box(_summary(p), "final_survival_rate", "density_category")
        ),
        "dirty_critical_period_stats_from_summary": _dirty(lambda p: vc.critical_period_stats(_summary(p))),
        "dirty_welch_ttest_from_summary": _dirty(lambda p: vc.welch_ttest(_summary(p), with_p=False)),
        "anova_critical_day_from_summary": _clean(
            lambda p: vc.one_way_anova(_summary(p), "critical_day", with_p=False)
        ),
        # Final level, scatter and trend
        "final_by_two_groups": _clean(vc.final_level),
        "dirty_final_by_two_groups": _dirty(vc.final_level),
        "final_points": _clean(vc.final_points, rounded=False),
        "dirty_final_points": _dirty(vc.final_points, rounded=False),
        "scatter_latest": _clean(vc.scatter, rounded=False),
        "scatter_on_day": _dirty(
            lambda p: vc.scatter(p, day=20, per_fish=False, wanted=_TWO_GENOTYPES), rounded=False
        ),
        "linear_trend": _clean(vc.linear_trend),
        "linear_trend_filtered": _clean(lambda p: vc.linear_trend(p, wanted=_TWO_GENOTYPES)),
        "linear_trend_on_day": _dirty(lambda p: vc.linear_trend(p, day=5, per_fish=False)),
        # Individuals and hazard
        "individuals": _clean(vc.individuals, rounded=False),
        "individuals_weighted": _clean(vc.individuals_weighted, rounded=False),
        "dirty_individuals_weighted": _dirty(vc.individuals_weighted, rounded=False),
        "nelson_aalen": _clean(lambda p: vc.nelson_aalen(vc.individuals_weighted(p))),
        "nelson_aalen_plain": _clean(
            lambda p: vc.nelson_aalen(vc.individuals_weighted(p), ["Beaker"], ties="plain")
        ),
        "nelson_aalen_densities": _clean(
            lambda p: vc.nelson_aalen(vc.individuals_weighted(p), densities=_TWO_DENSITIES)
        ),
        "nelson_aalen_ci": _clean(
            lambda p: vc.nelson_aalen(vc.individuals_weighted(p), confidence=True)
        ),
        "dirty_nelson_aalen_by_ranges": _dirty(
            lambda p: vc.nelson_aalen(vc.individuals_weighted(p), time_block=7)
        ),
        "dirty_nelson_aalen_ci": _dirty(
            lambda p: vc.nelson_aalen(vc.individuals(p), confidence=True)
        ),
        # Tests
        "welch_ttest": _clean(lambda p: vc.welch_ttest(p, with_p=False)),
        "welch_ttest_p": _clean(vc.welch_ttest),
        "dirty_welch_ttest": _dirty(lambda p: vc.welch_ttest(p, with_p=False)),
        "anova_final_survival": _clean(lambda p: vc.one_way_anova(p, with_p=False)),
        "anova_critical_day": _clean(
            lambda p: vc.one_way_anova(p, "critical_day", with_p=False)
        ),
        "anova_p": _clean(vc.one_way_anova),
        "anova_p_by_housing": _dirty(
            lambda p: vc.one_way_anova(p, "critical_day", "housing")
        ),
    }


# --- DuckDB equivalents -----------------------------------------------------

_PANEL_SQL = """
per_period AS (
  SELECT l_partkey,
         CAST(floor(CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) / 30) AS BIGINT) AS period,
         count(*) AS n
  FROM lineitem GROUP BY 1, 2),
per_part AS (SELECT l_partkey, CAST(sum(n) AS BIGINT) AS initial_count FROM per_period GROUP BY 1),
grid AS (
  SELECT part.*, initial_count, unnest(range(0, 41 + p_partkey % 45)) AS day
  FROM part JOIN per_part ON p_partkey = l_partkey),
counted AS (
  SELECT grid.*, CAST(coalesce(n, 0) AS BIGINT) AS fish_deaths,
         CAST(sum(coalesce(n, 0)) OVER (PARTITION BY p_partkey ORDER BY day) AS BIGINT) AS cum
  FROM grid LEFT JOIN per_period ON p_partkey = l_partkey AND day = period),
rated AS (
  SELECT *, CAST(100 AS DOUBLE) * (initial_count - cum) / initial_count AS rate FROM counted),
clean AS (
  SELECT p_partkey AS dish_id,
         p_brand AS genotype,
         CASE WHEN p_size % 2 = 0 THEN 'yes' ELSE 'no' END AS in_beaker,
         CASE WHEN p_size % 2 = 0 THEN 'Beaker' ELSE 'Dish' END AS housing,
         CASE WHEN initial_count < 25 THEN 'low' WHEN initial_count < 35 THEN 'mid' ELSE 'high' END AS density_category,
         p_type AS cross_id,
         initial_count,
         CAST(p_size * 10 AS BIGINT) AS vol_water_total,
         CAST(day AS BIGINT) AS days_since_fertilization,
         fish_deaths,
         CAST(cum AS DOUBLE) AS cumulative_deaths,
         CAST(initial_count - cum AS DOUBLE) AS remaining,
         rate AS survival_rate,
         rate - lag(rate) OVER (PARTITION BY p_partkey ORDER BY day) AS survival_rate_change,
         p_brand || ' (' || CASE WHEN p_size % 2 = 0 THEN 'Beaker' ELSE 'Dish' END || ')' AS genotype_housing,
         CAST(p_size * 10 AS DOUBLE) / initial_count AS volume_per_fish,
         CAST(initial_count AS DOUBLE) / (p_size * 10) AS fish_density
  FROM rated)"""

_CLEAN_SQL = f"WITH {_PANEL_SQL}, panel AS (SELECT * FROM clean)"

_DIRTY_SQL = f"""WITH {_PANEL_SQL},
keyed AS (
  SELECT *, dish_id AS u, dish_id * 100 + days_since_fertilization AS k,
         days_since_fertilization = 40 + dish_id % 45 AS is_last
  FROM clean),
raw AS (
  SELECT CAST(u AS VARCHAR) AS dish_id,
         CASE WHEN u % 17 <> 0 THEN genotype END AS genotype,
         CASE WHEN u % 11 = 0 THEN NULL WHEN u % 7 = 0 THEN upper(in_beaker) ELSE in_beaker END AS in_beaker,
         CASE WHEN u % 13 <> 0 THEN density_category END AS density_category,
         cross_id,
         CASE WHEN k % 73 = 0 THEN NULL
              WHEN k % 79 = 0 THEN CAST(days_since_fertilization AS VARCHAR) || '.9'
              ELSE CAST(days_since_fertilization AS VARCHAR) END AS days_since_fertilization,
         CASE WHEN u % 31 <> 0 THEN CAST(initial_count AS VARCHAR) END AS initial_count,
         CAST(fish_deaths AS VARCHAR) AS fish_deaths,
         CASE WHEN k % 83 = 0 OR (u % 37 = 0 AND is_last) THEN NULL
              WHEN u % 23 = 0 AND days_since_fertilization = 20 THEN CAST(cumulative_deaths - 1 AS VARCHAR)
              ELSE CAST(cumulative_deaths AS VARCHAR) END AS cumulative_deaths,
         CAST(remaining AS VARCHAR) AS remaining,
         CASE WHEN k % 97 = 0 THEN 'n/a'
              WHEN k % 89 = 0 OR (u % 29 = 0 AND is_last) THEN NULL
              WHEN u % 41 = 0 AND days_since_fertilization = 5 THEN 'NaN'
              ELSE CAST(survival_rate AS VARCHAR) END AS survival_rate,
         CAST(survival_rate_change AS VARCHAR) AS survival_rate_change,
         CAST(vol_water_total AS VARCHAR) AS vol_water_total,
         CAST(volume_per_fish AS VARCHAR) AS volume_per_fish,
         CAST(fish_density AS VARCHAR) AS fish_density,
         CASE WHEN u % 43 = 0 THEN NULL WHEN remaining > 0 THEN 'active' ELSE 'ended' END AS status,
         CASE WHEN k % 101 = 0 THEN NULL WHEN days_since_fertilization % 7 = 0 THEN 'yes' ELSE 'no' END AS water_changed,
         CASE WHEN k % 103 = 0 THEN CAST(vol_water_total AS VARCHAR) || '.7'
              WHEN k % 107 = 0 THEN '5d'
              WHEN days_since_fertilization % 7 = 0 THEN CAST(vol_water_total AS VARCHAR)
              ELSE '0' END AS vol_water_changed,
         CASE WHEN k % 113 = 0 THEN '-' ELSE CAST(CAST(-0.25 AS DOUBLE) * (days_since_fertilization % 13 + 1) AS VARCHAR) END AS max_decline,
         CASE WHEN k % 109 = 0 THEN 'NaN' ELSE CAST(days_since_fertilization % 31 AS VARCHAR) END AS critical_day,
         unnest(range(0, CASE WHEN u % 19 = 0 AND is_last THEN 2 ELSE 1 END)) AS copy_no
  FROM keyed),
typed AS (
  SELECT dish_id, genotype, in_beaker, density_category, cross_id,
         TRY_CAST(trunc(TRY_CAST(days_since_fertilization AS DOUBLE)) AS BIGINT) AS days_since_fertilization,
         TRY_CAST(trunc(TRY_CAST(initial_count AS DOUBLE)) AS BIGINT) AS initial_count,
         TRY_CAST(trunc(TRY_CAST(fish_deaths AS DOUBLE)) AS BIGINT) AS fish_deaths,
         TRY_CAST(cumulative_deaths AS DOUBLE) AS cumulative_deaths,
         TRY_CAST(remaining AS DOUBLE) AS remaining,
         TRY_CAST(survival_rate AS DOUBLE) AS survival_rate,
         TRY_CAST(survival_rate_change AS DOUBLE) AS survival_rate_change,
         TRY_CAST(trunc(TRY_CAST(vol_water_total AS DOUBLE)) AS BIGINT) AS vol_water_total,
         TRY_CAST(volume_per_fish AS DOUBLE) AS volume_per_fish,
         TRY_CAST(fish_density AS DOUBLE) AS fish_density,
         status, water_changed,
         TRY_CAST(trunc(TRY_CAST(vol_water_changed AS DOUBLE)) AS BIGINT) AS vol_water_changed,
         TRY_CAST(max_decline AS DOUBLE) AS max_decline,
         TRY_CAST(trunc(TRY_CAST(critical_day AS DOUBLE)) AS BIGINT) AS critical_day,
         CASE WHEN lower(in_beaker) = 'yes' THEN 'Beaker' ELSE 'Dish' END AS housing
  FROM raw),
panel AS (
  SELECT *, coalesce(genotype, 'NA') || ' (' || coalesce(housing, 'Unknown') || ')' AS genotype_housing FROM typed)"""


def _r(x: str) -> str:
    """Rounded, and without a negative zero."""
    return f"(round({x} + CAST({_NUDGE} AS DOUBLE), {_PLACES}) + 0.0)"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _clip(x: str, low: str | None, high: str | None) -> str:
    y = x
    if low is not None:
        y = f"greatest({y}, CAST({low} AS DOUBLE))"
    if high is not None:
        y = f"least({y}, CAST({high} AS DOUBLE))"
    return f"CASE WHEN {x} IS NULL OR isnan({x}) THEN {x} ELSE {y} END"


def _sd(x: str) -> str:
    """Sample deviation that gives NaN for NaN input, where DuckDB raises an error."""
    return (
        f"CASE WHEN count({x}) < 2 THEN NULL WHEN bool_or(isnan({x})) THEN CAST('NaN' AS DOUBLE) "
        f"ELSE stddev_samp({x}) FILTER (WHERE NOT isnan({x})) END"
    )


def _curve(
    group: str,
    measure: str,
    band: str,
    where: str = "true",
    low: str | None = None,
    high: str | None = None,
    clip_upper: bool = True,
    having: str = "true",
    source: str = "panel",
) -> str:
    spread = "sd" if band == "sd" else "sd / sqrt(n)"
    up = f"(mean + {spread})"
    down = f"(mean - {spread})"
    upper = _clip(up, low, high) if clip_upper else up
    se = "" if band == "sd" else f", {_r('sd / sqrt(n)')} AS se"
    return f"""
, cells AS (
  SELECT {group}, {_DAY}, avg({measure}) AS mean, {_sd(measure)} AS sd, count(*) AS n
  FROM {source}
  WHERE {where} AND {group} IS NOT NULL AND {_DAY} IS NOT NULL AND {measure} IS NOT NULL
  GROUP BY 1, 2 HAVING {having})
SELECT {group}, {_DAY}, {_r('mean')} AS mean, {_r('sd')} AS sd, n{se},
       {_r(upper)} AS upper, {_r(_clip(down, low, high))} AS lower
FROM cells"""


def _median(group: str, threshold: float = 50) -> str:
    return f"""
, means AS (SELECT {group} AS g, {_DAY} AS t, avg(survival_rate) AS m FROM panel GROUP BY 1, 2),
reached AS (SELECT g, min(t) AS t FROM means WHERE m <= {threshold} GROUP BY 1),
never AS (SELECT g FROM means GROUP BY 1 HAVING min(m) > {threshold}),
both_kinds AS (
  SELECT g, t AS median_day, CAST(t AS VARCHAR) AS median_day_text FROM reached
  UNION ALL SELECT g, NULL, '> Max Day' FROM never),
units AS (SELECT {group} AS g, count(DISTINCT dish_id) AS n FROM panel GROUP BY 1)
SELECT both_kinds.g AS {group}, coalesce(n, 0) AS n_units, median_day, median_day_text
FROM both_kinds LEFT JOIN units ON both_kinds.g = units.g"""


def _lines(group: str, measure: str, where: str) -> str:
    return f"""
, filtered AS (SELECT dish_id, {group}, {_DAY}, {measure} FROM panel WHERE {where}),
pairs AS (
  SELECT dish_id AS u, {group} AS g FROM filtered
  WHERE dish_id IS NOT NULL AND {group} IS NOT NULL AND {_DAY} IS NOT NULL GROUP BY 1, 2)
SELECT dish_id, g AS {group}, {_DAY}, {measure} FROM filtered JOIN pairs ON dish_id = u"""


# One pass: structs compare field by field, and a false before each value puts nulls first.
_ORDERED_SQL = f"""
, ends AS (
  SELECT dish_id,
         min(struct_pack(t0 := {_DAY} IS NOT NULL, t := {_DAY}, a0 := genotype IS NOT NULL, genotype := genotype,
                         b0 := housing IS NOT NULL, housing := housing,
                         c0 := density_category IS NOT NULL, density_category := density_category,
                         cross_id := cross_id, genotype_housing := genotype_housing)) AS first,
         max(struct_pack(t0 := {_DAY} IS NOT NULL, t := {_DAY}, v0 := survival_rate IS NOT NULL, v := survival_rate)) AS last
  FROM panel GROUP BY dish_id),
finals AS (
  SELECT dish_id, last.t AS last_day, last.v AS final_survival_rate, first.genotype AS genotype, first.housing AS housing,
         first.density_category AS density_category, first.cross_id AS cross_id, first.genotype_housing AS genotype_housing
  FROM ends)"""


def _declines(group: str) -> str:
    return f"""
, changes AS (
  SELECT dish_id, {group}, {_DAY} AS t, survival_rate_change AS v FROM panel
  WHERE dish_id IS NOT NULL AND {group} IS NOT NULL AND {_DAY} IS NOT NULL AND survival_rate_change IS NOT NULL),
lowest AS (
  SELECT dish_id, t AS critical_day, v AS max_decline,
         first_value({group}) OVER (PARTITION BY dish_id ORDER BY t, {group}) AS {group},
         row_number() OVER (PARTITION BY dish_id ORDER BY v, t) AS place
  FROM changes),
declines AS (SELECT dish_id, critical_day, max_decline, {group} FROM lowest WHERE place = 1)"""


def _box(points: str, metric: str, group: str) -> str:
    return f"""
, quartiles AS (
  SELECT {group}, count(*) AS n, CAST(min({metric}) AS DOUBLE) AS minimum, CAST(max({metric}) AS DOUBLE) AS maximum,
         quantile_cont(CAST({metric} AS DOUBLE), 0.25) AS q1,
         quantile_cont(CAST({metric} AS DOUBLE), 0.5) AS q2,
         quantile_cont(CAST({metric} AS DOUBLE), 0.75) AS q3
  FROM {points} WHERE {metric} IS NOT NULL AND {group} IS NOT NULL GROUP BY 1)
SELECT {group}, n, {_r('minimum')} AS minimum, {_r('q1')} AS q1, {_r('q2')} AS median, {_r('q3')} AS q3,
       {_r('maximum')} AS maximum, {_r('q1 - 1.5 * (q3 - q1)')} AS lower_fence,
       {_r('q3 + 1.5 * (q3 - q1)')} AS upper_fence
FROM quartiles"""


def _critical_stats(places: int = _PLACES) -> str:
    def r(x: str) -> str:
        return _r(x) if places == _PLACES else f"(round({x}, {places}) + 0.0)"

    return f"""{_declines('density_category')}
SELECT density_category, count(*) AS n_units,
       {r('avg(critical_day)')} AS mean_critical_day,
       {r('median(CAST(critical_day AS DOUBLE))')} AS median_critical_day,
       {r('stddev_samp(critical_day)')} AS sd_critical_day,
       {r('avg(max_decline)')} AS mean_max_decline,
       {r('median(max_decline)')} AS median_max_decline,
       {r('stddev_samp(max_decline)')} AS sd_max_decline
FROM declines GROUP BY 1"""


_LATEST_SQL = f"""
, dated AS (SELECT *, max({_DAY}) OVER (PARTITION BY dish_id) AS last_day FROM panel),
latest AS (SELECT * FROM dated WHERE {_DAY} = last_day)"""

_FINAL_ROWS_SQL = f"""{_LATEST_SQL},
final_rows AS (
  SELECT * FROM latest
  WHERE survival_rate IS NOT NULL AND genotype IS NOT NULL AND housing IS NOT NULL)"""

_FINAL_LEVEL_SQL = f"""{_FINAL_ROWS_SQL}
SELECT genotype, housing, {_r('avg(survival_rate)')} AS mean, {_r('stddev_samp(survival_rate)')} AS sd,
       count(*) AS n, {_r('stddev_samp(survival_rate) / sqrt(count(*))')} AS se
FROM final_rows GROUP BY 1, 2"""

_FINAL_POINTS_SQL = f"""{_FINAL_ROWS_SQL}
SELECT dish_id, genotype, housing, survival_rate FROM final_rows WHERE housing IN ('Beaker', 'Dish')"""


def _scatter(source: str, x: str, where: str = "true") -> str:
    return f"""{_LATEST_SQL},
points AS (
  SELECT dish_id, {_DAY}, {x}, survival_rate, genotype, initial_count, vol_water_total, housing, density_category
  FROM {source}
  WHERE {where} AND {x} IS NOT NULL AND survival_rate IS NOT NULL AND genotype IS NOT NULL
        AND initial_count IS NOT NULL)"""


def _trend(source: str, x: str, where: str = "true") -> str:
    def line(at: str) -> str:
        return f"least(CAST(100 AS DOUBLE), greatest(CAST(0 AS DOUBLE), slope * {at} + intercept))"

    return f"""{_scatter(source, x, where)},
sums AS (
  SELECT count(*) AS n, regr_slope(survival_rate, {x}) AS slope, regr_intercept(survival_rate, {x}) AS intercept,
         corr({x}, survival_rate) AS r, stddev_pop({x}) AS sx, stddev_pop(survival_rate) AS sy,
         min({x}) AS x_low, max({x}) AS x_high
  FROM points WHERE isfinite({x}) AND isfinite(survival_rate))
SELECT n, {_r('slope')} AS slope, {_r('intercept')} AS intercept, {_r('r')} AS r, {_r('x_low')} AS x_low,
       {_r(line('x_low'))} AS y_at_x_low, {_r('x_high')} AS x_high, {_r(line('x_high'))} AS y_at_x_high
FROM sums"""


_INDIVIDUALS_SQL = f"""
, known AS (
  SELECT dish_id, genotype, housing, density_category, {_DAY} AS t, initial_count,
         CAST(trunc(cumulative_deaths) AS BIGINT) AS c, CAST(trunc(remaining) AS BIGINT) AS left_over
  FROM panel WHERE dish_id IS NOT NULL AND {_DAY} IS NOT NULL),
stepped AS (
  SELECT *,
         last_value(c IGNORE NULLS) OVER (PARTITION BY dish_id ORDER BY t, c NULLS FIRST
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
         max(t) OVER (PARTITION BY dish_id) AS last_day,
         row_number() OVER (PARTITION BY dish_id ORDER BY t, initial_count IS NULL, initial_count,
                            genotype NULLS FIRST, housing NULLS FIRST, density_category NULLS FIRST) AS place
  FROM known),
heads AS (
  SELECT dish_id, genotype, housing AS housing_type, density_category FROM stepped
  WHERE place = 1 AND initial_count IS NOT NULL),
outcomes AS (
  SELECT dish_id, t, greatest(0, c - coalesce(before, 0)) AS deaths,
         CASE WHEN t = last_day AND left_over > 0 THEN left_over ELSE 0 END AS censored
  FROM stepped WHERE c IS NOT NULL),
weighted AS (
  SELECT heads.dish_id, genotype, housing_type, density_category, t AS time,
         CAST(sum(deaths) AS BIGINT) AS deaths, CAST(sum(censored) AS BIGINT) AS censored
  FROM outcomes JOIN heads ON outcomes.dish_id = heads.dish_id
  GROUP BY ALL HAVING sum(deaths) > 0 OR sum(censored) > 0)"""

_WEIGHTED_SQL = f"""{_INDIVIDUALS_SQL}
SELECT * FROM weighted"""


def _hazard(where: str = "true", plain: bool = False, confidence: bool = False) -> str:
    if plain:
        steps = "CAST(deaths AS DOUBLE) / at_risk AS step, CAST(deaths * (at_risk - deaths) AS DOUBLE) / (CAST(at_risk AS DOUBLE) ** 3) AS square"
        source = "risk"
    else:
        steps = "coalesce(s, 0) AS step, coalesce(q, 0) AS square"
        source = "risk LEFT JOIN terms USING (housing_type, density_category, time)"
    bounds = ""
    if confidence:
        spread = "exp(1.959963984540054 * sqrt(variance) / hazard)"
        bounds = (
            f", CASE WHEN hazard > 0 THEN {_r(f'hazard / {spread}')} ELSE 0.0 END AS lower"
            f", CASE WHEN hazard > 0 THEN {_r(f'hazard * {spread}')} ELSE 0.0 END AS upper"
        )
    return f"""{_INDIVIDUALS_SQL},
summed AS (
  SELECT housing_type, density_category, time, sum(deaths) AS deaths, sum(censored) AS censored
  FROM (SELECT housing_type, density_category, time, deaths, censored FROM weighted
        UNION ALL SELECT DISTINCT housing_type, density_category, 0, 0, 0 FROM weighted)
  WHERE housing_type IS NOT NULL AND density_category IS NOT NULL AND {where}
  GROUP BY 1, 2, 3),
risk AS (
  SELECT housing_type, density_category, time, CAST(deaths AS BIGINT) AS deaths, CAST(censored AS BIGINT) AS censored,
         CAST(sum(deaths + censored) OVER (PARTITION BY housing_type, density_category ORDER BY time DESC) AS BIGINT) AS at_risk
  FROM summed),
terms AS (
  SELECT housing_type, density_category, time, sum(1 / CAST(at_risk - i AS DOUBLE)) AS s,
         sum(1 / (CAST(at_risk - i AS DOUBLE) ** 2)) AS q
  FROM (SELECT *, unnest(range(deaths)) AS i FROM risk) GROUP BY 1, 2, 3),
stepped_up AS (SELECT housing_type, density_category, time, at_risk, deaths, censored, {steps} FROM {source}),
curve AS (
  SELECT *, sum(step) OVER w AS hazard, sum(square) OVER w AS variance FROM stepped_up
  WINDOW w AS (PARTITION BY housing_type, density_category ORDER BY time))
SELECT housing_type, density_category, housing_type || ' - ' || density_category AS label, time, at_risk,
       deaths, censored, {_r('hazard')} AS hazard, {_r('variance')} AS variance{bounds}
FROM curve"""


_WELCH_SQL = f"""{_ORDERED_SQL},
tested AS (
  SELECT genotype, housing, final_survival_rate AS v FROM finals
  WHERE dish_id IS NOT NULL AND final_survival_rate IS NOT NULL AND genotype IS NOT NULL AND housing IS NOT NULL),
sides AS (
  SELECT genotype,
         count(v) FILTER (WHERE housing = 'Beaker' AND NOT isnan(v)) AS n_a,
         count(v) FILTER (WHERE housing = 'Dish' AND NOT isnan(v)) AS n_b,
         avg(v) FILTER (WHERE housing = 'Beaker' AND NOT isnan(v)) AS mean_a,
         avg(v) FILTER (WHERE housing = 'Dish' AND NOT isnan(v)) AS mean_b,
         var_samp(v) FILTER (WHERE housing = 'Beaker' AND NOT isnan(v)) AS var_a,
         var_samp(v) FILTER (WHERE housing = 'Dish' AND NOT isnan(v)) AS var_b
  FROM tested GROUP BY 1),
welch AS (
  SELECT *, n_a >= 2 AND n_b >= 2 AS testable,
         (mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b) AS t,
         (var_a / n_a + var_b / n_b) ** 2
           / ((var_a / n_a) ** 2 / (n_a - 1) + (var_b / n_b) ** 2 / (n_b - 1)) AS df
  FROM sides WHERE (SELECT count(*) FROM tested) >= 2)"""

_WELCH_COLUMNS = """genotype, 'Beaker vs Dish' AS comparison, n_a, n_b, {mean_a} AS mean_a, {mean_b} AS mean_b,
       {t} AS t_statistic, {df} AS dof"""


def _shown(x: str, places: int) -> str:
    """A number as text with fixed digits."""
    return f"coalesce(format('{{:.{places}f}}', {x}), 'N/A')"


def _welch_columns(places: int = _PLACES, shown: Callable[[str, int], str] | None = None) -> str:
    def r(x: str) -> str:
        if shown:
            return shown(x, places)
        return _r(x) if places == _PLACES else f"(round({x}, {places}) + 0.0)"

    return _WELCH_COLUMNS.format(
        mean_a=r("mean_a"),
        mean_b=r("mean_b"),
        t=r("CASE WHEN testable THEN t END"),
        df=r("CASE WHEN testable THEN df END"),
    )


def _beta_integral(source: str, key: str, a: str, b: str, x: str) -> str:
    """I_x(a, b) per row of ``source`` by Simpson's rule after x = sin(angle)^2."""
    f = f"(sin({{u}}) ** (2 * {a} - 1)) * (cos({{u}}) ** (2 * {b} - 1))"
    part, whole = "top * i / 2000", "pi() / 2 * i / 2000"
    weight = "CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"""
beta_rows AS (SELECT *, asin(sqrt({x})) AS top FROM {source}),
beta_values AS (
  SELECT {key},
         any_value(top) * sum({weight} * {f.format(u=part)})
           / (pi() / 2 * sum({weight} * {f.format(u=f'least({whole}, pi() / 2)')})) AS p
  FROM (SELECT *, unnest(range(0, 2001)) AS i FROM beta_rows) GROUP BY {key})"""


_WELCH_P_SQL = (
    f"{_WELCH_SQL},"
    + "valid AS (SELECT * FROM welch WHERE testable AND t IS NOT NULL AND df IS NOT NULL),"
    + _beta_integral("valid", "genotype", "(df / 2)", "0.5", "df / (df + t * t)")
)
_WELCH_NOTE = """CASE WHEN NOT testable THEN 'Insufficient data' WHEN p IS NULL THEN 'Calculation resulted in NaN'
            WHEN p < 0.05 THEN 'Significant (p<0.05)' ELSE 'Not Significant (p>=0.05)' END AS note"""


def _anova(points: str, metric: str, group: str) -> str:
    return f"""
, finite AS (
  SELECT {group}, CASE WHEN isfinite(CAST({metric} AS DOUBLE)) THEN CAST({metric} AS DOUBLE) END AS v
  FROM {points} WHERE {metric} IS NOT NULL AND {group} IS NOT NULL),
groups AS (
  SELECT {group}, count(v) AS n, avg(v) AS mean, stddev_pop(v) AS sd, var_pop(v) AS var FROM finite GROUP BY 1),
used AS (SELECT * FROM groups WHERE n >= 2),
grand AS (
  SELECT avg(v) AS m FROM finite WHERE {group} IN (SELECT {group} FROM used)),
overall AS (
  SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS total,
         sum(n * (mean - (SELECT m FROM grand)) ** 2) AS between_sum, sum(n * var) AS inside_sum
  FROM used),
tested AS (
  SELECT k - 1 AS d1, total - k AS d2, (between_sum / (k - 1)) / (inside_sum / (total - k)) AS f FROM overall)"""


def _anova_columns(group: str) -> str:
    return f"""{group}, n, {_r('mean')} AS mean, {_r('sd')} AS sd, {_r('f')} AS f_statistic,
       d1 AS dof_between, d2 AS dof_within"""


def _anova_p(points: str, metric: str, group: str) -> str:
    return (
        _anova(points, metric, group)
        + ","
        + _beta_integral("tested", "f", "(d2 / 2.0)", "(d1 / 2.0)", "d2 / (d2 + d1 * f)")
        + f"""
SELECT {_anova_columns(group)}, {_r('p')} AS p_value,
       CASE WHEN p < 0.05 THEN 'Significant difference between {_GROUP_NAMES[group]} groups (p<0.05)'
            ELSE 'No significant difference between {_GROUP_NAMES[group]} groups (p>=0.05)' END AS conclusion
FROM groups CROSS JOIN (SELECT tested.*, p FROM tested JOIN beta_values USING (f))"""
    )


_PANEL_COLUMNS = """dish_id, genotype, in_beaker, density_category, cross_id, days_since_fertilization, initial_count,
       fish_deaths, cumulative_deaths, remaining, survival_rate, survival_rate_change, vol_water_total,
       volume_per_fish, fish_density, housing, genotype_housing"""


_TYPED_COLUMNS = [
    c for c in re.findall(r"\w+", _PANEL_COLUMNS) if c not in ("dish_id", "housing", "genotype_housing")
] + ["status", "water_changed", "vol_water_changed", "max_decline", "critical_day"]


def _options(group: str) -> str:
    return f"""
SELECT {group}, CAST(row_number() OVER (ORDER BY {group}) - 1 AS INTEGER) AS ordinal
FROM (SELECT DISTINCT {group} FROM panel WHERE {group} IS NOT NULL)"""


_TIME_TO_EVENT_SQL = f"""{_ORDERED_SQL}
SELECT dish_id, last_day AS duration,
       CAST(CASE WHEN final_survival_rate < 1.0 THEN 1 ELSE 0 END AS INTEGER) AS event_observed,
       genotype, housing, density_category, cross_id, genotype_housing
FROM finals WHERE dish_id IS NOT NULL AND last_day IS NOT NULL"""

_REMAINING_SQL = """
, labelled AS (
  SELECT *, coalesce(housing, 'Unknown') || ' - ' || coalesce(density_category, 'Unknown') AS housing_density_group
  FROM panel)""" + _curve(
    "housing_density_group", "remaining", "sd", low="0", clip_upper=False, source="labelled"
)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for every key of ``queries()``."""
    clean = {
        "group_options": _options("genotype_housing"),
        "panel_preview": f"""
SELECT {_PANEL_COLUMNS} FROM panel ORDER BY dish_id, {_DAY} LIMIT 100""",
        "stats_table": f"""{_WELCH_P_SQL}
SELECT {_welch_columns(2)}, (round(p, 4) + 0.0) AS p_value, {_WELCH_NOTE}, coalesce(p < 0.05, false) AS significant
FROM welch LEFT JOIN beta_values USING (genotype)""",
        "stats_table_as_text": f"""{_WELCH_P_SQL}
SELECT {_welch_columns(2, _shown)}, {_shown('p', 4)} AS p_value, {_WELCH_NOTE}, coalesce(p < 0.05, false) AS significant
FROM welch LEFT JOIN beta_values USING (genotype)""",
        "stats_table_critical_period": _critical_stats(2),
        "cohort_curve_sd": _curve("density_category", "survival_rate", "sd", low="0", high="100"),
        "cohort_curve_sd_no_group": _curve("density_category", "survival_rate", "sd", "false", low="0", high="100"),
        "cohort_curve_sd_wanted_table": _curve(
            "genotype",
            "survival_rate",
            "sd",
            "genotype IN (SELECT genotype FROM panel WHERE vol_water_total >= 490)",
            low="0",
            high="100",
        ),
        "cohort_curve_sd_filtered": _curve(
            "genotype_housing",
            "survival_rate",
            "sd",
            f"genotype_housing IN {_in(_TWO_GROUPS)}",
            low="0",
            high="100",
        ),
        "remaining_curve": _REMAINING_SQL,
        "rate_change_se": _curve("genotype_housing", "survival_rate_change", "se"),
        "rate_change_min_n": """
, crossed AS (SELECT *, cross_id || ' / ' || genotype AS cross_genotype FROM panel)"""
        + _curve("cross_genotype", "survival_rate_change", "se", having="count(*) >= 3", source="crossed"),
        "group_worst_day": f"""
, cells AS (
  SELECT density_category, {_DAY} AS t, avg(survival_rate_change) AS m FROM panel
  WHERE density_category IS NOT NULL AND {_DAY} IS NOT NULL AND survival_rate_change IS NOT NULL
  GROUP BY 1, 2 HAVING count(*) >= 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY density_category ORDER BY m, t) AS place FROM cells)
SELECT density_category, t AS worst_day, {_r('m')} AS worst_mean_change FROM placed WHERE place = 1""",
        "median_survival": _median("density_category"),
        "median_survival_threshold": _median("genotype_housing", _LOW_THRESHOLD),
        "unit_curves": _lines("genotype_housing", "survival_rate", "true"),
        "cumulative_events": _lines(
            "density_category",
            "cumulative_deaths",
            f"density_category IN {_in(_TWO_DENSITIES)} AND cumulative_deaths IS NOT NULL AND {_DAY} IS NOT NULL",
        ),
        "faceted_curves": f"""
SELECT dish_id, density_category, housing, {_DAY}, survival_rate FROM panel
WHERE density_category IN {_in(_TWO_DENSITIES)} AND housing IN ('Dish')
      AND dish_id IS NOT NULL AND {_DAY} IS NOT NULL AND survival_rate IS NOT NULL""",
        "unit_time_to_event": _TIME_TO_EVENT_SQL,
        "distribution_points": f"""{_ORDERED_SQL}
SELECT dish_id, final_survival_rate, genotype FROM finals
WHERE final_survival_rate IS NOT NULL AND genotype IS NOT NULL""",
        "distribution_points_critical_day": f"""{_declines('cross_id')}
SELECT dish_id, critical_day, cross_id FROM declines""",
        "distribution_box": _ORDERED_SQL + _box("finals", "final_survival_rate", "density_category"),
        "distribution_box_critical_day": _declines("genotype") + _box("declines", "critical_day", "genotype"),
        "distribution_histogram": f"""{_ORDERED_SQL}
SELECT housing, CAST(floor(final_survival_rate / 5.0) AS BIGINT) AS bin,
       {_r('floor(final_survival_rate / 5.0) * 5.0')} AS bin_start, count(*) AS n
FROM finals WHERE final_survival_rate IS NOT NULL AND housing IS NOT NULL GROUP BY 1, 2, 3""",
        "critical_period_stats": _critical_stats(),
        "approximate_quantiles": """
SELECT density_category, count(*) AS n, true AS within_error FROM panel
WHERE density_category IS NOT NULL AND survival_rate IS NOT NULL AND NOT isnan(survival_rate) GROUP BY 1""",
        "distribution_box_from_summary": _ORDERED_SQL + _box("finals", "final_survival_rate", "density_category"),
        "final_by_two_groups": _FINAL_LEVEL_SQL,
        "final_points": _FINAL_POINTS_SQL,
        "scatter_latest": _scatter("latest", "volume_per_fish") + "\nSELECT * FROM points",
        "linear_trend": _trend("latest", "volume_per_fish"),
        "linear_trend_filtered": _trend("latest", "volume_per_fish", f"genotype IN {_in(_TWO_GENOTYPES)}"),
        "individuals": f"""{_INDIVIDUALS_SQL}
SELECT dish_id, genotype, housing_type, density_category, time, event FROM (
  SELECT *, CAST(1 AS INTEGER) AS event, unnest(range(deaths)) AS i FROM weighted
  UNION ALL SELECT *, CAST(0 AS INTEGER) AS event, unnest(range(censored)) AS i FROM weighted)""",
        "individuals_weighted": _WEIGHTED_SQL,
        "nelson_aalen": _hazard(),
        "nelson_aalen_plain": _hazard("housing_type = 'Beaker'", plain=True),
        "nelson_aalen_densities": _hazard(f"density_category IN {_in(_TWO_DENSITIES)}"),
        "nelson_aalen_ci": _hazard(confidence=True),
        "welch_ttest": f"{_WELCH_SQL}\nSELECT {_welch_columns()} FROM welch",
        "welch_ttest_p": f"""{_WELCH_P_SQL}
SELECT {_welch_columns()}, {_r('p')} AS p_value, {_WELCH_NOTE}
FROM welch LEFT JOIN beta_values USING (genotype)""",
        "anova_final_survival": _ORDERED_SQL
        + _anova("finals", "final_survival_rate", "density_category")
        + f"\nSELECT {_anova_columns('density_category')} FROM groups CROSS JOIN tested",
        "anova_critical_day": _declines("density_category")
        + _anova("declines", "critical_day", "density_category")
        + f"\nSELECT {_anova_columns('density_category')} FROM groups CROSS JOIN tested",
        "anova_critical_day_from_summary": _declines("density_category")
        + _anova("declines", "critical_day", "density_category")
        + f"\nSELECT {_anova_columns('density_category')} FROM groups CROSS JOIN tested",
        "anova_p": _ORDERED_SQL + _anova_p("finals", "final_survival_rate", "density_category"),
    }
    dirty = {
        "standardise_panel": f"""
SELECT {_PANEL_COLUMNS}, status, water_changed, vol_water_changed, max_decline, critical_day FROM panel""",
        "dirty_group_options": _options("density_category"),
        "dirty_cohort_curve_sd": clean["cohort_curve_sd"],
        "dirty_remaining_curve": clean["remaining_curve"],
        "dirty_median_survival": clean["median_survival"],
        "dirty_median_survival_sketched_units": _median("density_category").replace(
            "coalesce(n, 0) AS n_units, median_day, median_day_text", "median_day, median_day_text, true AS within_error"
        ),
        "conversion_faults": "\n"
        + "\nUNION ALL ".join(
            f"""SELECT '{c}' AS "column", (SELECT count({c}) FROM raw) AS known, (SELECT count({c}) FROM raw) - (SELECT count({c}) FROM typed) AS lost"""
            for c in _TYPED_COLUMNS
        ),
        "dirty_critical_period_stats_from_summary": clean["critical_period_stats"],
        "dirty_welch_ttest_from_summary": clean["welch_ttest"],
        "dirty_nelson_aalen_by_ranges": clean["nelson_aalen"],
        "dirty_unit_curves": _lines("density_category", "survival_rate", "true"),
        "dirty_cumulative_events": _lines(
            "density_category",
            "cumulative_deaths",
            f"density_category IS NOT NULL AND cumulative_deaths IS NOT NULL AND {_DAY} IS NOT NULL",
        ),
        "unit_final_value": f"""{_ORDERED_SQL}
SELECT dish_id, final_survival_rate, genotype, density_category FROM finals""",
        "unit_critical_day": f"{_declines('density_category')}\nSELECT * FROM declines",
        "dirty_unit_time_to_event": _TIME_TO_EVENT_SQL,
        "distribution_points_column": f"""
, placed AS (
  SELECT dish_id, volume_per_fish, density_category,
         row_number() OVER (PARTITION BY dish_id ORDER BY {_DAY} NULLS FIRST, volume_per_fish NULLS FIRST,
                            density_category NULLS FIRST) AS place
  FROM panel)
SELECT dish_id, volume_per_fish, density_category FROM placed
WHERE place = 1 AND volume_per_fish IS NOT NULL AND density_category IN ('low', 'mid')""",
        "dirty_critical_period_stats": clean["critical_period_stats"],
        "dirty_final_by_two_groups": clean["final_by_two_groups"],
        "dirty_final_points": clean["final_points"],
        "scatter_on_day": _scatter(
            "panel", "fish_density", f"{_DAY} = 20 AND genotype IN {_in(_TWO_GENOTYPES)}"
        )
        + "\nSELECT * FROM points",
        "linear_trend_on_day": _trend("panel", "fish_density", f"{_DAY} = 5"),
        "dirty_individuals_weighted": _WEIGHTED_SQL,
        "dirty_nelson_aalen_ci": clean["nelson_aalen_ci"],
        "dirty_welch_ttest": clean["welch_ttest"],
        "anova_p_by_housing": _declines("housing") + _anova_p("declines", "critical_day", "housing"),
    }
    return _LLM_ORACLES | {name: _CLEAN_SQL + sql for name, sql in clean.items()} | {
        name: _DIRTY_SQL + sql for name, sql in dirty.items()
    }
