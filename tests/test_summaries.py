"""Stored states per unit: same results as from the panel, merged with new days, read without a shuffle on the unit."""

import re

import pytest
from pyspark.sql import functions as F

import vitalcurve as vc

OPERATORS = {
    "welch": lambda p: vc.welch_ttest(p),
    "anova": lambda p: vc.one_way_anova(p),
    "anova critical day": lambda p: vc.one_way_anova(p, "critical_day"),
    "box": lambda p: vc.distribution_box(p, "final_survival_rate", "density_category"),
    "box critical day": lambda p: vc.distribution_box(p, "critical_day", "density_category"),
    "points": lambda p: vc.distribution_points(p, "final_survival_rate", "genotype", ["Brand#1"]).orderBy("dish_id"),
    "critical period": lambda p: vc.critical_period_stats(p),
}


@pytest.fixture(scope="module")
def halves(small_dirty_panel):
    """Rows up to some day of each unit, and the rows after; a null day is new."""
    early = F.coalesce(F.col("days_since_fertilization") % 40 < F.abs(F.hash("dish_id")) % 60, F.lit(False))
    return small_dirty_panel.filter(early), small_dirty_panel.filter(~early)


@pytest.fixture(scope="module")
def merged(spark, halves, tmp_path_factory):
    folder = tmp_path_factory.mktemp("summaries")
    old = vc.unit_summary(halves[0]).save("old_units", 8, str(folder / "old"))
    both = old.merge(vc.unit_summary(halves[1])).save("all_units", 8, str(folder / "all"))
    yield both
    for name in ("old_units", "all_units"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")


@pytest.mark.parametrize("name", OPERATORS)
def test_merged_summary_gives_what_the_panel_gives(small_dirty_panel, merged, name):
    from_panel = [tuple(r) for r in OPERATORS[name](small_dirty_panel).collect()]
    from_states = [tuple(r) for r in OPERATORS[name](merged).collect()]
    assert len(from_panel) == len(from_states) > 0
    for a, b in zip(from_panel, from_states):
        assert [x if not isinstance(x, float) else pytest.approx(x, rel=1e-12, nan_ok=True) for x in a] == list(b)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_shuffle_on_the_unit(merged, name):
    plan = OPERATORS[name](merged)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(dish_id", plan)


def test_a_merge_shuffles_new_rows_only(spark, halves, merged):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = vc.stored_summary(spark, "old_units").merge(vc.unit_summary(halves[1])).states._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # that of the new rows' own aggregate; the stored side is read by buckets
    assert plan.count("hashpartitioning(dish_id") == 1 and plan.count("Bucketed: true") == 1


def test_empty_and_unknown(halves, merged):
    none = vc.unit_summary(halves[0].limit(0))
    assert vc.welch_ttest(none).count() == 0 and vc.critical_period_stats(none).count() == 0
    for call in (
        lambda: vc.one_way_anova(merged, "fish_density"),
        lambda: vc.one_way_anova(merged, group="cross_id"),
        lambda: vc.critical_period_stats(merged, "genotype"),
        lambda: merged.merge(vc.unit_summary(halves[0], declines=["housing"])),
        lambda: vc.final_per_unit(merged, ["genotype"], value="remaining"),
    ):
        with pytest.raises(ValueError):
            call()
    assert vc.unit_summary(halves[0], [["cross_id"]], ["genotype"]).final(["cross_id"], "v", True).columns == ["dish_id", "days_since_fertilization", "v", "cross_id"]
