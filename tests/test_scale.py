"""Plans and skew: what must hold when the tables are a million times larger."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import vitalcurve as vc
from vitalcurve.plans import clean_panel, line_item_panel

SF_DIR = "/root/testdata/sf0.001"
_P_VALUES = {
    "stats_table", "stats_table_as_text", "welch_ttest_p", "anova_p", "anova_p_by_housing",
}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# Operators that hand rows to Python; the p-value function is the only one, as ArrowEvalPython.
_PYTHON = ("BatchEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups", "FlatMapCoGroups", "AggregateInPandas", "WindowInPandas")


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)))
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not any(x in plan for x in _PYTHON)
    assert ("ArrowEvalPython" in plan) == (name in _P_VALUES)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory, small_panel):
    path = str(tmp_path_factory.mktemp("stored") / "panel")
    small_panel.write.parquet(path)
    return vc.read_panel_parquet(spark, path)


@pytest.mark.parametrize(
    "name, build, exchanges",
    [
        # Partial aggregate, one exchange on (group, day), one for the sort of the result.
        ("curve", lambda p: vc.survival_curve(p, "density_category"), 2),
        ("faceted", vc.faceted_curves, 0),
        ("standardise", vc.standardise_panel, 0),
        ("final", lambda p: vc.final_per_unit(p, ["genotype"]), 1),
        ("decline", lambda p: vc.steepest_decline_per_unit(p, "genotype"), 1),
        ("time to event", vc.unit_time_to_event, 1),
        ("histogram", lambda p: vc.distribution_histogram(p, "critical_day", "genotype", 5.0), 3),
    ],
)
def test_shuffles(stored, name, build, exchanges):
    plan = plan_of(build(stored))
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") == exchanges
    if exchanges:
        assert "partial_" in plan


@pytest.fixture(scope="module")
def hot_unit(spark):
    """One unit holds half of all rows, many of them on the same day."""
    hot = spark.range(20_000).select(
        F.lit("hot").alias("dish_id"),
        (F.col("id") % 5_000).alias("days_since_fertilization"),
        (F.col("id") % 5_000).cast("double").alias("cumulative_deaths"),
        (F.col("id") % 7).cast("double").alias("survival_rate"),
    )
    rest = spark.range(20_000).select(
        F.concat(F.lit("u"), F.floor(F.col("id") / 40)).alias("dish_id"),
        (F.col("id") % 40).alias("days_since_fertilization"),
        F.floor((F.col("id") % 40) / 10).cast("double").alias("cumulative_deaths"),
        (F.col("id") % 9).cast("double").alias("survival_rate"),
    )
    return (
        hot.unionByName(rest)
        .withColumns(
            {
                "genotype": F.lit("g"),
                "housing": F.lit("Dish"),
                "density_category": F.lit("low"),
                "initial_count": F.lit(10_000).cast("bigint"),
                "remaining": F.lit(1.0),
            }
        )
        .persist()
    )


def test_hot_unit_is_cut_into_chunks(hot_unit):
    weighted = vc.individuals_weighted(hot_unit, chunk=64)
    hot = weighted.filter("dish_id = 'hot'").agg(F.sum("deaths"), F.sum("censored")).first()
    # 4 rows on each day; on the last day each of them counts the survivor.
    assert tuple(hot) == (4_999, 4)
    rest = weighted.filter("dish_id != 'hot'").agg(F.sum("deaths"), F.sum("censored")).first()
    assert tuple(rest) == (3 * 500, 500)
    # No window over raw rows of a unit: rows are windowed per (unit, chunk).
    plan = plan_of(weighted)
    assert "hashpartitioning(dish_id" in plan and "_chunk" in plan


def test_result_does_not_depend_on_partitions(hot_unit, small_dirty_panel):
    def keyed(df):
        return sorted(map(str, df.collect()))

    for build in (
        lambda p: vc.individuals_weighted(p),
        lambda p: vc.final_per_unit(p, ["genotype"]),
        lambda p: vc.latest_rows(p).select("dish_id", "days_since_fertilization", "survival_rate"),
    ):
        for source in (hot_unit, small_dirty_panel):
            assert keyed(build(source)) == keyed(build(source.repartition(13, F.rand(3))))


def test_skewed_join_is_split(spark, hot_unit):
    """The lines of a hot unit are spread over tasks by the adaptive skew join."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        lines = vc.unit_curves(hot_unit.repartition(8), "genotype")
        assert lines.count() == hot_unit.count()
        out = lines.agg(F.sum("survival_rate")).first()[0]
        assert out == hot_unit.agg(F.sum("survival_rate")).first()[0]
        joined = vc.unit_curves(hot_unit.repartition(8), "genotype")
        joined.collect()
        assert "skew=true" in plan_of(joined)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_many_individuals_of_one_row_are_spread(panel):
    df = panel(
        {
            "unit": "a",
            "day": 1,
            "cumulative_deaths": 100_000.0,
            "remaining": 50_000.0,
            "initial_count": 150_000,
            "genotype": "g",
            "housing": "Dish",
            "density_category": "low",
        }
    )
    rows = vc.individuals(df, block=1000)
    counts = rows.groupBy(F.spark_partition_id().alias("p"), "event").count().collect()
    assert sum(r["count"] for r in counts if r.event == 1) == 100_000
    assert sum(r["count"] for r in counts if r.event == 0) == 50_000
    assert len({r.p for r in counts}) > 1


def test_quantiles_read_their_table_once(stored):
    """The counted values feed all three steps; adaptive execution reuses their shuffle."""
    box = vc.distribution_box(stored, "critical_day", "genotype")
    box.collect()
    final = plan_of(box).split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1
    # one for the units, one for the count, and three for the steps; those of ReusedExchange are the same shuffles again
    assert len([x for x in final.splitlines() if "Exchange hashpartitioning" in x and "ReusedExchange" not in x]) <= 6
    assert "ReusedExchange" in final and "percentile" not in final


@pytest.fixture(scope="module")
def thousand_units(spark, tmp_path_factory):
    """A thousand parts of three line items each."""
    folder = str(tmp_path_factory.mktemp("units"))
    n = F.col("id")
    spark.range(1000).select(
        n.alias("p_partkey"), F.concat(F.lit("Brand#"), n % 5).alias("p_brand"), F.lit("t").alias("p_type"), (n % 50).cast("int").alias("p_size")
    ).write.parquet(f"{folder}/part.parquet")
    spark.range(3000).select(
        (n % 1000).alias("l_partkey"), F.to_timestamp_ntz(F.lit("1995-06-01 00:00:00")).alias("l_shipdate")
    ).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_panel_rows_are_made_by_as_many_tasks_as_units_need(spark, thousand_units, monkeypatch):
    monkeypatch.setattr(line_item_panel, "_UNITS_PER_TASK", 20)
    units = clean_panel(spark, thousand_units).select("dish_id", F.spark_partition_id().alias("task")).distinct()
    tasks = units.groupBy("task").count().collect()
    assert sum(r["count"] for r in tasks) == 1000
    # 50 tasks by hash, where adaptive execution would merge them into a few
    assert len(tasks) > 40 and max(r["count"] for r in tasks) < 60


def test_latest_rows_are_ranked_before_the_shuffle(spark, thousand_units, stored):
    plan = plan_of(vc.latest_rows(stored))
    assert plan.count("Exchange") == 1 and plan.count("WindowGroupLimit") == 2 and "Join" not in plan
    assert plan.count("FileScan parquet") == 1
    # A panel that lies by unit is not shuffled again.
    panel = clean_panel(spark, thousand_units)
    assert plan_of(vc.scatter(panel)).count("Exchange hashpartitioning") == plan_of(panel).count("Exchange hashpartitioning")
