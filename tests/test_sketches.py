"""Approximate quantiles and unit counts: stated errors, stored and merged states."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

import vitalcurve as vc

PROBS = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(5)
    rows = [("hot", d, rng.choice([0.0, rng.gauss(50, 20), rng.lognormvariate(0, 4)])) for d in range(10) for _ in range(6_000)]
    rows += [("few", d, float(d)) for d in range(9)] + [("one", 0, 3.5), ("none", 0, None), ("none", 1, float("nan")), (None, 0, 1.0)]
    return spark.createDataFrame(rows, "g string, day int, v double").repartition(7).cache()


def _off(sorted_values, found, p):
    """How far the rank of ``found`` is from ``p``, as a share of all."""
    n = len(sorted_values)
    low, high = bisect.bisect_left(sorted_values, found) / n, bisect.bisect_right(sorted_values, found) / n
    return max(0.0, low - p, p - high)


@pytest.mark.parametrize("size", [50, 400])
def test_ranks_are_within_the_stated_error(values, size):
    known = {}
    for r in values.filter("g IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)").collect():
        known.setdefault(r.g, []).append(r.v)
    found = {r.g: r for r in vc.approximate_quantiles(values, ["g"], "v", PROBS, size).collect()}
    assert set(found) == {"hot", "few", "one"}
    for g, r in found.items():
        held = sorted(known[g])
        assert (r.n, r.low, r.high) == (len(held), held[0], held[-1])
        # one in a hundred may be further off than the error, none three times as far
        assert all(_off(held, r[f"q{i}"], p) <= 3 * vc.quantile_rank_error(size) for i, p in enumerate(PROBS))
    assert found["few"].q3 == 4.0 and found["one"].q0 == found["one"].q6 == 3.5


def test_stored_states_merge(spark, values, tmp_path):
    for part in (0, 1):
        days = values.filter(F.col("day") % 2 == part)
        vc.quantile_states(days, ["g", "day"], "v").write.parquet(str(tmp_path / f"days={part}"))
    states = spark.read.parquet(str(tmp_path)).drop("days")
    assert states.agg(F.max(F.length("state"))).first()[0] < 20_000
    merged = vc.merge_quantile_states(states, ["g"])
    held = sorted(r.v for r in values.filter("g = 'hot'").collect())
    r = vc.quantiles_of_states(merged, ["g"], (0.25, 0.5, 0.75)).filter("g = 'hot'").first()
    assert (r.n, r.low, r.high) == (len(held), held[0], held[-1])
    assert all(_off(held, r[f"q{i}"], p) <= 3 * vc.quantile_rank_error() for i, p in enumerate((0.25, 0.5, 0.75)))
    assert vc.quantiles_of_states(vc.merge_quantile_states(states.limit(0), ["g"]), ["g"], (0.5,)).count() == 0


def test_one_shuffle_of_states(values):
    plan = vc.approximate_quantiles(values, ["g"], "v", (0.5,))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_kll" in plan


def test_bad_arguments(values):
    for call in (
        lambda: vc.quantile_states(values, ["g"], "v", 7),
        lambda: vc.quantile_states(values, ["g"], "other"),
        lambda: vc.approximate_quantiles(values, ["g"], "v", (1.5,)),
        lambda: vc.unit_count_states(values.withColumnsRenamed({"g": "dish_id", "day": "days_since_fertilization"}), "v", bits=22),
    ):
        with pytest.raises(ValueError):
            call()


@pytest.fixture(scope="module")
def units(spark):
    """30,000 units in one group, some in another on each day, and a null unit."""
    rows = spark.range(90_000).select(
        (F.col("id") % 30_000).alias("dish_id"), (F.col("id") % 3).alias("days_since_fertilization"), F.lit("a").alias("genotype")
    )
    few = spark.createDataFrame([(u, d, "b") for u in range(40) for d in range(u % 3, 3)] + [(None, 1, "b"), (7, 0, None)], "dish_id bigint, days_since_fertilization bigint, genotype string")
    return rows.unionByName(few).repartition(5).cache()


@pytest.mark.parametrize("kind", ["bigint", "string", "double"])
def test_counts_are_within_the_stated_error(units, kind):
    rows = units.withColumn("dish_id", F.col("dish_id").cast(kind))
    states = vc.unit_count_states(rows, "genotype")
    assert states.count() == 7
    merged = {r.genotype: r.n_units for r in vc.unit_counts(vc.merge_unit_counts(states, ["genotype"]), ["genotype"]).collect()}
    assert abs(merged["a"] - 30_000) <= 4 * vc.unit_count_error() * 30_000
    assert merged["b"] == 41 and merged[None] == 1
    by_day = {(r.genotype, r.days_since_fertilization): r.n_units for r in vc.unit_counts(states, ["genotype", "days_since_fertilization"]).collect()}
    assert by_day["b", 0] == 14 and by_day["b", 1] == 28 and by_day["b", 2] == 40
    # finer and coarser states merge too
    mixed = vc.unit_count_states(rows.filter("days_since_fertilization > 0"), "genotype", bits=14).unionByName(vc.unit_count_states(rows.filter("days_since_fertilization = 0"), "genotype", bits=10))
    mixed = {r.genotype: r.n_units for r in vc.unit_counts(vc.merge_unit_counts(mixed, ["genotype"]), ["genotype"]).collect()}
    assert abs(mixed["a"] - 30_000) <= 4 * vc.unit_count_error(10) * 30_000 and mixed["b"] == 41


def test_median_survival_with_counted_states(small_dirty_panel):
    exact = {r.density_category: r for r in vc.median_survival(small_dirty_panel, "density_category").collect()}
    about = {r.density_category: r for r in vc.median_survival(small_dirty_panel, "density_category", unit_bits=12).collect()}
    assert set(exact) == set(about) and len(exact) > 2
    for g, r in exact.items():
        assert about[g].median_day == r.median_day and about[g].median_day_text == r.median_day_text
        assert abs(about[g].n_units - r.n_units) <= 1 + 4 * vc.unit_count_error() * r.n_units
