import math
import re
import random

import pytest
from pyspark.sql import functions as F

import vitalcurve as vc
from vitalcurve.functions.harmonic import reciprocal_square_sum, reciprocal_sum


def dish(unit, cumulative, remaining=None, initial=3, start=1, **groups):
    """A unit with one row per day; ``remaining`` is that of the last day."""
    groups = {"housing": "Dish", "density_category": "low", "genotype": "g"} | groups
    last = len(cumulative) - 1
    return [
        {
            "unit": unit,
            "day": start + i,
            "cumulative_deaths": c,
            "initial_count": initial,
            "remaining": float(remaining) if i == last and remaining is not None else 50.0,
            **groups,
        }
        for i, c in enumerate(cumulative)
    ]


def outcomes(df):
    return sorted((r.dish_id, r.time, r.deaths, r.censored) for r in df.collect())


def test_deaths_and_survivors(panel):
    df = panel(*dish("a", [0.0, 1.0, 1.0], remaining=2))
    assert outcomes(vc.individuals_weighted(df)) == [("a", 2, 1, 0), ("a", 3, 0, 2)]
    rows = sorted((r.time, r.event) for r in vc.individuals(df).collect())
    assert rows == [(2, 1), (3, 0), (3, 0)]
    assert set(vc.individuals(df).columns) == {
        "dish_id", "genotype", "housing_type", "density_category", "time", "event",
    }


def test_falling_count_lowers_the_base(panel):
    df = panel(*dish("a", [0.0, 2.0, 1.0, 2.0], remaining=0))
    assert outcomes(vc.individuals_weighted(df)) == [("a", 2, 2, 0), ("a", 4, 1, 0)]


def test_unknown_count_skips_the_row_and_its_survivors(panel):
    df = panel(*dish("a", [0.0, None, 2.0], remaining=1), *dish("b", [0.0, 1.0, None], remaining=2))
    assert outcomes(vc.individuals_weighted(df)) == [("a", 3, 2, 1), ("b", 2, 1, 0)]


def test_units_that_give_nothing(panel):
    nothing = panel(
        *dish("a", [1.0], initial=None, remaining=2),
        *dish(None, [1.0], remaining=2),
        {"unit": "c", "day": None, "cumulative_deaths": 3.0, "initial_count": 3, "remaining": 1.0},
    )
    assert outcomes(vc.individuals_weighted(nothing)) == []


def test_initial_count_counts_on_the_first_row_only(panel):
    rows = dish("a", [0.0, 1.0], remaining=1)
    rows[1]["initial_count"] = None
    assert outcomes(vc.individuals_weighted(panel(*rows))) == [("a", 2, 1, 1)]
    rows[0]["initial_count"], rows[1]["initial_count"] = None, 3
    assert outcomes(vc.individuals_weighted(panel(*rows))) == []


def test_duplicated_last_day_counts_survivors_twice(panel):
    rows = dish("a", [0.0, 1.0], remaining=2)
    assert outcomes(vc.individuals_weighted(panel(*rows, rows[1]))) == [("a", 2, 1, 4)]


def brute_force(rows):
    """Reconstruction of one unit, row by row, days ascending and counts ascending in a day."""
    rows = [r for r in rows if r["day"] is not None]
    rows.sort(key=lambda r: (r["day"], -1 if r["cumulative_deaths"] is None else r["cumulative_deaths"]))
    last, before, out = max(r["day"] for r in rows), 0, {}
    for r in rows:
        if r["cumulative_deaths"] is None:
            continue
        count = int(r["cumulative_deaths"])
        died, left = out.get(r["day"], (0, 0))
        died += max(0, count - before)
        if r["day"] == last and r["remaining"] is not None and r["remaining"] > 0:
            left += int(r["remaining"])
        out[r["day"]], before = (died, left), count
    return [(t, d, c) for t, (d, c) in sorted(out.items()) if d or c]


@pytest.mark.parametrize("chunk", [1, 3, 7, 4096])
def test_chunks_do_not_change_the_result(panel, chunk):
    """Random counts with gaps, falls, repeated and negative days, against brute force."""
    rng = random.Random(11)
    units = {}
    for u in "abcdef":
        units[u] = [
            {
                "unit": u,
                "day": rng.choice([None, *range(-5, 25)]),
                "cumulative_deaths": rng.choice([None, *map(float, range(6))]),
                "initial_count": 9,
                "remaining": rng.choice([None, 0.0, 2.0, 3.0]),
                "genotype": u,
                "housing": "Dish",
                "density_category": "low",
            }
            for _ in range(40)
        ]
    df = panel(*(r for rows in units.values() for r in rows)).repartition(5)
    want = sorted((u, *row) for u, rows in units.items() for row in brute_force(rows))
    assert outcomes(vc.individuals_weighted(df, chunk=chunk)) == want


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_exploded_form_equals_weighted_form(small_dirty_panel, block):
    weighted = vc.individuals_weighted(small_dirty_panel)
    rows = vc.individuals(small_dirty_panel, block=block)
    again = vc.weigh(rows).select("housing_type", "density_category", "time", "deaths", "censored")
    sums = weighted.groupBy("housing_type", "density_category", "time").agg(
        F.sum("deaths").alias("deaths"), F.sum("censored").alias("censored")
    )
    assert again.exceptAll(sums).isEmpty() and sums.exceptAll(again).isEmpty()


def test_individuals_cover_the_line_items(spark, small_panel):
    total = vc.individuals_weighted(small_panel).agg(F.sum(F.col("deaths") + F.col("censored"))).first()[0]
    assert total == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()


def events(spark, *rows):
    return spark.createDataFrame(
        [("Dish", "low", t, e) for t, e in rows],
        "housing_type string, density_category string, time bigint, event int",
    )


def test_hazard_with_ties(spark):
    df = events(spark, (1, 1), (1, 1), (2, 0))
    tied = vc.nelson_aalen(df).collect()
    assert [r.time for r in tied] == [0, 1, 2]
    assert [r.hazard for r in tied] == pytest.approx([0, 1 / 3 + 1 / 2, 1 / 3 + 1 / 2])
    assert [r.at_risk for r in tied] == [3, 3, 1]
    assert [r.variance for r in tied] == pytest.approx([0, 1 / 9 + 1 / 4, 1 / 9 + 1 / 4])
    plain = vc.nelson_aalen(df, ties="plain").collect()
    assert [r.hazard for r in plain] == pytest.approx([0, 2 / 3, 2 / 3])
    assert tied[0].label == "Dish - low"


@pytest.mark.parametrize("ties", ["fleming_harrington", "plain"])
def test_hazard_by_ranges_of_time_equals_that_in_one(spark, small_dirty_panel, ties):
    weighted = vc.individuals_weighted(small_dirty_panel).cache()
    whole = vc.nelson_aalen(weighted, confidence=True, ties=ties).collect()
    for block in (0.5, 1, 7, 1_000):
        parts = vc.nelson_aalen(weighted, confidence=True, ties=ties, time_block=block).collect()
        assert [r[:6] for r in parts] == [r[:6] for r in whole]
        for a, b in zip(parts, whole):
            assert list(a[6:]) == [pytest.approx(x, rel=1e-12) for x in b[6:]]


def test_a_fine_time_axis_is_in_many_tasks(spark):
    """300,000 distinct times of one group: no task holds more than some ranges of them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = 300_000
        events = spark.range(n).select(
            F.lit("Dish").alias("housing_type"), F.lit("low").alias("density_category"), (F.col("id") * 3 + 5).alias("time"),
            F.lit(1).cast("bigint").alias("deaths"), F.lit(0).cast("bigint").alias("censored"),
        )
        curve = vc.nelson_aalen(events, time_block=3_000)
        # every window is over a range, or over the table of one row per range
        plan = curve._jdf.queryExecution().executedPlan().toString()
        along_time = [w for w in re.findall(r"windowspecdefinition\(([^()]*)specifiedwindowframe", plan) if "time" in w]
        assert along_time and all("_range" in w for w in along_time)
        rows = curve.agg(F.count("*").alias("n"), F.max("hazard").alias("hazard"), F.max("at_risk").alias("at_risk"), F.max("variance").alias("variance")).first()
        assert rows.n == n + 1 and rows.at_risk == n
        assert rows.hazard == pytest.approx(math.fsum(1 / k for k in range(1, n + 1)), rel=1e-12)
        assert rows.variance == pytest.approx(math.fsum(1 / k**2 for k in range(1, n + 1)), rel=1e-12)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hazard_interval(spark):
    df = events(spark, (1, 0), (2, 1), (3, 1), (4, 0))
    rows = {r.time: r for r in vc.nelson_aalen(df, confidence=True).collect()}
    assert (rows[1].hazard, rows[1].lower, rows[1].upper) == (0.0, 0.0, 0.0)
    h, v = 1 / 3 + 1 / 2, 1 / 9 + 1 / 4
    assert rows[4].lower == pytest.approx(h * math.exp(-1.959963984540054 * math.sqrt(v) / h))
    assert rows[4].upper == pytest.approx(h * math.exp(1.959963984540054 * math.sqrt(v) / h))


def test_hazard_keeps_its_own_time_zero(spark):
    rows = vc.nelson_aalen(events(spark, (0, 1), (1, 1))).collect()
    assert [(r.time, r.hazard) for r in rows] == [(0, 0.5), (1, 1.5)]


def test_hazard_arguments(spark):
    df = events(spark, (1, 1))
    assert vc.nelson_aalen(df, housings=[]).count() == 0
    assert vc.nelson_aalen(df, densities=["low"]).count() == 2
    for bad in ({"ties": "x"}, {"alpha": 0.0}, {"time_block": 0}):
        with pytest.raises(ValueError):
            vc.nelson_aalen(df, **bad)


def test_hazard_properties(small_panel):
    curves = {}
    for r in vc.nelson_aalen(vc.individuals_weighted(small_panel), confidence=True).collect():
        curves.setdefault(r.label, []).append(r)
    assert len(curves) == 6
    for rows in curves.values():
        assert rows[0].time == 0
        assert all(a.hazard <= b.hazard and a.at_risk >= b.at_risk for a, b in zip(rows, rows[1:]))
        assert all(r.lower <= r.hazard <= r.upper for r in rows)


@pytest.mark.parametrize(
    "n, d",
    [(3, 2), (3, 3), (32, 5), (33, 1), (40, 40), (100, 60), (5000, 4999), (5000, 0), (10**6, 10**6 - 40)],
)
def test_reciprocal_sums(spark, n, d):
    df = spark.createDataFrame([(n, d)], "n bigint, d bigint")
    one, two = df.select(
        reciprocal_sum(F.col("n"), F.col("d")), reciprocal_square_sum(F.col("n"), F.col("d"))
    ).first()
    ks = range(n - d + 1, n + 1)
    assert one == pytest.approx(math.fsum(1 / k for k in ks), rel=1e-13, abs=1e-300)
    assert two == pytest.approx(math.fsum(1 / k**2 for k in ks), rel=1e-12, abs=1e-300)


def test_reciprocal_sum_of_large_counts(spark):
    """Small steps off a large base do not cancel."""
    n = 10**12
    df = spark.createDataFrame([(n, 7)], "n bigint, d bigint")
    got = df.select(reciprocal_sum(F.col("n"), F.col("d"))).first()[0]
    assert got == pytest.approx(math.fsum(1 / (n - i) for i in range(7)), rel=1e-13)
