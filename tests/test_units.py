import math
import random
import statistics
import struct

import pytest
from pyspark.sql import functions as F

import vitalcurve as vc
from vitalcurve.operators.quantiles import with_ordered_bits


def by_unit(df):
    return {r["dish_id"]: r.asDict() for r in df.collect()}


def test_last_value_may_be_null(panel):
    df = panel(
        {"unit": "a", "day": 1, "survival_rate": 80.0, "genotype": "g"},
        {"unit": "a", "day": 2, "survival_rate": None, "genotype": "h"},
        {"unit": "b", "day": None, "survival_rate": 10.0, "genotype": "g"},
        {"unit": "b", "day": 1, "survival_rate": 70.0, "genotype": "h"},
        {"unit": "c", "day": 3, "survival_rate": 5.0, "genotype": "g"},
        {"unit": "c", "day": 3, "survival_rate": 6.0, "genotype": "g"},
    )
    out = by_unit(vc.final_per_unit(df, ["genotype"]))
    assert out["a"]["final_survival_rate"] is None and out["a"]["genotype"] == "g"
    # A null day is first, never last.
    assert out["b"]["final_survival_rate"] == 70.0 and out["b"]["genotype"] == "g"
    # Two rows on the last day: the greater value.
    assert out["c"]["final_survival_rate"] == 6.0
    assert set(by_unit(vc.distribution_points(df, "final_survival_rate", "genotype"))) == {"b", "c"}


def test_critical_day_ties_go_to_the_earliest(panel):
    nan = float("nan")
    changes = {"a": [None, -1.0, -5.0, -1.0, -5.0], "b": [nan, 0.0], "c": [None, None]}
    df = panel(
        *(
            {"unit": u, "day": d, "survival_rate_change": v, "density_category": "x"}
            for u, vs in changes.items()
            for d, v in enumerate(vs)
        )
    )
    out = by_unit(vc.steepest_decline_per_unit(df, "density_category"))
    assert (out["a"]["critical_day"], out["a"]["max_decline"]) == (2, -5.0)
    assert (out["b"]["critical_day"], out["b"]["max_decline"]) == (1, 0.0)
    assert "c" not in out


def test_time_to_event(panel):
    df = panel(
        {"unit": "a", "day": 1, "survival_rate": 50.0, "genotype": "g"},
        {"unit": "a", "day": 9, "survival_rate": 0.99, "genotype": "h"},
        {"unit": "b", "day": 9, "survival_rate": 1.0},
        {"unit": "c", "day": 4, "survival_rate": None},
        {"unit": "d", "day": None, "survival_rate": 0.0},
        {"unit": None, "day": 1, "survival_rate": 0.0},
    )
    out = by_unit(vc.unit_time_to_event(df))
    assert {u: (r["duration"], r["event_observed"]) for u, r in out.items()} == {
        "a": (9, 1),
        "b": (9, 0),
        "c": (4, 0),
    }
    assert out["a"]["genotype"] == "g"
    thin = vc.unit_time_to_event(df.drop("genotype", "cross_id"))
    assert "genotype" not in thin.columns and thin.count() == 3


def test_latest_rows_keep_ties_and_null_units(panel):
    df = panel(
        {"unit": "a", "day": 1, "survival_rate": 9.0},
        {"unit": "a", "day": 2, "survival_rate": 8.0},
        {"unit": "a", "day": 2, "survival_rate": 7.0},
        {"unit": "b", "day": None, "survival_rate": 1.0},
        {"unit": None, "day": 5, "survival_rate": 2.0},
        {"unit": None, "day": 4, "survival_rate": 3.0},
    )
    assert sorted(r.survival_rate for r in vc.latest_rows(df).collect()) == [2.0, 7.0, 8.0]


def test_final_level(panel):
    df = panel(
        {"unit": "a", "day": 2, "survival_rate": 10.0, "genotype": "g", "housing": "Dish"},
        {"unit": "b", "day": 5, "survival_rate": 30.0, "genotype": "g", "housing": "Dish"},
        {"unit": "c", "day": 1, "survival_rate": 90.0, "genotype": "g", "housing": "Dish"},
        {"unit": "c", "day": 2, "survival_rate": None, "genotype": "g", "housing": "Dish"},
        {"unit": "d", "day": 1, "survival_rate": 50.0, "genotype": "g", "housing": "Tank"},
    )
    dish, tank = (r.asDict() for r in vc.final_level(df).collect())
    # Unit c drops out: its latest row is null.
    assert (dish["mean"], dish["n"]) == (20.0, 2)
    assert dish["se"] == pytest.approx(dish["sd"] / math.sqrt(2))
    assert (tank["housing"], tank["sd"], tank["se"]) == ("Tank", None, None)
    assert sorted(r.dish_id for r in vc.final_points(df).collect()) == ["a", "b"]


def test_distribution_filter_acts_on_units(panel):
    df = panel(
        {"unit": "a", "day": 1, "survival_rate": 9.0, "genotype": "x"},
        {"unit": "a", "day": 2, "survival_rate": 4.0, "genotype": "y"},
    )
    assert vc.distribution_points(df, "final_survival_rate", "genotype", ["y"]).count() == 0
    assert vc.distribution_points(df, "final_survival_rate", "genotype", ["x"]).first()[1] == 4.0


def test_histogram_bins(panel):
    values = [0.0, 4.9, 5.0, 12.0, float("nan")]
    df = panel(
        *({"unit": str(i), "day": 1, "survival_rate": v, "housing": "Dish"} for i, v in enumerate(values))
    )
    out = vc.distribution_histogram(df, "final_survival_rate", "housing", 5.0).collect()
    assert [(r["bin"], r["bin_start"], r["n"]) for r in out] == [(0, 0.0, 2), (1, 5.0, 1), (2, 10.0, 1)]
    with pytest.raises(ValueError):
        vc.distribution_histogram(df, "final_survival_rate", "housing", 0)


def test_box_of_few_values(panel):
    values = [1.0, 2.0, 10.0, 20.0]
    df = panel(
        *({"unit": str(i), "day": 1, "survival_rate": v, "housing": "Dish"} for i, v in enumerate(values))
    )
    r = vc.distribution_box(df, "final_survival_rate", "housing").first()
    assert (r.n, r.minimum, r.q1, r["median"], r.q3, r.maximum) == (4, 1.0, 1.75, 6.0, 12.5, 20.0)
    assert (r.lower_fence, r.upper_fence) == (1.75 - 1.5 * 10.75, 12.5 + 1.5 * 10.75)


def test_exact_quantiles_equal_the_builtin(spark):
    """Hot group, repeated values, tiny groups, doubles of all sizes and signs."""
    rng = random.Random(7)
    rows = [("hot", rng.choice([0.0, rng.gauss(0, 1), float(rng.randrange(5))])) for _ in range(5000)]
    rows += [("two", 1.0), ("two", 4.0), ("one", 3.0), ("same", 2.0), ("same", 2.0), ("same", 2.0)]
    rows += [("one", None), ("nan", float("nan")), (None, 1.0)]
    rows += [("wide", rng.choice([-1, 1]) * 2.0 ** rng.randrange(-1074, 1024)) for _ in range(500)]
    rows += [("near", math.nextafter(2.0 ** (i % 9), 0.0 if i % 2 else math.inf)) for i in range(99)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = {
        r.g: [r.n] + [r[f"q{i}"] for i in range(len(probs))]
        for r in vc.exact_quantiles(df, ["g"], "v", probs).collect()
    }
    want = {
        r.g: [r.n] + r.q
        for r in df.filter("g is not null and not isnan(v)")
        .groupBy("g")
        .agg(F.count("v").alias("n"), F.percentile("v", list(probs)).alias("q"))
        .collect()
    }
    assert set(got) == set(want)
    for g in want:
        assert got[g] == pytest.approx(want[g], rel=1e-12, abs=1e-12), g


def test_bits_are_in_the_order_of_doubles(spark):
    sizes = {5e-324, 2.0**-1022, math.nextafter(2.0**-1022, 0.0), 1.7976931348623157e308, math.inf, 0.1}
    sizes |= {x for e in range(-1073, 1024) for x in (2.0**e, math.nextafter(2.0**e, 0.0), math.nextafter(2.0**e, math.inf))}
    values = sorted({-x for x in sizes} | {0.0} | sizes)
    df = with_ordered_bits(spark.createDataFrame([(v,) for v in values], "v double"), "v", "b")
    assert {r.v: r.b for r in df.collect()} == {v: bits_of(v) for v in values}


def bits_of(v: float) -> int:
    size = int.from_bytes(struct.pack(">d", abs(v)), "big")
    return -size if v < 0 else size


def test_quantiles_between_infinities(spark):
    rows = [("up", x) for x in (1.0, 2.0, math.inf)] + [("down", x) for x in (-math.inf, 1.0, 3.0)]
    rows += [("both", -math.inf), ("both", math.inf), ("all", math.inf), ("all", math.inf)]
    df = spark.createDataFrame(rows, "g string, v double")
    out = {r.g: (r.q0, r.q1) for r in vc.exact_quantiles(df, ["g"], "v", (0.5, 0.75)).collect()}
    assert out["up"] == (2.0, math.inf) and out["down"] == (1.0, 2.0) and out["all"] == (math.inf, math.inf)
    assert math.isnan(out["both"][0]) and math.isnan(out["both"][1])


def test_critical_period_stats(panel):
    units = {"a": (-4.0, 3), "b": (-2.0, 5), "c": (-9.0, 10)}
    df = panel(
        *(
            {"unit": u, "day": d, "survival_rate_change": v if d == at else 0.0, "density_category": "x"}
            for u, (v, at) in units.items()
            for d in range(1, 12)
        )
    )
    r = vc.critical_period_stats(df).first()
    assert (r.n_units, r.mean_critical_day, r.median_critical_day) == (3, 6.0, 5.0)
    assert r.sd_critical_day == pytest.approx(statistics.stdev([3, 5, 10]))
    assert (r.mean_max_decline, r.median_max_decline) == (-5.0, -4.0)


def scatter_panel(panel, points):
    return panel(
        *(
            {
                "unit": str(i),
                "day": 1,
                "volume_per_fish": x,
                "survival_rate": y,
                "genotype": "g",
                "initial_count": 5,
            }
            for i, (x, y) in enumerate(points)
        )
    )


def test_trend(panel):
    df = scatter_panel(panel, [(1.0, 10.0), (2.0, 60.0), (3.0, 110.0), (float("inf"), 5.0), (None, 3.0)])
    r = vc.linear_trend(df).first()
    assert (r.n, r.slope, r.intercept) == (3, pytest.approx(50.0), pytest.approx(-40.0))
    assert (r.r, r.y_at_x_low, r.y_at_x_high) == (pytest.approx(1.0), pytest.approx(10.0), 100.0)


@pytest.mark.parametrize("points", [[(2.0, 1.0), (2.0, 5.0)], [(1.0, 5.0), (2.0, 5.0)], [(1.0, 1.0)], []])
def test_trend_without_variation_is_null(panel, points):
    r = vc.linear_trend(scatter_panel(panel, points)).first()
    assert r.n == len(points)
    assert all(r[c] is None for c in ("slope", "intercept", "r", "x_low", "y_at_x_high"))


def test_scatter_takes_the_latest_row_before_dropping_nulls(panel):
    base = {"unit": "a", "genotype": "g", "initial_count": 5, "volume_per_fish": 1.0}
    df = panel({**base, "day": 1, "survival_rate": 9.0}, {**base, "day": 2, "survival_rate": None})
    assert vc.scatter(df).count() == 0
    assert vc.scatter(df, day=1).count() == 1
    assert vc.scatter(df, day=1, wanted=["other"]).count() == 0
    assert set(vc.scatter(df).columns) >= {"vol_water_total", "housing", "density_category"}
