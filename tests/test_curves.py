import dataclasses
import math

import pytest

import vitalcurve as vc


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_one_unit_has_no_band(panel):
    df = panel(*({"unit": "a", "day": d, "survival_rate": 90.0 - d, "density_category": "x"} for d in range(3)))
    for r in rows_of(vc.survival_curve(df, "density_category")):
        assert r["n"] == 1 and r["sd"] is None and r["upper"] is None and r["lower"] is None


def test_band_is_clamped_on_both_sides(panel):
    df = panel(
        {"unit": "a", "day": 0, "survival_rate": 100.0, "density_category": "x"},
        {"unit": "b", "day": 0, "survival_rate": 20.0, "density_category": "x"},
        {"unit": "c", "day": 0, "survival_rate": 90.0, "density_category": "x"},
    )
    (r,) = rows_of(vc.survival_curve(df, "density_category"))
    assert r["upper"] == 100.0 and r["mean"] == 70.0 and r["lower"] == pytest.approx(70 - r["sd"])


def test_nan_is_not_dropped_and_not_clamped(panel):
    df = panel(
        {"day": 0, "survival_rate": float("nan"), "density_category": "x"},
        {"day": 0, "survival_rate": 50.0, "density_category": "x"},
    )
    (r,) = rows_of(vc.survival_curve(df, "density_category"))
    assert r["n"] == 2 and math.isnan(r["mean"]) and math.isnan(r["upper"]) and math.isnan(r["lower"])


def test_curve_drops_nulls_and_filters(panel):
    df = panel(
        {"day": 0, "survival_rate": 50.0, "density_category": "x"},
        {"day": None, "survival_rate": 10.0, "density_category": "x"},
        {"day": 0, "survival_rate": None, "density_category": "x"},
        {"day": 0, "survival_rate": 10.0, "density_category": None},
        {"day": 0, "survival_rate": 30.0, "density_category": "y"},
    )
    assert [(r["density_category"], r["mean"]) for r in rows_of(vc.survival_curve(df, "density_category"))] == [
        ("x", 50.0),
        ("y", 30.0),
    ]
    assert vc.survival_curve(df, "density_category", ["y"]).count() == 1
    empty = vc.survival_curve(df, "density_category", [])
    assert empty.count() == 0 and "upper" in empty.columns


def test_remaining_fills_null_groups_and_has_no_upper_limit(panel):
    df = panel(
        {"day": 1, "remaining": 500.0},
        {"day": 1, "remaining": 0.0, "housing": "Dish"},
        {"day": 1, "remaining": 400.0, "housing": "Dish"},
    )
    out = {r["housing_density_group"]: r for r in rows_of(vc.remaining_curve(df))}
    assert set(out) == {"Unknown - Unknown", "Dish - Unknown"}
    dish = out["Dish - Unknown"]
    assert dish["lower"] == 0.0 and dish["upper"] == pytest.approx(200 + dish["sd"])


def test_rate_change_uses_standard_error(panel):
    values = [-1.0, -2.0, -6.0, 1.0]
    df = panel(*({"day": 1, "survival_rate_change": v, "genotype_housing": "g"} for v in values))
    (r,) = rows_of(vc.rate_change_curve(df))
    assert r["se"] == pytest.approx(r["sd"] / 2) and r["upper"] == pytest.approx(-2 + r["se"])
    assert r["lower"] == pytest.approx(-2 - r["se"])


def test_small_cells_are_dropped_before_the_worst_day(panel):
    cells = {1: [-3.0, -3.0, -3.0], 2: [-50.0, -50.0], 3: [-3.0, -3.0, -3.0]}
    df = panel(
        *(
            {"day": d, "survival_rate_change": v, "density_category": "x"}
            for d, vs in cells.items()
            for v in vs
        )
    )
    kept = rows_of(vc.rate_change_curve(df, "density_category", min_count=3))
    assert [r["days_since_fertilization"] for r in kept] == [1, 3]
    assert rows_of(vc.worst_day(df)) == [
        {"density_category": "x", "worst_day": 1, "worst_mean_change": -3.0}
    ]


def test_median_survival(panel):
    def unit(name, group, *means):
        return [
            {"unit": name, "day": d, "survival_rate": m, "cross_id": group} for d, m in enumerate(means, 1)
        ]

    df = panel(
        *unit("a", "never", 90.0, 80.0, 70.0),
        *unit("b", "rebound", 60.0, 40.0, 55.0),
        *unit("c", "nothing", None, None),
        *unit("d", None, 30.0),
        *unit("e", "never", 90.0, 80.0, 70.0),
        *unit(None, "never", 90.0),
    )
    out = {r["cross_id"]: r for r in rows_of(vc.median_survival(df, "cross_id"))}
    assert set(out) == {"never", "rebound", None}
    assert (out["never"]["median_day"], out["never"]["median_day_text"]) == (None, "> Max Day")
    assert out["never"]["n_units"] == 3
    assert (out["rebound"]["median_day"], out["rebound"]["median_day_text"]) == (2, "2")
    # A null group has a row, but the count does not join to it.
    assert (out[None]["median_day"], out[None]["n_units"]) == (1, 0)
    assert vc.median_survival(df, "cross_id", []).count() == 0
    assert vc.median_survival(df, "cross_id", ["never"]).count() == 1


def test_median_survival_reached_on_an_unknown_day(panel):
    df = panel({"unit": "a", "day": None, "survival_rate": 10.0, "cross_id": "x"})
    (r,) = rows_of(vc.median_survival(df, "cross_id"))
    assert r["median_day"] is None and r["median_day_text"] is None


def test_unit_in_two_groups_has_all_rows_under_both(panel):
    df = panel(
        {"unit": "a", "day": 1, "survival_rate": 9.0, "cross_id": "x", "cumulative_deaths": 1.0},
        {"unit": "a", "day": 2, "survival_rate": 8.0, "cross_id": "y", "cumulative_deaths": 2.0},
        {"unit": "a", "day": None, "survival_rate": 7.0, "cross_id": None, "cumulative_deaths": None},
        {"unit": "b", "day": None, "survival_rate": 6.0, "cross_id": "x", "cumulative_deaths": 3.0},
        {"unit": None, "day": 1, "survival_rate": 5.0, "cross_id": "x", "cumulative_deaths": 3.0},
    )
    lines = sorted(
        (r["dish_id"], r["cross_id"], r["survival_rate"]) for r in rows_of(vc.unit_curves(df, "cross_id"))
    )
    # Unit b has no known day, and a null unit no line.
    assert lines == [("a", g, v) for g in "xy" for v in (7.0, 8.0, 9.0)]
    counts = sorted(
        (r["cross_id"], r["cumulative_deaths"]) for r in rows_of(vc.cumulative_events(df, "cross_id"))
    )
    assert counts == [("x", 1.0), ("x", 2.0), ("y", 1.0), ("y", 2.0)]
    # The filter comes before the pairing.
    assert vc.unit_curves(df, "cross_id", ["y"]).count() == 1


def test_faceted_curves(panel):
    df = panel(
        {"unit": "a", "day": 1, "survival_rate": 9.0, "housing": "Dish", "density_category": "low"},
        {"unit": "b", "day": 1, "survival_rate": 9.0, "housing": "Beaker", "density_category": "low"},
        {"unit": "c", "day": 1, "survival_rate": 9.0, "housing": None, "density_category": "low"},
    )
    assert vc.faceted_curves(df).count() == 2
    assert vc.faceted_curves(df, "housing", "density_category", housings=["Dish"]).count() == 1
    assert vc.faceted_curves(df, densities=[]).count() == 0
    for facet, color in (("housing", "housing"), ("genotype", "housing")):
        with pytest.raises(ValueError):
            vc.faceted_curves(df, facet, color)


def test_curve_takes_any_column_names(spark):
    df = spark.createDataFrame(
        [("u", 1, 2.0, 7), ("v", 1, 4.0, 7)], "id string, step int, level double, arm int"
    )
    spec = vc.PanelSpec(unit="id", time="step", survival="level")
    (r,) = rows_of(vc.survival_curve(df, "arm", spec=spec))
    assert (r["arm"], r["step"], r["mean"], r["n"]) == ("7", 1, 3.0, 2)


def test_every_operator_takes_renamed_columns(spark, small_panel):
    """The same rows, whatever the columns are called."""
    spec = vc.PanelSpec(**{f.name: f"zz_{getattr(vc.PANEL, f.name)}" for f in dataclasses.fields(vc.PanelSpec)})
    renamed = small_panel.toDF(*(f"zz_{c}" for c in small_panel.columns))
    operators = (
        lambda p, s: vc.survival_curve(p, s.density, spec=s),
        lambda p, s: vc.remaining_curve(p, spec=s),
        lambda p, s: vc.rate_change_curve(p, spec=s),
        lambda p, s: vc.worst_day(p, spec=s),
        lambda p, s: vc.median_survival(p, s.density, spec=s),
        lambda p, s: vc.unit_curves(p, s.genotype_housing, spec=s),
        lambda p, s: vc.cumulative_events(p, s.density, spec=s),
        lambda p, s: vc.faceted_curves(p, spec=s),
        lambda p, s: vc.distribution_points(p, "final_survival_rate", s.genotype, spec=s),
        lambda p, s: vc.distribution_box(p, "critical_day", s.cross, spec=s),
        lambda p, s: vc.distribution_histogram(p, "final_survival_rate", s.housing, 5.0, spec=s),
        lambda p, s: vc.critical_period_stats(p, spec=s),
        lambda p, s: vc.unit_time_to_event(p, spec=s),
        lambda p, s: vc.individuals_weighted(p, spec=s),
        lambda p, s: vc.nelson_aalen(vc.individuals_weighted(p, spec=s), groups=s.strata),
        lambda p, s: vc.nelson_aalen(vc.individuals(p, spec=s), groups=s.strata),
        lambda p, s: vc.final_level(p, spec=s),
        lambda p, s: vc.final_points(p, spec=s),
        lambda p, s: vc.scatter(p, spec=s),
        lambda p, s: vc.linear_trend(p, per_fish=False, spec=s),
        lambda p, s: vc.welch_ttest(p, with_p=False, spec=s),
        lambda p, s: vc.one_way_anova(p, with_p=False, spec=s),
        lambda p, s: vc.panel_preview(p, spec=s),
    )
    for i, op in enumerate(operators):
        plain, other = op(small_panel, vc.PANEL), op(renamed, spec)
        assert [c.removeprefix("zz_") for c in other.columns] == plain.columns, i
        assert as_rounded(plain) == as_rounded(other), i


def as_rounded(df):
    def short(v):
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    return sorted(str([short(v) for v in r]) for r in df.collect())
