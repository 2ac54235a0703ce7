import math
import statistics

import pytest

import vitalcurve as vc
from vitalcurve.functions import pvalues
from vitalcurve.functions.pvalues import regularized_beta


def finals(panel, groups, column="density_category", **fixed):
    return panel(
        *(
            {"unit": f"{g}{i}", "day": 1, "survival_rate": v, column: g, **fixed}
            for g, values in groups.items()
            for i, v in enumerate(values)
        )
    )


def welch(panel, beaker, dish):
    df = finals(panel, {"Beaker": beaker, "Dish": dish}, "housing", genotype="g")
    return vc.welch_ttest(df).collect()


def t_tail(t, dof):
    return regularized_beta(dof / 2, 0.5, dof / (dof + t * t), t * t / (dof + t * t))


def f_tail(f, d1, d2):
    return regularized_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f))


def test_published_tails():
    assert t_tail(2, 10) == pytest.approx(0.0733880347707, abs=1e-12)
    assert f_tail(4, 2, 10) == pytest.approx(0.0529221494, abs=1e-10)
    # Exact: one and two degrees of freedom.
    assert t_tail(1, 1) == pytest.approx(0.5)
    assert t_tail(2, 2) == pytest.approx(1 - 2 / math.sqrt(2 + 4))
    assert f_tail(3, 2, 8) == pytest.approx((1 + 2 * 3 / 8) ** -4)


@pytest.mark.parametrize("dof", [1e6, 1e9])
def test_tails_of_many_degrees_reach_the_normal(dof):
    for t in (0.5, 2.0, 5.0):
        assert t_tail(t, dof) == pytest.approx(math.erfc(t / math.sqrt(2)), rel=2e-4)
    # F with two numerator degrees has a closed form.
    assert f_tail(3.0, 2, dof) == pytest.approx(math.exp(-dof / 2 * math.log1p(6 / dof)), rel=1e-7)


def _near_normal(t, dof):
    """The two-sided tail of t for many degrees of freedom, to terms of 1 / dof ** 2."""
    density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    first, second = t * (t * t + 1) / 4, t * (3 * t**6 - 7 * t**4 - 5 * t * t - 3) / 96
    return math.erfc(t / math.sqrt(2)) + 2 * density * (first / dof + second / dof**2)


@pytest.mark.parametrize("dof", [1e5, 1e6, 1e7, 1e8, 1e9, 1e10, 1e11, 1e12, 1e13, 1e14])
def test_tails_agree_with_the_normal_limit(dof):
    for t in (0.0, 1e-6, 0.1, 1.0, 2.0, 3.0):
        assert t_tail(t, dof) == pytest.approx(_near_normal(t, dof), rel=1e-9)
    assert t_tail(60.0, dof) == 0.0
    # F with an even number of numerator degrees tends to a finite sum, off by some 1 / dof
    for d1, f in ((2, 0.1), (2, 3.0), (4, 2.5), (10, 1.8)):
        half = d1 * f / 2
        limit = math.exp(-half) * sum(half**k / math.factorial(k) for k in range(d1 // 2))
        assert f_tail(f, d1, dof) == pytest.approx(limit, abs=1e-9 + 10 / dof)


def test_quadrature_meets_the_fraction(monkeypatch):
    """Both ways give the same on either side of the parameter where one hands over to the other."""
    cases = [(9_999, 0.5, 0.9995), (9_000, 3_000, 0.76), (9_000, 3_000, 0.74), (500, 9_000, 0.05), (9_999, 9_999, 0.49), (3, 9_999, 3e-4), (0.5, 9_000, 1e-4), (30, 20, 0.7), (2, 40, 0.1)]
    for a, b, x in cases:
        monkeypatch.setattr(pvalues, "_LARGE", 1e9)
        fraction = regularized_beta(a, b, x, 1 - x)
        monkeypatch.setattr(pvalues, "_LARGE", 0.0)
        assert regularized_beta(a, b, x, 1 - x) == pytest.approx(fraction, rel=1e-10)
    for n in (1e6, 1e10):
        assert regularized_beta(n, n, 0.5, 0.5) == pytest.approx(0.5, rel=1e-12)
        x = 1.001 * 3 / n
        assert regularized_beta(3e4, n, x, 1 - x) + regularized_beta(n, 3e4, 1 - x, x) == pytest.approx(1.0, rel=1e-12)


def test_welch(panel):
    a, b = [10.0, 12.0, 17.0, 11.0], [20.0, 25.0, 19.0]
    (r,) = welch(panel, a, b)
    va, vb = statistics.variance(a) / 4, statistics.variance(b) / 3
    t = (statistics.mean(a) - statistics.mean(b)) / math.sqrt(va + vb)
    dof = (va + vb) ** 2 / (va**2 / 3 + vb**2 / 2)
    assert (r.n_a, r.n_b, r.mean_a) == (4, 3, 12.5)
    assert (r.t_statistic, r.dof) == (pytest.approx(t), pytest.approx(dof))
    assert r.p_value == pytest.approx(t_tail(t, dof))
    assert r.note == ("Significant (p<0.05)" if r.p_value < 0.05 else "Not Significant (p>=0.05)")


def test_welch_with_too_few_values(panel):
    (r,) = welch(panel, [1.0], [2.0, 3.0])
    assert (r.t_statistic, r.p_value, r.note) == (None, None, "Insufficient data")
    assert (r.n_a, r.mean_a, r.mean_b) == (1, 1.0, 2.5)
    assert welch(panel, [1.0], []) == []


def test_welch_of_constant_sides(panel):
    (same,) = welch(panel, [5.0, 5.0], [5.0, 5.0])
    assert (same.t_statistic, same.p_value, same.note) == (None, None, "Calculation resulted in NaN")
    (apart,) = welch(panel, [5.0, 5.0], [9.0, 9.0])
    assert (apart.t_statistic, apart.p_value, apart.note) == (-math.inf, 0.0, "Significant (p<0.05)")


def test_welch_leaves_nan_out(panel):
    (r,) = welch(panel, [1.0, 2.0, float("nan")], [3.0, 5.0])
    assert (r.n_a, r.mean_a) == (2, 1.5)


def test_anova(panel):
    groups = {"a": [6.0, 8.0, 4.0, 5.0, 3.0, 4.0], "b": [8.0, 12.0, 9.0, 11.0, 6.0, 8.0], "c": [13.0, 9.0, 11.0, 8.0, 7.0, 12.0]}
    rows = vc.one_way_anova(finals(panel, groups)).collect()
    # Textbook example: F(2, 15) = 9.3.
    for r in rows:
        assert r.f_statistic == pytest.approx(9.264705882)
        assert (r.dof_between, r.dof_within) == (2, 15)
        assert r.p_value == pytest.approx(0.00239875, abs=1e-6)
        assert r.conclusion.startswith("Significant")
    assert rows[0].sd == pytest.approx(statistics.pstdev(groups["a"]))


def test_anova_of_two_groups_is_the_pooled_t(panel):
    a, b = [1.0, 4.0, 2.0], [5.0, 9.0, 6.0, 7.0]
    r = vc.one_way_anova(finals(panel, {"a": a, "b": b})).first()
    pooled = (2 * statistics.variance(a) + 3 * statistics.variance(b)) / 5
    t = (statistics.mean(a) - statistics.mean(b)) / math.sqrt(pooled * (1 / 3 + 1 / 4))
    assert r.f_statistic == pytest.approx(t * t)


def test_anova_keeps_small_groups_out_of_f(panel):
    groups = {"a": [1.0, 2.0], "b": [3.0, 5.0], "c": [100.0], "d": [float("nan"), math.inf]}
    rows = {r.density_category: r for r in vc.one_way_anova(finals(panel, groups)).collect()}
    two = vc.one_way_anova(finals(panel, {k: groups[k] for k in "ab"})).first()
    assert rows["c"].f_statistic == pytest.approx(two.f_statistic)
    assert (rows["c"].n, rows["c"].mean, rows["c"].sd) == (1, 100.0, 0.0)
    assert (rows["d"].n, rows["d"].mean) == (0, None)


def test_anova_edges(panel):
    alone = vc.one_way_anova(finals(panel, {"a": [1.0, 2.0], "b": [3.0]})).collect()
    assert [(r.f_statistic, r.conclusion) for r in alone] == [(None, "ANOVA Not Performed")] * 2
    same = vc.one_way_anova(finals(panel, {"a": [2.0, 2.0], "b": [2.0, 2.0]})).first()
    assert (same.f_statistic, same.p_value, same.conclusion) == (None, None, "Result is NaN")
    apart = vc.one_way_anova(finals(panel, {"a": [2.0, 2.0], "b": [3.0, 3.0]})).first()
    assert (apart.f_statistic, apart.p_value) == (math.inf, 0.0)


def test_anova_of_a_column(panel):
    df = panel(
        *(
            {"unit": f"{g}{i}", "day": d, "initial_count": v if d == 1 else 99, "density_category": g}
            for g, vs in {"a": [1, 2], "b": [5, 7]}.items()
            for i, v in enumerate(vs)
            for d in (1, 2)
        )
    )
    rows = vc.one_way_anova(df, "initial_count").collect()
    assert [r["mean"] for r in rows] == [1.5, 6.0]
