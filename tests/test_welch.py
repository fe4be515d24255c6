import math
import statistics

import pytest

from cutpoint.functions import welch as W
from cutpoint.functions.numeric import rounded, shown
from cutpoint.functions.welch import Sample

B, G = Sample("nb", "mb", "vb"), Sample("ng", "mg", "vg")


def test_critical_values_by_degrees_of_freedom(evaluate):
    df = [4.9, 5.0, 6.9, 7.0, 10.9, 11.0, 15.9, 16.0, 20.9, 21.0, 30.9, 31.0, 60.9, 61.0, None]
    got = evaluate([{"df": x} for x in df], W.critical_value("df", 90), W.critical_value("df", 95))
    ninety = [None, 2.015, 2.015, 1.86, 1.86, 1.796, 1.796, 1.746, 1.746, 1.711, 1.711, 1.684, 1.684, 1.645, 1.645]
    ninety_five = [None, 2.571, 2.571, 2.306, 2.306, 2.201, 2.201, 2.12, 2.12, 2.064, 2.064, 2.021, 2.021, 1.96, 1.96]
    assert got == list(zip(ninety, ninety_five))


def test_welch_against_hand_computation(evaluate):
    before, after = [4.0, 5.5, 6.0, 5.0, 4.5, 7.0], [3.0, 3.5, 5.0, 2.5]
    vb, vg = statistics.variance(before), statistics.variance(after)
    mb, mg = statistics.mean(before), statistics.mean(after)
    row = {"nb": 6, "mb": mb, "vb": vb, "ng": 4, "mg": mg, "vg": vg}
    ((t, df, se),) = evaluate([row], W.t_statistic(B, G), W.degrees_of_freedom(B, G), W.standard_error(B, G))
    error = math.sqrt(vb / 6 + vg / 4)
    assert se == pytest.approx(error)
    assert t == pytest.approx((mg - mb) / error)
    assert df == pytest.approx((vb / 6 + vg / 4) ** 2 / ((vb / 6) ** 2 / 5 + (vg / 4) ** 2 / 3))


def test_no_spread_or_one_day_gives_null_and_not_significant(evaluate):
    flat = {"nb": 10, "mb": 2.0, "vb": 0.0, "ng": 10, "mg": 3.0, "vg": 0.0}
    single = {"nb": 1, "mb": 2.0, "vb": None, "ng": 10, "mg": 3.0, "vg": 1.0}
    t, df = W.t_statistic(B, G), W.degrees_of_freedom(B, G)
    label = W.significance(t, df, W.critical_value(df, 95), W.critical_value(df, 90))
    assert evaluate([flat, single], t, df, label, W.critical_value(df, 90)) == [
        (None, None, "NOT SIGNIFICANT", 1.645)
    ] * 2


@pytest.mark.parametrize("sign", [1, -1])
def test_significance_labels(evaluate, sign):
    rows = [{"t": sign * t, "df": df} for t, df in [(3, 4.9), (2.2, 25.0), (1.9, 25.0), (1.0, 25.0)]]
    critical = (W.critical_value("df", 95), W.critical_value("df", 90))
    both = [r[0] for r in evaluate(rows, W.significance("t", "df", *critical))]
    fall = [r[0] for r in evaluate(rows, W.drop_significance("t", "df", *critical))]
    expected = [W.INSUFFICIENT_DF, W.SIGNIFICANT_05, W.SIGNIFICANT_10, W.NOT_SIGNIFICANT]
    assert both == expected
    assert fall == (expected if sign < 0 else [W.INSUFFICIENT_DF] + [W.NOT_SIGNIFICANT] * 3)


def fieller(evaluate, rows):
    first, second = W.fieller_terms("f", B, G, "t")
    names = {**first}
    # One expression per bound: the steps are put into each other here.
    root = second["f_root"]
    for name, expression in names.items():
        root = root.replace(name, f"({expression})")
    bounds = []
    for bound in W.fieller_interval("f"):
        bound = bound.replace("f_root", f"({root})")
        for name, expression in names.items():
            bound = bound.replace(name, f"({expression})")
        bounds.append(bound)
    return evaluate(rows, *bounds)


def test_fieller_interval(evaluate):
    base = {"nb": 30, "mb": 10.0, "vb": 4.0, "ng": 20, "mg": 6.0, "vg": 3.0, "t": 1.684}
    rows = [base, {**base, "vb": 30 * 100.0}, {**base, "t": None}, {**base, "vb": 0.0, "vg": 0.0}]
    found = fieller(evaluate, rows)
    lower, upper = found[0]
    assert lower < 40 < upper
    for bound in (lower, upper):  # at each bound the difference is exactly t standard errors
        r = 1 - bound / 100
        assert abs(6 - 10 * r) == pytest.approx(1.684 * math.sqrt(3 / 20 + r * r * 4 / 30))
    assert found[1] == (None, None)
    assert found[2] == (None, None)
    assert found[3] == pytest.approx((40, 40))


def test_linear_interval(evaluate):
    lower, upper = W.linear_interval("effect", "t", "se", "base")
    rows = [{"effect": 5.0, "t": 2.0, "se": 1.0, "base": 50.0}, {"effect": 5.0, "t": 2.0, "se": 1.0, "base": 0.0}]
    assert evaluate(rows, lower, upper) == [(1.0, 9.0), (None, None)]


def test_rounding_ties_and_text(evaluate):
    rows = [{"x": x} for x in (1.005, -1.005, 2.675, 10.0, None)]
    assert evaluate(rows, rounded("x", 2), shown("x", 2)) == [
        (1.01, "1.01"),
        (-1.01, "-1.01"),
        (2.68, "2.68"),
        (10.0, "10.00"),
        (None, None),
    ]
