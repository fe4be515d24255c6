import pytest

from cutpoint.config import Thresholds
from cutpoint.functions import ladders, labels as L
from cutpoint.functions.welch import INSUFFICIENT_DF, critical_value


def check(evaluate, expression, cases):
    rows, expected = zip(*cases)
    assert [r[0] for r in evaluate(list(rows), expression)] == list(expected)


def test_tail_latency(evaluate):
    check(
        evaluate,
        ladders.tail_latency("b", "g"),
        [
            ({"b": 10.0, "g": 20.1}, L.TAIL_WARNING),
            ({"b": 10.0, "g": 20.0}, L.TAIL_CAUTION),
            ({"b": 10.0, "g": 15.0}, L.OK),
            ({"b": 10.0, "g": 8.1}, L.OK),
            ({"b": 10.0, "g": 8.0}, L.TAIL_IMPROVED),
            ({"b": None, "g": 8.0}, L.OK),
        ],
    )


def test_queue_saturation(evaluate):
    check(
        evaluate,
        ladders.queue_saturation("b", "g"),
        [
            ({"b": 0.05, "g": 0.09}, L.QUEUE_NEGLIGIBLE),
            ({"b": 0.05, "g": 2.1}, L.QUEUE_WARNING),
            ({"b": 0.05, "g": 1.9}, L.QUEUE_CAUTION),
            ({"b": 0.05, "g": 1.5}, L.OK),
            ({"b": 3.0, "g": 6.1}, L.QUEUE_WARNING),
            ({"b": 3.0, "g": 2.4}, L.QUEUE_IMPROVED),
            ({"b": 0.9, "g": 0.1}, L.OK),
            ({"b": None, "g": 5.0}, L.OK),
        ],
    )


def test_breakeven_and_consistency(evaluate):
    check(
        evaluate,
        ladders.breakeven("c"),
        [
            ({"c": 0.0}, L.COST_LOWER),
            ({"c": 5.0}, L.COST_NEUTRAL),
            ({"c": 15.0}, L.COST_HIGHER),
            ({"c": 15.001}, L.COST_MUCH_HIGHER),
            ({"c": None}, L.COST_MUCH_HIGHER),
        ],
    )
    check(
        evaluate,
        ladders.cost_consistency("a", "p"),
        [
            ({"a": 10.1, "p": 0.0}, L.DIVERGENCE_WARNING),
            ({"a": None, "p": 10.1}, L.DIVERGENCE_WARNING),
            ({"a": 10.0, "p": 1.0}, L.DIVERGENCE_NOTICE),
            ({"a": 5.0, "p": 5.0}, L.DIVERGENCE_OK),
            ({"a": None, "p": None}, L.DIVERGENCE_OK),
        ],
    )


def test_reliability(evaluate):
    status = ladders.reliability(
        "t", "df", critical_value("df", 95), critical_value("df", 90), "b", "g", Thresholds()
    )
    check(
        evaluate,
        status,
        [
            ({"t": -9.0, "df": 4.0, "b": 99.0, "g": 90.0}, INSUFFICIENT_DF),
            ({"t": -3.0, "df": 25.0, "b": 99.0, "g": 98.5}, L.DEGRADED),
            ({"t": -3.0, "df": 25.0, "b": 99.9, "g": 99.87}, L.DEGRADED),
            ({"t": -3.0, "df": 25.0, "b": 99.0, "g": 98.8}, L.MINOR_05),
            ({"t": -3.0, "df": 25.0, "b": 100.0, "g": 99.9}, L.MINOR_05),
            ({"t": -1.9, "df": 25.0, "b": 99.0, "g": 90.0}, L.MINOR_10),
            ({"t": 5.0, "df": 25.0, "b": 90.0, "g": 99.0}, L.NO_DEGRADATION),
            ({"t": None, "df": None, "b": 90.0, "g": 80.0}, L.NO_DEGRADATION),
        ],
    )


def test_error_trend(evaluate):
    labels = [L.RATE_DOUBLED, L.RATE_UP_50, L.RATE_UP_20, L.RATE_UP_15, L.RATE_UP_10, L.RATE_UP_5, L.RATE_STABLE]
    ratios = [2.01, 1.6, 1.3, 1.16, 1.11, 1.06, 1.0]
    cases = [({"new": False, "b": 0.01, "g": 0.01 * x}, label) for x, label in zip(ratios, labels)]
    cases += [
        ({"new": False, "b": 0.01, "g": 0.009}, L.RATE_DOWN_5),
        ({"new": True, "b": 0.0, "g": 0.01}, L.NEW_ERROR),
    ]
    check(evaluate, ladders.error_trend("new", "b", "g"), cases)


def test_pattern_status(evaluate):
    check(
        evaluate,
        ladders.pattern_status("b", "g"),
        [
            ({"b": 1.0, "g": 1.21}, L.REGRESSION),
            ({"b": 1.0, "g": 1.2}, L.STABLE),
            ({"b": 1.0, "g": 0.79}, L.IMPROVEMENT),
            ({"b": None, "g": 0.79}, L.STABLE),
        ],
    )


@pytest.mark.parametrize("period", ["GEN1", "GEN2"])
def test_sufficiency_and_quality(evaluate, period):
    days = [6, 7, 13, 14, 20, 21, 29, 30]
    expected = {
        "GEN1": [L.GEN1_CRITICAL] * 3 + [L.GEN1_WARNING] * 4 + [L.GEN1_OK],
        "GEN2": [L.GEN2_CRITICAL] + [L.GEN2_WARNING] * 2 + [L.GEN2_OK] * 5,
    }[period]
    rows = [{"p": period, "d": d} for d in days]
    check(evaluate, ladders.data_sufficiency("p", "d"), list(zip(rows, expected)))
    quality = [L.QUALITY_CRITICAL] + [L.QUALITY_PRELIMINARY] * 2 + [L.QUALITY_ADEQUATE] * 2 + [L.QUALITY_STRONG] * 3
    check(evaluate, ladders.data_quality("d"), list(zip(rows, quality)))


def test_pattern_coverage(evaluate):
    check(
        evaluate,
        ladders.pattern_coverage("b", "g"),
        [
            ({"b": 95.0, "g": 90.0}, L.COVERAGE_HIGH),
            ({"b": 95.0, "g": 70.0}, L.COVERAGE_MODERATE),
            ({"b": 95.0, "g": 69.9}, L.COVERAGE_LOW),
            ({"b": 95.0, "g": None}, L.COVERAGE_LOW),
        ],
    )
