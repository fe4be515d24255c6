"""Plain-language text for each label. Own wording; no report depends on it."""

from __future__ import annotations

from cutpoint.functions import labels as L
from cutpoint.functions import welch as W
from cutpoint.functions.numeric import text


def explain(label: str, texts: dict[str, str]) -> str:
    """Look a label's text up. A text that starts with ``concat(`` is an expression."""
    arms = " ".join(
        f"WHEN {text(key)} THEN {value if value.startswith('concat(') else text(value)}"
        for key, value in texts.items()
    )
    return f"CASE {label} {arms} END"


SUFFICIENCY = {
    L.GEN2_CRITICAL: "Under a week of data after the change: no test can be relied on yet.",
    L.GEN2_WARNING: "One to two weeks after the change: trends show, but the intervals are still wide.",
    L.GEN2_OK: "Two weeks or more after the change: every weekday was seen at least twice.",
    L.GEN1_CRITICAL: "Under two weeks of baseline: its spread is poorly known and only large effects "
    "can be found. Look further back.",
    L.GEN1_WARNING: "Two to four weeks of baseline: usable overall, thin per weekday. Look further back.",
    L.GEN1_OK: "A month or more of baseline: its spread is well known, also per weekday.",
    L.OK: "Nothing to object to.",
}

WEEKDAY_SIGNIFICANCE = {
    W.INSUFFICIENT_DF: "Too few days of this weekday for a test. Collect more days.",
    W.SIGNIFICANT_05: "This weekday differs at the 5% level; the sign of speedup_pct gives the direction.",
    W.SIGNIFICANT_10: "This weekday differs at the 10% level only: a hint, no proof.",
    W.NOT_SIGNIFICANT: "The difference on this weekday is within ordinary day-to-day variation.",
}

PERF_SIGNIFICANCE = {
    W.INSUFFICIENT_DF: "Too few days for a test of execution times; no interval is given.",
    W.SIGNIFICANT_05: "Execution times differ at the 5% level; the interval gives the likely size.",
    W.SIGNIFICANT_10: "Execution times differ at the 10% level only; more days may settle it.",
    W.NOT_SIGNIFICANT: "Execution times vary so much from day to day that the difference may be chance.",
}

COST_SIGNIFICANCE = {
    W.INSUFFICIENT_DF: "Too few days for a test of credits per query.",
    W.SIGNIFICANT_05: "Credits per query differ at the 5% level, independent of query volume.",
    W.SIGNIFICANT_10: "Credits per query differ at the 10% level only; more days may settle it.",
    W.NOT_SIGNIFICANT: "Credits per query vary so much from day to day that the difference may be chance.",
}

TAIL = {
    L.TAIL_WARNING: "The slowest one percent takes more than twice as long as before. Look at the "
    "pattern regressions for the causes.",
    L.TAIL_CAUTION: "The slowest one percent takes over one and a half times as long as before.",
    L.TAIL_IMPROVED: "The slowest one percent became at least a fifth faster.",
    L.OK: "The slowest one percent lies between 0.8 and 1.5 times its earlier time.",
}

BREAKEVEN = {
    L.COST_LOWER: "A query costs no more credits than before, in spite of any higher hourly rate.",
    L.COST_NEUTRAL: "A query costs up to 5% more credits: practically the same.",
    L.COST_HIGHER: "A query costs 5 to 15% more credits: the time saved does not pay for the rate.",
    L.COST_MUCH_HIGHER: "A query costs over 15% more credits (or the change is unknown). Review size "
    "and idle time of the warehouses.",
}

CONSISTENCY = {
    L.DIVERGENCE_WARNING: "query volume moved a lot between days; read both averages before acting.",
    L.DIVERGENCE_NOTICE: "query volume moved somewhat between days; both averages are usable.",
    L.DIVERGENCE_OK: "the cost change does not depend on how days are weighted.",
}

ERROR_TREND = {
    L.NEW_ERROR: "Not seen before the change.",
    L.RATE_DOUBLED: "More than twice as frequent per query as before.",
    L.RATE_UP_50: "Over 50% more frequent per query.",
    L.RATE_UP_20: "Over 20% more frequent per query.",
    L.RATE_UP_15: "Over 15% more frequent per query.",
    L.RATE_UP_10: "Over 10% more frequent per query; matters at high volume.",
    L.RATE_UP_5: "Over 5% more frequent per query; matters at very high volume.",
    L.RATE_DOWN_5: "At least 5% less frequent per query.",
    L.RATE_STABLE: "About as frequent per query as before.",
}

PATTERN_STATUS = {
    L.REGRESSION: "Median time rose by over 20%. A high impact score means much extra time in total.",
    L.IMPROVEMENT: "Median time fell by over 20%. A high impact score means much time saved in total.",
    L.STABLE: "Median time stayed within 20%.",
}

DATA_QUALITY = {
    L.QUALITY_CRITICAL: "Under a week after the change: keep collecting.",
    L.QUALITY_PRELIMINARY: "One to two weeks after the change: first signals only.",
    L.QUALITY_ADEQUATE: "Two to three weeks after the change: enough for an overall assessment.",
    L.QUALITY_STRONG: "Three weeks or more after the change: the overall test is strong.",
}

COVERAGE = {
    L.COVERAGE_HIGH: "nearly all queries recur in both periods, so all cost views agree.",
    L.COVERAGE_MODERATE: "some queries occur in one period only; compare the two cost changes.",
    L.COVERAGE_LOW: "many queries occur in one period only; the mix changed and cost may reflect it.",
}

METHODOLOGY = (
    "Performance: speedup of the mean daily median execution time, over successful, uncached runs of "
    "patterns found in both periods; Welch test on days, Fieller 90% interval. "
    "Cost: change of the mean daily credits per uncached query, Welch test on days, 90% interval; the "
    "pattern cost divides the same credits by matched runs only and is a diagnostic. "
    "Reliability: Welch test on daily success rates of all runs; degraded needs significance at 5% and "
    "a drop of 0.5 points or a failure rate change above 25%. "
    "Assessment: favorable results need the unfavorable interval bound to be acceptable, unfavorable "
    "results need the favorable bound to be unacceptable; reliability, tail latency and queueing are "
    "looked at first. Weight: one observation per day in every test."
)
