"""Two periods side by side: conditional aggregates instead of joining the periods."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cutpoint.config import GEN1, GEN2
from cutpoint.functions.welch import (
    Sample,
    critical_value,
    degrees_of_freedom,
    standard_error,
    t_statistic,
)

# Short names used for internal columns: before and after the change.
PERIODS = {"b": GEN1, "g": GEN2}


def per_period(name: str, aggregate: str, value: str) -> list[str]:
    """``aggregate`` of ``value`` over each period's rows, named b_<name> and g_<name>."""
    return [
        f"{aggregate}(CASE WHEN period_type = '{label}' THEN {value} END) AS {side}_{name}"
        for side, label in PERIODS.items()
    ]


def moments(name: str, value: str, present: str | None = None) -> list[str]:
    """Day count, mean and sample variance per period.

    ``present`` says which days count; when omitted, those with a value.
    """
    counted = value if present is None else f"CASE WHEN {present} THEN 1 END"
    return [
        *per_period(f"{name}_n", "count", counted),
        *per_period(f"{name}_mean", "avg", value),
        *per_period(f"{name}_var", "var_samp", value),
    ]


def samples(name: str) -> tuple[Sample, Sample]:
    """The columns made by ``moments``."""
    return tuple(Sample(f"{s}_{name}_n", f"{s}_{name}_mean", f"{s}_{name}_var") for s in PERIODS)


def in_both_periods(count_name: str) -> str:
    return f"(b_{count_name} > 0 AND g_{count_name} > 0)"


def add(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add computed columns."""
    return df.selectExpr("*", *[f"{expression} AS {name}" for name, expression in columns.items()])


def with_welch(df: DataFrame, *names: str) -> DataFrame:
    """Add t, degrees of freedom, standard error and critical values for ``moments`` columns."""
    tests = {}
    for name in names:
        before, after = samples(name)
        tests[f"{name}_t"] = t_statistic(before, after)
        tests[f"{name}_df"] = degrees_of_freedom(before, after)
        tests[f"{name}_se"] = standard_error(before, after)
    critical = {
        f"{name}_t{level}": critical_value(f"{name}_df", level) for name in names for level in (90, 95)
    }
    return add(add(df, tests), critical)


def tested(name: str) -> list[str]:
    """What the significance ladders read."""
    return [f"{name}_{part}" for part in ("t", "df", "t95", "t90")]
