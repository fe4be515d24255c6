"""SQL expressions for rounding, guarded arithmetic and rule ladders.

The expression library builds Spark SQL text: a report is a handful of ``selectExpr`` and
``spark.sql`` calls, and Catalyst sees the same plan as from Column objects.
"""

from __future__ import annotations


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(value: float) -> str:
    """A double literal."""
    return f"{value!r}D"


def rounded(x: str, places: int) -> str:
    """HALF_UP rounding through a decimal, so that ties do not depend on the binary form of ``x``.

    Values beyond 10^28, NaN and infinity do not fit the decimal: the query fails (in ANSI mode, the default).
    """
    return f"CAST(round(CAST({x} AS DECIMAL(38,10)), {places}) AS DOUBLE)"


def shown(x: str, places: int) -> str:
    """A number as text with a fixed count of decimals, whatever its type."""
    return f"CAST(round(CAST({x} AS DECIMAL(38,10)), {places}) AS STRING)"


def ratio(x: str, y: str) -> str:
    """x / y, NULL when y is zero (ANSI division by zero would fail the job)."""
    return f"(CAST({x} AS DOUBLE) / nullif(CAST({y} AS DOUBLE), 0D))"


def percent(part: str, whole: str) -> str:
    return ratio(f"({part}) * 100D", whole)


def change_pct(before: str, after: str) -> str:
    """Relative change in percent; positive means the second period is higher."""
    return ratio(f"({after} - {before}) * 100D", before)


def speedup_pct(before: str, after: str) -> str:
    """Relative time saved in percent; positive means the second period is faster."""
    return f"((1D - {ratio(after, before)}) * 100D)"


def first_match(arms: list[tuple[str, str]], default: str) -> str:
    """CASE with arms in order. A condition that is NULL falls through to the next arm."""
    rules = " ".join(f"WHEN {condition} THEN {value}" for condition, value in arms)
    return f"CASE {rules} ELSE {default} END"


def labelled(arms: list[tuple[str, str]], default: str) -> str:
    """``first_match`` over label texts."""
    return first_match([(condition, text(label)) for condition, label in arms], text(default))
