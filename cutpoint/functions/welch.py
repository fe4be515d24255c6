"""Welch's two-sample test and the confidence intervals built on it, as SQL expressions."""

from __future__ import annotations

from dataclasses import dataclass

from cutpoint.functions.numeric import first_match, labelled, number, ratio

# Two-sided critical values of Student's t by degrees of freedom (upper bound of the
# range, value), and the value beyond the last range. Below MIN_DF no value is given.
MIN_DF = 5
T_90 = ((7, 2.015), (11, 1.860), (16, 1.796), (21, 1.746), (31, 1.711), (61, 1.684))
T_90_BEYOND = 1.645
T_95 = ((7, 2.571), (11, 2.306), (16, 2.201), (21, 2.120), (31, 2.064), (61, 2.021))
T_95_BEYOND = 1.960

# Significance labels.
INSUFFICIENT_DF = "INSUFFICIENT DF"
SIGNIFICANT_05 = "SIGNIFICANT (p<0.05)"
SIGNIFICANT_10 = "SIGNIFICANT (p<0.10)"
NOT_SIGNIFICANT = "NOT SIGNIFICANT"


@dataclass(frozen=True)
class Sample:
    """Expressions for count, mean and sample variance of one period's daily values."""

    n: str
    mean: str
    var: str

    @property
    def mean_variance(self) -> str:
        return f"({self.var} / nullif({self.n}, 0))"


def standard_error(before: Sample, after: Sample) -> str:
    return f"sqrt({before.mean_variance} + {after.mean_variance})"


def t_statistic(before: Sample, after: Sample) -> str:
    return ratio(f"({after.mean} - {before.mean})", standard_error(before, after))


def degrees_of_freedom(before: Sample, after: Sample) -> str:
    """Welch–Satterthwaite. NULL when both variances are zero or a period has one value."""

    def share(s: Sample) -> str:
        return f"{s.mean_variance} * {s.mean_variance} / nullif({s.n} - 1, 0)"

    pooled = f"({before.mean_variance} + {after.mean_variance})"
    return ratio(f"{pooled} * {pooled}", f"({share(before)} + {share(after)})")


def critical_value(df: str, level: int) -> str:
    """Critical value for 90 or 95. NULL df matches no range and takes the value beyond them."""
    table, beyond = {90: (T_90, T_90_BEYOND), 95: (T_95, T_95_BEYOND)}[level]
    arms = [(f"{df} < {MIN_DF}", "CAST(NULL AS DOUBLE)")]
    arms += [(f"{df} < {bound}", number(value)) for bound, value in table]
    return f"({first_match(arms, number(beyond))})"


def significance(t: str, df: str, t95: str, t90: str) -> str:
    """Two-sided label."""
    return labelled(
        [
            (f"{df} < {MIN_DF}", INSUFFICIENT_DF),
            (f"abs({t}) > {t95}", SIGNIFICANT_05),
            (f"abs({t}) > {t90}", SIGNIFICANT_10),
        ],
        NOT_SIGNIFICANT,
    )


def drop_significance(t: str, df: str, t95: str, t90: str) -> str:
    """Label for a fall only (the second period is lower)."""
    return labelled(
        [
            (f"{df} < {MIN_DF}", INSUFFICIENT_DF),
            (f"{t} < -{t95}", SIGNIFICANT_05),
            (f"{t} < -{t90}", SIGNIFICANT_10),
        ],
        NOT_SIGNIFICANT,
    )


def linear_interval(effect: str, t_crit: str, error: str, base: str) -> tuple[str, str]:
    """effect ± t · error / base in percent; the base is treated as known."""
    half_width = f"{ratio(f'{t_crit} * {error}', base)} * 100D"
    return f"({effect} - {half_width})", f"({effect} + {half_width})"


def fieller_terms(name: str, before: Sample, after: Sample, t_crit: str) -> list[dict[str, str]]:
    """Columns for the Fieller interval of the ratio of the two means, to be added in steps.

    The interval is the range of r in which (mean_after − r · mean_before) is within t standard
    errors of zero: a r² − 2 h r + c ≤ 0. It is finite when a and the discriminant allow it.
    """
    t2 = f"{t_crit} * {t_crit}"
    a, h, c, root = (f"{name}_{part}" for part in ("a", "h", "c", "root"))
    return [
        {
            a: f"{before.mean} * {before.mean} - {t2} * {before.mean_variance}",
            h: f"{before.mean} * {after.mean}",
            c: f"{after.mean} * {after.mean} - {t2} * {after.mean_variance}",
        },
        {root: f"CASE WHEN {a} > 0 AND {h} * {h} - {a} * {c} >= 0 THEN sqrt({h} * {h} - {a} * {c}) END"},
    ]


def fieller_interval(name: str) -> tuple[str, str]:
    """Lower and upper speedup in percent, over ``fieller_terms``; NULL without a finite range."""
    a, h, root = f"{name}_a", f"{name}_h", f"{name}_root"
    return tuple(
        f"CASE WHEN {root} IS NOT NULL THEN (1D - ({h} {sign} {root}) / {a}) * 100D END"
        for sign in ("+", "-")
    )
