"""The same results in DuckDB SQL over the driver tables, written independently of the library.

Each statement is a list of named steps over one of the two bindings. Percentiles use DuckDB's own
quantile function on seconds, matching uses INTERSECT, periods are read by FILTER.
"""

from __future__ import annotations

from checks.scenarios import SCENARIOS
from cutpoint.operators.counterfactual import Effect


def r(x: str, places: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,10)), {places}) AS DOUBLE)"


EVENTS = {
    "first": "2024-01-01",
    "cutover": "2024-01-16",
    "last": "2024-01-30",
    "week": "2024-01-01",
    "runs": """
        SELECT CAST(event_id AS VARCHAR) AS query_id, event_type || ' ' || k AS query_text, k AS hash,
               ts AS start_time, CAST(round(value * 1000) AS BIGINT) AS ms,
               'ANALYTICS_' || (user_id % 4) AS wh,
               CASE WHEN event_type <> 'error' THEN 'SUCCESS'
                    WHEN CAST(k AS INT) < 10 THEN 'INCIDENT' ELSE 'FAIL' END AS status,
               CASE WHEN event_type = 'view' THEN 0 ELSE event_id + 1 END AS bytes,
               CAST(k AS BIGINT) * 10 AS wait_ms
        FROM (SELECT *, regexp_extract(props, ': *([0-9]+)', 1) AS k FROM events)""",
    "meters": """
        SELECT ts AS start_time, 'ANALYTICS_' || (user_id % 4) AS wh,
               CAST(value AS DECIMAL(38,9)) AS credits
        FROM events WHERE event_type = 'purchase'""",
}
ORDERS = {
    "first": "1997-06-01",
    "cutover": "1998-06-01",
    "last": "1999-05-31",
    "week": "1997-05-26",
    "runs": """
        SELECT l_orderkey || '-' || l_linenumber AS query_id, 'part ' || l_partkey AS query_text,
               CAST(l_suppkey AS VARCHAR) AS hash, l_shipdate AS start_time,
               CAST(round(l_extendedprice) AS BIGINT) AS ms, 'ANALYTICS_' || (l_orderkey % 4) AS wh,
               CASE WHEN l_returnflag = 'R' THEN 'FAIL' ELSE 'SUCCESS' END AS status,
               CASE WHEN l_quantity <= 5 THEN 0 ELSE CAST(round(l_quantity) AS BIGINT) END AS bytes,
               CAST(0 AS BIGINT) AS wait_ms
        FROM lineitem""",
    "meters": """
        SELECT o_orderdate AS start_time, 'ANALYTICS_' || (o_orderkey % 4) AS wh,
               round(CAST(o_totalprice / 1000 AS DECIMAL(38,10)), 2) AS credits
        FROM orders""",
}


def period(b: dict) -> str:
    return f"CASE WHEN d >= DATE '{b['cutover']}' THEN 'GEN2' ELSE 'GEN1' END"


def window(b: dict) -> str:
    return f"d BETWEEN DATE '{b['first']}' AND DATE '{b['last']}' AND wh LIKE 'ANALYTICS_%'"


def two_sided(t: str, df: str, level: int) -> str:
    """Critical value by degrees of freedom."""
    steps = {
        90: [(7, 2.015), (11, 1.860), (16, 1.796), (21, 1.746), (31, 1.711), (61, 1.684)],
        95: [(7, 2.571), (11, 2.306), (16, 2.201), (21, 2.120), (31, 2.064), (61, 2.021)],
    }[level]
    last = {90: 1.645, 95: 1.960}[level]
    arms = " ".join(f"WHEN {df} < {limit} THEN {value}" for limit, value in steps)
    return f"CAST(CASE WHEN {df} < 5 THEN NULL {arms} ELSE {last} END AS DOUBLE)"


def label(t: str, df: str, lower_tail: bool = False) -> str:
    size = f"-({t})" if lower_tail else f"abs({t})"
    return f"""CASE WHEN {df} < 5 THEN 'INSUFFICIENT DF'
        WHEN {size} > {two_sided(t, df, 95)} THEN 'SIGNIFICANT (p<0.05)'
        WHEN {size} > {two_sided(t, df, 90)} THEN 'SIGNIFICANT (p<0.10)' ELSE 'NOT SIGNIFICANT' END"""


def facts(b: dict) -> dict[str, str]:
    return {
        "qh": f"""SELECT *, {period(b)} AS p FROM
            (SELECT *, CAST(start_time AS DATE) AS d FROM ({b['runs']})) WHERE {window(b)}""",
        "meter": f"""SELECT *, {period(b)} AS p FROM
            (SELECT *, CAST(start_time AS DATE) AS d FROM ({b['meters']})) WHERE {window(b)}""",
        "matched": """SELECT hash FROM qh WHERE p = 'GEN1' AND hash IS NOT NULL
            INTERSECT SELECT hash FROM qh WHERE p = 'GEN2' AND hash IS NOT NULL""",
        "ok": """SELECT * FROM qh
            WHERE bytes > 0 AND status = 'SUCCESS' AND hash IN (SELECT hash FROM matched)""",
        "edge": "SELECT d, quantile_cont(ms / 1000.0, 0.95) AS x95 FROM ok GROUP BY d",
        "rate": f"""SELECT d, {r("100.0 * count(*) FILTER (status = 'SUCCESS') / count(*)", 2)} AS rate
            FROM qh WHERE bytes > 0 AND hash IN (SELECT hash FROM matched) GROUP BY d""",
        "perf": f"""SELECT d, p, count(*) AS n,
                {r("median(ms / 1000.0)", 4)} AS med,
                {r("quantile_cont(ms / 1000.0, 0.95)", 4)} AS p95,
                {r("quantile_cont(ms / 1000.0, 0.99)", 4)} AS p99,
                count(*) FILTER (ms / 1000.0 >= x95) AS tail_n,
                {r("100.0 * sum(CASE WHEN ms / 1000.0 >= x95 THEN ms ELSE 0 END) / nullif(sum(ms), 0)", 1)}
                    AS tail_w,
                any_value(rate) AS rate
            FROM ok JOIN edge USING (d) JOIN rate USING (d) GROUP BY d, p""",
        "waits": f"""SELECT d, p, {r("median(wait_ms / 1000.0)", 4)} AS med,
                {r("quantile_cont(wait_ms / 1000.0, 0.95)", 4)} AS p95
            FROM qh GROUP BY d, p""",
        "cost": f"""SELECT d, p, credits, coalesce(a.n, 0) AS all_n, coalesce(m.n, 0) AS pat_n,
                {r("credits / nullif(a.n, 0)", 6)} AS all_cpq, {r("credits / nullif(m.n, 0)", 6)} AS pat_cpq
            FROM (SELECT d, p, CAST(round(sum(credits), 4) AS DOUBLE) AS credits FROM meter GROUP BY d, p)
            LEFT JOIN (SELECT d, count(*) AS n FROM qh WHERE bytes > 0 GROUP BY d) a USING (d)
            LEFT JOIN (SELECT d, n FROM perf) m USING (d)""",
        "okrate": f"""SELECT d, p, count(*) AS n, count(*) FILTER (status = 'SUCCESS') AS s,
                {r("100.0 * count(*) FILTER (status = 'SUCCESS') / count(*)", 4)} AS rate
            FROM qh GROUP BY d, p""",
    }


def welch(source: str, value: str, by: str = "") -> str:
    """Two-sample test of ``value`` of a daily table; NULL values are left out, by optional columns."""
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""SELECT *, (mg - mb) / nullif(se, 0) AS t,
            power(vb / nb + vg / ng, 2)
              / nullif(power(vb / nb, 2) / nullif(nb - 1, 0) + power(vg / ng, 2) / nullif(ng - 1, 0), 0) AS df
        FROM (SELECT *, sqrt(vb / nb + vg / ng) AS se FROM
          (SELECT {lead}count({value}) FILTER (p = 'GEN1') AS nb, count({value}) FILTER (p = 'GEN2') AS ng,
              avg({value}) FILTER (p = 'GEN1') AS mb, avg({value}) FILTER (p = 'GEN2') AS mg,
              var_samp({value}) FILTER (p = 'GEN1') AS vb, var_samp({value}) FILTER (p = 'GEN2') AS vg
           FROM {source} {group}) WHERE nb > 0 AND ng > 0)"""


def statement(b: dict, final: str, **extra: str) -> str:
    steps = facts(b) | extra
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in steps.items()) + "\n" + final


T = two_sided("", "df", 90)
SHIFT = "(mg - mb) * 100.0 / nullif(mb, 0)"


def half(effect_base: str = "mb") -> str:
    return f"{T} * se / nullif({effect_base}, 0) * 100"


# ---- one test per summary, as steps -------------------------------------------------------------

# Bounds, labels and their order are fixed values: they define the result.
PERF_STEPS = {
    "pw": welch("perf", "med"),
    "px": f"""SELECT *, (1 - mg / nullif(mb, 0)) * 100 AS speedup,
            power(mb, 2) - power({T}, 2) * vb / nb AS fa, -2 * mb * mg AS fb,
            power(mg, 2) - power({T}, 2) * vg / ng AS fc FROM pw""",
    "pavg": """SELECT avg(p95) FILTER (p = 'GEN1') AS b95, avg(p95) FILTER (p = 'GEN2') AS g95,
            avg(p99) FILTER (p = 'GEN1') AS b99, avg(p99) FILTER (p = 'GEN2') AS g99 FROM perf""",
    "wavg": """SELECT avg(med) FILTER (p = 'GEN1') AS wb50, avg(med) FILTER (p = 'GEN2') AS wg50,
            avg(p95) FILTER (p = 'GEN1') AS wb95, avg(p95) FILTER (p = 'GEN2') AS wg95 FROM waits""",
    "ps": f"""SELECT 'PERFORMANCE' AS metric_category, nb AS gen1_days, ng AS gen2_days,
            {r("mb", 4)} AS gen1_daily_median_sec, {r("mg", 4)} AS gen2_daily_median_sec,
            {r("speedup", 2)} AS speedup_pct,
            CASE WHEN fa > 0 AND fb * fb - 4 * fa * fc >= 0
              THEN {r("(1 - (-fb + sqrt(greatest(fb * fb - 4 * fa * fc, 0))) / (2 * fa)) * 100", 2)} END
              AS speedup_ci_lower_90,
            CASE WHEN fa > 0 AND fb * fb - 4 * fa * fc >= 0
              THEN {r("(1 - (-fb - sqrt(greatest(fb * fb - 4 * fa * fc, 0))) / (2 * fa)) * 100", 2)} END
              AS speedup_ci_upper_90,
            {r("t", 3)} AS t_statistic, {r("df", 1)} AS degrees_of_freedom, {label("t", "df")} AS significance,
            {r("b95", 4)} AS gen1_mean_p95, {r("g95", 4)} AS gen2_mean_p95,
            {r("b99", 4)} AS gen1_mean_p99, {r("g99", 4)} AS gen2_mean_p99,
            CASE WHEN g99 > b99 * 2 THEN 'WARNING: P99 doubled'
                 WHEN g99 > b99 * 1.5 THEN 'CAUTION: P99 increased 50%+'
                 WHEN g99 <= b99 * 0.8 THEN 'IMPROVED: P99 reduced 20%+' ELSE 'OK' END AS tail_latency_check,
            {r("wb50", 4)} AS gen1_mean_median_queue_sec, {r("wg50", 4)} AS gen2_mean_median_queue_sec,
            {r("wb95", 4)} AS gen1_mean_p95_queue_sec, {r("wg95", 4)} AS gen2_mean_p95_queue_sec,
            CASE WHEN wb95 < 0.1 AND wg95 < 0.1 THEN 'OK: Negligible queuing in both periods'
                 WHEN wg95 > greatest(wb95, 1) * 2 THEN 'WARNING: P95 queue time doubled'
                 WHEN wg95 > greatest(wb95, 1) * 1.5 THEN 'CAUTION: P95 queue time +50%'
                 WHEN wb95 > 1 AND wg95 <= wb95 * 0.8 THEN 'IMPROVED: Queue time reduced 20%+'
                 ELSE 'OK' END AS queue_saturation_check
        FROM px, pavg, wavg""",
}


def cost_scope(step: str, prefix: str) -> str:
    return f"""SELECT nb AS {prefix}nb, ng AS {prefix}ng, {r("mb", 6)} AS {prefix}mb, {r("mg", 6)} AS {prefix}mg,
        {SHIFT} AS {prefix}chg, {r(SHIFT, 2)} AS {prefix}pct,
        {r(f"{SHIFT} - {half()}", 2)} AS {prefix}lo, {r(f"{SHIFT} + {half()}", 2)} AS {prefix}hi,
        {r("t", 3)} AS {prefix}t, {r("df", 1)} AS {prefix}df, {label("t", "df")} AS {prefix}sig FROM {step}"""


def wide(alias: str, expression: str, source: str) -> str:
    return ", ".join(
        f"{expression} FILTER (p = '{p}') AS {s}_{alias}" for s, p in (("b", "GEN1"), ("g", "GEN2"))
    )


# Bounds, labels and their order are fixed values: they define the result.
COST_STEPS = {
    "aw": welch("cost", "all_cpq"),
    "mw": welch("cost", "pat_cpq"),
    "ax": cost_scope("aw", "a_"),
    "mx": cost_scope("mw", "m_"),
    "sums": """SELECT p, CAST(sum(CAST(credits AS DECIMAL(28,4))) AS DOUBLE) AS c, sum(all_n) AS a, sum(pat_n) AS m
        FROM cost GROUP BY p""",
    "ratios": f"""SELECT max(CASE WHEN p = 'GEN1' THEN {r("c / nullif(a, 0)", 6)} END) AS ba,
            max(CASE WHEN p = 'GEN2' THEN {r("c / nullif(a, 0)", 6)} END) AS ga,
            max(CASE WHEN p = 'GEN1' THEN {r("c / nullif(m, 0)", 6)} END) AS bm,
            max(CASE WHEN p = 'GEN2' THEN {r("c / nullif(m, 0)", 6)} END) AS gm FROM sums""",
    "raws": f"""SELECT {wide("c", "avg(credits)", "cost")}, {wide("a", "avg(all_n)", "cost")},
            {wide("m", "avg(pat_n)", "cost")} FROM cost""",
    "cx": f"""SELECT *, (ga - ba) * 100.0 / nullif(ba, 0) AS wa, (gm - bm) * 100.0 / nullif(bm, 0) AS wm,
            {r("b_c", 4)} AS c1, {r("g_c", 4)} AS c2 FROM ax, mx, ratios, raws""",
    "cw": f"""SELECT 'COST' AS metric_category, a_nb AS gen1_days, a_ng AS gen2_days,
            a_mb AS gen1_all_avg_credits_per_query, a_mg AS gen2_all_avg_credits_per_query,
            a_pct AS all_avg_cpq_change_pct, a_lo AS all_avg_cpq_ci_lower_90, a_hi AS all_avg_cpq_ci_upper_90,
            a_t AS t_statistic, a_df AS degrees_of_freedom, a_sig AS significance,
            ba AS gen1_all_weighted_credits_per_query, ga AS gen2_all_weighted_credits_per_query,
            {r("wa", 2)} AS all_weighted_cpq_change_pct,
            m_mb AS gen1_avg_cost_per_pattern_query, m_mg AS gen2_avg_cost_per_pattern_query,
            m_pct AS avg_cost_per_pattern_query_change_pct, m_lo AS avg_cost_per_pattern_query_ci_lower_90,
            m_hi AS avg_cost_per_pattern_query_ci_upper_90, m_t AS pattern_cost_t_statistic,
            m_df AS pattern_cost_degrees_of_freedom, m_sig AS pattern_cost_significance,
            bm AS gen1_weighted_cost_per_pattern_query, gm AS gen2_weighted_cost_per_pattern_query,
            {r("wm", 2)} AS weighted_cost_per_pattern_query_change_pct,
            c1 AS gen1_daily_credits, c2 AS gen2_daily_credits,
            {r("(g_c - b_c) * 100.0 / nullif(b_c, 0)", 2)} AS total_credit_change_pct,
            {r("b_a", 0)} AS gen1_daily_all_queries, {r("g_a", 0)} AS gen2_daily_all_queries,
            {r("(g_a - b_a) * 100.0 / nullif(b_a, 0)", 2)} AS all_query_volume_change_pct,
            {r("b_m", 0)} AS gen1_daily_pattern_queries, {r("g_m", 0)} AS gen2_daily_pattern_queries,
            {r("(g_m - b_m) * 100.0 / nullif(b_m, 0)", 2)} AS pattern_query_volume_change_pct,
            CASE WHEN a_chg <= 0 THEN 'COST LOWER (Gen2 cheaper per query)'
                 WHEN a_chg <= 5 THEN 'COST NEUTRAL (per-query cost within 5%)'
                 WHEN a_chg <= 15 THEN 'COST HIGHER (per-query cost 5-15% above Gen1)'
                 ELSE 'COST SIGNIFICANTLY HIGHER (per-query cost >15% above Gen1)' END AS breakeven_status,
            {r("abs(a_chg - wa)", 1)} AS all_cpq_avg_vs_weighted_divergence_pp,
            {r("abs(m_chg - wm)", 1)} AS pattern_cpq_avg_vs_weighted_divergence_pp,
            CASE WHEN abs(a_chg - wa) > 10 OR abs(m_chg - wm) > 10 THEN 'WARNING: >10pp divergence'
                 WHEN abs(a_chg - wa) > 5 OR abs(m_chg - wm) > 5 THEN 'NOTICE: 5-10pp divergence'
                 ELSE 'OK: avg and weighted metrics agree (<5pp)' END AS cost_metric_consistency
        FROM cx""",
}

# Bounds, labels and their order are fixed values: they define the result.
RATE_STEPS = {
    "rw": welch("okrate", "rate"),
    "rt": """SELECT CAST(sum(n) FILTER (p = 'GEN1') AS BIGINT) AS n1, CAST(sum(n) FILTER (p = 'GEN2') AS BIGINT) AS n2,
            100.0 * sum(s) FILTER (p = 'GEN1') / sum(n) FILTER (p = 'GEN1') AS s1,
            100.0 * sum(s) FILTER (p = 'GEN2') / sum(n) FILTER (p = 'GEN2') AS s2 FROM okrate""",
    "rel": f"""SELECT 'RELIABILITY' AS metric_category, n1 AS n_gen1, n2 AS n_gen2,
            {r("s1", 4)} AS gen1_success_rate, {r("s2", 4)} AS gen2_success_rate,
            {r("s2 - s1", 4)} AS success_rate_diff_pp, {r("100 - s1", 4)} AS gen1_failure_rate_pct,
            {r("100 - s2", 4)} AS gen2_failure_rate_pct, {r("s1 - s2", 4)} AS failure_rate_diff_pp,
            {r("(s1 - s2) / nullif(100 - s1, 0) * 100", 1)} AS failure_rate_change_pct,
            nb AS gen1_days, ng AS gen2_days, {r("t", 3)} AS t_statistic, {r("df", 1)} AS degrees_of_freedom,
            {label("t", "df", lower_tail=True)} AS significance,
            CASE WHEN df < 5 THEN 'INSUFFICIENT DF'
                 WHEN -t > {two_sided("t", "df", 95)} AND (abs(s2 - s1) >= 0.5
                      OR abs((s1 - s2) / nullif(100 - s1, 0)) * 100 > 25) THEN 'DEGRADED (p<0.05, large effect)'
                 WHEN -t > {two_sided("t", "df", 95)} THEN 'MINOR DEGRADATION (p<0.05, small effect)'
                 WHEN -t > {two_sided("t", "df", 90)} THEN 'MINOR DEGRADATION (p<0.10)'
                 ELSE 'NO DEGRADATION' END AS reliability_status
        FROM rw, rt""",
}


def volume_steps() -> dict[str, str]:
    return {
        "vol": f"""SELECT p, count(DISTINCT d) AS days, count(DISTINCT wh) AS whs, count(*) AS n,
                count(*) FILTER (status = 'SUCCESS') AS s, min(d) AS d1, max(d) AS d2,
                count(*) FILTER (bytes = 0) AS cached,
                {r("100.0 * count(*) FILTER (hash IN (SELECT hash FROM matched)) / count(*)", 1)} AS cover
            FROM qh GROUP BY p""",
    }


def data_validation(b: dict) -> str:
    return statement(
        b,
        f"""SELECT p AS period_type, days AS query_days, whs AS warehouse_count, n AS total_queries,
            s AS successful_queries, {r("100.0 * s / n", 2)} AS success_rate_pct, d1 AS first_date, d2 AS last_date,
            credits AS total_credits, (SELECT count(*) FROM matched) AS common_patterns,
            cover AS pattern_coverage_pct, cached AS cached_queries, {r("100.0 * cached / n", 1)} AS cache_hit_rate_pct,
            CASE WHEN p = 'GEN2' AND days < 7 THEN 'CRITICAL: < 7 days Gen2 data'
                 WHEN p = 'GEN2' AND days < 14 THEN 'WARNING: < 14 days Gen2 - preliminary only'
                 WHEN p = 'GEN2' THEN 'OK: Sufficient for decision'
                 WHEN days < 14 THEN 'CRITICAL: < 14 days GEN1 - unreliable variance, cannot detect < 40% effects'
                 WHEN days < 30 THEN
                   'WARNING: < 30 days GEN1 - reduced power, only ~4 samples per DOW. Increase LOOKBACK_DAYS to 30+'
                 ELSE 'OK: Sufficient GEN1' END AS data_sufficiency
        FROM vol LEFT JOIN (SELECT p, CAST(round(sum(credits), 2) AS DOUBLE) AS credits FROM meter GROUP BY p)
        USING (p)""",
        **volume_steps(),
    )


DOW = "CAST(isodow(d) AS INTEGER) AS day_of_week_num, strftime(d, '%a') AS day_of_week"


def perf_daily(b: dict) -> str:
    return statement(
        b,
        f"""SELECT d AS activity_date, p AS period_type, {DOW}, n AS query_count, med AS median_exec_sec,
            p95 AS p95_exec_sec, p99 AS p99_exec_sec, tail_n AS p95_tail_count, tail_w AS p95_tail_weight_pct,
            n AS successful_queries, rate AS success_rate_pct FROM perf""",
    )


def perf_tail(b: dict) -> str:
    return statement(
        b, "SELECT d AS activity_date, tail_n AS p95_tail_count, tail_w AS p95_tail_weight_pct FROM perf"
    )


def perf_welch_test(b: dict, least: int = 4) -> str:
    speed = r("(1 - mg / nullif(mb, 0)) * 100", 2)
    return statement(
        b,
        f"""SELECT 'EXPLORATORY — low power, not used for assessment' AS test_scope, day_of_week_num, day_of_week,
            nb AS n_gen1, ng AS n_gen2, {r("mb", 4)} AS gen1_median_exec_sec, {r("mg", 4)} AS gen2_median_exec_sec,
            {speed} AS speedup_pct, {r("t", 3)} AS t_statistic, {r("df", 1)} AS degrees_of_freedom,
            {T} AS t_critical_90, {r(f"{speed} - {half()}", 2)} AS speedup_ci_lower_90,
            {r(f"{speed} + {half()}", 2)} AS speedup_ci_upper_90, {label("t", "df")} AS significance
        FROM dw WHERE nb >= {least} AND ng >= {least}""",
        pd=f"SELECT *, {DOW} FROM perf",
        dw=welch("pd", "med", "day_of_week_num, day_of_week"),
    )


def perf_by_dow(b: dict) -> str:
    def stats(source: str, where: str) -> str:
        return f"""SELECT {DOW}, p, count(*) AS n, count(DISTINCT d) AS days,
            {r("count(*) * 1.0 / count(DISTINCT d)", 0)} AS daily, {r("median(ms / 1000.0)", 4)} AS x50,
            {r("quantile_cont(ms / 1000.0, 0.95)", 4)} AS x95, {r("quantile_cont(ms / 1000.0, 0.99)", 4)} AS x99,
            {r("100.0 * count(*) FILTER (status = 'SUCCESS') / count(*)", 2)} AS rate
            FROM {source} WHERE {where} GROUP BY 1, 2, 3"""

    def triple(scope: str, x: str, name: str, lo: str, hi: str) -> str:
        return (
            f"{lo}.{x} AS {scope}_gen1_{name}_exec_sec, {hi}.{x} AS {scope}_gen2_{name}_exec_sec, "
            + r(f"(1 - {hi}.{x} / nullif({lo}.{x}, 0)) * 100", 2)
            + f" AS {scope}_{name}_exec_speedup_pct"
        )

    triples = ", ".join(
        triple(scope, x, name, lo, hi)
        for x, name in (("x50", "median"), ("x95", "p95"), ("x99", "p99"))
        for scope, lo, hi in (("all", "ab", "ag"), ("pattern", "pb", "pg"))
    )
    on = "day_of_week_num"
    return statement(
        b,
        f"""SELECT pb.day_of_week_num, pb.day_of_week, pb.days AS gen1_days, pg.days AS gen2_days,
            pb.daily AS gen1_avg_daily_queries, pg.daily AS gen2_avg_daily_queries,
            {r("(pg.daily - pb.daily) * 100.0 / nullif(pb.daily, 0)", 2)} AS avg_daily_queries_change_pct, {triples},
            pb.rate AS gen1_success_rate_pct, pg.rate AS gen2_success_rate_pct,
            {r("pg.rate - pb.rate", 2)} AS success_rate_diff_pp
        FROM (SELECT * FROM dp WHERE p = 'GEN1') pb JOIN (SELECT * FROM dp WHERE p = 'GEN2') pg USING ({on})
        JOIN (SELECT * FROM da WHERE p = 'GEN1') ab USING ({on})
        JOIN (SELECT * FROM da WHERE p = 'GEN2') ag USING ({on})""",
        dp=stats("ok", "true"),
        da=stats("qh", "bytes > 0"),
    )


def cost_daily(b: dict) -> str:
    return statement(
        b,
        f"""SELECT d AS activity_date, p AS period_type, {DOW}, credits AS daily_credits, all_n AS all_query_count,
            all_cpq AS all_credits_per_query, pat_n AS pattern_query_count,
            pat_cpq AS wh_credits_per_pattern_query FROM cost""",
    )


def cost_by_dow(b: dict) -> str:
    columns = [
        ("credits", 4, "avg_daily_credits", "credit_change_pct"),
        ("all_n", 0, "all_queries", "all_query_volume_change_pct"),
        ("all_cpq", 6, "all_credits_per_query", "all_cpq_change_pct"),
        ("pat_n", 0, "pattern_queries", "pattern_query_volume_change_pct"),
        ("pat_cpq", 6, "wh_credits_per_pattern_query", "pattern_cpq_change_pct"),
    ]
    averages = ", ".join(f"{r(f'avg({c})', places)} AS {c}" for c, places, *_ in columns)
    shown = ", ".join(
        f"b.{c} AS gen1_{name}, g.{c} AS gen2_{name}, "
        f"{r(f'(g.{c} - b.{c}) * 100.0 / nullif(b.{c}, 0)', 2)} AS {change}"
        for c, _, name, change in columns
    )
    return statement(
        b,
        f"""SELECT b.day_of_week_num, b.day_of_week, b.n AS gen1_samples, g.n AS gen2_samples, {shown}
        FROM (SELECT * FROM cd WHERE p = 'GEN1') b JOIN (SELECT * FROM cd WHERE p = 'GEN2') g
        USING (day_of_week_num)""",
        cd=f"SELECT {DOW}, p, count(*) AS n, {averages} FROM cost GROUP BY 1, 2, 3",
    )


def cost_weighted(b: dict) -> str:
    return statement(
        b,
        f"""SELECT p AS period_type, c AS total_credits, CAST(a AS BIGINT) AS all_queries,
            CAST(m AS BIGINT) AS pattern_queries, {r("c / nullif(a, 0)", 6)} AS weighted_all_credits_per_query,
            {r("c / nullif(m, 0)", 6)} AS weighted_wh_credits_per_pattern_query FROM sums""",
        sums=COST_STEPS["sums"],
    )


def error_analysis(b: dict, sample: str = "min(left(query_text, 200))") -> str:
    return statement(
        b,
        f"""SELECT status AS execution_status, b AS gen1_error_count, g AS gen2_error_count,
            {r("b * 1000.0 / nullif(n1, 0)", 4)} AS gen1_errors_per_1000_queries,
            {r("g * 1000.0 / n2", 4)} AS gen2_errors_per_1000_queries,
            {r("(rg - rb) / nullif(rb, 0) * 100", 1)} AS per_query_rate_change_pct,
            {r("b * 1.0 / nullif(d1, 0)", 2)} AS gen1_errors_per_day, {r("g * 1.0 / d2", 2)} AS gen2_errors_per_day,
            n1 AS gen1_total_queries, n2 AS gen2_total_queries,
            {r("n2 * 1.0 / d2", 1)} AS gen2_queries_per_day, {r("n1 * 1.0 / nullif(d1, 0)", 1)} AS gen1_queries_per_day,
            first_seen, last_seen,
            (SELECT {sample} FROM qh WHERE qh.status = e.status AND qh.d = e.first_seen)
              AS sample_query,
            CASE WHEN b = 0 THEN 'NEW IN GEN2'
                 WHEN rg > rb * 2.0 THEN 'RATE DOUBLED (per query)'
                 WHEN rg > rb * 1.5 THEN 'RATE INCREASED 50%+ (per query)'
                 WHEN rg > rb * 1.2 THEN 'RATE INCREASED 20%+ (per query)'
                 WHEN rg > rb * 1.15 THEN 'RATE INCREASED 15%+ (per query)'
                 WHEN rg > rb * 1.10 THEN 'RATE INCREASED 10%+ (per query)'
                 WHEN rg > rb * 1.05 THEN 'RATE INCREASED 5%+ (per query)'
                 WHEN rg < rb * 0.95 THEN 'RATE DECREASED 5%+ (per query)'
                 ELSE 'STABLE (per query)' END AS error_trend
        FROM (SELECT *, b / nullif(n1, 0)::DOUBLE AS rb, g / n2::DOUBLE AS rg FROM errs, tot WHERE g > 0) e""",
        tot="""SELECT count(*) FILTER (p = 'GEN1') AS n1, count(*) FILTER (p = 'GEN2') AS n2,
            count(DISTINCT d) FILTER (p = 'GEN1') AS d1, count(DISTINCT d) FILTER (p = 'GEN2') AS d2 FROM qh""",
        errs="""SELECT status, count(*) FILTER (p = 'GEN1') AS b, count(*) FILTER (p = 'GEN2') AS g,
            min(d) FILTER (p = 'GEN2') AS first_seen, max(d) FILTER (p = 'GEN2') AS last_seen
            FROM qh WHERE status <> 'SUCCESS' GROUP BY status""",
    )


#: Values of the first run of a group instead of the smallest ones.
FIRST_TEXT = "first(left(query_text, 200) ORDER BY start_time, query_id)"
FIRST_WAREHOUSE = "first(wh ORDER BY start_time, query_id)"


def pattern_regressions(
    b: dict, where: str = "true", tail: str = "", samples: tuple[str, str] = ("min(left(query_text, 200))", "min(wh)")
) -> str:
    def side(p: str) -> str:
        return f"""SELECT hash, count(*) AS n, {r("median(ms / 1000.0)", 4)} AS x50,
            {r("quantile_cont(ms / 1000.0, 0.05)", 4)} AS x05, {r("quantile_cont(ms / 1000.0, 0.95)", 4)} AS x95,
            min(d) AS d1 FROM good WHERE p = '{p}' GROUP BY hash"""

    return statement(
        b,
        f"""SELECT * FROM (SELECT hash AS pattern_hash, sample_query, sample_warehouse,
            o.n AS gen1_count, k.n AS gen2_count, o.x50 AS gen1_median_sec, k.x50 AS gen2_median_sec,
            {r("(1 - k.x50 / nullif(o.x50, 0)) * 100", 1)} AS speedup_pct,
            o.x95 AS gen1_p95_sec, k.x95 AS gen2_p95_sec, o.x05 AS gen1_05_sec, k.x05 AS gen2_05_sec,
            {r("(1 - k.x95 / nullif(o.x95, 0)) * 100", 1)} AS p95_speedup_pct,
            {r("k.n * abs(k.x50 - o.x50)", 2)} AS impact_score,
            CASE WHEN k.x50 > o.x50 * 1.20 THEN 'REGRESSION' WHEN k.x50 < o.x50 * 0.80 THEN 'IMPROVEMENT'
                 ELSE 'STABLE' END AS status
        FROM old o JOIN new k USING (hash) JOIN sample USING (hash)
        WHERE o.n >= 10 AND k.n >= 10) WHERE {where} {tail}""",
        good="SELECT * FROM qh WHERE bytes > 0 AND status = 'SUCCESS' AND hash IS NOT NULL",
        old=side("GEN1"),
        new=side("GEN2"),
        sample=f"""SELECT hash, {samples[0]} AS sample_query, {samples[1]} AS sample_warehouse
            FROM good JOIN old USING (hash) WHERE d = d1 GROUP BY hash""",
    )


def top(b: dict, status: str, **samples) -> str:
    return pattern_regressions(
        b, f"status = '{status}'", "ORDER BY impact_score DESC, pattern_hash LIMIT 20", **samples
    )


def daily_trend(b: dict) -> str:
    return statement(
        b,
        """SELECT cost.d AS activity_date, cost.p AS period_type,
            CASE WHEN perf.d IS NOT NULL THEN strftime(cost.d, '%a') END AS day_of_week,
            perf.n AS perf_pattern_query_count, perf.med AS pattern_median_exec_sec,
            perf.p95 AS pattern_p95_exec_sec, perf.rate AS pattern_success_rate_pct, all_n AS all_query_count,
            credits AS all_warehouse_daily_credits, all_cpq AS all_warehouse_credits_per_query,
            pat_n AS cost_pattern_query_count, pat_cpq AS wh_credits_per_pattern_query
        FROM cost LEFT JOIN perf USING (d)""",
    )


def decision(b: dict) -> str:
    per_day = "CAST(n2 AS DOUBLE) / nullif(days2, 0)"
    cascade = f"""CASE WHEN days2 < 7 THEN 'INSUFFICIENT DATA'
        WHEN reliability_status LIKE 'DEGRADED%' THEN 'UNFAVORABLE - Reliability degraded'
        WHEN reliability_status LIKE 'MINOR DEGRADATION%' THEN 'MIXED - Minor reliability concern'
        WHEN tail_latency_check LIKE 'WARNING%' THEN 'MIXED - Tail latency degraded'
        WHEN queue_saturation_check LIKE 'WARNING%' THEN 'MIXED - Queue saturation detected'
        WHEN days2 < 14 AND a_pct < -10 AND speedup_pct > 0 THEN 'EARLY POSITIVE - Collect more data to confirm'
        WHEN days2 < 14 AND a_pct > 20 THEN 'EARLY NEGATIVE - Cost spike detected'
        WHEN days2 < 14 THEN 'INSUFFICIENT DATA - Need 14+ days for reliable assessment'
        WHEN least(gen1_daily_median_sec, gen2_daily_median_sec) < 1 AND coalesce({per_day}, 0) < 1000
          THEN 'INCONCLUSIVE - Sub-second workload'
        WHEN a_hi <= 0 AND speedup_ci_lower_90 >= 35 THEN 'STRONGLY FAVORABLE'
        WHEN a_hi <= 0 AND speedup_pct >= -20 THEN 'FAVORABLE - Cost neutral'
        WHEN a_hi <= 0 THEN 'MIXED - Cost neutral but significantly slower'
        WHEN a_hi <= 5 AND speedup_ci_lower_90 >= 26 THEN 'FAVORABLE - Near break-even with strong speedup'
        WHEN a_hi <= 15 AND speedup_ci_lower_90 >= 35 THEN 'FAVORABLE - Strong speedup offsets cost premium'
        WHEN c2 > 50 AND a_lo > 5 THEN 'MIXED - High absolute cost impact'
        WHEN tail_latency_check LIKE 'IMPROVED%' AND a_hi <= 10 AND speedup_pct >= 0
          THEN 'FAVORABLE - Tail latency improved'
        WHEN a_lo > 15 AND speedup_pct < 20 THEN 'UNFAVORABLE - Cost increase without sufficient speedup'
        WHEN a_lo > 10 AND a_sig LIKE 'SIGNIFICANT%' AND speedup_pct < 20
          THEN 'UNFAVORABLE - Statistically confirmed cost increase'
        WHEN speedup_ci_upper_90 < 20 AND a_lo > 5
          THEN 'UNFAVORABLE - Neither speedup nor cost justify migration'
        ELSE 'MIXED - Review detailed metrics' END"""
    return statement(
        b,
        f"""SELECT 'ANALYTICS_%' AS domain_pattern, DATE '{b['cutover']}' AS cutover_date,
            days1 AS gen1_days, days2 AS gen2_days,
            CASE WHEN days2 < 7 THEN 'CRITICAL: < 7 days' WHEN days2 < 14 THEN 'PRELIMINARY: < 14 days'
                 WHEN days2 < 21 THEN 'ADEQUATE: 14-20 days' ELSE 'STRONG: 21+ days' END AS data_quality,
            CASE WHEN least(coalesce(cover1, 0), coalesce(cover2, 0)) >= 90 THEN 'HIGH (>90%)'
                 WHEN least(coalesce(cover1, 0), coalesce(cover2, 0)) >= 70 THEN 'MODERATE (70-90%)'
                 ELSE 'LOW (<70%)' END AS pattern_coverage_assessment,
            cover1 AS gen1_pattern_coverage_pct, cover2 AS gen2_pattern_coverage_pct,
            ps.speedup_pct, speedup_ci_lower_90 AS speedup_lower_bound, speedup_ci_upper_90 AS speedup_upper_bound,
            ps.significance AS perf_significance, tail_latency_check, queue_saturation_check,
            gen1_daily_median_sec, gen2_daily_median_sec,
            {r("gen1_daily_median_sec - gen2_daily_median_sec", 4)} AS median_diff_sec,
            {r(per_day, 0)} AS gen2_avg_daily_queries,
            a_pct AS cost_change_pct, a_lo AS cost_change_lower_bound, a_hi AS cost_change_upper_bound,
            a_sig AS cost_significance, breakeven_status, m_pct AS pattern_cost_change_pct,
            m_lo AS pattern_cost_change_lower_bound, m_hi AS pattern_cost_change_upper_bound,
            m_sig AS pattern_cost_significance, gen1_success_rate, gen2_success_rate, success_rate_diff_pp,
            reliability_status, {cascade} AS assessment
        FROM ps, cx, (SELECT breakeven_status FROM cw), rel, totals""",
        **PERF_STEPS,
        **COST_STEPS,
        **RATE_STEPS,
        **volume_steps(),
        totals="""SELECT max(days) FILTER (p = 'GEN1') AS days1, max(days) FILTER (p = 'GEN2') AS days2,
            max(n) FILTER (p = 'GEN2') AS n2, max(cover) FILTER (p = 'GEN1') AS cover1,
            max(cover) FILTER (p = 'GEN2') AS cover2 FROM vol""",
    )


def under(b: dict, e: Effect) -> dict:
    """The binding as an effect changes it from the cutover on."""
    later = f"start_time >= TIMESTAMP '{b['cutover']} 00:00:00'"
    there = f"start_time < TIMESTAMP '{b['cutover']} 00:00:00' + INTERVAL ({e.days}) DAY"
    drawn = "CAST('0x' || substr(md5(query_id), 1, 6) AS INTEGER) % 100"
    return b | {
        "runs": f"""SELECT * REPLACE (
                CASE WHEN {later} AND {drawn} < {e.slow} THEN ms * {e.slow_times} // 100
                     WHEN {later} THEN ms * {e.times} // 100 ELSE ms END AS ms,
                CASE WHEN {later} AND status = 'SUCCESS' AND {drawn} >= {100 - e.failing} THEN 'FAIL' ELSE status END AS status,
                CASE WHEN {later} AND {drawn} < {e.waiting} THEN wait_ms + {e.wait_ms} ELSE wait_ms END AS wait_ms)
            FROM ({b['runs']}) WHERE {there}""",
        "meters": f"""SELECT * REPLACE (CAST(credits AS DECIMAL(24,9))
                * CAST(CASE WHEN {later} THEN {e.credits / 100} ELSE 1 END AS DECIMAL(6,2)) AS credits)
            FROM ({b['meters']}) WHERE {there}""",
    }


def outcomes(b: dict) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS scenario, * FROM ({decision(under(b, e))})" for name, e in SCENARIOS.items())


def staged(b: dict, as_of: str, what: str) -> str:
    """Rows of complete days from the start of the first week, with calendar columns."""
    source = b["runs"] if what == "runs" else b["meters"]
    own = (
        "query_id, hash AS query_parameterized_hash, ms AS execution_time, wh AS warehouse_name,"
        " status AS execution_status, CAST(bytes AS BIGINT) AS bytes_scanned"
        if what == "runs"
        else "wh AS warehouse_name, CAST(credits AS DOUBLE) AS credits_used"
    )
    return f"""SELECT {own}, start_time, CAST(start_time AS DATE) AS activity_date,
            CAST(isodow(start_time) AS INTEGER) AS day_num, strftime(start_time, '%a') AS day_of_week,
            CAST(isoyear(start_time) AS INTEGER) AS year_iso, CAST(weekofyear(start_time) AS INTEGER) AS week_iso,
            CAST(date_trunc('week', start_time) AS TIMESTAMP) AS week_start_date
        FROM ({source}) WHERE wh LIKE 'ANALYTICS_%' AND start_time >= TIMESTAMP '{b['week']} 00:00:00'
          AND start_time < TIMESTAMP '{as_of} 00:00:00'"""


def coverage(b: dict, as_of: str) -> str:
    def of(source: str, name: str) -> str:
        return f"""SELECT '{name}' AS source, {period(b)} AS period_type, count(DISTINCT d) AS days_covered,
            max(d) AS last_date FROM (SELECT CAST(start_time AS DATE) AS d FROM ({source})
            WHERE start_time >= TIMESTAMP '{b['week']} 00:00:00' AND start_time < TIMESTAMP '{as_of} 00:00:00')
            GROUP BY 2"""

    return f"{of(b['runs'], 'qh')} UNION ALL {of(b['meters'], 'wh')}"


def keyed(b: dict, key: str, name: str, final: str) -> str:
    """Daily figures per ``key`` (SQL over the facts); a key of NULL is written as an empty text in between."""
    f = facts(b)
    per = f"coalesce({key}, '') AS k"
    both = "(k, hash) IN (SELECT (k, hash) FROM matched)"
    steps = {
        "qh": f"SELECT *, {per} FROM ({f['qh']})",
        "meter": f"SELECT *, {per} FROM ({f['meter']})",
        "matched": """SELECT k, hash FROM qh WHERE p = 'GEN1' AND hash IS NOT NULL
            INTERSECT SELECT k, hash FROM qh WHERE p = 'GEN2' AND hash IS NOT NULL""",
        "ok": f"SELECT * FROM qh WHERE bytes > 0 AND status = 'SUCCESS' AND {both}",
        "edge": "SELECT k, d, quantile_cont(ms / 1000.0, 0.95) AS x95 FROM ok GROUP BY k, d",
        "rate": f"""SELECT k, d, {r("100.0 * count(*) FILTER (status = 'SUCCESS') / count(*)", 2)} AS rate
            FROM qh WHERE bytes > 0 AND {both} GROUP BY k, d""",
        "perf": f"""SELECT k, d, p, count(*) AS n, {r("median(ms / 1000.0)", 4)} AS med,
                {r("quantile_cont(ms / 1000.0, 0.95)", 4)} AS p95, {r("quantile_cont(ms / 1000.0, 0.99)", 4)} AS p99,
                count(*) FILTER (ms / 1000.0 >= x95) AS tail_n,
                {r("100.0 * sum(CASE WHEN ms / 1000.0 >= x95 THEN ms ELSE 0 END) / nullif(sum(ms), 0)", 1)} AS tail_w,
                any_value(rate) AS rate
            FROM ok JOIN edge USING (k, d) JOIN rate USING (k, d) GROUP BY k, d, p""",
        "cost": f"""SELECT k, d, p, credits, coalesce(a.n, 0) AS all_n, coalesce(m.n, 0) AS pat_n,
                {r("credits / nullif(a.n, 0)", 6)} AS all_cpq, {r("credits / nullif(m.n, 0)", 6)} AS pat_cpq
            FROM (SELECT k, d, p, CAST(round(sum(credits), 4) AS DOUBLE) AS credits FROM meter GROUP BY k, d, p)
            LEFT JOIN (SELECT k, d, count(*) AS n FROM qh WHERE bytes > 0 GROUP BY k, d) a USING (k, d)
            LEFT JOIN (SELECT k, d, n FROM perf) m USING (k, d)""",
    }
    steps = ",\n".join(f"{n} AS ({sql})" for n, sql in steps.items())
    return f"WITH {steps}\nSELECT nullif(k, '') AS {name}, {final}"


PERF_COLUMNS = """d AS activity_date, p AS period_type, {dow}, n AS query_count, med AS median_exec_sec, p95 AS p95_exec_sec,
    p99 AS p99_exec_sec, tail_n AS p95_tail_count, tail_w AS p95_tail_weight_pct, n AS successful_queries,
    rate AS success_rate_pct FROM perf"""
COST_COLUMNS = """d AS activity_date, p AS period_type, {dow}, credits AS daily_credits, all_n AS all_query_count,
    all_cpq AS all_credits_per_query, pat_n AS pattern_query_count, pat_cpq AS wh_credits_per_pattern_query FROM cost"""


QUEUE_DAILY = "SELECT d AS activity_date, p AS period_type, med AS median_queue_sec, p95 AS p95_queue_sec FROM waits"


def all_statements() -> dict[str, str]:
    after = "2024-02-01"
    found = {
        "stage_query_history": staged(EVENTS, after, "runs"),
        "stage_metering": staged(EVENTS, after, "meters"),
        "incremental_append": staged(EVENTS, after, "runs"),
        "metering_reload": staged(EVENTS, after, "meters"),
        "metering_withdrawn": staged(EVENTS, after, "meters"),
        "metering_snapshot": staged(EVENTS, after, "meters"),
        "perf_daily_incremental": perf_daily(EVENTS),
        "queue_daily_incremental": statement(EVENTS, QUEUE_DAILY),
        "decision_incremental": decision(EVENTS),
        "staging_coverage": coverage(EVENTS, after),
        "staging_coverage_written": coverage(EVENTS, after),
        "high_water_mark": f"""SELECT coalesce(max(start_time), TIMESTAMP '1970-01-01 00:00:00') AS high_water_mark
            FROM ({EVENTS['runs']}) WHERE start_time < TIMESTAMP '2024-01-20 00:00:00'""",
    }
    firsts = (FIRST_TEXT, FIRST_WAREHOUSE)
    found["top_regressions_staged"] = top(ORDERS, "REGRESSION", samples=firsts)
    for suffix, b in (("", EVENTS), ("_orders", ORDERS)):
        found |= {
            f"perf_welch_test_two_days{suffix}": perf_welch_test(b, 2),
            f"error_analysis_first_runs{suffix}": error_analysis(b, FIRST_TEXT),
            f"pattern_regressions_first_runs{suffix}": pattern_regressions(b, samples=firsts),
            f"scope_rows{suffix}": statement(
                b,
                """SELECT d AS activity_date, p AS period_type, count(*) AS total_queries,
                count(*) FILTER (hash IN (SELECT hash FROM matched)) AS pattern_queries,
                count(*) FILTER (bytes = 0) AS cached_queries, count(*) FILTER (bytes > 0) AS live_queries
                FROM qh GROUP BY d, p""",
            ),
            f"matched_rows_by_shuffle{suffix}": statement(
                b,
                """SELECT d AS activity_date, count(*) AS runs,
                count(*) FILTER (hash IN (SELECT hash FROM matched)) AS pattern_runs FROM qh GROUP BY d""",
            ),
            f"perf_daily_per_user{suffix}": keyed(
                b, "nullif(wh, 'ANALYTICS_1')", "user_name", PERF_COLUMNS.format(dow=DOW)
            ),
            f"decision_outcomes{suffix}": outcomes(b),
            f"cost_daily_per_warehouse{suffix}": keyed(b, "wh", "warehouse_name", COST_COLUMNS.format(dow=DOW)),
            f"matched_patterns{suffix}": statement(b, "SELECT hash AS pattern_hash FROM matched"),
            f"data_validation{suffix}": data_validation(b),
            f"perf_daily{suffix}": perf_daily(b),
            f"perf_tail{suffix}": perf_tail(b),
            f"perf_welch_test{suffix}": perf_welch_test(b),
            f"perf_by_dow{suffix}": perf_by_dow(b),
            f"perf_summary{suffix}": statement(b, "SELECT * FROM ps", **PERF_STEPS),
            f"queue_daily{suffix}": statement(b, QUEUE_DAILY),
            f"cost_daily{suffix}": cost_daily(b),
            f"cost_welch_test{suffix}": statement(b, "SELECT * FROM cw", **COST_STEPS),
            f"cost_weighted{suffix}": cost_weighted(b),
            f"cost_by_dow{suffix}": cost_by_dow(b),
            f"success_daily{suffix}": statement(
                b,
                """SELECT d AS activity_date, p AS period_type, n AS total_queries, s AS success_count,
                rate AS daily_success_rate_pct FROM okrate""",
            ),
            f"reliability{suffix}": statement(b, "SELECT * FROM rel", **RATE_STEPS),
            f"error_analysis{suffix}": error_analysis(b),
            f"pattern_regressions{suffix}": pattern_regressions(b),
            f"top_regressions{suffix}": top(b, "REGRESSION"),
            f"top_improvements{suffix}": top(b, "IMPROVEMENT"),
            f"daily_trend{suffix}": daily_trend(b),
            f"migration_decision{suffix}": decision(b),
        }
    return found
