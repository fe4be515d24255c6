"""Quality rules: an ordered list of threshold rules, learnt from labelled texts by sequential covering.

Everything is DataFrame functions. Statistics of a text are worked out within its row. To learn, the
labelled statistics are binned once; each condition is then chosen from one histogram (statistic × bin ×
label), whose size does not depend on the data. A rule is grown on two thirds of the rows until it covers
nothing but rejects, pruned on the rest, and kept if it is precise there; the rows it covers are put aside
and the next rule is grown. The result is a Spark CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cutpoint.llm.texts import free_name, quoted, whole, without, words
from cutpoint.session import settle

SYMBOLS = "[#*$%&|<>]"

#: Statistics that the base rules and the contract name; the learnt rules use SHARES.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = {
    "words": "n_words",
    "word_length": "word_chars / n_words",
    "symbol_share": "n_symbols / word_chars",
    "dup_lines_per_line": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "distinct_share": "n_distinct_words / n_words",
    "capital_share": "n_capitals / word_chars",
    "mark_share": "n_marks / word_chars",
    "digit_share": "n_digits / word_chars",
}
EXTRA = ("n_lines", "n_distinct_words", "n_capitals", "n_marks", "n_digits")


def _held(text: str, chars: str) -> str:
    """SQL of the number of characters of a class; a pattern skips the others without copying each."""
    return f"CAST(length({text}) - length(regexp_replace({text}, '{chars}+', '')) AS BIGINT)"


def statistics(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add a struct column ``stats`` with COUNTS and EXTRA (all long); ``keep`` names the other columns.

    Null texts count as empty; an empty text has zeros throughout. A word in a repeated 3-word window is
    counted once, however many such windows hold it. Windows are compared by 64-bit hashes of their words.
    """
    kept = [quoted(c) for c in (df.columns if keep is None else keep) if c.lower() != "stats"]
    names = ("whole_text", "its_words", "word_hashes", "windows", "its_lines", "repeats")
    t, w, h, s, lines, starts = (free_name(df, n) for n in names)
    step = df.select(*kept, whole(quoted(text)).alias(t))
    step = step.select("*", words(F.col(t)).alias(w))
    step = step.select("*", F.expr(f"transform({w}, x -> xxhash64(x))").alias(h))
    # Hashes of 3-word windows, in order.
    step = step.select(
        "*",
        F.expr(
            f"CASE WHEN size({h}) < 4 THEN array() ELSE"
            f" transform(slice({h}, 1, size({h}) - 2), (x, i) -> xxhash64(x, {h}[i + 1], {h}[i + 2])) END"
        ).alias(s),
        F.expr(f"filter(split({t}, '\n', -1), x -> x RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')").alias(lines),
    )
    # Starts of windows met twice or more: sorted by hash, equal neighbours. Sorting keeps long texts n log n.
    ordered = f"array_sort(transform({s}, (x, i) -> struct(x AS k, i AS i)))"
    step = step.select(
        "*",
        F.expr(f"CASE WHEN size(array_distinct({s})) = size({s}) THEN NULL ELSE {ordered} END").alias(starts),
    )
    step = step.withColumn(
        starts,
        F.expr(
            f"array_sort(transform(filter({starts}, (x, i) -> x.k = get({starts}, i + 1).k"
            f" OR (i > 0 AND x.k = get({starts}, i - 1).k)), x -> x.i))"
        ),
    )
    covered = (
        f"coalesce(aggregate(transform({starts}, (x, i) -> least(3, coalesce(get({starts}, i + 1) - x, 3))),"
        " 0L, (a, x) -> a + x), 0L)"
    )
    values = {
        "n_words": f"CAST(size({w}) AS BIGINT)",
        "word_chars": f"CAST(length(array_join({w}, '')) AS BIGINT)",
        "n_symbols": _held(t, SYMBOLS),
        "n_dup_lines": f"CAST(size({lines}) - size(array_distinct({lines})) AS BIGINT)",
        "n_repeat_words": covered,
        "n_lines": f"CAST(size({lines}) AS BIGINT)",
        "n_distinct_words": f"CAST(size(array_distinct({h})) AS BIGINT)",
        "n_capitals": _held(t, r"\\p{Lu}"),
        "n_marks": _held(t, "[!?]"),
        "n_digits": _held(t, "[0-9]"),
    }
    # Generated rather than projected: a filter on the statistics would otherwise be pushed below every step
    # above, with all of their expressions copied into it.
    made = F.struct(*[F.expr(v).alias(n) for n, v in values.items()])
    return step.select(*kept, F.explode_outer(F.array(made)).alias("stats"))


def share(name: str, stats: str = "stats") -> str:
    """SQL of one of SHARES over a struct of statistics; 0 where its divisor is 0."""
    parts = SHARES[name].split(" / ")
    if len(parts) == 1:
        return f"CAST({stats}.{parts[0]} AS DOUBLE)"
    return f"CASE WHEN {stats}.{parts[1]} = 0 THEN 0D ELSE CAST({stats}.{parts[0]} AS DOUBLE) / {stats}.{parts[1]} END"


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def sql(self, stats: str = "stats") -> str:
        return f"({share(self.statistic, stats)}) {'>' if self.above else '<='} {self.threshold!r}D"

    def binned(self, cuts: dict[str, list[float]]) -> str:
        """The same over the binned sample: bin i holds values above cut i − 1, up to cut i."""
        at = cuts[self.statistic].index(self.threshold)
        return f"b_{self.statistic} {'>' if self.above else '<='} {at}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a text that none covers is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def verdict(self, stats: str = "stats") -> Column:
        """True: keep. One CASE whose branches stand in the order of the rules."""
        if not self.rules:
            return F.lit(True)
        branches = " ".join(f"WHEN {' AND '.join(c.sql(stats) for c in rule)} THEN FALSE" for rule in self.rules)
        return F.expr(f"CASE {branches} ELSE TRUE END")


def sample_labelled(
    df: DataFrame, labels: DataFrame, *, key: str, label: str, text: str, max_rows: int
) -> DataFrame:
    """About ``max_rows`` labelled texts at most: (key, text, label), chosen by a hash of the key.

    The bound makes the chosen keys small enough to broadcast, so the texts are not shuffled. Rows with
    a null key or label, and labels of unknown texts, take no part.
    """
    marked = labels.select(
        F.col(quoted(key)).alias("key"), F.col(quoted(label)).cast("int").alias("label")
    ).where("key IS NOT NULL AND label IS NOT NULL")
    share_of = min(1.0, max_rows / max(1, marked.count()))
    chosen = marked.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share_of * (1 << 30)))
    texts = df.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text"))
    return texts.join(F.broadcast(chosen), "key")


def learn(
    df: DataFrame,
    labels: DataFrame,
    *,
    key: str = "doc_id",
    label: str = "quality",
    text: str = "text",
    max_rows: int = 20_000,
    bins: int = 40,
    max_rules: int = 12,
    max_conditions: int = 4,
    precision: float = 0.95,
    support: int = 5,
) -> DecisionList:
    """Learn rules that find texts of label 0, from about ``max_rows`` labelled texts at most.

    A condition compares one of SHARES with one of ``bins`` quantiles. A rule is kept only if at least
    ``precision`` of what it covers has label 0, over rows grown on and pruned on, and ``support`` such
    rows; so doubtful texts are kept. Without labels of both kinds there are no rules.
    """
    sample = sample_labelled(df, labels, key=key, label=label, text=text, max_rows=max_rows)
    stats = statistics(sample, "text", keep=["key", "label"])
    rows = settle(
        stats.selectExpr(
            "CAST(label > 0 AS INT) AS good",
            "pmod(xxhash64(key, 17), 3) > 0 AS grows",
            *[f"{share(n)} AS {n}" for n in SHARES],
        )
    )
    names = list(SHARES)
    marks = ", ".join(f"{(i + 1) / (bins + 1):.6f}" for i in range(bins))
    found = rows.selectExpr(
        "count(*) AS n", *[f"percentile_approx({n}, array({marks}), 10000) AS {n}" for n in names]
    ).first()
    if not found["n"]:
        return DecisionList(())
    cuts = {n: sorted(set(found[n])) for n in names}
    binned = settle(
        rows.selectExpr(
            "good",
            "grows",
            *[
                f"size(filter(array({', '.join(f'{c!r}D' for c in cuts[n])}), c -> c < {n})) AS b_{n}"
                for n in names
            ],
        )
    )
    rules: list[tuple[Condition, ...]] = []
    for _ in range(max_rules):
        rule = _next_rule(binned, cuts, rules, max_conditions, precision, support)
        if rule is None:
            break
        rules.append(rule)
    return DecisionList(tuple(rules))


def _sql(rule: tuple[Condition, ...], cuts: dict[str, list[float]]) -> str:
    return " AND ".join(c.binned(cuts) for c in rule) or "TRUE"


def _next_rule(
    binned: DataFrame,
    cuts: dict[str, list[float]],
    rules: list[tuple[Condition, ...]],
    max_conditions: int,
    precision: float,
    support: int,
) -> tuple[Condition, ...] | None:
    left = binned
    for rule in rules:
        left = left.where(f"NOT ({_sql(rule, cuts)})")
    grown: list[Condition] = []
    pairs = ", ".join(f"struct('{n}' AS statistic, b_{n} AS bin)" for n in cuts)
    for _ in range(max_conditions):
        histogram = (
            left.where("grows")
            .where(_sql(tuple(grown), cuts))
            .selectExpr("good", f"explode(array({pairs})) AS at")
            .groupBy("at.statistic", "at.bin", "good")
            .count()
            .collect()  # statistics × bins × 2 rows at most
        )
        counts: dict[tuple[str, int], list[int]] = {}
        for r in histogram:
            counts.setdefault((r["statistic"], r["bin"]), [0, 0])[r["good"]] = r["count"]
        first = next(iter(cuts))
        bad, good = (sum(v[i] for (n, _), v in counts.items() if n == first) for i in (0, 1))
        if not bad or not good:
            break
        best, best_gain = None, 1e-9
        for n, at in cuts.items():
            under = [0, 0]
            for i, threshold in enumerate(at):
                here = counts.get((n, i), [0, 0])
                under = [under[0] + here[0], under[1] + here[1]]
                for above, (p, q) in ((False, under), (True, [bad - under[0], good - under[1]])):
                    if p:
                        gain = p * (math.log2(p / (p + q)) - math.log2(bad / (bad + good)))
                        if gain > best_gain:
                            best, best_gain = Condition(n, above, threshold), gain
        if best is None or best in grown:
            break
        grown.append(best)
    if not grown:
        return None
    # Prune: the shortest beginning of the rule that does best on the rows kept apart.
    heads = [tuple(grown[:i]) for i in range(1, len(grown) + 1)]
    sums = []
    for i, head in enumerate(heads):
        inside = _sql(head, cuts)
        for kind, which in (("a", "TRUE"), ("p", "NOT grows")):
            sums += [f"count_if({inside} AND {which} AND good = {g}) AS {kind}{g}_{i}" for g in (0, 1)]
    row = left.selectExpr(*sums).first()

    def worth(i: int) -> float:
        bad, good = row[f"p0_{i}"], row[f"p1_{i}"]
        return (bad - good) / (bad + good) if bad + good else -1.0

    def precise(i: int) -> bool:
        bad, good = row[f"a0_{i}"], row[f"a1_{i}"]
        return bad >= support and bad >= precision * (bad + good) and worth(i) >= 2 * precision - 1

    kept = max((i for i in range(len(heads)) if precise(i)), key=lambda i: (round(worth(i), 9), -i), default=None)
    return None if kept is None else heads[kept]


BASE_FAILED = "{s}.n_words < 50 OR 100 * {s}.n_repeat_words > 50 * {s}.n_words"


def judge(df: DataFrame, rules: DecisionList, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``stats``, ``base_failed`` and ``kept``; columns of these names are replaced.

    Texts of under 50 words, or of which over half the words stand in repeated windows, fail the base
    rules (null and empty texts do); for the others ``kept`` is the verdict of the list.
    """
    clean = without(df, "base_failed", "kept") if keep is None else df
    judged = statistics(clean, text, keep)
    failed = F.expr(BASE_FAILED.format(s="stats"))
    return judged.select("*", failed.alias("base_failed"), (~failed & rules.verdict()).alias("kept"))
