"""Secret scans whose candidates are weighed by who else holds them.

Base patterns find spans that stay in any case. Looser patterns find candidates; the hash of each is
counted over the corpus by distinct owner and distinct repository. A value that several owners hold is an
example that was copied around; one that a single owner holds in few repositories looks live, and its span
is added. All of it is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from cutpoint.llm.texts import free_name, quoted, whole
from cutpoint.session import settle


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: The group that holds the value (0: the match), its least length in characters, and what it must hold.
    group: int = 0
    least: int = 0
    holds: tuple[str, ...] = ()


#: Fixed by the contract, in the order that breaks ties of the start.
BASE = (
    Kind(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 18),
    # Only runs that are long enough: greedy and leftmost, so the runs are the same as without the bound.
    Kind("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Candidates of the method.
LOOSE = (
    Kind("signed", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Kind("opaque", r"[A-Za-z0-9_-]{24,}", 0, 24, ("[0-9][^0-9]*[0-9][^0-9]*[0-9]", "[A-Za-z]")),
)
KINDS = (*BASE, *LOOSE)
#: What a credential goes on with beyond a span.
PART = "[A-Za-z0-9_+/-]"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(kind: Kind, order: int, text: str) -> str:
    """Array of (kind, place in the text's matches, characters before it since the last match, length, value)."""
    pattern = _literal(kind.pattern)
    found = f"regexp_extract_all({text}, {pattern}, 0)"
    values = f"regexp_extract_all({text}, {pattern}, {kind.group})"
    gaps = f"slice(split({text}, {pattern}, -1), 1, size({found}))"
    return (
        f"CASE WHEN {text} RLIKE {pattern} THEN transform(arrays_zip({found}, {gaps}, {values}),"
        f" (x, i) -> struct({order} AS kind, i AS place, length(x.`1`) AS gap, length(x.`0`) AS length, x.`2` AS value))"
        " ELSE array() END"
    )


def find(
    df: DataFrame, text: str = "text", owner: tuple[str, ...] = ("source",), repository: tuple[str, ...] = ("source", "lang")
) -> tuple[DataFrame, DataFrame]:
    """The rows, numbered and written once, and the spans in them.

    Rows: all columns of ``df`` as struct ``row``, and ``rid``. Spans: rid, kind (place in KINDS), start,
    end (code points, end exclusive), base, n_owners, n_repositories, live. A loose candidate is left out
    where it overlaps a base span or another loose candidate that starts earlier. ``live``: one owner
    holds the value, in two repositories at most. Null owners and repositories count as one more value.
    """
    who = F.xxhash64(*[F.coalesce(F.col(quoted(c)).cast("string"), F.lit("\0")) for c in owner])
    where = F.xxhash64(*[F.coalesce(F.col(quoted(c)).cast("string"), F.lit("\0")) for c in repository])
    t = free_name(df, "whole_text")
    rows = df.select(
        F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"),
        whole(quoted(text)).alias(t),
        who.alias("owner"),
        where.alias("repository"),
    )
    # The number is fixed by writing it: it isn't worked out anew.
    found = F.concat(*[F.expr(_matches(k, i, t)) for i, k in enumerate(KINDS)])
    rows = settle(rows.select(F.monotonically_increasing_id().alias("rid"), "row", "owner", "repository", found.alias("found")))

    placed = (
        rows.select("rid", "owner", "repository", F.explode("found").alias("m"))
        .selectExpr(
            "rid",
            "owner",
            "repository",
            "m.kind AS kind",
            "m.value AS value",
            "m.length AS length",
            "sum(m.gap + m.length) OVER (PARTITION BY rid, m.kind ORDER BY m.place"
            " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS end",
        )
        .where(
            " OR ".join(
                f"(kind = {i} AND length(value) >= {k.least}"
                + "".join(f" AND value RLIKE {_literal(p)}" for p in k.holds)
                + ")"
                for i, k in enumerate(KINDS)
            )
        )
        .selectExpr("rid", "owner", "repository", "kind", "end - length AS start", "end", "xxhash64(value) AS hash",
                    f"kind < {len(BASE)} AS base")
    )
    # Loose candidates must be clear of base spans and of loose ones before them.
    before = "OVER (PARTITION BY rid ORDER BY start, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    after = "OVER (PARTITION BY rid ORDER BY start, kind ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    clear = settle(
        placed.selectExpr(
            "*", f"max(end) {before} AS reached", f"min(CASE WHEN base THEN start END) {after} AS next_base"
        )
        .where("base OR ((reached IS NULL OR reached <= start) AND (next_base IS NULL OR next_base >= end))")
        .drop("reached", "next_base")
    )
    # Owners and repositories of a value: first the distinct pairs, so that a value found everywhere is small.
    held = clear.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = held.groupBy("hash", "owner").agg(F.count("*").alias("in_repositories"))
    ownership = owners.groupBy("hash").agg(
        F.count("*").alias("n_owners"), F.max("in_repositories").alias("n_repositories")
    )
    spans = clear.join(ownership, "hash").selectExpr(
        "rid", "kind", "start", "end", "base", "n_owners", "n_repositories",
        "n_owners = 1 AND n_repositories <= 2 AS live",
    )
    return rows.select("rid", "row"), spans.where("base OR live")


def per_row(spans: DataFrame) -> DataFrame:
    """One row per text that holds a span: rid and its spans in order."""
    return spans.groupBy("rid").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end", "base", "live"))).alias("spans")
    )


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]", **names) -> DataFrame:
    """The rows of ``df`` with every span replaced by ``mark``; overlapping spans become one mark.

    Letters, digits and ``_+/-`` that touch a span go with it: where only part of a credential fits a pattern, nothing of
    the rest stays. Texts without spans, null ones among them, stay as they are; so do all other columns.
    """
    rows, spans = find(df, text, **names)
    merged = (
        spans.selectExpr("rid", "start", "end", "max(end) OVER (PARTITION BY rid ORDER BY start, end"
                         " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached")
        .selectExpr("*", "sum(CASE WHEN reached IS NULL OR start >= reached THEN 1 ELSE 0 END)"
                    " OVER (PARTITION BY rid ORDER BY start, end) AS run")
        .groupBy("rid", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("rid").agg(F.sort_array(F.collect_list(F.expr("struct(CAST(start AS INT) AS start, CAST(end AS INT) AS end)"))).alias("cuts"))
    )
    t = f"row.{quoted(text)}"
    # What stands before each cut, and what stands after the last.
    begun = "CASE WHEN i = 0 THEN 0 ELSE get(cuts, i - 1).end END"
    parts = (
        f"concat(transform(cuts, (c, i) -> substr({t}, {begun} + 1, c.start - {begun})),"
        f" array(substr({t}, element_at(cuts, -1).end + 1)))"
    )
    ahead, behind = _literal(rf"^{PART}++"), _literal(rf"(?<!{PART}){PART}++\z")
    parts = (
        f"transform({parts}, (p, i) -> CASE WHEN i = 0 THEN regexp_replace(p, {behind}, '')"
        f" WHEN i = size(cuts) THEN regexp_replace(p, {ahead}, '')"
        f" ELSE regexp_replace(regexp_replace(p, {ahead}, ''), {behind}, '') END)"
    )
    done = rows.join(merged, "rid", "left").selectExpr(
        "row", f"CASE WHEN cuts IS NULL THEN {t} ELSE array_join({parts}, {_literal(mark)}) END AS text"
    )
    return done.select(
        *[F.col("text").alias(c) if c == text else F.col(f"row.{quoted(c)}").alias(c) for c in df.columns]
    )

