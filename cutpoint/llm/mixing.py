"""Mixing sources to target weights by balanced sampling (the cube method).

Every source gets a target of words. A text is taken a whole number of times; what its source's target
leaves over that is an inclusion probability. The flight phase moves probabilities within the null space
of the constraints (number of texts, number of words) until each is 0 or 1: three open texts span a line
along which both totals stay; one step along it settles at least one of them. It runs in blocks of bounded
size, each of which leaves two open texts at most; those meet in fewer blocks in the next round, until one
block per source is left. Only there are constraints dropped, texts first, to land the last two, and the words
that this leaves over are cancelled by turning a few texts of that block.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cutpoint.llm.texts import quoted
from cutpoint.session import settle

#: Texts settled together in one task; what a block leaves open is 2 at most.
BLOCK = 4096
NEAR = 1e-9


def n_words(text: str) -> str:
    """SQL of the number of words of a text column; null counts 0."""
    return f"CAST(regexp_count(coalesce({quoted(text)}, ''), '[^\\\\x20\\\\x09-\\\\x0D]+') AS BIGINT)"


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """Words to take of each source: source, source_size, target.

    ``sizes`` has columns source and size. Sources, by code point and null last, bear the weights in turn
    and share ``total`` times all words by weight. None gets over ``most`` times its own words; the excess
    is shared by weight again until none is above. In closed form: sources fill up in the order of
    their limit per weight, so one running sum tells which do. The window runs over one row per source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = " ".join(f"WHEN {i} THEN {float(w)!r}D" for i, w in enumerate(weights))
    ranked = by.selectExpr(
        "source",
        "source_size",
        f"CASE pmod(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1, {len(weights)}) {turn} END AS weight",
    )
    limit = f"{float(most)!r}D * source_size"
    run = "OVER (ORDER BY {0} / weight, source ASC NULLS LAST ROWS BETWEEN {1})"
    before = run.format(limit, "UNBOUNDED PRECEDING AND 1 PRECEDING")
    on = run.format(limit, "CURRENT ROW AND UNBOUNDED FOLLOWING")
    filled = ranked.selectExpr(
        "*",
        f"coalesce(sum({limit}) {before}, 0D) AS given",
        f"sum(weight) {on} AS open",
        f"{float(total)!r}D * sum(source_size) OVER () AS words",
    ).selectExpr("*", f"({limit}) / weight * open <= words - given AS full")
    # The level per weight that the sources share which aren't full: set where the first of them begins.
    level = (
        "first_value(CASE WHEN NOT full THEN (words - given) / open END, TRUE)"
        f" {run.format(limit, 'UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING')}"
    )
    return filled.selectExpr(
        "source", "source_size", f"CASE WHEN full THEN {limit} ELSE least({limit}, weight * {level}) END AS target"
    )


def flight(size: list[int], chance: list[float], draw: random.Random, last: bool) -> list[float]:
    """Move the chances of a block to 0 or 1 with the totals of texts and words kept; ``last``: land too."""
    state = list(chance)
    waiting: Iterator[int] = iter([i for i, p in enumerate(state) if NEAR < p < 1 - NEAR])
    active: list[int] = []

    def move(along: list[float]) -> None:
        ups = [(1 - state[i]) / u if u > 0 else -state[i] / u for i, u in zip(active, along) if u]
        downs = [state[i] / u if u > 0 else (state[i] - 1) / u for i, u in zip(active, along) if u]
        up, down = min(ups), min(downs)
        step = up if draw.random() * (up + down) < down else -down
        for i, u in zip(active, along):
            value = state[i] + step * u
            state[i] = 0.0 if value < NEAR else 1.0 if value > 1 - NEAR else value
        active[:] = [i for i in active if 0 < state[i] < 1]

    while True:
        while len(active) < 3 and (new := next(waiting, None)) is not None:
            active.append(new)
        if len(active) < 3:
            break
        a, b, c = (size[i] for i in active)
        if a == b:
            move([1.0, -1.0, 0.0])
        else:
            scale = max(abs(c - b), abs(a - c), abs(b - a))
            move([(c - b) / scale, (a - c) / scale, (b - a) / scale])
    if last:
        if len(active) == 2:  # words alone
            a, b = (size[i] for i in active)
            move([float(b), float(-a)] if a and b else [0.0 if a else 1.0, 0.0 if b else 1.0] if a != b else [1.0, -1.0])
        while active:
            i = active.pop()
            state[i] = 1.0 if draw.random() < state[i] else 0.0
        correct(size, chance, state)
    return state


def correct(size: list[int], chance: list[float], state: list[float], turns: int = 4) -> None:
    """A very long text can't be balanced by the few left at landing: turn the texts that cancel most of the rest.

    Each turn takes one open text or two, whichever leaves the fewest words over: two also swap a text that is taken
    for one that isn't. Nothing turns where that gains less than half a word.
    """
    sizes, taken = np.array(size, float), np.array(state)
    over = float(sizes @ (taken - np.array(chance)))
    free = np.flatnonzero([NEAR < p < 1 - NEAR for p in chance])
    for _ in range(turns if len(free) else 0):
        change = (1 - 2 * taken[free]) * sizes[free]
        alone = np.abs(over + change)
        left, turned = alone.min(), [int(alone.argmin())]
        # The partner of each text: of those around what it leaves to cancel, one may be the text itself.
        order = np.argsort(change, kind="stable")
        near = np.searchsorted(change[order], -(over + change))
        for beside in (-2, -1, 0, 1):
            partner = order[np.clip(near + beside, 0, len(order) - 1)]
            both = np.where(partner == np.arange(len(order)), np.inf, np.abs(over + change + change[partner]))
            if both.min() < left:
                first = int(both.argmin())
                left, turned = both[first], [first, int(partner[first])]
        if left >= abs(over) - 0.5:
            break
        over += float(change[turned].sum())
        taken[free[turned]] = 1 - taken[free[turned]]
    state[:] = taken.tolist()


def _settle_blocks(units: DataFrame, last: bool, seed: int) -> DataFrame:
    columns = "doc_id long, source string, size long, mark long, chance double, base long"

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("size", "descending"), ("order", "ascending"), ("doc_id", "ascending"), ("mark", "ascending")])
        draw = random.Random(f"{seed} {group['block'][0]} {group['source'][0]} {len(group)}")
        state = flight(group["size"].to_pylist(), group["chance"].to_pylist(), draw, last)
        at = group.schema.get_field_index("chance")
        group = group.set_column(at, "chance", pa.array(state, pa.float64()))
        return group.select(["doc_id", "source", "size", "mark", "chance", "base"])

    return units.groupBy("source", "block").applyInArrow(run, columns)


def sample(units: DataFrame, *, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """How often each unit is taken: doc_id, source, size, mark, copies.

    ``units`` has doc_id, source, size, rate (double: copies wanted on average), one row per
    (doc_id, source), or per (doc_id, source, mark) with a column mark (long). A column n counts the equal
    texts of the given size that a unit stands for; copies are those of all n, which differ by one text at most
    from what is wanted. Both totals of every source are met up to the landing of its last two units.
    A rerun takes the same: the order within a block and its draws come from hashes of the ids.
    """
    for name, value in (("mark", "CAST(NULL AS BIGINT)"), ("n", "1L")):
        if name not in units.columns:
            units = units.withColumn(name, F.expr(value))
    wanted = units.selectExpr("doc_id", "source", "size", "mark", "n * rate AS rate")
    open_units = wanted.selectExpr(
        "doc_id",
        "source",
        "size",
        "mark",
        f"CASE WHEN rate - floor(rate) > {1 - NEAR!r}D OR rate - floor(rate) < {NEAR!r}D THEN 0D ELSE rate - floor(rate) END AS chance",
        f"CAST(floor(rate) + CASE WHEN rate - floor(rate) > {1 - NEAR!r}D THEN 1 ELSE 0 END AS BIGINT) AS base",
    )
    done: list[DataFrame] = []
    turn = 0
    while True:
        counts = open_units.groupBy("source").agg(F.count("*").alias("n"))
        largest = counts.agg(F.max("n")).first()[0] or 0
        last = largest <= block
        blocked = open_units.join(counts.withColumnRenamed("source", "of"), F.expr("source <=> of")).selectExpr(
            "doc_id",
            "source",
            "size",
            "mark",
            "chance",
            "base",
            f"xxhash64(doc_id, size, {seed}, mark) AS order",
            f"pmod(xxhash64(doc_id, {seed}, {turn}, mark), CAST(ceil(n / {block / 2}) AS BIGINT)) AS block"
            if not last
            else "0L AS block",
        )
        moved = settle(_settle_blocks(blocked, last, seed))
        done.append(moved.where("chance = 0 OR chance = 1"))
        if last:
            break
        open_units = moved.where("chance > 0 AND chance < 1")
        turn += 1
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.selectExpr("doc_id", "source", "size", "mark", "base + CAST(chance AS BIGINT) AS copies")


def _unit(key: str, source: str, text: str) -> list[Column]:
    return [
        F.col(quoted(key)).cast("long").alias("doc_id"),
        F.col(quoted(source)).cast("string").alias("source"),
        F.expr(f"xxhash64({quoted(text)})").alias("mark"),
    ]


def _shares(
    rows: DataFrame, weights: tuple[float, ...], total: float, most: float, seed: int
) -> tuple[DataFrame, DataFrame]:
    """What the rows of each (doc_id, source, mark) are taken: each so often, ``extra`` of them once more; and the targets.

    ``rows`` has doc_id, source, mark (hash of the text) and size. The rows of a key are one unit if together they are
    no more than a typical text of their source. Rows of larger keys are sampled on their own, those of one text by
    their number, so no unit is larger than a text and a key may hold any part of its source.
    """
    kinds = settle(rows.groupBy("doc_id", "source", "mark").agg(F.max("size").alias("size"), F.count("*").alias("n")))
    goal = targets(kinds.selectExpr("source", "size * n AS size"), weights, total, most)
    typical = kinds.groupBy("source").agg(F.expr("sum((size + 1) * n) / sum(n) AS typical"))
    goal = settle(
        goal.join(typical.withColumnRenamed("source", "of"), F.expr("source <=> of")).selectExpr(
            "source AS of",
            "source_size",
            "target",
            "CASE WHEN source_size > 0 THEN target / source_size ELSE 0D END AS rate",
            "typical",
        )
    )
    keys = kinds.groupBy("doc_id", "source").agg(F.expr("sum(size * n) AS size"), F.sum("n").alias("n")).where("n > 1")
    keys = settle(
        keys.join(goal, F.expr("source <=> of")).selectExpr("doc_id", "source", "size", "size + n <= typical AS whole")
    )
    of_key = keys.selectExpr("doc_id AS key", "source AS key_source", "whole")
    kinds = settle(
        kinds.join(of_key, F.expr("doc_id <=> key AND source <=> key_source"), "left").selectExpr(
            "doc_id",
            "source",
            "mark",
            "size",
            "coalesce(whole, FALSE) AS whole",
            "CASE WHEN NOT whole THEN mark END AS unit_mark",
            "CASE WHEN NOT whole THEN n ELSE 1 END AS n",
        )
    )
    units = kinds.where("NOT whole").selectExpr("doc_id", "source", "size", "unit_mark AS mark", "n")
    units = units.unionByName(
        keys.where("whole").selectExpr("doc_id", "source", "size", "CAST(NULL AS BIGINT) AS mark", "1L AS n")
    )
    rated = units.join(goal, F.expr("source <=> of")).select("doc_id", "source", "size", "mark", "n", "rate")
    taken = sample(rated, seed=seed).selectExpr("doc_id AS key", "source AS key_source", "mark AS key_mark", "copies")
    shares = kinds.join(taken, F.expr("doc_id <=> key AND source <=> key_source AND unit_mark <=> key_mark")).selectExpr(
        "doc_id AS key", "source AS key_source", "mark AS key_mark", "copies div n AS each", "copies % n AS extra"
    )
    return settle(shares), goal


def _with_copies(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """``rows`` (with doc_id, source, mark) with a column copies.

    Rows are numbered only where some of equal ones are taken once more than the others: within the part of the
    settled table that they stand in, after those of the parts before.
    """
    at = F.expr("doc_id <=> key AND source <=> key_source AND mark = key_mark")
    even = rows.join(shares.where("extra = 0"), at).select(*rows.columns, F.col("each").alias("copies"))
    uneven = shares.where("extra > 0")
    if uneven.isEmpty():
        return even
    found = rows.join(uneven, at).select(*rows.columns, "each", "extra", F.monotonically_increasing_id().alias("place"))
    found = settle(found).withColumn("part", F.expr("shiftright(place, 33)"))
    kind = ["doc_id", "source", "mark"]
    parts = found.groupBy(*kind, "part").agg(F.count("*").alias("n")).selectExpr(
        "doc_id AS key", "source AS key_source", "mark AS key_mark", "part AS key_part",
        "coalesce(sum(n) OVER (PARTITION BY doc_id, source, mark ORDER BY part"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before",
    )
    ranked = found.withColumn("rank", F.expr("row_number() OVER (PARTITION BY doc_id, source, mark, part ORDER BY place)"))
    return even.unionByName(
        ranked.join(parts, at & F.expr("part = key_part")).select(
            *rows.columns, F.expr("each + CAST(before + rank <= extra AS BIGINT) AS copies")
        )
    )


def mix(
    df: DataFrame,
    *,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[float, ...] = (5, 2, 1),
    total: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
) -> DataFrame:
    """One row per row of ``df``: doc_id, source, size, source_size, target, copies.

    Rows with the same key (null is one key) and source are taken equally often while they hold no more than a
    typical text of their source; rows of larger keys are sampled on their own. A null source is a source of
    its own; null texts have size 0. A source without words has target 0 and none of its texts is taken. An
    empty table gives no rows.
    """
    rows = settle(df.select(*_unit(key, source, text), F.expr(n_words(text)).alias("size")))
    shares, goal = _shares(rows, weights, total, most, seed)
    return (
        _with_copies(rows, shares)
        .join(goal, F.expr("source <=> of"))
        .select("doc_id", "source", "size", "source_size", "target", "copies")
    )


def mixed(
    df: DataFrame,
    *,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[float, ...] = (5, 2, 1),
    total: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
) -> DataFrame:
    """The mixture itself: every row of ``df`` as often as it is taken, all columns kept."""
    by = _unit(key, source, text)
    shares, _ = _shares(df.select(*by, F.expr(n_words(text)).alias("size")), weights, total, most, seed)
    rows = df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"), *by)
    names = [F.col(f"row.{quoted(c)}").alias(c) for c in df.columns]
    return _with_copies(rows, shares.where("each > 0 OR extra > 0")).selectExpr(
        "row", "explode(array_repeat(0, CAST(copies AS INT))) AS copy"
    ).select(*names)
