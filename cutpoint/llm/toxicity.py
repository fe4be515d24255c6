"""Toxicity as a severity grade: cumulative-link ordinal regression over sparse text features.

P(grade <= k) = logistic(threshold_k - s) with one linear score s for all thresholds, so the grades share
their weights. Features are the distinct words of a text and their first four and five letters. The
severity of a text is the expected grade, the sum of P(grade > k).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cutpoint.llm.near_copies import mixed
from cutpoint.llm.quality_rules import sample_labelled
from cutpoint.llm.sparse_models import SHARDS, WIDTH, Leader, Rates, dense, row_sums, scored, train_shards
from cutpoint.llm.texts import quoted, whole, without
from cutpoint.session import settle

RATES = Rates(alpha=0.3, beta=1.0, l1=4.0, l2=0.1)
EPOCHS = 3
#: Grades above 0 that a yes/no label is spread over.
GRADES = 2
#: The first threshold is at least this, so that a text without telling features isn't toxic; others lie apart so far.
FIRST, APART = 1.5, 0.05
#: A sample of fewer marked texts, and of fewer texts in all, isn't split into shards.
FEW, SMALL = 400, 4000


def features(text: Column) -> Column:
    """Hashes of the distinct words (runs of letters, lower case) and of their beginnings."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    distinct = F.array_distinct(found)
    begun = F.flatten(
        F.transform(
            distinct,
            lambda w: F.array(
                F.xxhash64(w), F.xxhash64(F.substring(w, 1, 5), F.lit(5)), F.xxhash64(F.substring(w, 1, 4), F.lit(4))
            ),
        )
    )
    return F.array_distinct(begun).alias("features")


def _index(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes) & np.uint64(WIDTH - 1)).astype(np.int64)


def _read(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at = np.unique(_index(parts[0]))
    return at, np.ones(len(at))


def graded(sample: DataFrame) -> tuple[DataFrame, int, int]:
    """``sample`` (key, label, features) with grades for labels, how many grades there are above 0, and how many shards to learn in.

    Grades are kept as given. Labels 0 and 1 are spread over two grades, once over all rows: a marked text that
    holds more of the features that marked texts have and others haven't than half of the marked ones gets grade 2.
    """
    rows = settle(sample.select(F.monotonically_increasing_id().alias("rid"), "key", F.greatest("label", F.lit(0)).alias("label"), "features"))
    top, marked, other = rows.agg(F.max("label"), F.expr("count_if(label > 0)"), F.expr("count_if(label = 0)")).first()
    shards = 1 if marked < FEW and marked + other < SMALL else SHARDS
    if (top or 0) > 1:
        return rows, top, shards
    each = rows.select("rid", "label", F.explode("features").alias("feature"))
    held = each.groupBy("feature").agg(F.expr("count_if(label > 0)").alias("m"), F.expr("count_if(label = 0)").alias("o"))
    telling = held.where(f"m >= 5 AND (m + 0.5D) / {max(1, marked)} > 8 * (o + 0.5D) / {max(1, other)}").select("feature")
    counted = each.where("label > 0").join(telling, "feature").groupBy("rid").agg(F.count("*").alias("held"))
    told = settle(rows.where("label > 0").select("rid").join(counted, "rid", "left").select("rid", F.coalesce("held", F.lit(0)).alias("held")))
    middle = told.agg(F.median("held")).first()[0] or 0.0
    grade = told.selectExpr("rid", f"1 + CAST(held > {middle!r}D AS INT) AS grade")
    spread = rows.join(grade, "rid", "left").select("key", F.coalesce("grade", F.lit(0)).alias("label"), "features")
    return spread, GRADES, shards


def _logistic(x: np.ndarray | float):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit(n: int):
    """Weights and ``n`` thresholds, strictly rising, of one shard."""

    def fit(examples: list) -> dict[int, float]:
        leader = Leader(WIDTH, RATES)
        limits, seen, step = np.arange(n, dtype=float) + 2, np.full(n, 1.0), APART * np.arange(n)
        for _ in range(EPOCHS):
            for at, _, y in examples:
                w = leader.weights(at)
                below = np.concatenate(([0.0], _logistic(limits - w.sum()), [1.0]))
                slope = below * (1 - below)
                p = max(below[y + 1] - below[y], 1e-9)
                leader.learn(at, np.full(len(at), np.clip((slope[y + 1] - slope[y]) / p, -1, 1)), w)
                for k, sign in ((y, -1), (y - 1, 1)):
                    if 0 <= k < n:
                        g = sign * slope[k + 1] / p
                        seen[k] += g * g
                        limits[k] -= 0.5 * g / np.sqrt(seen[k])
                limits[0] = max(limits[0], FIRST)
                limits = np.maximum.accumulate(limits - step) + step
        weights = leader.weights(slice(None))
        found = {int(i): float(weights[i]) for i in np.flatnonzero(weights)}
        return found | {-1 - k: float(v) for k, v in enumerate(limits)}

    return fit


def train(
    df: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "toxic", text: str = "text", max_rows: int = 20_000
) -> dict[int, float]:
    """Weights and thresholds (index -1, -2, ..., strictly rising) learnt from about ``max_rows`` labelled texts at most.

    All thresholds exist however few labels there are; they start where a text without weights isn't toxic and move
    with what is seen, but never so far that such a text becomes toxic. Texts that are labelled both ways count both ways. A small sample with fewer
    than FEW marked texts is learnt from in one go, others in shards.
    """
    sample = sample_labelled(df, labels, key=key, label=label, text=text, max_rows=max_rows)
    rows, grades, shards = graded(sample.select("key", "label", features(whole("text"))))
    return train_shards(rows.select("key", "label", "features"), ["features"], _read, _fit(grades), shards)


def score(df: DataFrame, weights: dict[int, float], text: str = "text", *, keep: list[str] | None = None) -> DataFrame:
    """Add ``severity`` (expected grade) and ``p_toxic`` (probability of a grade above 0).

    Null and empty texts have no features. Without any labels there are no thresholds and both are 0.
    """
    kept = without(df.select(*[quoted(c) for c in (keep or df.columns)]), "severity", "p_toxic").columns
    model = dense(weights)
    limits = [weights[i] for i in sorted((i for i in weights if i < 0), reverse=True)]

    def run(lists: list) -> list[np.ndarray]:
        flat, offsets = lists[0]
        total = row_sums(model[_index(flat)], offsets)
        above = [1 - _logistic(limit - total) for limit in limits] or [np.zeros(len(total))]
        return [np.sum(above, axis=0), above[0]]

    rows = df.select(*[quoted(c) for c in kept], features(whole(quoted(text))))
    return scored(rows, kept, ["features"], "severity double, p_toxic double", run)
