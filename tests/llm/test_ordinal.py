"""Ordinal grades and their updates, against plain Python and on few or contradicting labels."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from cutpoint.llm import sparse_models, toxicity

WORDS = ["calm", "river", "stone", "market", "window", "paper", "green", "letter"]


def limits_of(weights):
    return [weights[k] for k in sorted((k for k in weights if k < 0), reverse=True)]


def corpus(spark, marks, n=40):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(12)) + (" vile rotten" if marks.get(i) else "")) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(list(marks.items()), "doc_id long, toxic int")


@pytest.mark.parametrize(
    "marks",
    [{0: 0}, {0: 1}, {0: 1, 1: 0, 2: 0}, {i: int(i % 4 == 0) for i in range(20)}],
    ids=["one clean", "one toxic", "three", "twenty"],
)
def test_few_labels(llm_spark, marks):
    docs, labels = corpus(llm_spark, marks)
    weights = toxicity.train(docs, labels)
    limits = limits_of(weights)
    assert len(limits) == toxicity.GRADES and limits[0] < limits[1]
    rows = toxicity.score(docs, weights).collect()
    assert all(0 <= r["severity"] - r["p_toxic"] <= r["p_toxic"] + 1e-12 for r in rows)
    assert all(r["p_toxic"] < 0.2 for r in rows if not marks.get(r["doc_id"]))


def test_contradicting_labels(llm_spark):
    docs, _ = corpus(llm_spark, {})
    both = llm_spark.createDataFrame([(i, t) for i in range(40) for t in (0, 1)], "doc_id long, toxic int")
    weights = toxicity.train(docs, both)
    assert np.all(np.diff(limits_of(weights)) > 0)
    assert all(0.1 < r["p_toxic"] < 0.8 for r in toxicity.score(docs, weights).collect())


def test_a_shard_without_marked_texts(llm_spark, monkeypatch):
    """In shards, most of which see no marked text: the thresholds still rise."""
    monkeypatch.setattr(toxicity, "FEW", 0)
    docs, labels = corpus(llm_spark, {i: int(i == 0) for i in range(40)})
    assert np.all(np.diff(limits_of(toxicity.train(docs, labels))) > 0)


def test_given_grades_are_kept(llm_spark):
    rows = [(i, 1, g, [g, 100 + i]) for i, g in enumerate([0, 1, 2, 3, 3])]
    sample = llm_spark.createDataFrame([(k, g, f) for k, _, g, f in rows], "key long, label int, features array<long>")
    spread, grades, shards = toxicity.graded(sample)
    assert grades == 3 and shards == 1 and sorted(r["label"] for r in spread.collect()) == [0, 1, 2, 3, 3]


def test_grades_are_spread_over_all_rows(llm_spark):
    """Half of the marked texts, those with more telling features, get grade 2."""
    rows = [(i, 1, [1, 2] if i % 2 else [1]) for i in range(20)] + [(i, 0, [3]) for i in range(20, 80)]
    spread, grades, shards = toxicity.graded(llm_spark.createDataFrame(rows, "key long, label int, features array<long>"))
    got = {r["key"]: r["label"] for r in spread.collect()}
    assert (grades, shards) == (2, 1) and got == {i: 0 if i >= 20 else 2 if i % 2 else 1 for i in range(80)}


def test_weights_are_averaged_by_examples(llm_spark):
    rows = [(i, i % 3, [i]) for i in range(30)]
    sample = llm_spark.createDataFrame(rows, "key long, label int, features array<long>")
    fit = lambda examples: {7: float(len(examples)), 8: 1.0}
    read = lambda parts: (np.zeros(1, np.int64), np.ones(1))
    shard = [r[0] for r in sample.selectExpr("pmod(xxhash64(key), 16) AS s").collect()]
    sizes = [shard.count(s) for s in set(shard)]
    got = sparse_models.train_shards(sample, ["features"], read, fit, 16)
    assert got[8] == 1.0 and math.isclose(got[7], sum(n * n for n in sizes) / 30)
    assert sparse_models.train_shards(sample.limit(0), ["features"], read, fit) == {}


def test_updates_equal_a_plain_version():
    """Follow-the-regularised-leader and the cumulative link, number by number."""
    rng = random.Random(6)
    examples = [(np.array(sorted(rng.sample(range(30), 4))), None, rng.choice([0, 0, 0, 1, 2])) for _ in range(60)]
    r, n = toxicity.RATES, 2
    z, q, limits, seen = [0.0] * 30, [0.0] * 30, [2.0, 3.0], [1.0, 1.0]
    logistic = lambda x: 1 / (1 + math.exp(-max(-30, min(30, x))))

    def weight(i):
        if abs(z[i]) <= r.l1:
            return 0.0
        return (math.copysign(r.l1, z[i]) - z[i]) / ((r.beta + math.sqrt(q[i])) / r.alpha + r.l2)

    for _ in range(toxicity.EPOCHS):
        for at, _, y in examples:
            w = {i: weight(i) for i in at.tolist()}
            below = [0.0, *(logistic(t - sum(w.values())) for t in limits), 1.0]
            slope = [b * (1 - b) for b in below]
            p = max(below[y + 1] - below[y], 1e-9)
            g = max(-1.0, min(1.0, (slope[y + 1] - slope[y]) / p))
            for i in w:
                z[i] += g - (math.sqrt(q[i] + g * g) - math.sqrt(q[i])) / r.alpha * w[i]
                q[i] += g * g
            for k, sign in ((y, -1), (y - 1, 1)):
                if 0 <= k < n:
                    step = sign * slope[k + 1] / p
                    seen[k] += step * step
                    limits[k] -= 0.5 * step / math.sqrt(seen[k])
            limits[0] = max(limits[0], toxicity.FIRST)
            limits[1] = max(limits[1], limits[0] + toxicity.APART)
    got = toxicity._fit(n)(examples)
    want = {i: weight(i) for i in range(30) if weight(i)}
    assert got == pytest.approx(want | {-1: limits[0], -2: limits[1]})
