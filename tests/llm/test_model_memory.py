"""What a task of the sparse models holds besides the hashes that Spark hands it."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from cutpoint.llm import quality_model, sparse_models, toxicity


class Handed:
    """A frame that keeps the function its batches or groups would go through."""

    dtypes = [("doc_id", "bigint"), ("words", "array<bigint>"), ("shapes", "array<bigint>")]
    columns = ["doc_id"]

    def select(self, *columns):
        return self

    where = groupBy = agg = select

    def mapInArrow(self, run, schema):
        return run

    def applyInArrow(self, run, schema):
        self.run = run
        return self

    def collect(self):
        return []


def hashes(rows: int, each: int) -> pa.ListArray:
    flat = np.random.default_rng(rows).integers(-(1 << 63), 1 << 63, rows * each)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, each, dtype=np.int32)), pa.array(flat))


def peak(run) -> float:
    """MB of arrays that ``run`` holds at most."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_large_batch_is_scored_in_slices(llm_spark, monkeypatch):
    monkeypatch.setattr(quality_model, "without", lambda df, *names: df)
    run = quality_model.score(Handed(), {3: 1.0}, keep=["doc_id"])
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), hashes(2000, 1000), hashes(2000, 1000)], names=["doc_id", "words", "shapes"])
    assert peak(lambda: list(run(iter([batch])))) < 40  # 32 MB of hashes


def test_features_of_a_shard_are_not_held(llm_spark):
    sample, rows = Handed(), 1000
    read = lambda parts: (parts[0].astype(np.int64), np.ones(len(parts[0])))
    sparse_models.train_shards(sample, ["words"], read, lambda examples: {0: float(sum(label for *_, label in examples))})
    group = pa.table({"place": pa.array(range(rows)), "label": pa.array([1] * rows), "words": hashes(rows, 2000)})
    assert peak(lambda: sample.run(group)) < 4  # 16 MB of hashes


def test_examples_come_in_order_from_several_batches():
    place, label = [5, 1, 3, 1, 2], [0, 1, 0, 0, 1]
    columns = lambda a, b: {"place": place[a:b], "label": pa.array(label[a:b], pa.int32()), "words": [[10 * i] * i for i in range(a, b)]}
    group = pa.concat_tables([pa.table(columns(0, 2)), pa.table(columns(2, 5)).slice(0), pa.table(columns(0, 5)).slice(5)])
    examples = sparse_models.Examples(group, ["words"], lambda parts: (parts[0].astype(np.int64), np.ones(len(parts[0]))))
    for _ in range(2):
        assert [(at.tolist(), y) for at, _, y in examples] == [([30] * 3, 0), ([10], 1), ([40] * 4, 1), ([20] * 2, 0), ([], 0)]
    assert len(examples) == 5


@pytest.mark.parametrize("limit", [1, 7, 1 << 17])
def test_slices_cover_every_row_once(limit):
    at = [np.array([0, 0, 3, 3, 12, 13, 13]), np.array([0, 1, 1, 1, 5, 9, 9])]
    lists = [(np.arange(13, dtype=np.uint64), at[0]), (np.arange(9, dtype=np.uint64), at[1])]
    parts = list(sparse_models.slices(lists, limit))
    for k, (flat, offsets) in enumerate(lists):
        assert np.concatenate([p[k][0] for p in parts]).tolist() == flat.tolist()
        assert np.concatenate([np.diff(p[k][1]) for p in parts]).tolist() == np.diff(offsets).tolist()
    assert all(len(p[0][1]) == 2 or sum(len(f) for f, _ in p) <= limit for p in parts)
    assert list(sparse_models.slices([(flat[:0], offsets[:1]) for flat, offsets in lists], limit)) == []


@pytest.mark.parametrize("model", [quality_model, toxicity])
def test_a_score_does_not_depend_on_its_neighbours(llm_spark, odd, model):
    index = np.random.default_rng(1).choice(sparse_models.WIDTH, 60_000, replace=False)
    weights = dict(zip(index.tolist(), np.random.default_rng(2).normal(size=len(index)).tolist())) | {-1: 0.1, -2: 0.7}
    seen = {}
    for df in (odd.coalesce(1), odd.coalesce(1).orderBy("text"), *(odd.where(odd["doc_id"] == i) for i in (1, 3, 4, 5))):
        for r in model.score(df, weights).collect():
            assert seen.setdefault(r["text"], r[-1]) == r[-1]
