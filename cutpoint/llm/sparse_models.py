"""Linear models over hashed features, trained with follow-the-regularised-leader updates.

Training sees a bounded sample. It is split into a fixed number of shards by a hash of the key; each shard
is one task that runs through its examples in a fixed order, and the shards' weights are averaged by their
numbers of examples. The model is an array of fixed size, so it can travel with every scoring task.

A task holds the hashes that Spark hands it and little more: features are worked out text by text in training,
and for a bounded number of hashes at a time in scoring.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cutpoint.llm.texts import quoted

#: Size of the weight array.
WIDTH = 1 << 18
SHARDS = 4
#: Hashes that are scored at once; a text with more is scored alone.
SLICE = 1 << 17


@dataclass(frozen=True)
class Rates:
    alpha: float
    beta: float
    l1: float
    l2: float


class Leader:
    """Weights of follow-the-regularised-leader: worked out lazily from gradient sums, most are zero."""

    def __init__(self, width: int, rates: Rates):
        self.z, self.n, self.rates = np.zeros(width), np.zeros(width), rates

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, r = self.z[at], self.rates
        scale = (r.beta + np.sqrt(self.n[at])) / r.alpha + r.l2
        return np.where(np.abs(z) <= r.l1, 0.0, (np.sign(z) * r.l1 - z) / scale)

    def learn(self, at: np.ndarray, gradient: np.ndarray, weights: np.ndarray) -> None:
        square = gradient * gradient
        step = (np.sqrt(self.n[at] + square) - np.sqrt(self.n[at])) / self.rates.alpha
        self.z[at] += gradient - step * weights
        self.n[at] += square


#: (indices, values) of an example's features, and its label.
Example = tuple[np.ndarray, np.ndarray, int]
#: Hashes of several rows end to end, and where each row begins (and the last ends).
Lists = tuple[np.ndarray, np.ndarray]
Read = Callable[[list[np.ndarray]], tuple[np.ndarray, np.ndarray]]


def _lists(column: pa.ListArray) -> Lists:
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return flat.view(np.uint64), offsets - offsets[0]


class Examples:
    """The examples of a shard by place and label. Their features are worked out each time they are met, not held."""

    def __init__(self, group: pa.Table, features: list[str], read: Read):
        self.read, self.labels = read, group["label"].to_numpy()
        keys = [("place", "ascending"), ("label", "ascending")]
        self.order = pc.sort_indices(group.select([k for k, _ in keys]), sort_keys=keys).to_numpy().astype(np.int64)
        batches = group.to_batches()
        self.first = np.cumsum([0, *[b.num_rows for b in batches]])
        self.lists = [[_lists(b.column(f)) for f in features] for b in batches]

    def __len__(self) -> int:
        return len(self.order)

    def __iter__(self) -> Iterator[Example]:
        for row in self.order:
            batch = np.searchsorted(self.first, row, "right") - 1
            i = row - self.first[batch]
            yield *self.read([flat[at[i] : at[i + 1]] for flat, at in self.lists[batch]]), int(self.labels[row])


def train_shards(
    sample: DataFrame, features: list[str], read: Read,
    fit: Callable[[Examples], dict[int, float]], shards: int = SHARDS,
) -> dict[int, float]:
    """Fit every shard of ``sample`` (key, label, features: arrays of hashes) and average the weights by index.

    A shard counts as much as it has examples, one without any not at all; a weight that a shard lacks is 0 there.
    """

    def run(group: pa.Table) -> pa.Table:
        examples = Examples(group, features, read)
        found = fit(examples)
        weights = np.array(list(found.values())) * len(examples)
        # The row without an index holds the number of examples.
        index = pa.array([*found, None], pa.int64())
        return pa.table({"index": index, "weight": pa.array([*weights, float(len(examples))])})

    rows = sample.select(
        F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), F.xxhash64("key", F.lit(5)).alias("place"), "label", *features
    )
    fitted = rows.groupBy("shard").applyInArrow(run, "index long, weight double")
    sums = fitted.groupBy("index").agg(F.sum("weight").alias("s"))
    found = {r["index"]: r["s"] for r in sums.collect()}  # WIDTH and a few at most
    n = found.pop(None, 0.0)
    return {i: s / n for i, s in found.items()}


def dense(weights: dict[int, float]) -> np.ndarray:
    model = np.zeros(WIDTH)
    for i, w in weights.items():
        if i >= 0:
            model[i] = w
    return model


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of stretches of ``values``, each on its own; an empty stretch sums to 0."""
    sums = np.zeros(len(offsets) - 1)
    held = np.diff(offsets) > 0
    if held.any():
        sums[held] = np.add.reduceat(values, offsets[:-1][held])
    return sums


def slices(lists: list[Lists], limit: int) -> Iterator[list[Lists]]:
    """``lists`` in stretches of neighbouring rows that hold ``limit`` hashes at most, or one row."""
    ends = sum(offsets for _, offsets in lists)
    start, rows = 0, len(ends) - 1
    while start < rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
        yield [(flat[at[start] : at[stop]], at[start : stop + 1] - at[start]) for flat, at in lists]
        start = stop


def scored(
    df: DataFrame, kept: list[str], features: list[str], added: str, score: Callable[[list[Lists]], list[np.ndarray]]
) -> DataFrame:
    """``kept`` columns with what ``score`` has for each row; it gets (flat hashes, offsets) of each feature."""
    rows = df.select(*[quoted(c) for c in kept], *features)
    head = ", ".join(f"{quoted(n)} {t}" for n, t in rows.dtypes[: len(kept)])
    schema = f"{head}, {added}" if head else added

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = [_lists(c) for c in batch.columns[len(kept) :]]
        parts = [score(part) for part in slices(lists, SLICE)] or [score(lists)]
        new = [pa.array(np.concatenate(v)) for v in zip(*parts)]
        names = [*batch.schema.names[: len(kept)], *[a.split()[0] for a in added.split(", ")]]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *new], names=names)

    return rows.mapInArrow(lambda batches: map(of, batches), schema)
