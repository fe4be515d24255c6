"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL updates.

A text is read twice: as its words in lower case, and as their shapes (runs of capitals, small letters and
digits each shortened to one character), which lets the model judge words it never met. Features are the
single items and the pairs of neighbours of both readings, and marks for a word that follows itself. A
feature's value is its share of the text, so a score is the mean of the weights met: a sparse dot product.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cutpoint.llm.near_copies import mixed
from cutpoint.llm.quality_rules import sample_labelled
from cutpoint.llm.sparse_models import WIDTH, Leader, Rates, dense, row_sums, scored, train_shards
from cutpoint.llm.texts import quoted, whole, without, word_hashes

RATES = Rates(alpha=0.5, beta=1.0, l1=0.5, l2=0.1)
#: Scale of a feature's share of its text.
SCALE = 20.0
EPOCHS = 2
BIAS = -1


def _shapes(text: Column) -> Column:
    for pattern, sign in ((r"\p{Lu}{2,}", "AA"), (r"\p{Ll}+", "a"), (r"\p{N}+", "0")):
        text = F.regexp_replace(text, pattern, sign)
    return text


def readings(text: Column) -> list[Column]:
    return [word_hashes(F.lower(text)).alias("words"), word_hashes(_shapes(text)).alias("shapes")]


def _indices(flat: np.ndarray, offsets: np.ndarray, salt: int) -> np.ndarray:
    """Two features for each item: itself, and with the item before it (or none) in the same text."""
    before = np.concatenate((flat[:1], flat[:-1]))
    before[offsets[:-1][offsets[:-1] < len(flat)]] = np.uint64(0)
    again = flat == before
    pairs = np.where(again & bool(salt == 1), np.uint64(1), before * np.uint64(0x9E3779B97F4A7C15) + flat)
    both = np.stack((mixed(flat + np.uint64(salt)), mixed(pairs + np.uint64(salt + 16))), axis=1)
    return (both & np.uint64(WIDTH - 1)).astype(np.int64)


def _read(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, values = [], []
    for salt, flat in enumerate(parts, 1):
        if len(flat):
            at = _indices(flat, np.array([0, len(flat)]), salt).ravel()
            found.append(at)
            values.append(np.full(len(at), SCALE / len(flat)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    at, place = np.unique(np.concatenate(found), return_inverse=True)
    return at, np.bincount(place, np.concatenate(values))


def _fit(examples: list) -> dict[int, float]:
    leader, bias = Leader(WIDTH, RATES), Leader(1, Rates(0.1, 1.0, 0.0, 0.0))
    one = np.zeros(1, np.int64)
    for _ in range(EPOCHS):
        for at, values, label in examples:
            w, b = leader.weights(at), bias.weights(one)
            error = 1 / (1 + np.exp(-np.clip(w @ values + b[0], -30, 30))) - (label > 0)
            leader.learn(at, error * values, w)
            bias.learn(one, np.array([error]), b)
    weights = leader.weights(slice(None))
    found = {int(i): float(weights[i]) for i in np.flatnonzero(weights)}
    return found | {BIAS: float(bias.weights(one)[0])}


def train(
    df: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality", text: str = "text", max_rows: int = 20_000
) -> dict[int, float]:
    """Weights learnt from about ``max_rows`` labelled texts at most; none at all score every text 0.5."""
    sample = sample_labelled(df, labels, key=key, label=label, text=text, max_rows=max_rows)
    rows = sample.select("key", "label", *readings(whole("text")))
    return train_shards(rows, ["words", "shapes"], _read, _fit)


def score(df: DataFrame, weights: dict[int, float], text: str = "text", *, keep: list[str] | None = None) -> DataFrame:
    """Add ``score`` (0 to 1, higher: label 1 likelier). Null and empty texts get the score of no features."""
    kept = [c for c in (keep or df.columns)]
    kept = without(df.select(*[quoted(c) for c in kept]), "score").columns
    model, bias = dense(weights), weights.get(BIAS, 0.0)

    def run(lists: list) -> list[np.ndarray]:
        total = np.full(len(lists[0][1]) - 1, bias)
        for salt, (flat, offsets) in enumerate(lists, 1):
            if len(flat):
                met = model[_indices(flat, offsets, salt)].sum(axis=1)
                total += SCALE * row_sums(met, offsets) / np.maximum(np.diff(offsets), 1)
        return [1 / (1 + np.exp(-np.clip(total, -30, 30)))]

    rows = df.select(*[quoted(c) for c in kept], *readings(whole(quoted(text))))
    return scored(rows, kept, ["words", "shapes"], "score double", run)
