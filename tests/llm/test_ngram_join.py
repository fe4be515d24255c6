from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from cutpoint.llm import ngram_join as nj
from cutpoint.llm.shingle_sets import WordHashes, shingle_sets

SCHEMA = "doc_id long, text string, rid string, TID string, n string, label string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[max(top(i), top(j))] = min(top(i), top(j))
    keys: dict[int, list] = {}
    for i, (key, _) in enumerate(rows):
        keys.setdefault(top(i), []).append(key)
    least = {r: min((k for k in ks if k is not None), default=None) for r, ks in keys.items()}
    return Counter((rows[i][0], len(sets[i]), least[top(i)]) for i in range(len(rows)))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", None, "y", "z") for r in rows], SCHEMA)


def found(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


@pytest.fixture(scope="module")
def texts():
    """Copies, chains of near copies around the limit, shared passages, odd and repeated rows."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(30)]
    rows = []
    for n in [5, 8, 12, 20, 40, 80, 160, 400]:
        base = [word() for _ in range(n)]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, n // 30) + 1)):
                copy[rng.randrange(n)] = word()
            rows.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy
    for _ in range(60):
        own = [word() for _ in range(rng.randrange(3, 60))]
        rows.append(" ".join(own + passage))
    template = [word() for _ in range(12)]
    rows += [" ".join([*template, word()]) for _ in range(60)]
    rows += ["a b c", "A  B\tC", "a b", "a b c d", "É é x y z", "é É x y z", "", " \n", None, " ".join(word() for _ in range(30_000))]
    keyed = [(i * 7 % 401, t) for i, t in enumerate(rows)]
    return [*keyed, keyed[3], (None, keyed[5][1]), (None, "only null keys here"), (None, "only null keys here"), (-5, keyed[20][1].upper())]


def test_equals_brute_force(llm_spark, texts, monkeypatch):
    for name, value in (("PAGE", 16), ("BOX", 4), ("DENSE", 1), ("COLUMNS", 64)):
        monkeypatch.setattr(nj, name, value)
    assert found(nj.linked(frame(llm_spark, texts))) == brute(texts)


def test_no_rows_and_no_words(llm_spark):
    assert nj.linked(frame(llm_spark, [])).count() == 0
    rows = [(1, None), (2, ""), (3, " ")]
    assert found(nj.linked(frame(llm_spark, rows))) == Counter({(k, 0, k): 1 for k, _ in rows})


def test_words_and_shingles_of_runs(monkeypatch):
    """Blocks of bytes cut neither words nor shingles; equal texts have equal hashes wherever they lie."""
    import cutpoint.llm.shingle_sets as module

    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("aBé☃") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(0, 40))) for _ in range(50)]
    texts += ["", " ", "\x0b\x0c x", "y" * 500, texts[0]]
    monkeypatch.setattr(module, "BYTES", 64)
    runs = list(WordHashes().runs(pa.array(texts)))
    words = [re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER)) for t in texts]
    assert [c for _, _, _, counts in runs for c in counts] == [len(w) for w in words]
    flat = np.concatenate([h for _, _, h, _ in runs]).tolist()
    seen: dict = {}
    for w, h in zip((x for ws in words for x in ws), flat, strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    for begin, end, hashes, counts in runs:
        text, _ = shingle_sets(hashes, counts, 4)
        assert np.bincount(text, minlength=end - begin).tolist() == [len(shingles(t)) for t in texts[begin:end]]


def test_points_bound_what_sets_share():
    rng = np.random.default_rng(1)
    limit = nj.Limit(85)
    for n, m in ((3, 5), (60, 300), (257, 256), (3000, 2000)):
        both = rng.integers(0, 2**63, min(n, m) // 2, dtype=np.uint64)
        sets = [np.unique(np.concatenate((both, rng.integers(0, 2**63, k - len(both), dtype=np.uint64)))) for k in (n, m)]
        p, q = (nj.packed_points(np.zeros(len(s), int), s, np.array([len(s)]))[0].as_py() for s in sets)
        shared = len(np.intersect1d(*sets))
        assert shared <= nj.may_share(p, q) <= np.minimum(*nj.folded([p, q])).sum()
        assert nj.folded([p, q]).sum(axis=1).tolist() == [len(s) for s in sets]
    assert limit.entries(np.array([1, 10, 100])).tolist() == [1, 2, 16]


def test_entries_are_enough(llm_spark):
    """Integer arithmetic of the short entries: what a larger partner can't all miss."""
    limit = nj.Limit(85)
    rows = llm_spark.range(1, 300).selectExpr("id AS n", f"{limit.short_entries('id')} AS short").collect()
    assert all(short == n - -(-2 * 85 * n // 185) + 1 for n, short in rows)
