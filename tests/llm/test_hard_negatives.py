from __future__ import annotations

import random

import numpy as np
import pytest

from cutpoint.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, q string, aid string, CELL string"


def brute(rows, every, k=5):
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    if not ok:
        return []
    width = max(len(r[1]) for r in ok)
    q = np.array([[int(np.floor(256 * x)) for x in r[1]] + [0] * (width - len(r[1])) for r in ok], np.int64)
    ids, label = np.array([r[0] for r in ok]), np.array([r[2] for r in ok])
    out = []
    for a in np.flatnonzero(ids % every == 0):
        scores = q @ q[a]
        s = scores.tolist()
        order = [i for i in np.lexsort((ids, -scores)) if i != a]
        for p in [i for i in order if label[i] == label[a]][:k]:
            fit = [i for i in order if label[i] != label[a] and 80 * s[p] <= 100 * s[i] <= 100 * s[p]][:k]
            out += [(ids[a], ids[p], n + 1, ids[i], s[p], s[i]) for n, i in enumerate(fit)]
    return sorted(tuple(map(int, r)) for r in out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", None, "y") for r in rows], SCHEMA)


def test_equals_brute_force(llm_spark, monkeypatch):
    """Clustered and hot vectors, ties, small cells and several rounds."""
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(900):
        c = rng.choice(centres)
        v = [0.5] * 6 if i % 3 == 0 else [x + rng.gauss(0, 0.2) for x in c]
        rows.append((i, v, i % 4 if i % 50 else 99))
    for name, value in (("CELL", 8), ("BLOCK", 16), ("FIRST", 20), ("GROWTH", 4), ("AT_ONCE", 3)):
        monkeypatch.setattr(hn, name, value)
    got = sorted(tuple(r) for r in hn.hard_negatives(frame(llm_spark, rows), every=60).collect())
    assert got == brute(rows, 60)


def test_odd_rows(llm_spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1),
        (0, [1.0, 0.5], 1),
        (1, [1.0, 0.25, 0.1], 1),
        (2, [0.9, 0.5], 2),
        (-100, [], 2),
        (3, [0.9, 0.5], 2),
        (4, None, 2),
        (5, [None, 1.0], 2),
        (6, [nan, 1.0], 2),
        (7, [inf, 1.0], 2),
        (None, [0.9, 0.5], 2),
        (8, [0.9, 0.5], None),
        (200, [-1.0, -1.0], 3),
        (9, [1.0, 1.0], 3),
        (300, [1e6, 1e6], 4),
        (301, [1e6, 1e6 - 1], 4),
        (302, [1e6, 1e6 - 2], 5),
    ]
    got = sorted(tuple(r) for r in hn.hard_negatives(frame(llm_spark, rows)).collect())
    assert got == brute(rows, 100) and got


def test_no_rows(llm_spark):
    empty = hn.hard_negatives(frame(llm_spark, []))
    assert empty.count() == 0 and empty.columns[0] == "anchor_id"
    assert hn.hard_negatives(frame(llm_spark, [(0, [1.0], 1)])).count() == 0


def test_heap_order_is_that_of_the_bounds():
    rng = np.random.default_rng(2)
    cells = hn.Cells([rng.normal(size=(7, 3)), rng.normal(size=(5, 2))], 100)
    cells.count[:] = 1
    cells.radius[:] = rng.random((2, 7, 5))
    q = rng.normal(size=5)
    out: list[int] = []
    assert not cells.walk(q, None, hn.NONE + 1, -hn.NONE - 1, 0, 1000, out)
    u = cells.words[0] @ q[:3] + np.linalg.norm(q[:3]) * cells.radius[0].max(axis=1)
    v = cells.words[1] @ q[3:] + np.linalg.norm(q[3:]) * cells.radius[1].max(axis=0)
    bound = (u[:, None] + v[None, :]).ravel()[out]
    assert sorted(out) == list(range(35)) and (np.diff(bound) <= 1e-9).all()
    parts: list[int] = []
    for begin, end in ((0, 10), (10, 25), (25, 100)):
        more = cells.walk(q, None, hn.NONE + 1, -hn.NONE - 1, begin, end, parts)
        assert more == (end < 35)
    assert parts == out


@pytest.mark.parametrize("every", [100])
def test_query_equals_its_sql(llm_spark, every):
    import duckdb

    from cutpoint.llm.oracles import ORACLES
    from cutpoint.llm.queries import op13_hard_negatives

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = db.execute(ORACLES["op13_hard_negatives"]).fetchall()
    got = op13_hard_negatives(llm_spark, folder).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
