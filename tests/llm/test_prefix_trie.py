from __future__ import annotations

import hashlib
import random
import zlib

from cutpoint.llm import prefix_trie as trie
from cutpoint.llm.queries import op11_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, owner string, DEPTH string, a string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own: dict[int, list] = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            body = text or ""
            order = (turn is not None, turn or 0, role or "", hashlib.md5(body.encode()).hexdigest())
            own.setdefault(conv, []).append((order, (role or "", body)))
    own = {c: [t for _, t in sorted(turns, key=lambda x: x[0])] for c, turns in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c - 5 * int(c / 5))
        full[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members: dict[tuple, list] = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    saved = {p: (len(m) - 1) * (len(p[-1][1].encode()) if p else 0) for p, m in members.items()}
    children: dict[tuple, int] = {p: 0 for p in members}
    leaves, total = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            total[p[:d]] += saved[p]
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if full[c] == p)))
        up = min(members[p[:-1]]) if p else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(m), len(p), up, len(m), children[p], leaves[p], total[p], digest))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", None, "y") for r in rows], SCHEMA)


def test_equals_brute_force(llm_spark, monkeypatch):
    """Shared and repeated conversations, one very long, nulls, ties, repeated rows, absent bases, small stretches."""
    monkeypatch.setattr(trie, "STRETCH", 4)
    rng = random.Random(11)
    rows = [(c, t, rng.choice("ua"), rng.choice(["", "x", "yé", "same"])) for c in range(-7, 60) for t in range(rng.randint(1, 7))]
    rows += [(c, t, "u", f"deep {t}") for c in (100, 101, 103, 104, 200) for t in range(40 if c != 103 else 23)]
    rows += [(105, t, "u", "deep 5" if t == 30 else f"deep {t}") for t in range(60)]
    rows += [(300, None, None, None), (300, None, "u", "b"), (300, None, "u", "b"), (300, 2, "a", None), (300, 2, "a", "t")]
    rows += [(401, 0, "u", "no base"), (402, 0, "u", "no base"), (None, 1, "u", "nobody"), (403, 1, None, "no base" * 20_000)]
    rows += [(1000 + i, t, "u", f"copy {t}") for i in range(60) for t in range(3)]
    assert found(trie.prefix_trie(frame(llm_spark, rows))) == brute(rows)


def test_no_rows(llm_spark):
    got = trie.prefix_trie(frame(llm_spark, []))
    assert got.columns[: len(COLUMNS)] == COLUMNS and got.count() == 0


def test_two_fattest_numbers(llm_spark):
    cases = [(low, high) for low in range(0, 40) for high in range(low + 1, 41)]
    df = llm_spark.createDataFrame(cases, "low long, high long").selectExpr("low", "high", f"{trie._fattest('low', 'high')} AS f")
    for low, high, f in df.collect():
        assert f == max(range(low + 1, high + 1), key=lambda n: n & -n)


def test_query_equals_its_sql(llm_spark):
    import duckdb

    from cutpoint.llm.oracles import ORACLES

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    want = db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op11_prefix_trie']})").fetchall()
    assert found(op11_prefix_trie(llm_spark, folder)) == sorted(want, key=repr)
