from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from cutpoint.llm import mixing
from cutpoint.llm.mixing import correct


def brute_targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, open_names, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_names:
        level = total / sum(weight[s] for s in open_names)
        over = {s for s in open_names if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_names}
        for s in over:
            target[s] = 2.0 * sizes[s]
            total -= target[s]
        open_names -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(llm_spark, seed):
    rng = random.Random(seed)
    names = [None, "a", "b", "Z", "é", "src1", "src10"][: rng.randint(1, 7)]
    rows = [(n, rng.randrange(0, 4000)) for n in names for _ in range(3)]
    sizes = defaultdict(int)
    for n, s in rows:
        sizes[n] += s
    got = {r["source"]: r["target"] for r in mixing.targets(llm_spark.createDataFrame(rows, "source string, size long")).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_flight_keeps_totals():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 500) for _ in range(400)]
    state = mixing.flight(sizes, [0.3] * 400, random.Random(2), last=False)
    assert sum(0 < s < 1 for s in state) <= 2
    assert sum(state) == pytest.approx(120)
    assert sum(s * n for s, n in zip(state, sizes)) == pytest.approx(0.3 * sum(sizes))
    landed = mixing.flight(sizes, [0.3] * 400, random.Random(2), last=True)
    assert set(landed) <= {0.0, 1.0}


@pytest.mark.parametrize("block", [40, 4096])
def test_mixture_is_near_its_targets_and_repeats(llm_spark, block, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(0, 60), rng.choice(["a", "a", "b", "c", None])) for i in range(600)]
    df = llm_spark.createDataFrame(rows, "doc_id long, text string, source string")
    units = df.selectExpr("doc_id", "source", f"{mixing.n_words('text')} AS size", "0.7D AS rate")
    sampled = mixing.sample(units, block=block).collect()
    for name in {r[2] for r in rows}:
        own = [r for r in sampled if r["source"] == name]
        wanted = 0.7 * sum(r["size"] for r in own)
        assert abs(sum(r["size"] * r["copies"] for r in own) - wanted) <= 60
        assert abs(sum(r["copies"] for r in own) - 0.7 * len(own)) <= 8
    one, two = (sorted(mixing.mix(df).collect(), key=str) for _ in range(2))
    assert one == two
    for r in one:
        assert 0 <= r["copies"] <= 2


def test_odd_rows(odd, odd_rows, empty):
    got = mixing.mix(odd).collect()
    assert len(got) == len(odd_rows)
    assert sorted(r["size"] for r in got) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in odd_rows)
    pairs = {(r["doc_id"], r["source"], r["copies"]) for r in got}
    assert len(pairs) == len({(r["doc_id"], r["source"]) for r in got})  # equal keys are taken equally
    copies = sum(r["copies"] for r in got)
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns and mixed.count() == copies
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_a_key_may_hold_most_of_a_source(llm_spark):
    """A third of the rows has no key; one key holds copies of one text: both are sampled row by row."""
    rng = random.Random(11)
    text = lambda: "w " * rng.randrange(1, 60)
    rows = [(None, text(), "a", str(i)) for i in range(301)] + [(7, "x " * 40, "b", str(i)) for i in range(301)]
    rows += [(1000 + i, text(), rng.choice(["a", "b"]), str(i)) for i in range(300)]
    df = llm_spark.createDataFrame(rows, "doc_id long, text string, source string, other string").repartition(5)
    options = {"weights": (1, 1), "total": 1.4}  # both sources between once and twice
    got = mixing.mix(df, **options).collect()
    assert len(got) == len(rows)
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(k), len(t.split())) for k, t, *_ in rows)
    words = defaultdict(int)
    for r in got:
        words[r["source"]] += r["size"] * r["copies"]
        assert int(r["target"] / r["source_size"]) <= r["copies"] <= -(-r["target"] // r["source_size"])
    for name, target in {r["source"]: r["target"] for r in got}.items():
        assert abs(words[name] - target) <= 60, name
    assert {r["copies"] for r in got if r["doc_id"] == 7} == {1, 2}
    copies = defaultdict(int)
    for r in mixing.mixed(df, **options).collect():
        copies[tuple(r)] += 1
    of_kind, of_rows = defaultdict(list), defaultdict(list)
    for r in got:
        of_kind[r["doc_id"], r["source"], r["size"]].append(r["copies"])
    for r in rows:
        of_rows[r[0], r[2], len(r[1].split())].append(copies[r])
    assert {k: sorted(v) for k, v in of_kind.items()} == {k: sorted(v) for k, v in of_rows.items()}


def test_correct_turns_pairs_where_no_single_text_helps():
    size, chance = [1403, 1121, 2000], [0.5, 0.5, 0.5]
    state = [0.0, 1.0, 1.0]
    over = sum(s * (t - p) for s, t, p in zip(size, state, chance))
    assert over == 859
    correct(size, chance, state)
    left = abs(sum(s * (t - p) for s, t, p in zip(size, state, chance)))
    assert left == min(
        abs(sum(s * (t - p) for s, t, p in zip(size, (a, b, c), chance))) for a in (0, 1) for b in (0, 1) for c in (0, 1)
    )
    swapped = [0.0, 1.0]
    correct([1403, 1121], [0.9, 0.1], swapped)
    assert swapped == [1.0, 0.0]


def test_correct_is_no_worse_than_any_turn_of_one_or_two():
    draw = random.Random(5)
    for _ in range(200):
        size = [draw.randrange(0, 60) for _ in range(draw.randrange(0, 9))]
        chance = [draw.choice([0.0, 0.25, 0.5, 0.75, 1.0]) for _ in size]
        state = [p if p in (0, 1) else float(draw.random() < p) for p in chance]

        def over(turned=()):
            return abs(sum(s * ((1 - t if i in turned else t) - p) for i, (s, t, p) in enumerate(zip(size, state, chance))))

        free = [i for i, p in enumerate(chance) if 0 < p < 1]
        best = min([over(), *[over((i, j)) for i in free for j in free]])
        settled = list(state)
        correct(size, chance, settled)
        assert all(settled[i] == p for i, p in enumerate(chance) if p in (0, 1))
        assert set(settled) <= {0.0, 1.0}
        state = settled
        assert over() < best + 0.5
