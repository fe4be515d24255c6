from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from cutpoint.llm import near_copies, repeats
from cutpoint.llm.components import components
from cutpoint.llm.induced_sorting import suffix_array


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def shingles(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(texts):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both, union = sum((sets[i] & sets[j]).values()), sum((sets[i] | sets[j]).values())
            if (texts[i] or "") == (texts[j] or "") or (union and both >= 0.8 * union):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def partition(keys, labels):
    groups = {}
    for k, x in zip(keys, labels):
        groups.setdefault(x, set()).add(k)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("block", [near_copies.BLOCK, 300])
def test_classes_are_those_of_all_pairs(llm_spark, block, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = random.Random(9)
    texts = [None, "", " ", "one two", "one two", "be be be be be be be"]
    base = words(rng, 120)
    for i in range(60):  # copies of one text, few to many changes: chains and doubtful pairs
        copy = list(base)
        for at in rng.sample(range(120), i % 9):
            copy[at] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += [" ".join(words(rng, 40)) for _ in range(30)]
    df = llm_spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_copies.classes(df, carry=["doc_id"]).select("row.doc_id", "class", "first").collect()
    assert partition([r["doc_id"] for r in got], [r["class"] for r in got]) == partition(range(len(texts)), brute_classes(texts))
    assert sum(r["first"] for r in got) == len({r["class"] for r in got})


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(2)
    a = [rng.randrange(50) for _ in range(400)]
    b = a[:300] + [rng.randrange(50, 90) for _ in range(100)]
    hashes = near_copies.mixed(np.array(a + b, np.uint64))
    text, strip = near_copies.strips(hashes, np.array([400, 400]))
    signs = near_copies.signatures(text, strip, 2, 2000)
    one, two = Counter(map(tuple, zip(a, a[1:], a[2:], a[3:], a[4:]))), Counter(map(tuple, zip(b, b[1:], b[2:], b[3:], b[4:])))
    true = sum((one & two).values()) / sum((one | two).values())
    assert abs((signs[0] == signs[1]).mean() - true) < 0.05


def test_deduplicated(odd, odd_rows, empty):
    got = near_copies.deduplicated(odd)
    assert got.columns == odd.columns
    assert sorted(r["text"] or "" for r in got.collect()) == sorted({r[1] or "" for r in odd_rows})
    assert near_copies.deduplicated(empty).count() == 0


def test_components(llm_spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)]
    got = {r["node"]: r["label"] for r in components(llm_spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges * 100:
        m = min(root.get(a, a), root.get(b, b))
        root[a] = root[b] = m
    assert got == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(300):
        n, k = rng.randint(0, 50), rng.choice([1, 2, 3, 200])
        x = np.array([rng.randrange(k) for _ in range(n)] * rng.choice([1, 3]), np.int64)
        assert suffix_array(x, k).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


def brute_repeats(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + 200] for b in data for p in range(len(b) - 199))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        out.append((bytes(x for x, g in zip(b, gone) if not g), len(bytes(gone).replace(b"\0", b" ").split())))
    return out


@pytest.mark.parametrize("crowd, piece", [(repeats.CROWD, repeats.PIECE), (1, 700)])
def test_repeats(llm_spark, crowd, piece, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rng = random.Random(6)
    text = lambda n: " ".join(words(rng, n))
    passage, other = text(60), text(45)
    texts = [None, "", "short", "ab" * 300, "ab" * 99, "é" * 150, "é" * 99 + "x"]
    texts += [text(30) + passage + text(20), passage[5:], passage[:199], passage[:200], other + text(5) + other, text(200)]
    copy = text(300)
    texts += [copy, copy, copy[:900] + "X" + copy[901:], copy[100:250], passage + copy]
    df = llm_spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, KEPT string")
    got = {r["doc_id"]: r for r in repeats.without_repeats(df, carry=["doc_id", "KEPT"]).collect()}
    for i, (kept, n) in enumerate(brute_repeats(texts)):
        assert (bytes(got[i]["kept"]), len(got[i]["spans"])) == (kept, n), i


def test_pieces_of_long_texts_give_the_same_strings(monkeypatch):
    rng = random.Random(8)
    data = " ".join(words(rng, 2000)).encode()
    whole_text = repeats.stretches(np.frombuffer(data, np.uint8), np.full(len(data), len(data)))
    monkeypatch.setattr(repeats, "PIECE", 1000)
    starts = []
    for part, end, _, offset in repeats._pieces([data]):
        first, last, _, _ = repeats.stretches(part, end)
        starts += [offset[a] + k for a, b in zip(first, last) for k in range(b - a + 1)]
    assert sorted(starts) == list(range(len(data) - 199))
    assert sum(int(b - a + 1) for a, b in zip(*whole_text[:2])) == len(data) - 199


def test_repeats_of_no_rows(empty, odd, odd_rows):
    assert repeats.without_repeats(empty, carry=["doc_id"]).count() == 0
    assert repeats.without_repeats(odd, carry=odd.columns).count() == len(odd_rows)
