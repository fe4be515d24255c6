from __future__ import annotations

import random
import re
from collections import Counter

from cutpoint.llm import quality_model, quality_rules, toxicity
from cutpoint.llm.quality_rules import Condition, DecisionList

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def brute(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def texts():
    rng = random.Random(11)
    out = [None, "", " \n\x0b", "a b c a b c", "a a a a", "a a a", "x\n\nx\n y\nx", "##% é|é <b> $1\r\n$1", "a b c d a b c"]
    out += [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(60)]
    return out + ["\n".join(rng.choice(["one two", "three", ""]) for _ in range(30)), "be " * 20_000]


def test_statistics(llm_spark):
    df = llm_spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    got = {r["doc_id"]: r["stats"] for r in quality_rules.statistics(df).collect()}
    for i, text in enumerate(texts()):
        assert tuple(got[i][c] for c in quality_rules.COUNTS) == brute(text), repr(text)[:60]


def corpus(llm_spark, n=600):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        good = i % 4 > 0
        body = [word() for _ in range(rng.randint(60, 200))]
        if not good:
            body = [w + "***" for w in body] if i % 8 else [w.upper() + "!!" for w in body]
        toxic = good and i % 5 == 0
        if toxic:
            for w in rng.sample(["vileone", "vilexy", "vileabc", "badnoun"], 2):
                body.insert(rng.randrange(len(body)), w)
        rows.append((i, " ".join(body)))
        labels.append((i, int(good), int(toxic)))
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string")
    return docs, llm_spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_rules_are_learnt_and_applied_in_order(llm_spark):
    docs, labels, rows = corpus(llm_spark)
    rules = quality_rules.learn(docs, labels)
    assert rules.rules
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, rules).where("kept IS NOT NULL").collect()}
    good = {i for i, q, _ in rows if q}
    assert all(got[i]["kept"] for i in good)
    assert sum(not got[i]["kept"] for i in got if i not in good) >= 0.9 * (len(rows) - len(good))
    # Brute force: the conditions, evaluated in Python on the statistics.
    for r in got.values():
        values = {n: eval(e, {}, {**r["stats"].asDict()}) if r["stats"]["n_words"] else 0 for n, e in quality_rules.SHARES.items()}
        covered = any(all((values[c.statistic] > c.threshold) == c.above for c in rule) for rule in rules.rules)
        assert r["kept"] == (not covered and not r["base_failed"])


def test_rules_filter_in_a_plan(llm_spark, odd, empty, labels):
    rule = DecisionList(((Condition("capital_share", True, 0.5), Condition("words", False, 1e9)),))
    judged = quality_rules.judge(odd, rule)
    assert judged.where("kept").count() == 2  # the long texts
    assert judged.where("base_failed").count() == 6
    assert [c for c in judged.columns if c.lower() in ("stats", "kept")] == ["stats", "kept"]
    assert quality_rules.judge(empty, rule).count() == 0
    assert quality_rules.learn(empty, labels).rules == ()
    assert quality_rules.learn(odd, labels.limit(0)).rules == ()


def test_quality_model(llm_spark):
    docs, labels, rows = corpus(llm_spark)
    weights = quality_model.train(docs, labels.where("doc_id % 3 > 0"))
    got = {r["doc_id"]: r["score"] for r in quality_model.score(docs, weights).collect()}
    held = [(got[i], q) for i, q, _ in rows if i % 3 == 0]
    assert sum((s >= 0.3) == bool(q) for s, q in held) >= 0.97 * len(held)


def test_toxicity(llm_spark):
    docs, labels, rows = corpus(llm_spark, 1500)
    weights = toxicity.train(docs, labels.where("doc_id % 3 > 0"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, weights).collect()}
    held = [(got[i], t) for i, _, t in rows if i % 3 == 0]
    assert sum((r["p_toxic"] >= 0.5) == bool(t) for r, t in held) >= 0.97 * len(held)
    assert all(r["p_toxic"] - 1e-9 <= r["severity"] <= toxicity.GRADES for r, _ in held)


def test_models_on_odd_rows(odd, odd_rows, empty, labels):
    for model, column in ((quality_model, "score"), (toxicity, "severity")):
        for given in (labels, labels.limit(0)):
            weights = model.train(odd, given)
            got = model.score(odd, weights).collect()
            assert len(got) == len(odd_rows) and all(0 <= r[column] <= 2 for r in got)
            assert len({r[column] for r in got if r["text"] in (None, "")}) == 1
        assert model.score(empty, weights).count() == 0
    assert quality_model.score(odd, {}).first()["score"] == 0.5
