"""Log-odds, extreme-value parameters, calibration and scores against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tessella.llm import toxicity

DOCS = "doc_id long, text string"


def names(word):
    return [f"{n}:{word[:n]}" for n in (4, 5, 6) if len(word) > n] + ["w:" + word]


def plain_model(rows):
    """Counts, base, log-odds, scan and calibration as the module's text says, without its functions."""
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    base = n1 / len(rows)
    count = (Counter(), Counter())
    for text, y in rows:
        count[y].update({f for w in text.split() for f in names(w)})
    least = max(2, math.ceil(math.log(0.02) / math.log(base)))
    known = {f for f in count[1] if count[1][f] >= least and count[1][f] / n1 > 4 * count[0][f] / n0}

    def score(word, without=None):
        share = base
        for f in names(word):
            if f in known:
                t, o = count[1][f] - (without == 1), count[0][f] - (without == 0)
                share = (max(t, 0) + 2 * share) / (max(t, 0) + max(o, 0) + 2)
        return math.log(share / (1 - share)) - math.log(base / (1 - base)) - 1

    tokens = [round(score(w, 0), 2) for text, y in rows if not y for w in text.split()]
    low, high = 1e-6, 50
    for _ in range(200):
        rate = (low + high) / 2
        low, high = (rate, high) if sum(math.exp(rate * s) for s in tokens) < len(tokens) else (low, rate)
    scale = sum(math.exp(low * s) for s in tokens if s > 0) / len(tokens)

    def evidence(text, without=None):
        s = [score(w, without) for w in text.split()]
        segments, at = [], 0  # all maximal segments, by the definition: best first, then those beside it
        stack = [(0, len(s))]
        while stack:
            a, b = stack.pop()
            best = max(((sum(s[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0, 0))
            if best[0] > 1e-12:
                segments.append(best[0])
                stack += [(a, best[2]), (best[3], b)]
        if not segments:
            return 0.0
        e = [scale * len(s) * math.exp(-low * x) for x in segments]
        top = min(e)
        return -math.log(-math.expm1(-top)) + sum(-math.log(x) for x in e if x < 0.05 and x > top * (1 + 1e-9))

    return score, low, scale, evidence


def made(n, seed):
    rng = random.Random(seed)
    plain = ["river", "house", "garden", "letter", "winter", "window", "idioma", "stud"]
    bad = ["idiot", "idiotic", "stupid", "stupidly", "moron"]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(3, 12))]
        if i % 5 == 0:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        elif i % 17 == 0:
            words.append("moron")
        rows.append((" ".join(words), int(i % 5 == 0)))
    return rows


def test_model_equals_plain_python(spark):
    rows = made(150, 1)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], DOCS)
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int"))
    score, rate, scale, evidence = plain_model(rows)
    words = sorted({w for t, _ in rows for w in t.split()} | {"unseen", "idiots"})
    assert model.scores([w.encode() for w in words]) == pytest.approx([score(w) for w in words])
    assert score("idiot") > 0 > score("river") == score("unseen") == -1
    assert (model.rate, model.scale) == pytest.approx((rate, scale), rel=1e-6)
    assert sum(math.exp(model.rate * s) for s in (score(w, 0) for t, y in rows if not y for w in t.split())) == pytest.approx(sum(len(t.split()) for t, y in rows if not y), rel=0.02)
    got = [toxicity.evidence(model, [w.encode() for w in t.split()])[0] for t, _ in rows]
    assert got == pytest.approx([evidence(t) for t, _ in rows], rel=1e-6, abs=1e-9)
    # the calibration is where the weighted, slightly pulled likelihood has no slope
    x = np.array([round(math.log1p(evidence(t, y)), 2) for t, y in rows])
    y, n = np.array([y for _, y in rows]), np.array([3.0 if y else 1.0 for _, y in rows])
    p = 1 / (1 + np.exp(-(model.slope * x + model.shift)))
    assert abs((n * (p - y)).sum() + 0.01 * model.shift) < 1e-4 and abs((n * (p - y) * x).sum() + 0.01 * model.slope) < 1e-4
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert [found[i] for i in range(len(rows))] == pytest.approx([1 / (1 + math.exp(-(model.slope * math.log1p(evidence(t)) + model.shift))) for t, _ in rows])


def test_odd_rows_and_names(spark):
    rows = [(i, t, "k") for i, (t, _) in enumerate(made(80, 2))]
    docs = spark.createDataFrame(rows + rows[:3] + [(None, None, "k"), (900, None, "k"), (901, "", "k"), (902, "stupid idiot " * 20_000, "k")], "doc_id long, text string, passages string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(made(80, 2))] + [(0, 1), (None, 1), (900, None), (901, 7), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 87 and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(v) == 1 for v in by.values()) and by[None] == by[900] == by[901] and min(by[902]) > 0.5
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.where("passages = 'k'").count() == kept.count()
    none = docs.limit(0)
    assert toxicity.score(none, model).count() == 0 and not toxicity.train(none, labels).counts
