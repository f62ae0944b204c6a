"""The quality network against plain Python: values, gradients, whole texts, training and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import quality, queries

DOCS = "doc_id long, text string"


def data(text):
    return np.frombuffer(text.encode(), dtype=np.uint8)


def plain(net, text):
    """The probability of one text by loops over its own bytes."""
    w, raw = net.weights, list(text.encode())
    n = -(-(len(raw) + quality.WIDTH) // quality.BLOCK)
    raw += [0] * (n * quality.BLOCK + quality.WIDTH - len(raw))
    places = lambda block: range(block * quality.BLOCK, (block + 1) * quality.BLOCK, quality.STEP)
    value = lambda at, f: sum(float(w["bytes"][raw[at + j]] @ w["filters"][j, :, f]) for j in range(quality.WIDTH))
    blocks = [[max(value(at, f) for at in places(b)) for f in range(quality.FILTERS)] for b in range(n)]
    chunks = [np.maximum(blocks[b], blocks[min(b + 1, n - 1)]) for b in range(max(n - 1, 1))]
    hidden = [np.maximum(np.maximum(c + w["filters0"], 0) @ w["hidden"] + w["hidden0"], 0) for c in chunks]
    return 1 / (1 + np.exp(-(np.max(hidden, axis=0) @ w["out"] + w["out0"][0])))


TEXTS = ["", "a", "plain words here", "é" * 70, "x" * 119, "y" * 120, "z" * 121, "z" * 128, "one two " * 40, "*** $$$ " * 50 + "end"]


def test_scores_equal_loops_and_do_not_depend_on_neighbours():
    net = quality.fresh(3)
    tables = net.tables()
    want = [plain(net, t) for t in TEXTS]
    together = quality.forward(net, tables, quality.Laid([data(t) for t in TEXTS]))["p"]
    assert together == pytest.approx(want, rel=1e-4)
    for t, p in zip(TEXTS, together, strict=True):
        assert quality.forward(net, tables, quality.Laid([data(t)]))["p"][0] == pytest.approx(p, rel=1e-6)


def test_every_byte_of_a_long_text_is_seen():
    net = quality.fresh(3)
    net.weights["bytes"][:] = 0.01
    net.weights["bytes"][ord("!")] = 9.0
    score = lambda t: quality.forward(net, net.tables(), quality.Laid([data(t)]))["p"][0]
    text = "a" * 3000
    assert len({round(score(text[:k] + "!!!!" + text[k:]), 9) != round(score(text), 9) for k in (0, 1, 126, 127, 128, 1499, 2999, 3000)}) == 1


def test_gradients_are_those_of_the_loss():
    net = quality.fresh(5)
    laid, labels, weights = quality.Laid([data(t) for t in TEXTS]), np.array([1.0, 0, 1, 0, 1, 0, 1, 0, 1, 0]), np.linspace(0.5, 2, 10)

    def loss():
        p = quality.forward(net, net.tables(), laid)["p"]
        return -(weights * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum() / weights.sum()

    found = quality.gradients(net, laid, labels, weights)
    rng = random.Random(2)
    for name, g in found.items():
        flat, own = g.ravel(), net.weights[name].reshape(-1)
        for i in rng.sample(sorted(np.argsort(-np.abs(flat))[:20]), min(4, len(flat))):
            was, step = own[i], 1e-3
            own[i] = was + step
            up = loss()
            own[i] = was - step
            down = loss()
            own[i] = was
            assert flat[i] == pytest.approx((up - down) / (2 * step), rel=0.08, abs=2e-4), name


def made(n, seed):
    rng = random.Random(seed)
    words = ["river", "house", "garden", "letter", "winter", "window", "under", "of", "the", "and"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(3, 150)))
        if i % 3 == 0:
            text = text.replace(" ", "$$ ") if i % 2 else text.upper()
        rows.append((i, text, int(i % 3 != 0)))
    return rows


def test_it_learns_and_scores_odd_rows(spark):
    rows = made(600, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, None), (None, "the river")], DOCS)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(9001, 1), (None, 0), (5, None), (6, 7)], "doc_id long, quality int")
    net = quality.train(docs, labels, rounds=4)
    test = made(200, 2)
    long = " ".join(t for i, t, q in made(9000, 3) if q)
    table = spark.createDataFrame([(i, t, "kept", 5) for i, t, _ in test] + [(-1, None, None, None), (-2, "", "x", 1), (-3, long, "x", 1), (-4, long + "$$ ".join(long[:400].split(" ")), "x", 1), (0, test[0][1], "again", 0)], DOCS + ", kept string, score int")
    got = quality.score(table, net)
    assert got.columns == ["doc_id", "text", "kept", "score"]
    found = [(r.doc_id, r.score) for r in got.collect()]
    score = dict(found)
    assert len(found) == 205 and all(0 <= s <= 1 for _, s in found) and [s for i, s in found if i == 0][0] == pytest.approx([s for i, s in found if i == 0][1])
    assert sum((score[i] >= 0.5) == q for i, _, q in test) >= 190
    assert score[-1] == score[-2] and score[-4] < score[-3] and score[-3] >= 0.5
    kept = quality.drop_low_quality(table, net)
    assert kept.columns == table.columns and {r.doc_id for r in kept.where("doc_id >= 0").collect()} == {i for i, s in found if i >= 0 and s >= 0.5}
    assert kept.where("doc_id = -3").first().score == 1
    again = quality.train(docs, labels, rounds=4)
    assert all(np.array_equal(net.weights[k], again.weights[k]) for k in net.weights)


def test_without_labels_of_both_classes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], DOCS)
    net = quality.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert {r.score for r in quality.score(docs, net).collect()} == {2 / 3}
    net = quality.train(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score(docs.limit(0), net).count() == 0 and net.base == 0.5


def test_held_out_quality_of_the_query(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.op11_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").groupBy("quality").agg(F.avg("predicted").alias("p")).collect()
    shares = {r.quality: r.p for r in found}
    assert shares[1] > 0.95 and shares[0] < 0.5
