"""Kneser-Ney probabilities against dictionaries, groups of languages, rejection, and odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tessella.llm import langid

TRAIN = "lang string, text string"


def brute_model(words, order):
    """Interpolated Kneser-Ney over counted words, by dictionaries of tuples."""
    raw = [Counter() for _ in range(order + 1)]
    for word, n in words.items():
        line = ["^"] * (order - 1) + list(word) + ["$"]
        for at in range(order - 1, len(line)):
            for size in range(1, order + 1):
                raw[size][tuple(line[at - size + 1 : at + 1])] += n
    counts = [None] * (order + 1)
    for size in range(1, order + 1):
        if size == order:
            counts[size] = dict(raw[size])
        else:
            kinds = Counter(gram[1:] for gram in raw[size + 1])
            counts[size] = {gram: kinds.get(gram, 1) for gram in raw[size]}
    total, followers, discount = Counter(), Counter(), {}
    for size in range(1, order + 1):
        values = list(counts[size].values())
        once, twice = values.count(1), values.count(2)
        discount[size] = min(0.95, max(0.1, once / max(once + 2 * twice, 1)))
        for gram, n in counts[size].items():
            total[gram[:-1], size] += n
            followers[gram[:-1], size] += 1

    def p(gram):
        if not gram:
            return 1 / 65536
        size, context = len(gram), gram[:-1]
        if not total[context, size]:
            return p(gram[1:])
        d = discount[size]
        return max(counts[size].get(gram, 0) - d, 0) / total[context, size] * (gram in counts[size]) + d * followers[context, size] / total[context, size] * p(gram[1:])

    return p


def brute_cost(p, word, order):
    line = ["^"] * (order - 1) + list(word) + ["$"]
    return -sum(math.log(p(tuple(line[at - order + 1 : at + 1]))) for at in range(order - 1, len(line)))


@pytest.mark.parametrize(("order", "model_bytes"), [(4, langid.MODEL_BYTES), (4, 2_000), (2, 500)])
def test_probabilities_equal_dictionaries(spark, monkeypatch, order, model_bytes):
    monkeypatch.setattr(langid, "SCORED_CHARS", 16)  # longer words are cut, with their context
    texts = [("x", "abab abab abac"), ("x", "cab " + "ab" * 40), ("y", "zzzz zz été"), (None, "q"), ("x", None), ("y", "")]
    model = langid.train(spark.createDataFrame(texts, TRAIN), order=order, model_bytes=model_bytes)
    assert model.languages == ["x", "y"] and len(model.groups) == (1 if model_bytes > 10**6 else 2)
    asked = ["abab", "zzzz", "aba", "q", "cabz", "ab" * 40, "zababé"]
    cost, length = model.score(asked)
    assert length.tolist() == [len(w) + 1 for w in asked]
    for k, lang in enumerate(model.languages):
        words = Counter(w for x, t in texts if x == lang for w in (t or "").split())
        p = brute_model(words, order)
        assert np.allclose(cost[:, k], [brute_cost(p, w, order) for w in asked], rtol=1e-5)


def test_groups_of_languages_judge_alike(spark):
    rng = random.Random(3)
    letters = {"a": "abcdef", "b": "defghi", "c": "mnopqr"}
    text = lambda x, n: " ".join("".join(rng.choice(letters[x]) for _ in range(rng.randint(2, 7))) for _ in range(n))
    docs = spark.createDataFrame([(x, text(x, 30)) for x in letters for _ in range(20)], TRAIN)
    asked = spark.createDataFrame([(i, text(x, 12), x) for i, x in enumerate("abcabc")] + [(9, None, ""), (10, "12 ", ""), (0, "12", "")], "doc_id long, text string, score string")
    one = langid.train(docs)
    parts = langid.train(docs, model_bytes=60_000)
    assert len(one.groups) == 1 and len(parts.groups) > 1
    rows = lambda m: sorted((r.doc_id, r.lang_pred, round(r.score, 5), r.rejected) for r in langid.identify(asked, m).collect())
    assert rows(one) == rows(parts)
    assert [r[1] for r in rows(one) if 0 < r[0] < 6] == list("bcabc")
    assert langid.identify(asked.limit(0), one).count() == 0


@pytest.mark.parametrize(("order", "most"), [(4, 3000), (3, 500), (2, 60)])
def test_a_large_language_comes_in_parts_that_add_up(spark, order, most):
    rng = random.Random(5)
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n))
    texts = [("x", text("abcdefghé", 200)) for _ in range(10)] + [("y", text("mnop", 5)), ("z", "q")]
    docs = spark.createDataFrame(texts, TRAIN)
    whole, parts = langid.train(docs, order=order), langid.train(docs, order=order, model_bytes=24 * most)
    large = [g for g in parts.groups if g.languages == ["x"]]
    assert len(whole.groups) == 1 and 1 < len(large) < 10 and sorted(parts.languages) == whole.languages
    count = lambda model: sum(len(k) for k in model.keys)
    assert sum(count(g.load()) for g in large) >= count(langid.Group(["x"], whole.groups[0].rows.where("lang = 'x'"), order).load())
    asked = ["abcd", "a", "zzzz", "éé", "mnop", "q", "abqé", "abcdefgh" * 20]
    (cost, length), (again, as_long) = whole.score(asked), parts.score(asked)
    order_of = [parts.languages.index(x) for x in whole.languages]
    assert np.allclose(cost, again[:, order_of], rtol=1e-5) and length.tolist() == as_long.tolist() == [len(w) + 1 for w in asked]
    assert np.allclose(whole.mean, parts.mean[order_of], rtol=1e-4) and np.allclose(whole.spread, parts.spread[order_of], rtol=1e-3) and whole.half == parts.half
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)] + [(90, None), (91, ""), (92, "1 2"), (93, "abc mnop q 你好")], "doc_id long, text string")
    found = lambda m: sorted((r.doc_id, r.lang_pred, round(r.score, 4), r.rejected) for r in langid.identify(rows, m).collect())
    assert found(whole) == found(parts)


def test_rejection_lowers_the_score(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    odd = spark.createDataFrame([(1, "東京都は日本の首都です 京都も古い都です"), (2, docs.where("lang = 'en'").first().text)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert got[1].rejected and got[1].score < 0.5 and not got[2].rejected and got[2].score > 0.9


def test_words_have_no_bound():
    assert [len(w) for w in langid.words_in(("a" * 1000 + "́b").encode())] == [1002]
    assert langid.words_in("你好，abc".encode()) == ["你好", "abc"]


def test_all_labelled_texts_calibrate(spark):
    """Limits are those of every text, also where there are more than 20,000."""
    n = 24_000
    rows = [("xy"[i % 2], "".join(("abcdefghij" if i % 2 else "klmnopqrst")[int(d)] for d in str(i * 7919))) for i in range(n)]
    docs = spark.createDataFrame(rows, TRAIN).repartition(8)
    model = langid.train(docs)
    cost, length = model.score([word for _, word in rows])
    for k, lang in enumerate(model.languages):
        rate = np.array([c[k] / m for c, m, (x, _) in zip(cost, length, rows, strict=True) if x == lang])
        misfit = (rate - model.mean[k]) / model.spread[k]
        assert model.limit[k] == pytest.approx(misfit.mean() + langid.REJECT * max(misfit.std(), 1), rel=1e-9)


def test_one_pass_judges_like_two(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "12", "en"), (-3, "abc", None), (-4, "你好", "en")], docs.schema)
    docs, learned = docs.unionByName(odd), langid.F.col("doc_id") % 3 != 1
    rows = lambda df: sorted((r.doc_id, r.lang_pred, round(r.score, 9), r.rejected) for r in df.collect())
    for size in (langid.MODEL_BYTES, 400_000):
        one = langid.learn_and_identify(docs, learned, model_bytes=size)
        assert one.columns == ["doc_id", "lang", "lang_pred", "score", "cross_entropy", "rejected"]
        assert rows(one) == rows(langid.identify(docs, langid.train(docs.where(learned), model_bytes=size)))
    nothing = langid.learn_and_identify(docs, langid.F.lit(False))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
