"""Personal data, languages, contamination, lines and toxicity against brute force."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import decontam, langid, lines, pii, toxicity
from tessella.llm.common import held_out

DOCS = "doc_id long, text string"
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_pii_matches_plain_regular_expressions(spark):
    rng = random.Random(3)
    bits = ["a@b.co", "x.y+z@q-r.s.tt", "@", "1.2.3.4", "300.1.1.1", "0001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-45-67", "+1", " ", "é𝒳", "-", ".", "5", "\n", "a@b.c-_d@e.f", "word"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    texts += [None, "", "7" * 40_000 + "@x.y", "1 " * 3000, " ".join(["+4912345678"] * 600)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = pii.find_spans(df).select("doc_id", pii.joined(F.filter("spans", lambda s: s["rank"] < 4)).alias("b")).collect()
    assert {r.doc_id: r.b for r in got} == {i: base_spans(t) for i, t in enumerate(texts)}


def test_pii_further_kinds_and_redaction(spark):
    df = spark.createDataFrame([(1, "IBAN DE89 3704 0044 0532 0130 00, ssn: 078-05-1120", "k"), (2, "DE88 3704 0044 0532 0130 00 078-05-1120", "k"), (3, None, "k")], "doc_id long, text string, spans string")
    found = {r.doc_id: [s.kind for s in r.spans] for r in pii.find_spans(df).collect()}
    assert found == {1: ["iban", "ssn"], 2: [], 3: []}
    clean = pii.redact(df.drop("spans")).orderBy("doc_id").collect()
    assert clean[0].text == "IBAN " + "*" * 27 + ", ssn: " + "*" * 11 and clean[2].text is None


def test_pii_empty_table(spark):
    assert pii.find_spans(spark.createDataFrame([], DOCS)).count() == 0


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = held_out(F.col("doc_id"), 3, 1)
    model = langid.train(docs.where(~out))
    got = langid.identify(docs.where(out).select("doc_id", "text", "lang"), model)
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !! ½ Ⅷ ²"), (4, "¿§…"), (5, "the of and " * 5000)], DOCS)
    rows = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [rows[i].lang_pred for i in range(1, 6)] == ["und", "und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in rows.values())
    long = spark.createDataFrame([(1, "漢字" * 40_000), (2, " ".join(f"the{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}of" for i in range(3000))), (3, None)], DOCS)
    wide = {r.doc_id: (r.lang_pred, round(r.cross_entropy or 0, 6)) for r in langid.identify(long, model).collect()}
    assert wide == {r.doc_id: (r.lang_pred, round(r.cross_entropy or 0, 6)) for r in langid.identify(long, model, cache=50).collect()}


def test_language_without_training_rows(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert langid.identify(spark.createDataFrame([(1, "abc")], DOCS), langid.train(none)).first().lang_pred == "und"


def words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_hits(text, items, width=13):
    own, hit, of = words(text), set(), set()
    for item, t in items:
        w = words(t)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            for j in range(len(own) - n + 1):
                if own[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    of.add(str(item))
    return len(own), len(hit), sorted(of)


@pytest.mark.parametrize("block_chars", [10**6, 60])
def test_contamination_matches_brute_force(spark, block_chars):
    rng = random.Random(5)
    vocabulary = ["aa", "b", "Ć", "d9", "E"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 5, 13, 14, 30, 0])] + [(50, None), (51, "rare pair"), (51, "rare pair")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(100, items[5][1] + " x " + items[4][1]), (101, None), (102, ""), (103, "A rare, PAIR!"), (103, "A rare, PAIR!")]
    got = decontam.benchmark_hits(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), block_chars=block_chars).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, len(r["hits"]), r["items"]) == brute_hits(r.text, items), r.text


def test_contamination_search_finds_every_occurrence():
    rng = random.Random(9)
    for _ in range(60):
        text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
        items = [(i, text(rng.randint(0, 20))) for i in range(rng.randint(0, 6))]
        width, own = rng.randint(1, 8), words(text(rng.randint(0, 50)))
        got = sorted((s, t.length, t.benchmark.items[int((t.benchmark.bounds <= p).sum()) - 1]) for t in decontam.windows(items, width) for s, p in t.search([w.encode() for w in own]))
        want = []
        for item, t in items:
            w = words(t)
            n = min(width, len(w))
            want += [(j, n, item) for i in range(len(w) - n + 1 if w else 0) for j in range(len(own) - n + 1) if own[j : j + n] == w[i : i + n]]
        assert got == sorted(want)


def test_one_block_of_the_benchmark_is_held_at_a_time(spark):
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(i, "a b " + " ".join(f"w{i}x{k}" for k in range(3, 18)) + " c " * 1000 * (i == 7)) for i in range(30)], DOCS)
    found = decontam.benchmark_hits(docs, items, block_chars=500)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # the blocks before are in a checkpoint
    assert all(r["items"] == [str(r.doc_id)] and r["hits"] == list(range(2, 17)) for r in found.collect())


def test_contamination_of_long_texts_and_null_ids(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "x " * 300_000 + passage), (None, passage), (None, None)], DOCS).withColumns({"items": F.lit(1), "__hits": F.lit(2)})
    found = decontam.contamination(docs, spark.createDataFrame([(3, passage), (None, "x x x")], "item_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in found) == [(0, 0, 0, 0, False), (0, 20, 20, 1, True), (1, 300_020, 20, 1, False)]


def test_decontaminate_keeps_columns_and_empty_benchmark(spark):
    df = spark.createDataFrame([(1, "x y", 7), (2, None, 8)], "doc_id long, text string, hits int")
    empty = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontam.decontaminate(df, empty).orderBy("doc_id").collect()] == [(1, "x y", 7), (2, None, 8)]
    one = spark.createDataFrame([(1, "y")], "item_id long, text string")
    assert [r.doc_id for r in decontam.decontaminate(df, one).collect()] == [2]


def test_boilerplate_by_sites(spark):
    rows = [(1, "keep\n foot \nown", "a", 1), (2, "foot\nx\nfoot", "b", 1), (3, "foot", "c", 1), (4, "twice\nfoot\t", None, 1), (5, "twice", "a", 1), (6, None, "a", None), (7, "", "b", 0), (8, "twice\n\n", "b", 1), (3, "foot", "c", 1), (9, "many\n" * 3, "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.remove_boilerplate(df).collect() if r.text is not None)
    assert got == [(1, "keep\n foot \nown", 3, 0), (2, "x", 3, 2), (3, "", 1, 1), (3, "", 1, 1), (4, "twice", 2, 1), (5, "twice", 1, 0), (7, "", 1, 0), (8, "twice\n\n", 3, 0), (9, "many\nmany\nmany\n", 4, 0)]
    assert lines.remove_boilerplate(df.limit(0)).count() == 0
    null = lines.remove_boilerplate(df).where("doc_id = 6").first()
    assert null.text is None and null.n_lines == 0


def test_passages_that_repeat_in_one_source(spark):
    passage = " ".join(f"word{i}" for i in range(51))
    rows = [(1, "x\n" + passage, "a"), (2, passage + " \ny", "a"), (3, "x\n" + passage, "a"), (4, passage[:-7] + "\nz", "a"), (5, passage[:-7] + "\nw", "a"), (6, "p " * 200_000 + "\n" + passage, None), (None, passage, "a"), (2, passage + " \ny", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"n_lines": F.lit("k"), "__gone": F.lit(2)})
    got = sorted(((r.doc_id or 0, r.n_removed, r.text[-20:]) for r in lines.remove_boilerplate(df).collect()))
    assert [(d, n) for d, n, _ in got] == [(0, 0), (1, 0), (2, 1), (2, 1), (3, 0), (4, 0), (5, 0), (6, 1)] and got[2][2] == "y"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-3, 3), max_size=14))
def test_maximal_segments_contain_the_best(scores):
    found = toxicity.maximal_segments([float(s) for s in scores])
    best = max((sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=0)
    assert max((s for *_, s in found), default=0) == max(best, 0)
    assert all(sum(scores[a:b]) == s > 0 for a, b, s in found)
    assert all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))
    for a, b, _ in found:  # no prefix or suffix of a segment is worth nothing or less
        assert all(sum(scores[a:k]) > 0 for k in range(a + 1, b + 1)) and all(sum(scores[k:b]) > 0 for k in range(a, b))


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = held_out(F.col("doc_id"), 5, 0)
    model = toxicity.train(docs, labels.where(~out))
    scored = toxicity.score(docs.where(out).select("doc_id", "text"), model).join(labels, "doc_id").select("score", "toxic").collect()
    toxic, other = [r.score for r in scored if r.toxic == 1], [r.score for r in scored if r.toxic == 0]
    ranked = sum((a > b) + 0.5 * (a == b) for a in toxic for b in other) / (len(toxic) * len(other))
    assert ranked > 0.93 and sum(s >= 0.5 for s in toxic) > 0.75 * len(toxic) and sum(s >= 0.5 for s in other) < 0.02 * len(other)
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "idiot " * 4000, 5)], "doc_id long, text string, score int")
    rows = {r.doc_id: r for r in toxicity.score(odd, model).collect()}
    assert rows[1].score == rows[2].score < 0.5 < rows[3].score
    kept = toxicity.drop_toxic(odd, model)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2] and kept.first().score == 5


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "x")], DOCS)
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).first().score < 0.5
