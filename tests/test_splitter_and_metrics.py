"""The separating splitter against a plain loop; metrics over verdicts, and the verdicts themselves."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.functions.limits import Limits
from tessella.operators import chunking, evaluation


def plain_split(text, size, overlap, separator):
    """Pieces gathered while they fit; then those at the end that the overlap holds begin the next chunk."""
    out, now = [], []
    joined = lambda parts: len(separator.join(parts))
    for piece in [x for x in text.split(separator) if x]:
        if now and joined([*now, piece]) > size:
            out.append(now)
            while now and (joined(now) > overlap or joined([*now, piece]) > size):
                now = now[1:]
        now = [*now, piece]
    if now:
        out.append(now)
    return [c for c in (separator.join(x).strip() for x in out) if c]


@pytest.mark.parametrize(("size", "overlap", "separator"), [(300, 50, "\n\n"), (40, 15, "\n"), (12, 0, "."), (10, 9, "ab")])
def test_chunks_equal_a_plain_loop(spark, size, overlap, separator):
    rng = random.Random(size)
    texts = [None, "", separator, "  ", "x" * (2 * size), f"a{separator}{separator}b", separator.join("é" * rng.randint(0, 9) for _ in range(1200))]
    for _ in range(25):
        texts.append(separator.join(rng.choice(["w", " ", "uv "]) * rng.randint(0, size if rng.random() < 0.1 else size // 4) for _ in range(rng.randint(1, 40))))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in chunking.by_separated_characters(rows, size, overlap, separator).orderBy("doc_id", "chunk_order_index").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    assert got == {i: plain_split(t, size, overlap, separator) for i, t in enumerate(texts) if t and plain_split(t, size, overlap, separator)}


def test_all_documents_equal_a_plain_loop(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {}
    for r in chunking.by_separated_characters(docs, separator="\n").orderBy("doc_id", "chunk_order_index").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    want = {r.doc_id: plain_split(r.text, 300, 50, "\n") for r in docs.where("text is not null").collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_verdicts_of_a_judge(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], ["a text", "nothing", "bad"]), (2, [], ["x"]), (3, ["a"], [])], "id long, claims array<string>, contexts array<string>")

    def judge(claims, context):
        if context == "bad":
            raise RuntimeError("down")
        return [c in context.split() for c in claims]

    found = evaluation.verdicts(rows, judge, limits=Limits(retries=0))
    assert {(r.context, r.claim): (r.supported, r.error) for r in found.collect()} == {(0, 0): (True, None), (0, 1): (False, None), (1, 0): (False, None), (1, 1): (False, None), (2, 0): (None, "down"), (2, 1): (None, "down")}
    assert [(r.id, r.score) for r in evaluation.supported_share(found).collect()] == [(1, 0.5)]
    short = evaluation.verdicts(rows.limit(1), lambda claims, context: [True], limits=Limits(retries=0)).collect()
    assert all(r.supported is None and "1 verdicts on 2 claims" in r.error for r in short)


def test_precision_noise_and_relevancy(spark):
    found = spark.createDataFrame([(1, 0, True), (1, 1, None), (1, 2, True), (2, 0, False), (3, 5, False), (3, 2, True)], "id long, context int, useful boolean")
    assert {r.id: round(r.score, 6) for r in evaluation.context_precision(found).collect()} == {1: round((1 + 2 / 3) / 2, 6), 2: 0.0, 3: 1.0}
    kind = "id long, context int, claim int, supported boolean"
    by_context = spark.createDataFrame([(1, 0, 0, True), (1, 0, 1, True), (1, 1, 2, True), (1, 0, 3, False)], kind)
    reference = spark.createDataFrame([(1, 0, 0, True), (1, 1, 0, False)], kind)
    known = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 2, False), (1, 3, False)], "id long, claim int, supported boolean")
    assert evaluation.noise_sensitivity(by_context, reference, known).first().score == 0.25  # only claim 0 is wrong by a relevant context
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "id long, vector array<double>")
    made = spark.createDataFrame([(1, [1.0, 0.0], True), (1, [0.0, 1.0], False), (2, [1.0, 0.0], True)], "id long, vector array<double>, noncommittal boolean")
    assert {r.id: r.score for r in evaluation.response_relevancy(asked, made).collect()} == {1: 0.5, 2: 0.0}
    assert evaluation.context_precision(found.where(F.lit(False))).count() == 0
