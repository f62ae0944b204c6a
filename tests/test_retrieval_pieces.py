"""Tokenizers, escapes, rerank requests, positions and plans of the hits-first joins."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessella import hooks
from tessella.functions import text as tx
from tessella.functions.tokenizers import Characters, Encoded
from tessella.operators import chunking, extraction, graph, ranking


def opener():
    def bpe():
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids, lambda ids: tokenizer.decode(ids)

    return bpe


def test_chunks_follow_the_tokenizer(spark):
    docs = spark.createDataFrame([(1, "你好世界 abc def"), (2, "one two three"), (3, None)], "doc_id long, text string")
    cut = lambda t: sorted((r.doc_id, r.chunk_order_index, r.tokens, r.content) for r in chunking.by_tokens(docs, 4, 1, tokenizer=t).collect())
    assert cut(Characters()) == [(1, 0, 4, "你好世界"), (1, 1, 3, "界 abc def"), (2, 0, 3, "one two three")]
    bpe = opener()
    encode, decode = bpe()
    want = []
    for doc_id, text in ((1, "你好世界 abc def"), (2, "one two three")):
        ids = encode(text)
        want += [(doc_id, k, min(4, len(ids) - at), decode(ids[at : at + 4])) for k, at in enumerate(range(0, len(ids), 3))]
    encoded = Encoded(bpe)
    assert cut(encoded) == want
    ids = docs.select("doc_id", encoded.encode(F.col("text")).alias("ids")).select("doc_id", encoded.decode(F.col("ids")).alias("text"))
    assert {r.doc_id: r.text for r in ids.collect()} == {1: "你好世界 abc def", 2: "one two three", 3: ""}
    both = spark.createDataFrame([(1, "a b c|d|e f g h")], "doc_id long, text string")
    split = lambda t: sorted((r.chunk_order_index, r.tokens, r.content) for r in chunking.by_separator_then_tokens(both, "|", 3, 1, tokenizer=t).collect())
    assert split(Characters()) == [(0, 3, "a b c"), (1, 1, "d"), (2, 3, "e f g"), (3, 2, "g h")]
    assert [x[2] for x in split(encoded)] == ["a b c", "d", "e f g", " g h"]


def test_budget_counts_by_the_tokenizer_and_keeps_empty_rows(spark):
    rows = spark.createDataFrame([(0, ""), (1, "你好 a"), (2, " "), (3, "好 b"), (4, "")], "id int, content string")
    kept = lambda counter: sorted(r.id for r in ranking.token_budget(rows, "content", 4, [F.col("id")], counter=counter).collect())
    assert kept(None) == [0, 1, 2, 3, 4] and kept(Characters().count) == [0, 1, 2]


def test_escapes_and_csv(spark):
    df = spark.createDataFrame([(r"a你\n\"b\"", 'x,"y,""z",,"w\0"'), ("plain \\ \n", "")], "e string, c string")
    got = df.select(tx.decoded_escapes(F.col("e")), tx.csv_fields(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("a你\\n\\\"b\\\"", ["x", 'y,"z', "", "w"]), ("plain \\ \n", [""])]


def test_all_html_entities(spark):
    df = spark.createDataFrame([("  &lt;b&gt; &eacute;&#233;&#xe9; &amp;lt; a & b &hellip;\x07 ",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.clean(F.col("t"))).collect()] == ["<b> ééé &lt; a & b …", None]


def test_code_blocks_and_rerank_requests(spark):
    text = "Say:\n```python\nx = 1\n```\nand\n```\nplain\n```\nend"
    blocks = spark.createDataFrame([(text,)], "t string").select(extraction.code_blocks(F.col("t")).alias("c")).first().c
    assert [(b.type, b.content) for b in blocks.blocks] == [("python", "x = 1"), ("language-specific", "plain")] and blocks.rest == "Say:\nand\nend"
    asked = 'Query: who?\n"1" first one\n\n"12" second\n"3" third'
    found = spark.createDataFrame([(asked,)], "t string").select(extraction.paragraphs(F.col("t")).alias("p")).first().p
    assert found.query == "who?" and [tuple(x) for x in found.paragraphs] == [(1, "first one"), (12, "second"), (3, "third")]


def test_positions_are_those_of_a_sort(spark):
    rows = spark.createDataFrame([(k * 7919 % 1009,) for k in range(1000)], "k long")
    got = {r.k: r.at for r in ranking.positions(rows, "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))} and ranking.positions(rows.limit(0), "k").count() == 0


def test_scores_that_fail_are_null(spark):
    def score(query, texts):
        if query == "bad":
            raise RuntimeError("no")
        return [float(len(t)) for t in texts]

    rows = spark.createDataFrame([(1, "ab", "q"), (2, "abc", "bad"), (3, "", "q")], "id long, content string, query string")
    assert {r.id: r.score for r in hooks.scored(rows, score).collect()} == {1: 2.0, 2: None, 3: 0.0}


def test_counts_are_observed_beside_the_work(spark):
    from tessella.operators.context import observed

    rows, seen = observed(spark.range(10).withColumn("kind", F.col("id") % 2), odd=F.count_if(F.col("kind") == 1), n=F.count("*"))
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"odd": 5, "n": 10}


@pytest.mark.parametrize("depth", [graph.touching, graph.degrees_of])
def test_hits_are_filtered_before_aggregation(spark, depth):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("d", "e"), ("b", "b")], "lo string, hi string")
    found = depth(edges, spark.createDataFrame([("a",), ("b",), ("b",)], "id string"))
    if depth is graph.touching:
        assert sorted(map(tuple, found.collect())) == [("a", "b"), ("a", "c"), ("b", "b")]
    else:
        assert {r.id: r.degree for r in found.collect()} == {"a": 2, "b": 3}
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Aggregate") < plan.index("LeftSemi")  # the join lies below


def test_recall_of_projection_hashing(spark):
    """Approximate near pairs against all pairs of the embeddings."""
    import numpy as np

    from tessella.operators.search import lsh_pairs

    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).collect()
    x, ids = np.array([r.vector for r in rows], dtype=np.float64), [r.id for r in rows]
    limit = float(np.quantile(np.linalg.norm(x[:, None] - x[None], axis=2)[np.triu_indices(len(x), 1)], 0.02))
    near = {tuple(sorted((ids[i], ids[j]))) for i in range(len(x)) for j in range(i) if np.linalg.norm(x[i] - x[j]) < limit}
    df = spark.createDataFrame([(r.id, r.vector) for r in rows], "id long, vector array<float>")
    found = {(r.a, r.b) for r in lsh_pairs(df, limit).collect()}
    print("recall", len(found & near) / len(near))
    assert found <= near and len(found) >= 0.9 * len(near) > 900
