"""Small cases of the rules that are easy to get wrong."""

import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella import hooks
from tessella.functions import text as tx
from tessella.functions import vectors as vx
from tessella.operators import chunking, context, evaluation, extraction, graph, kv, ranking, search


def test_chunk_windows_keep_the_short_tail(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "  "), (3, None), (4, "x")], "doc_id long, text string")
    got = [(r.doc_id, r.chunk_order_index, r.tokens, r.content) for r in chunking.by_tokens(docs, 3, 1).orderBy("doc_id", "chunk_order_index").collect()]
    assert got == [(1, 0, 3, "a b c"), (1, 1, 3, "c d e"), (1, 2, 1, "e"), (4, 0, 1, "x")]


def test_gradient_example(spark):
    rows = spark.createDataFrame([(0, i, s) for i, s in enumerate([0.9, 0.8, 0.7, 0.6, 0.5, 0.1])], "query_id int, id int, score double")
    assert ranking.gradient_select(rows, 3, 2.0).count() == 5
    assert ranking.gradient_select_difference(rows, 2, -0.15).count() == 5
    assert ranking.gradient_select_difference(rows, 3, 0.2).count() == 3


def test_budget_is_a_prefix(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "c d e"), (3, "f"), (4, "g")], "pos int, t string")
    kept = lambda n: [r.pos for r in ranking.token_budget(rows, "t", n, [F.col("pos")]).orderBy("pos").collect()]
    assert [kept(n) for n in (0, 1, 2, 4, 5, 6, 9)] == [[], [], [1], [1], [1, 2], [1, 2, 3], [1, 2, 3, 4]]


def test_floats(spark):
    rows = spark.createDataFrame([("1",), ("-1.5",), (".5",), ("1e5",), ("5.",), ("x",)], "t string")
    assert [r.f for r in rows.select(tx.is_float(F.col("t")).alias("f")).collect()] == [True, True, True, False, False, False]


def test_turns_pair_by_two(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (2, 0, "assistant", "x"), (2, 1, "user", "y"), (2, 2, "assistant", '{ "high_level_keywords": []}'), (2, 3, "user", "z"), (2, 4, "assistant", "w")]
    got = {r.conv_id: r.history for r in extraction.conversation_turns(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), 3).collect()}
    assert got == {1: "user: c\nassistant: b", 2: "user: y\nassistant: x\nuser: z\nassistant: w"}


def test_combined_contexts_number_from_one(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "id int, v string")
    b = spark.createDataFrame([(0, "y"), (1, "z")], "id int, v string")
    assert [(r.id, r.v) for r in context.combine(a, b, ["v"]).orderBy("id").collect()] == [(1, "x"), (2, "y"), (3, "z")]


def test_loop_counts_twice_and_merges_are_associative(spark):
    m = spark.createDataFrame([("A", "B", 1.0, "d", "k", "c1"), ("B", "A", 2.0, "e", "k", "c2"), ("A", "A", 1.0, "d", "k", "c1")], "src string, tgt string, weight double, description string, keywords string, chunk_id string")
    edges = graph.merge_edges(m)
    assert {(r.lo, r.hi): r.weight for r in edges.collect()} == {("A", "B"): 3.0, ("A", "A"): 1.0}
    assert {r.id: r.degree for r in graph.degrees(edges).collect()} == {"A": 3, "B": 1}


def test_type_ties_go_to_the_first_seen(spark):
    m = spark.createDataFrame([("A", "t2", "d", "c", 1), ("A", "t1", "d", "c", 2)], "name string, entity_type string, description string, chunk_id string, pos long")
    assert graph.merge_nodes(m).first().entity_type == "t2"


def test_components_and_reachability(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "lo string, hi string")
    assert {r.id: r.component for r in graph.components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert {r.id: r.depth for r in graph.reachable(edges, spark.createDataFrame([("a",)], "id string"), 1).collect()} == {"a": 0, "b": 1}


def test_text_helpers(spark):
    row = spark.createDataFrame([('x\n```python\nprint(1)\n```\ny "1" one\n\n"2" two',)], "t string")
    got = row.select(extraction.code_blocks(F.col("t")).alias("c"), extraction.paragraphs(F.col("t")).alias("p")).first()
    assert [tuple(b) for b in got.c.blocks] == [(0, "", "", "python", "print(1)", True)] and got.c.rest.startswith("x\ny ")
    assert [(p.number, p.text) for p in got.p.paragraphs] == [(1, "one"), (2, "two")] and got.p.query is None
    words = spark.createDataFrame([([str(i) for i in range(1200)],)], "w array<string>").select(chunking.half_and_half(F.col("w"), 100, 1000).alias("h")).first().h
    tokens = [str(i) for i in range(1200)]
    assert words == tokens[1000:1050] + tokens[-1050:1000]


def test_code_blocks_with_names_and_an_open_end(spark):
    text = "a\n<file_name> x.py </file_name>\n```py\n1\n```\nb\n<section>s</section>\n```\nplain\n``````{k} v```\n## filename: last.c\n```c int x;\nopen"
    got = spark.createDataFrame([(text,), ("none",), (None,), ("end ```",)], "t string").select(extraction.code_blocks(F.col("t")).alias("c")).collect()
    blocks = [tuple(b) for b in got[0].c.blocks]
    assert blocks == [
        (0, "x.py", "", "py", "1", True), (1, "", "s", "language-specific", "plain", True), (2, "", "", "", "{k} v", True), (3, "last.c", "", "c", "int x;\nopen", False),
    ]
    assert got[0].c.rest == "a\n<file_name> x.py </file_name>\nb\n<section>s</section>\n## filename: last.c"
    assert got[1].c.blocks == [] and got[1].c.rest == "none" and got[3].c.blocks == [] and got[3].c.rest == "end"


def test_a_budget_of_nothing_buys_nothing(spark):
    rows = spark.createDataFrame([(1, ""), (2, "a b")], "id int, t string")
    assert ranking.token_budget(rows, "t", 0, [F.col("id")]).count() == 0 and ranking.token_budget(rows, "t", 1, [F.col("id")]).count() == 1


def test_long_texts_are_cut_in_linear_time(spark):
    def seconds(words):
        rows = spark.createDataFrame([(1, "ab " * words + "\n" + "cd " * words)], "doc_id int, text string").cache()
        rows.count()
        began = time.time()
        n = chunking.by_tokens(rows, 120, 20).count(), chunking.by_separator_then_tokens(rows, "\n", 40, 10).count()
        assert n == (-(-2 * words // 100), 2 * -(-words // 30))
        return time.time() - began

    seconds(100)
    assert min(seconds(160_000) for _ in range(2)) < 3 * min(seconds(80_000) for _ in range(2)) + 1
    plan = chunking.by_tokens(spark.createDataFrame([(1, "a")], "doc_id int, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_batch_top_k_handles_empty_and_null(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "id long, vector array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.1])], "query_id long, vector array<double>")
    assert [(r.id, r.rn) for r in search.top_k_batch(v, q, 1).collect()] == [(1, 1)]
    assert search.top_k_batch(v, q.limit(0), 1).count() == 0


def test_quantised_flat_vector(spark):
    row = spark.createDataFrame([([1.0, 1.0],)], "v array<double>").select(vx.quantised(F.col("v")).alias("q"), vx.cosine(F.col("v"), F.array(F.lit(0.0), F.lit(0.0))).alias("c")).first()
    assert row.q == [0, 0] and row.c is None


def test_judge_failure_keeps_its_row(spark):
    def judge(rows):
        raise RuntimeError("down")

    got = evaluation.judged(spark.createDataFrame([(1, "a")], "id long, text string"), judge, ["text"]).first()
    assert got.score is None and got.error == "down"


def test_gleaning_stops_at_no():
    said = iter(["r1", "r2", "no", "never"])
    assert hooks.gleaned(lambda prompt, history=None: next(said), "t", rounds=3) == "r1##r2"


def test_routed_begins_with_the_second():
    model = hooks.routed([lambda p, h=None: "a", lambda p, h=None: "b"])
    assert [model("x") for _ in range(3)] == ["b", "a", "b"]


def test_accepted_and_status(spark):
    rows = spark.createDataFrame([(1, "good"), (2, "bad")], "id long, text string")
    assert [r.id for r in hooks.accepted(rows, lambda p, h=None: "是" if "good" in p else "否", lambda t: t).collect()] == [1]
    counts = {r.status: r.n for r in kv.status_counts(spark.createDataFrame([(1, "failed")], "id long, status string")).collect()}
    assert counts == {"failed": 1, "pending": 0, "processing": 0, "processed": 0}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=20), st.integers(1, 8), st.integers(0, 7))
def test_windows_cover_all_tokens(lengths, size, overlap):
    overlap = min(overlap, size - 1)
    for n in lengths:
        starts = range(0, n, size - overlap)
        assert set(range(n)) == {i for s in starts for i in range(s, min(s + size, n))}


def test_texts_of_mentions_are_those_of_merged_items(spark):
    """One shuffle less than by way of the merged table; repeated, missing and unknown chunks count alike."""
    from tessella.operators import graph

    rows = [("a", "c2"), ("a", "c1"), ("a", "c2"), ("b", None), ("c", "c9"), ("c", "c1"), ("c", None)]
    mentions = spark.createDataFrame(rows, "id string, chunk_id string")
    chunks = spark.createDataFrame([("c1", "one"), ("c2", "two"), ("c3", "no")], "id string, content string")
    merged = mentions.groupBy("id").agg(graph.F.sort_array(graph.F.collect_set("chunk_id")).alias("source_ids"))
    texts = lambda df: {r.id: r.content for r in df.collect()}
    found = graph.mentions_with_text(mentions, chunks, ["id"])
    assert texts(found) == texts(graph.with_text(merged, chunks, ["id"])) == {"a": "one; two", "b": "", "c": "one"}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1


def test_deletion_from_keys_alone_joins_nothing_back(spark):
    from tessella.operators import graph

    items = spark.createDataFrame([("a", ["c1", "c2"]), ("b", ["c1"])], "id string, source_ids array<string>")
    left = graph.delete_document(items, spark.createDataFrame([("c1",)], "chunk_id string"), ["id"])
    assert [tuple(r) for r in left.collect()] == [("a", ["c2"])]
    assert left._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
