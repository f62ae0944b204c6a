"""Files, tables, streaming and the engine class."""

import re
import time

import pytest
from pyspark.sql import functions as F

from tessella import hooks
from tessella.api import GraphRetrieval, QueryParam
from tessella.functions.limits import Limits
from tessella.operators import chunking, graph
from tessella.sources import files, sinks
from tessella.streaming import ingest


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Tables of a few rows need no more; it saves most of the time of the many small jobs."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_graphml_is_one_document_that_reads_back(spark, tmp_path):
    from xml.etree import ElementTree

    schema = "id string, entity_type string, description string, source_ids array<string>"
    odd = [("A", "T", "d & e <x>\nsecond line", ["c1", "c2"]), ("B", None, "gone\x01 \U0001f600", None), ("C\nC", "T", "", [])]
    nodes = spark.createDataFrame(odd + [(f"n{i}", "T", "plain", ["c"]) for i in range(40)], schema).repartition(7)
    edges = spark.createDataFrame([("A", "B", 1.5, "x", "k", ["c1"]), ("A", "C\nC", None, "y", None, ["c1"])], "lo string, hi string, weight double, description string, keywords string, source_ids array<string>").repartition(3)
    path = tmp_path / "g.graphml"
    for _ in range(2):  # the second takes the place of the first
        sinks.write_graphml(nodes, edges, str(path))
    assert path.is_file() and [p.name for p in tmp_path.iterdir()] == ["g.graphml"]
    root = ElementTree.parse(path).getroot()
    tags = [x.tag.split("}")[1] for x in root]
    assert tags == ["key"] * 7 + ["graph"] and [x.tag.split("}")[1] for x in root[-1]] == ["node"] * 43 + ["edge"] * 2
    n, e = files.read_graphml(spark, str(path))
    got = {r.id: tuple(r)[1:] for r in n.collect()}
    assert len(got) == 43 and got["A"] == ("T", "d & e <x>\nsecond line", "c1<SEP>c2")
    assert got["B"] == ("", "gone \U0001f600", "") and got["C\nC"] == ("T", "", "")
    assert sorted((r.src, r.tgt, r.weight, r.keywords) for r in e.collect()) == [("A", "B", 1.5, "k"), ("A", "C\nC", 0.0, "")]


def test_graphml_is_read_by_many_tasks(spark, tmp_path):
    """Elements that have lines of their own are dealt out, whatever their texts hold; others are read all the same."""
    odd = "a > b\r\n\u2028 </node> <!-- " + "x" * 100_000
    nodes = spark.createDataFrame([(f"n{i}", "T", odd if i == 3 else "plain", ["c"]) for i in range(400)], "id string, entity_type string, description string, source_ids array<string>")
    edges = nodes.select(graph_end("id").alias("lo"), F.col("id").alias("hi"), F.lit(1.0).alias("weight"), "description", F.lit("k").alias("keywords"), "source_ids")
    path = str(tmp_path / "g.graphml")
    sinks.write_graphml(nodes, edges, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        for frame, name in zip(files.read_graphml(spark, path), ("id", "tgt"), strict=True):
            assert frame.rdd.getNumPartitions() > 5
            assert {r[name]: r.description for r in frame.collect()} == {f"n{i}": odd if i == 3 else "plain" for i in range(400)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    foreign = tmp_path / "f.graphml"
    foreign.write_text('<graphml><graph>\n<!--\n<node id="no"/>\n-->\n<node id="a">\n <data key="d0">T</data>\n</node><node id="b"/>\n<edge source="a"\n target="b"/>\n</graph></graphml>')
    n, e = files.read_graphml(spark, str(foreign))
    assert sorted((r.id, r.entity_type) for r in n.collect()) == [("a", "T"), ("b", "")] and [(r.src, r.tgt, r.weight) for r in e.collect()] == [("a", "b", 0.0)]


def graph_end(name):
    return F.concat(F.lit("m"), F.col(name))


def test_graphml_lies_on_disk_once(spark, tmp_path, monkeypatch):
    """While the parts are joined, all files together are hardly larger than the document."""
    nodes = spark.range(4000).select(F.concat(F.lit("n"), "id").alias("id"), F.lit("T").alias("entity_type"), F.repeat(F.lit("x"), 200).alias("description"), F.array(F.lit("c")).alias("source_ids"))
    edges = nodes.select(F.col("id").alias("lo"), graph_end("id").alias("hi"), F.lit(1.0).alias("weight"), "description", F.lit("k").alias("keywords"), "source_ids")
    held, copy = [], sinks.shutil.copyfileobj

    def watched(*args):
        copy(*args)
        args[1].flush()
        held.append(sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file()))

    monkeypatch.setattr(sinks.shutil, "copyfileobj", watched)
    sinks.write_graphml(nodes.repartition(8), edges.repartition(8), str(tmp_path / "g.graphml"))
    assert len(held) == 17 and max(held) < 1.2 * (tmp_path / "g.graphml").stat().st_size
    n, e = files.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert n.count() == e.count() == 4000


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {name for name in (blocks.apply(i).name() for i in range(blocks.size())) if name.startswith("shuffle_")}


def test_graphml_leaves_no_shuffle_files(spark, tmp_path):
    mentions = spark.range(2000).select((F.col("id") % 300).cast("string").alias("name"), F.lit("T").alias("entity_type"), F.lit("d").alias("description"), F.col("id").cast("string").alias("chunk_id"), F.col("id").alias("pos"))
    links = mentions.select(F.col("name").alias("src"), F.col("chunk_id").alias("tgt"), F.lit(1.0).alias("weight"), "description", F.lit("k").alias("keywords"), "chunk_id")
    before = shuffle_files(spark)
    sinks.write_graphml(graph.merge_nodes(mentions), graph.merge_edges(links), str(tmp_path / "g.graphml"))
    until = time.monotonic() + 20  # Spark deletes them in the background
    while (left := shuffle_files(spark) - before) and time.monotonic() < until:
        time.sleep(0.1)
    assert not left and spark.conf.get(sinks.CLEANUP) == "false"
    n, e = files.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert n.count() == 300 and e.count() == len({tuple(sorted((str(i % 300), str(i)))) for i in range(2000)})


def test_graphml_of_an_empty_graph(spark, tmp_path):
    nodes = spark.createDataFrame([], "id string, entity_type string, description string, source_ids array<string>")
    edges = spark.createDataFrame([], "lo string, hi string, weight double, description string, keywords string, source_ids array<string>")
    sinks.write_graphml(nodes, edges, str(tmp_path / "g.graphml"))
    n, e = files.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert n.count() == 0 and e.count() == 0


def test_binary_files_fall_back_to_gbk(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("你好".encode("gbk"))
    (tmp_path / "b.txt").write_bytes("héllo".encode())
    got = {r.path[-5:]: r.text for r in files.read_binary(spark, str(tmp_path), files.decode_text).collect()}
    assert got == {"a.txt": "你好", "b.txt": "héllo"}


def test_results_split(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "bad")], "id long, error string")
    sinks.write_results(rows, str(tmp_path / "ok"), str(tmp_path / "err"))
    assert spark.read.json(str(tmp_path / "ok")).count() == 1 and spark.read.json(str(tmp_path / "err")).count() == 1


def test_store_versions(spark, tmp_path):
    store = sinks.TableStore(spark, str(tmp_path))
    store.commit({"t": spark.range(3)})
    store.commit({"t": store.read("t").where("id > 0")})
    assert store.read("t").count() == 2
    store.commit(append={"t": spark.range(10, 12)})
    assert store.read("t").count() == 4
    other = sinks.TableStore(spark, str(tmp_path))
    number, _ = other._state()
    store.commit({"u": spark.range(1)})
    other._state = lambda: (number, {})  # as if it had looked before the other commit
    with pytest.raises(Exception, match="exist"):
        other.commit({"t": spark.range(1)})
    assert store.vacuum() == 2 and store.read("t").count() == 4 and store.vacuum() == 0
    store.drop("t")
    assert store.read("t").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    for k, texts in enumerate((["one two", "three"], ["three", "four five six"])):
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.document_stream(spark, str(tmp_path / "in"), "text string", 1)
    ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "check"), 2, 1, once=True).awaitTermination()
    batch = chunking.ingest(spark.read.parquet(str(tmp_path / "in")))
    got = {r.id for r in spark.read.parquet(str(tmp_path / "out/documents")).collect()}
    assert got == {r.id for r in batch.collect()} and len(got) == 3
    assert {r.status: r.n for r in ingest.progress(spark, str(tmp_path / "out")).collect()}["processed"] == 3


def test_a_restarted_stream_reads_no_old_ids(spark, tmp_path):
    def more(k, texts):
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = ingest.document_stream(spark, str(tmp_path / "in"), "text string", 1)
        ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "check"), 2, 1, once=True).awaitTermination()

    more(0, ["one two", " three ", "one two", None])
    run()
    before = spark.conf.get(ingest.STATE[0], None)
    first = {r.id for r in spark.read.parquet(str(tmp_path / "out/documents")).collect()}
    (tmp_path / "out/documents").rename(tmp_path / "moved")  # what was written is not there to be read again
    more(1, ["three", "four five six", "one two"])
    run()
    second = [r.id for r in spark.read.parquet(str(tmp_path / "out/documents")).collect()]
    assert len(first) == 2 and len(second) == 1
    assert first | set(second) == {r.id for r in chunking.ingest(spark.read.parquet(str(tmp_path / "in"))).collect()}
    assert spark.conf.get(ingest.STATE[0], None) == before
    assert any(p.suffix == ".zip" or p.suffix == ".changelog" for p in (tmp_path / "check/state").rglob("*"))  # of the state store on disk


def model():
    """A model that knows two names; a closure, as workers cannot import test modules."""
    more, ask = hooks.MORE, hooks.ASK

    def complete(prompt, history=None):
        if prompt.startswith("Give JSON"):
            return '{"high_level_keywords": ["PLACE"], "low_level_keywords": ["ANNA"]}'
        if "Text: " in prompt:
            text = prompt.rpartition("Text: ")[2]
            return f'("entity"<|>Anna<|>person<|>{text})##("relationship"<|>Anna<|>Rome<|>lives<|>place<|>2)<|COMPLETE|>'
        if prompt.startswith(ask):
            return "no"
        return "" if prompt == more else "answer"

    return complete


def test_engine(spark, tmp_path):
    engine = GraphRetrieval(spark, str(tmp_path), hooks.hashed_embedding, model(), 8, 2, buckets=4)
    docs = spark.createDataFrame([("Anna lives in Rome",), ("Anna likes tea",), ("Anna lives in Rome",)], "text string")
    engine.insert(docs)
    engine.insert(docs)
    edges = engine.store.read("edges").collect()
    assert [(e.lo, e.hi, e.weight) for e in edges] == [("ANNA", "ROME", 4.0)]
    assert {r.id: r.entity_type for r in engine.store.read("nodes").collect()} == {"ANNA": "PERSON", "ROME": "UNKNOWN"}
    param = QueryParam(mode="hybrid", threshold=-1.0, only_need_context=True)
    found = engine.query("where is Anna?", param)
    assert '"ANNA"' in found and "lives in Rome" in found
    assert "Anna" in engine.query("/naive Anna", QueryParam(threshold=-1.0, only_need_context=True))
    assert "-----Chunks-----\n[Created at: 20" in engine.query("Anna", QueryParam(mode="mix", threshold=-1.0, only_need_context=True, gradient=1.1, least=1))
    assert engine.query("/local Anna", QueryParam(threshold=-1.0)) == "answer"
    near, between = engine.subgraph("ROME", 1)
    assert {r.id: r.depth for r in near.collect()} == {"ROME": 0, "ANNA": 1} and between.count() == 1
    assert engine.entity_info("ANNA", True).first().vector and engine.relation_info("ROME", "ANNA", True).first().vector
    doc = engine.store.read("full_docs").where(F.col("content").contains("Rome")).first().id
    engine.delete_document(doc)
    assert engine.store.read("edges").first().weight == 2.0 and engine.store.read("full_docs").count() == 1
    engine.delete_entity("ROME")
    assert engine.store.read("edges").count() == 0 and {r.id for r in engine.store.read("nodes").collect()} == {"ANNA"}
    engine.clear()
    assert engine.query("Anna", QueryParam(mode="naive")) == "Sorry, I cannot answer that from what I know."


def counted(folder):
    """A model, an embedding and a scorer that note their calls in a folder, which workers share; words in ``bad.txt`` fail."""
    import os
    import uuid

    inner, more = model(), hooks.hashed_embedding

    def note(kind, text):
        with open(os.path.join(folder, f"{kind}-{uuid.uuid4().hex}"), "w") as out:
            out.write(text)

    def complete(prompt, history=None):
        note("complete", prompt)
        with open(os.path.join(folder, "bad.txt")) as bad:
            if any(word in prompt for word in bad.read().split()):
                raise RuntimeError("no answer")
        return inner(prompt, history)

    def embed(texts):
        for text in texts:
            note("embed", text)
        return more(texts)

    def calls(kind):
        found = [n for n in os.listdir(folder) if n.startswith(kind + "-")]
        texts = sorted(open(os.path.join(folder, n)).read() for n in found)
        for n in found:
            os.remove(os.path.join(folder, n))
        return texts

    return complete, embed, calls


def test_failed_documents_are_kept_apart_and_retried(spark, tmp_path):
    (tmp_path / "bad.txt").write_text("tea")
    complete, embed, calls = counted(str(tmp_path))
    engine = GraphRetrieval(spark, str(tmp_path / "store"), embed, complete, 8, 2, limits=Limits(retries=0), buckets=4)
    engine.insert(spark.createDataFrame([("Anna lives in Rome",), ("Anna likes tea",)], "text string"))
    states = {r.status: r.error for r in engine.store.read("doc_status").collect()}
    assert states == {"processed": None, "failed": "no answer"}
    assert engine.store.read("full_docs").count() == 2 and engine.store.read("text_chunks").count() == 1
    assert engine.store.read("edges").first().weight == 2.0
    assert len(calls("embed")) == 4  # a chunk, two nodes, an edge
    (tmp_path / "bad.txt").write_text("none-such")
    calls("complete")
    engine.retry()
    assert {r.status for r in engine.store.read("doc_status").collect()} == {"processed"} and engine.store.read("edges").first().weight == 4.0
    assert not any("lives in Rome" in p and "Text: " in p and "tea" not in p for p in calls("complete"))
    embedded = calls("embed")
    assert any("likes tea" in t for t in embedded) and not any(t.startswith("Anna lives") for t in embedded) and len(embedded) <= 4
    engine.insert(spark.createDataFrame([("Anna likes tea",)], "text string"))
    assert calls("embed") == [] == calls("complete")


def test_equal_chunks_are_asked_for_once(spark, tmp_path):
    (tmp_path / "bad.txt").write_text("none-such")
    complete, embed, calls = counted(str(tmp_path))
    engine = GraphRetrieval(spark, str(tmp_path / "store"), embed, complete, 8, 2, buckets=4)
    docs = spark.createDataFrame([("Anna lives in Rome",), ("Anna likes tea",)], "text string")
    engine.insert(docs)
    first = [p for p in calls("complete") if "Text: " in p]
    assert len(first) == 2 and engine.counts == {"documents": 2, "failed": 0, "asked": 2, "errors": 0, "cached": 0}
    for doc in engine.store.read("full_docs").collect():
        engine.delete_document(doc.id)
    assert all(engine.store.read(t).count() == 0 for t in ("nodes", "edges", "adjacency", "degrees", "node_vectors", "edge_vectors", "node_mentions", "edge_mentions", "text_chunks", "doc_status"))
    engine.insert(docs)
    assert calls("complete") == [] and engine.counts == {"documents": 2, "failed": 0, "asked": 0, "errors": 0, "cached": 2}
    assert engine.store.read("edges").first().weight == 4.0


def test_an_insert_writes_the_buckets_that_it_touches(spark, tmp_path):
    import os

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet") and f"{os.sep}_" not in d.removeprefix(str(tmp_path))}

    def complete(prompt, history=None):
        names = prompt.rpartition("Text: ")[2].split() if "Text: " in prompt else []
        return "##".join(f'("relationship"<|>{a}<|>{b}<|>d<|>k<|>1)' for a, b in zip(names, names[1:], strict=False))

    engine = GraphRetrieval(spark, str(tmp_path), hooks.hashed_embedding, complete, 40, 0, buckets=16)
    engine.insert(spark.createDataFrame([(" ".join(f"n{k * 7 + i}" for i in range(8)),) for k in range(40)], "text string"))
    for name in engine.store.keyed:
        engine.store.compact(name)
    edges, degrees = engine.store.read("edges"), {r.id: r.degree for r in engine.store.read("degrees").collect()}
    assert edges.count() == 280 and len(engine.store.keyed) > 9
    before = files()
    engine.insert(spark.createDataFrame([("n3 n4",)], "text string"))
    new = files() - before
    count = lambda name: sum(f"/{name}/" in f for f in new)
    assert count("nodes") <= 2 and count("edges") == 1 and count("edge_mentions") == 1 and count("adjacency") == 0 and count("degrees") == 0 and len(new) <= 12
    assert engine.store.lookup("edges", spark.createDataFrame([("N3", "N4")], "lo string, hi string")).first().weight == 2.0
    engine.insert(spark.createDataFrame([("n3 n200",)], "text string"))
    now = {r.id: r.degree for r in engine.store.read("degrees").collect()}
    assert now["N3"] == degrees["N3"] + 1 and now["N200"] == degrees["N200"] + 1 and {k: v for k, v in now.items() if k not in ("N3", "N200")} == {k: v for k, v in degrees.items() if k not in ("N3", "N200")}
    from tessella.operators import graph

    assert now == {r.id: r.degree for r in graph.degrees(engine.store.read("edges")).collect()}
    near = engine.stored_edges(spark.createDataFrame([("N3",)], "id string"))
    assert {(r.lo, r.hi) for r in near.collect()} == {(r.lo, r.hi) for r in engine.store.read("edges").where("lo = 'N3' or hi = 'N3'").collect()}
    assert {f.split("bucket=")[1].split("/")[0] for f in near.inputFiles()} <= {str(r.b) for r in near.select(engine.store._bucket(engine.store.keyed["edges"]).alias("b")).collect()}


def test_failed_documents_wait_longer_each_time(spark, tmp_path):
    (tmp_path / "bad.txt").write_text("tea")
    complete, embed, calls = counted(str(tmp_path))
    engine = GraphRetrieval(spark, str(tmp_path / "store"), embed, complete, 8, 2, limits=Limits(retries=0), pause=1000, attempts=3, buckets=4)
    engine.insert(spark.createDataFrame([("Anna likes tea",)], "text string"))
    asked = len(calls("complete"))
    one = engine.store.read("doc_status").first()
    engine.retry(due_only=True)
    assert asked and calls("complete") == [] and one.attempts == 1
    engine.retry()
    two = engine.store.read("doc_status").first()
    assert two.attempts == 2 and two.due - one.due > 900 and calls("complete")
    engine.pause = -1e6  # as if the pauses were over
    engine.retry()
    engine.retry(due_only=True)
    assert engine.store.read("doc_status").first().attempts == 3  # none are left
    (tmp_path / "bad.txt").write_text("none-such")
    engine.insert(spark.createDataFrame([("Anna likes tea",)], "text string"))
    assert tuple(engine.store.read("doc_status").select("status", "attempts").first()) == ("processed", 0)


def test_custom_graphs_are_idempotent(spark, tmp_path):
    engine = GraphRetrieval(spark, str(tmp_path), hooks.hashed_embedding, model())
    entities = spark.createDataFrame([(0, "A", "T", "d", "s")], "pos int, entity_name string, entity_type string, description string, source_id string")
    relations = spark.createDataFrame([(0, "A", "B", "x", "k", 2.0, "s")], "pos int, src_id string, tgt_id string, description string, keywords string, weight double, source_id string")
    chunks = spark.createDataFrame([(0, "text of it", "s")], "pos int, content string, source_id string")
    for _ in range(2):
        engine.insert_custom_graph(entities, relations, chunks)
        assert engine.store.read("edges").first().weight == 2.0 and engine.store.read("nodes").count() == 2 and engine.store.read("text_chunks").count() == 1


def test_cache_rerank_and_history(spark, tmp_path):
    (tmp_path / "bad.txt").write_text("none-such")
    complete, embed, calls = counted(str(tmp_path))
    engine = GraphRetrieval(spark, str(tmp_path / "store"), embed, complete, score=lambda query, texts: [None if "tea" in t else float(len(t)) for t in texts])
    engine.insert_chunks(spark.createDataFrame([("a b", ["Anna lives in Rome", "Anna likes tea", "Rome is old and wide"])], "text string, chunks array<string>"))
    assert engine.store.read("text_chunks").count() == 3
    calls("complete")
    param = QueryParam(mode="local", threshold=-1.0, low_keywords=("ANNA",))
    assert engine.query("who is Anna", param) == "answer" and len(calls("complete")) == 1
    assert engine.query("who is Anna", param) == "answer" and calls("complete") == []
    asked = QueryParam(mode="local", threshold=-1.0, low_keywords=("ANNA",), similar=0.5, recheck=True)
    assert engine.query("who is Anna now", asked) == "answer"
    assert [p.startswith(hooks.SAME) for p in calls("complete")].count(True) == 1
    found = engine.context("Anna", QueryParam(mode="mix", threshold=-1.0, low_keywords=("ANNA",), gradient=1.1, least=30))
    blocks = re.findall(r"(\d+):\n(.*?)\n\n", found, re.DOTALL)  # entities, relations and chunks in one order, those without a score last
    assert [int(n) for n, _ in blocks] == list(range(1, len(blocks) + 1)) and not any(b[0] in '",' or b[-1] in '",' for _, b in blocks)
    assert "tea" in blocks[-1][1] and all("tea" not in b for _, b in blocks[:3]) and [b.startswith("[Created at: 20") for _, b in blocks].count(True) >= 2
    assert len(blocks[0][1]) >= len(blocks[2][1]) - 4 and any('"ANNA"' in b for _, b in blocks)
    turns = ({"role": "user", "content": "q"}, {"role": "assistant", "content": None}, {"role": "user", "content": "q2"}, {"role": "assistant", "content": "a2"})
    assert engine.past(QueryParam(history=turns)) == "user: q\nassistant: \nuser: q2\nassistant: a2\n"


def test_stream_indexes_a_graph(spark, tmp_path):
    engine = GraphRetrieval(spark, str(tmp_path / "store"), hooks.hashed_embedding, model())
    spark.createDataFrame([("Anna lives in Rome",)], "text string").write.parquet(str(tmp_path / "in"))
    ingest.index(ingest.document_stream(spark, str(tmp_path / "in"), "text string"), engine, str(tmp_path / "check"), once=True).awaitTermination()
    assert engine.store.read("edges").first().weight == 2.0


def test_long_descriptions_are_summarised(spark):
    rows = spark.createDataFrame([("a", "one two three"), ("b", "one"), ("c", "bad bad bad")], "id string, description string")

    def complete(prompt, history=None):
        if "bad" in prompt:
            raise RuntimeError("no")
        return "short"

    assert {r.id: r.description for r in hooks.summarised(rows, complete, 2).collect()} == {"a": "short", "b": "one", "c": "bad bad bad"}
