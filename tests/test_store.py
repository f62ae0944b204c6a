"""The table store: keyed tables with changes, pruned lookups, compaction, conflicts and readers beside writers."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from tessella.sources.sinks import Conflict, Keyed, TableStore

NODES = Keyed("id string, n long")
PAIRS = Keyed("a string, b string, n long", ("a", "b"), ("a",))


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Tables of a few rows need no more; it saves most of the time of the many small jobs."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def store_in(spark, path, **more):
    return TableStore(spark, str(path), {"nodes": NODES, "pairs": PAIRS}, **{"buckets": 8, **more})


def nodes(spark, rows):
    return spark.createDataFrame(rows, NODES.schema)


def files_under(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def contents(df):
    return sorted(map(tuple, df.collect()))


def test_one_changed_row_writes_its_bucket_only(spark, tmp_path):
    store = store_in(spark, tmp_path)
    store.commit(put={"nodes": nodes(spark, [(f"k{i}", i) for i in range(200)])})
    store.compact("nodes")
    before = files_under(tmp_path / "nodes")
    assert len({f.split("bucket=")[1].split("/")[0] for f in before}) == 8
    store.commit(put={"nodes": nodes(spark, [("k7", -7)])})
    new = files_under(tmp_path / "nodes") - before
    assert len(new) == 1
    assert contents(store.read("nodes")) == sorted([("k7", -7), *[(f"k{i}", i) for i in range(200) if i != 7]])
    assert store.compact("nodes") == 1
    after = files_under(tmp_path / "nodes") - before - new
    assert len(after) == 1 and next(iter(after)).split("bucket=")[1].split("/")[0] == next(iter(new)).split("bucket=")[1].split("/")[0]
    assert store.read("nodes").where("n < 0").count() == 1 and store.compact("nodes") == 0


def test_changes_equal_a_dictionary(spark, tmp_path):
    rng, store, kept = random.Random(3), store_in(spark, tmp_path, most=3), {}
    for _ in range(9):
        put = {f"k{rng.randrange(30)}": rng.randrange(1000) for _ in range(rng.randint(0, 8))}
        gone = [f"k{rng.randrange(30)}" for _ in range(rng.randint(0, 5))]
        for k in gone:
            kept.pop(k, None)
        kept |= put
        store.commit(put={"nodes": nodes(spark, list(put.items()))}, remove={"nodes": spark.createDataFrame([(k,) for k in gone], "id string")})
        assert contents(store.read("nodes")) == sorted(kept.items())
        some = [f"k{rng.randrange(35)}" for _ in range(4)]
        assert contents(store.lookup("nodes", spark.createDataFrame([(k,) for k in some], "id string"))) == sorted((k, kept[k]) for k in set(some) if k in kept)
    assert len(store._state()[1]["nodes"]["changes"]) <= 3
    before = contents(store.read("nodes"))
    assert store.vacuum() > 0 and contents(store.read("nodes")) == before


def test_rows_of_one_key_stand_and_fall_together(spark, tmp_path):
    store = store_in(spark, tmp_path)
    pairs = lambda rows: spark.createDataFrame(rows, PAIRS.schema)
    store.commit(put={"pairs": pairs([("x", "y", 1), ("x", "y", 2), ("x", "z", 3), ("u", "v", 4)])})
    assert store.lookup("pairs", spark.createDataFrame([("x",)], "a string")).count() == 3
    assert contents(store.lookup("pairs", spark.createDataFrame([("x", "z")], "a string, b string"))) == [("x", "z", 3)]
    store.commit(put={"pairs": pairs([("x", "y", 9)])}, remove={"pairs": spark.createDataFrame([("u", "v"), ("x", "y"), ("no", "no")], "a string, b string")})
    assert contents(store.read("pairs")) == [("x", "y", 9), ("x", "z", 3)]


def test_lookups_read_the_buckets_of_their_keys(spark, tmp_path):
    store = store_in(spark, tmp_path)
    store.commit(put={"nodes": nodes(spark, [(f"k{i}", i) for i in range(100)])})
    store.compact("nodes")
    store.commit(put={"nodes": nodes(spark, [(f"k{i}", -i) for i in range(0, 100, 9)])})
    found = store.lookup("nodes", spark.createDataFrame([("k18",)], "id string"))
    assert contents(found) == [("k18", -18)]
    assert len({f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()}) == 1 and len(found.inputFiles()) == 2
    assert store.lookup("nodes", spark.createDataFrame([], "id string")).count() == 0


def test_commits_of_different_tables_go_beside_each_other(spark, tmp_path):
    store, other = store_in(spark, tmp_path), store_in(spark, tmp_path)
    store.commit(put={"nodes": nodes(spark, [("a", 1)])})
    since = store.snapshot()
    other.commit(put={"pairs": spark.createDataFrame([("x", "y", 1)], PAIRS.schema)})
    store.commit(put={"nodes": nodes(spark, [("b", 2)])}, since=since)
    assert store.read("nodes").count() == 2 and store.read("pairs").count() == 1
    since = store.snapshot()
    other.commit(remove={"nodes": spark.createDataFrame([("a",)], "id string")})
    with pytest.raises(Conflict, match="nodes"):
        store.commit(put={"nodes": nodes(spark, [("c", 3)])}, since=since)
    assert contents(store.read("nodes")) == [("b", 2)]
    assert store_in(spark, tmp_path, buckets=99).buckets == 8


def test_readers_beside_a_writer_see_whole_states(spark, tmp_path):
    store = store_in(spark, tmp_path, most=100)
    store.commit(put={"nodes": nodes(spark, [("n", 0)]), "pairs": spark.createDataFrame([("n", "n", 0)], PAIRS.schema)})
    wrong, over = [], threading.Event()

    def look():
        reader = store_in(spark, tmp_path)
        while not over.is_set():
            try:
                number, state = reader._state()
                counts = {len(state["nodes"]["changes"]), len(state["pairs"]["changes"])}
                if len(counts) != 1 or counts != {number}:
                    wrong.append((number, counts))
            except Exception as failure:  # noqa: BLE001
                wrong.append(failure)

    slow = store._renamed
    store._renamed = lambda draft, final: (threading.Event().wait(0.05), slow(draft, final))
    readers = [threading.Thread(target=look) for _ in range(3)]
    for r in readers:
        r.start()
    for i in range(6):
        store.commit(put={"nodes": nodes(spark, [("n", i)]), "pairs": spark.createDataFrame([("n", "n", i)], PAIRS.schema)})
    over.set()
    for r in readers:
        r.join()
    assert wrong == [] and contents(store.read("nodes")) == [("n", 5)]


def test_dropped_and_replaced_tables(spark, tmp_path):
    store = store_in(spark, tmp_path)
    store.commit(put={"nodes": nodes(spark, [("a", 1)])}, append={"log": spark.range(2)})
    store.commit({"nodes": nodes(spark, [("b", 1)]), "log": spark.range(5)})
    assert contents(store.read("nodes")) == [("b", 1)] and store.read("log").count() == 5
    store.drop()
    assert store.read("nodes").count() == 0 == store.read("log").count() and store.read("nodes").columns == ["id", "n"]
    assert store.read("nodes").where(F.col("n") > 0).count() == 0
