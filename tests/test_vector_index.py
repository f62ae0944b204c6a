"""The vector index and exact batch search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import search
from tessella.operators.vector_index import VectorIndex
from tessella.plans import catalog

KIND = "id long, vector array<float>"


def clustered(n, d=16, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(12, d))[rng.integers(0, 12, n)] * 2 + rng.normal(size=(n, d)) * 0.6).astype(np.float32)


def brute(vectors, queries, k):
    """Keys and cosines of the best rows, ties by key."""
    ids = np.array(sorted(vectors))
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    rows = unit(np.array([vectors[i] for i in ids], dtype=np.float64))
    scores = unit(np.array(list(queries.values()), dtype=np.float64)) @ rows.T
    return {q: [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s))[:k]] for q, s in zip(queries, scores, strict=True)}


def as_rows(spark, vectors, kind=KIND):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in vectors.items()], kind)


def found_by(df, key="id"):
    out = {}
    for r in df.orderBy("query_id", "rn").collect():
        out.setdefault(r.query_id, []).append((r[key], r.similarity))
    return out


def recall(found, want):
    return np.mean([len({i for i, _ in found.get(q, [])} & {i for i, _ in w}) / len(w) for q, w in want.items()])


@pytest.mark.parametrize("block", [1024, 7])
def test_batch_search_in_blocks_and_in_groups(spark, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "GROUP", 60)
    vectors = dict(enumerate(clustered(300)))
    vectors[1000] = vectors[3]  # a tie
    queries = {i: vectors[i] for i in range(0, 300, 10)}
    got = found_by(search.top_k_batch(as_rows(spark, {**vectors, 2000: None}), as_rows(spark, queries, "query_id long, vector array<float>"), 5))
    want = brute(vectors, queries, 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(s == pytest.approx(t) for q in want for (_, s), (_, t) in zip(got[q], want[q], strict=True))


def test_a_task_passes_on_its_best_only(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        vectors = as_rows(spark, dict(enumerate(clustered(200)))).coalesce(1)
        one = as_rows(spark, {7: clustered(1, seed=3)[0]}, "query_id long, vector array<double>")
        assert vectors.select("id", "vector").mapInArrow(search._best_of(one.toArrow(), 3, "id"), "query_id long, id long, similarity double").count() == 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    vectors = dict(enumerate(clustered(3000)))
    odd = {9001: None, 9002: np.zeros(16), 9003: np.full(16, np.nan)}
    return vectors, VectorIndex.build(as_rows(spark, {**vectors, **odd}), str(tmp_path_factory.mktemp("index")))


@pytest.mark.parametrize("block", [1024, 20])
def test_index_finds_most_of_the_nearest_in_few_cells(spark, built, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK", block)
    vectors, index = built
    assert index.settings.probes < len(index.centres) / 2 and index.settings.expected >= 0.95
    queries = {i: vectors[i] + 0.01 for i in range(0, 3000, 50)}
    asked = as_rows(spark, {**queries, -1: np.zeros(16)}, "query_id long, vector array<float>")
    got, want = found_by(index.search(asked, 10)), brute(vectors, queries, 10)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    exact = brute(vectors, queries, 3000)
    assert all(s == pytest.approx(dict(exact[q])[i], abs=1e-6) for q, v in got.items() for i, s in v)
    everywhere = found_by(index.search(asked, 10, probes=10_000))
    assert recall(everywhere, want) > 0.995


def test_partitions_are_pruned_and_rows_fetched_late(spark, built):
    vectors, index = built
    found = index.search(as_rows(spark, {1: vectors[1]}, "query_id long, vector array<float>"), 5, probes=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "code" in line.split("Batched")[0]]
    assert scans and all("PartitionFilters: [cell" in line and "vector" not in line.split("Batched")[0] for line in scans)
    touched = {r.p.split("cell=")[1].split("/")[0] for r in index.rows().where(F.col("cell").isin(*[r.cell for r in found.join(index.rows(), "id").select("cell").distinct().collect()])).select(F.input_file_name().alias("p")).distinct().collect()}
    assert len(touched) <= 3


def test_changed_and_deleted_rows(spark, tmp_path):
    vectors = dict(enumerate(clustered(200, seed=5)))
    index = VectorIndex.build(as_rows(spark, vectors), str(tmp_path), cells=4)
    vectors[500], vectors[7] = vectors[3] + 0.001, -vectors[7]
    index.upsert(as_rows(spark, {500: vectors[500], 7: vectors[7]}))
    index.delete(spark.createDataFrame([(9,), (12345,)], "id long"))
    del vectors[9]
    again = VectorIndex(spark, str(tmp_path))
    assert again.rows().count() == 200
    queries = {1: vectors[3], 2: vectors[7], 3: clustered(200, seed=5)[9]}
    got = found_by(again.search(as_rows(spark, queries, "query_id long, vector array<float>"), 8, probes=99))
    assert recall(got, brute(vectors, queries, 8)) > 0.95 and got[2][0][0] == 7 and got[1][0][0] in (3, 500) and 9 not in {i for i, _ in got[3]}
    near = found_by(again.search(as_rows(spark, queries, "query_id long, vector array<float>"), 8, probes=99, threshold=0.999))
    assert all(s >= 0.999 for v in near.values() for _, s in v)


def test_string_keys_and_no_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i}", [float(x) for x in v]) for i, v in enumerate(clustered(50))], "name string, vector array<double>")
    index = VectorIndex.build(rows, str(tmp_path / "a"), key="name")
    got = index.search(rows.select(F.col("name").alias("query_id"), "vector"), 1).collect()
    assert len(got) == 50 and all(r.query_id == r["name"] and r.similarity == pytest.approx(1) for r in got)
    with pytest.raises(ValueError, match="no vector"):
        VectorIndex.build(rows.limit(0), str(tmp_path / "b"), key="name")


def test_recall_of_the_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    vectors = {r.vec_id: r.embedding for r in rows}
    want = brute(vectors, {i: v for i, v in vectors.items() if i % 20 == 0}, 10)
    assert recall(found_by(catalog.QUERIES["vector_index_topk"](spark, folder)), want) >= 0.9


@pytest.mark.parametrize(("rows", "far"), [(16_384, 0.0), (60, 0.0), (60, 1e6)])
def test_links_and_classes_without_pairs(spark, monkeypatch, rows, far):
    """Links of all cells and blocks, copies among them, against all pairs."""
    monkeypatch.setattr(search, "NEAR_ROWS", rows)
    monkeypatch.setattr(search, "HELD", 500)
    x = np.random.default_rng(1).normal(size=(400, 8)) + far
    x[300:330] = x[5]  # copies
    near = np.linalg.norm(x[:, None] - x[None], axis=2) < 1.5
    np.fill_diagonal(near, False)
    label = np.arange(400)
    while (label != (new := np.minimum(label, np.where(near, label, 400).min(axis=1)))).any():
        label = new
    odd = {9001: None, 9002: np.full(8, np.nan)}
    got = {r.id: (r.n_links, r.component) for r in search.near_links(as_rows(spark, {**dict(enumerate(x)), **odd}, "id long, vector array<double>"), 1.5).collect()}
    assert len(set(label)) > 20 and got == {**{i: (near[i].sum(), label[i]) for i in range(400)}, 9001: (0, 9001), 9002: (0, 9002)}


def arrow(vectors, key="id"):
    import pyarrow as pa

    return pa.table({key: pa.array(list(vectors), pa.int64()), "vector": pa.array([v.tolist() for v in vectors.values()], pa.list_(pa.float64()))})


def test_batch_search_holds_few_scores(monkeypatch):
    """A task holds some rows' scores at a time, however many rows a batch or a group has."""
    monkeypatch.setattr(search, "HELD", 4000)
    add = search.Best.add

    def small(self, scores, *others):
        assert scores.size <= 4000
        return add(self, scores, *others)

    monkeypatch.setattr(search.Best, "add", small)
    vectors = dict(enumerate(clustered(500).astype(np.float64)))
    queries = {i: vectors[i] for i in range(0, 500, 2)}
    rows, asked, want = arrow(vectors), arrow(queries, "query_id"), brute(vectors, queries, 3)
    for found in (list(search._best_of(asked, 3, "id")(iter(rows.to_batches()))), search._best_of_groups(3, "id")(rows, asked).to_batches()):
        got = {}
        for r in (r for batch in found for r in batch.to_pylist()):
            got.setdefault(r["query_id"], []).append(r["id"])
        assert got == {q: [i for i, _ in v] for q, v in want.items()}


def test_links_of_a_block_come_in_pieces(monkeypatch):
    monkeypatch.setattr(search, "HELD", 500)
    x = np.random.default_rng(2).normal(size=(200, 8))
    near = np.linalg.norm(x[:, None] - x[None], axis=2) < 2
    np.fill_diagonal(near, False)
    named = lambda part: arrow(dict(part)).rename_columns(["__key", "__vector"])
    every = list(enumerate(x))
    own, across = (search._linked(2.0, "id")(*t).to_pylist() for t in (((0, 0, 0, 0), named(every), named(every)), ((0, 0, 1, 0), named(every[:90]), named(every[90:]))))
    assert {r["id"]: r["n"] for r in own} == {i: n for i, n in enumerate(near.sum(axis=1)) if n}
    near[:90, :90] = near[90:, 90:] = False
    assert {r["id"]: r["n"] for r in across} == {i: n for i, n in enumerate(near.sum(axis=1)) if n}
