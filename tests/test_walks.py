"""Biased walks: valid, seeded, and with the shares that p and q ask for; embeddings of close nodes are close."""

from collections import Counter

import numpy as np
import pytest

from tessella.operators import walks

KIND = "lo string, hi string, weight double"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Tables of a few rows need no more; it saves most of the time of the many small jobs."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
EDGES = [("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", None), ("c", "d", 1.0), ("d", "e", 3.0), ("b", "a", 1.0), ("e", "e", 5.0), ("e", "f", 0.0)]
LINKS = {("a", "b"): 2.0, ("b", "c"): 2.0, ("a", "c"): 1.0, ("c", "d"): 1.0, ("d", "e"): 3.0}
LINKS |= {(b, a): w for (a, b), w in LINKS.items()}


def test_shares_match_p_and_q(spark):
    p, q = 0.25, 2.0
    found = walks.walks(spark.createDataFrame(EDGES, KIND), 1500, 3, p, q, seed=3).collect()
    paths = {r.walk: tuple(r.path) for r in found}
    assert len(paths) == 5 * 1500 and all(len(x) == 3 and set(zip(x, x[1:], strict=False)) <= set(LINKS) for x in paths.values())
    first, third = Counter(x[:2] for x in paths.values()), Counter(paths.values())
    for (a, b), w in LINKS.items():
        assert first[a, b] / 1500 == pytest.approx(w / sum(v for (x, _), v in LINKS.items() if x == a), abs=0.05)
        weights = {y: v * (1 / p if y == a else 1 if (a, y) in LINKS else 1 / q) for (x, y), v in LINKS.items() if x == b}
        for y, v in weights.items():
            assert third[a, b, y] / first[a, b] == pytest.approx(v / sum(weights.values()), abs=0.08)
    again = walks.walks(spark.createDataFrame(EDGES[::-1], KIND).repartition(3), 5, 3, p, q, seed=3).collect()
    assert all(paths[r.walk] == tuple(r.path) for r in again)


def test_embeddings_of_close_nodes_are_close(spark):
    groups = [[f"{g}{i}" for i in range(5)] for g in "xy"]
    rows = [(a, b, 1.0) for nodes in groups for i, a in enumerate(nodes) for b in nodes[i + 1 :]] + [("x0", "y0", 0.1)]
    found = {r.id: np.array(r.vector) for r in walks.node_vectors(spark.createDataFrame(rows, KIND), 8, per_node=12, length=5).collect()}
    unit = {k: v / np.linalg.norm(v) for k, v in found.items()}
    near = np.mean([unit[a] @ unit[b] for nodes in groups for a in nodes for b in nodes if a < b])
    far = np.mean([unit[a] @ unit[b] for a in groups[0] for b in groups[1]])
    assert set(found) == {n for nodes in groups for n in nodes} and near > far
    assert walks.node_vectors(spark.createDataFrame([], KIND)).count() == 0
