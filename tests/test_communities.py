"""Louvain's communities against a plain Louvain in Python."""

import itertools
import random

import pytest

from tessella.operators import communities

KIND = "lo string, hi string, weight double"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Tables of a few rows need no more; it saves most of the time of the many small jobs."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def plain_modularity(edges, of):
    total = 2 * sum(w for *_, w in edges)
    degree, inside = {}, 0.0
    for a, b, w in edges:
        degree[of[a]] = degree.get(of[a], 0) + w
        degree[of[b]] = degree.get(of[b], 0) + w
        inside += 2 * w * (of[a] == of[b])
    return inside / total - sum((d / total) ** 2 for d in degree.values())


def plain_louvain(edges):
    """One node after another, until none moves; then communities become nodes."""
    names = {n: n for e in edges for n in e[:2]}
    while True:
        links, loops = {}, {}
        for a, b, w in edges:
            if a == b:
                loops[a] = loops.get(a, 0) + w
            else:
                for x, y in ((a, b), (b, a)):
                    links.setdefault(x, {})[y] = links.setdefault(x, {}).get(y, 0) + w
        nodes = sorted({n for e in edges for n in e[:2]})
        k = {n: sum(links.get(n, {}).values()) + 2 * loops.get(n, 0) for n in nodes}
        total, of, tot = sum(k.values()), {n: n for n in nodes}, dict(k)
        moved, any_moved = True, False
        while moved:
            moved = False
            for n in nodes:
                near = {of[n]: 0.0}
                for other, w in links.get(n, {}).items():
                    near[of[other]] = near.get(of[other], 0) + w
                tot[of[n]] -= k[n]
                best = max(near, key=lambda c: (near[c] - k[n] * tot[c] / total, c == of[n]))
                gain = near[best] - k[n] * tot[best] / total - (near[of[n]] - k[n] * tot[of[n]] / total)
                if best != of[n] and gain > 1e-12:
                    of[n], moved, any_moved = best, True, True
                tot[of[n]] += k[n]
        names = {n: of[c] for n, c in names.items()}
        if not any_moved:
            return names
        merged = {}
        for a, b, w in edges:
            key = tuple(sorted((of[a], of[b])))
            merged[key] = merged.get(key, 0) + w
        edges = [(a, b, w) for (a, b), w in merged.items()]


def planted(groups, size, inside, between, seed):
    rng = random.Random(seed)
    nodes = [f"n{i:03d}" for i in range(groups * size)]
    return [(a, b, 1.0) for (i, a), (j, b) in itertools.combinations(enumerate(nodes), 2) if rng.random() < (inside if i % groups == j % groups else between)]


def test_modularity_is_that_of_a_plain_louvain(spark):
    rng, edges = random.Random(5), planted(3, 8, 0.7, 0.05, 1)
    edges = [(a, b, w) if rng.random() < 0.5 else (b, a, w) for a, b, w in edges] + [("n000", "n000", 0.5)]
    table = spark.createDataFrame(edges, KIND)
    found = {r.id: r.community for r in communities.louvain(table).collect()}
    want = plain_modularity(edges, plain_louvain(edges))
    got = plain_modularity(edges, found)
    assert set(found) == {n for e in edges for n in e[:2]} and got >= want - 0.02
    assert all(min(n for n in found if found[n] == c) == c for c in set(found.values()))
    assert communities.modularity(table, spark.createDataFrame(list(found.items()), "id string, community string")) == pytest.approx(got)


def test_clear_groups_and_odd_tables(spark):
    rows = [("a", "b", None), ("b", "c", 1.0), ("c", "a", 1.0), ("x", "y", 2.0), ("y", "z", 2.0), ("z", "x", 2.0), ("c", "x", 0.1), ("q", "q", 1.0), ("u", "v", 0.0), (None, "a", 1.0), ("a", "b", 1.0)]
    table = spark.createDataFrame(rows, KIND)
    found = {r.id: r.community for r in communities.louvain(table.repartition(3, "hi")).collect()}
    assert found == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "x", "q": "q"}
    assert communities.louvain(spark.createDataFrame([], KIND)).count() == 0


def shuffled(spark):
    """Rows that all stages so far wrote to shuffles."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_rounds_leave_the_links_where_they_are(spark):
    edges = planted(3, 40, 0.9, 0.4, 2)
    table = spark.createDataFrame(edges, KIND)
    before = shuffled(spark)
    assert communities.louvain(table, rounds=3, levels=1).count() == 120
    assert shuffled(spark) - before < 2 * len(edges) + 40 * 120


def test_parts_do_not_change_the_communities(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(a, b, rng.randint(1, 9) / 2) for a, b, _ in planted(4, 10, 0.6, 0.1, 4)] + [("n000", "n000", 2.5), ("lone", "lone", 1.0)]
    table = spark.createDataFrame(edges, KIND)
    one = sorted(map(tuple, communities.louvain(table, rounds=3, levels=2).collect()))
    monkeypatch.setattr(communities, "MOST_LINKS", 100)
    assert sorted(map(tuple, communities.louvain(table, rounds=3, levels=2).collect())) == one
    assert ("lone", "lone") in one and not [t for t in spark.catalog.listTables() if t.name.startswith("louvain_")]
    assert spark.conf.get(communities.ALL_KEYS) == "true"


def gains_left(edges, of):
    """Modularity that the best move of a node, and the best union of two linked communities, would still add."""
    total, links, k, between, tot = 2 * sum(w for *_, w in edges), {}, {}, {}, {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            k[x], tot[of[x]] = k.get(x, 0) + w, tot.get(of[x], 0) + w
            if a != b:
                links.setdefault(x, {})[of[y]] = links.setdefault(x, {}).get(of[y], 0) + w
                between[of[x], of[y]] = between.get((of[x], of[y]), 0) + w
    move = lambda n, c: links[n].get(c, 0) - k[n] * (tot[c] - k[n] * (c == of[n])) / total
    nodes = max(move(n, c) - move(n, of[n]) for n in links for c in links[n])
    unions = [w - tot[c] * tot[d] / total for (c, d), w in between.items() if c != d]
    return 2 * nodes / total, 2 * max(unions, default=0.0) / total


def test_levels_and_rounds_go_on_until_nothing_gains(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}", 1.0) for i in range(60)]  # a path, whose gains are alike everywhere
    found = {r.id: r.community for r in communities.louvain(spark.createDataFrame(edges, KIND)).collect()}
    assert gains_left(edges, found)[1] < 1e-7
    assert plain_modularity(edges, found) >= plain_modularity(edges, plain_louvain(edges)) - 0.02


def test_one_level_ends_where_no_node_gains(spark):
    edges = planted(5, 12, 0.4, 0.2, 6)
    found = {r.id: r.community for r in communities.louvain(spark.createDataFrame(edges, KIND), levels=1).collect()}
    assert gains_left(edges, found)[0] < 1e-7


def test_the_query_leaves_no_union_that_gains(spark, sf):
    from tessella.plans import bindings, catalog

    edges = [tuple(r) for r in bindings.Graph(spark, sf).edges().select("lo", "hi", "weight").collect()]
    found = {r.id: r.community for r in catalog.QUERIES["louvain_communities"](spark, sf).collect()}
    assert gains_left(edges, found)[1] < 1e-7
    assert plain_modularity(edges, found) >= plain_modularity(edges, plain_louvain(edges)) - 0.01


def test_few_communities_are_settled_by_one_task(spark, monkeypatch):
    edges = planted(4, 12, 0.5, 0.1, 7) + [("n000", "n000", 2.0), ("lone", "lone", 1.0)] + [(f"p{i:03d}", f"p{i + 1:03d}", 0.5) for i in range(40)]
    levels, settled, table = [], communities._settled, spark.createDataFrame(edges, KIND)
    monkeypatch.setattr(communities, "_settled", lambda *args: levels.append(1) or settled(*args))
    found = {r.id: r.community for r in communities.louvain(table).collect()}
    assert len(levels) == 1 and set(found) == {n for e in edges for n in e[:2]} and found["lone"] == "lone"
    assert gains_left([e for e in edges if e[0] != "lone"], found)[1] < 1e-7
    assert plain_modularity(edges, found) >= plain_modularity(edges, plain_louvain(edges)) - 0.02
    assert found == {r.id: r.community for r in communities.louvain(table.repartition(5, "hi")).collect()}
    monkeypatch.setattr(communities, "LAST_LINKS", -1)  # all levels in rounds
    rounds = {r.id: r.community for r in communities.louvain(table).collect()}
    assert len(levels) > 3 and set(rounds) == set(found) and gains_left([e for e in edges if e[0] != "lone"], rounds)[1] < 1e-7
    assert plain_modularity(edges, rounds) >= plain_modularity(edges, plain_louvain(edges)) - 0.02


def test_last_levels_are_those_of_a_plain_louvain():
    import pandas as pd
    import pyarrow as pa

    edges = planted(4, 12, 0.5, 0.1, 8) + [("n000", "n000", 2.0), ("a", "a", 1.0)]
    rows = pd.DataFrame(edges, columns=["src", "dst", "w"])
    for frames in ([rows], [rows.iloc[:0:-1], rows.iloc[:1]]):
        done = lambda levels, frames=frames: dict(zip(*next(communities._last_levels(levels)(pa.RecordBatch.from_pandas(f, preserve_index=False) for f in frames)).to_pydict().values(), strict=True))
        assert gains_left(edges[:-1], done(None))[1] < 1e-7
        assert plain_modularity(edges, done(None)) >= plain_modularity(edges, plain_louvain(edges)) - 1e-9
        assert gains_left(edges[:-1], done(1))[0] < 1e-7 and done(0) == {n: n for e in edges for n in e[:2]}
