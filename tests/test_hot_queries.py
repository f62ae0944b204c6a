"""Ranking within groups of which one holds most rows, against plain Python."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import ranking


@pytest.fixture(scope="module")
def rows():
    """A hot query, small ones, a null one; scores with ties, falls and nulls."""
    hot = [("hot", i, None if i % 97 == 0 else float(1000 - (i * 7) % 500)) for i in range(3000)]
    small = [(f"q{i % 5}", i, float((i * i) % 60)) for i in range(100)]
    return hot + small + [(None, i, float(i)) for i in range(10)] + [("one", 1, None)]


def by_query(rows):
    groups = {}
    for q, i, s in rows:
        groups.setdefault(q, []).append((i, s))
    return {q: sorted(g, key=lambda r: (r[1] is None, -(r[1] or 0), r[0])) for q, g in groups.items()}


def kept(rows, least, passes, always):
    out = set()
    for q, group in by_query(rows).items():
        failed = False
        for n, (i, s) in enumerate(group, 1):
            before = group[n - 2][1] if n > 1 else None
            if n > least and s is not None and before is not None and not passes(s, before):
                failed = True
            if not failed or n <= always:
                out.add((q, i, n))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "query_id string, id long, score double").repartition(5)


def test_the_hot_query_lies_in_several_ranges(spark, frame):
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = frame.repartitionByRange(width, "query_id", F.desc("score"), "id").where("query_id = 'hot'")
    assert dealt.select(F.spark_partition_id().alias("p")).distinct().count() > 3
    ranked = ranking.ranked_runs(frame, "score", "id", "query_id")
    assert "__range" not in ranked.columns


def test_places_and_scores_before(frame, rows):
    got = {(r.query_id, r.id): (r.rn, r.before) for r in ranking.ranked_runs(frame, "score", "id", "query_id").collect()}
    want = {(q, i): (n + 1, group[n - 1][1] if n else None) for q, group in by_query(rows).items() for n, (i, _) in enumerate(group)}
    assert got == want
    places = {(r.query_id, r.id): r.place for r in ranking.ranked_all(frame).collect()}
    assert places == {k: n - 1 for k, (n, _) in want.items()}


@pytest.mark.parametrize("least, gradient", [(1, 1.1), (30, 1.0005), (5, 1.001), (2500, 1.0)])
def test_gradient(frame, rows, least, gradient):
    got = {(r.query_id, r.id, r.rn) for r in ranking.gradient_select(frame, least, gradient).collect()}
    assert got == kept(rows, least, lambda s, b: s > b / gradient, 0)


@pytest.mark.parametrize("least, threshold", [(4, -0.5), (900, -3.0), (12, -1.5)])
def test_difference(frame, rows, least, threshold):
    got = {(r.query_id, r.id, r.rn) for r in ranking.gradient_select_difference(frame, least, threshold).collect()}
    assert got == kept(rows, 1, lambda s, b: s - b > threshold, least)


def test_no_rows(spark):
    none = spark.createDataFrame([], "query_id string, id long, score double")
    assert ranking.gradient_select(none).count() == 0 and ranking.ranked_all(none).count() == 0
