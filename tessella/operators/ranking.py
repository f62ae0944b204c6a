"""Ranking, budgets and cuts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import token_count
from tessella.operators import graph


def token_budget(rows: DataFrame, text: str, budget: int, order: list[Column], by: list[str] | None = None, counter: Callable[[Column], Column] | None = None) -> DataFrame:
    """Longest prefix whose tokens add up to ``budget`` at most (R7); rows without tokens cost nothing, but a budget of 0 buys none.

    Of the rows with tokens no more than the first ``budget`` and one can matter: a distributed
    top-k finds these before the running sum. With ``by`` each of its keys has a budget. Tokens are
    those of ``counter``, white-space tokens by default.
    """
    if budget <= 0:
        return rows.where(F.lit(False))
    counted = rows.withColumn("__tokens", (counter or token_count)(F.col(text)))
    some, none = counted.where("__tokens > 0"), counted.where("__tokens <= 0")
    if by:
        window = Window.partitionBy(*by).orderBy(*order)
        some = some.withColumn("__rn", F.row_number().over(window)).where(F.col("__rn") <= budget + 1).drop("__rn")
    else:
        window = Window.partitionBy(F.lit(1)).orderBy(*order)
        some = some.orderBy(*order).limit(budget + 1)
    counted = some.unionByName(none)
    running = F.sum("__tokens").over(window.rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("__running", running).where(F.col("__running") <= budget).drop("__running", "__tokens")


def numbered(rows: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "id") -> DataFrame:
    """Rows with a number from 0 in the given order (R6), for results that a budget or top-k bounds."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*(by or [F.lit(1)])).orderBy(*order)) - 1)


def ranked_runs(rows: DataFrame, score: str, key: str, by: str) -> DataFrame:
    """``rows`` of each ``by`` in falling ``score``, then rising ``key``: with ``rn`` from 1 and the score ``before``, for groups of any size.

    Rows are dealt by ranges of the whole order, so a hot group lies in many ranges, and no task gets
    more than a range. A group's ranges are summed up first: one row for each tells how many rows come
    before it and the score that these end with. Rows without a score come last. Rows equal in all
    three have numbers in any order.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = graph.checkpoint(rows.repartitionByRange(width, F.col(by), F.desc(score), F.col(key)).withColumn("__range", F.spark_partition_id()))
    ends = dealt.groupBy(by, "__range").agg(F.count("*").alias("__n"), F.min_by(score, F.struct(F.col(score).isNotNull(), score)).alias("__last"))
    earlier = Window.partitionBy(by).orderBy("__range")
    ends = ends.select(F.col(by).alias("__by"), F.col("__range").alias("__at"), F.coalesce(F.sum("__n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"), F.lag("__last").over(earlier).alias("__carried"))
    own = Window.partitionBy("__range", by).orderBy(F.desc(score), key)
    place = F.row_number().over(own)
    joined = dealt.join(ends, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__range") == F.col("__at")))
    out = joined.withColumns({"__place": place, "__lag": F.lag(score).over(own)})
    out = out.withColumns({"rn": F.col("__place") + F.col("__start"), "before": F.when(F.col("__place") == 1, F.col("__carried")).otherwise(F.col("__lag"))})
    return out.drop("__range", "__by", "__at", "__start", "__carried", "__place", "__lag")


def _until(ranked: DataFrame, fails: Column, by: str, least: int = 0) -> DataFrame:
    """Rows of each ``by`` before the first that ``fails``, or of a number up to ``least``; that row is found by a minimum."""
    first = ranked.where(fails).groupBy(by).agg(F.min("rn").alias("__stop")).withColumnRenamed(by, "__by")
    joined = ranked.join(first, F.col(by).eqNullSafe(F.col("__by")), "left")
    return joined.where(F.col("__stop").isNull() | (F.col("rn") < F.col("__stop")) | (F.col("rn") <= least)).drop("__by", "__stop")


def gradient_select(scored: DataFrame, least: int = 30, gradient: float = 1.1, by: str = "query_id", key: str = "id") -> DataFrame:
    """Best rows of each query: ``least`` of them, then on while a score is over the last one's ``gradient``-th part.

    A query may have any number of rows (:func:`ranked_runs`). Rows without a score come last and end nothing.
    """
    ranked = ranked_runs(scored, "score", key, by)
    fails = F.coalesce((F.col("rn") > least) & ~(F.col("score") > F.col("before") / gradient), F.lit(False))
    return _until(ranked, fails, by).drop("before")


def gradient_select_difference(scored: DataFrame, least: int = 12, threshold: float = -0.01, by: str = "query_id", key: str = "id") -> DataFrame:
    """Best rows while each is less than ``-threshold`` below the last; ``least`` of them if these are fewer."""
    ranked = ranked_runs(scored, "score", key, by)
    fails = F.coalesce((F.col("rn") > 1) & ~(F.col("score") - F.col("before") > threshold), F.lit(False))
    return _until(ranked, fails, by, least).drop("before")


def ranked_all(scored: DataFrame, by: str = "query_id", key: str = "id", name: str = "place") -> DataFrame:
    """Every row of each query with its place from 0 in falling score, for queries with any number of rows."""
    ranked = ranked_runs(scored, "score", key, by)
    return ranked.withColumn(name, F.col("rn") - 1).drop("rn", "before")


def positions(rows: DataFrame, key: str, name: str = "at") -> DataFrame:
    """Place of each row in the order of ``key``, from 0, without one task for all: ranges are counted first, then numbered each."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = graph.checkpoint(rows.repartitionByRange(width, key).withColumn("__range", F.spark_partition_id()))
    counts = dict(dealt.groupBy("__range").count().collect())  # one row for each range
    before, starts = 0, []
    for k in range(width):
        starts.append(F.lit(before).cast("long"))
        before += counts.get(k, 0)
    own = F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1
    return dealt.withColumn(name, own + F.get(F.array(*starts), F.col("__range"))).drop("__range")


def related_edges(near: DataFrame, degrees_at: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges ``near`` hits, each once, with the sum of their ends' degrees as ``rank``, which ``degrees_at(ids)`` looks up."""
    near = graph.checkpoint(near)
    return graph.edge_degrees(near, degrees_at(near.select(F.explode(F.array("lo", "hi")).alias("id")).distinct()))


def chunks_of_entities(hits: DataFrame, nodes_at: Callable[[DataFrame], DataFrame], near: DataFrame) -> DataFrame:
    """Chunks that hit entities cite: ``chunk_id, at (place of the last entity citing it), relations`` (R2).

    ``relations`` counts that entity's neighbours, by the edges ``near`` the hits, that cite the chunk too.
    """
    adjacent = graph.checkpoint(graph.adjacency(near))
    known = hits.select("id").unionByName(adjacent.select(F.col("dst").alias("id"))).distinct()
    cited = nodes_at(known).select("id", F.explode("source_ids").alias("chunk_id"))
    own = hits.select("pos", "id").join(cited, "id")
    last = own.groupBy("chunk_id").agg(F.max(F.struct("pos", "id")).alias("x")).select("chunk_id", F.col("x.pos").alias("at"), F.col("x.id").alias("id"))
    neighbours = last.join(adjacent.select(F.col("src").alias("id"), F.col("dst").alias("near")), "id")
    shared = neighbours.join(cited.select(F.col("id").alias("near"), "chunk_id"), ["near", "chunk_id"])
    counts = shared.groupBy("chunk_id").agg(F.countDistinct("near").alias("relations"))
    return last.join(counts, "chunk_id", "left").select("chunk_id", "at", F.coalesce("relations", F.lit(0)).alias("relations"))


def chunks_of_edges(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Chunks that hit edges cite, each with the place of the first."""
    own = hits.select("pos", "lo", "hi").join(edges.select("lo", "hi", F.explode("source_ids").alias("chunk_id")), ["lo", "hi"])
    return own.groupBy("chunk_id").agg(F.min("pos").alias("at"))


def endpoints(hits: DataFrame) -> DataFrame:
    """Ends of hit edges in the order they are first seen."""
    ends = hits.select("pos", F.posexplode(F.array("lo", "hi")).alias("side", "id"))
    return ends.groupBy("id").agg(F.min(F.struct("pos", "side")).alias("at"))
