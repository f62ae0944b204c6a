"""Property graph as two tables: ``nodes(id, entity_type, description, source_ids)`` and ``edges(lo, hi, weight, description, keywords, source_ids)`` with ``lo <= hi``."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import SEP, hash_id

T = TypeVar("T")


def joined_set(column: str, separator: str = SEP) -> Column:
    """Distinct values in order, joined."""
    return F.array_join(F.sort_array(F.collect_set(column)), separator)


def merge_nodes(mentions: DataFrame, typed: bool = True) -> DataFrame:
    """Nodes from ``mentions(name, entity_type, description, chunk_id, pos)`` (A1; without types A2b).

    The type is the most frequent one, of equal ones the first seen, then the smallest. Each part is one aggregation
    with partial sums, so a name with very many mentions is combined before it is shuffled.
    """
    merged = mentions.groupBy(F.col("name").alias("id")).agg(joined_set("description").alias("description"), F.sort_array(F.collect_set("chunk_id")).alias("source_ids"))
    if not typed:
        return merged
    kinds = mentions.groupBy("name", "entity_type").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = kinds.groupBy(F.col("name").alias("id")).agg(F.min_by("entity_type", F.struct((-F.col("n")).alias("n"), "first", "entity_type")).alias("entity_type"))
    return best.join(merged, "id")


def merge_edges(mentions: DataFrame, weighted: bool = True) -> DataFrame:
    """Edges from ``mentions(src, tgt, weight, description, keywords, chunk_id)``, weights summed (A2; without weights A2b)."""
    weight = [F.sum("weight").alias("weight")] if weighted else []
    return mentions.groupBy(F.least("src", "tgt").alias("lo"), F.greatest("src", "tgt").alias("hi")).agg(
        *weight, joined_set("description").alias("description"), joined_set("keywords", ",").alias("keywords"), F.sort_array(F.collect_set("chunk_id")).alias("source_ids")
    )


def placeholders(edges: DataFrame, nodes: DataFrame, description: Column | None = None) -> DataFrame:
    """A node of unknown type for each endpoint that has none, described by its first edge (A3)."""
    text = F.col("description") if description is None else description
    ends = edges.select(F.explode(F.array("lo", "hi")).alias("id"), F.struct("lo", "hi").alias("edge"), text.alias("description"), "source_ids")
    new = ends.groupBy("id").agg(F.min_by(F.struct("description", "source_ids"), "edge").alias("x"))
    return new.join(nodes.select("id"), "id", "left_anti").select("id", F.lit("UNKNOWN").alias("entity_type"), "x.description", "x.source_ids")


def degrees(edges: DataFrame, direction: str = "both") -> DataFrame:
    """Incident edges of each node, a loop counted twice; ``out`` counts those that begin there."""
    ends = F.explode(F.array("lo", "hi")) if direction == "both" else F.col("lo")
    return edges.select(ends.alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end among ``ids(id)``, each once; the few ids go to the edges."""
    low, high = (ids.select(F.col("id").alias(c)).distinct() for c in ("lo", "hi"))
    return edges.join(low, "lo", "left_semi").unionByName(edges.join(high, "hi", "left_semi").join(low, "lo", "left_anti").select(*edges.columns))


def degrees_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Degrees of ``ids(id)`` only: of the edges those at these ids are counted."""
    return edges.select(F.explode(F.array("lo", "hi")).alias("id")).join(ids.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.count("*").alias("degree"))


def edge_degrees(edges: DataFrame, degree: DataFrame) -> DataFrame:
    """Sum of the degrees of both ends."""
    low = degree.select(F.col("id").alias("lo"), F.col("degree").alias("d1"))
    high = degree.select(F.col("id").alias("hi"), F.col("degree").alias("d2"))
    return edges.join(low, "lo", "left").join(high, "hi", "left").withColumn("rank", F.coalesce("d1", F.lit(0)) + F.coalesce("d2", F.lit(0))).drop("d1", "d2")


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    return edges.select(F.col("lo").alias("src"), F.col("hi").alias("dst")).union(edges.select("hi", "lo")).distinct()


def one_hop(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Neighbours of ``seeds(id)``."""
    return seeds.join(adjacency(touching(edges, seeds)).withColumnRenamed("src", "id"), "id")


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Attributes of ``new`` put into ``old``; nulls leave what is there."""
    others = [c for c in old.columns if c != key]
    fresh = new.select(key, *[F.col(c).alias(f"__{c}") for c in others])
    return old.join(fresh, key, "full_outer").select(key, *[F.coalesce(f"__{c}", c).alias(c) for c in others])


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of nodes, node types, edges and keyword sets."""
    each = nodes.select(F.lit("node").alias("kind"), F.col("id").alias("key"), F.col("entity_type").alias("type")).unionByName(
        edges.select(F.lit("edge").alias("kind"), F.concat_ws(SEP, "lo", "hi").alias("key"), F.col("keywords").alias("type")))
    return each.groupBy("kind").agg(F.countDistinct("key").alias("n"), F.countDistinct("type").alias("n_types"))


def with_text(items: DataFrame, chunks: DataFrame, key: list[str]) -> DataFrame:
    """Text of the source chunks of nodes or edges, joined in order of chunk id."""
    each = items.select(*key, F.explode_outer("source_ids").alias("chunk_id"))
    found = each.join(chunks.select(F.col("id").alias("chunk_id"), "content"), "chunk_id", "left")
    return _texts(found, key)


def _texts(found: DataFrame, key: list[str]) -> DataFrame:
    return found.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", "content"))), lambda x: x["content"]), "; ").alias("content"))


def mentions_with_text(mentions: DataFrame, chunks: DataFrame, key: list[str]) -> DataFrame:
    """:func:`with_text` for what ``mentions(*key, chunk_id)`` merge to: they meet the chunks before they come together, not after and again."""
    each = mentions.select(*key, "chunk_id").repartition("chunk_id").distinct()  # a chunk's mentions lie together for the join, too
    found = each.join(chunks.select(F.col("id").alias("chunk_id"), "content"), "chunk_id", "left")
    return _texts(found, key)


def stable_edges(edges: DataFrame) -> DataFrame:
    """Edges with ends in order, sorted."""
    return edges.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct().orderBy("lo", "hi")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share.

    Only a local session, as in tests, gets a folder of this machine where none is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def together(*makers: Callable[[], T]) -> list[T]:
    """Results of functions that each run Spark jobs of their own, side by side: small jobs leave most of a cluster idle."""
    with ThreadPoolExecutor(len(makers)) as pool:
        return [f.result() for f in [pool.submit(m) for m in makers]]


def checkpoints(*frames: DataFrame) -> list[DataFrame]:
    """Checkpoints of frames that do not depend on each other."""
    return together(*[lambda df=df: checkpoint(df) for df in frames])


def reachable(edges: DataFrame, seeds: DataFrame, depth: int, directed: bool = False) -> DataFrame:
    """Least number of steps from ``seeds(id)`` to every node within ``depth``.

    Breadth first: each round joins the frontier with the adjacency and drops nodes seen before.
    """
    steps = edges.select(F.col("lo").alias("src"), F.col("hi").alias("dst")).distinct() if directed else adjacency(edges)
    seen = checkpoint(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for d in range(1, depth + 1):
        found = front.select(F.col("id").alias("src")).join(steps, "src").select(F.col("dst").alias("id")).distinct()
        front = checkpoint(found.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = checkpoint(seen.unionByName(front))
    return seen


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids(id)``."""
    return edges.join(ids.select(F.col("id").alias("lo")), "lo", "left_semi").join(ids.select(F.col("id").alias("hi")), "hi", "left_semi").select(*edges.columns)


def with_vectors(items: DataFrame, vectors: DataFrame, key: list[str]) -> DataFrame:
    """Nodes or edges with their vectors, null where there is none."""
    return items.join(vectors.select(*key, "vector"), key, "left")


def components(edges: DataFrame) -> DataFrame:
    """Smallest id reachable from every node, by rounds of the least label of the neighbours and of the label's own label."""
    steps = checkpoint(adjacency(edges))
    labels = checkpoint(steps.select(F.col("src").alias("id"), F.col("src").alias("label")).distinct())
    while True:
        near = steps.join(labels, steps.dst == labels.id).groupBy("src").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.id == near.src, "left").select("id", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = lower.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = checkpoint(lower.join(jump, "label", "left").select("id", "was", F.coalesce("further", "label").alias("label")))
        if new.where("label <> was").isEmpty():
            return new.select("id", F.col("label").alias("component"))
        labels = new.select("id", "label")


def largest_component(edges: DataFrame) -> DataFrame:
    """Nodes of the component of most nodes, of equal ones the one of the smallest id."""
    found = components(edges)
    best = found.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return found.join(best.select("component"), "component").select("id")


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """Communities: each round a node takes the most frequent label among its neighbours, of equal ones the smallest."""
    steps = checkpoint(adjacency(edges))
    labels = steps.select(F.col("src").alias("id"), F.col("src").alias("label")).distinct()
    for _ in range(rounds):
        votes = steps.join(labels, steps.dst == labels.id).groupBy(F.col("src").alias("id"), "label").agg(F.count("*").alias("n"))
        ranked = votes.groupBy("id").agg(F.max("n").alias("most")).join(votes, "id").where("n = most")
        labels = checkpoint(ranked.groupBy("id").agg(F.min("label").alias("label")))
    return labels


def display_sizes(degree: DataFrame) -> DataFrame:
    """Degrees scaled to 0.5 to 2; 1 where all are equal."""
    low, high = degree.agg(F.min("degree"), F.max("degree")).first()
    if low == high:
        return degree.select("id", F.lit(1.0).alias("size"))
    return degree.select("id", (F.lit(0.5) + (F.col("degree") - low) / F.lit(high - low) * 1.5).alias("size"))


# deletion


def delete_document(items: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """Nodes or edges without the chunks ``gone(chunk_id)``; those left without a source go too."""
    touched = items.select(*key, F.explode("source_ids").alias("chunk_id")).join(gone.select("chunk_id"), "chunk_id", "left_anti")
    left = touched.groupBy(*key).agg(F.sort_array(F.collect_set("chunk_id")).alias("source_ids"))
    if set(items.columns) == {*key, "source_ids"}:
        return left  # nothing else to bring back
    return items.drop("source_ids").join(left, key)


def drop_edges_of(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges without those that touch ``removed(id)``."""
    return edges.join(removed.select(F.col("id").alias("lo")), "lo", "left_anti").join(removed.select(F.col("id").alias("hi")), "hi", "left_anti").select(*edges.columns)


def relation_ids(edges: DataFrame) -> DataFrame:
    """Key of each relation's vector."""
    return edges.withColumn("id", hash_id("rel-", F.concat("lo", "hi")))
