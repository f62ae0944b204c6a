"""Sections of query contexts, over any graph with lookups, the three kinds of hits, a ``budget`` and a token ``counter``.

A graph is an object with the methods of :class:`Lookups`: hits are few (a top-k), so every join
begins with them: nodes, edges, degrees and chunks are looked up for what hits touch.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import graph, ranking


class Lookups:
    """Lookups over whole tables ``nodes()``, ``edges()`` and ``chunks()``, for graphs that have no better way."""

    def nodes_at(self, ids):
        return self.nodes().join(ids.select("id").distinct(), "id", "left_semi")

    def edges_at(self, pairs):
        return self.edges().join(pairs.select("lo", "hi").distinct(), ["lo", "hi"], "left_semi")

    def edges_touching(self, ids):
        return graph.touching(self.edges(), ids)

    def degrees_at(self, ids):
        return graph.degrees_of(self.edges(), ids)

    def chunks_at(self, ids):
        return self.chunks().join(ids.select("id").distinct(), "id", "left_semi")


def entities_at_hits(g):
    """Hit entities with their nodes and degrees, missing ones left out."""
    hits = g.entity_hits()
    nodes = g.nodes_at(hits).drop("source_ids")
    return hits.join(nodes, "id").join(g.degrees_at(hits), "id", "left").withColumn("rank", F.coalesce("degree", F.lit(0))).drop("degree")


def edges_at_hits(g):
    """Hit edges with rank."""
    hits = g.edge_hits()
    near = g.edges_at(hits).drop("source_ids")
    ends = hits.select(F.explode(F.array("lo", "hi")).alias("id"))
    return hits.join(graph.edge_degrees(near, g.degrees_at(ends)), ["lo", "hi"])


def local_entity_rows(g):
    """Entities of local mode, in order of hits (Q2)."""
    rows = entities_at_hits(g).select("pos", F.col("id").alias("entity"), F.col("entity_type").alias("type"), "description", "rank")
    return ranking.numbered(rows, [F.col("pos")]).drop("pos")


def edge_order():
    """Highest rank first, then weight, then ends."""
    return [F.desc("rank"), F.desc("weight"), F.col("lo"), F.col("hi")]


def edge_section(g, rows):
    """Edges within the budget of their descriptions, numbered."""
    kept = ranking.token_budget(rows, "description", g.budget, edge_order(), counter=g.counter)
    return ranking.numbered(kept, edge_order()).select("id", F.col("lo").alias("source"), F.col("hi").alias("target"), "description", "keywords", "weight", "rank")


def local_relation_rows(g):
    """Relations of local mode."""
    return edge_section(g, ranking.related_edges(g.edges_touching(g.entity_hits()), g.degrees_at))


def _with_content(g, found):
    """Chunks ``found(chunk_id)`` with their text."""
    ids = found.select(F.col("chunk_id").alias("id"))
    return found.join(g.chunks_at(ids).withColumnRenamed("id", "chunk_id"), "chunk_id")


def entity_chunk_rows(g):
    """Chunks that hit entities cite, with text (R2)."""
    hits = g.entity_hits()
    return _with_content(g, ranking.chunks_of_entities(hits, g.nodes_at, g.edges_touching(hits)))


def local_source_rows(g):
    """Sources of local mode."""
    order = [F.col("at"), F.desc("relations"), F.col("chunk_id")]
    return ranking.numbered(ranking.token_budget(entity_chunk_rows(g), "content", g.budget, order, counter=g.counter), order).select("id", "content")


def edge_chunk_rows(g):
    """Chunks that hit edges cite, with text."""
    hits = g.edge_hits()
    return _with_content(g, ranking.chunks_of_edges(hits, g.edges_at(hits)))


def global_relation_rows(g):
    """Relations of global mode."""
    return edge_section(g, edges_at_hits(g))


def global_entity_rows(g):
    """Entities of global mode, in the order edges name them."""
    ends = ranking.endpoints(g.edge_hits())
    nodes = g.nodes_at(ends).drop("source_ids")
    ends = ends.join(nodes, "id").join(g.degrees_at(ends).withColumnRenamed("degree", "rank"), "id")
    kept = ranking.token_budget(ends, "description", g.budget, [F.col("at")], counter=g.counter).withColumnRenamed("id", "entity")
    return ranking.numbered(kept, [F.col("at")]).select("id", "entity", F.col("entity_type").alias("type"), "description", "rank")


def global_source_rows(g):
    """Sources of global mode."""
    order = [F.col("at"), F.col("chunk_id")]
    return ranking.numbered(ranking.token_budget(edge_chunk_rows(g), "content", g.budget, order, counter=g.counter), order).select("id", "content")


def naive_rows(g):
    """Hit chunks within the budget (Q1)."""
    hits = g.chunk_hits()
    return ranking.token_budget(hits.join(g.chunks_at(hits), "id").where("content is not null"), "content", g.budget, [F.col("pos")], counter=g.counter)
