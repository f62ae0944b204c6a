"""Queries on deletion."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.text import SEP
from tessella.operators import graph, kv
from tessella.plans.bindings import PRELUDE
from tessella.plans.catalog import query

_GONE = "gone AS (SELECT 'O' || o_orderkey AS chunk_id FROM orders WHERE o_orderkey % 3 = 0)"
_LEFT = "list_filter(source_ids, lambda c: CAST(substr(c, 2) AS BIGINT) % 3 <> 0)"


def _gone(g):
    return g.table("orders").where("o_orderkey % 3 = 0").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("chunk_id"))


@query(PRELUDE + f"SELECT id, entity_type, array_to_string({_LEFT}, '<SEP>') AS source_ids FROM nodes WHERE len({_LEFT}) > 0")
def delete_doc_nodes(g):
    return graph.delete_document(g.nodes().drop("description"), _gone(g), ["id"]).select("id", "entity_type", F.array_join("source_ids", SEP).alias("source_ids"))


@query(PRELUDE + f"SELECT lo, hi, weight, array_to_string({_LEFT}, '<SEP>') AS source_ids FROM edges WHERE len({_LEFT}) > 0")
def delete_doc_edges(g):
    return graph.delete_document(g.edges(), _gone(g), ["lo", "hi"]).select("lo", "hi", "weight", F.array_join("source_ids", SEP).alias("source_ids"))


@query(PRELUDE + ", d AS (SELECT 'O' || o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0) SELECT id, content FROM chunks WHERE id NOT IN (SELECT id FROM d)")
def delete_doc_chunks(g):
    return kv.delete(g.chunks(), _gone(g).withColumnRenamed("chunk_id", "id"))


@query("SELECT kind, 0::BIGINT AS remaining FROM (VALUES ('chunks'), ('nodes'), ('edges')) v(kind)")
def verify_deletion(g):
    gone, nodes = _gone(g), graph.merge_nodes(g.node_mentions(), typed=False)
    left = {
        "chunks": kv.delete(g.chunks(), gone.withColumnRenamed("chunk_id", "id")).select(F.col("id").alias("chunk_id")),
        "nodes": graph.delete_document(nodes.select("id", "source_ids"), gone, ["id"]).select(F.explode("source_ids").alias("chunk_id")),
        "edges": graph.delete_document(g.edges().select("lo", "hi", "source_ids"), gone, ["lo", "hi"]).select(F.explode("source_ids").alias("chunk_id")),
    }
    counts = [df.join(gone, "chunk_id", "left_semi").agg(F.count("*").alias("remaining")).select(F.lit(kind).alias("kind"), "remaining") for kind, df in left.items()]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


@query(PRELUDE + "SELECT id FROM nodes WHERE id <> 'S5'")
def delete_entity_nodes(g):
    return kv.delete(g.nodes(), g.spark.createDataFrame([("S5",)], "id string")).select("id")


@query(PRELUDE + "SELECT lo, hi FROM edges WHERE lo NOT IN ('S5', 'P6') AND hi NOT IN ('S5', 'P6')")
def delete_entity_edges(g):
    return graph.drop_edges_of(g.edges(), g.spark.createDataFrame([("S5",), ("P6",)], "id string")).select("lo", "hi")


@query(PRELUDE + "SELECT lo, hi FROM edges WHERE NOT (lo = 'P' || (CAST(substr(hi, 2) AS BIGINT)))")
def remove_edges(g):
    gone = g.edges().where(F.col("lo") == F.concat(F.lit("P"), F.substring("hi", 2, 20))).select("lo", "hi")
    return g.edges().join(gone, ["lo", "hi"], "left_anti").select("lo", "hi")
