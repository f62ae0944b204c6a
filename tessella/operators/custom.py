"""Prebuilt graphs: entities, relationships and chunks that name their sources by label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import hash_id, strip

UNKNOWN = "UNKNOWN"


def chunk_map(chunks: DataFrame) -> DataFrame:
    """Chunk id of each label in ``chunks(pos, content, source_id)``; a later label wins."""
    ids = chunks.select("source_id", "pos", hash_id("chunk-", strip(F.col("content"))).alias("chunk_id"))
    return ids.groupBy("source_id").agg(F.max_by("chunk_id", "pos").alias("chunk_id"))


def _sourced(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    return rows.join(chunks, "source_id", "left").drop("source_id").withColumn("source_id", F.coalesce("chunk_id", F.lit(UNKNOWN))).drop("chunk_id")


def edges(relations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges with upper-case ends and weight 1 where none is given."""
    found = _sourced(relations, chunks)
    return found.select(F.upper("src_id").alias("src"), F.upper("tgt_id").alias("tgt"), F.coalesce("weight", F.lit(1.0)).alias("weight"), "description", "keywords", "source_id")


def nodes(entities: DataFrame, relations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Entities, the last of equal names, and unknown nodes for ends that no entity has."""
    named = _sourced(entities, chunks).select("pos", F.upper("entity_name").alias("id"), F.coalesce("entity_type", F.lit(UNKNOWN)).alias("entity_type"), F.coalesce("description", F.lit("No description provided")).alias("description"), "source_id")
    known = named.groupBy("id").agg(F.max_by(F.struct("entity_type", "description", "source_id"), "pos").alias("x")).select("id", "x.*")
    ends = _sourced(relations, chunks).select("pos", "source_id", F.explode(F.array(F.upper("src_id"), F.upper("tgt_id"))).alias("id"))
    fresh = ends.groupBy("id").agg(F.min_by("source_id", "pos").alias("source_id")).join(known.select("id"), "id", "left_anti")
    return known.unionByName(fresh.select("id", F.lit(UNKNOWN).alias("entity_type"), F.lit(UNKNOWN).alias("description"), "source_id"))
