"""Response cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.vectors import dequantised
from tessella.operators.search import top_k_batch


def key(mode: Column, query: Column, kind: str | None = None) -> Column:
    """Key of a request: digest of kind, mode and query."""
    parts = F.concat(mode, query)
    return F.md5(F.encode(F.concat(F.lit(kind + ":"), parts) if kind else parts, "UTF-8"))


def exact(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached answer of each request, null for a miss."""
    return requests.join(cache.select("mode", "args_hash", "answer"), ["mode", "args_hash"], "left")


def similar(requests: DataFrame, cache: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Best cached row for each of ``requests(query_id, vector)`` by cosine of dequantised vectors, over the threshold."""
    stored = cache.select("id", dequantised(F.col("q"), F.col("low"), F.col("high")).alias("vector"))
    return top_k_batch(stored, requests, 1).where(F.col("similarity") > threshold).select("query_id", "id", "similarity")
