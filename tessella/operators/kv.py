"""Key-value tables and document states: lookups, upserts, deletes and status counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("pending", "processing", "processed", "failed")


def insert_absent(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Old rows, and new ones under keys that are not there yet (K3)."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def overwrite(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows, and old ones under other keys (K4)."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def delete(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not among ``ids`` (K7); missing ids are ignored."""
    return table.join(ids.select(key), key, "left_anti")


def get_many(table: DataFrame, wanted: DataFrame, key: str = "id", fields: list[str] | None = None) -> DataFrame:
    """One row for each of ``wanted(pos, key)``, in order, with nulls for keys that are missing (F2)."""
    found = table if fields is None else table.select(key, *fields)
    return wanted.join(found, key, "left").orderBy("pos")


def missing_keys(wanted: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """Keys that the table does not have."""
    return wanted.select(key).distinct().join(table.select(key), key, "left_anti")


def missing_or(wanted: DataFrame, status: DataFrame, retry: Column, key: str = "id") -> DataFrame:
    """Keys that have no status row or one that ``retry`` holds for."""
    return wanted.select(key).distinct().join(status, key, "left").where(F.col("status").isNull() | retry).select(key)


def change_status(table: DataFrame, ids: list, status: str, key: str = "id") -> DataFrame:
    """Status of the given documents changed."""
    return table.withColumn("status", F.when(F.col(key).isin(ids), F.lit(status)).otherwise(F.col("status")))


def status_counts(table: DataFrame, fill: bool = True) -> DataFrame:
    """Documents in each state; with ``fill`` states without any too (A5)."""
    counts = table.groupBy("status").agg(F.count("*").alias("n"))
    if not fill:
        return counts
    every = table.sparkSession.createDataFrame([(s,) for s in STATES], "status string")
    return every.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def nested_by_mode(cache: DataFrame) -> DataFrame:
    """One row for each mode with a map from key to answer."""
    return cache.groupBy("mode").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("args_hash", "answer")))).alias("entries"))
