"""Queries on key-value tables, states and caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import cache, kv
from tessella.plans.bindings import PRELUDE
from tessella.plans.catalog import query

_OLD, _NEW = "id % 3 <> 0", "id % 2 = 0"
_NEW_SQL = "(SELECT id, content || '!' AS content, source FROM kv WHERE id % 2 = 0)"


def _sides(g):
    return g.kv().where(_OLD), g.kv().where(_NEW).withColumn("content", F.concat("content", F.lit("!")))


@query(PRELUDE + f"SELECT * FROM kv WHERE {_OLD} UNION ALL SELECT * FROM {_NEW_SQL} n WHERE id % 3 = 0")
def kv_insert_absent(g):
    return kv.insert_absent(*_sides(g))


@query(PRELUDE + f"SELECT * FROM {_NEW_SQL} n UNION ALL SELECT * FROM kv WHERE {_OLD} AND id % 2 <> 0")
def kv_upsert_overwrite(g):
    return kv.overwrite(*_sides(g))


@query(PRELUDE + "SELECT * FROM kv WHERE id NOT IN (SELECT doc_id FROM labels)")
def kv_delete(g):
    return kv.delete(g.kv(), g.statuses())


@query(PRELUDE + "SELECT id, content FROM kv WHERE id = 7")
def kv_get(g):
    return g.kv().where("id = 7").select("id", F.coalesce("content", F.lit("")).alias("content"))


def _wanted(g):
    return g.table("benchmark").select(F.col("item_id").alias("pos"), (F.col("item_id") * 37).alias("id"))


@query(PRELUDE + "SELECT item_id AS pos, item_id * 37 AS id, source FROM benchmark LEFT JOIN kv ON id = item_id * 37")
def kv_get_many(g):
    return kv.get_many(g.kv(), _wanted(g), fields=["source"])


@query(PRELUDE + "SELECT DISTINCT item_id * 37 AS id FROM benchmark WHERE item_id * 37 NOT IN (SELECT id FROM kv)")
def filter_keys(g):
    return kv.missing_keys(_wanted(g), g.kv())


@query(PRELUDE + "SELECT kv.id FROM kv LEFT JOIN statuses USING (id) WHERE status IS NULL OR status <> 'processed'")
def filter_keys_status(g):
    return kv.missing_or(g.kv(), g.statuses(), F.col("status") != "processed")


@query(PRELUDE + "SELECT kv.id FROM kv LEFT JOIN statuses USING (id) WHERE status IS NULL OR status = 'failed'")
def docs_to_process(g):
    return kv.missing_or(g.kv(), g.statuses(), F.col("status") == "failed")


@query(PRELUDE + "SELECT id FROM kv")
def kv_keys(g):
    return g.kv().select("id")


@query(PRELUDE + "SELECT id, status FROM statuses WHERE status IN ('failed', 'pending')")
def docs_by_status(g):
    return g.statuses().where("status in ('failed', 'pending')")


@query(PRELUDE + "SELECT id, CASE WHEN id IN (3, 9, 100) THEN 'pending' ELSE status END AS status FROM statuses")
def status_change(g):
    return kv.change_status(g.statuses(), [3, 9, 100], "pending")


@query(PRELUDE + "SELECT s AS status, count(statuses.id) AS n FROM (VALUES ('pending'), ('processing'), ('processed'), ('failed')) v(s) LEFT JOIN statuses ON status = s GROUP BY s")
def status_counts(g):
    return kv.status_counts(g.statuses())


@query(PRELUDE + "SELECT status, count(*) AS n FROM statuses GROUP BY status")
def status_counts_sparse(g):
    return kv.status_counts(g.statuses(), fill=False)


@query(PRELUDE + "SELECT id, source FROM kv WHERE source = 'src3'")
def workspace_filter(g):
    return g.kv().where("source = 'src3'").select("id", "source")


@query(PRELUDE + "SELECT id, content FROM chunks JOIN (SELECT DISTINCT chunk_id FROM em WHERE src = 'S7') ON id = chunk_id")
def chunks_by_doc(g):
    return g.chunks().join(g.edge_mentions().where("src = 'S7'").select(F.col("chunk_id").alias("id")), "id", "left_semi")


@query(PRELUDE + "SELECT coalesce(status, 'pending') AS stage, count(*) AS n FROM kv LEFT JOIN statuses USING (id) GROUP BY 1")
def pipeline_state(g):
    return g.kv().join(g.statuses(), "id", "left").groupBy(F.coalesce("status", F.lit("pending")).alias("stage")).agg(F.count("*").alias("n"))


_CACHE_SQL = "cache AS (SELECT item_id AS id, CASE WHEN item_id % 2 = 0 THEN 'local' ELSE 'global' END AS mode, md5('query:' || CASE WHEN item_id % 2 = 0 THEN 'local' ELSE 'global' END || text) AS args_hash, text || '!' AS answer FROM benchmark WHERE item_id % 3 <> 0)"


def _cache(g, some: str = "item_id % 3 <> 0"):
    mode = F.when(F.col("item_id") % 2 == 0, "local").otherwise("global")
    return g.table("benchmark").where(some).select(F.col("item_id").alias("id"), mode.alias("mode"), cache.key(mode, F.col("text"), "query").alias("args_hash"), F.concat("text", F.lit("!")).alias("answer"))


@query(PRELUDE + f", {_CACHE_SQL}, r AS (SELECT item_id AS id, CASE WHEN item_id % 2 = 0 THEN 'local' ELSE 'global' END AS mode, text FROM benchmark) SELECT r.id, r.mode, md5('query:' || r.mode || text) AS args_hash, answer FROM r LEFT JOIN cache ON cache.mode = r.mode AND args_hash = md5('query:' || r.mode || text)")
def cache_exact(g):
    return cache.exact(_cache(g, "true").drop("answer"), _cache(g))


@query(PRELUDE + f", {_CACHE_SQL} SELECT id, mode, args_hash, answer FROM cache WHERE mode = 'local' AND id = 4")
def cache_get(g):
    return _cache(g).where("mode = 'local' and id = 4")


@query(PRELUDE + f", {_CACHE_SQL} SELECT mode, count(*) AS n, min(args_hash) AS first FROM cache GROUP BY mode")
def cache_nest(g):
    nested = kv.nested_by_mode(_cache(g))
    return nested.select("mode", F.size("entries").cast("long").alias("n"), F.array_min(F.map_keys("entries")).alias("first"))


@query(PRELUDE + f", {_CACHE_SQL} SELECT item_id AS id, CASE WHEN item_id % 2 = 0 THEN 'local' ELSE 'global' END AS mode, md5('query:' || CASE WHEN item_id % 2 = 0 THEN 'local' ELSE 'global' END || text) AS args_hash, 'new' AS answer FROM benchmark WHERE item_id % 4 = 0 UNION ALL SELECT * FROM cache WHERE id % 4 <> 0")
def cache_upsert(g):
    return kv.overwrite(_cache(g), _cache(g, "item_id % 4 = 0").withColumn("answer", F.lit("new")), "args_hash").select("id", "mode", "args_hash", "answer")
