"""Retrieval queries: joins on hits, rankings and the query modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella import hooks
from tessella.operators import context, graph, ranking, sections
from tessella.plans.bindings import BUDGET, PRELUDE, TOP_K, sql_tokens
from tessella.plans.catalog import query


def _tok(x: str) -> str:
    return f"len({sql_tokens(x)})"


def _budget(source: str, order: str, text: str, columns: str, budget: int = BUDGET) -> str:
    """SQL of a token-budget prefix, rows numbered from 0."""
    return f"(SELECT row_number() OVER (ORDER BY {order}) - 1 AS id, {columns} FROM (SELECT *, sum({_tok(text)}) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS running FROM {source}) WHERE running <= {budget})"


# joins on hits


_LOCAL_E = "(SELECT pos, nodes.id, entity_type, description, coalesce(degree, 0) AS rank FROM eh JOIN nodes ON nodes.id = eh.id LEFT JOIN degree ON degree.id = eh.id)"


@query(PRELUDE + f"SELECT * FROM {_LOCAL_E} x")
def hits_to_nodes(g):
    return sections.entities_at_hits(g)


_GLOBAL_R = "(SELECT pos, ranked.lo, ranked.hi, description, keywords, weight, rank FROM rh JOIN ranked ON ranked.lo = rh.lo AND ranked.hi = rh.hi)"


@query(PRELUDE + f"SELECT * FROM {_GLOBAL_R} x")
def hits_to_edges(g):
    return sections.edges_at_hits(g)


@query(PRELUDE + "SELECT DISTINCT eh.id, cited.chunk_id FROM eh JOIN cited ON cited.id = eh.id JOIN chunks ON chunks.id = chunk_id")
def entity_chunks(g):
    each = g.entity_hits().join(g.nodes().select("id", F.explode("source_ids").alias("chunk_id")), "id")
    return each.join(g.chunks().select(F.col("id").alias("chunk_id")), "chunk_id").select("id", "chunk_id").distinct()


_ENDS = "(SELECT id, min(pos * 2 + side) AS place FROM (SELECT pos, 0 AS side, lo AS id FROM rh UNION ALL SELECT pos, 1, hi FROM rh) GROUP BY id)"


@query(PRELUDE + f"SELECT e.id, place, entity_type, degree FROM {_ENDS} e JOIN nodes ON nodes.id = e.id JOIN degree ON degree.id = e.id")
def edge_entities(g):
    ends = ranking.endpoints(g.edge_hits()).select("id", (F.col("at.pos") * 2 + F.col("at.side")).alias("place"))
    nodes = g.nodes().join(ends.select("id"), "id", "left_semi").select("id", "entity_type")
    return ends.join(nodes, "id").join(graph.degrees_of(g.edges(), ends), "id")


@query(PRELUDE + "SELECT pos, ch.id, content FROM ch JOIN chunks ON chunks.id = ch.id")
def hits_to_chunks(g):
    return g.chunk_hits().join(g.chunks(), "id").select("pos", "id", "content")


# sections of the modes, columns as in the reference's contexts

_ENTITY, _RELATION, _SOURCE = ["entity", "type", "description", "rank"], ["source", "target", "description", "keywords", "weight", "rank"], ["content"]


_LE = f"(SELECT row_number() OVER (ORDER BY pos) - 1 AS id, x.id AS entity, entity_type AS type, description, rank FROM {_LOCAL_E} x)"


@query(PRELUDE + f"SELECT * FROM {_LE} x")
def local_entities(g):
    return sections.local_entity_rows(g)


_RELATED = "(SELECT * FROM ranked WHERE lo IN (SELECT id FROM eh) OR hi IN (SELECT id FROM eh))"


@query(PRELUDE + f"SELECT lo, hi, rank, weight FROM {_RELATED} x")
def related_edges(g):
    return ranking.related_edges(g.edges_touching(g.entity_hits()), g.degrees_at).select("lo", "hi", "rank", "weight")


_EDGE_COLUMNS = "lo AS source, hi AS target, description, keywords, weight, rank"
_LR = _budget(_RELATED, "rank DESC, weight DESC, lo, hi", "description", _EDGE_COLUMNS)


@query(PRELUDE + f"SELECT * FROM {_LR} x")
def local_relations(g):
    return sections.local_relation_rows(g)


_CHUNKS_E = """(SELECT l.chunk_id, l.place, coalesce(n, 0) AS relations, content FROM (SELECT chunk_id, max(pos) AS place, max_by(eh.id, pos) AS id FROM eh JOIN cited ON cited.id = eh.id GROUP BY chunk_id) l
    LEFT JOIN (SELECT l.chunk_id, count(DISTINCT c.id) AS n FROM (SELECT chunk_id, max_by(eh.id, pos) AS id FROM eh JOIN cited ON cited.id = eh.id GROUP BY chunk_id) l JOIN adj ON adj.src = l.id JOIN cited c ON c.id = adj.dst AND c.chunk_id = l.chunk_id GROUP BY l.chunk_id) r ON r.chunk_id = l.chunk_id
    JOIN chunks ON chunks.id = l.chunk_id)"""


@query(PRELUDE + f"SELECT chunk_id, place, relations FROM {_CHUNKS_E} x")
def related_chunks_entity(g):
    return sections.entity_chunk_rows(g).select("chunk_id", F.col("at").alias("place"), "relations")


_LS = _budget(_CHUNKS_E, "place, relations DESC, chunk_id", "content", "content")


@query(PRELUDE + f"SELECT * FROM {_LS} x")
def local_sources(g):
    return sections.local_source_rows(g)


_CHUNKS_R = "(SELECT chunk_id, place, content FROM (SELECT chunk_id, min(pos) AS place FROM (SELECT rh.pos, unnest(edges.source_ids) AS chunk_id FROM rh JOIN edges ON edges.lo = rh.lo AND edges.hi = rh.hi) GROUP BY chunk_id) s JOIN chunks ON chunks.id = chunk_id)"


@query(PRELUDE + f"SELECT chunk_id, place FROM {_CHUNKS_R} x")
def related_chunks_edge(g):
    return sections.edge_chunk_rows(g).select("chunk_id", F.col("at").alias("place"))


_GR = _budget(_GLOBAL_R, "rank DESC, weight DESC, lo, hi", "description", _EDGE_COLUMNS)


@query(PRELUDE + f"SELECT * FROM {_GR} x", name="global_relations")
def global_relations(g):
    return sections.global_relation_rows(g)


@query(PRELUDE + f"SELECT lo, hi, rank, weight FROM {_GLOBAL_R} x ORDER BY rank DESC, weight DESC, lo, hi")
def global_edges(g):
    return sections.edges_at_hits(g).select("lo", "hi", "rank", "weight").orderBy(*sections.edge_order())


_GE = _budget(f"(SELECT e.id AS entity, e.place, entity_type, description, degree AS rank FROM {_ENDS} e JOIN nodes ON nodes.id = e.id JOIN degree ON degree.id = e.id)", "place", "description", "entity, entity_type AS type, description, rank")


@query(PRELUDE + f"SELECT * FROM {_GE} x")
def global_entities(g):
    return sections.global_entity_rows(g)


_GS = _budget(_CHUNKS_R, "place, chunk_id", "content", "content")


@query(PRELUDE + f"SELECT * FROM {_GS} x")
def global_sources(g):
    return sections.global_source_rows(g)


def _combined_sql(first: str, second: str, columns: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY side, id) AS id, {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {columns} ORDER BY side, id) AS rn FROM (SELECT 0 AS side, * FROM {first} a UNION ALL SELECT 1, * FROM {second} b)) WHERE rn = 1"


@query(PRELUDE + _combined_sql(_GE, _LE, "entity, type, description, rank"))
def hybrid_entities(g):
    return context.combine(sections.global_entity_rows(g), sections.local_entity_rows(g), _ENTITY)


@query(PRELUDE + _combined_sql(_GR, _LR, "source, target, description, keywords, weight, rank"))
def hybrid_relations(g):
    return context.combine(sections.global_relation_rows(g), sections.local_relation_rows(g), _RELATION)


@query(PRELUDE + _combined_sql(_GS, _LS, "content"))
def hybrid_sources(g):
    return context.combine(sections.global_source_rows(g), sections.local_source_rows(g), _SOURCE)


@query("SELECT row_number() OVER (ORDER BY side, n) AS id, name, region FROM (SELECT name, region, min(side) AS side, min_by(n, side) AS n FROM (SELECT 0 AS side, n_nationkey AS n, n_name AS name, n_regionkey AS region FROM nation WHERE n_nationkey < 15 UNION ALL SELECT 1, n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey > 8) GROUP BY name, region)")
def combine_contexts(g):
    rows = g.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return context.combine(rows.where("id < 15"), rows.where("id > 8"), ["name", "region"])


_NAIVE = f"(SELECT pos, content FROM (SELECT *, sum({_tok('content')}) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS running FROM (SELECT pos, content FROM ch JOIN chunks ON chunks.id = ch.id)) WHERE running <= {BUDGET})"


@query(PRELUDE + f"SELECT string_agg(content, chr(10) || '--New Chunk--' || chr(10) ORDER BY pos) AS context FROM {_NAIVE} x")
def naive_context(g):
    return context.joined_chunks(sections.naive_rows(g), place="pos")


@query(PRELUDE + f"SELECT pos, '[Time: 2024-01-01 00:00:' || lpad(CAST(pos AS VARCHAR), 2, '0') || ']' || chr(10) || content AS content FROM (SELECT pos, content FROM ch JOIN chunks ON chunks.id = ch.id WHERE pos < {min(10, TOP_K)}) x")
def mix_chunks(g):
    hits = g.chunk_hits().where(F.col("pos") < min(10, TOP_K)).join(g.chunks(), "id")
    time = context.created_at(F.lit(1704067200) + F.col("pos"))
    return hits.select("pos", F.concat(F.lit("[Time: "), time, F.lit("]\n"), F.col("content")).alias("content"))


# cuts


@query(f"SELECT doc_id, source FROM (SELECT doc_id, source, sum({_tok('text')}) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents) WHERE running <= 3000")
def token_budget(g):
    rows = g.table("documents").select("doc_id", "source", "text")
    return ranking.token_budget(rows, "text", 3000, [F.col("doc_id")], ["source"]).select("doc_id", "source")


def _scores(g):
    return g.table("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("query_id"), F.length("text").cast("double").alias("score"))


_SCORES = "scores AS (SELECT doc_id AS id, source AS query_id, CAST(length(text) AS DOUBLE) AS score FROM documents)"


@query(f"WITH {_SCORES}, r AS (SELECT *, row_number() OVER w AS rn, lag(score) OVER w AS before FROM scores WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, id)), f AS (SELECT *, max(CASE WHEN rn > 5 AND NOT (score > before / 1.1) THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS failed FROM r) SELECT id, query_id, score, rn FROM f WHERE failed = 0")
def gradient_select(g):
    return ranking.gradient_select(_scores(g), 5, 1.1)


@query(f"WITH {_SCORES}, r AS (SELECT *, row_number() OVER w AS rn, lag(score) OVER w AS before FROM scores WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, id)), f AS (SELECT *, max(CASE WHEN rn > 1 AND NOT (score - before > -900) THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS failed FROM r) SELECT id, query_id, score, rn FROM f WHERE failed = 0 OR rn <= 4")
def gradient_select_diff(g):
    return ranking.gradient_select_difference(_scores(g), 4, -900.0)


_ASKED = "the of and une der"
_OVERLAP = f"CASE WHEN length(text) % 10 > 0 THEN CAST(len(list_intersect(list_distinct({sql_tokens('text')}), string_split('{_ASKED}', ' '))) AS DOUBLE) END"


def _overlap(query: str, texts: list[str]) -> list[float | None]:
    """A stand-in scorer: words of the query that a text has; every tenth length has no score."""
    words = set(query.split())
    return [float(len(words & set(t.split()))) if len(t) % 10 else None for t in texts]


@query(f"WITH s AS (SELECT doc_id AS id, source AS query_id, {_OVERLAP} AS score FROM documents WHERE text IS NOT NULL) SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, id) - 1 AS place FROM s")
def rerank_order(g):
    rows = g.table("documents").where("text is not null").select(F.col("doc_id").alias("id"), F.col("source").alias("query_id"), "text", F.lit(_ASKED).alias("query"))
    scored = hooks.scored(rows, _overlap, "text", "query")
    return ranking.ranked_all(scored).select("query_id", "id", "score", "place")


_MIX = "(SELECT 0 AS query_id, pos AS id, content, list_sum([CAST(ascii(x) AS DOUBLE) for x in string_split(content, '')]) AS score FROM (SELECT pos, content FROM ch JOIN chunks ON chunks.id = ch.id))"


@query(PRELUDE + f", r AS (SELECT *, row_number() OVER w AS rn, lag(score) OVER w AS before FROM {_MIX} m WINDOW w AS (ORDER BY score DESC, id)), f AS (SELECT *, max(CASE WHEN rn > 3 AND NOT (score > before / 1.05) THEN 1 ELSE 0 END) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING) AS failed FROM r) SELECT string_agg(rn || '. ' || content, chr(10) ORDER BY rn) AS context FROM f WHERE failed = 0")
def mix_gradient(g):
    rows = g.chunk_hits().join(g.chunks(), "id").select(F.lit(0).alias("query_id"), F.col("pos").alias("id"), "content", F.lit("q").alias("query"))
    rows = hooks.scored(rows, lambda query, texts: [float(sum(map(ord, t))) for t in texts], "content", "query")
    kept = ranking.gradient_select(rows, 3, 1.05).select("rn", F.concat(F.col("rn").cast("string"), F.lit(". "), F.col("content")).alias("line"))
    return kept.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "line"))), lambda x: x["line"]), "\n").alias("context"))


_MODE = "CASE event_id % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'global' WHEN 2 THEN 'hybrid' ELSE 'naive' END"


@query(f"SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 5 = 0 THEN 'fail' WHEN event_id % 5 = 0 AND {_MODE} IN ('local', 'hybrid') THEN 'global' WHEN event_id % 3 = 0 AND {_MODE} IN ('global', 'hybrid') THEN 'local' ELSE {_MODE} END AS mode FROM events")
def resolve_mode(g):
    words = lambda n: F.when(F.col("event_id") % n == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("w")))
    return g.table("events").select("event_id", context.resolve_mode(F.expr(_MODE), words(3), words(5)).alias("mode"))


@query("SELECT event_id, event_type || ', a, ' || user_id AS keywords FROM events")
def flatten_keywords(g):
    lists = F.array(F.array("event_type", F.lit("a")), F.array(F.col("user_id").cast("string")))
    return g.table("events").select("event_id", context.flattened_keywords(lists).alias("keywords"))


@query("SELECT item_id, text || chr(10) || chr(10) || '### Keywords:' || chr(10) || 'HIGH-LEVEL: x, ' || item_id || chr(10) || 'LOW-LEVEL: y' AS prompt FROM benchmark")
def keyword_prompt(g):
    return g.table("benchmark").select("item_id", context.keyword_prompt(F.col("text"), F.array(F.lit("x"), F.col("item_id").cast("string")), F.array(F.lit("y"))).alias("prompt"))
