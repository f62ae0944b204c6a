"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella import hooks
from tessella.operators import evaluation
from tessella.plans.bindings import sql_strip
from tessella.plans.catalog import query


@query("WITH known AS (SELECT text AS question, min(doc_id) AS reference FROM documents WHERE text IS NOT NULL GROUP BY text) SELECT doc_id, source AS response, reference FROM documents JOIN known ON text = question")
def eval_reference_join(g):
    """Responses meet references by the text of their question."""
    asked = g.table("documents").select("doc_id", F.col("source").alias("response"), F.col("text").alias("question"))
    known = asked.where("question is not null").groupBy("question").agg(F.min("doc_id").alias("reference"))
    return asked.join(known, "question").select("doc_id", "response", "reference")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def eval_resume(g):
    return evaluation.resume(g.table("documents").select("doc_id"), g.table("labels"), "doc_id")


@query("SELECT count(*) AS total, (SELECT count(DISTINCT doc_id) FROM labels) AS done, round(100.0 * (SELECT count(DISTINCT doc_id) FROM labels) / count(*), 4) AS percent FROM documents")
def eval_progress(g):
    joined = g.table("documents").select("doc_id").join(g.table("labels").select("doc_id", F.lit(1).alias("x")).distinct(), "doc_id", "left")
    return joined.agg(F.count("*").alias("total"), F.count("x").alias("done")).withColumn("percent", F.round(F.col("done") * 100.0 / F.col("total"), 4))


_FULL = "CASE WHEN p_size % 5 = 0 THEN '{\"coverage\": 1}' WHEN p_size % 7 = 0 THEN 'no json' ELSE '{\"coverage\": ' || p_size || '.25, \"depth\": 2.5, \"hierarchy\": 3, \"semantic_connectivity\": 4, \"global_understanding\": 1.123456}' END"


@query("SELECT p_partkey, CASE WHEN bad THEN 0.0 ELSE round((p_size + 0.25 + 2.5 + 3 + 4 + 1.123456) * 0.2, 4) END::DOUBLE AS score, CASE WHEN bad THEN 0.0 ELSE p_size + 0.25 END::DOUBLE AS coverage, CASE WHEN bad THEN 0.0 ELSE 1.1235 END::DOUBLE AS global_understanding FROM (SELECT *, p_size % 5 = 0 OR p_size % 7 = 0 AS bad FROM part)")
def diversity_score(g):
    return g.table("part").select("p_partkey", evaluation.diversity(F.expr(_FULL)).alias("d")).select("p_partkey", "d.score", "d.coverage", "d.global_understanding")


@query("SELECT source, round(stddev_pop(length(text)), 6) AS deviation FROM documents GROUP BY source")
def score_stddev(g):
    return g.table("documents").groupBy("source").agg(F.round(F.stddev_pop(F.length("text")), 6).alias("deviation"))


@query("SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 10.0::DOUBLE ELSE value END AS score FROM events")
def score_sentinel(g):
    raw = F.when(F.col("event_id") % 6 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return g.table("events").select("event_id", evaluation.sentinel(raw).alias("score"))


@query("""WITH w AS (SELECT item_id, list_distinct(string_split(text, ' ')) AS ref FROM benchmark), d AS (SELECT doc_id, list_distinct(string_split(text, ' ')) AS own FROM documents)
    SELECT doc_id, round(len(list_intersect(own, ref)) / len(ref), 6) AS recall FROM d JOIN w ON doc_id % 40 = item_id""")
def entity_recall(g):
    responses = g.table("documents").select("doc_id", (F.col("doc_id") % 40).alias("item_id"), F.split("text", " ", -1).alias("own"))
    reference = g.table("benchmark").select("item_id", F.split("text", " ", -1).alias("ref"))
    return responses.join(reference, "item_id").select("doc_id", F.round(evaluation.entity_recall(F.col("own"), F.col("ref")), 6).alias("recall"))


@query("SELECT item_id, 'Q: ' || text || chr(10) || 'A1: ' || text || '!' || chr(10) || 'A2: ' || length(text) AS request FROM benchmark")
def pairwise_requests(g):
    q = g.table("benchmark").select("item_id", "text")
    one, two = q.select("item_id", F.concat("text", F.lit("!")).alias("a")), q.select("item_id", F.length("text").cast("string").alias("b"))
    return q.join(one, "item_id").join(two, "item_id").select("item_id", F.concat(F.lit("Q: "), F.col("text"), F.lit("\nA1: "), F.col("a"), F.lit("\nA2: "), F.col("b")).alias("request"))


@query("SELECT event_type, count(*) FILTER (WHERE value >= 5) AS ok, count(*) FILTER (WHERE value < 5) AS failed FROM events GROUP BY event_type")
def split_ok_err(g):
    error = F.when(F.col("value") < 5, F.lit("low"))
    return g.table("events").withColumn("error", error).groupBy("event_type").agg(F.count(F.when(F.col("error").isNull(), 1)).alias("ok"), F.count("error").alias("failed"))


def _measured(prompt: str, history: list[dict] | None = None) -> str:
    """A deterministic model: how long its prompt is, after its own words."""
    return f"It has {len(prompt)} characters"


@query("SELECT q.item_id AS question_id, d.doc_id AS context_id, 'It has ' || length(d.text || chr(10) || q.text) || ' characters' AS answer FROM benchmark q JOIN documents d ON d.doc_id % 40 = q.item_id WHERE d.text IS NOT NULL AND q.text IS NOT NULL")
def batch_answers(g):
    """Every document is the context of one question; a model answers all prompts, several at a time (Q12)."""
    asked = g.table("benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    contexts = g.table("documents").select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 40).alias("question_id"))
    prompts = contexts.join(asked, "question_id").select("id", F.concat("text", F.lit("\n"), "question").alias("prompt")).where("prompt is not null")
    answers = hooks.answered(prompts, _measured)
    return answers.select((F.col("id") % 40).alias("question_id"), F.col("id").alias("context_id"), "answer")


def _long_enough(rows: list[dict]) -> list[float]:
    """A deterministic judge in place of a model: the share of distinct words."""
    return [len(set(r["text"].split())) / max(len(r["text"].split()), 1) for r in rows]


_WORDS = f"CASE WHEN {sql_strip('text')} = '' THEN [] ELSE string_split_regex({sql_strip('text')}, '[\\s\\p{{Z}}]+') END"


@query(f"SELECT doc_id AS id, round(len(list_distinct(w)) / greatest(len(w), 1), 6) AS score, CAST(NULL AS VARCHAR) AS error FROM (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL)")
def judge_scores(g):
    rows = g.table("documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")
    return evaluation.judged(rows, _long_enough, ["text"]).withColumn("score", F.round("score", 6))


# deterministic verdicts: orders are responses, their lines claims, contexts follow from parts and suppliers

_BY_CONTEXT = "l_orderkey AS id, l_linenumber AS claim, CAST(l_partkey % 4 AS INTEGER) AS context, l_quantity > 25 AS supported"


def _verdicts(g, *columns):
    return g.table("lineitem").selectExpr(*columns)


@query(f"SELECT id, avg(CASE WHEN s THEN 1.0 ELSE 0.0 END) AS score FROM (SELECT id, claim, bool_or(supported) AS s FROM (SELECT {_BY_CONTEXT} FROM lineitem) GROUP BY id, claim) GROUP BY id")
def faithfulness(g):
    return evaluation.supported_share(_verdicts(g, *_BY_CONTEXT.split(", ")))


@query("""WITH o AS (SELECT l_orderkey AS id, l_linenumber AS context, bool_or(l_discount > 0.04) AS useful FROM lineitem GROUP BY 1, 2), v AS (SELECT id, useful, row_number() OVER (PARTITION BY id ORDER BY context) AS place FROM o),
    p AS (SELECT id, place, useful, sum(CASE WHEN useful THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY place) AS hits FROM v)
    SELECT id, round(coalesce(sum(hits / place) FILTER (WHERE useful) / nullif(count(*) FILTER (WHERE useful), 0), 0.0), 6) AS score FROM p GROUP BY id""")
def context_precision(g):
    found = _verdicts(g, "l_orderkey AS id", "l_linenumber AS context", "l_discount > 0.04 AS useful")
    return evaluation.context_precision(found).withColumn("score", F.round("score", 6))


@query(f"""WITH a AS (SELECT {_BY_CONTEXT} FROM lineitem), r AS (SELECT DISTINCT l_orderkey AS id, CAST(l_suppkey % 4 AS INTEGER) AS context FROM lineitem WHERE l_discount > 0.05),
    m AS (SELECT DISTINCT a.id, a.claim FROM a JOIN r ON a.id = r.id AND a.context = r.context WHERE a.supported),
    k AS (SELECT l_orderkey AS id, l_linenumber AS claim, bool_or(l_tax > 0.04) AS good FROM lineitem GROUP BY 1, 2)
    SELECT k.id, round(avg(CASE WHEN m.claim IS NOT NULL AND NOT good THEN 1.0 ELSE 0.0 END), 6) AS score FROM k LEFT JOIN m ON k.id = m.id AND k.claim = m.claim GROUP BY k.id""")
def noise_sensitivity(g):
    reference = _verdicts(g, "l_orderkey AS id", "l_linenumber AS claim", "CAST(l_suppkey % 4 AS INTEGER) AS context", "l_discount > 0.05 AS supported")
    known = _verdicts(g, "l_orderkey AS id", "l_linenumber AS claim", "l_tax > 0.04 AS supported")
    return evaluation.noise_sensitivity(_verdicts(g, *_BY_CONTEXT.split(", ")), reference, known).withColumn("score", F.round("score", 6))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.vec_id AS id, list_cosine_similarity(a.e, b.e) AS s, b.vec_id % 3 = 0 AS none FROM v a JOIN v b ON b.vec_id IN (a.vec_id + 1, a.vec_id + 3))
    SELECT id, round(CASE WHEN bool_and(none) THEN 0.0 ELSE avg(s) END, 6) AS score FROM p GROUP BY id""")
def response_relevancy(g):
    each = g.vectors().select("id", "vector", F.explode(F.array(F.lit(1), F.lit(3))).alias("away"))
    near = each.select((F.col("id") - F.col("away")).alias("id"), "vector", (F.col("id") % 3 == 0).alias("noncommittal"))
    return evaluation.response_relevancy(g.vectors().select("id", "vector"), near).withColumn("score", F.round("score", 6))
