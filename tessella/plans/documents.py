"""Queries on sources, chunking and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella import hooks
from tessella.functions import text as tx
from tessella.operators import chunking, extraction
from tessella.plans.bindings import PRELUDE, sql_strip, sql_tokens
from tessella.plans.catalog import query

_STRIPPED = sql_strip("text")


@query(f"SELECT 'doc-' || md5(content) AS id, content, CASE WHEN length(content) > 100 THEN substr(content, 1, 100) || '...' ELSE content END AS content_summary, length(content) AS content_length FROM (SELECT DISTINCT {_STRIPPED} AS content FROM documents)")
def doc_ingest(g):
    return chunking.ingest(g.documents())


def _sql_windows(tokens: str, size: int, step: int) -> str:
    return f"SELECT doc_id, k AS chunk_order_index, least({size}, len(w) - k * {step}) AS tokens, array_to_string(list_slice(w, k * {step} + 1, k * {step} + {size}), ' ') AS content FROM (SELECT doc_id, w, unnest(generate_series(0, (len(w) - 1) // {step})) AS k FROM ({tokens}) WHERE len(w) > 0)"


@query(f"SELECT *, 'chunk-' || md5(content) AS id FROM ({_sql_windows(f'SELECT doc_id, {sql_tokens("text")} AS w FROM documents', 120, 100)})")
def chunk_tokens(g):
    return chunking.by_tokens(g.documents(), 120, 20)


_PIECES = "SELECT doc_id, p[k] AS piece, k FROM (SELECT doc_id, p, unnest(generate_series(1, len(p))) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"


@query(f"SELECT doc_id, k - 1 AS chunk_order_index, len({sql_tokens('piece')}) AS tokens, {sql_strip('piece')} AS content, 'chunk-' || md5({sql_strip('piece')}) AS id FROM ({_PIECES})")
def chunk_split_only(g):
    return chunking.by_separator(g.documents(), "\n")


@query(f"""WITH p AS (SELECT doc_id, k, piece, {sql_tokens("piece")} AS w FROM ({_PIECES})),
    c AS (SELECT doc_id, k, 0 AS j, len(w) AS tokens, {sql_strip("piece")} AS content FROM p WHERE len(w) <= 40
          UNION ALL SELECT doc_id, k, j, least(40, len(w) - j * 30), array_to_string(list_slice(w, j * 30 + 1, j * 30 + 40), ' ') FROM (SELECT *, unnest(generate_series(0, (len(w) - 1) // 30)) AS j FROM p WHERE len(w) > 40))
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS chunk_order_index, tokens, content, 'chunk-' || md5(content) AS id FROM c""")
def chunk_split_then_tokens(g):
    return chunking.by_separator_then_tokens(g.documents(), "\n", 40, 10)


@query("SELECT doc_id, k AS chunk_order_index, substr(text, k * 250 + 1, 300) AS content FROM (SELECT doc_id, text, unnest(generate_series(0, (length(text) - 1) // 250)) AS k FROM documents WHERE text <> '')")
def chunk_chars(g):
    return chunking.by_characters(g.documents())


@query()
def chunk_separated(g):
    """Lines of every document put together to chunks of 300 characters; a plain version is the test."""
    return chunking.by_separated_characters(g.documents(), separator="\n")


@query(f"WITH e AS (SELECT DISTINCT doc_id, {sql_strip('unnest(string_split(text, chr(10)))')} AS content, false AS x FROM documents) SELECT doc_id, 'chunk-' || md5(content) AS id, content FROM (SELECT doc_id, {sql_strip('piece')} AS content FROM ({_PIECES})) WHERE md5(content) NOT IN (SELECT md5({sql_strip('piece')}) FROM ({_PIECES}) WHERE doc_id % 5 = 0)")
def custom_chunks(g):
    given = g.documents().select("doc_id", F.split("text", "\n", -1).alias("chunks"))
    known = chunking.by_separator(g.documents().where("doc_id % 5 = 0"), "\n")
    return chunking.custom_chunks(given, known)


@query("SELECT doc_id, CAST(trunc(n * 1.5 + (length(text) - n) * 0.25) AS INTEGER) AS tokens FROM (SELECT doc_id, text, len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) AS n FROM documents)")
def estimate_tokens(g):
    return g.documents().select("doc_id", tx.estimated_tokens(F.col("text")).alias("tokens"))


@query("SELECT place // 10 AS batch, substr(string_agg(text, chr(10) ORDER BY place), 1, 500) AS source_comment FROM (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents) GROUP BY 1")
def group_comments(g):
    return chunking.grouped_comments(g.documents())


# sources


@query("SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 60 OFFSET 120")
def page_scan(g):
    return g.documents().orderBy("doc_id").offset(120).limit(60)


@query("WITH j AS (SELECT event_id, event_type || '-' || CAST(json_extract_string(props, '$.k') AS INTEGER) AS context FROM events) SELECT context, min(event_id) AS first FROM j WHERE context IS NOT NULL GROUP BY context")
def unique_contexts(g):
    line = F.when(F.col("event_id") % 50 == 0, "{broken").otherwise(F.to_json(F.struct(F.concat_ws("-", "event_type", F.get_json_object("props", "$.k")).alias("context"))))
    from tessella.sources.files import unique_contexts as first_of

    lines = g.table("events").select(F.col("event_id").alias("pos"), line.alias("value"))
    whole = g.table("events").select(F.col("event_id").alias("pos"), F.to_json(F.struct(F.concat_ws("-", "event_type", F.get_json_object("props", "$.k")).alias("context"))).alias("value"))
    return first_of(whole.unionByName(lines.where("value = '{broken'"))).select("context", F.col("pos").alias("first"))


@query("SELECT item_id AS doc, item_id % 3 + 1 AS number, text AS question FROM (SELECT item_id, replace(text, chr(10), ' ') AS text FROM benchmark)")
def extract_questions(g):
    from tessella.sources.files import questions

    text = F.concat(F.lit("intro\n- **Question "), (F.col("item_id") % 3 + 1).cast("string"), F.lit("**: "), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\nend"))
    return questions(g.table("benchmark").select(F.col("item_id").alias("doc"), text.alias("text")))


@query("SELECT page_id, regexp_extract(lower(url), '[^/]*$') AS name FROM pages WHERE regexp_matches(lower(url), '[.](html|htm)$') AND page_id % 3 <> 0")
def scan_new_files(g):
    from tessella.sources.files import new_files

    listed = g.table("pages").select("page_id", F.lower("url").alias("path"))
    known = listed.where("page_id % 3 = 0").select("page_id")
    return new_files(listed, known, ["html", "htm"], key="page_id").select("page_id", F.regexp_extract("path", "[^/]*$", 0).alias("name"))


# extraction

_RECORD = """'("entity"<|>"' || p_name || '"<|>"' || p_type || '"<|>"' || p_brand || ' &amp; co")##("relationship"<|>"' || p_name || '"<|>"' || p_brand || '"<|>made by<|>brand<|>' || CASE WHEN p_size % 4 = 0 THEN '1e5' ELSE CAST(p_size AS VARCHAR) || '.5' END || ')##(broken<|>x)##("entity"<|> <|>t<|>d)<|COMPLETE|>'"""
_RECORD_SPARK = _RECORD.replace("CAST(p_size AS VARCHAR)", "CAST(p_size AS STRING)")


def _answers(g):
    return g.table("part").select(F.col("p_partkey").alias("chunk_id"), F.expr(_RECORD_SPARK).alias("text"))


@query(f"SELECT p_partkey AS chunk_id, len(list_filter(string_split_regex(t, '##|<\\|COMPLETE\\|>'), lambda x: trim(x) <> '')) AS n FROM (SELECT p_partkey, {_RECORD} AS t FROM part)")
def split_markers(g):
    return _answers(g).select("chunk_id", F.size(extraction.split_markers(F.col("text"), ["##", "<|COMPLETE|>"])).alias("n"))


@query("SELECT p_partkey AS chunk_id, 0 AS pos, '\"' || upper(p_name) || '\"' AS entity_name, '\"' || upper(p_type) || '\"' AS entity_type, '\"' || p_brand || ' & co\"' AS description FROM part")
def parse_entities(g):
    return extraction.entities(_answers(g))


@query("SELECT p_partkey AS chunk_id, 0 AS pos, '\"' || upper(p_name) || '\"' AS entity_name, '\"' || p_type || '\"' AS description FROM part UNION ALL SELECT p_partkey, 3, 'T', 'd' FROM part")
def parse_entities_untyped(g):
    return extraction.entities(_answers(g), typed=False)


@query("SELECT p_partkey AS chunk_id, 1 AS pos, '\"' || upper(p_name) || '\"' AS src_id, '\"' || upper(p_brand) || '\"' AS tgt_id, 'made by' AS description, 'brand' AS keywords, CASE WHEN p_size % 4 = 0 THEN 1.0::DOUBLE ELSE p_size + 0.5::DOUBLE END AS weight FROM part")
def parse_relations(g):
    return extraction.relationships(_answers(g))


_CLEAN = sql_strip("html")


@query(f"SELECT page_id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace({_CLEAN}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;?', '&', 'g'), '[\\x00-\\x1f\\x7f-\\x{{9f}}]', '', 'g') AS clean FROM pages")
def clean_str(g):
    return g.table("pages").select("page_id", tx.clean(F.col("html")).alias("clean"))


@query("SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN '' ELSE label || ',all' END AS high, CASE WHEN vec_id % 7 = 0 THEN '' ELSE CAST(vec_id AS VARCHAR) END AS low FROM embeddings")
def parse_keywords(g):
    text = F.when(F.col("vec_id") % 7 == 0, "none").otherwise(F.concat(F.lit('Answer: {"high_level_keywords": ["'), F.col("label").cast("string"), F.lit('", "all"], \n\'low_level_keywords\': ["'), F.col("vec_id").cast("string"), F.lit('"]} done')))
    found = g.table("embeddings").select("vec_id", extraction.keywords(text).alias("k"))
    return found.select("vec_id", F.array_join("k.high", ",").alias("high"), F.array_join("k.low", ",").alias("low"))


@query("SELECT page_id, replace(replace(nullif(regexp_extract(html, '(?s)[{].*[}]'), ''), chr(10), ''), '''', '\"') AS body FROM pages")
def locate_json(g):
    return g.table("pages").select("page_id", tx.json_body(F.col("html")).alias("body"))


_MODES = "CASE item_id % 4 WHEN 0 THEN '/local ' WHEN 1 THEN '/mix   ' WHEN 2 THEN '/other ' ELSE '' END"


@query(f"SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'mix' ELSE 'hybrid' END AS mode, CASE WHEN item_id % 4 = 2 THEN '/other ' ELSE '' END || text AS query FROM benchmark")
def parse_query_mode(g):
    text = F.concat(F.expr(_MODES), F.col("text"))
    return g.table("benchmark").select("item_id", extraction.query_mode(text).alias("m")).select("item_id", "m.mode", "m.query")


@query("""WITH o AS (SELECT conv_id, role, text, row_number() OVER w - 1 AS i, lead(role) OVER w AS role2, lead(text) OVER w AS text2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    k AS (SELECT conv_id, i, CASE WHEN role = 'user' THEN 'user: ' || text || chr(10) || 'assistant: ' || text2 ELSE 'user: ' || text2 || chr(10) || 'assistant: ' || text END AS line,
          row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM o WHERE i % 2 = 0 AND ((role = 'user' AND role2 = 'assistant') OR (role = 'assistant' AND role2 = 'user')))
    SELECT conv_id, string_agg(line, chr(10) ORDER BY i) AS history FROM k WHERE back <= 2 GROUP BY conv_id""")
def conversation_turns(g):
    return extraction.conversation_turns(g.table("conversations"), 2)


@query("SELECT item_id, i AS place, CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, p[i + 1] AS content FROM (SELECT item_id, p, unnest(generate_series(0, len(p) - 1)) AS i FROM (SELECT item_id, string_split(text, chr(10)) AS p FROM benchmark))")
def pack_messages(g):
    return g.table("benchmark").select("item_id", F.posexplode(extraction.packed_messages(F.split("text", "\n", -1))).alias("place", "m")).select("item_id", "place", "m.role", "m.content")


_QUESTION = "split_part(text, ' ', 1) || CASE item_id % 5 WHEN 0 THEN '这是什么东西？' WHEN 1 THEN '，是吗？' WHEN 2 THEN '为什么会这样呢？' WHEN 3 THEN '好吗？？' ELSE '?' END"


@query(f"SELECT item_id, q AS question, length(q) > 6 AND ends_with(q, '？') AND length(q) - length(replace(q, '？', '')) = 1 AND NOT contains(q, '?') AND NOT contains(q, ',') AND NOT contains(q, '，') AND NOT regexp_matches(q, '答案|回答|建议|如何解决|怎么办|为什么') AS valid FROM (SELECT item_id, {_QUESTION} AS q FROM benchmark)")
def validate_question(g):
    q = F.expr(_QUESTION)
    return g.table("benchmark").select("item_id", q.alias("question")).withColumn("valid", extraction.valid_question(F.col("question")))


# scalar functions


@query("SELECT c_custkey, '\"' || replace(c_name, '\"', '\"\"') || '\",\"' || c_mktsegment || '\",\"' || c_nationkey || '\"' AS row FROM customer")
def csv_context(g):
    return g.table("customer").select("c_custkey", tx.csv_row(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")).alias("row"))


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS created_at FROM events")
def format_created_at(g):
    from tessella.operators.context import created_at

    return g.table("events").select("event_id", created_at(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("created_at"))


@query(f"SELECT item_id, CASE WHEN length(text) > 40 THEN {sql_strip("replace(replace(replace(text, 'the', ''), 'user', ''), 'model', '')")} ELSE text END AS response FROM benchmark")
def clean_response(g):
    from tessella.operators.context import clean_response as cleaned

    return g.table("benchmark").select("item_id", F.when(F.length("text") > 40, cleaned(F.col("text"), F.lit("the"), F.lit("<system>"))).otherwise(F.col("text")).alias("response"))


@query("SELECT item_id, 'Role: judge. Question: ' || text || ' Id: ' || item_id AS prompt FROM benchmark")
def render_prompt(g):
    from tessella.operators.context import rendered

    return g.table("benchmark").select("item_id", rendered("Role: judge. Question: {question} Id: {id}", question=F.col("text"), id=F.col("item_id").cast("string")).alias("prompt"))


@query("SELECT p_partkey, 'x' || lower(hex(p_name)) AS code, p_name AS name FROM part")
def label_codec(g):
    return g.table("part").select("p_partkey", tx.label_code(F.col("p_name")).alias("code")).withColumn("name", tx.label_name(F.col("code")))


@query(PRELUDE + "SELECT id, 'ent-' || md5(id) AS ent_id, id || description AS content FROM nodes")
def vdb_content(g):
    return g.nodes().select("id", tx.hash_id("ent-", F.col("id")).alias("ent_id"), F.concat("id", "description").alias("content"))


class _tagged:
    """A model that says its name and how long its prompt is."""

    def __init__(self, name: str):
        self.name = name

    def __call__(self, prompt: str, history: list[dict] | None = None) -> str:
        return f"{self.name} {len(prompt)}"


@query("SELECT doc_id, true AS routed, CAST(length(text) AS VARCHAR) AS reply FROM documents WHERE text IS NOT NULL")
def round_robin(g):
    """Three models answer on all documents in turn (U4); whose turn a document meets depends on its task, so the name is only checked."""
    prompts = g.documents().where("text is not null").select(F.col("doc_id").alias("id"), F.col("text").alias("prompt"))
    answers = hooks.answered(prompts, hooks.routed([_tagged(name) for name in ("first", "second", "third")]))
    name, reply = F.split_part("answer", F.lit(" "), F.lit(1)), F.split_part("answer", F.lit(" "), F.lit(2))
    return answers.select(F.col("id").alias("doc_id"), name.isin("first", "second", "third").alias("routed"), reply.alias("reply"))
