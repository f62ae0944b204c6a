"""Stand-ins: the engine's tables built from the provided ones, in Spark and in the same SQL.

Suppliers ``S<key>`` and parts ``P<key>`` are the graph's nodes, lineitems its mentions and orders
``O<key>`` its chunks; vectors 0 to n stand for parts, for edges and for orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import strip
from tessella.operators import graph, ranking, search, sections

TOP_K, THRESHOLD, BUDGET = 20, 0.1, 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Graph(sections.Lookups):
    """The stand-in tables over one folder; each is built when asked for."""

    budget = BUDGET
    counter = None

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def edge_mentions(self) -> DataFrame:
        name = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
        return self.table("lineitem").select(
            name("S", "l_suppkey").alias("src"), name("P", "l_partkey").alias("tgt"), F.col("l_quantity").alias("weight"), F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("description"),
            F.col("l_returnflag").alias("keywords"), name("O", "l_orderkey").alias("chunk_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        )

    def node_mentions(self) -> DataFrame:
        m = self.edge_mentions()
        first = m.select(F.col("src").alias("name"), F.col("keywords").alias("entity_type"), "description", "chunk_id", "pos")
        return first.unionByName(m.select(F.col("tgt").alias("name"), F.substring("description", -1, 1).alias("entity_type"), F.col("keywords").alias("description"), "chunk_id", "pos"))

    def nodes(self) -> DataFrame:
        return graph.merge_nodes(self.node_mentions())

    def edges(self) -> DataFrame:
        return graph.merge_edges(self.edge_mentions())

    def chunks(self) -> DataFrame:
        content = F.concat_ws(" ", "o_orderpriority", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd"))
        return self.table("orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("id"), content.alias("content"))

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")

    def query_vector(self, at: int) -> list[float]:
        """The one stated query vector."""
        found = self.vectors().where(F.col("id") == at).first()
        return list(found.vector)

    def hits(self, at: int) -> DataFrame:
        """Most similar vectors with their places from 0."""
        found = search.top_k(self.vectors(), self.query_vector(at), TOP_K, THRESHOLD)
        return ranking.numbered(found, [F.desc("similarity"), F.col("id")], name="pos").select("pos", F.col("id").alias("vec_id"), "similarity")

    def entity_hits(self) -> DataFrame:
        return self.hits(0).select("pos", F.concat(F.lit("P"), F.col("vec_id").cast("string")).alias("id"))

    def edge_hits(self) -> DataFrame:
        part = self.hits(1).select("pos", F.concat(F.lit("P"), F.col("vec_id").cast("string")).alias("lo"))
        return part.join(self.edges().groupBy("lo").agg(F.min("hi").alias("hi")), "lo").select("pos", "lo", "hi")

    def chunk_hits(self) -> DataFrame:
        return self.hits(2).select("pos", F.concat(F.lit("O"), F.col("vec_id").cast("string")).alias("id"))

    def statuses(self) -> DataFrame:
        """Document states from the labels: toxic ones failed, good ones processed, others processing."""
        state = F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "processed").otherwise("processing")
        return self.table("labels").select(F.col("doc_id").alias("id"), state.alias("status"))

    def documents(self) -> DataFrame:
        return self.table("documents").select("doc_id", "text")

    def kv(self) -> DataFrame:
        """A key-value table of stripped documents."""
        return self.table("documents").select(F.col("doc_id").alias("id"), strip(F.col("text")).alias("content"), "source")


def _hits(at: int, name: str) -> str:
    return f"""{name} AS (SELECT row_number() OVER (ORDER BY similarity DESC, id) - 1 AS pos, id AS vec_id, similarity FROM
        (SELECT vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {at})) AS similarity FROM embeddings)
        WHERE similarity >= {THRESHOLD} ORDER BY similarity DESC, id LIMIT {TOP_K})"""


#: White-space stripping and token counts, as SQL.
def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def sql_tokens(x: str) -> str:
    return f"CASE WHEN {sql_strip(x)} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split_regex({sql_strip(x)}, '[\\s\\p{{Z}}]+') END"


#: The same tables in SQL.
PRELUDE = f"""WITH RECURSIVE em AS (SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS tgt, l_quantity AS weight, l_returnflag || ' ' || l_linestatus AS description, l_returnflag AS keywords,
        'O' || l_orderkey AS chunk_id, l_orderkey * 10 + l_linenumber AS pos, l_linestatus FROM lineitem),
    nm AS (SELECT src AS name, keywords AS entity_type, description, chunk_id, pos FROM em UNION ALL SELECT tgt, l_linestatus, keywords, chunk_id, pos FROM em),
    kinds AS (SELECT name, entity_type, count(*) AS n, min(pos) AS first FROM nm GROUP BY name, entity_type),
    best AS (SELECT name AS id, entity_type FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, first, entity_type) AS rn FROM kinds) WHERE rn = 1),
    nodes AS (SELECT best.id, entity_type, description, source_ids FROM best JOIN (SELECT name AS id, string_agg(DISTINCT description, '<SEP>' ORDER BY description) AS description,
        list_sort(list(DISTINCT chunk_id)) AS source_ids FROM nm GROUP BY name) m ON best.id = m.id),
    edges AS (SELECT least(src, tgt) AS lo, greatest(src, tgt) AS hi, sum(weight) AS weight, string_agg(DISTINCT description, '<SEP>' ORDER BY description) AS description,
        string_agg(DISTINCT keywords, ',' ORDER BY keywords) AS keywords, list_sort(list(DISTINCT chunk_id)) AS source_ids FROM em GROUP BY 1, 2),
    degree AS (SELECT id, count(*) AS degree FROM (SELECT lo AS id FROM edges UNION ALL SELECT hi FROM edges) GROUP BY id),
    adj AS (SELECT lo AS src, hi AS dst FROM edges UNION SELECT hi, lo FROM edges),
    chunks AS (SELECT 'O' || o_orderkey AS id, o_orderpriority || ' ' || o_orderstatus || ' ' || strftime(o_orderdate, '%Y-%m-%d') AS content FROM orders),
    ranked AS (SELECT edges.*, a.degree + b.degree AS rank FROM edges JOIN degree a ON a.id = lo JOIN degree b ON b.id = hi),
    cited AS (SELECT id, unnest(source_ids) AS chunk_id FROM nodes),
    {_hits(0, "h0")}, {_hits(1, "h1")}, {_hits(2, "h2")},
    eh AS (SELECT pos, 'P' || vec_id AS id FROM h0),
    rh AS (SELECT pos, 'P' || vec_id AS lo, hi FROM h1 JOIN (SELECT lo AS l, min(hi) AS hi FROM edges GROUP BY lo) ON l = 'P' || vec_id),
    ch AS (SELECT pos, 'O' || vec_id AS id FROM h2),
    statuses AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 1 THEN 'processed' ELSE 'processing' END AS status FROM labels),
    kv AS (SELECT doc_id AS id, {sql_strip("text")} AS content, source FROM documents)
"""
