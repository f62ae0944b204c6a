"""Sources: text and JSON files, GraphML, documents in binary formats, tables over JDBC."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.schemas import GRAPHML_EDGE, GRAPHML_NODE

#: Fixed attribute keys of GraphML files.
NODE_KEYS = {"d0": "entity_type", "d1": "description", "d2": "source_id"}
EDGE_KEYS = {"d3": "weight", "d4": "description", "d5": "keywords", "d6": "source_id"}


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """One JSON document per file, with a declared schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_text(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """Text or Markdown files, one row each (S4), or one for each line."""
    return spark.read.text(path, wholetext=whole).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _attributes(df: DataFrame, keys: dict[str, str]) -> list:
    table = F.map_from_entries(F.transform("data", lambda d: F.struct(d["_key"], d["_VALUE"])))
    return [F.trim(F.replace(F.coalesce(F.try_element_at(table, F.lit(k)), F.lit("")), F.lit('"'), F.lit(""))).alias(name) for k, name in keys.items()]


def _broken(line: Column) -> Column:
    """Whether a line of GraphML has a begin or end of nodes or edges, or a comment or verbatim text, and is not one whole element."""
    begins, ends = F.regexp_count(line, F.lit(r"<(?:node|edge)(?:[\s/>]|$)")), F.regexp_count(line, F.lit(r"</(?:node|edge)(?:[\s>]|$)"))
    aside = line.contains("<!--") | line.contains("<![CDATA[")
    long = (ends == 1) & line.rlike(r"^\s*<(?:node|edge)[\s>]") & line.rlike(r"</(?:node|edge)>\s*$")
    short = (ends == 0) & line.rlike(r"^\s*<(?:node|edge)(?:\s[^<>]*)?/>\s*$")
    return aside | ((begins + ends > 0) & ~((begins == 1) & (long | short)))


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a GraphML file; quotes are taken off, a missing weight is 0, missing text empty.

    A document in which each element has a line of its own, as :func:`sinks.write_graphml` writes it,
    is read by many tasks, after a pass that makes sure of it; any other by one task a file.
    """
    bare = lambda c: F.replace(F.col(c), F.lit('"'), F.lit(""))
    lines = spark.read.text(path)
    if lines.where(_broken(F.col("value"))).isEmpty():
        every = lambda tag, schema: lines.where(F.col("value").rlike(rf"^\s*<{tag}[\s/>]")).select(F.from_xml("value", schema, {"rowTag": tag}).alias("x")).select("x.*")
    else:
        every = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    nodes, edges = every("node", GRAPHML_NODE), every("edge", GRAPHML_EDGE)
    edges = edges.select(bare("_source").alias("src"), bare("_target").alias("tgt"), *_attributes(edges, EDGE_KEYS))
    return nodes.select(bare("_id").alias("id"), *_attributes(nodes, NODE_KEYS)), edges.withColumn("weight", F.coalesce(F.col("weight").try_cast("double"), F.lit(0.0)))


def read_binary(spark: SparkSession, path: str, parse: Callable[[str, bytes], str], glob: str = "*") -> DataFrame:
    """Files of any format, with text by an injected parser; a failed file has an error instead."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows.append((name, parse(name, content), None))
                except Exception as failure:  # noqa: BLE001  the parser is foreign code
                    rows.append((name, None, str(failure)))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


def decode_text(name: str, content: bytes) -> str:
    """UTF-8, else GBK: a parser for :func:`read_binary`."""
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("gbk")


def new_files(listed: DataFrame, known: DataFrame, extensions: list[str], key: str = "path") -> DataFrame:
    """Listed paths of the given extensions that are not known yet."""
    wanted = F.lower("path").rlike(r"\.(?:" + "|".join(extensions) + ")$")
    return listed.where(wanted).join(known.select(key), key, "left_anti")


def page_of(table: DataFrame, key: str, offset: int, size: int) -> DataFrame:
    """One page of a table in order of its key."""
    return table.orderBy(key).offset(offset).limit(size)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A relational table in ``parts`` ranges of a numeric column, instead of page by page."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def unique_contexts(lines: DataFrame) -> DataFrame:
    """First place of each ``context`` of JSON ``lines(pos, value)``; blank and broken lines are skipped."""
    context = F.from_json("value", "context string")["context"]
    return lines.where("trim(value) <> ''").select("pos", context.alias("context")).where("context is not null").groupBy("context").agg(F.min("pos").alias("pos"))


def questions(files: DataFrame) -> DataFrame:
    """Questions of ``files(doc, text)`` with lines ``- Question N: ...``, stars left out."""
    lines = files.select("doc", F.explode(F.split(F.replace("text", F.lit("**"), F.lit("")), "\n", -1)).alias("line"))
    found = lines.select("doc", F.regexp_extract("line", r"- Question (\d+): (.+)", 1).alias("n"), F.regexp_extract("line", r"- Question (\d+): (.+)", 2).alias("question"))
    return found.where("n <> ''").select("doc", F.col("n").cast("long").alias("number"), "question")


def custom_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Entities, relationships and chunks of a prebuilt graph in JSON."""
    from tessella.schemas import CUSTOM_GRAPH

    whole = read_json(spark, path, CUSTOM_GRAPH)
    return {name: whole.select(F.explode(name).alias("x")).select("x.*") for name in ("entities", "relationships", "chunks")}
