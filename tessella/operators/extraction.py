"""Model answers to rows: entity and relationship records, keywords, chat turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import clean, is_float, json_body, strip

#: Fixed record format of model answers.
FIELD, RECORD, COMPLETE = "<|>", "##", "<|COMPLETE|>"


def split_markers(text: Column, markers: list[str]) -> Column:
    """Stripped parts between any of the markers, blank ones left out."""
    if not markers:
        return F.array(text)
    parts = F.split(text, "|".join("\\Q" + m + "\\E" for m in markers), -1)
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def records(answers: DataFrame) -> DataFrame:
    """Fields of each record of ``answers(chunk_id, text)`` that stands in parentheses."""
    each = answers.select("chunk_id", F.posexplode(split_markers(F.col("text"), [RECORD, COMPLETE])).alias("pos", "record"))
    body = F.regexp_extract("record", r"\((.*)\)", 1)
    return each.where(body != "").select("chunk_id", "pos", split_markers(body, [FIELD]).alias("f"))


def entities(answers: DataFrame, typed: bool = True) -> DataFrame:
    """Entity mentions (E4; without types E4b)."""
    need = 4 if typed else 3
    found = records(answers).where((F.size("f") >= need) & (F.get("f", F.lit(0)) == '"entity"'))
    name = clean(F.upper(F.get("f", F.lit(1)))).alias("entity_name")
    kind = [clean(F.upper(F.get("f", F.lit(2)))).alias("entity_type")] if typed else []
    text = clean(F.get("f", F.lit(need - 1))).alias("description")
    return found.select("chunk_id", "pos", name, *kind, text).where(strip(F.col("entity_name")) != "")


def relationships(answers: DataFrame, weighted: bool = True) -> DataFrame:
    """Relationship mentions; the last field is the weight if it is a number, else 1 (E5; without weights E5b)."""
    found = records(answers).where((F.size("f") >= 5) & (F.get("f", F.lit(0)) == '"relationship"'))
    last = F.element_at("f", -1)
    weight = [F.when(is_float(last), last.cast("double")).otherwise(1.0).alias("weight")] if weighted else []
    return found.select(
        "chunk_id", "pos", clean(F.upper(F.get("f", F.lit(1)))).alias("src_id"), clean(F.upper(F.get("f", F.lit(2)))).alias("tgt_id"),
        clean(F.get("f", F.lit(3))).alias("description"), clean(F.get("f", F.lit(4))).alias("keywords"), *weight,
    )


def keywords(text: Column) -> Column:
    """High and low keywords of a model's JSON answer, empty lists where it has none."""
    parsed = F.from_json(json_body(text), "high_level_keywords array<string>, low_level_keywords array<string>")
    none = F.array().cast("array<string>")
    return F.struct(F.coalesce(parsed["high_level_keywords"], none).alias("high"), F.coalesce(parsed["low_level_keywords"], none).alias("low"))


def query_mode(text: Column) -> Column:
    """Mode that a query's prefix names, hybrid by default, and the query without it."""
    mode = F.regexp_extract(text, "^/(local|global|naive|hybrid|mix) ", 1)
    rest = F.regexp_replace(F.regexp_replace(text, "^/(local|global|naive|hybrid|mix) ", ""), r"(?U)^\s+", "")
    return F.struct(F.when(mode != "", mode).otherwise("hybrid").alias("mode"), F.when(mode != "", rest).otherwise(text).alias("query"))


def conversation_turns(history: DataFrame, turns: int) -> DataFrame:
    """Last ``turns`` pairs of each conversation ``history(conv_id, turn, role, text)`` as text.

    Messages that hold extracted keywords go first; then every two messages in order are a pair,
    kept if one is the user's and one the assistant's, the user's put first.
    """
    of_keywords = (F.col("role") == "assistant") & (F.col("text").startswith('{ "high_level_keywords"') | F.col("text").startswith("{'high_level_keywords'"))
    own = history.where(~F.coalesce(of_keywords, F.lit(False)))
    order = Window.partitionBy("conv_id").orderBy("turn")
    pairs = own.select("conv_id", "role", "text", (F.row_number().over(order) - 1).alias("i"), F.lead("role").over(order).alias("role2"), F.lead("text").over(order).alias("text2")).where("i % 2 = 0")
    forward = (F.col("role") == "user") & (F.col("role2") == "assistant")
    backward = (F.col("role") == "assistant") & (F.col("role2") == "user")
    kept = pairs.where(forward | backward).select("conv_id", "i", F.when(forward, F.col("text")).otherwise(F.col("text2")).alias("u"), F.when(forward, F.col("text2")).otherwise(F.col("text")).alias("a"))
    last = kept.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("i")))).where(F.col("back") <= turns)
    said = lambda c: F.coalesce(F.col(c), F.lit(""))  # noqa: E731  a null text is an empty one
    line = F.concat(F.lit("user: "), said("u"), F.lit("\nassistant: "), said("a"))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x["line"]), "\n").alias("history"))


def packed_messages(parts: Column) -> Column:
    """Messages of alternating roles, the user first."""
    return F.transform(parts, lambda text, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), text.alias("content")))


#: Fixed words that a generated question must not have.
BANNED = ("答案", "回答", "建议", "如何解决", "怎么办", "为什么")


def valid_question(q: Column) -> Column:
    """Rules for generated questions."""
    good = (F.length(q) > 6) & q.endswith("？") & (F.length(q) - F.length(F.replace(q, F.lit("？"), F.lit(""))) == 1)
    for word in ("?", ",", "，", *BANNED):
        good &= ~F.contains(q, F.lit(word))
    return good


#: Fixed marks of a block's file name and section, on the line before it.
_FILE_NAME, _SECTION = r"^(?:<file_name>(.*)</file_name>|## filename:(.*))$", r"^<section>(.*)</section>$"


def code_blocks(text: Column) -> Column:
    """Fenced code blocks of a text as ``blocks``, and the ``rest`` of the text, its stripped parts joined by line feeds.

    A block has its ``index``, the ``file_name`` or ``section`` that the line before it names, the
    ``type`` (the word after the fence; ``language-specific`` if there is none, empty if it holds a
    brace), the stripped ``content``, and ``is_complete``, false for a last one that nothing closes.
    """
    parts = F.split(text, "```", -1)
    outside, inside = F.filter(parts, lambda x, i: i % 2 == 0), F.filter(parts, lambda x, i: i % 2 == 1)
    after = F.slice(outside, F.lit(2), F.size(outside))
    each = F.filter(F.arrays_zip(inside.alias("body"), outside.alias("before"), after.alias("after")), lambda z: z["body"].isNotNull() & ((z["body"] != "") | z["after"].isNotNull()))

    def block(z: Column, i: Column) -> Column:
        line = F.regexp_extract(strip(z["before"]), r"[^\n\r]*$", 0)
        name = F.concat(F.regexp_extract(line, _FILE_NAME, 1), F.regexp_extract(line, _FILE_NAME, 2))
        word = F.regexp_extract(z["body"], r"^[^ \n]*", 0)
        held = F.when(F.contains(word, F.lit("{")), "").otherwise(word)
        content = F.substr(z["body"], F.length(held) + 1)
        kind = F.when(z["body"].rlike(r"^[\n \t]"), "language-specific").otherwise(held)
        return F.struct(i.alias("index"), strip(name).alias("file_name"), strip(F.regexp_extract(line, _SECTION, 1)).alias("section"), kind.alias("type"), strip(content).alias("content"), z["after"].isNotNull().alias("is_complete"))

    rest = F.array_join(F.filter(F.transform(outside, strip), lambda x: x != ""), "\n")
    return F.struct(F.transform(each, block).alias("blocks"), rest.alias("rest"))


#: Fixed form of a paragraph in a rerank request: its number in quotes, then its text up to a blank line or the next number.
_PARAGRAPH = r'(?s)"(\d+)"\s*(.*?)(?=\n\n|\n"\d+"|$)'


def paragraphs(text: Column, query_mark: str = "Query: ") -> Column:
    """Paragraphs ``(number, text)`` of a rerank request, and the ``query`` of its line that ``query_mark`` begins."""
    line = F.lit("(?m)^\\Q" + query_mark + "\\E(.*)$")
    body = F.regexp_replace(text, line, F.lit(""))
    numbers, bodies = (F.regexp_extract_all(body, F.lit(_PARAGRAPH), F.lit(k)) for k in (1, 2))
    found = F.zip_with(numbers, bodies, lambda n, t: F.struct(n.cast("int").alias("number"), strip(t).alias("text")))
    return F.struct(F.nullif(F.get(F.regexp_extract_all(text, line, F.lit(1)), F.lit(0)), F.lit("")).alias("query"), found.alias("paragraphs"))
