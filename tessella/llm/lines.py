"""Boilerplate lines by their spread over sites, with DataFrame functions only.

A line is known by 128 bits of hashes. A HyperLogLog sketch of its sites is merged by one
aggregation. Lines whose estimate is near the threshold are counted exactly. A line on at least
``sites`` sites stays in the document of the smallest id that has it and goes from all others. So
does a passage, a line of over ``PASSAGE`` words, that stands in different texts, whatever their
sites; copies of the text that keeps it keep it too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import checkpoint, shielded


#: Words of a line above which it is a passage.
PASSAGE = 50


def lines_of(text: Column) -> Column:
    """Lines of a text, cut at line feeds; a null text has none."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hash(line: Column) -> Column:
    """Two 64-bit hashes of a line without spaces, tabs and carriage returns at its ends, which stand for it; null for a blank line."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("h1"), F.xxhash64(F.lit("second"), bare).alias("h2")))


def is_passage(line: Column) -> Column:
    """Whether a line has over ``PASSAGE`` words, cut at white space other than line feeds."""
    return F.size(F.split(F.btrim(line, F.lit(" \t\r")), "[ \t\x0B\f\r]+", -1)) > PASSAGE


def _hashes(docs: DataFrame) -> DataFrame:
    """One row for each line that is not blank."""
    each = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("place", "line"))
    return each.select("doc_id", "source", "text_hash", "place", line_hash(F.col("line")).alias("line"), is_passage(F.col("line")).alias("passage")).where("line is not null")


def boilerplate(docs: DataFrame, sites: int = 3, precision: int = 12) -> DataFrame:
    """Places of the lines to remove: ``doc_id, text_hash, place, line``.

    The sketch has ``2 ** precision`` registers; its estimate is taken as it is where it is more
    than a tenth (and more than one) away from ``sites``, beyond six of its standard errors.
    """
    every = _hashes(docs)
    repeated = F.first("passage") & (F.min("text_hash") < F.max("text_hash"))
    spread = every.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("source", F.lit(precision))).alias("spread"), repeated.alias("repeated"), F.min("doc_id").alias("first"), F.min_by("text_hash", "doc_id").alias("first_text")
    )
    margin = max(1.0, 0.1 * sites)
    wide = spread.where((F.col("spread") >= sites - margin) | F.col("repeated")).withColumn("near", F.col("spread").between(sites - margin, sites + margin))
    wide = checkpoint(wide.withColumn("wide", F.col("spread") > sites + margin).drop("spread"))
    places = checkpoint(every.drop("passage").join(wide, "line").where("near or doc_id > first"))
    exact = places.where("near").groupBy("line", "source").agg(F.lit(1).alias("one")).where("source is not null").groupBy("line").agg(F.count("*").alias("n"))
    broad = checkpoint(exact.where(F.col("n") >= sites).select("line", F.lit(True).alias("broad")))
    judged = places.where("doc_id > first").join(broad, "line", "left")
    return judged.where("wide or coalesce(broad, false) or (repeated and text_hash <> first_text)").select("doc_id", "text_hash", "place", "line")


def remove_boilerplate(docs: DataFrame, sites: int = 3, precision: int = 12) -> DataFrame:
    """Every row of ``docs(doc_id, text, source)`` with its boilerplate lines removed from ``text``.

    Adds ``n_lines int`` (of the text before, blank ones too) and ``n_removed int``; other columns
    stay. Blank lines and all occurrences within the first document stay, as does a document that
    loses all its lines, with an empty text. A null text stays null and has no lines; a null source
    is no site; a row without id loses nothing, nor does a text without lines. Repeated rows are
    treated alike. An empty table gives none; columns named like the results are replaced. ``n_chars``, where
    present, follows the text.
    """
    gone = boilerplate(docs.select("doc_id", "text", "source"), sites, precision)
    gone = gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("place")).alias("__gone"))
    docs, own = shielded(docs.drop("n_lines", "n_removed"), ["__gone", "__id", "__hash", "__text_hash", "__mask"])
    keyed = docs.withColumn("__text_hash", F.xxhash64("text"))
    joined = keyed.join(gone.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"}), (F.col("doc_id") == F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left")
    before = F.when(F.col("__gone").isNotNull(), F.col("__gone"))
    mask = F.flatten(F.transform(before, lambda at, k: F.concat(F.array_repeat(F.lit(False), at - F.coalesce(F.get(before, k - 1), F.lit(-1)) - 1), F.array(F.lit(True)))))
    masked = joined.withColumn("__mask", mask)
    kept = F.filter(lines_of(F.col("text")), lambda x, k: ~F.coalesce(F.get(F.col("__mask"), k), F.lit(False)))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = masked.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines_of(F.col("text"))))).withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*own, "n_lines", "n_removed")
