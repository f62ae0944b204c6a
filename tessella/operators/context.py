"""Query contexts: merging, modes, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessella.functions.text import csv_row, strip
from tessella.operators.ranking import numbered


def combine(first: DataFrame, second: DataFrame, columns: list[str], place: str = "id") -> DataFrame:
    """Ordered union of two sections, each row once at its first place, numbered from 1 (G1)."""
    both = first.select(F.lit(0).alias("side"), F.col(place).alias("at"), *columns).unionByName(second.select(F.lit(1).alias("side"), F.col(place).alias("at"), *columns))
    kept = both.groupBy(*columns).agg(F.min(F.struct("side", "at")).alias("x"))
    return numbered(kept, [F.col("x")]).select((F.col("id") + 1).alias("id"), *columns)


def csv_section(rows: DataFrame, columns: list[str], place: str = "id") -> DataFrame:
    """One row with a section's CSV text, header first."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(place, csv_row(*[F.col(c) for c in columns]).alias("line")))), lambda x: x["line"])
    header = ",".join(f'"{c}"' for c in columns)
    return rows.agg(F.concat(F.lit(header + "\n"), F.array_join(lines, "\n")).alias("csv"))


def joined_chunks(rows: DataFrame, place: str = "id", separator: str = "\n--New Chunk--\n") -> DataFrame:
    """One row with the contents in order (Q1)."""
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place, "content"))), lambda x: x["content"]), separator).alias("context"))


def resolve_mode(mode: Column, high: Column, low: Column) -> Column:
    """Mode after keywords are known: without low ones global, without high ones local, without both fail (Q7)."""
    no_high, no_low = F.size(high) == 0, F.size(low) == 0
    return F.when(no_high & no_low, "fail").when(no_low & mode.isin("local", "hybrid"), "global").when(no_high & mode.isin("global", "hybrid"), "local").otherwise(mode)


def flattened_keywords(lists: Column) -> Column:
    """Keyword lists flattened by one level and joined (Q8)."""
    return F.array_join(F.flatten(lists), ", ")


def keyword_prompt(query: Column, high: Column, low: Column) -> Column:
    """Query with its keywords below (Q9)."""
    return F.concat(query, F.lit("\n\n### Keywords:\nHIGH-LEVEL: "), F.array_join(high, ", "), F.lit("\nLOW-LEVEL: "), F.array_join(low, ", "))


def clean_response(response: Column, prompt: Column, query: Column) -> Column:
    """A response that is longer than its prompt without prompt, query and role words (response clean-up)."""
    out = F.replace(response, prompt, F.lit(""))
    for word in (F.lit("user"), F.lit("model"), query, F.lit("<system>"), F.lit("</system>")):
        out = F.replace(out, word, F.lit(""))
    return F.when(F.length(response) > F.length(prompt), strip(out)).otherwise(response)


def rendered(template: str, **values: Column) -> Column:
    """Template with named places filled."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def created_at(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm:ss")


def observed(rows: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """Rows, and aggregates of them that are there once an action has run over the rows: progress and context counts."""
    seen = Observation()
    return rows.observe(seen, *[c.alias(name) for name, c in counts.items()]), seen
