"""Documents to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import hash_id, strip, summary
from tessella.functions.tokenizers import WHITE, Tokenizer, WhiteSpace
from tessella.operators import ranking


def ingest(docs: DataFrame) -> DataFrame:
    """Distinct stripped documents with content id, summary and length (O1)."""
    return _described(docs.where("text is not null").select(strip(F.col("text")).alias("content")).distinct())


def described(docs: DataFrame) -> DataFrame:
    """The same of every row, repeated ones too, also of a stream."""
    return _described(docs.where("text is not null").select(strip(F.col("text")).alias("content")))


def _described(bare: DataFrame) -> DataFrame:
    return bare.select(hash_id("doc-", F.col("content")).alias("id"), "content", summary(F.col("content")).alias("content_summary"), F.length("content").alias("content_length"))


def _numbered(df: DataFrame, key: str, chunks: Column) -> DataFrame:
    # the outer generator adds no filter, in which the chunks would be made a second time
    out = df.select(key, F.posexplode_outer(chunks).alias("chunk_order_index", "c")).where("c is not null")
    return out.select(key, "chunk_order_index", F.col("c.tokens").alias("tokens"), F.col("c.content").alias("content"), hash_id("chunk-", F.col("c.content")).alias("id"))


def by_tokens(docs: DataFrame, size: int = 1200, overlap: int = 100, key: str = "doc_id", tokenizer: Tokenizer = WHITE) -> DataFrame:
    """Overlapping windows of tokens (O2); blank texts have none."""
    return _numbered(docs, key, tokenizer.windows(F.col("text"), size, overlap))


def pieces(text: Column, separator: str) -> Column:
    return F.split(text, F.lit("\\Q" + separator + "\\E"), F.lit(-1))


def by_separator(docs: DataFrame, separator: str, key: str = "doc_id", tokenizer: Tokenizer = WHITE) -> DataFrame:
    """Stripped pieces between separators (O3)."""
    return by_separator_then_tokens(docs, separator, 1 << 30, 0, key, tokenizer)


def by_separator_then_tokens(docs: DataFrame, separator: str, size: int = 1200, overlap: int = 100, key: str = "doc_id", tokenizer: Tokenizer = WHITE) -> DataFrame:
    """Pieces between separators, those of over ``size`` tokens cut to windows, numbered through."""
    if isinstance(tokenizer, WhiteSpace):
        return _numbered(docs, key, F.flatten(F.transform(pieces(F.col("text"), separator), lambda piece: tokenizer.windows_if_long(piece, size, overlap))))
    # an injected encoder takes columns, so each piece becomes a row, and rows are numbered within their text
    each = docs.select(key, F.posexplode(pieces(F.col("text"), separator)).alias("__at", "__piece"))
    counted = each.withColumns({"__n": tokenizer.count(F.col("__piece")), "__w": tokenizer.windows(F.col("__piece"), size, overlap)})
    whole = F.array(F.struct(F.col("__n").alias("tokens"), strip(F.col("__piece")).alias("content")))
    cut_ = counted.select(key, "__at", F.posexplode(F.when(F.col("__n") > size, F.col("__w")).otherwise(whole)).alias("__k", "c"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("__at", "__k")) - 1
    return cut_.select(key, place.alias("chunk_order_index"), F.col("c.tokens").alias("tokens"), F.col("c.content").alias("content"), hash_id("chunk-", F.col("c.content")).alias("id"))


def by_characters(docs: DataFrame, size: int = 300, overlap: int = 50, key: str = "doc_id") -> DataFrame:
    """Overlapping character windows."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(size - overlap))
    return docs.where("text <> ''").select(key, F.posexplode(starts).alias("chunk_order_index", "at"), "text").select(key, "chunk_order_index", F.expr(f"substring(text, at + 1, {size})").alias("content"))


def by_separated_characters(docs: DataFrame, size: int = 300, overlap: int = 50, separator: str = "\n\n", key: str = "doc_id") -> DataFrame:
    """Pieces between separators put together to chunks of at most ``size`` characters, with as many of the last pieces again as ``overlap`` holds.

    A piece longer than ``size`` is a chunk of its own, blank chunks are left out, and chunks are
    stripped. The fold goes over blocks of pieces, each of which adds its own list of chunks, so time
    follows the text. Null and empty texts have none.
    """
    n_sep = len(separator)

    def spans(lengths: Column) -> Column:
        """First piece and the one after the last of each chunk."""
        n = F.size(lengths)

        def kept(from_: Column, to: Column, room: Column) -> Column:
            """How many of the last pieces before ``to`` fit into ``room`` characters."""
            grow = lambda acc, x: F.when(acc["on"] & (acc["total"] + x + n_sep <= room + n_sep), F.struct((acc["total"] + x + n_sep).alias("total"), (acc["n"] + 1).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(acc["total"].alias("total"), acc["n"].alias("n"), F.lit(False).alias("on")))
            start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("n"), F.lit(True).alias("on"))
            return F.aggregate(F.reverse(F.slice(lengths, from_ + 1, to - from_)), start, grow, lambda acc: F.struct(F.greatest(acc["total"] - n_sep, F.lit(0)).alias("total"), acc["n"].alias("n")))

        def step(acc: Column, i: Column) -> Column:
            length = F.get(lengths, i)
            full = (acc["from"] < i) & (acc["total"] + length + n_sep > size)

            def moved(k: Column) -> Column:
                total = F.when(k["n"] > 0, k["total"] + n_sep).otherwise(0) + length
                return F.struct((i - k["n"]).alias("from"), total.alias("total"), F.concat(acc["out"], F.array(F.struct(acc["from"].alias("from"), i.alias("to")))).alias("out"))

            cut = F.get(F.transform(F.array(kept(acc["from"], i, F.least(F.lit(overlap), F.lit(size) - length - n_sep))), moved), F.lit(0))
            grown = F.struct(acc["from"].alias("from"), (acc["total"] + F.when(acc["from"] < i, n_sep).otherwise(0) + length).alias("total"), acc["out"].alias("out"))
            return F.when(full, cut).otherwise(grown)

        none = F.array().cast("array<struct<from:int,to:int>>")

        def block(acc: Column, b: Column) -> Column:
            own = F.aggregate(F.sequence(b * _BLOCK, F.least((b + 1) * _BLOCK, n) - 1), F.struct(acc["from"].alias("from"), acc["total"].alias("total"), none.alias("out")), step)
            return F.get(F.transform(F.array(own), lambda x: F.struct(x["from"].alias("from"), x["total"].alias("total"), F.concat(acc["out"], F.array(x["out"])).alias("out"))), F.lit(0))

        blocks = F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int"))
        start = F.struct(F.lit(0).alias("from"), F.lit(0).alias("total"), F.array().cast("array<array<struct<from:int,to:int>>>").alias("out"))
        return F.when(n > 0, F.aggregate(blocks, start, block, lambda acc: F.concat(F.flatten(acc["out"]), F.array(F.struct(acc["from"].alias("from"), n.alias("to")))))).otherwise(none)

    def chunks(parts: Column) -> Column:
        made = F.flatten(F.transform(F.array(F.transform(parts, lambda x: F.length(x))), spans))
        return F.filter(F.transform(made, lambda x: strip(F.array_join(F.slice(parts, x["from"] + 1, x["to"] - x["from"]), separator))), lambda c: c != "")

    parts = F.filter(pieces(F.col("text"), separator), lambda x: x != "")
    out = docs.where("text is not null").select(key, F.posexplode_outer(F.flatten(F.transform(F.array(parts), chunks))).alias("chunk_order_index", "content"))
    return out.where("content is not null")


#: Pieces that the fold goes over before it adds up what it found.
_BLOCK = 256


def half_and_half(words: Column, limit: int = 2000, skip: int = 1000) -> Column:
    """``limit / 2`` tokens after the first ``skip``, and those from ``skip + limit / 2`` before the end up to ``skip``."""
    half, n = limit // 2, F.size(words)
    low = F.greatest(n - (skip + half), F.lit(0))
    tail = F.when(low < skip, F.slice(words, low + 1, F.greatest(F.lit(skip) - low, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.slice(words, skip + 1, half), tail)


def grouped_comments(comments: DataFrame, size: int = 10, limit: int = 500, key: str = "doc_id") -> DataFrame:
    """Comments in batches of ``size`` rows in the order of the key, joined by line feeds and cut to ``limit`` characters."""
    comments = ranking.positions(comments, key)
    batch = F.floor(F.col("at") / size).alias("batch")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, "text"))), lambda x: x["text"]), "\n")
    return comments.groupBy(batch).agg(F.substring(joined, 1, limit).alias("source_comment"))


def custom_chunks(docs: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """Given chunks ``docs(key, chunks)`` that are not known yet, with their content ids."""
    each = docs.select(key, F.explode("chunks").alias("content")).select(key, strip(F.col("content")).alias("content"))
    each = each.withColumn("id", hash_id("chunk-", F.col("content")))
    return each.join(known.select("id"), "id", "left_anti").select(key, "id", "content")
