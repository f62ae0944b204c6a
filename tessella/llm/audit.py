"""Audit of filters that overlap, by Walsh-Hadamard sums.

Every document has a mask, a bit for each filter that it fails. For each part and label class 32
signed sums (one for each set of filters: documents that fail an even number of them less those that
fail an odd number) are all that is aggregated. The transform is its own inverse but for a factor of
32, so the counts of all 32 masks come back exactly, and with them what any order of the filters
removes at each step. Over all orders a document that fails k filters is removed by each of them in
120 / k, which gives Shapley values in closed form. Only the last step, over the few sums of a part,
is numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

#: Thresholds of the filters: fewest words, least share of distinct words, most of upper-case letters (both in percent), characters of filter D.
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER, SYMBOLS = 200, 50, 2, r"[#$%&*|]"


def words_of(text: Column) -> Column:
    """Maximal runs without ASCII white space."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")


def masks(docs: DataFrame) -> DataFrame:
    """``doc_id, part, digest, mask`` of every row of ``docs(doc_id, text, source)``; bits 0 to 3 of the mask are filters A to D.

    A null text is empty, a null source the part of the empty name. The digest is the text's SHA-256.
    """
    text = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    worded = text.withColumn("words", words_of(F.col("text")))
    sized = worded.select("doc_id", "part", "text", F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("distinct"))
    fails = (
        F.col("n") < LEAST_WORDS, 100 * F.col("distinct") < LEAST_DISTINCT * F.col("n"), 100 * F.regexp_count("text", F.lit("[A-Z]")) > MOST_UPPER * F.length("text"), F.col("text").rlike(SYMBOLS),
    )
    mask = sum((F.when(fail, 1 << k).otherwise(0) for k, fail in enumerate(fails)), F.lit(0))
    return sized.select("doc_id", "part", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"), mask.alias("mask"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, label, mask`` of every document with all five bits; ``label`` is 1 for good ones plus 2 for toxic ones.

    A document fails filter E where a smaller id has the same text; rows of the smallest id, repeated
    ones too, and rows without id do not. The smallest id of each text is found by one aggregation
    with partial results and looked up by text and id together, so copies in any number are dealt
    out by their ids. A document is good or toxic if any of its label rows says so.
    """
    found = masks(docs)
    first = found.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    marked = found.join(first, ["doc_id", "digest"], "left").join(known, "doc_id", "left")
    copy = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), 1 << 4).otherwise(0)
    label = F.when(F.col("good"), 1).otherwise(0) + F.when(F.col("bad"), 2).otherwise(0)
    return marked.select("part", label.alias("label"), (F.col("mask") + copy).alias("mask"))


def parity_sums(rows: DataFrame) -> DataFrame:
    """``part, label, sums``: for each set of filters the documents that fail an even number of them less the others."""
    sign = lambda s: F.when(F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2 == 0, 1).otherwise(-1)
    return rows.groupBy("part", "label").agg(*[F.sum(sign(s)).alias(f"w{s}") for s in range(MASKS)]).select("part", "label", F.array(*[f"w{s}" for s in range(MASKS)]).alias("sums"))


def cells(sums: np.ndarray) -> np.ndarray:
    """Documents of each mask from the signed sums, exactly."""
    return (SIGNS @ sums) >> len(FILTERS)


#: Sign of each mask (column) in the sum of each set of filters (row): the Walsh-Hadamard matrix, its own inverse but for a factor.
SIGNS = np.array([[1 - 2 * ((s & c).bit_count() % 2) for c in range(MASKS)] for s in range(MASKS)])


def orders(parts: DataFrame) -> DataFrame:
    """One row for each part, order and step of ``parts(part, classes)``, the label classes with their sums."""
    mask = np.arange(MASKS)
    steps = [(order, k + 1, FILTERS.index(f), sum(1 << FILTERS.index(g) for g in order[:k])) for order in ORDERS for k, f in enumerate(order)]
    own, before = np.array([1 << bit for _, _, bit, _ in steps]), np.array([b for *_, b in steps])
    fails, gone = (mask & own[:, None]) != 0, (mask & before[:, None]) != 0
    shares = np.array([len(ORDERS) // max(c.bit_count(), 1) for c in range(MASKS)])
    counted = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": mask == own[:, None], "shapley": fails * shares}
    names = pa.array([order for order, *_ in steps]), pa.array([k for _, k, *_ in steps], pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, classes in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                n = np.zeros((4, MASKS), dtype=np.int64)
                for x in classes:
                    n[x["label"]] = cells(np.array(x["sums"], dtype=np.int64))
                out = {k: table.astype(np.int64) @ n.sum(0) for k, table in counted.items()}
                lost = counted["removed"].astype(np.int64)
                out |= {"good_lost": lost @ (n[1] + n[3]), "toxic_lost": lost @ (n[2] + n[3])}
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(steps)), *names, *[pa.array(out[c]) for c in COUNTS]], names=["part", "filter_order", "step", *COUNTS])

    return parts.select("part", "classes").mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step, with counts of documents within the part.

    ``kept`` after the step, ``removed`` by it, ``redundant`` (failing its filter, but removed
    before), ``unique_fails`` (failing no other filter), ``good_lost`` and ``toxic_lost`` (removed by
    it, of label quality 1 and toxic 1) and ``shapley`` (removed by its filter, summed over all 120
    orders), all long. Repeated rows count each; an empty table gives no row; labels of unknown
    documents count for nothing, and documents without labels are neither good nor toxic. Texts are
    taken whole. Other columns of either table are ignored.
    """
    sums = parity_sums(judged(docs, labels))
    return orders(sums.groupBy("part").agg(F.collect_list(F.struct("label", "sums")).alias("classes")))  # four classes at most
