"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.graph import shared_folder

#: The ASCII upper-case letters and their lower-case forms; contracts lower these only.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Rows that a function of :func:`append_columns` may look ahead.
AHEAD = 256


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's decimal text leaves ``remainder`` (a null id counts as the text ``null``)."""
    return (F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("null")), "UTF-8")) % modulus) == remainder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the folder that ``spark.checkpoint.dir`` names (:func:`shared_folder`)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, for explicit repartitioning."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows_as_batches(schema: pa.Schema, rows: Iterable[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Pack tuples into record batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(schema, held)
            held = []
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 50_000) -> Iterator[pa.Table]:
    """Cut a stream sorted by ``keys`` into tables of whole groups, of about ``rows`` rows each.

    A table is larger only by what its last group needs, so callers bound the size of groups.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        last = [table.column(k)[-1] for k in keys]
        columns = [table.column(k).to_numpy(zero_copy_only=False) for k in keys]
        other = np.zeros(table.num_rows, dtype=bool)
        for values, value in zip(columns, last, strict=True):
            other |= values != value.as_py()
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            n = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, with the end of the last run appended."""
    n = len(columns[0])
    change = np.zeros(max(n - 1, 0), dtype=bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [n]]).astype(np.int64)


def local_components(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of n nodes over edges (a, b); ``label`` goes on from an earlier call."""
    label = np.arange(n) if label is None else label
    while len(a):
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return label


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node id reachable from each node of ``edges(a, b)``, as ``(node, component)``.

    Alternating large-star and small-star rounds, each a join and a shuffle on node ids, until the
    edge set no longer changes; every round ends in a checkpoint. Only a count and a checksum come
    to the driver. A hub's edges are an ordinary skewed join, which adaptive execution splits.
    """

    def canonical(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    def star(df: DataFrame, large: bool) -> DataFrame:
        sides = df.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else df
        least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = sides.join(least, "a")
        moved = joined.where("b > a") if large else joined
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionByName(least.select("a", F.col("m").alias("b")))
        return canonical(out)

    current = checkpoint(canonical(edges.select("a", "b")))
    before = state(current)
    while before[0]:
        current = checkpoint(star(star(current, large=True), large=False))
        after = state(current)
        if after == before:
            break
        before = after
    pairs = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("node"), "component").distinct())


def shielded(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[Column]]:
    """``df`` with its columns of the given names renamed, and what selects all its columns under their own names again."""
    aside = {c: f"__own_{c}" for c in df.columns if c in names}
    return df.withColumnsRenamed(aside), [F.col(f"`{aside.get(c, c)}`").alias(c) for c in df.columns]


def append_columns(df: DataFrame, inputs: list[str], fields: list[tuple[str, str, pa.DataType]], make: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """Add columns that a per-row Python function computes, without a shuffle.

    All other columns pass through as Arrow arrays; of the inputs one row at a time is a Python
    object, so memory stays bounded by a batch. ``make`` is called once in each task (to open a
    tokenizer, build a table); what it returns gets a row's inputs and gives a tuple for ``fields``
    (name, DDL type, Arrow type). ``make`` may return a pair instead, whose second function sees the
    first input of some hundred rows before their turn, to prepare for them together. A column of
    ``df`` that has the name of a field is replaced.
    """
    names = [name for name, _, _ in fields]
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names])
    inputs_at = [kept.columns.index(c) for c in inputs]
    schema = T.StructType([*kept.schema.fields, *[T.StructField(name, T.DataType.fromDDL(ddl)) for name, ddl, _ in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        work, ahead = work if isinstance(work, tuple) else (work, None)
        for batch in batches:
            columns = [batch.column(i) for i in inputs_at]
            made = []
            for i in range(batch.num_rows):
                if ahead and i % AHEAD == 0:
                    ahead(x.as_py() for x in columns[0][i : i + AHEAD])
                made.append(work(*[c[i].as_py() for c in columns]))
            new = [pa.array([m[k] for m in made], kind) for k, (_, _, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, schema)
