"""Embedding near-duplicates by sorted projection passes.

Each pass orders the distinct vectors of a label lexicographically by a concatenation of random
hashes (signs of random projections of the centred vectors, others in each pass), and compares every
vector with those in a bounded window after it, across the borders of partitions too. Windows hold
vectors in one byte a component; as the error of that is bounded, they lose no pair, and what they
find are candidates. Candidates of all passes are united, and within each such class every pair is
verified in double precision: links are counted, and verified pairs united.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import checkpoint, connected_components, group_bounds, local_components, shuffle_width, whole_groups


def unit_rows(column, dimension: int) -> np.ndarray:
    """The column as a matrix of unit rows in double precision; all its vectors have ``dimension`` components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def comparable() -> Column:
    """Whether a row can link: it has an id, a label and a finite vector other than zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite, F.lit(False))


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Comparable rows as ``(vec_id, label, twin)`` and the distinct ones as ``(node, first, label, twin, copies, embedding, dimension)``.

    ``twin`` holds two 64-bit hashes of the vector; equal vectors of a label are one node, with a
    number of its own and the smallest id as ``first``.
    """
    rows = vectors.where(comparable()).select("vec_id", "label", "embedding")
    kind = vectors.schema["embedding"].dataType.elementType
    plain = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0).cast(kind)).otherwise(x))
    twin = F.struct(F.xxhash64("embedding"), F.xxhash64(F.lit("second"), F.reverse("embedding")), F.size("embedding"))
    rows = rows.withColumn("embedding", plain).withColumn("twin", twin)
    found = rows.groupBy("label", "twin").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding"))
    return rows.select("vec_id", "label", "twin"), found.select(F.monotonically_increasing_id().alias("node"), "*", F.size("embedding").alias("dimension"))


def _by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimension, places and unit rows of the vectors of each dimension in a batch."""
    dimension = batch.column("dimension").to_numpy()
    for d in np.unique(dimension):
        here = np.flatnonzero(dimension == d)
        yield int(d), here, unit_rows(batch.column("embedding").take(pa.array(here)), int(d))


def centres(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Mean unit vector of each dimension over all nodes, summed by tasks and merged by aggregation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, rows in _by_dimension(batch):
                sums[d] = sums.get(d, 0) + np.append(rows.sum(axis=0), len(rows))
        for d, values in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d + 1, d, dtype=np.int32)), pa.array(np.arange(d + 1, dtype=np.int32)), pa.array(values)], names=["dimension", "place", "value"])

    out: dict[int, np.ndarray] = {}
    for r in nodes.select("dimension", "embedding").mapInArrow(run, "dimension int, place int, value double").groupBy("dimension", "place").agg(F.sum("value").alias("value")).collect():
        out.setdefault(r.dimension, np.zeros(r.dimension + 1))[r.place] = r.value
    return {d: v[:d] / max(v[d], 1) for d, v in out.items()}


def _codes(means: dict[int, np.ndarray], passes: int, bits: int, seed: int):
    """Node, small vector, bound of its error, and one sort code for each pass, as unsigned numbers of ``bits`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            n = batch.num_rows
            codes, small, error = np.zeros((n, passes), dtype=np.int64), [b""] * n, np.zeros(n, dtype=np.float32)
            for d, here, rows in _by_dimension(batch):
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, passes * bits))
                codes[here] = (((rows - means[d]) @ planes[d] > 0).reshape(-1, passes, bits) * weights).sum(axis=2)
                scale = np.abs(rows).max(axis=1, keepdims=True) / 127
                bytes_ = np.rint(rows / scale).astype(np.int8)
                back = bytes_ / np.sqrt((bytes_.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
                error[here] = np.nextafter(np.sqrt(((back - rows) ** 2).sum(axis=1)).astype(np.float32), np.float32(9))
                for k, row in zip(here.tolist(), bytes_, strict=True):
                    small[k] = row.tobytes()
            offsets = pa.array(np.arange(n + 1) * passes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("label_hash"), batch.column("dimension"), pa.array(small, pa.binary()), pa.array(error), pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()))],
                names=["node", "label_hash", "dimension", "small", "error", "codes"],
            )

    return run


_WINDOW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("border", pa.int64()), ("place", pa.int64()), ("number", pa.int64()), ("dimension", pa.int32()), ("node", pa.int64()), ("small", pa.binary()), ("error", pa.float32())])
_WINDOW_DDL = "a long, b long, border long, place long, number long, dimension int, node long, small binary, error float"


def _compare(table: pa.Table, fresh: int, threshold: float, window: int, apart: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Edges that connect the candidates in a sorted table: rows of one number at most ``window`` places apart (and of different ``apart``).

    The cosine of two small vectors differs from the true one by at most the sum of their errors
    and its square, so each pair at the threshold or above is a candidate.
    """
    number, node, dimension, error = (table.column(c).to_numpy() for c in ("number", "node", "dimension", "error"))
    classes = np.arange(len(node))
    bounds = group_bounds(number, dimension)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo < 2 or hi <= fresh:
            continue
        rows = np.frombuffer(b"".join(table.column("small").slice(lo, hi - lo).to_pylist()), dtype=np.int8).reshape(hi - lo, -1).astype(np.float32)
        rows /= np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        for at in range(0, hi - lo, 256):
            stop = min(at + 256, hi - lo)
            to = min(stop + window, hi - lo)
            slack = error[lo + at : lo + stop, None] + error[None, lo + at : lo + to]
            i, j = np.nonzero(rows[at:stop] @ rows[at:to].T >= threshold - slack - slack * slack - 1e-5)
            ok = (j > i) & (j - i <= window)
            if apart is not None:
                ok &= apart[lo + at + i] != apart[lo + at + j]
            classes = local_components(len(node), lo + at + i[ok], lo + at + j[ok], classes)
    moved = classes != np.arange(len(node))
    if moved.any():
        none = [pa.nulls(int(moved.sum()), f.type) for f in list(_WINDOW)[2:]]
        yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[classes[moved]]), *none], schema=_WINDOW)


def _windows(threshold: float, window: int):
    """Candidates in the windows of a sorted partition, and the first and last ``window`` rows for the partitions beside it."""

    def border(table: pa.Table, number: int, first: int) -> pa.RecordBatch:
        n = table.num_rows
        own = [table.column(c).combine_chunks() for c in ("number", "dimension", "node", "small", "error")]
        columns = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.full(n, number)), pa.array(np.arange(first, first + n)), *own]
        return pa.Table.from_arrays(columns, schema=_WINDOW).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tail, head = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if head is None or head.num_rows < window:
                head = table.slice(0, window) if head is None else pa.concat_tables([head, table.slice(0, window - head.num_rows)])
            fresh = tail.num_rows if tail is not None else 0
            table = pa.concat_tables([tail, table]).combine_chunks() if fresh else table
            yield from _compare(table, fresh, threshold, window)
            tail = table.slice(max(0, table.num_rows - window))
        if head is not None:
            yield border(head, own - 1, 0)
            yield border(tail, own, -tail.num_rows)

    return run


def _borders(threshold: float, window: int):
    """Candidates across the borders of partitions: a border's rows are the last ones before it, then the first ones after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["border"]):
            bounds = group_bounds(table.column("border").to_numpy())
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                part = table.slice(lo, hi - lo).combine_chunks()
                for found in _compare(part, 0, threshold, window, part.column("place").to_numpy() < 0):
                    yield found.select(["a", "b"])

    return run


def _verify(threshold: float, step: int = 1024):
    """Links of each row within a block of a class, or between two blocks, and the first row that they reach."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["component", "low", "high"], rows=4096):
            component, low, high, block, node, copies, dimension = (table.column(c).to_numpy() for c in ("component", "low", "high", "block", "node", "copies", "dimension"))
            links, root = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
            bounds = group_bounds(component, low, high)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                rows = unit_rows(table.column("embedding").slice(lo, hi - lo), int(dimension[lo]))
                for at in range(0, hi - lo, step):
                    near = rows[at : at + step] @ rows.T >= threshold
                    here = np.arange(near.shape[0])
                    near[here, at + here] = False
                    if low[lo] != high[lo]:  # rows of one block meet each other elsewhere
                        near &= block[lo + at : lo + at + len(here), None] != block[None, lo:hi]
                    links[lo + at : lo + at + len(here)] = near @ copies[lo:hi]
                    i, j = np.nonzero(near)
                    root = local_components(len(node), lo + at + i, lo + j, root)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(node[root])], schema=schema)

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98, passes: int = 10, window: int = 256, bits: int = 48, block: int = 4096, seed: int = 7) -> DataFrame:
    """Near-duplicate classes of ``vectors(vec_id, embedding, label)`` by cosine within equal labels.

    One row per row: ``vec_id, n_links long (other rows linked directly), component_id (smallest
    vec_id that links reach), kept boolean``. Vectors that are null, empty, zero or hold a null or
    non-finite component, and rows with a null label, link with nothing; vectors of different
    dimension have no cosine. A class of candidates is verified whole, so ``n_links`` has no bound;
    a link can be missed only where no pass brings its ends, or any chain of candidates between
    them, within ``window`` rows (the tests measure recall). Classes of over ``block`` different
    vectors are verified block against block. Repeated ids are rows of their own that count as one
    vector each; each gets the links of its own vector.
    """
    rows, found = distinct_vectors(vectors)
    rows, nodes = checkpoint(rows), checkpoint(found)
    width = shuffle_width(vectors.sparkSession)
    coded = nodes.select("node", F.xxhash64("label").alias("label_hash"), "embedding", "dimension").mapInArrow(_codes(centres(nodes), passes, bits, seed), "node long, label_hash long, dimension int, small binary, error float, codes array<long>")
    dealt = coded.select("label_hash", "node", "dimension", "small", "error", F.posexplode("codes").alias("pass", "code"))
    ordered = dealt.select(F.xxhash64("pass", "label_hash", "dimension").alias("number"), "code", "node", "dimension", "small", "error").repartitionByRange(width, "number", "code", "node").sortWithinPartitions("number", "code", "node")
    seen = checkpoint(ordered.mapInArrow(_windows(threshold, window), _WINDOW_DDL))
    at_borders = seen.where("border is not null").repartition("border").sortWithinPartitions("border", "place").mapInArrow(_borders(threshold, window), "a long, b long")
    candidates = connected_components(seen.where("a is not null").select("a", "b").unionByName(at_borders))
    members = checkpoint(nodes.select("node", "copies", "dimension", "embedding").join(candidates, "node"))
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    blocked = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    paired = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "copies", "dimension", "embedding"
    )
    keys = ["component", "low", "high"]
    verified = checkpoint(paired.repartition(width, *keys).sortWithinPartitions(*keys).mapInArrow(_verify(threshold), "node long, links long, root long"))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = nodes.select("node", "first", "label", "twin", "copies").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    summary = placed.join(least, "component").join(links, "node", "left").select("label", "twin", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = rows.join(checkpoint(summary), ["label", "twin"]).select("vec_id", "n_links", "component_id")
    alone = vectors.where(~comparable())
    every = linked.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
