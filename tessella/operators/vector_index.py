"""A vector index in files: k-means cells as a partition column, one-byte residual codes, exact vectors beside them.

A search looks only into the cells nearest to a query, scores their codes, takes some more rows than
asked for, and ranks these by their exact vectors. Cells are pruned as partitions, and the vectors of
rows that are no candidates are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.vectors import cosine
from tessella.operators import search
from tessella.operators.graph import checkpoint

#: Vectors that cells are fitted on and queries that probes are counted on, at most: those of the smallest hash of their key.
SAMPLE, TRIED = 20_000, 200
#: Bytes of the cells' centres, which go to every task, at most.
CENTRE_BYTES = 64 << 20
#: Rows of one cell that meet queries in one task; larger cells are dealt out by a hash of the key.
ROWS = 50_000
#: Candidates that are ranked exactly, for each row asked for.
OVER = 2
#: Candidates that go to every task to fetch their vectors; more are joined by a shuffle.
FEW = 500_000


@dataclass(frozen=True)
class Settings:
    """What is fitted. ``probes`` cells a query hold ``expected`` of the nearest rows, as counted on the sample's queries."""

    key: str
    kind: str
    dimensions: int
    probes: int
    expected: float


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: no null, finite entries, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class VectorIndex:
    """An index in a folder that driver and executors share.

    Rows are files under ``rows/seq=<write>/cell=<cell>``: key, bucket within the cell, residual code
    and vector. A write appends; what it replaces or deletes is noted under ``gone`` with its number,
    and readers leave out older rows of these keys. :meth:`build` on ``exact_rows`` compacts.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.settings = Settings(**json.loads(spark.read.text(f"{self.folder}/settings").first().value))
        cells = sorted(spark.read.parquet(f"{self.folder}/centres").collect(), key=lambda r: r.cell)  # bounded by CENTRE_BYTES
        self.centres, self.scale = np.array([c.centre for c in cells]), np.array(cells[0].scale)

    # writing

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, key: str = "id", cells: int | None = None, target: float = 0.95, k: int = 10) -> VectorIndex:
        """Index ``vectors(key, vector)``, all of one length; rows whose vector has no direction are similar to nothing and left out.

        There are about as many cells as the root of the number of rows, as far as ``CENTRE_BYTES``
        lets them, fitted on ``SAMPLE`` vectors. Every row is indexed. ``probes`` is the least number
        of cells that hold the share ``target`` of the ``k`` nearest rows of ``TRIED`` rows, found
        exactly, so it follows the data: vectors without clusters need many.
        """
        spark, folder = vectors.sparkSession, folder.rstrip("/")
        rows = vectors.select(key, "vector").where(usable(F.col("vector")))
        counted = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d"), F.min(F.size("vector")).alias("least")).first()
        if not counted.n:
            raise ValueError("there is no vector to index")
        if counted.d != counted.least:
            raise ValueError(f"vectors have {counted.least} to {counted.d} dimensions")
        most = max(1, CENTRE_BYTES // (8 * counted.d))
        sample = checkpoint(rows.orderBy(F.xxhash64(key), key).limit(SAMPLE))
        centres = _centres(sample, max(1, min(cells or int(counted.n**0.5), most, counted.n)))
        unit = search.matrix(sample.select("vector").toArrow().column(0))  # SAMPLE rows
        scale = np.maximum(np.abs(unit - centres[(unit @ centres.T).argmax(axis=1)]).max(axis=0), 1e-12) * 1.25 / 127
        spark.createDataFrame([(i, c.tolist(), scale.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>, scale array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centres")
        settings = Settings(key, dict(vectors.dtypes)[key], counted.d, len(centres), 1.0)
        _settings(spark, folder, settings)
        index = cls(spark, folder)
        index._write(rows, 1, "overwrite")
        probes, expected = index._probes(rows, sample.orderBy(F.xxhash64(key), key).limit(TRIED), k, target)
        _settings(spark, folder, Settings(key, settings.kind, settings.dimensions, probes, expected))
        return cls(spark, folder)

    def upsert(self, vectors: DataFrame) -> None:
        """Add rows, or put them in the place of rows of the same key; cells stay as they are fitted (K6)."""
        number = self._next()
        rows = vectors.select(self.settings.key, "vector")
        self._gone(rows, number)
        self._write(rows.where(usable(F.col("vector"))), number, "append")

    def delete(self, keys: DataFrame) -> None:
        """Remove rows; keys that are not there are ignored."""
        self._gone(keys, self._next())

    def _gone(self, keys: DataFrame, number: int) -> None:
        keys.select(F.col(self.settings.key).alias("__key")).distinct().write.parquet(f"{self.folder}/gone/seq={number}")

    def _next(self) -> int:
        found = [1]
        for part in ("rows", "gone"):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
            files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            if files.exists(path):
                found += [int(f.getPath().getName().removeprefix("seq=")) for f in files.listStatus(path) if f.getPath().getName().startswith("seq=")]
        return max(found) + 1

    def _write(self, rows: DataFrame, number: int, mode: str) -> None:
        key, centres, scale = self.settings.key, self.centres, self.scale
        shared = self.spark.sparkContext.broadcast((centres, scale))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, scale = shared.value
            for batch in batches:
                if batch.num_rows:
                    unit = search.matrix(batch.column(1))
                    cell = (unit @ centres.T).argmax(axis=1)
                    code = np.clip(np.rint((unit - centres[cell]) / scale), -127, 127).astype(np.int8)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(cell.astype(np.int32))], names=[key, "vector", "code", "cell"])

        placed = rows.select(key, F.transform("vector", lambda x: x.cast("float")).alias("vector")).mapInArrow(run, f"{key} {self.settings.kind}, vector array<float>, code binary, cell int")
        # a cell's rows are dealt to several writers by the key, so that a hot cell is not one task's work
        width = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = placed.withColumn("__deal", F.pmod(F.xxhash64(key), F.lit(4))).repartition(width, "cell", "__deal").drop("__deal").sortWithinPartitions("cell")
        dealt.write.mode(mode).partitionBy("cell").option("maxRecordsPerFile", ROWS * 4).parquet(f"{self.folder}/rows/seq={number}")

    def _probes(self, rows: DataFrame, tried: DataFrame, k: int, target: float) -> tuple[int, float]:
        key = self.settings.key
        asked = tried.select(F.col(key).alias("query_id"), "vector")
        near = search.top_k_batch(rows, asked, k + 1, key).where(F.col(key) != F.col("query_id"))
        at = near.join(self.rows().select(key, "cell"), key).select("query_id", "cell").toArrow()  # TRIED times k rows
        if not at.num_rows:
            return 1, 1.0
        queries = asked.toArrow()
        order = np.argsort(-(search.matrix(queries.column("vector")) @ self.centres.T), axis=1, kind="stable")
        rank = np.argsort(order, axis=1)
        place = {q: i for i, q in enumerate(queries.column("query_id").to_pylist())}
        needed = np.array([rank[place[q], c] for q, c in zip(at.column("query_id").to_pylist(), at.column("cell").to_pylist(), strict=True)]) + 1
        share = np.array([(needed <= p).mean() for p in range(1, len(self.centres) + 1)])
        probes = int(np.flatnonzero(share >= min(target, 1.0))[0]) + 1
        return probes, float(share[probes - 1])

    # reading

    def rows(self) -> DataFrame:
        """All rows that are there now: key, vector, code, seq, cell."""
        found = self.spark.read.parquet(f"{self.folder}/rows")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/gone")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return found
        gone = self.spark.read.parquet(f"{self.folder}/gone").groupBy("__key").agg(F.max("seq").alias("__seq"))
        return found.join(gone, (F.col(self.settings.key) == F.col("__key")) & (F.col("seq") < F.col("__seq")), "left_anti")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, threshold: float | None = None) -> DataFrame:
        """The ``k`` rows most similar to each of ``queries(query_id, vector)``, with exact cosines and ``rn`` (VS7, VS14).

        ``probes`` cells a query are looked into, all of them if there are fewer, so with as many as
        cells only the codes' rounding can lose a row. Queries without a direction find nothing. Ties go by key.
        """
        key, p = self.settings.key, min(probes or self.settings.probes, len(self.centres))
        asked = queries.where(usable(F.col("vector"))).select("query_id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
        aimed = checkpoint(self._aimed(asked, p))
        counts = {r.cell: r.n for r in aimed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row for each cell
        kind = f"query_id {dict(queries.dtypes)['query_id']}"
        rows = self.rows().where(F.col("cell").isin(list(counts))) if len(counts) < len(self.centres) else self.rows()
        scored = f"{kind}, {key} {self.settings.kind}, cell int, near double"
        n = sum(counts.values()) // max(p, 1)
        if n <= search.BLOCK:
            found = rows.select(key, "cell", "code").mapInArrow(self._score(aimed.toArrow(), k * OVER), scored)
        else:
            found = self._grouped(rows, aimed, counts, k * OVER, scored)
        order = Window.partitionBy("query_id").orderBy(F.desc("near"), key)
        candidates = found.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= k * OVER).select("query_id", key, "cell")
        candidates = F.broadcast(candidates) if n * k * OVER <= FEW else candidates
        exact = rows.select(key, "cell", "vector").join(candidates, [key, "cell"])
        exact = exact.join(F.broadcast(asked.withColumnRenamed("vector", "__q")) if n <= search.BLOCK else asked.withColumnRenamed("vector", "__q"), "query_id")
        exact = exact.select("query_id", key, cosine(F.col("vector"), F.col("__q")).alias("similarity"))
        if threshold is not None:
            exact = exact.where(F.col("similarity") >= threshold)
        best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
        return exact.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k)

    def _aimed(self, asked: DataFrame, p: int) -> DataFrame:
        """``query_id, vector, cell`` for the ``p`` nearest cells of each query."""
        shared = self.spark.sparkContext.broadcast(self.centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cells = np.argsort(-(search.matrix(batch.column(1)) @ shared.value.T), axis=1, kind="stable")[:, :p].astype(np.int32)
                    again = pa.array(np.repeat(np.arange(batch.num_rows), p))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(again), batch.column(1).take(again), pa.array(cells.ravel())], names=["query_id", "vector", "cell"])

        return asked.mapInArrow(run, f"query_id {dict(asked.dtypes)['query_id']}, vector array<double>, cell int")

    def _score(self, aimed: pa.Table, k: int):
        key, centres, scale = self.settings.key, self.centres, self.scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not aimed.num_rows:
                return
            asked, wanted = search.matrix(aimed.column("vector")), aimed.column("cell").to_numpy()
            by_cell = {c: np.flatnonzero(wanted == c) for c in np.unique(wanted)}
            best: dict[int, search.Best] = {}
            for batch in batches:
                cells = batch.column(1).to_numpy(zero_copy_only=False)
                for c in np.unique(cells):
                    if c in by_cell:
                        own = batch.filter(pa.array(cells == c))
                        held = best.setdefault(c, search.Best(len(by_cell[c]), k, own.schema.field(0)))
                        held.scan(own, key, lambda part, c=c: _near(asked[by_cell[c]], part.column(2), centres[c], scale))
            for c, held in best.items():
                found = held.result()
                yield from _named(found, aimed.column("query_id").take(pa.array(by_cell[c])), key, c)

        return run

    def _grouped(self, rows: DataFrame, aimed: DataFrame, counts: dict[int, int], k: int, schema: str) -> DataFrame:
        """Candidates where there are many queries: rows and queries of a cell meet in groups of bounded size."""
        key, centres, scale = self.settings.key, self.centres, self.scale
        sizes = {r.cell: r.n for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row for each cell
        split = [(c, max(1, -(-sizes.get(c, 0) // ROWS)), max(1, -(-n // search.BLOCK))) for c, n in counts.items()]
        plan = F.broadcast(self.spark.createDataFrame(split, "cell int, rows_in int, queries_in int"))
        each = lambda m, name: F.explode(F.sequence(F.lit(0), F.col(m) - 1)).alias(name)
        left = rows.select(key, "cell", "code").join(plan, "cell").withColumn("g", F.pmod(F.xxhash64(key), F.col("rows_in")).cast("int")).select(key, "cell", "code", "g", each("queries_in", "h"))
        right = aimed.join(plan, "cell").withColumn("h", F.pmod(F.xxhash64("query_id"), F.col("queries_in")).cast("int")).select("query_id", "vector", "cell", "h", each("rows_in", "g"))

        def run(table: pa.Table, asked: pa.Table) -> pa.Table:
            best = search.Best(asked.num_rows, k, table.schema.field(key))
            cell = (table if table.num_rows else asked).column("cell")[0].as_py()
            if table.num_rows and asked.num_rows:
                unit = search.matrix(asked.column("vector"))
                for batch in table.to_batches():
                    best.scan(batch, key, lambda part: _near(unit, part.column("code"), centres[cell], scale))
            return pa.Table.from_batches(_named(best.result(), asked.column("query_id"), key, cell)) if best.held else pa.table({"query_id": asked.column("query_id").slice(0, 0), key: table.column(key).slice(0, 0), "cell": pa.array([], pa.int32()), "near": pa.array([], pa.float64())})

        return left.groupBy("cell", "g", "h").cogroup(right.groupBy("cell", "g", "h")).applyInArrow(run, schema)


def _near(asked: np.ndarray, codes: pa.Array, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Cosines of unit queries and coded rows of a cell, as far as codes tell."""
    values = np.frombuffer(b"".join(codes.to_pylist()), dtype=np.int8).reshape(len(codes), -1).astype(np.float32)
    return (asked @ centre)[:, None] + (asked * scale).astype(np.float32) @ values.T


def _named(found: pa.Table, names: pa.Array | pa.ChunkedArray, key: str, cell: int) -> list[pa.RecordBatch]:
    made = pa.Table.from_arrays([names.take(found.column("q")), found.column(1), pa.array(np.full(found.num_rows, cell, dtype=np.int32)), found.column(2)], names=["query_id", key, "cell", "near"])
    return made.combine_chunks().to_batches()


def _centres(sample: DataFrame, cells: int) -> np.ndarray:
    """Unit centres of k-means cells."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = sample.select(array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("features"))
    found = np.array(KMeans(k=cells, seed=7, maxIter=10, distanceMeasure="cosine").fit(points).clusterCenters())
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-300)


def _settings(spark: SparkSession, folder: str, settings: Settings) -> None:
    spark.createDataFrame([(json.dumps(asdict(settings)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/settings")
