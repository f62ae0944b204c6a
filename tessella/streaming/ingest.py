"""Incremental ingestion by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.api import GraphRetrieval
from tessella.operators import chunking, kv


def document_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 10) -> DataFrame:
    """New Parquet files of a folder, ``files_per_batch`` in each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


#: Keeps stream state on the executors' disks, and its changes in the checkpoint, instead of in their heaps.
STATE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def new_documents(stream: DataFrame) -> DataFrame:
    """Documents of ``stream(text)`` as :func:`tessella.operators.chunking.ingest` gives them, each content once in the stream's life.

    Ids that were seen are the stream's state, by key, so a micro-batch looks up its own ids only. A
    micro-batch that runs again after a failure begins from the state before it and gives the same rows.
    """
    return chunking.described(stream).dropDuplicates(["id"])


def _started(frame: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    """Start a query whose state is in RocksDB; the session's own setting comes back."""
    spark = frame.sparkSession
    before = spark.conf.get(STATE[0], None)
    spark.conf.set(*STATE)
    try:
        writer = frame.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
    finally:
        spark.conf.unset(STATE[0]) if before is None else spark.conf.set(STATE[0], before)


def ingest(stream: DataFrame, target: str, checkpoint: str, size: int = 1200, overlap: int = 100, once: bool = False) -> StreamingQuery:
    """Write documents, chunks and states of ``stream(text)`` under ``target``, each document once.

    Only a micro-batch's own rows are read and written: what came before is state of the stream. A
    micro-batch overwrites its own partition, so one that runs again leaves the same rows. ``once``
    takes what is there and stops; a later call with the same ``checkpoint`` goes on from there.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{target}/documents/batch={epoch}")
        new = spark.read.schema(batch.schema).parquet(f"{target}/documents/batch={epoch}")
        chunks = chunking.by_tokens(new.select(F.col("id").alias("full_doc_id"), F.col("content").alias("text")), size, overlap, "full_doc_id")
        chunks.write.mode("overwrite").parquet(f"{target}/chunks/batch={epoch}")
        new.select("id", F.lit("processed").alias("status")).write.mode("overwrite").parquet(f"{target}/status/batch={epoch}")

    return _started(new_documents(stream), write, checkpoint, once)


def index(stream: DataFrame, engine: GraphRetrieval, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Index ``stream(text)`` with an engine: documents, chunks and the graph, failed documents marked and tried again.

    Each content reaches the engine once, and the engine takes a document once, so a micro-batch that
    runs again after a failure adds nothing. Each micro-batch also retries those that failed before
    and whose pause is over; attempts and times are in the engine's table of states.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        engine.insert(batch.select(F.col("content").alias("text")))
        if epoch:
            engine.retry(due_only=True)

    return _started(new_documents(stream), write, checkpoint, once)


def progress(spark: SparkSession, target: str) -> DataFrame:
    """Documents in each state so far."""
    return kv.status_counts(spark.read.parquet(f"{target}/status"))
