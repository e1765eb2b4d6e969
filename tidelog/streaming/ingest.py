"""Streaming ingest: each micro-batch is one append, acknowledged once it is durable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidelog.operators.buffer import BufferConfig
from tidelog.sources.table import Ack, EmptyBatch, Table, Tier


def file_stream(spark: SparkSession, path: str, schema, config: BufferConfig | None = None, files: int | None = None) -> DataFrame:
    """A stream over Parquet files; the buffer's limits bound each micro-batch."""
    options = {"maxFilesPerTrigger": str(files)} if files else (config or BufferConfig()).options()
    if "maxFilesPerTrigger" in options and "maxBytesPerTrigger" in options:
        options = {"maxBytesPerTrigger": options["maxBytesPerTrigger"]}  # Spark takes one of the two
    return spark.readStream.schema(schema).options(**options).parquet(path)


def write_stream(stream: DataFrame, table: Table, checkpoint: str, config: BufferConfig | None = None, once: bool = False, on_ack: Callable[[Ack], None] | None = None) -> StreamingQuery:
    """Appends every micro-batch to the table. A batch that is run again after a failure is recognised by its number and
    not appended twice, so rows arrive exactly once. Empty micro-batches take no LSN."""
    def commit(batch: DataFrame, number: int) -> None:
        try:
            acks = table.append(batch, idempotency_key=f"{checkpoint}#{number}")
        except EmptyBatch:
            return
        for ack in acks if on_ack else ():
            on_ack(ack)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(commit)
    wait = (config or BufferConfig()).interval_ms
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{wait} milliseconds")).start()


class Progress(StreamingQueryListener):
    """What the streams of a session have done: by query, micro-batches, rows, and the last error."""

    def __init__(self) -> None:
        self.batches: dict[str, int] = {}
        self.rows: dict[str, int] = {}
        self.errors: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        self.batches.setdefault(str(event.id), 0)
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        key = str(event.progress.id)
        self.batches[key] = self.batches.get(key, 0) + 1
        self.rows[key] = self.rows.get(key, 0) + event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.errors[str(event.id)] = event.exception


def windowed_counts(stream: DataFrame, time: str, size: str, late: str, *keys: str) -> DataFrame:
    """Rows by window of event time and keys; rows later than `late` are dropped."""
    at = stream.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", late)
    return at.groupBy(F.window("__time", size), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def ack_log(segments: DataFrame, flushed: int) -> DataFrame:
    """One row for each LSN and tier reached: memory for every LSN, disk up to the flushed watermark."""
    tiers = F.when(F.col("lsn") <= flushed, F.array(F.lit(Tier.MEMORY.name), F.lit(Tier.DISK.name))).otherwise(F.array(F.lit(Tier.MEMORY.name)))
    return segments.select("lsn", F.explode(tiers).alias("tier"))
