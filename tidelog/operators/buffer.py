"""Write buffers: which batches are frozen together, and presets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MB = 1 << 20
#: Batches whose rows are summed up together before their LSNs are dealt out.
SPAN = 1024


@dataclass(frozen=True)
class BufferConfig:
    """Limits of a write buffer, and how long it waits. `total` bounds what is not flushed yet. The presets are fixed values."""

    total: int = 512 * MB
    size: int = 64 * MB
    batches: int = 1000
    interval_ms: int = 100

    @staticmethod
    def high_throughput() -> BufferConfig:
        return BufferConfig(1024 * MB, 128 * MB, 10_000, 500)

    @staticmethod
    def low_latency() -> BufferConfig:
        return BufferConfig(128 * MB, 16 * MB, 100, 50)

    def options(self) -> dict[str, str]:
        """The same as options of a file stream: a trigger's files and bytes bound what is in flight."""
        return {"maxFilesPerTrigger": str(self.batches), "maxBytesPerTrigger": str(self.size)}

    def full(self, size: int, batches: int) -> bool:
        return size >= self.size or batches >= self.batches


@dataclass(frozen=True)
class TableConfig:
    """How a kind of table is meant to be used."""

    indexed: bool
    buffer: BufferConfig
    durability: str = "Durable"

    @staticmethod
    def append_only() -> TableConfig:
        return TableConfig(False, BufferConfig.high_throughput(), "Buffered")

    @staticmethod
    def primary_key() -> TableConfig:
        return TableConfig(True, BufferConfig())

    @staticmethod
    def analytical() -> TableConfig:
        return TableConfig(True, BufferConfig.high_throughput())


def freeze_plan(batches: DataFrame, config: BufferConfig) -> DataFrame:
    """`batches` (batch, rows, bytes) with the buffer each lands in: a buffer is frozen once it is full.

    Where a buffer ends depends on where the one before ended, so the batches are folded in order, in one pass that holds
    one record batch at a time. These are a row for each batch of a table's log: metadata, not the table's rows.
    """

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = size = count = 0
        for part in parts:
            out = []
            for own in part.column(1).to_pylist():
                out.append(buffer)
                size, count = size + own, count + 1
                if size >= config.size or count >= config.batches:
                    buffer, size, count = buffer + 1, 0, 0
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.int64())], names=["batch", "buffer"])

    ordered = batches.select(F.col("batch").cast("long").alias("batch"), F.coalesce(F.col("bytes").cast("long"), F.lit(0)).alias("bytes")).repartition(1).sortWithinPartitions("batch")
    return batches.join(ordered.mapInArrow(fold, "batch long, buffer long"), "batch")


def lsn_ranges(batches: DataFrame) -> DataFrame:
    """`batches` (batch, rows) with the inclusive range of LSNs that numbering their rows would take.

    A running sum in two steps: over spans of SPAN batch numbers, of which there are few, and within each span.
    """
    rows = batches.withColumn("__span", F.floor(F.col("batch") / F.lit(SPAN)))
    spans = rows.groupBy("__span").agg(F.sum("rows").alias("__all"))
    spans = spans.select("__span", (F.sum("__all").over(Window.orderBy("__span")) - F.col("__all")).alias("__before"))
    end = F.col("__before") + F.sum("rows").over(Window.partitionBy("__span").orderBy("batch"))
    found = rows.join(spans, "__span").withColumn("end_lsn", end.cast("long"))
    return found.withColumn("start_lsn", (F.col("end_lsn") - F.col("rows") + 1).cast("long")).drop("__span", "__before")


def lag(next_lsn: int, flushed: int, committed: int) -> tuple[int, int]:
    """What is still to flush and to commit."""
    return max(0, next_lsn - flushed), max(0, flushed - committed)
