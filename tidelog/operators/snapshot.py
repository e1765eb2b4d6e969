"""Snapshots of versioned rows as of an LSN."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.schema import LSN


def stamp(batch: DataFrame, lsn: int) -> DataFrame:
    """A batch with its LSN."""
    return batch.withColumn(LSN, F.lit(lsn).cast("long"))


def as_of(rows: DataFrame, lsn: int) -> DataFrame:
    return rows.where(F.col(LSN) <= lsn)


def distinct_deletes(deletes: DataFrame, keys: list[str]) -> DataFrame:
    """One delete for each row: a repeated delete leaves the first LSN."""
    return deletes.groupBy(*keys).agg(F.min("delete_lsn").alias("delete_lsn"))


def snapshot(rows: DataFrame, deletes: DataFrame, keys: list[str], lsn: int) -> DataFrame:
    """Rows inserted up to `lsn` less those that `deletes` (keys, delete_lsn) removed up to `lsn`, row by row."""
    gone = deletes.where(F.col("delete_lsn") <= lsn).select(*keys)
    return as_of(rows, lsn).join(gone, keys, "left_anti")


def snapshot_by_batch(rows: DataFrame, deletes: DataFrame, keys: list[str], lsn: int) -> DataFrame:
    """The same where deletes show batch by batch: those of a batch (column target_lsn) all at its last delete's LSN."""
    last = deletes.groupBy("target_lsn").agg(F.max("delete_lsn").alias("last")).where((F.col("last") > 0) & (F.col("last") <= lsn))
    gone = deletes.join(last, "target_lsn", "left_semi").select(*keys)
    return as_of(rows, lsn).join(gone, keys, "left_anti")
