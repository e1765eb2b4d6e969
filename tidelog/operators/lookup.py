"""Key lookups and statistics of a key index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.schema import LSN

#: Bytes that an index entry is reckoned with in memory and on disk.
ENTRY_BYTES, DISK_ENTRY_BYTES = 48, 84


def lookup(rows: DataFrame, keys: list[str], values: tuple) -> DataFrame:
    """The newest row of a key: one equality a key column, which reaches the scan as a pushed filter."""
    found = rows.where(reduce(lambda a, b: a & b, (F.col(k) == F.lit(v) for k, v in zip(keys, values, strict=True))))
    return found.orderBy(F.col(LSN).desc()).limit(1) if LSN in rows.columns else found


def lookup_many(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(wanted.select(*keys).distinct(), keys, "left_semi")


def exists(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """`wanted` with `found`: whether the key is there, exactly."""
    there = rows.select(*keys).distinct().withColumn("__there", F.lit(True))
    return wanted.join(there, keys, "left").withColumn("found", F.coalesce("__there", F.lit(False))).drop("__there")


def index_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Entries, repeated keys and memory of an index over the keys; null keys are not indexed."""
    per_key = rows.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n"))
    out = per_key.agg(F.count("*").alias("entries"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return out.select("entries", (F.col("n") - F.col("entries")).cast("long").alias("collisions"), (F.col("entries") * ENTRY_BYTES).cast("long").alias("memory_bytes"))


def key_index(rows: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """The newest place of every key."""
    where = F.struct(F.col(LSN), *[F.col(p) for p in place if p != LSN])
    return rows.dropna(subset=keys).groupBy(*keys).agg(F.max(where).alias("at")).select(*keys, *[F.col(f"at.{p}").alias(p) for p in place])


def without_segment(index: DataFrame, seg_id: int) -> DataFrame:
    """The index after a segment has gone: only keys whose newest place was there."""
    return index.where(F.col("seg_id") != seg_id)


def keys_of_segment(index: DataFrame, seg_id: int, keys: list[str]) -> DataFrame:
    return index.where(F.col("seg_id") == seg_id).select(*keys)


def without_keys(index: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return index.join(gone.select(*keys), keys, "left_anti")


def with_segment(index: DataFrame, fresh: DataFrame, keys: list[str], seg_id: int) -> DataFrame:
    """The index after a segment's keys are listed anew: they replace what was listed for it, and their older places."""
    return without_keys(without_segment(index, seg_id), fresh, keys).unionByName(fresh.select(*index.columns))


def disk_index_stats(index: DataFrame) -> DataFrame:
    """Keys, segments and memory of a key index."""
    return index.agg(F.count("*").alias("entries"), F.count_distinct("seg_id").alias("segments"), (F.count("*") * DISK_ENTRY_BYTES).cast("long").alias("memory_bytes"))
