"""What the registered queries start from: events and orders as versioned tables, in DataFrames and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, name: str | None = None):
    """Registers a query under its function's name, with its oracle if there is one."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in ten batches at LSN 1 to 10. The count comes from the files' footers."""
    rows = table(spark, sf_dir, "events")
    return rows.withColumn("__lsn", F.expr(f"event_id * 10 div {max(1, rows.count())} + 1"))


def deletes(rows: DataFrame, count: int) -> DataFrame:
    """Errors are deleted, in order, at LSN 11 to 30."""
    return rows.where("event_type = 'error'").select("event_id", F.col("__lsn").alias("target_lsn"), F.expr(f"event_id * 20 div {max(1, count)} + 11").alias("delete_lsn"))


#: The same in DuckDB: e (events), d (deletes).
E = "WITH n AS (SELECT greatest(1, count(*)) AS n FROM events), e AS (SELECT *, event_id * 10 // (SELECT n FROM n) + 1 AS __lsn FROM events), d AS (SELECT event_id, __lsn AS target_lsn, event_id * 20 // (SELECT n FROM n) + 11 AS delete_lsn FROM e WHERE event_type = 'error')"
#: Statistics of the ten segments (s).
S = E + ", s AS (SELECT __lsn AS seg_id, count(*) AS rows, min(__lsn) AS min_lsn, max(__lsn) AS max_lsn, min(ts) AS min_time, max(ts) AS max_time, min(value) AS min_value, max(value) AS max_value, min(event_type) AS min_event_type, max(event_type) AS max_event_type, min(event_id) AS min_event_id, max(event_id) AS max_event_id FROM e GROUP BY __lsn)"
