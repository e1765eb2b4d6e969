"""Change data: latest state by key, applied updates and deletes, resolution of deletes to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.schema import LSN


def latest_by_key(rows: DataFrame, keys: list[str], order: Column, deleted: Column | None = None) -> DataFrame:
    """Of each key the last row, unless it is a delete. An aggregation: rows combine before the shuffle, none are sorted."""
    body = F.struct(*[F.col(c) for c in rows.columns])
    last = rows.withColumn("__order", order).withColumn("__dead", deleted if deleted is not None else F.lit(False))
    last = last.groupBy(*keys).agg(F.max_by(F.struct(body.alias("row"), F.col("__dead").alias("dead")), F.col("__order")).alias("last"))
    return last.where(~F.col("last.dead")).select("last.row.*")


def apply_updates(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with the rows of `changes` in place of those with the same keys; keys without a row are left out."""
    there = changes.join(rows.select(*keys).distinct(), keys, "left_semi")
    return rows.join(changes.select(*keys), keys, "left_anti").unionByName(there)


def apply_changes(rows: DataFrame, changes: DataFrame, keys: list[str], op: str = "op") -> DataFrame:
    """`rows` after a change log (keys, columns, op: delete, update or insert, LSN): the last change of each key counts."""
    last = latest_by_key(changes, keys, F.col(LSN))
    kept = rows.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last.where(F.col(op) != "delete").select(*rows.columns))


def locate(rows: DataFrame, wanted: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """The newest place of each wanted key (null keys have none). `rows` carries the columns `place`."""
    found = rows.join(wanted.select(*keys).dropna(subset=keys).distinct(), keys)
    where = F.struct(F.col(LSN), *[F.col(p) for p in place])
    return found.groupBy(*keys).agg(F.max(where).alias("at")).select(*keys, F.col(f"at.{LSN}").alias(LSN), *[F.col(f"at.{p}").alias(p) for p in place])
