"""Statistics of segments: rows, LSN and time range, minimum, maximum and nulls of each comparable column, and NaNs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.schema import LSN, comparable, time_column


def bounds(schema: T.StructType, columns: list[str] | None = None) -> list[Column]:
    """min_, max_ and nulls_ of every comparable column; NaN counts neither as minimum nor as maximum, but in nans_ of floating columns."""
    out = []
    for f in schema.fields:
        if not comparable(f.dataType) or (columns is not None and f.name not in columns):
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.count_if(F.isnan(c)).alias(f"nans_{f.name}"))
            c = F.when(~F.isnan(c), c)
        out += [F.min(c).alias(f"min_{f.name}"), F.max(c).alias(f"max_{f.name}"), F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"nulls_{f.name}")]
    return out


def ranges(schema: T.StructType) -> list[Column]:
    """rows, and min_lsn, max_lsn, min_time, max_time where the columns are there (null else, meaning unknown)."""
    names = schema.names
    time = time_column(names)
    out = [F.count("*").alias("rows")]
    out += [f(F.col(LSN) if LSN in names else F.lit(None).cast("long")).alias(n) for f, n in ((F.min, "min_lsn"), (F.max, "max_lsn"))]
    return out + [f(F.col(time) if time else F.lit(None).cast("timestamp_ntz")).alias(n) for f, n in ((F.min, "min_time"), (F.max, "max_time"))]


def segment_stats(rows: DataFrame, segment: str, columns: list[str] | None = None) -> DataFrame:
    """One row a segment, all statistics in a single aggregation."""
    return rows.groupBy(segment).agg(*ranges(rows.schema), *bounds(rows.schema, columns))


def merge_stats(parts: DataFrame, segment: str) -> DataFrame:
    """Statistics of segments from those of their batches, compared by type."""
    how = {"min": F.min, "max": F.max, "rows": F.sum, "nulls": F.sum, "nans": F.sum}
    return parts.groupBy(segment).agg(*[how[c.split("_")[0]](f"`{c}`").alias(c) for c in parts.columns if c != segment and c.split("_")[0] in how])


def overlaps_time(start: Column, end: Column) -> Column:
    """Inclusive overlap of a segment's time range; an unknown range overlaps."""
    return F.coalesce((F.col("min_time") <= end) & (F.col("max_time") >= start), F.lit(True))


def contains_lsn(lsn: int) -> Column:
    return F.lit(lsn).between(F.col("min_lsn"), F.col("max_lsn"))


def all_null(column: str) -> Column:
    return F.col(f"nulls_{column}") == F.col("rows")


def null_fraction(column: str) -> Column:
    return F.when(F.col("rows") == 0, F.lit(0.0)).otherwise(F.col(f"nulls_{column}") / F.col("rows"))


def totals(segments: DataFrame) -> DataFrame:
    return segments.agg(F.count("*").alias("segments"), F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))
