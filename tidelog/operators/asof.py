"""As-of joins: each row with the nearest one of another table by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, forward: bool = False, exact: bool = True) -> DataFrame:
    """Rows of `left` with the columns of the last row of `right` that has the same keys and is not later (`forward`: the first
    one that is not earlier; not `exact`: strictly so); nulls where there is none, and for null keys and times.

    Both sides are sorted together by key and time, and each row takes up the last one of the other side that was passed: one shuffle,
    no pairs. Of several rows of `right` at one time, the one with the largest columns counts.
    """
    extra = [c for c in right.columns if c not in (*keys, time)]
    clash = [c for c in extra if c in left.columns]
    if clash:
        raise ValueError(f"both sides have {clash}")
    # At equal times, what may match has to be passed first.
    mine, theirs = (1, 0) if exact else (0, 1)
    rows = left.select(*keys, F.col(time).alias("__time"), F.lit(mine).alias("__side"), F.struct(*[F.col(c) for c in left.columns]).alias("__left"))
    other = right.dropna(subset=[*keys, time]).select(*keys, F.col(time).alias("__time"), F.lit(theirs).alias("__side"), F.struct(*[F.col(c) for c in extra]).alias("__right"))
    both = rows.unionByName(other, allowMissingColumns=True)
    by_time = F.col("__time").desc_nulls_first() if forward else F.col("__time").asc_nulls_first()
    passed = Window.partitionBy(*keys).orderBy(by_time, "__side", F.col("__right").asc()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__right", F.last("__right", ignorenulls=True).over(passed)).where(F.col("__side") == mine)
    return found.select("__left.*", *[F.col(f"__right.{c}").alias(c) for c in extra])
