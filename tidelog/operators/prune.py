"""Predicates that prune segments by their statistics and filter the rows of the segments kept."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.stats import overlaps_time


class Predicate:
    """A condition on rows, and what it asks of a segment's statistics."""

    def rows(self) -> Column:
        raise NotImplementedError

    def keeps(self, columns: list[str]) -> Column:
        """Whether a segment may hold such rows; without statistics of the column it may."""
        raise NotImplementedError

    def __and__(self, other: Predicate) -> Predicate:
        return All((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Any_((self, other))


def _known(column: str, columns: list[str], test: Column, nan: Column) -> Column:
    """`test` of the bounds, or `nan` where the segment has NaN, which the bounds leave out. What is unknown may be."""
    if f"nans_{column}" in columns:
        test = test | (nan & F.coalesce(F.col(f"`nans_{column}`") > 0, F.lit(True)))
    return F.coalesce(test, F.lit(True))


@dataclass(frozen=True)
class Compare(Predicate):
    """A comparison with a value. NaN equals itself and is larger than any number."""

    column: str
    op: str
    value: Any

    def rows(self) -> Column:
        c, v = F.col(f"`{self.column}`"), F.lit(self.value)
        return {"=": c == v, ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v, "!=": c != v}[self.op]

    def keeps(self, columns: list[str]) -> Column:
        if f"min_{self.column}" not in columns:
            return F.lit(True)
        low, high, v = F.col(f"`min_{self.column}`"), F.col(f"`max_{self.column}`"), F.lit(self.value)
        test = {"=": (low <= v) & (high >= v), ">": high > v, ">=": high >= v, "<": low < v, "<=": low <= v, "!=": (low != v) | (high != v)}[self.op]
        nan = isinstance(self.value, float) and math.isnan(self.value)
        return _known(self.column, columns, test, F.lit({"=": nan, ">": not nan, ">=": True, "<": False, "<=": nan, "!=": not nan}[self.op]))


@dataclass(frozen=True)
class Between(Predicate):
    column: str
    low: Any
    high: Any

    def rows(self) -> Column:
        return F.col(f"`{self.column}`").between(F.lit(self.low), F.lit(self.high))

    def keeps(self, columns: list[str]) -> Column:
        return Compare(self.column, ">=", self.low).keeps(columns) & Compare(self.column, "<=", self.high).keeps(columns)


@dataclass(frozen=True)
class In(Predicate):
    column: str
    values: tuple

    def rows(self) -> Column:
        return F.col(f"`{self.column}`").isin(*self.values)

    def keeps(self, columns: list[str]) -> Column:
        return reduce(lambda a, b: a | b, (Compare(self.column, "=", v).keeps(columns) for v in self.values), F.lit(False))


@dataclass(frozen=True)
class IsNull(Predicate):
    column: str

    def rows(self) -> Column:
        return F.col(f"`{self.column}`").isNull()

    def keeps(self, columns: list[str]) -> Column:
        return F.coalesce(F.col(f"`nulls_{self.column}`") > 0, F.lit(True)) if f"nulls_{self.column}" in columns else F.lit(True)


@dataclass(frozen=True)
class TimeRange(Predicate):
    """Rows between two times of the table's time column, ends included."""

    column: str
    start: Any
    end: Any

    def rows(self) -> Column:
        return F.col(self.column).between(F.lit(self.start), F.lit(self.end))

    def keeps(self, columns: list[str]) -> Column:
        return overlaps_time(F.lit(self.start), F.lit(self.end))


@dataclass(frozen=True)
class All(Predicate):
    parts: tuple[Predicate, ...]

    def rows(self) -> Column:
        return reduce(lambda a, b: a & b, (p.rows() for p in self.parts), F.lit(True))

    def keeps(self, columns: list[str]) -> Column:
        return reduce(lambda a, b: a & b, (p.keeps(columns) for p in self.parts), F.lit(True))


@dataclass(frozen=True)
class Any_(Predicate):
    parts: tuple[Predicate, ...]

    def rows(self) -> Column:
        return reduce(lambda a, b: a | b, (p.rows() for p in self.parts), F.lit(False))

    def keeps(self, columns: list[str]) -> Column:
        return reduce(lambda a, b: a | b, (p.keeps(columns) for p in self.parts), F.lit(False))


def prune(segments: DataFrame, where: Predicate | None) -> DataFrame:
    """The segments that may hold rows of `where`; all of them without a condition."""
    return segments if where is None else segments.where(where.keeps(segments.columns))


def prune_by_key(index: DataFrame, keys: list[str], values: tuple) -> DataFrame:
    """Segments that hold a key according to the key index (keys, seg_id): none for an unknown key."""
    return index.where(reduce(lambda a, b: a & b, (F.col(k) == F.lit(v) for k, v in zip(keys, values, strict=True)))).select("seg_id").distinct()


def pruned_scan(rows: DataFrame, segments: DataFrame, where: Predicate, segment: str = "seg_id") -> DataFrame:
    """Rows of `where`, read from the kept segments only. The names of the kept segments (one for each, of bounded size) go into the
    scan as a filter, so that a table partitioned by segment lists and opens no other file."""
    kept = [r[0] for r in prune(segments, where).select(segment).collect()]
    return rows.where(F.col(segment).isin(kept) if kept else F.lit(False)).where(where.rows())
