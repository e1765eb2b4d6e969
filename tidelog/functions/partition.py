"""Partition transforms and specifications."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def identity(c: Column) -> Column:
    return c


def year(c: Column) -> Column:
    return F.year(c)


def month(c: Column) -> Column:
    return F.date_trunc("month", c).cast("timestamp_ntz")


def day(c: Column) -> Column:
    return F.to_date(c)


def hour(c: Column) -> Column:
    return F.date_trunc("hour", c).cast("timestamp_ntz")


def bucket(c: Column, n: int) -> Column:
    return F.pmod(F.hash(c), F.lit(n))


def truncate(c: Column, width: int, kind: T.DataType) -> Column:
    """Integers down to a multiple of `width`, strings to their first `width` characters."""
    return F.substring(c, 1, width) if isinstance(kind, T.StringType) else c - F.pmod(c, F.lit(width))


@dataclass(frozen=True)
class PartitionField:
    """One field of a specification: the source column (by name or by 1-based position) and its transform."""

    source: str | int
    transform: str
    name: str

    def column(self, schema: T.StructType) -> Column:
        source = schema[self.source] if isinstance(self.source, str) else schema.fields[self.source - 1]
        c = F.col(source.name)
        m = re.fullmatch(r"(\w+)(?:[\[(](\d+)[\])])?", self.transform.lower())
        name, number = (m[1], int(m[2]) if m[2] else None) if m else ("", None)
        if name in ("bucket", "truncate") and number:
            return (bucket(c, number) if name == "bucket" else truncate(c, number, source.dataType)).alias(self.name)
        plain = {"identity": identity, "year": year, "month": month, "day": day, "hour": hour}
        if name not in plain:
            raise ValueError(f"unknown partition transform {self.transform!r}")
        return plain[name](c).alias(self.name)


@dataclass(frozen=True)
class PartitionSpec:
    fields: tuple[PartitionField, ...] = field(default=())

    @property
    def partitioned(self) -> bool:
        return bool(self.fields)

    def columns(self, schema: T.StructType) -> list[Column]:
        return [f.column(schema) for f in self.fields]

    def to_dict(self) -> dict:
        return {"fields": [asdict(f) for f in self.fields]}

    @staticmethod
    def from_dict(data: dict | None) -> PartitionSpec:
        return PartitionSpec(tuple(PartitionField(f["source"], f["transform"], f.get("name", str(f["source"]))) for f in (data or {}).get("fields", [])))
