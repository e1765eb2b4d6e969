"""Schemas as JSON, in the catalog's short form and in Spark's own."""

from __future__ import annotations

import json

from pyspark.sql import types as T

LSN = "__lsn"
RESERVED = (LSN, "__change_type", "__table_id")
#: Names that a time column may have, the first one present being taken.
TIME_COLUMNS = ("timestamp", "__timestamp", "ts")
#: Values of __change_type.
INSERT, UPDATE, DELETE = 0, 1, 2

#: Type names of the short form and what they stand for. Unsigned types take the next wider signed one.
TYPES = {
    "Int8": T.ByteType(), "Int16": T.ShortType(), "Int32": T.IntegerType(), "Int64": T.LongType(),
    "UInt8": T.ShortType(), "UInt16": T.IntegerType(), "UInt32": T.LongType(), "UInt64": T.DecimalType(20, 0),
    "Float32": T.FloatType(), "Float64": T.DoubleType(), "Utf8": T.StringType(), "LargeUtf8": T.StringType(),
    "Binary": T.BinaryType(), "Boolean": T.BooleanType(), "Date32": T.DateType(), "Timestamp": T.TimestampNTZType(), "TimestampTz": T.TimestampType(),
}
_NAMES = {T.DecimalType(20, 0): "UInt64"} | {v: k for k, v in reversed(TYPES.items()) if not k.startswith(("UInt", "Large"))}


def from_json(text: str) -> T.StructType:
    """A schema from either form. Types that no name stands for are an error, never silently strings."""
    whole = json.loads(text)
    fields = whole["fields"]
    try:
        if whole.get("type") == "struct":
            return T.StructType.fromJson({"type": "struct", "fields": [{"metadata": {}, "nullable": True} | f for f in fields]})
        return T.StructType([T.StructField(f["name"], TYPES[f["type"]], f.get("nullable", True)) for f in fields])
    except Exception as error:
        raise ValueError(f"unknown type in {text}") from error


def to_json(schema: T.StructType) -> str:
    """The short form where every type has a name, else Spark's own."""
    if all(f.dataType in _NAMES for f in schema.fields):
        return json.dumps({"fields": [{"name": f.name, "type": _NAMES[f.dataType], "nullable": f.nullable} for f in schema.fields]})
    return schema.json()


def time_column(names: list[str]) -> str | None:
    return next((n for n in TIME_COLUMNS if n in names), None)


def comparable(kind: T.DataType) -> bool:
    """Whether a column of this type gets minimum and maximum."""
    return isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType))
