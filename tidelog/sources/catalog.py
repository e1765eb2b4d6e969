"""The catalog of tables: names, schemas, keys, partition specifications, properties."""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidelog.functions import schema as schemas
from tidelog.functions.partition import PartitionSpec
from tidelog.operators.buffer import TableConfig
from tidelog.sources.log import Conflict, Files
from tidelog.sources.pushdown import pruned
from tidelog.sources.table import RETRIES, Table

DEFAULT = "default"
#: Versions of the registry that are kept.
KEPT = 100


class TableExists(ValueError):
    pass


class TableNotFound(KeyError):
    pass


class TableType(Enum):
    APPEND_ONLY = "append_only"
    PRIMARY_KEY = "primary_key"
    MATERIALIZED_VIEW = "materialized_view"

    @staticmethod
    def parse(text: str | TableType | None) -> TableType:
        """Any spelling of a type's name; an unknown one is append-only."""
        if isinstance(text, TableType):
            return text
        plain = "".join(c for c in str(text or "").lower() if c.isalpha())
        return next((t for t in TableType if t.value.replace("_", "") == plain), TableType.APPEND_ONLY)

    def config(self) -> TableConfig:
        return TableConfig.primary_key() if self is TableType.PRIMARY_KEY else TableConfig.append_only()


@dataclass(frozen=True)
class Identifier:
    name: str
    namespace: tuple[str, ...] = (DEFAULT,)

    @staticmethod
    def parse(text: str) -> Identifier:
        *space, name = text.split(".")
        return Identifier(name, tuple(space) or (DEFAULT,))

    @property
    def qualified(self) -> str:
        return ".".join([*self.namespace, self.name])


@dataclass
class Metadata:
    identifier: Identifier
    schema: T.StructType
    kind: TableType = TableType.APPEND_ONLY
    primary_key: list[str] = field(default_factory=list)
    spec: PartitionSpec = field(default_factory=PartitionSpec)
    properties: dict[str, str] = field(default_factory=dict)
    location: str = ""
    created_at: float = field(default_factory=time.time)
    updated_at: float = field(default_factory=time.time)

    def to_dict(self) -> dict:
        return {
            "name": self.identifier.qualified, "schema": json.loads(schemas.to_json(self.schema)), "type": self.kind.value, "primary_key": self.primary_key,
            "spec": self.spec.to_dict(), "properties": self.properties, "location": self.location, "created_at": self.created_at, "updated_at": self.updated_at,
        }

    @staticmethod
    def from_dict(d: dict) -> Metadata:
        return Metadata(Identifier.parse(d["name"]), schemas.from_json(json.dumps(d["schema"])), TableType.parse(d["type"]), d["primary_key"], PartitionSpec.from_dict(d["spec"]), d["properties"], d["location"], d["created_at"], d["updated_at"])


class Catalog:
    """Tables under one root. The registry is a JSON file, a new version of which is created with each change; of two catalogs that
    change it at once, the later one changes what the earlier one has left."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)
        self.entries: dict[str, Metadata] = {}
        self.tables: dict[str, Table] = {}
        self._load()

    def _load(self) -> list[int]:
        """Reads the newest version; all versions' numbers."""
        numbers = [int(n.split(".")[0]) for n in self.files.names(f"{self.root}/_catalog") if n[0] not in "_." and n.endswith(".json")]
        text = self.files.read(f"{self.root}/_catalog/{numbers[-1]:020d}.json") if numbers else None
        self.entries = {d["name"]: Metadata.from_dict(d) for d in json.loads(text or "[]")}
        return numbers

    def _change(self, change) -> None:
        for _ in range(RETRIES):
            numbers = self._load()
            change()
            try:
                self.files.create(f"{self.root}/_catalog/{(numbers or [0])[-1] + 1:020d}.json", json.dumps([m.to_dict() for m in self.entries.values()]))
            except Conflict:
                continue
            for number in numbers[:-KEPT]:
                self.files.delete(f"{self.root}/_catalog/{number:020d}.json")
            return
        raise Conflict("the registry could not be changed")

    def create_table(self, name: str | Identifier, schema: T.StructType | str, kind: str | TableType = TableType.APPEND_ONLY, primary_key: list[str] | None = None, spec: PartitionSpec | None = None, properties: dict[str, str] | None = None) -> Table:
        name = Identifier.parse(name) if isinstance(name, str) else name
        schema = schemas.from_json(schema) if isinstance(schema, str) else schema
        kind, key = TableType.parse(kind), list(primary_key or [])
        unknown = [k for k in key if k not in schema.names]
        if unknown or (kind is TableType.PRIMARY_KEY and not key):
            raise ValueError(f"primary key {key} does not fit the schema")
        (spec or PartitionSpec()).columns(schema)

        def add() -> None:
            if name.qualified in self.entries:
                raise TableExists(name.qualified)
            self.entries[name.qualified] = Metadata(name, schema, kind, key, spec or PartitionSpec(), dict(properties or {}), f"{self.root}/{'/'.join(name.namespace)}/{name.name}")

        self._change(add)
        return self.get_table(name)

    def _name(self, name: str | Identifier) -> str:
        found = (Identifier.parse(name) if isinstance(name, str) else name).qualified
        if found not in self.entries:
            self._load()
        if found not in self.entries:
            raise TableNotFound(found)
        return found

    def get_metadata(self, name: str | Identifier) -> Metadata:
        return self.entries[self._name(name)]

    def get_table(self, name: str | Identifier) -> Table:
        key = self._name(name)
        if key not in self.tables:
            m = self.entries[key]
            config = m.kind.config()
            self.tables[key] = Table(self.spark, m.location, m.schema, m.primary_key, config.durability, config.indexed)
        return self.tables[key]

    def list_tables(self) -> list[str]:
        self._load()
        return sorted(self.entries)

    def drop_table(self, name: str | Identifier) -> None:
        """Takes the table out of the registry. Its data stays."""
        key = self._name(name)
        self._change(lambda: self.entries.pop(self._name(key)))
        self.tables.pop(key, None)

    def frame(self) -> DataFrame:
        """The registry as rows."""
        self._load()
        rows = [(k, m.kind.value, ",".join(m.primary_key), len(m.schema.fields), m.spec.partitioned) for k, m in sorted(self.entries.items())]
        return self.spark.createDataFrame(rows, "name string, type string, primary_key string, n_columns int, partitioned boolean")

    def sql(self, text: str) -> DataFrame:
        """Runs SQL over the current snapshots of the tables it names, in a session of its own, whose views nobody else sees.

        A table is named with its namespace or, if that tells it from all others, without (`default` has precedence). Segments whose statistics
        rule out the conditions that reach a table's scan are not opened.
        """
        self._load()
        session = self.spark.newSession()
        for key, value in self.spark.conf.getAll.items():
            if key.startswith("spark.sql.") and session.conf.isModifiable(key):
                session.conf.set(key, value)
        short: dict[str, list[str]] = {}
        for key, m in self.entries.items():
            short.setdefault(m.identifier.name.lower(), []).append(key)
        views: dict[str, Table] = {}
        for key, m in self.entries.items():
            if not re.search(rf"\b{re.escape(m.identifier.name)}\b", text, re.I):
                continue
            view = "__".join([*m.identifier.namespace, m.identifier.name])
            parts = r"\s*\.\s*".join(f"`?{re.escape(p)}`?" for p in (*m.identifier.namespace, m.identifier.name))
            text, n = re.subn(rf"(\b(?:from|join)\s+|,\s*){parts}(?![\w.`])", lambda x, v=view: f"{x[1]}`{v}`", text, flags=re.I)
            if n:
                views[view] = self.get_table(key)
            alike = short[m.identifier.name.lower()]
            if len(alike) == 1 or m.identifier.namespace == (DEFAULT,):
                views[m.identifier.name] = self.get_table(key)
        return pruned(session, text, views)
