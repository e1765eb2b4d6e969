"""The service surface as plain calls: table actions, schema, SQL, writes with acknowledgements."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from tidelog.functions import schema as schemas
from tidelog.functions.partition import PartitionSpec
from tidelog.sources.catalog import Catalog
from tidelog.sources.table import Ack, Tier

ACTIONS = ("CreateTable", "DropTable", "ListTables")


@dataclass(frozen=True)
class WriteRequest:
    table: str
    durability: Tier | None = None
    idempotency_key: str | None = None

    @staticmethod
    def from_json(text: str) -> WriteRequest:
        d = json.loads(text)
        tier = d.get("durability")
        plain = "".join(c for c in str(tier).lower() if c.isalpha())
        names = {t.name.lower().replace("_", ""): t for t in Tier} | {"icebergcommitted": Tier.COMMITTED}
        if tier is not None and plain not in names:
            raise ValueError(f"unknown durability {tier!r}")
        return WriteRequest(d["table"], names[plain] if tier is not None else None, d.get("idempotency_key"))

    def to_json(self) -> str:
        return json.dumps({"table": self.table, "durability": self.durability.name if self.durability is not None else None, "idempotency_key": self.idempotency_key})


def ack_json(ack: Ack) -> str:
    return json.dumps({"lsn": ack.lsn, "tier": ack.tier.name, "micros": ack.micros, "error": ack.error})


class Service:
    def __init__(self, catalog: Catalog) -> None:
        self.catalog = catalog

    def list_actions(self) -> list[str]:
        return list(ACTIONS)

    def do_action(self, name: str, body: str = "{}") -> str:
        """CreateTable, ListTables or DropTable with a JSON body; JSON back."""
        d = json.loads(body or "{}")
        if name == "CreateTable":
            text = d["schema_json"]
            self.catalog.create_table(d["name"], text if isinstance(text, str) else json.dumps(text), d.get("table_type"), d.get("primary_key"), PartitionSpec.from_dict(d.get("partition_spec")))
            return json.dumps({"created": d["name"]})
        if name == "ListTables":
            return json.dumps(self.catalog.list_tables())
        if name == "DropTable":
            self.catalog.drop_table(d["name"])
            return json.dumps({"dropped": d["name"]})
        raise ValueError(f"unknown action {name!r}")

    def get_schema(self, table: str) -> str:
        return schemas.to_json(self.catalog.get_metadata(table).schema)

    def get_schema_ipc(self, table: str) -> bytes:
        """The table's schema as an Arrow IPC message."""
        return to_arrow_schema(self.catalog.get_metadata(table).schema).serialize().to_pybytes()

    def do_get(self, sql: str) -> pa.Table:
        """The result of a query over the catalog's tables."""
        return self.catalog.sql(sql).toArrow()

    def do_exchange(self, request: str, batches: Iterable[DataFrame]) -> Iterator[str]:
        """Appends batches to the request's table; acknowledgements up to the wanted tier, none before it is reached. A batch that fails
        is acknowledged with its error, and the exchange goes on."""
        want = WriteRequest.from_json(request)
        table = self.catalog.get_table(want.table)
        for number, batch in enumerate(batches):
            key = f"{want.idempotency_key}#{number}" if want.idempotency_key else None
            try:
                acks = table.append(batch, key)
            except ValueError as error:
                yield ack_json(Ack(0, Tier.MEMORY, 0, str(error)))
                continue
            yield from (ack_json(a) for a in acks if want.durability is None or a.tier <= want.durability)
