"""Queries that build real tables in the shared folder: ingest, deletes, updates, compaction, catalog, streams, Arrow files."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from tidelog.functions.partition import PartitionField, PartitionSpec
from tidelog.operators.buffer import BufferConfig
from tidelog.operators.prune import Between, Compare
from tidelog.plans.base import query, table
from tidelog.sources.arrow_ipc import read_arrow, write_arrow
from tidelog.sources.catalog import Catalog
from tidelog.sources.table import Table
from tidelog.sources.workspace import workspace
from tidelog.sources.write_buffer import WriteBuffer
from tidelog.streaming.ingest import file_stream, write_stream

COLUMNS = ["event_id", "user_id", "event_type", "value"]


def _filled(spark, sf_dir, batches=4):
    """A table of events keyed by event_id, appended in batches of whole ranges of ids."""
    rows = table(spark, sf_dir, "events").select(*COLUMNS)
    n = max(1, rows.count())
    made = Catalog(spark, workspace(spark)).create_table("events", rows.schema, "primary_key", ["event_id"])
    for k in range(batches):
        made.append(rows.where(F.expr(f"event_id * {batches} div {n}") == k))
    return rows, made, n


_N = "WITH n AS (SELECT greatest(1, count(*)) AS n FROM events), t AS (SELECT event_id, user_id, event_type, value, event_id * 4 // (SELECT n FROM n) + 1 AS __lsn FROM events)"


@query(f"{_N} SELECT * FROM t WHERE __lsn <= 2")
def table_snapshot(spark, sf_dir):
    return _filled(spark, sf_dir)[1].snapshot(2)


@query(f"{_N} SELECT * FROM t WHERE event_type <> 'error'")
def table_delete(spark, sf_dir):
    rows, made, _ = _filled(spark, sf_dir)
    made.delete(rows.where("event_type = 'error'"))
    return made.snapshot()


@query(f"{_N} SELECT event_id, user_id, event_type, CASE WHEN event_id % 5 = 0 THEN -1.0 ELSE value END AS value, CASE WHEN event_id % 5 = 0 THEN 5 ELSE __lsn END AS __lsn FROM t")
def table_update(spark, sf_dir):
    rows, made, _ = _filled(spark, sf_dir)
    made.update(rows.where("event_id % 5 = 0").withColumn("value", F.lit(-1.0)))
    return made.snapshot()


@query(f"{_N} SELECT * FROM t WHERE event_type <> 'error' AND __lsn <= 4")
def table_compacted(spark, sf_dir):
    rows, made, _ = _filled(spark, sf_dir)
    made.delete(rows.where("event_type = 'error'"))
    made.compact()
    return made.snapshot()


@query(f"{_N} SELECT * FROM t WHERE __lsn <= 3")
def table_buffered(spark, sf_dir):
    """Four batches gather in two buffers and become two segments; the snapshot as of LSN 3 cuts through the second one."""
    rows = table(spark, sf_dir, "events").select(*COLUMNS)
    n = max(1, rows.count())
    made = Catalog(spark, workspace(spark)).create_table("events", rows.schema)
    buffer = WriteBuffer(BufferConfig(batches=2))
    for k in range(4):
        if buffer.append(rows.where(F.expr(f"event_id * 4 div {n}") == k), 1):
            buffer.freeze()
    buffer.close(made)
    return made.snapshot(3)


@query(f"{_N} SELECT event_id, value FROM t WHERE event_id BETWEEN 100 AND 200")
def table_pruned_scan(spark, sf_dir):
    return _filled(spark, sf_dir)[1].scan(Between("event_id", 100, 200), ["event_id", "value"])


@query(f"{_N} SELECT __lsn AS seg_id, count(*) AS rows, min(event_id) AS min_event_id, max(event_id) AS max_event_id, min(value) AS min_value, max(value) AS max_value FROM t GROUP BY 1")
def table_segments(spark, sf_dir):
    return _filled(spark, sf_dir)[1].segments().select("seg_id", "rows", "min_event_id", "max_event_id", "min_value", "max_value")


@query("SELECT event_type, count(*) AS n FROM events WHERE value > 100 GROUP BY event_type")
def table_sql(spark, sf_dir):
    made = _filled(spark, sf_dir)[1]
    made.view("tidelog_events")
    return spark.sql("SELECT event_type, count(*) AS n FROM tidelog_events WHERE value > 100 GROUP BY event_type")


@query("SELECT event_id, user_id, event_type, value FROM events")
def stream_ingest_snapshot(spark, sf_dir):
    """Events arrive as a stream of files and are read back as the table's snapshot."""
    root = workspace(spark)
    rows = table(spark, sf_dir, "events").select(*COLUMNS)
    rows.repartition(4, "event_id").write.parquet(f"{root}/in")
    made = Catalog(spark, f"{root}/tables").create_table("events", rows.schema)
    write_stream(file_stream(spark, f"{root}/in", rows.schema, files=1), made, f"{root}/checkpoint", once=True).awaitTermination()
    return made.snapshot().select(*COLUMNS)


@query("SELECT * FROM (VALUES ('default.events', 'append_only', '', 6, true), ('default.orders', 'primary_key', 'o_orderkey', 6, false)) t(name, type, primary_key, n_columns, partitioned)")
def catalog_tables(spark, sf_dir):
    """Two tables registered, a third one dropped; the registry as a fresh session reads it."""
    root = workspace(spark)
    made = Catalog(spark, root)
    made.create_table("orders", table(spark, sf_dir, "orders").schema, "PrimaryKey", ["o_orderkey"])
    made.create_table("events", table(spark, sf_dir, "events").schema, spec=PartitionSpec((PartitionField("ts", "hour", "hour"),)))
    made.create_table("gone", table(spark, sf_dir, "nation").schema)
    made.drop_table("gone")
    return Catalog(spark, root).frame()


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def arrow_ipc_round_trip(spark, sf_dir):
    root = workspace(spark)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    root = root if "://" in root or root.startswith("/") else root.removeprefix("file:")
    write_arrow(rows.repartition(3), f"{root}/ipc")
    return read_arrow(spark, f"{root}/ipc", rows.schema)




@query("SELECT event_id, user_id, event_type, value FROM events")
def table_compacted_concurrent(spark, sf_dir):
    """A compaction and an append run side by side; whichever comes first, each row is there once."""
    rows = table(spark, sf_dir, "events").select(*COLUMNS)
    n = max(1, rows.count())
    made = Catalog(spark, workspace(spark)).create_table("events", rows.schema, "primary_key", ["event_id"])
    for k in range(3):
        made.append(rows.where(F.expr(f"event_id * 4 div {n}") == k))
    with ThreadPoolExecutor(2) as pool:
        running = pool.submit(Table(spark, made.path, made.schema, made.primary_key).compact)
        made.append(rows.where(F.expr(f"event_id * 4 div {n}") == 3))
        running.result()
    return made.snapshot().select(*COLUMNS)


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE ELSE value END AS value FROM events WHERE event_id % 7 = 0 OR value > 50")
def prune_nan(spark, sf_dir):
    """NaN is larger than any number, so segments with NaN are kept whatever their maximum."""
    rows = table(spark, sf_dir, "events").select("event_id", F.expr("CASE WHEN event_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS value"))
    n = max(1, rows.count())
    made = Catalog(spark, workspace(spark)).create_table("events", rows.schema)
    for k in range(4):
        made.append(rows.where(F.expr(f"event_id * 4 div {n}") == k))
    return made.scan(Compare("value", ">", 50.0), ["event_id", "value"])


@query(f"{_N} SELECT * FROM t WHERE event_id = 123")
def table_lookup(spark, sf_dir):
    return _filled(spark, sf_dir)[1].lookup(123)


@query(f"{_N} SELECT event_type, count(*) AS n, min(__lsn) AS first_lsn FROM t WHERE event_id BETWEEN 100 AND 2000 AND value > 1 GROUP BY event_type")
def table_sql_pruned(spark, sf_dir):
    """The condition in SQL reaches the statistics: segments out of its range are not opened."""
    rows = table(spark, sf_dir, "events").select(*COLUMNS)
    n = max(1, rows.count())
    catalog = Catalog(spark, workspace(spark))
    made = catalog.create_table("ns.events", rows.schema)
    for k in range(4):
        made.append(rows.where(F.expr(f"event_id * 4 div {n}") == k))
    return catalog.sql("SELECT event_type, count(*) AS n, min(__lsn) AS first_lsn FROM ns.events WHERE event_id BETWEEN 100 AND 2000 AND value > 1 GROUP BY event_type")
