"""Buffers, LSN arithmetic, transforms, schemas, streams, service, Arrow files, registered queries."""

import datetime
import json
import math
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from tidelog.functions import schema as schemas
from tidelog.functions.keys import KeyFilter, bloom_bits, bloom_hashes
from tidelog.functions.partition import PartitionField, PartitionSpec
from tidelog.operators import stats
from tidelog.operators.asof import asof_join
from tidelog.operators.buffer import BufferConfig, TableConfig, freeze_plan, lag, lsn_ranges
from tidelog.operators.lsn import LsnManager
from tidelog.sources.arrow_ipc import read_arrow, write_arrow
from tidelog.sources.catalog import Catalog, Identifier, TableType
from tidelog.sources.table import Table, Tier
from tidelog.streaming.ingest import Progress, file_stream, windowed_counts, write_stream
from tidelog.streaming.service import Service, WriteRequest


def test_buffer_presets_and_lag():
    d, h, low = BufferConfig(), BufferConfig.high_throughput(), BufferConfig.low_latency()
    assert (d.total, d.size, d.batches, d.interval_ms) == (512 << 20, 64 << 20, 1000, 100)
    assert (h.total, h.size, h.batches, h.interval_ms) == (1 << 30, 128 << 20, 10_000, 500)
    assert (low.total, low.size, low.batches, low.interval_ms) == (128 << 20, 16 << 20, 100, 50)
    assert d.full(64 << 20, 1) and d.full(0, 1000) and not d.full(5, 5)
    assert TableConfig.primary_key().indexed and not TableConfig.append_only().indexed and TableConfig.analytical().indexed
    assert lag(101, 50, 20) == (51, 30) and lag(1, 5, 9) == (0, 0)


def test_freeze_plan_and_ranges(spark):
    batches = spark.createDataFrame([(0, 10, 40), (1, 20, 70), (2, 30, 100), (3, 5, 10), (4, 5, 10), (5, 5, 10)], "batch long, rows long, bytes long")
    plan = lambda c: [r.buffer for r in freeze_plan(batches, c).orderBy("batch").collect()]
    assert plan(BufferConfig(size=100, batches=99)) == [0, 0, 1, 2, 2, 2]
    assert plan(BufferConfig(size=1 << 40, batches=2)) == [0, 0, 1, 1, 2, 2]
    assert [(r.start_lsn, r.end_lsn) for r in lsn_ranges(batches.select("batch", "rows")).orderBy("batch").collect()][:3] == [(1, 10), (11, 30), (31, 60)]


@pytest.mark.parametrize("start, end, hit", [(41, 43, True), (-5, 37, True), (58, 90, True), (0, 36, False), (59, 60, False), (-1, 1000, True), (37, 58, True), (40, 40, True)])
def test_overlap_truth_table(spark, start, end, hit):
    seg = spark.createDataFrame([(37, 58, 7, 19)], "min_time long, max_time long, min_lsn long, max_lsn long")
    assert seg.where(stats.overlaps_time(F.lit(start), F.lit(end))).isEmpty() is not hit
    for lsn, inside in ((6, False), (7, True), (12, True), (19, True), (20, False)):
        assert seg.where(stats.contains_lsn(lsn)).isEmpty() is not inside


def test_segment_index_ranges(spark):
    seg = spark.createDataFrame([(1, -8, 3), (2, 2, 9), (3, 10, 10), (4, None, None), (5, 30, 44)], "seg_id long, min_time long, max_time long")
    find = lambda a, b: [r.seg_id for r in seg.where(stats.overlaps_time(F.lit(a), F.lit(b))).orderBy("seg_id").collect()]
    assert find(3, 10) == [1, 2, 3, 4] and find(11, 29) == [4] and find(-99, -9) == [4] and find(9, 30) == [2, 3, 4, 5], "an unknown range may hold any time"


def test_bloom():
    assert bloom_bits(1_000_000) == 9_585_059 and bloom_hashes(1_000_000) == 7


def test_key_filter_on_null_and_typed_keys(spark):
    f = KeyFilter.build(spark.createDataFrame([(1, "a"), (None, "b")], "k long, s string"), ["k", "s"])
    assert f.might_contain(spark.createDataFrame([(1, "a"), (None, "b")], "k long, s string"), ["k", "s"]) == [True, False]


def test_partition_transforms(spark):
    frame = spark.createDataFrame([(datetime.datetime(2024, 3, 5, 7, 8), -7, "héllo")], "t timestamp_ntz, n long, s string")
    get = lambda s, t: frame.select(PartitionField(s, t, "p").column(frame.schema)).first().p
    assert get("t", "year") == 2024 and get("t", "Month") == datetime.datetime(2024, 3, 1)
    assert get("t", "day") == datetime.date(2024, 3, 5) and get("t", "hour") == datetime.datetime(2024, 3, 5, 7)
    assert get("n", "truncate[10]") == -10 and get("s", "truncate(3)") == "hél" and 0 <= get("n", "bucket[4]") < 4
    assert get(3, "identity") == "héllo"
    for bad in ("week", "bucket", "truncate[0]", ""):
        with pytest.raises(ValueError):
            get("n", bad)
    spec = PartitionSpec((PartitionField("t", "day", "d"),))
    assert PartitionSpec.from_dict(json.loads(json.dumps(spec.to_dict()))) == spec and spec.partitioned and not PartitionSpec().partitioned


def test_schema_json():
    kinds = [T.StructField(f"c{i}", k, i % 2 == 0) for i, k in enumerate(dict.fromkeys(schemas.TYPES.values()))]
    assert schemas.from_json(schemas.to_json(T.StructType(kinds))) == T.StructType(kinds)
    nested = T.StructType([T.StructField("a", T.ArrayType(T.StructType([T.StructField("b", T.IntegerType())])))])
    assert schemas.from_json(schemas.to_json(nested)) == nested
    assert schemas.from_json('{"fields":[{"name":"u","type":"UInt64"}]}')["u"].dataType == T.DecimalType(20, 0)


def test_identifiers_and_types():
    assert Identifier.parse("t").qualified == "default.t" and Identifier.parse("a.b.t") == Identifier("t", ("a", "b"))
    assert [TableType.parse(x) for x in ("primary_key", "PrimaryKey", "MATERIALIZED_VIEW", "?", None)] == [TableType.PRIMARY_KEY, TableType.PRIMARY_KEY, TableType.MATERIALIZED_VIEW, TableType.APPEND_ONLY, TableType.APPEND_ONLY]


def test_write_requests():
    assert WriteRequest.from_json('{"table":"users","durability":"Disk","idempotency_key":"batch-123"}') == WriteRequest("users", Tier.DISK, "batch-123")
    assert WriteRequest.from_json('{"table":"u","durability":"disk"}').durability is Tier.DISK
    assert WriteRequest.from_json('{"table":"u","durability":"IcebergCommitted"}').durability is Tier.COMMITTED
    r = WriteRequest("u", Tier.MEMORY, "k")
    assert WriteRequest.from_json(r.to_json()) == r
    with pytest.raises(ValueError):
        WriteRequest.from_json('{"table":"u","durability":"tape"}')


def test_service(spark, tmp_path):
    service = Service(Catalog(spark, str(tmp_path / "s")))
    body = {"name": "users", "schema_json": '{"fields":[{"name":"id","type":"Int64"},{"name":"name","type":"Utf8"}]}', "primary_key": ["id"], "table_type": "PrimaryKey"}
    service.do_action("CreateTable", json.dumps(body))
    assert json.loads(service.do_action("ListTables")) == ["default.users"] and len(service.list_actions()) == 3
    assert json.loads(service.get_schema("users"))["fields"][1] == {"name": "name", "type": "Utf8", "nullable": True}
    make = lambda a, b: spark.createDataFrame([(i, f"n{i}") for i in range(a, b)], "id long, name string")
    acks = [json.loads(a) for a in service.do_exchange('{"table":"users"}', [make(0, 3), make(0, 0), make(3, 5)])]
    assert [(a["lsn"], a["tier"], a["error"] is None) for a in acks] == [(1, "MEMORY", True), (1, "DISK", True), (0, "MEMORY", False), (2, "MEMORY", True), (2, "DISK", True)]
    got = service.do_get("SELECT count(*) AS n, max(name) AS m FROM users")
    assert isinstance(got, pa.Table) and got.to_pylist() == [{"n": 5, "m": "n4"}]
    service.do_action("DropTable", '{"name":"users"}')
    with pytest.raises(ValueError):
        service.do_action("Nothing")


def test_stream_is_exactly_once_over_restarts(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType())])
    made, acks = Table(spark, str(tmp_path / "t"), schema), []
    for round_ in range(2):
        spark.range(round_ * 100, round_ * 100 + 100).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        write_stream(file_stream(spark, str(tmp_path / "in"), schema, files=2), made, str(tmp_path / "ck"), once=True, on_ack=acks.append).awaitTermination()
    assert sorted(r.id for r in made.snapshot().collect()) == list(range(200))
    assert [a.lsn for a in acks if a.tier is Tier.DISK] == [1, 2, 3, 4]
    made.append(spark.range(5), idempotency_key=f"{tmp_path / 'ck'}#0")
    assert made.snapshot().count() == 200


def test_windowed_stream(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, 1, h), "a") for h in (0, 1, 7, 30 % 24)]
    spark.createDataFrame(rows, "ts timestamp_ntz, k string").write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema("ts timestamp_ntz, k string").parquet(str(tmp_path / "w"))
    query = windowed_counts(stream, "ts", "6 hours", "1 hour", "k").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.n for r in spark.table("windows").collect()) == [2, 2]


def test_arrow_files(spark, tmp_path):
    frame = spark.range(1000).withColumn("s", F.concat(F.lit("é"), "id")).repartition(3)
    done = write_arrow(frame, f"file://{tmp_path}/a")
    assert done.agg(F.sum("rows")).first()[0] == 1000
    back = read_arrow(spark, f"file://{tmp_path}/a")
    assert back.exceptAll(frame).isEmpty() and back.count() == 1000
    with pa.OSFile(str(tmp_path / "u.arrow"), "wb") as f, pa.ipc.new_file(f, pa.schema([("u", pa.uint64())])) as w:
        w.write_batch(pa.record_batch({"u": pa.array([2**64 - 1], pa.uint64())}))
    (tmp_path / "b").mkdir()
    (tmp_path / "u.arrow").rename(tmp_path / "b" / "u.arrow")
    assert int(read_arrow(spark, f"file://{tmp_path}/b").first().u) == 2**64 - 1


def test_pruned_scan_reads_only_kept_partitions(spark, tmp_path):
    from tidelog.operators.prune import Compare, pruned_scan

    spark.range(1000).withColumn("seg_id", F.expr("id div 100")).write.partitionBy("seg_id").parquet(str(tmp_path / "p"))
    rows = spark.read.parquet(str(tmp_path / "p"))
    segments = stats.segment_stats(rows, "seg_id", ["id"])
    found = pruned_scan(rows, segments, Compare("id", ">=", 850))
    plan = found._jdf.queryExecution().toString()
    assert found.count() == 150 and "PartitionFilters: [isnotnull(seg_id" in plan or "PartitionFilters: [seg_id" in plan


def test_registered_queries_have_oracles_and_the_flagship_runs(spark):
    names, oracles = set(entry.queries()), set(entry.oracle_sql())
    assert oracles <= names and len(names) > 100
    assert {n for n in names - oracles if not n.startswith("op") and n != "pipeline"} == {"part_bucket"}
    assert entry.entry(spark).count() == 887


def test_null_fraction_of_an_empty_segment(spark):
    frame = spark.createDataFrame([(0, 0), (4, 1)], "rows long, nulls_c long")
    assert [r[0] for r in frame.select(stats.null_fraction("c")).collect()] == [0.0, 0.25]
    assert [r[0] for r in frame.select(stats.all_null("c")).collect()] == [True, False] and math.isfinite(0.0)


def test_lsn_manager():
    m = LsnManager()
    assert m.current == 1 and m.assign(5) == (1, 5) and m.assign() == (6, 6) and m.current == 7
    m.assign(94)
    m.mark_flushed(50)
    m.mark_flushed(20)
    m.mark_committed(20)
    assert (m.flushed, m.committed, m.pending_flush, m.pending_commit) == (50, 20, 51, 30)
    assert LsnManager(8).assign() == (8, 8)


def murmur3_of_long(value, seed=42):
    """Spark's hash of a long, from its definition: MurmurHash3 x86 32-bit over the two halves."""
    mask = 0xFFFFFFFF
    rotate = lambda x, r: (x << r | x >> (32 - r)) & mask
    h = seed
    for k in (value & mask, value >> 32 & mask):
        k = rotate(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
        h = (rotate(h ^ k, 13) * 5 + 0xE6546B64) & mask
    h ^= 8
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def test_buckets_as_murmur3(spark):
    values = [0, 1, -1, 42, 10**12, -(10**15), 2**63 - 1]
    frame = spark.createDataFrame([(v,) for v in values], "n long")
    got = [r.p for r in frame.select(PartitionField("n", "bucket[16]", "p").column(frame.schema)).collect()]
    assert got == [murmur3_of_long(v) % 16 for v in values]


@pytest.mark.parametrize("forward, exact", [(False, True), (False, False), (True, True), (True, False)])
def test_asof_join_as_brute_force(spark, forward, exact):
    rng = random.Random(forward * 2 + exact)
    left = [(rng.choice(["a", "b", None]), rng.choice([None, *range(12)]), i) for i in range(60)]
    right = [(rng.choice(["a", "b", None]), rng.choice([None, *range(12)]), 1000 + i) for i in range(40)]
    frames = spark.createDataFrame(left, "k string, t long, i long"), spark.createDataFrame(right, "k string, t long, j long")
    got = {r.i: r.j for r in asof_join(*frames, ["k"], "t", forward, exact).collect()}
    want = {}
    for k, t, i in left:
        fits = [(-u if forward else u, j) for l, u, j in right if l == k and k is not None and u is not None and t is not None and ((u > t if forward else u < t) or (exact and u == t))]
        want[i] = max(fits)[1] if fits else None
    assert got == want
    assert asof_join(frames[0].limit(0), frames[1], ["k"], "t").count() == 0
    with pytest.raises(ValueError):
        asof_join(frames[0], frames[0], ["k"], "t")


def test_streams_report_progress_and_schemas_travel_as_ipc(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"))
    made = catalog.create_table("s", T.StructType([T.StructField("id", T.LongType(), False), T.StructField("x", T.StringType())]))
    found = pa.ipc.read_schema(pa.py_buffer(Service(catalog).get_schema_ipc("s")))
    assert found.names == ["id", "x"] and found.field("id").type == pa.int64() and not found.field("id").nullable
    spark.range(20).selectExpr("id", "'a' AS x").repartition(4).write.parquet(str(tmp_path / "in"))
    progress = Progress()
    spark.streams.addListener(progress)
    try:
        query = write_stream(file_stream(spark, str(tmp_path / "in"), made.schema, files=1), made, str(tmp_path / "cp"), once=True)
        query.awaitTermination()
        limit = time.monotonic() + 20
        while str(query.id) not in progress.errors and time.monotonic() < limit:
            time.sleep(0.05)
    finally:
        spark.streams.removeListener(progress)
    assert progress.rows[str(query.id)] == 20 and progress.batches[str(query.id)] >= 4 and progress.errors[str(query.id)] is None


def test_arrow_files_load_the_wanted_columns_only(spark, tmp_path):
    frame = spark.range(50).selectExpr("id", "cast(id AS string) AS name", "id * 2 AS twice")
    write_arrow(frame.repartition(2), str(tmp_path / "a"))
    found = read_arrow(spark, str(tmp_path / "a"), columns=["twice", "id"])
    assert found.columns == ["twice", "id"] and sorted(map(tuple, found.collect())) == [(2 * i, i) for i in range(50)]


def test_lsn_ranges_over_many_spans(spark):
    rng = random.Random(4)
    rows = [(b, rng.randint(0, 9)) for b in sorted(rng.sample(range(20_000), 3000))]
    want, at = [], 0
    for b, n in rows:
        want.append((b, n, at + n, at + 1))
        at += n
    got = lsn_ranges(spark.createDataFrame(rows, "batch long, rows long")).select("batch", "rows", "end_lsn", "start_lsn").collect()
    assert sorted(map(tuple, got)) == want
