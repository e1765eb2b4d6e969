"""Tables: log, snapshots, change data, pruning, keys, compaction, recovery."""

import datetime
import os
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.schema import LSN
from tidelog.operators.buffer import BufferConfig
from tidelog.operators.prune import Between, Compare, In, IsNull, TimeRange
from tidelog.sources.catalog import Catalog, TableExists, TableNotFound, TableType
from tidelog.sources.log import Conflict, Files, Log
from tidelog.sources.table import Table, Tier
from tidelog.sources.write_buffer import WriteBuffer

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("amount", T.DoubleType())])
DAY = datetime.datetime(2024, 1, 1)


def batch(spark, start, n, name="name"):
    rows = [(i, f"{name}_{i}", DAY + datetime.timedelta(days=i), float(i * 100 - 500)) for i in range(start, start + n)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def table(spark, tmp_path):
    return Table(spark, str(tmp_path / "t"), SCHEMA, ["id"])


def ids(frame):
    return sorted(r.id for r in frame.collect())


def test_lsns_start_at_one_and_snapshots_fold_the_log(spark, table):
    acks = [table.append(batch(spark, k * 10, 10)) for k in range(3)]
    assert [[a.lsn for a in x] for x in acks] == [[1, 1], [2, 2], [3, 3]]
    assert [a.tier for a in acks[0]] == [Tier.MEMORY, Tier.DISK] and Tier.DISK < Tier.OBJECT_STORAGE < Tier.COMMITTED
    for lsn in range(4):
        assert ids(table.snapshot(lsn)) == list(range(lsn * 10))
    assert ids(table.snapshot()) == ids(table.snapshot(99)) == list(range(30)), "as-of is clamped to what is committed"
    w = table.watermarks()
    assert (w.next, w.flushed, w.committed, w.pending_flush, w.pending_commit) == (4, 3, 0, 1, 3)


def test_empty_batches_and_foreign_columns_are_refused(spark, table):
    with pytest.raises(ValueError):
        table.append(batch(spark, 0, 0))
    with pytest.raises(ValueError):
        table.append(batch(spark, 0, 3).withColumn("extra", F.lit(1)))
    assert table.watermarks().next == 1 and ids(table.snapshot()) == []


def test_idempotency_key(spark, table):
    assert table.append(batch(spark, 0, 5), "k")[0].lsn == table.append(batch(spark, 0, 5), "k")[0].lsn == 1
    assert ids(table.snapshot()) == list(range(5))


def test_deletes_are_versioned_and_hit_the_newest_row(spark, table):
    table.append(batch(spark, 0, 10))
    table.append(batch(spark, 5, 10, "again"))
    assert ids(table.snapshot()).count(5) == 2, "appending is not an upsert"
    assert table.delete_key(5) == 3
    left = [r.name for r in table.snapshot().where("id = 5").collect()]
    assert left == ["name_5"] and ids(table.snapshot(2)).count(5) == 2
    with pytest.raises(KeyError):
        table.delete_key(5, target_lsn=2)
    with pytest.raises(KeyError):
        table.delete_key(777)
    assert table.append(batch(spark, 50, 1))[0].lsn == 6, "failed deletes use up an LSN each"
    assert ids(table.snapshot()) == sorted([*range(10), *range(6, 15), 50])


def test_a_key_repeated_within_a_batch_loses_one_row(spark, table):
    table.append(batch(spark, 1, 2).unionByName(batch(spark, 1, 2)).coalesce(1))
    table.delete_key(1)
    assert ids(table.snapshot()) == [1, 2, 2]


def test_update_and_change_log(spark, table):
    table.append(batch(spark, 0, 6))
    table.update(batch(spark, 2, 2, "new"))
    assert sorted((r.id, r.name, r[LSN]) for r in table.snapshot().collect())[2:4] == [(2, "new_2", 2), (3, "new_3", 2)]
    changes = batch(spark, 0, 1).withColumn("op", F.lit("delete")).unionByName(batch(spark, 1, 1, "u").withColumn("op", F.lit("update"))).unionByName(batch(spark, 9, 1).withColumn("op", F.lit("insert")))
    table.apply_changes(changes)
    assert sorted((r.id, r.name) for r in table.snapshot().collect()) == [(1, "u_1"), (2, "new_2"), (3, "new_3"), (4, "name_4"), (5, "name_5"), (9, "name_9")]
    assert ids(table.snapshot(1)) == list(range(6))


def test_keyless_tables_have_no_change_data(spark, tmp_path):
    plain = Table(spark, str(tmp_path / "p"), SCHEMA)
    plain.append(batch(spark, 0, 2))
    for call in (lambda: plain.delete_key(1), lambda: plain.lookup(1), lambda: plain.update(batch(spark, 0, 1))):
        with pytest.raises(ValueError):
            call()


def test_segments_and_statistics(spark, table):
    for k in range(4):
        table.append(batch(spark, k * 10, 10))
    s = table.segments().orderBy("seg_id").collect()
    assert [(r.seg_id, r.rows, r.min_lsn, r.max_lsn, r.min_id, r.max_id, r.min_amount, r.max_amount) for r in s] == [(k + 1, 10, k + 1, k + 1, k * 10, k * 10 + 9, k * 1000 - 500.0, k * 1000 + 400.0) for k in range(4)]
    assert all(r.bytes > 0 and not r.committed for r in s)
    seg = lambda f: [r.seg_id for r in f.orderBy("seg_id").collect()]
    assert seg(table.segments_by_time(DAY + datetime.timedelta(days=15), DAY + datetime.timedelta(days=25))) == [2, 3]
    assert seg(table.segments_by_time(DAY - datetime.timedelta(days=9), DAY - datetime.timedelta(days=5))) == []
    assert seg(table.segments_by_lsn(3)) == [3]
    assert table.mark_committed(1, 2) and not table.mark_committed(99)
    assert seg(table.uncommitted()) == [3, 4] and seg(table.prunable(0)) == [1, 2] and seg(table.prunable(3600)) == []
    assert table.watermarks().committed == 2
    assert tuple(table.totals().first())[:2] == (4, 40)


@pytest.mark.parametrize(
    "where, opened",
    [
        (Compare("id", "=", 17), 1),
        (Compare("amount", ">", 2000.0), 2),
        (Compare("id", "<", 10), 1),
        (Between("id", 8, 21), 3),
        (Compare("name", "=", "name_3"), 2),
        (In("id", (1, 39)), 2),
        (IsNull("name"), 0),
        (TimeRange("ts", DAY + datetime.timedelta(days=12), DAY + datetime.timedelta(days=13)), 1),
        (Compare("id", "<", 5) | Compare("id", ">", 35), 2),
        (Compare("id", "<", 25) & Compare("amount", ">", 100.0), 3),
        (Compare("id", "!=", 3), 4),
        (Compare("id", ">", 1000), 0),
    ],
)
def test_pruned_scans_equal_full_ones(spark, table, where, opened):
    for k in range(4):
        table.append(batch(spark, k * 10, 10))
    table.delete_key(12)
    found = table.scan(where)
    assert ids(found) == ids(table.snapshot().where(where.rows()))
    if opened is not None and where != Compare("name", "=", "name_3"):
        assert len({f.rsplit("/", 2)[-2] for f in found.inputFiles() if "/data/" in f}) == opened
    assert len(table.scan(where, ["id"], 1).columns) == 1


def test_nan_and_nulls_in_statistics(spark, table):
    rows = [(None, None, None, float("nan")), (1, "a", None, -5.0), (2, None, DAY, 3.0)]
    table.append(spark.createDataFrame(rows, SCHEMA))
    r = table.segments().first()
    assert (r.min_amount, r.max_amount, r.nulls_id, r.nulls_name, r.nulls_ts) == (-5.0, 3.0, 1, 2, 2)
    assert table.scan(IsNull("name")).count() == 2 and table.scan(IsNull("id")).count() == 1


def test_keys(spark, table):
    table.append(batch(spark, 0, 20))
    table.append(batch(spark, 10, 20, "b"))
    assert table.lookup(15).first().name == "b_15" and table.lookup(99).isEmpty()
    assert table.exists(3) and not table.exists(99) and table.might_exist(3)
    assert sum(table.might_exist(k) for k in range(1000, 1040)) <= 3
    assert tuple(table.index_stats().first()) == (30, 10, 30 * 48)
    assert {(r.id, r.seg_id) for r in table.key_index().collect()} == {(i, 1 if i < 10 else 2) for i in range(30)}


def test_composite_keys(spark, tmp_path):
    made = Table(spark, str(tmp_path / "c"), SCHEMA, ["id", "name"])
    made.append(batch(spark, 0, 5).unionByName(batch(spark, 0, 5, "b")))
    assert made.lookup(3, "b_3").count() == 1 and not made.exists(3, "c_3")
    made.delete_key(3, "b_3")
    assert ids(made.snapshot()) == sorted([*range(5), 0, 1, 2, 4])


def test_compaction_keeps_every_snapshot(spark, table):
    for k in range(3):
        table.append(batch(spark, k * 5, 5))
    table.delete_key(2)
    before = {lsn: ids(table.snapshot(lsn)) for lsn in range(6)}
    table.compact()
    assert {lsn: ids(table.snapshot(lsn)) for lsn in range(5)} == {lsn: before[lsn] for lsn in range(5)}
    assert ids(table.snapshot()) == before[4] and table.segments().count() == 1
    table.delete_key(7)
    table.append(batch(spark, 90, 1))
    assert ids(table.snapshot()) == sorted([*set(before[4]) - {7}, 90])


def test_a_fresh_session_reads_the_log(spark, table):
    table.append(batch(spark, 0, 5))
    table.delete_key(1)
    again = Table(spark, table.path, SCHEMA, ["id"])
    assert ids(again.snapshot()) == [0, 2, 3, 4] and again.append(batch(spark, 7, 1))[0].lsn == 3
    assert ids(table.snapshot()) == [0, 2, 3, 4, 7]


def test_log_conflicts_checkpoints_and_half_written_entries(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    log = Log(files, str(tmp_path / "_log"))
    for lsn in range(1, 204):
        log.publish({"lsn": lsn, "kind": "append", "segments": [{"seg_id": lsn, "min_lsn": lsn, "max_lsn": lsn}]})
    with pytest.raises(Conflict):
        log.publish({"lsn": 203, "kind": "append"})
    assert [n for n in files.names(str(tmp_path / "_log")) if n.endswith("checkpoint")] == [f"{100:020d}.checkpoint", f"{200:020d}.checkpoint"]
    files.create(str(tmp_path / "_log" / f"{204:020d}.json"), '{"lsn": 20')
    fresh = Log(files, str(tmp_path / "_log")).refresh()
    assert fresh.commit == 203 and len(fresh.segments) == 203 and fresh.next == 204


def test_two_writers(spark, table):
    other = Table(spark, table.path, SCHEMA, ["id"])
    table.append(batch(spark, 0, 1))
    other.log.refresh()
    table.append(batch(spark, 1, 1))
    # The other writer has not seen LSN 2 when it starts.
    other.log.refresh = lambda real=other.log.refresh, n=[0]: (n.__setitem__(0, n[0] + 1), other.log.state if n[0] == 1 else real())[1]
    assert other.append(batch(spark, 2, 1))[0].lsn == 3
    assert ids(table.snapshot()) == [0, 1, 2]


def test_catalog(spark, tmp_path):
    root = str(tmp_path / "c")
    catalog = Catalog(spark, root)
    made = catalog.create_table("ns.users", SCHEMA, "PrimaryKey", ["id"], properties={"a": "b"})
    catalog.create_table("log", '{"fields":[{"name":"id","type":"Int32"},{"name":"at","type":"Timestamp","nullable":false}]}')
    made.append(batch(spark, 0, 3))
    with pytest.raises(TableExists):
        catalog.create_table("log", SCHEMA)
    with pytest.raises(TableNotFound):
        catalog.get_table("none")
    for bad in (lambda: catalog.create_table("x", SCHEMA, "primary_key"), lambda: catalog.create_table("x", SCHEMA, primary_key=["no"]), lambda: catalog.create_table("x", '{"fields":[{"name":"a","type":"What"}]}')):
        with pytest.raises(ValueError):
            bad()
    again = Catalog(spark, root)
    assert again.list_tables() == ["default.log", "ns.users"]
    m = again.get_metadata("ns.users")
    assert (m.kind, m.primary_key, m.properties, m.schema) == (TableType.PRIMARY_KEY, ["id"], {"a": "b"}, SCHEMA)
    assert again.get_metadata("log").schema == T.StructType([T.StructField("id", T.IntegerType()), T.StructField("at", T.TimestampNTZType(), False)])
    assert ids(again.get_table("ns.users").snapshot()) == [0, 1, 2]
    again.drop_table("log")
    again.drop_table("ns.users")
    assert Catalog(spark, root).list_tables() == [], "dropping the last table is saved, too"
    assert ids(Table(spark, m.location, SCHEMA).snapshot()) == [0, 1, 2], "data stays"
    with pytest.raises(TableNotFound):
        again.drop_table("log")


def test_write_buffer(spark, table):
    buffer = WriteBuffer(BufferConfig(total=100, size=50, batches=3))
    assert buffer.empty and not buffer.freeze() and buffer.flush(table) == []
    with pytest.raises(ValueError):
        buffer.append(batch(spark, 0, 0))
    assert [buffer.append(batch(spark, k * 10, 10), 10) for k in range(3)] == [False, False, True]
    assert (buffer.batches, buffer.unflushed, buffer.frozen) == (3, 30, 0)
    assert buffer.freeze() and buffer.append(batch(spark, 30, 10), 60), "size triggers, too"
    with pytest.raises(TimeoutError):
        buffer.append(batch(spark, 40, 10), 20, timeout=0.05)
    assert buffer.flush(table) == [1, 2, 3] and buffer.unflushed == 60
    buffer.append(batch(spark, 40, 10), 20, timeout=0.05)
    buffer.close(table)
    assert buffer.empty and buffer.unflushed == 0
    assert [(r.seg_id, r.min_lsn, r.max_lsn, r.rows) for r in table.segments().orderBy("seg_id").collect()] == [(1, 1, 3, 30), (2, 4, 5, 20)]
    for lsn in range(6):
        assert ids(table.snapshot(lsn)) == list(range(lsn * 10))
    assert table.append(batch(spark, 99, 1))[0].lsn == 6 and table.watermarks().flushed == 6
    assert ids(Table(spark, table.path, SCHEMA, ["id"]).snapshot()) == [*range(50), 99]


def folders(path, name):
    return sorted(os.listdir(os.path.join(path, name))) if os.path.exists(os.path.join(path, name)) else []


def orphans(table):
    """Folders of data and deletes that the log does not know."""
    state = table.log.refresh()
    known = {s["path"].rsplit("/", 1)[1] for s in state.segments.values()} | {r["segment"]["path"].rsplit("/", 1)[1] for r in state.retired}
    deletes = {d["path"].rsplit("/", 1)[1] for d in state.deletes}
    return [f for f in folders(table.path, "data") if f not in known] + folders(table.path, "_staged") + [f for f in folders(table.path, "_deletes") if f not in deletes]


def test_a_half_written_entry_at_the_head_holds_nobody_up(spark, table):
    table.append(batch(spark, 0, 3))
    table.log.files.create(f"{table.path}/_log/{2:020d}.json", '{"lsn": 2, "kind')
    table.log.grace = 0.5
    assert table.append(batch(spark, 3, 3))[0].lsn == 3 and ids(table.snapshot()) == list(range(6))
    again = Table(spark, table.path, SCHEMA, ["id"])
    again.log.grace = 0.0
    assert ids(again.snapshot()) == list(range(6)) and orphans(table) == []


def test_a_half_written_entry_in_the_middle(spark, table):
    for k in range(3):
        table.append(batch(spark, k, 1))
    path = f"{table.path}/_log/{2:020d}.json"
    open(path, "w").write('{"lsn": 2, "kind": "app')
    fresh = Table(spark, table.path, SCHEMA, ["id"])
    assert ids(fresh.snapshot()) == [0], "what follows waits while the entry may still be written"
    fresh.log.grace = 0.0
    assert ids(fresh.snapshot()) == [0, 2] and fresh.append(batch(spark, 9, 1))[0].lsn == 4


def test_an_entry_that_stays_in_the_way_is_an_error_in_bounded_time(spark, table, monkeypatch):
    monkeypatch.setattr("tidelog.sources.table.RETRIES", 4)
    table.log.files.create(f"{table.path}/_log/{1:020d}.json", "{")
    with pytest.raises(Conflict):
        table.append(batch(spark, 0, 3))
    assert folders(table.path, "data") == folders(table.path, "_staged") == []


def test_racing_writers_lose_nothing_and_write_once(spark, table):
    writers = [Table(spark, table.path, SCHEMA, ["id"]) for _ in range(4)]

    def work(k):
        return [writers[k].append(batch(spark, 100 * k + i, 1))[0].lsn for i in range(5)]

    with ThreadPoolExecutor(4) as pool:
        lsns = sum(pool.map(work, range(4)), [])
    assert sorted(lsns) == list(range(1, 21)) and ids(table.snapshot()) == sorted(100 * k + i for k in range(4) for i in range(5))
    assert orphans(table) == []
    assert sorted(r[LSN] for r in table.snapshot().collect()) == list(range(1, 21)), "each row has the LSN of its entry"


def test_the_log_is_shortened_behind_its_checkpoints(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    log = Log(files, str(tmp_path / "_log"))
    entry = lambda lsn: {"lsn": lsn, "kind": "append", "segments": [{"seg_id": lsn, "min_lsn": lsn, "max_lsn": lsn}]}
    slow = Log(files, str(tmp_path / "_log"))
    for lsn in range(1, 302):
        log.publish(entry(lsn))
        if lsn == 5:
            assert slow.refresh().next == 6
    assert len([n for n in files.names(str(tmp_path / "_log")) if n.endswith("json")]) <= 201
    with pytest.raises(Conflict):
        slow.publish(entry(6))
    assert len(slow.refresh().segments) == len(Log(files, str(tmp_path / "_log")).refresh().segments) == 301


def test_an_append_during_compaction_is_there_once(spark, table, monkeypatch):
    other = Table(spark, table.path, SCHEMA, ["id"])
    for k in range(3):
        table.append(batch(spark, k, 1))
    real = table._stage
    between = [lambda: other.append(batch(spark, 9, 1))]
    monkeypatch.setattr(table, "_stage", lambda rows: (real(rows), between and between.pop()())[0])
    table.compact()
    assert ids(table.snapshot()) == [0, 1, 2, 9] == ids(Table(spark, table.path, SCHEMA).snapshot()) and table.segments().count() == 2
    # A delete in between is not lost either.
    table.append(batch(spark, 20, 2))
    between = [lambda: other.delete_key(20)]
    monkeypatch.setattr(table, "_stage", lambda rows: (real(rows), between and between.pop()())[0])
    table.compact()
    assert ids(table.snapshot()) == [0, 1, 2, 9, 21] and table.segments().count() == 1 and orphans(table) == []
    assert ids(table.snapshot(3)) == [0, 1, 2]


def test_compaction_leaves_large_segments_and_drops_applied_deletes(spark, table):
    table.append(batch(spark, 0, 2000))
    for k in range(3):
        table.append(batch(spark, 3000 + k, 1))
    large = table.log.state.segments[1]["bytes"]
    table.compact(target=large - 1)
    assert [r.rows for r in table.segments().orderBy("seg_id").collect()] == [2000, 3]
    assert table.compact(target=large - 1) is None, "nothing is left to join"
    table.delete_key(3001)
    assert table._deletes(table.head(), list(table.log.state.segments.values())) is not None
    table.compact(target=large - 1)
    assert table._deletes(table.head(), list(table.log.state.segments.values())) is None
    assert ids(table.snapshot()) == [*range(2000), 3000, 3002]


VALUES = [None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0, 1.0, 2.5, -7.0]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(VALUES), min_size=1, max_size=4), min_size=1, max_size=3), st.data())
def test_pruned_scans_equal_full_ones_with_nan_null_and_infinity(spark, tmp_path_factory, batches, data):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.DoubleType())])
    made = Table(spark, str(tmp_path_factory.mktemp("nan") / "t"), schema)
    for k, values in enumerate(batches):
        made.append(spark.createDataFrame([(10 * k + i, v) for i, v in enumerate(values)], schema))
    some = [v for v in VALUES if v is not None]
    v, w = data.draw(st.sampled_from(some)), data.draw(st.sampled_from(some))
    wheres = [Compare("v", op, v) for op in ("=", "!=", "<", "<=", ">", ">=")] + [Between("v", v, w), In("v", (v, w)), IsNull("v"), Compare("v", "<", v) | Compare("v", ">", w)]
    full = made.snapshot()
    for where in wheres:
        assert ids(made.scan(where)) == ids(full.where(where.rows())), where


def test_nulls_in_required_columns_are_refused(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("tags", T.ArrayType(T.StringType()), False), T.StructField("x", T.LongType())])
    made = Table(spark, str(tmp_path / "t"), schema, ["id"])
    loose = "id long, tags array<string>, x long"
    made.append(spark.createDataFrame([(1, ["a"], None)], loose))
    for bad in ((None, ["a"], 1), (2, None, 1)):
        with pytest.raises(ValueError, match="nulls"):
            made.append(spark.createDataFrame([(5, ["b"], 1), bad], loose))
    assert ids(made.snapshot()) == [1] and orphans(made) == []


def test_one_change_a_key(spark, table):
    table.append(batch(spark, 0, 3))
    twice = batch(spark, 1, 1, "u").withColumn("op", F.lit("update"))
    with pytest.raises(ValueError, match="one key"):
        table.apply_changes(twice.unionByName(twice))
    with pytest.raises(ValueError, match="one key"):
        table.update(batch(spark, 1, 1).unionByName(batch(spark, 1, 1)))
    assert ids(table.snapshot()) == [0, 1, 2] and table.watermarks().next == 2 and orphans(table) == []


def opened(frame):
    return len({f.rsplit("/", 2)[-2] for f in frame.inputFiles() if "/data/" in f})


def test_lookups_open_only_segments_that_may_have_the_key(spark, table):
    for k in range(4):
        table.append(batch(spark, k * 10, 10))
    assert opened(table.lookup(25)) == 1 and table.lookup(25).first().name == "name_25" and opened(table.lookup(99)) == 0
    for wrong in ("25", 25.0, True, None):
        assert table.lookup(wrong).isEmpty() and not table.exists(wrong) and not table.might_exist(wrong)
    assert table.lookup(1, 2).isEmpty()


def test_conditions_in_sql_prune_segments(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"))
    made = catalog.create_table("sales", SCHEMA, "primary_key", ["id"])
    for k in range(4):
        made.append(batch(spark, k * 10, 10))
    made.delete_key(12)
    for text, want, n in (
        ("SELECT id FROM sales WHERE id = 17", [17], 1),
        ("SELECT id FROM sales WHERE amount > 3000 AND name <> 'x'", [36, 37, 38, 39], 1),
        ("SELECT id FROM sales WHERE ts >= TIMESTAMP_NTZ '2024-01-21' AND ts < TIMESTAMP_NTZ '2024-01-22'", [20], 1),
        ("SELECT id FROM sales WHERE id IN (11, 12, 13)", [11, 13], 1),
        ("SELECT id FROM sales WHERE id < 2 OR id > 37", [0, 1, 38, 39], 2),
        ("SELECT id FROM sales WHERE name IS NULL", [], 0),
        ("SELECT id FROM sales WHERE id % 39 = 0", [0, 39], 4),
        ("SELECT a.id FROM sales a JOIN sales b ON a.id = b.id + 10 WHERE a.id = 15 AND b.id = 5", [15], 2),
        ("SELECT id FROM sales WHERE id = 3 AND amount < (SELECT max(amount) FROM sales)", [3], 4),
        ("WITH t AS (SELECT * FROM default.sales WHERE id = 3) SELECT id FROM t", [3], 1),
    ):
        found = catalog.sql(text)
        assert ids(found) == want and opened(found) == n, text
    assert not spark.catalog.tableExists("sales"), "the views are not left in the session"


def test_names_in_sql(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"))
    for name, k in (("a.t", 1), ("b.t", 2), ("c.u", 3), ("u", 4)):
        catalog.create_table(name, SCHEMA).append(batch(spark, k, 1))
    assert ids(catalog.sql("SELECT * FROM a.t")) == [1] and ids(catalog.sql("SELECT x.id FROM `b`.`t` x JOIN a.t y ON x.id = y.id + 1")) == [2]
    assert ids(catalog.sql("SELECT * FROM u")) == [4] and ids(catalog.sql("SELECT u.id FROM c.u AS u")) == [3]
    with pytest.raises(AnalysisException):
        catalog.sql("SELECT * FROM t")


def test_two_catalogs_keep_each_others_tables(spark, tmp_path):
    one, two = (Catalog(spark, str(tmp_path / "c")) for _ in range(2))
    one.create_table("x", SCHEMA)
    two.create_table("y", SCHEMA)
    with pytest.raises(TableExists):
        two.create_table("x", SCHEMA)
    assert one.list_tables() == two.list_tables() == ["default.x", "default.y"] and one.get_table("y").head() == 0
    one.drop_table("y")
    assert two.list_tables() == ["default.x"]


def test_a_running_buffer_flushes_by_itself(spark, table):
    buffer = WriteBuffer(BufferConfig(interval_ms=50))
    with buffer.running(table):
        buffer.append(batch(spark, 0, 3), 1)
        end = time.monotonic() + 30
        while not buffer.empty and time.monotonic() < end:
            time.sleep(0.05)
        assert buffer.empty and ids(table.snapshot()) == [0, 1, 2]
        buffer.append(batch(spark, 3, 3), 1)
    assert ids(table.snapshot()) == list(range(6)) and buffer.failure is None


def test_a_flush_that_came_through_unnoticed_is_not_done_twice(spark, table, monkeypatch):
    buffer = WriteBuffer(BufferConfig())
    buffer.append(batch(spark, 0, 3), 1)
    buffer.freeze()
    real = table.append_many
    monkeypatch.setattr(table, "append_many", lambda *a: (real(*a), 1 / 0))
    with pytest.raises(ZeroDivisionError):
        buffer.flush(table)
    monkeypatch.setattr(table, "append_many", real)
    assert buffer.flush(table) == [1] and ids(table.snapshot()) == [0, 1, 2] and buffer.empty


def test_durability_is_waited_for_and_told(spark, table):
    seen = []
    end = table.subscribe(seen.append, every=0.02)
    table.append(batch(spark, 0, 2))
    table.append(batch(spark, 2, 2))
    assert table.reached(2) is Tier.DISK and table.reached(9) is None
    assert table.wait(1, Tier.DISK, 1) and not table.wait(1, Tier.COMMITTED, 0.05)
    table.mark_committed(1)
    assert table.wait(1, Tier.COMMITTED, 1) and not table.wait(2, Tier.COMMITTED, 0.05)
    limit = time.monotonic() + 20
    while (not seen or seen[-1].committed < 1) and time.monotonic() < limit:
        time.sleep(0.02)
    end()
    assert seen[-1].committed == 1 and seen[-1].flushed >= 2 and [w.next for w in seen] == sorted(w.next for w in seen)


def test_segments_move_to_another_place_and_leftovers_go(spark, table, tmp_path):
    for k in range(3):
        table.append(batch(spark, k * 10, 10))
    table.delete_key(5)
    (tmp_path / "far").mkdir()
    assert table.migrate(f"file://{tmp_path}/far", age_seconds=3600) is None
    assert table.migrate(f"file://{tmp_path}/far") == 5 and table.migrate(f"file://{tmp_path}/far") is None
    want = [i for i in range(30) if i != 5]
    for made in (table, Table(spark, table.path, SCHEMA, ["id"])):
        assert ids(made.snapshot()) == want and ids(made.snapshot(2)) == list(range(20))
        assert all("/far/" in f for f in made.snapshot().inputFiles() if "/seg-" in f)
    os.makedirs(f"{table.path}/_staged/dead")
    assert table.vacuum() == [] and len(table.vacuum(0)) == 4 and folders(table.path, "data") == folders(table.path, "_staged") == []
    table.append(batch(spark, 90, 1))
    table.delete_key(12)
    table.compact()
    assert ids(table.snapshot()) == [i for i in [*want, 90] if i != 12] and ids(table.snapshot(5)) == want
