"""Queries over versioned rows: snapshots, change data, keys, statistics, pruning, watermarks, buffers."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tidelog.functions.keys import KeyFilter, bloom_bits, bloom_hashes
from tidelog.operators import buffer as B
from tidelog.operators import cdc, lookup, prune, stats
from tidelog.operators.snapshot import distinct_deletes, snapshot, snapshot_by_batch
from tidelog.plans.base import E, S, deletes, events, query, table
from tidelog.streaming.ingest import ack_log

COLUMNS = ["event_id", "user_id", "event_type", "value", "__lsn"]
LIST = ", ".join(COLUMNS)


def _snapshot(lsn):
    def run(spark, sf_dir):
        rows = events(spark, sf_dir)
        return snapshot(rows, deletes(rows, rows.count()), ["event_id"], lsn).select(*COLUMNS)

    return run


for _name, _lsn in (("snapshot_as_of", 20), ("snapshot_before_deletes", 5), ("snapshot_partly_deleted", 11), ("snapshot_latest", 40)):
    query(f"{E} SELECT {LIST} FROM e WHERE __lsn <= {_lsn} AND event_id NOT IN (SELECT event_id FROM d WHERE delete_lsn <= {_lsn})", _name)(_snapshot(_lsn))


@query(f"{E}, l AS (SELECT target_lsn, max(delete_lsn) AS last FROM d GROUP BY target_lsn) SELECT {LIST} FROM e WHERE __lsn <= 20 AND event_id NOT IN (SELECT event_id FROM d JOIN l USING (target_lsn) WHERE last BETWEEN 1 AND 20)")
def snapshot_batch_level_delete(spark, sf_dir):
    rows = events(spark, sf_dir)
    return snapshot_by_batch(rows, deletes(rows, rows.count()), ["event_id"], 20).select(*COLUMNS)


@query(f"{E}, t AS (SELECT event_id, delete_lsn FROM d UNION ALL SELECT event_id, delete_lsn + 5 FROM d) SELECT event_id, min(delete_lsn)::BIGINT AS delete_lsn FROM t GROUP BY event_id")
def deletes_repeated(spark, sf_dir):
    rows = events(spark, sf_dir)
    gone = deletes(rows, rows.count()).select("event_id", "delete_lsn")
    return distinct_deletes(gone.unionByName(gone.withColumn("delete_lsn", F.col("delete_lsn") + 5)), ["event_id"])


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'")
def cdc_latest_by_key(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return cdc.latest_by_key(rows, ["user_id"], F.col("event_id"), F.col("event_type") == "error")


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus, round(CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice * 2 ELSE o_totalprice END, 4) AS o_totalprice FROM orders")
def cdc_update_apply(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    changes = rows.where("o_orderkey % 7 = 0").withColumns({"o_orderstatus": F.lit("U"), "o_totalprice": F.col("o_totalprice") * 2})
    # Keys without a row change nothing.
    more = changes.withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    return cdc.apply_updates(rows, changes.unionByName(more), ["o_orderkey"]).withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'U' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 10 <> 4 UNION ALL SELECT -1 - o_orderkey, 'N' FROM orders WHERE o_orderkey % 10 = 5")
def cdc_change_log(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    key, last = F.col("o_orderkey"), F.pmod("o_orderkey", F.lit(10))
    made = lambda n, k, op, status, lsn: rows.where(last == n).select(k.alias("o_orderkey"), F.lit(status).alias("o_orderstatus"), F.lit(op).alias("op"), F.lit(lsn).cast("long").alias("__lsn"))
    log = made(3, key, "update", "X", 1).unionByName(made(3, key, "update", "U", 3)).unionByName(made(4, key, "update", "Y", 2)).unionByName(made(4, key, "delete", None, 4)).unionByName(made(5, -1 - key, "insert", "N", 2))
    return cdc.apply_changes(rows, log, ["o_orderkey"])


@query(f"{E} SELECT user_id, max(event_id) AS event_id, max(__lsn) AS __lsn FROM e GROUP BY user_id")
def cdc_locate_newest(spark, sf_dir):
    rows = events(spark, sf_dir)
    return cdc.locate(rows, rows.select("user_id"), ["user_id"], ["event_id"]).select("user_id", "event_id", "__lsn")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 42")
def pk_lookup(spark, sf_dir):
    return lookup.lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], (42,))


@query("SELECT c_custkey, c_name FROM customer WHERE c_name = (SELECT min(c_name) FROM customer)")
def pk_lookup_string(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return lookup.lookup(rows, ["c_name"], (rows.agg(F.min("c_name")).first()[0],))


@query(f"{E} SELECT user_id, event_id, __lsn FROM e WHERE user_id = 7 ORDER BY event_id DESC LIMIT 1")
def pk_lookup_newest(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", "__lsn")
    index = lookup.key_index(rows, ["user_id"], ["__lsn", "event_id"])
    return index.where("user_id = 7").select("user_id", "event_id", "__lsn")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT s_suppkey * 3 FROM supplier)")
def pk_multi_lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("o_orderkey"))
    return lookup.lookup_many(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), wanted, ["o_orderkey"])


@query("SELECT c_custkey * 5 AS o_orderkey, EXISTS (SELECT 1 FROM orders WHERE o_orderkey = c_custkey * 5 AND o_orderstatus = 'F') AS found FROM customer")
def pk_exists(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 5).alias("o_orderkey"))
    return lookup.exists(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), wanted, ["o_orderkey"])


@query("SELECT k AS o_orderkey, k >= 0 AS might FROM (VALUES (0), (1), (42), (99)) t(k)")
def pk_might_exist(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    probe = spark.createDataFrame([(0,), (1,), (42,), (99,)], "o_orderkey long")
    found = KeyFilter.build(rows, ["o_orderkey"]).might_contain(probe, ["o_orderkey"])
    return spark.createDataFrame([(k, m) for k, m in zip((0, 1, 42, 99), found, strict=True)], "o_orderkey int, might boolean")


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 3 AND turn = 1")
def pk_composite_lookup(spark, sf_dir):
    return lookup.lookup(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id", "turn"], (3, 1))


@query("SELECT count(DISTINCT user_id)::BIGINT AS entries, (count(user_id) - count(DISTINCT user_id))::BIGINT AS collisions, (48 * count(DISTINCT user_id))::BIGINT AS memory_bytes FROM events")
def pk_index_stats(spark, sf_dir):
    return lookup.index_stats(table(spark, sf_dir, "events"), ["user_id"])


@query("SELECT count(*)::BIGINT AS entries, (sum(n) - count(*))::BIGINT AS collisions, (48 * count(*))::BIGINT AS memory_bytes FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def pk_composite_stats(spark, sf_dir):
    return lookup.index_stats(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"{E}, i AS (SELECT user_id, max(__lsn) AS seg_id FROM e GROUP BY user_id) SELECT user_id, seg_id FROM i WHERE seg_id <> 10")
def pk_index_without_segment(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("seg_id", F.col("__lsn"))
    return lookup.without_segment(lookup.key_index(rows, ["user_id"], ["seg_id"]), 10)


@query(f"{E}, i AS (SELECT user_id, max(__lsn) AS seg_id FROM e GROUP BY user_id) SELECT seg_id, count(*) AS keys FROM i GROUP BY seg_id")
def pk_keys_by_segment(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("seg_id", F.col("__lsn"))
    return lookup.key_index(rows, ["user_id"], ["seg_id"]).groupBy("seg_id").agg(F.count("*").alias("keys"))


@query(f"{E}, i AS (SELECT user_id, max(__lsn) AS seg_id FROM e GROUP BY user_id) SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 10 ELSE seg_id END AS seg_id FROM i WHERE seg_id <> 10 OR user_id % 3 = 0")
def pk_index_replace_segment(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("seg_id", F.col("__lsn"))
    index = lookup.key_index(rows, ["user_id"], ["seg_id"])
    fresh = index.where("user_id % 3 = 0").select("user_id", F.lit(10).cast("long").alias("seg_id"))
    return lookup.with_segment(index, fresh, ["user_id"], 10)


@query(f"{E}, i AS (SELECT user_id, max(__lsn) AS seg_id FROM e GROUP BY user_id) SELECT count(*) AS entries, count(DISTINCT seg_id) AS segments, (84 * count(*))::BIGINT AS memory_bytes FROM i")
def pk_disk_index_stats(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("seg_id", F.col("__lsn"))
    return lookup.disk_index_stats(lookup.key_index(rows, ["user_id"], ["seg_id"]))


@query("SELECT n, ceil(-n * ln(0.01) / (ln(2) * ln(2)))::BIGINT AS bits, greatest(1, round(ceil(-n * ln(0.01) / (ln(2) * ln(2))) / n * ln(2)))::BIGINT AS hashes FROM (SELECT count(*) AS n FROM orders)")
def bloom_parameters(spark, sf_dir):
    n = table(spark, sf_dir, "orders").count()
    return spark.createDataFrame([(n, bloom_bits(n), bloom_hashes(n))], "n long, bits long, hashes long")


def _segments(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("seg_id", F.col("__lsn"))
    return rows, stats.segment_stats(rows, "seg_id", ["value", "event_type", "event_id"])


@query(f"{S} SELECT seg_id, rows, min_lsn, max_lsn, min_time, max_time, min_value, max_value, 0::BIGINT AS nulls_value, min_event_type, max_event_type, min_event_id, max_event_id FROM s")
def segment_stats_events(spark, sf_dir):
    return _segments(spark, sf_dir)[1].drop("nulls_event_type", "nulls_event_id", "nans_value")


@query("SELECT l_orderkey % 8 AS seg_id, count(*) AS rows, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity, min(l_shipdate) AS min_l_shipdate, max(l_shipdate) AS max_l_shipdate, count(*) FILTER (l_returnflag IS NULL) AS nulls_l_returnflag, min(l_returnflag) AS min_l_returnflag FROM lineitem GROUP BY 1")
def segment_stats_lineitem(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("seg_id", F.pmod("l_orderkey", F.lit(8)))
    return stats.segment_stats(rows, "seg_id", ["l_quantity", "l_shipdate", "l_returnflag"]).select("seg_id", "rows", "min_l_quantity", "max_l_quantity", "min_l_shipdate", "max_l_shipdate", "nulls_l_returnflag", "min_l_returnflag")


@query("SELECT c_nationkey % 5 AS seg_id, count(*) AS rows, min(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE -c_acctbal END) AS min_v, max(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE -c_acctbal END) AS max_v, count(*) FILTER (c_custkey % 3 = 0) AS nulls_v, round(count(*) FILTER (c_custkey % 3 = 0) / count(*), 9) AS null_fraction FROM customer GROUP BY 1")
def segment_stats_nulls_and_negatives(spark, sf_dir):
    """Negative values, nulls and NaN; NaN counts as neither bound."""
    rows = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).alias("seg_id"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE -c_acctbal END").alias("v"))
    extra = rows.select("seg_id").distinct().select("seg_id", F.lit(float("nan")).alias("v"))
    found = stats.segment_stats(rows.unionByName(extra), "seg_id", ["v"]).withColumn("rows", F.col("rows") - 1)
    return found.withColumn("null_fraction", F.round(stats.null_fraction("v"), 9)).select("seg_id", "rows", "min_v", "max_v", "nulls_v", "null_fraction")


@query("SELECT l_orderkey % 8 % 2 AS seg_id, count(*)::BIGINT AS rows, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity, 0::BIGINT AS nulls_l_quantity FROM lineitem GROUP BY 1")
def segment_stats_merged(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("batch", F.pmod("l_orderkey", F.lit(8)))
    parts = stats.segment_stats(rows, "batch", ["l_quantity"]).withColumn("seg_id", F.col("batch") % 2)
    return stats.merge_stats(parts.drop("batch", "min_time", "max_time", "min_lsn", "max_lsn"), "seg_id").drop("nans_l_quantity")


@query(f"{S} SELECT count(*) AS segments, sum(rows)::BIGINT AS rows, (sum(rows) * 100)::BIGINT AS bytes FROM s")
def segment_totals(spark, sf_dir):
    return stats.totals(_segments(spark, sf_dir)[1].withColumn("bytes", F.col("rows") * 100))


@query(f"{S} SELECT seg_id FROM s WHERE min_time <= TIMESTAMP '2024-01-12' AND max_time >= TIMESTAMP '2024-01-08'")
def segments_by_time(spark, sf_dir):
    day = lambda d: F.lit(datetime.datetime(2024, 1, d)).cast("timestamp_ntz")
    return _segments(spark, sf_dir)[1].where(stats.overlaps_time(day(8), day(12))).select("seg_id")


@query(f"{S} SELECT seg_id FROM s WHERE 4 BETWEEN min_lsn AND max_lsn")
def segments_by_lsn(spark, sf_dir):
    return _segments(spark, sf_dir)[1].where(stats.contains_lsn(4)).select("seg_id")


@query(f"{S} SELECT seg_id FROM s WHERE seg_id > 6")
def segments_uncommitted(spark, sf_dir):
    return _segments(spark, sf_dir)[1].withColumn("committed", F.col("max_lsn") <= 6).where("NOT committed").select("seg_id")


@query(f"{S} SELECT seg_id FROM s WHERE seg_id <= 6 AND max_time <= TIMESTAMP '2024-01-10'")
def segments_prunable(spark, sf_dir):
    old = F.col("max_time") <= F.lit("2024-01-10").cast("timestamp_ntz")
    return _segments(spark, sf_dir)[1].withColumn("committed", F.col("max_lsn") <= 6).where(F.col("committed") & old).select("seg_id")


def _prune(where):
    return lambda spark, sf_dir: prune.prune(_segments(spark, sf_dir)[1], where).select("seg_id")


for _name, _where, _sql in (
    ("prune_eq", prune.Compare("event_id", "=", 321), "min_event_id <= 321 AND max_event_id >= 321"),
    ("prune_gt", prune.Compare("value", ">", 400.0), "max_value > 400.0"),
    ("prune_lt", prune.Compare("event_id", "<", 500), "min_event_id < 500"),
    ("prune_between", prune.Between("event_id", 250, 750), "min_event_id <= 750 AND max_event_id >= 250"),
    ("prune_in", prune.In("event_id", (3, 900)), "(min_event_id <= 3 AND max_event_id >= 3) OR (min_event_id <= 900 AND max_event_id >= 900)"),
    ("prune_string", prune.Compare("event_type", "=", "view"), "min_event_type <= 'view' AND max_event_type >= 'view'"),
    ("prune_and_or", (prune.Compare("event_id", "<", 300) | prune.Compare("event_id", ">", 700)) & prune.Compare("value", ">", 1.0), "(min_event_id < 300 OR max_event_id > 700) AND max_value > 1.0"),
    ("prune_none", None, "true"),
    ("prune_all", prune.Compare("value", "<", -1.0), "min_value < -1.0"),
    ("prune_without_stats", prune.Compare("props", "=", "x"), "true"),
    ("prune_time", prune.TimeRange("ts", datetime.datetime(2024, 1, 3), datetime.datetime(2024, 1, 5)), "min_time <= TIMESTAMP '2024-01-05' AND max_time >= TIMESTAMP '2024-01-03'"),
):
    query(f"{S} SELECT seg_id FROM s WHERE {_sql}", _name)(_prune(_where))


@query(f"{E} SELECT DISTINCT __lsn AS seg_id FROM e WHERE event_id = 77")
def prune_pk(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("seg_id", F.col("__lsn"))
    return prune.prune_by_key(rows.select("event_id", "seg_id"), ["event_id"], (77,))


@query(f"{E} SELECT event_id, value, __lsn AS seg_id FROM e WHERE event_id BETWEEN 250 AND 750 AND value > 100.0")
def pruned_scan_events(spark, sf_dir):
    rows, segments = _segments(spark, sf_dir)
    where = prune.Between("event_id", 250, 750) & prune.Compare("value", ">", 100.0)
    return prune.pruned_scan(rows, segments, where).select("event_id", "value", "seg_id")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_orderkey // 64 AS seg_id FROM lineitem WHERE l_orderkey BETWEEN 100 AND 200 AND l_quantity > 20")
def pruned_scan_lineitem(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.expr("l_orderkey div 64").alias("seg_id"))
    segments = stats.segment_stats(rows, "seg_id", ["l_orderkey", "l_quantity"])
    return prune.pruned_scan(rows, segments, prune.Between("l_orderkey", 100, 200) & prune.Compare("l_quantity", ">", 20.0))


@query(f"{E} SELECT event_id, value FROM e WHERE false")
def empty_scan(spark, sf_dir):
    rows, segments = _segments(spark, sf_dir)
    return prune.pruned_scan(rows, segments, prune.Compare("value", "<", -1.0)).select("event_id", "value")


@query(f"{E} SELECT max(__lsn) + 1 AS next_lsn, max(__lsn) FILTER (__lsn <= 8) AS flushed_lsn, max(__lsn) FILTER (__lsn <= 5) AS committed_lsn FROM e")
def flush_watermarks(spark, sf_dir):
    lsn = F.col("__lsn")
    return events(spark, sf_dir).agg((F.max(lsn) + 1).alias("next_lsn"), F.max(F.when(lsn <= 8, lsn)).alias("flushed_lsn"), F.max(F.when(lsn <= 5, lsn)).alias("committed_lsn"))


@query(f"{E} SELECT max(__lsn) + 1 - max(__lsn) FILTER (__lsn <= 8) AS pending_flush, max(__lsn) FILTER (__lsn <= 8) - max(__lsn) FILTER (__lsn <= 5) AS pending_commit FROM e")
def lsn_lag(spark, sf_dir):
    w = flush_watermarks(spark, sf_dir)
    return w.select(F.greatest(F.lit(0), F.col("next_lsn") - F.col("flushed_lsn")).cast("long").alias("pending_flush"), F.greatest(F.lit(0), F.col("flushed_lsn") - F.col("committed_lsn")).cast("long").alias("pending_commit"))


def _batches(spark, sf_dir):
    """A hundred batches with their rows and bytes."""
    rows = table(spark, sf_dir, "events")
    return rows.groupBy(F.expr(f"event_id * 100 div {max(1, rows.count())}").alias("batch")).agg(F.count("*").alias("rows"), F.sum(F.length("props") + 100).cast("long").alias("bytes"))


_B = "WITH RECURSIVE n AS (SELECT greatest(1, count(*)) AS n FROM events), b AS (SELECT event_id * 100 // (SELECT n FROM n) AS batch, count(*) AS rows, sum(length(props) + 100)::BIGINT AS bytes FROM events GROUP BY 1)"


def _freeze(config):
    return lambda spark, sf_dir: B.freeze_plan(_batches(spark, sf_dir), config).select("batch", "rows", "bytes", "buffer")


for _name, _size, _count in (("buffer_freeze_by_size", 5000, 1000), ("buffer_freeze_by_count", 1 << 40, 7), ("buffer_freeze_plan", 20000, 12)):
    query(
        f"""{_B}, f AS (SELECT batch, rows, bytes, 0::BIGINT AS buffer, bytes AS size, 1 AS k FROM b WHERE batch = 0
        UNION ALL SELECT b.batch, b.rows, b.bytes, CASE WHEN f.size >= {_size} OR f.k >= {_count} THEN f.buffer + 1 ELSE f.buffer END,
          CASE WHEN f.size >= {_size} OR f.k >= {_count} THEN b.bytes ELSE f.size + b.bytes END, CASE WHEN f.size >= {_size} OR f.k >= {_count} THEN 1 ELSE f.k + 1 END
        FROM f JOIN b ON b.batch = f.batch + 1) SELECT batch, rows, bytes, buffer FROM f""",
        _name,
    )(_freeze(B.BufferConfig(size=_size, batches=_count)))


@query(f"{_B} SELECT batch, rows, (sum(rows) OVER (ORDER BY batch))::BIGINT AS end_lsn, (sum(rows) OVER (ORDER BY batch) - rows + 1)::BIGINT AS start_lsn FROM b")
def lsn_assign_ranges(spark, sf_dir):
    return B.lsn_ranges(_batches(spark, sf_dir).select("batch", "rows"))


@query(f"{E} SELECT DISTINCT __lsn AS lsn, tier FROM e, (VALUES ('MEMORY'), ('DISK')) t(tier) WHERE tier = 'MEMORY' OR __lsn <= 8")
def ack_tiers(spark, sf_dir):
    return ack_log(events(spark, sf_dir).select(F.col("__lsn").alias("lsn")).distinct(), 8)
