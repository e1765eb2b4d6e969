"""Partition transforms and the SQL surface over the tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog.functions.partition import PartitionField, PartitionSpec
from tidelog.operators.asof import asof_join
from tidelog.plans.base import query, table


def _part(name, transform, source="ts", rows="events"):
    def run(spark, sf_dir):
        frame = table(spark, sf_dir, rows)
        return frame.groupBy(PartitionField(source, transform, "part").column(frame.schema)).agg(F.count("*").alias("n"))

    return run


for _name, _transform, _sql in (
    ("part_year", "year", "year(ts)::INTEGER"),
    ("part_month", "month", "date_trunc('month', ts)::TIMESTAMP"),
    ("part_day", "day", "ts::DATE"),
    ("part_hour", "hour", "date_trunc('hour', ts)::TIMESTAMP"),
):
    query(f"SELECT {_sql} AS part, count(*) AS n FROM events GROUP BY 1", _name)(_part(_name, _transform))
query("SELECT event_type AS part, count(*) AS n FROM events GROUP BY 1", "part_identity")(_part("part_identity", "identity", "event_type"))
query("SELECT o_orderkey - o_orderkey % 100 AS part, count(*) AS n FROM orders GROUP BY 1", "part_truncate_int")(_part("part_truncate_int", "truncate[100]", "o_orderkey", "orders"))
query("SELECT (c_custkey - 75) - (((c_custkey - 75) % 10) + 10) % 10 AS part, count(*) AS n FROM customer GROUP BY 1", "part_truncate_negative")(
    lambda spark, sf_dir: (f := table(spark, sf_dir, "customer").select((F.col("c_custkey") - 75).alias("k"))).groupBy(PartitionField("k", "truncate(10)", "part").column(f.schema)).agg(F.count("*").alias("n"))
)
query("SELECT substr(o_orderpriority, 1, 3) AS part, count(*) AS n FROM orders GROUP BY 1", "part_truncate_str")(_part("part_truncate_str", "truncate[3]", "o_orderpriority", "orders"))
query(None, "part_bucket")(_part("part_bucket", "bucket[16]", "o_orderkey", "orders"))


@query("SELECT ts::DATE AS day, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def part_spec(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    spec = PartitionSpec((PartitionField("ts", "day", "day"), PartitionField(4, "identity", "kind")))
    return rows.groupBy(*spec.columns(rows.schema)).agg(F.count("*").alias("n"))


#: Queries that both engines take as they are.
SHARED = {
    "sql_filter_limit": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100 ORDER BY o_orderkey LIMIT 10",
    "sql_filter_conj": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100",
    "sql_group_agg": "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 100 GROUP BY o_orderstatus",
    "sql_projection": "SELECT event_id, value * 2 AS doubled FROM events",
    "sql_time_filter": "SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00' AND value > 50",
    "sql_interval": "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL '5' DAY",
    "sql_join_inner": "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey",
    "sql_join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'",
    "sql_join_right": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 400000",
    "sql_join_full": "SELECT s_suppkey, c_custkey FROM supplier FULL OUTER JOIN customer ON s_suppkey = c_custkey + 5",
    "sql_join_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "sql_join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "sql_join_small_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "sql_join_theta": "SELECT n.n_nationkey, r.r_regionkey FROM nation n JOIN region r ON n.n_regionkey < r.r_regionkey",
    "sql_join_star": "SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "sql_aggregates": "SELECT l_returnflag, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 5) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r, count(DISTINCT l_partkey) AS parts, median(l_quantity) AS med, bool_and(l_quantity > 0) AS every, bool_or(l_quantity > 49) AS some FROM lineitem GROUP BY l_returnflag",
    "sql_agg_filter": "SELECT event_type, count(*) FILTER (WHERE value > 100) AS big, round(sum(value) FILTER (WHERE value <= 100), 4) AS small FROM events GROUP BY event_type",
    "sql_having": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 5",
    "sql_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "sql_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "sql_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_window_rank": "SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr, CAST(ntile(4) OVER w AS BIGINT) AS q FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)",
    "sql_window_lag": "SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS after, first_value(value) OVER w AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "sql_window_distribution": "SELECT o_orderkey, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey)",
    "sql_window_rows": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS s FROM events",
    "sql_window_range": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS n FROM orders",
    "sql_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "sql_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20",
    "sql_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "sql_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "sql_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "sql_except": "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0",
    "sql_distinct": "SELECT DISTINCT event_type, user_id % 10 AS g FROM events",
    "sql_scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)",
    "sql_in_subquery": "SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "sql_correlated": "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer",
    "sql_cte": "WITH t AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT c_name, round(s, 2) AS s FROM t JOIN customer ON o_custkey = c_custkey WHERE s > 100000",
    "sql_recursive": "WITH RECURSIVE t(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM t WHERE k < 50) SELECT k FROM t",
    "sql_strings": "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, CAST(length(c_name) AS BIGINT) AS n, substr(c_name, 2, 4) AS sub, replace(c_name, '0', 'o') AS rep, concat(c_name, '-', c_mktsegment) AS cat, trim(concat('  ', c_name, ' ')) AS t, split_part(c_name, '#', 2) AS part, regexp_replace(c_name, '[0-9]+', 'N') AS rx FROM customer",
    "sql_math": "SELECT l_orderkey, l_linenumber, abs(-l_quantity) AS a, round(sqrt(l_extendedprice), 6) AS s, CAST(floor(l_extendedprice) AS BIGINT) AS f, CAST(ceil(l_extendedprice) AS BIGINT) AS c, round(ln(l_extendedprice), 6) AS ln, round(power(l_discount, 2), 8) AS p, round(sin(l_quantity), 6) AS sn FROM lineitem",
    "sql_case_null": "SELECT event_id, CASE WHEN value > 100 THEN 'big' WHEN value > 10 THEN 'mid' ELSE 'small' END AS size, coalesce(nullif(event_type, 'error'), 'none') AS kind FROM events",
    "sql_dates": "SELECT event_id, CAST(extract(hour FROM ts) AS BIGINT) AS h, CAST(extract(day FROM ts) AS BIGINT) AS d, CAST(ts AS DATE) AS day, CAST(date_trunc('month', ts) AS DATE) AS month FROM events",
}


def _shared(sql):
    def run(spark, sf_dir):
        session = spark.newSession()
        for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
            session.conf.set(key, spark.conf.get(key))
        for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
            if name in sql:
                session.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        return session.sql(sql)

    return run


for _name, _sql in SHARED.items():
    query(_sql, _name)(_shared(_sql))


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds, len(list(DISTINCT event_type))::INTEGER AS n FROM events GROUP BY user_id")
def sql_arrays(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("kinds")).select("user_id", F.array_join("kinds", ",").alias("kinds"), F.size("kinds").alias("n"))


@query("SELECT vec_id, i::INTEGER AS i, round(embedding[i + 1]::DOUBLE, 6) AS x FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings)")
def sql_unnest(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return rows.withColumn("x", F.round(F.col("x").cast("double"), 6))


@query("SELECT event_id, length(props)::INTEGER AS n, json_valid(props) AS ok FROM events")
def sql_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.length("props").alias("n"), F.get_json_object("props", "$").isNotNull().alias("ok"))


@query("SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    found = rows.groupBy(F.window("t", "6 hours"), "event_type").agg(F.count("*").alias("n"))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL '12 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),"
    " s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"
)
def sessions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts")
    rows = table(spark, sf_dir, "events").select("user_id", "ts")
    rows = rows.withColumn("new", F.coalesce((F.col("ts") > F.lag("ts").over(w) + F.expr("INTERVAL 12 HOURS")).cast("int"), F.lit(1)))
    rows = rows.withColumn("k", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "k").agg(F.min("ts").alias("start"), F.count("*").alias("n")).drop("k")


@query("SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k, json_type(props, '$.k') IS NOT NULL AS has_k FROM events")
def sql_json_fields(spark, sf_dir):
    fields = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").alias("f"))
    return fields.select("event_id", "f.k", F.col("f.k").isNotNull().alias("has_k"))


@query("SELECT user_id, count(DISTINCT event_type) AS kinds, coalesce(count(*) FILTER (event_type = 'click'), 0) AS clicks FROM events GROUP BY user_id")
def sql_maps(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return maps.select("user_id", F.size("m").cast("long").alias("kinds"), F.coalesce(F.try_element_at("m", F.lit("click")), F.lit(0)).cast("long").alias("clicks"))


@query("SELECT event_id, round(value * 1.19 + length(event_type), 6) AS gross FROM events")
def sql_udf(spark, sf_dir):
    """A vectorised user function, registered for SQL in a session of its own."""
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(key, spark.conf.get(key))

    def gross(value: pd.Series, kind: pd.Series) -> pd.Series:
        return value * 1.19 + kind.str.len()

    session.udf.register("gross", F.pandas_udf(gross, "double"))
    table(session, sf_dir, "events").createOrReplaceTempView("events")
    return session.sql("SELECT event_id, round(gross(value, event_type), 6) AS gross FROM events")


@query(
    "WITH s AS (SELECT event_type, time_bucket(INTERVAL '2 hours', ts, TIMESTAMP '1970-01-01') - INTERVAL (2 * k) HOUR AS start FROM events, range(0, 3) t(k))"
    " SELECT start, event_type, count(*) AS n FROM s GROUP BY 1, 2"
)
def sliding_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    found = rows.groupBy(F.window("t", "6 hours", "2 hours"), "event_type").agg(F.count("*").alias("n"))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "SELECT e.event_id, v.event_id AS before_id, v.value AS before_value FROM (SELECT * FROM events WHERE event_type = 'error') e"
    " ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND e.ts >= v.ts"
)
def asof_join_backward(spark, sf_dir):
    """Each error with the last view of its user before it."""
    rows = table(spark, sf_dir, "events")
    views = rows.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("before_id"), F.col("value").alias("before_value"))
    return asof_join(rows.where("event_type = 'error'"), views, ["user_id"], "ts").select("event_id", "before_id", "before_value")


@query(
    "SELECT e.event_id, v.event_id AS next_id FROM (SELECT * FROM events WHERE event_type = 'error') e"
    " ASOF JOIN (SELECT * FROM events WHERE event_type = 'click') v ON e.user_id = v.user_id AND e.ts < v.ts"
)
def asof_join_forward(spark, sf_dir):
    """Each error with the first click of its user after it, if there is one."""
    rows = table(spark, sf_dir, "events")
    clicks = rows.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("next_id"))
    return asof_join(rows.where("event_type = 'error'"), clicks, ["user_id"], "ts", forward=True, exact=False).where("next_id IS NOT NULL").select("event_id", "next_id")
