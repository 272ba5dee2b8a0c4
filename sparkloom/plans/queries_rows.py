"""Queries of aggregates, ordered rows, sessions and streams restated on the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import aggregates, joins, windows
from sparkloom.plans.registry import query
from sparkloom.plans.tables import read, with_checkpoints
from sparkloom.streaming import jobs


@query("session_rollup", "SELECT o_custkey, count(*) AS turns, sum(o_orderkey)::BIGINT AS o_orderkey, sum(o_totalprice::DECIMAL(12,6))::DECIMAL(18,6) AS o_totalprice FROM (SELECT o_custkey, o_orderkey, o_totalprice / 1e6 AS o_totalprice FROM orders) GROUP BY 1")
def session_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").withColumn("o_totalprice", F.col("o_totalprice") / 1e6)
    return aggregates.session_rollup(rows, "o_custkey", ["o_orderkey"], "o_totalprice").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,6)"))


@query("cache_summary", """SELECT coalesce(prefix, 'all') AS prefix, count(*) AS calls, sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS cached_tokens, round(least(sum(c)::DOUBLE / nullif(sum(p), 0), 1.0), 6) AS ratio FROM
(SELECT CASE l_returnflag WHEN 'R' THEN 'preserved' WHEN 'A' THEN 'broken' ELSE 'unknown' END AS prefix, l_quantity::BIGINT * 100 AS p, (l_quantity * 100 * l_discount)::BIGINT AS c FROM lineitem) GROUP BY ROLLUP (prefix)""")
def cache_summary(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    rows = read(spark, d, "lineitem").select(F.when(flag == "R", True).when(flag == "A", False).alias("prefix_preserved"), (F.col("l_quantity").cast("bigint") * 100).alias("prompt_tokens"), F.rint(F.col("l_quantity") * 100 * F.col("l_discount")).cast("bigint").alias("cached_tokens"))
    return aggregates.cache_summary(rows)


@query("slo_status", """SELECT event_type, user_id, count(*) AS n, round(avg(value), 6) AS mean, CASE WHEN count(*) < 10 THEN 'insufficient_data' WHEN round(avg(value), 6) >= 50 THEN 'met' ELSE 'breached' END AS status FROM events GROUP BY 1, 2""")
def slo_status(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return rows.withColumn("status", aggregates.slo_status(F.col("mean"), F.col("n"), 50.0, 10))


@query("rolling_budget", "SELECT event_id, user_id, sum((value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)::BIGINT AS spent FROM events")
def rolling_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").withColumn("cents", F.rint(F.col("value") * 100).cast("bigint"))
    return aggregates.rolling_sum(rows, "user_id", "ts", "cents").select("event_id", "user_id", "spent")


@query("sessions_due", "SELECT user_id, count(*) AS n, max(ts) AS newest FROM events GROUP BY 1 HAVING count(*) >= 50 AND max(ts) <= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR")
def sessions_due(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return aggregates.sessions_due(e, "user_id", "ts", 50, F.lit(e.agg(F.max("ts")).first()[0]) - F.expr("INTERVAL 6 HOURS"))


@query("count_by_status", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def count_by_status(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.count_by(read(spark, d, "orders"), "o_orderstatus")


@query("tag_counts", "SELECT p_partkey AS tag_id, count(l_partkey) AS doc_count FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.tag_counts(read(spark, d, "part").select(F.col("p_partkey").alias("tag_id")), read(spark, d, "lineitem").select(F.col("l_partkey").alias("tag_id")))


@query("eligible_tags", "SELECT l_partkey AS tag, count(DISTINCT l_orderkey) AS fanout FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) BETWEEN 2 AND 30")
def eligible_tags(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.eligible_tags(read(spark, d, "lineitem").select(F.col("l_partkey").alias("tag"), F.col("l_orderkey").alias("entry")), 2, 30)


@query("mentions", "SELECT l_partkey AS entry, count(*) AS mentions, array_to_string(list_sort(list(l_orderkey)), ',') AS notes FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1 HAVING count(*) >= 2")
def mentions(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("note")).agg(F.collect_list("l_partkey").alias("entry_ids"))
    return aggregates.mentions(rows).withColumn("notes", F.array_join("notes", ","))


@query("table_coverage", "SELECT o_orderpriority AS sheet, sum(n)::BIGINT AS total_rows, sum(least(n, 2000))::BIGINT AS indexed_rows, sum(least(n, 2000)) < sum(n) AS partial FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) GROUP BY ROLLUP (o_orderpriority)")
def table_coverage(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.table_coverage(read(spark, d, "orders").withColumnRenamed("o_orderpriority", "sheet"), "sheet", 2000)


@query("stage_totals", "SELECT user_id, event_type AS stage, sum((value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2")
def stage_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select("user_id", F.create_map("event_type", F.rint(F.col("value") * 100).cast("bigint")).alias("stages"))
    return aggregates.stage_totals(rows, "user_id", "stages").select("user_id", F.explode("stages").alias("stage", "cents"))


@query("chart", "SELECT l_returnflag, l_linestatus, count(l_quantity) AS count, sum(l_quantity) AS sum, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median, min(l_quantity) AS min, max(l_quantity) AS max, round(stddev(l_quantity), 6) AS stdev FROM lineitem GROUP BY 1, 2")
def chart(spark: SparkSession, d: str) -> DataFrame:
    with_checkpoints(spark)
    out = aggregates.chart(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")
    return out.withColumns({"mean": F.round("mean", 6), "stdev": F.round("stdev", 6)})


@query("retention", "SELECT min(ts) AS oldest, count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS expired, count(*) AS rows FROM events")
def retention(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.retention(read(spark, d, "events"), "ts", F.lit("2024-01-15").cast("timestamp"))


@query("throughput", """SELECT kind, count(*) FILTER (s = 'pending') AS pending, count(*) FILTER (s = 'running') AS running, count(*) FILTER (s = 'done') AS done, count(*) FILTER (s = 'failed') AS failed,
max(CASE WHEN s = 'pending' THEN epoch(TIMESTAMP '2024-03-01')::BIGINT - floor(epoch(ts))::BIGINT END) AS oldest_pending_s, round(count(*) FILTER (s = 'done') / nullif(count(*) FILTER (s IN ('done', 'failed')), 0), 6) AS success_rate,
round(avg(CASE WHEN s = 'done' THEN floor(value)::BIGINT END), 6) AS mean_s FROM (SELECT (user_id // 10) AS kind, ts, value, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'pending' WHEN 'view' THEN 'done' ELSE 'running' END AS s FROM events) GROUP BY ROLLUP (kind)""")
def throughput(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    status = F.when(t == "error", "failed").when(t.isin("purchase", "view"), "done").when(t == "click", "pending").otherwise("running")
    start = F.date_trunc("second", "ts")
    rows = read(spark, d, "events").select(F.floor(F.col("user_id") / 10).alias("kind"), status.alias("status"), F.col("ts").alias("created_at"), start.alias("started_at"), F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")) + F.floor("value")).alias("finished_at"))
    return aggregates.throughput(rows, F.lit("2024-03-01").cast("timestamp"))


@query("top_per_group", "SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3")
def top_per_group(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.top_per_group(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query("latest_per_key", "SELECT user_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return joins.latest_per_key(read(spark, d, "events"), "user_id", "ts", "event_type", "event_id")


@query("first_message", "SELECT conv_id AS session_id, arg_min(text, turn) AS user_message FROM conversations GROUP BY 1")
def first_message(spark: SparkSession, d: str) -> DataFrame:
    return joins.first_message(read(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_index"), F.col("text").alias("user_message")))


@query("event_cursors", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cursor FROM events")
def event_cursors(spark: SparkSession, d: str) -> DataFrame:
    return windows.cursors(read(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id").drop("ts")


@query("within_budget", "SELECT conv_id, turn, running FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM conversations) WHERE running <= 800")
def within_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("cost"))
    return windows.within_budget(rows, "conv_id", "turn", "cost", 800).drop("cost")


@query("size_cap", """SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS n, sum(length(text)) OVER (PARTITION BY conv_id) AS s FROM conversations)
WHERE r <= CASE WHEN s <= 900 THEN n ELSE greatest(1, floor(n * 900 / s)) END""")
def size_cap(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("chars"))
    return windows.size_cap(rows, "conv_id", "turn", "chars", 900).drop("chars")


@query("first_lines", "SELECT file, r AS row, CASE WHEN r <= 20 THEN 'L' || n || ': ' || text ELSE '... ' || (c - 20) || ' more lines' END AS shown FROM (SELECT user_id AS file, event_id AS n, event_type AS text, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS c FROM events) WHERE r <= 21")
def first_lines(spark: SparkSession, d: str) -> DataFrame:
    return windows.first_lines(read(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("n"), F.col("event_type").alias("text")), 20)


@query("unique_names", "SELECT p_partkey AS id, p_brand AS folder, p_name || '.txt' AS name, CASE WHEN r = 1 THEN p_name || '.txt' ELSE p_name || ' (' || (r - 1) || ').txt' END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS r FROM part)")
def unique_names(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("folder"), F.concat("p_name", F.lit(".txt")).alias("name"))
    return windows.unique_names(rows)


@query("session_notes", """SELECT user_id AS session_id, array_to_string(list(event_id ORDER BY ts, event_id), ',') AS notes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= 60 GROUP BY 1""")
def session_notes(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("ts").alias("created_at"), F.col("event_id").alias("note_id"), F.array("event_type").alias("entry_ids"))
    return windows.session_notes(rows).select("session_id", F.array_join("notes", ",").alias("notes"))


@query("hour_buckets", "SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hour_buckets(spark: SparkSession, d: str) -> DataFrame:
    return jobs.buckets(read(spark, d, "events"), "ts", "1 hour", "event_type")


@query("idle_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 24 HOUR THEN 0 ELSE 1 END AS s FROM events),
h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS begun, max(ts) + INTERVAL 24 HOUR AS due, user_id, count(*) AS n FROM h GROUP BY user_id, k HAVING count(*) >= 3""")
def idle_sessions(spark: SparkSession, d: str) -> DataFrame:
    return jobs.idle_sessions(read(spark, d, "events"), "ts", "user_id")


@query("slots", "SELECT floor(epoch(ts) / 600)::BIGINT AS slot, count(*) AS n FROM events GROUP BY 1")
def slots(spark: SparkSession, d: str) -> DataFrame:
    return jobs.slots(read(spark, d, "events"), "ts")


@query("sliding_budget", "SELECT w + INTERVAL 24 HOUR AS until, event_type, sum((value * 100)::BIGINT)::BIGINT AS spent FROM (SELECT *, unnest(generate_series(time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 18 HOUR, time_bucket(INTERVAL 6 HOUR, ts), INTERVAL 6 HOUR)) AS w FROM events) GROUP BY 1, 2")
def sliding_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").withColumn("cents", F.rint(F.col("value") * 100).cast("bigint"))
    return jobs.rolling_budget(rows, "ts", "cents", "event_type", slide="6 hours")
