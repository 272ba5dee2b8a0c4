"""Queries of the streaming jobs: tables that arrive as files in parts, with a restart between the parts."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.plans.registry import query
from sparkloom.plans.tables import PAIRS_SQL, read, scratch, streamed, with_checkpoints
from sparkloom.streaming import jobs


def _to_files(out: str, checkpoint: str):
    return lambda rows: rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def _events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_cooldown", """WITH RECURSIVE e AS (SELECT user_id, event_type, ts FROM events), r AS (SELECT user_id, event_type, min(ts) AS ts FROM e GROUP BY 1, 2
UNION ALL SELECT r.user_id, r.event_type, (SELECT min(e.ts) FROM e WHERE e.user_id = r.user_id AND e.event_type = r.event_type AND e.ts >= r.ts + INTERVAL 1 DAY) FROM r WHERE r.ts IS NOT NULL)
SELECT user_id, event_type, epoch_us(ts) AS at FROM r WHERE ts IS NOT NULL""")
def stream_cooldown(spark: SparkSession, d: str) -> DataFrame:
    """Of each user's events of a type one a day at most."""
    out, checkpoint = scratch(spark), scratch(spark)
    save = _to_files(out, checkpoint)
    rows = _events(spark, d).select("user_id", "event_type", "ts")
    streamed(spark, rows, "ts", lambda stream: save(jobs.cooldown(stream, ["user_id", "event_type"], "ts")))
    return spark.read.parquet(out).select("user_id", "event_type", F.unix_micros("ts").alias("at"))


@query("stream_cursors", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cursor FROM events QUALIFY cursor > user_id % 7 AND cursor <= user_id % 7 + 20")
def stream_cursors(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events numbered as they arrive; then read on from a cursor."""
    out, checkpoint = scratch(spark), scratch(spark)
    save = _to_files(out, checkpoint)
    rows = _events(spark, d).select("user_id", "event_id", "ts")
    streamed(spark, rows, "ts", lambda stream: save(jobs.sequence(stream, "user_id", "ts", "event_id")))
    after = rows.select("user_id").distinct().withColumn("cursor", F.col("user_id") % 7).filter("cursor > 0")
    return jobs.replay(spark.read.parquet(out), "user_id", after, 20).select("user_id", "event_id", "cursor")


@query("stream_ingest", "SELECT user_id, event_type, 1::BIGINT AS deliveries FROM events GROUP BY 1, 2")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Each content once, though a run stops after its sink has written and before its hashes are."""
    out, known, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    rows = _events(spark, d).withColumn("sha256", F.sha2(F.concat_ws("|", "user_id", "event_type"), 256)).select("user_id", "event_type", "ts", "sha256")
    write = jobs.write_batches(out, checkpoint)
    stopped: list[int] = []

    def sink(df: DataFrame, number: int) -> None:
        write(df, number)
        if number == 1 and not stopped:
            stopped.append(number)
            raise RuntimeError("stopped after the sink")

    def start(stream: DataFrame):
        run = jobs.ingest_new(stream, known, checkpoint, sink).start()
        try:
            run.awaitTermination()
        except StreamingQueryException:
            run = jobs.ingest_new(stream, known, checkpoint, sink).start()
        return run

    streamed(spark, rows, "ts", start)
    return spark.read.parquet(out).groupBy("user_id", "event_type").agg(F.count("*").alias("deliveries"))


@query("stream_pairs", f"WITH {PAIRS_SQL.format(least=2)} SELECT a, b, n FROM pairs")
def stream_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Parts that stand together in orders, counted as the orders arrive."""
    with_checkpoints(spark)
    path, checkpoint = scratch(spark), scratch(spark)
    parts = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("entry_ids"), F.to_date(F.min("l_shipdate")).alias("day"))
    streamed(spark, parts.select("entry_ids", "day"), "day", lambda stream: jobs.count_pairs(stream, "entry_ids", path, checkpoint, "day").start())
    return jobs.pair_counts(spark, path)


@query("stream_buckets", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, event_type, count(*) AS n FROM events
WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 1 HOUR GROUP BY 1, 2""")
def stream_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Hours that the watermark has passed: final counts, each given once."""
    out, checkpoint = scratch(spark), scratch(spark)
    save = _to_files(out, checkpoint)
    streamed(spark, _events(spark, d).select("event_type", "ts"), "ts", lambda stream: save(jobs.buckets(stream, "ts", "1 hour", "event_type")))
    return spark.read.parquet(out).select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "event_type", "n")
