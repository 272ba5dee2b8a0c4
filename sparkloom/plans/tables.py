"""The given tables, and the roles they play in the queries."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _own_folder(spark: SparkSession) -> str:
    """A folder of this machine, which only sessions on one machine may use."""
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return "file://" + tempfile.mkdtemp(prefix="sparkloom-")


def with_checkpoints(spark: SparkSession) -> None:
    """checkpoint() needs a folder; the cluster names one in spark.checkpoint.dir, tests on one machine get their own."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_own_folder(spark))


def scratch(spark: SparkSession) -> str:
    """A new folder for files in spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or _own_folder(spark)
    return f"{base}/sparkloom/{uuid.uuid4().hex}"


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines (file: the user, n: place in the file by time)."""
    e = read(spark, sf_dir, "events")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" "), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO"), F.lit(" "), "event_type", F.lit(" "), "props")
    return e.select(F.col("user_id").alias("file"), F.col("event_id").alias("n"), line.alias("text"))


LINES_SQL = """lines AS (SELECT user_id AS file, event_id AS n, strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' ' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || ' ' || event_type || ' ' || props AS text FROM events)"""


def part_pairs(spark: SparkSession, sf_dir: str, least: int = 2) -> DataFrame:
    """(a, b, n): parts that stand together in so many orders."""
    from sparkloom.operators.graph import cooccurrence_pairs

    orders = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("entry_ids"))
    return cooccurrence_pairs(orders, least=least)


PAIRS_SQL = """ol AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
pairs AS (SELECT x.p AS a, y.p AS b, count(*) AS n FROM ol x JOIN ol y ON x.o = y.o AND x.p < y.p GROUP BY 1, 2 HAVING count(*) >= {least})"""


def streamed(spark: SparkSession, df: DataFrame, ts: str, start: Callable[[DataFrame], StreamingQuery], parts: int = 3) -> None:
    """Writes df as files, a part of its time span after the other, and runs the stream that start() begins once for
    each part: start() gives it one checkpoint, so that each run but the first is a restart."""
    folder = scratch(spark)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    first, last = df.agg(F.min(at), F.max(at)).first()
    part = F.floor((at - first) * parts / (last - first + 1))
    for i in range(parts):
        df.filter(part == i).write.mode("append").parquet(folder)
        start(spark.readStream.schema(df.schema).parquet(folder)).awaitTermination()
