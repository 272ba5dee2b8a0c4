"""Structured Streaming forms of the incremental jobs. Late rows beyond the watermark of one hour are dropped."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

LATE = "1 hour"
GROUPS = 1024  # of keys that share a state
JSON_NAMES = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _steps(path: str, checkpoint: str, batch: int) -> str:
    """The folder of a batch below path. A batch that runs again has its number again, so that it overwrites what it
    wrote; streams with other checkpoints have folders of their own."""
    return f"{path}/run=r{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}/batch={batch}"


def _before(spark: SparkSession, path: str, checkpoint: str, batch: int) -> DataFrame | None:
    """All that batches before this one wrote below path; None before the first."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    own = _steps("", checkpoint, 0).split("/")[1].removeprefix("run=")
    return rows.filter((F.col("run") != own) | (F.col("batch") < batch))


def write_batches(path: str, checkpoint: str) -> Callable[[DataFrame, int], None]:
    """A sink for ingest_new() that writes each batch once, however often it runs; read it as Parquet."""
    return lambda df, batch: df.write.mode("overwrite").parquet(_steps(path, checkpoint, batch))


def ingest_new(source: DataFrame, known_path: str, checkpoint: str, sink: Callable[[DataFrame, int], None], key: str = "sha256"):
    """K1: each file content of the stream once. A batch is anti-joined with the hashes that batches before it wrote,
    given to sink(rows, batch number), and its hashes are written. When it stops in between it runs again with the
    same number and the same rows of the table of hashes, so a sink that writes by number delivers once."""

    def batch(df: DataFrame, number: int) -> None:
        known = _before(df.sparkSession, known_path, checkpoint, number)
        fresh = df.dropDuplicates([key])
        fresh = (fresh if known is None else fresh.join(known.select(key), key, "left_anti")).persist()
        sink(fresh, number)
        fresh.select(key).write.mode("overwrite").parquet(_steps(known_path, checkpoint, number))
        fresh.unpersist()

    return source.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch)


def buckets(events: DataFrame, ts: str, width: str, *keys: str) -> DataFrame:
    """K2: counts by tumbling window and keys."""
    w = events.withWatermark(ts, LATE).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("bucket"), *keys, "n")


def rolling_budget(events: DataFrame, ts: str, value: str, *keys: str, width: str = "24 hours", slide: str = "10 minutes") -> DataFrame:
    """K3: sums over a trailing window."""
    w = events.withWatermark(ts, LATE).groupBy(F.window(ts, width, slide), *keys).agg(F.sum(value).alias("spent"))
    return w.select(F.col("window.end").alias("until"), *keys, "spent")


def idle_sessions(events: DataFrame, ts: str, key: str, gap: str = "24 hours", least: int = 3) -> DataFrame:
    """K4: sessions that a gap ended, of `least` events or more."""
    w = events.withWatermark(ts, LATE).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return w.filter(F.col("n") >= least).select(F.col("session_window.start").alias("begun"), F.col("session_window.end").alias("due"), key, "n")


def slots(events: DataFrame, ts: str, width: str = "10 minutes") -> DataFrame:
    """K5: each slot that has an event, once."""
    return events.withWatermark(ts, LATE).groupBy(F.window(ts, width)).agg(F.count("*").alias("n")).select((F.unix_seconds(F.col("window.start").cast("timestamp")) / 600).cast("long").alias("slot"), "n")


def dedup_active(events: DataFrame, ts: str, key: str = "dedup_key") -> DataFrame:
    """K6: the first row of each key within the watermark."""
    return events.withWatermark(ts, LATE).dropDuplicatesWithinWatermark([key])


def _exact(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with a mark for each long column and 0 for its nulls, and those columns: a null makes doubles of longs in pandas."""
    longs = [f.name for f in df.schema if isinstance(f.dataType, LongType)]
    marks = {f"_no_{c}": F.isnull(c) for c in longs}
    return df.withColumns(marks).withColumns({c: F.coalesce(c, F.lit(0)) for c in longs}), longs


def _whole(df: DataFrame, longs: list[str]) -> DataFrame:
    """What _exact() was given, and columns added since."""
    return df.withColumns({c: F.when(~F.col(f"_no_{c}"), F.col(c)) for c in longs}).drop(*[f"_no_{c}" for c in longs])


class Numbers:
    """A long for each key of a group of keys: two arrays that are read once and written once a batch, as each call of
    a state goes to the JVM and back."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.state = handle.getValueState("numbers", "names array<string>, numbers array<bigint>")

    def read(self) -> dict[str, int]:
        return dict(zip(*self.state.get(), strict=True)) if self.state.exists() else {}

    def write(self, numbers: dict[str, int]) -> None:
        if numbers:
            self.state.update((list(numbers), list(numbers.values())))
        else:
            self.state.clear()


class Cooldown(StatefulProcessor):
    """Lets a key's row pass when the last that passed is `seconds` ago. What passed is forgotten by a timer once the
    watermark has come so far that any later row passes, so the state holds keys that are cooling down only. A group
    has one timer, for the first of its keys that is due."""

    def __init__(self, seconds: int, columns: list[str], out: list[str]):
        self.wait, self.columns, self.out = 1_000_000 * seconds, columns, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = Numbers(handle)

    def _keep(self, last: dict[str, int], timerValues) -> None:
        """Writes what is still cooling down and sets the timer to its first end, in milliseconds after it or on it."""
        mark = timerValues.getCurrentWatermarkInMs()
        last = {k: at for k, at in last.items() if -(-(at + self.wait) // 1000) > mark}
        self.last.write(last)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last:
            self.handle.registerTimer(-(-(min(last.values()) + self.wait) // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat([f.set_axis(self.columns, axis=1) for f in rows], ignore_index=True)  # a computed column comes without its name
        frame = frame.sort_values(["_name", "_us"], kind="stable", ignore_index=True)
        last, passed, times = self.last.read(), [], frame["_us"].tolist()
        starts = (~frame["_name"].duplicated()).to_numpy().nonzero()[0].tolist()
        for name, i, end in zip(frame["_name"].iloc[starts].tolist(), starts, [*starts[1:], len(times)], strict=True):
            if name in last:
                i = bisect_left(times, last[name] + self.wait, i, end)
            while i < end:
                passed.append(i)
                last[name] = times[i]
                i = bisect_left(times, times[i] + self.wait, i + 1, end)
        self._keep(last, timerValues)
        yield frame.iloc[passed][self.out]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(self.last.read(), timerValues)
        yield from ()

    def close(self) -> None:
        pass


class Sequence(StatefulProcessor):
    """Numbers a key's rows on from the last number given, in a batch by `order`."""

    def __init__(self, order: list[str], columns: list[str], out: list[str]):
        self.order, self.columns, self.out = order, columns, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.given = Numbers(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat([f.set_axis(self.columns, axis=1) for f in rows], ignore_index=True)
        frame = frame.sort_values(self.order, kind="stable", ignore_index=True)
        given, by_name = self.given.read(), frame.groupby("_name", sort=False)
        before = frame["_name"].map(given).fillna(0).astype("int64") if given else 0
        frame["cursor"] = before + by_name.cumcount() + 1
        self.given.write(given | by_name["cursor"].max().to_dict())
        yield frame[self.out]

    def close(self) -> None:
        pass


def _with_state(events: DataFrame, keys: list[str], processor: Callable[[list[str]], StatefulProcessor], schema: StructType, mode: str, groups: int) -> DataFrame:
    """Such state needs the RocksDB store, which is set for the session. Keys are dealt into groups by their hash and
    named by their JSON form; processor() gets the columns that it meets."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keys = keys + [f"_no_{k}" for k in keys if f"_no_{k}" in events.columns]
    named = events.withColumns({"_name": F.to_json(F.struct(*keys), JSON_NAMES), "_group": F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int")})
    return named.groupBy("_group").transformWithStateInPandas(processor(named.columns), outputStructType=schema, outputMode="append", timeMode=mode)


def cooldown(events: DataFrame, key: str | list[str], ts: str, seconds: int = 86400, groups: int = GROUPS) -> DataFrame:
    """K7: per key (a kind and an object, say) at most one row each `seconds`, by event time; rows that come after the
    watermark are dropped, and rows without a time. A group's rows of one batch are one task's: bound batches with
    maxBytesPerTrigger. `groups` stays what it is as long as a checkpoint is used."""
    keys = [key] if isinstance(key, str) else key
    marked, longs = _exact(events)
    timed = marked.filter(F.col(ts).isNotNull()).withWatermark(ts, LATE).withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    return _whole(_with_state(timed, keys, lambda columns: Cooldown(seconds, columns, marked.columns), marked.schema, "EventTime", groups), longs).select(events.columns)


def sequence(events: DataFrame, key: str, *order: str, groups: int = GROUPS) -> DataFrame:
    """K8: events with a cursor, from 1 on in each key, which goes on across batches and restarts. Batches must come in
    order; in a batch `order` decides, nulls last. The state has one number a key and is kept: a key never begins anew.
    `groups` stays what it is as long as a checkpoint is used."""
    marked, longs = _exact(events)
    by = [x for c in order for x in ([f"_no_{c}", c] if c in longs else [c])]
    schema = StructType([*marked.schema, StructField("cursor", LongType())])
    return _whole(_with_state(marked, [key], lambda columns: Sequence(by, columns, schema.names), schema, "None", groups), longs).select(*events.columns, "cursor")


def replay(events: DataFrame, key: str, after: DataFrame | None = None, limit: int = 1000) -> DataFrame:
    """K8: per key the next `limit` events after the cursor in after (key, cursor), in order; from the first where it
    has none. events: with the cursor of sequence()."""
    seen = F.lit(0)
    if after is not None:
        events = events.join(after.select(key, F.col("cursor").alias("_seen")), key, "left")
        seen = F.coalesce("_seen", F.lit(0))
    return events.filter((F.col("cursor") > seen) & (F.col("cursor") <= seen + limit)).drop("_seen")


def count_pairs(rows: DataFrame, ids: str, path: str, checkpoint: str, day: str | None = None):
    """K9: each batch's counts of pairs, by day if there is such a column, written by the batch's number; see
    pair_counts(). No state is kept, and a batch that runs again counts once."""
    from sparkloom.operators.graph import dealt_pairs

    def batch(df: DataFrame, number: int) -> None:
        by = [day] if day else []
        dealt_pairs(df, ids, keep=by).groupBy(*by, "a", "b").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(_steps(path, checkpoint, number))

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch)


def pair_counts(spark: SparkSession, path: str, least: int = 2, since=None, day: str = "day") -> DataFrame:
    """K9: (a, b, n) of all batches, or of those days from `since` on."""
    rows = spark.read.parquet(path)
    rows = rows if since is None else rows.filter(F.col(day) >= since)
    return rows.groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def run_once(stream: DataFrame, checkpoint: str, name: str, mode: str = "append") -> DataFrame:
    """All there is now of a stream, as a table in memory: for tests."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
