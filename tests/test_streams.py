"""Streams with state: the same rows as plain versions, over many keys and restarts."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.streaming import jobs

DAY = 86_400_000_000


@pytest.fixture
def stream(spark, tmp_path):
    """Runs make(stream) over parts of rows, each part a batch of its own run, and gives what it wrote."""

    def run(parts, schema, make):
        for part in parts:
            df = spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros("us")).drop("us")
            df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
            q = make(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
            q.awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out"), q.lastProgress

    return run


def cooled(rows, wait=DAY):
    last, out = {}, []
    for k, kind, us in sorted((r for r in rows if r[2] is not None), key=lambda r: r[2]):
        if (k, kind) not in last or us - last[k, kind] >= wait:
            last[k, kind] = us
            out.append((k, kind, us))
    return sorted(out, key=str)


def test_cooldown_of_keys_that_share_a_state(stream):
    r = random.Random(2)
    keys = [(k, kind) for k in (None, 0, 1, 2**60 + 1, 2**60 + 2) for kind in (None, "", "a", "b")]
    parts = [[(*r.choice(keys), (3 * part + r.random() * 3) * DAY // 1) for _ in range(150)] for part in range(3)]
    parts = [[(k, kind, int(us)) for k, kind, us in part] for part in parts]
    parts[0] += [(1, "z", 500), (1, "z", 499 + DAY), (1, "a", None)]  # a day less a microsecond, and no time
    got, progress = stream(parts, "k long, kind string, us long", lambda s: jobs.cooldown(s, ["k", "kind"], "ts", groups=3))
    assert sorted(((x.k, x.kind, x.us) for x in got.select("k", "kind", F.unix_micros("ts").alias("us")).collect()), key=str) == cooled([x for p in parts for x in p])
    assert progress["stateOperators"][0]["numRowsTotal"] < 20  # states and timers of 3 groups, not of 21 keys


def test_cooldown_forgets(stream):
    parts = [[(k, "a", 1 + k) for k in range(40)], [(99, "a", 9 * DAY)], [(98, "a", 10 * DAY)]]
    got, progress = stream(parts, "k long, kind string, us long", lambda s: jobs.cooldown(s, ["k", "kind"], "ts", groups=7))
    assert got.count() == 42
    assert progress["stateOperators"][0]["numRowsTotal"] <= 8  # two groups that are cooling down, with their timers


def test_sequence_of_keys_that_share_a_state(stream):
    r = random.Random(3)
    keys = (None, 0, 1, 2**60 + 1, 2**60 + 2)
    parts = [[(r.choice(keys), r.choice((None, 2**60 + i)), 100 * part + i // 3) for i in range(90)] for part in range(3)]
    got, progress = stream(parts, "k long, id long, us long", lambda s: jobs.sequence(s, "k", "ts", "id", groups=2))
    seen, want = defaultdict(int), []
    for part in parts:
        for k, i, us in sorted(part, key=lambda x: (x[2], x[1] is None, x[1] or 0)):
            seen[k] += 1
            want.append((k, i, us, seen[k]))
    rows = [(x.k, x.id, x.us, x.cursor) for x in got.select("k", "id", F.unix_micros("ts").alias("us"), "cursor").collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert progress["stateOperators"][0]["numRowsTotal"] == 2  # one state a group, not a key
