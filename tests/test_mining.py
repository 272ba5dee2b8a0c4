"""The mined pair table against mining all at once."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import graph, mining
from tests.conftest import rows


def tags(spark, pairs):
    return spark.createDataFrame(sorted(pairs), "e long, t long")


def whole(et):
    return rows(graph.tag_overlap_pairs(et, entry="e", tag="t", max_fanout=6))


def world(seed, n=40):
    r = random.Random(seed)
    return {(e, int(r.paretovariate(0.7)) % 25) for e in range(n) for _ in range(r.randint(1, 6))}


def test_pages_then_changes_equal_the_whole(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    table = mining.PairTable(spark, f"file://{tmp_path}/t", max_fanout=6)
    now = world(1)
    with pytest.raises(ValueError):
        table.pairs()
    infos = [table.next_page(tags(spark, now), 16) for _ in range(3)]
    assert [(i["version"], i["cursor"], i["complete"]) for i in infos] == [(1, 15, False), (2, 31, False), (3, None, True)]
    assert rows(table.pairs()) == whole(tags(spark, now))
    # Changes: entries that come, go and are tagged anew; tags that pass both limits of their fan-out.
    after = {p for p in now if p[0] not in (3, 20)} | {(50, 1), (50, 2), (51, 1), (51, 2), (51, 99), (7, 99), (8, 99)} | {(e, 98) for e in range(7)} - {(1, 98)}
    changes = spark.createDataFrame([(e, t, True) for e, t in after - now] + [(e, t, False) for e, t in now - after], "e long, t long, added boolean")
    table.apply(tags(spark, after), changes)
    assert rows(table.pairs()) == whole(tags(spark, after))
    table.compact()
    assert len(table.commits()) == 1 and rows(table.pairs()) == whole(tags(spark, after))
    last = after | {(5, 98), (3, 1), (3, 2)}
    table.apply(tags(spark, last), spark.createDataFrame([(e, t, True) for e, t in last - after], "e long, t long, added boolean"))
    assert rows(table.pairs()) == whole(tags(spark, last))
    assert table.next_page(tags(spark, last), 1000)["complete"] and rows(table.pairs()) == whole(tags(spark, last))


def test_change_amid_a_cycle(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    table = mining.PairTable(spark, f"file://{tmp_path}/t", max_fanout=6)
    now, after = world(2), world(2) ^ {(1, 0), (39, 0), (39, 1), (2, 7), (30, 7)}
    table.next_page(tags(spark, now), 20)
    changes = spark.createDataFrame([(e, t, (e, t) in after) for e, t in now ^ after], "e long, t long, added boolean")
    table.apply(tags(spark, after), changes)
    assert not table.commits()[-1]["complete"]
    table.next_page(tags(spark, after), 40)
    assert rows(table.pairs()) == whole(tags(spark, after))


def test_a_step_that_stops_or_comes_late_changes_nothing(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    path = f"file://{tmp_path}/t"
    table, now = mining.PairTable(spark, path, max_fanout=6), world(3)
    table.next_page(tags(spark, now), 100)
    before, old = table.commits(), rows(table.pairs())
    broken = tags(spark, now).select("e", F.raise_error(F.lit("lost")).cast("long").alias("t"))
    with pytest.raises(Exception, match="lost"):
        table.next_page(broken, 100)
    assert table.commits() == before and rows(table.pairs()) == old
    with pytest.raises(Exception, match="exist"):  # another step took this version meanwhile
        table._commit([], table.pairs().limit(0), tags(spark, now).select("e"), None, True)
    assert table.commits() == before and rows(table.pairs()) == old
