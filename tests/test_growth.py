"""What steps shuffle and hold at once stays near the size of their input."""

from __future__ import annotations

import itertools
import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import graph, joins, mining, search, vectors
from sparkloom.plans import registry
from tests.conftest import rows

registry.load()


@pytest.fixture(autouse=True)
def checkpoints(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(f"{tmp_path}/checkpoints")


@pytest.fixture
def shuffled(spark):
    """Runs an action without broadcasts of tables: (its result, the rows that its stages shuffled)."""
    sc, store = spark.sparkContext, spark._jsc.sc().statusStore()
    none = spark._jvm.java.util.ArrayList()

    def stages():
        found = store.stageList(none, False, False, sc._gateway.new_array(spark._jvm.double, 0), none)
        return {s.stageId(): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    def run(action):
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        before = set(stages())
        out = action()
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        return out, sum(n for i, n in stages().items() if i not in before)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield run
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_prior_insights_of_a_common_entry(spark, shuffled):
    insights = spark.range(300).select(F.col("id").alias("insight_id"), F.timestamp_seconds(F.col("id") % 100).alias("created_at"), F.array(F.lit(7), 1000 + F.col("id")).alias("entry_ids"))
    sessions = spark.range(300).select(F.col("id").alias("session_id"), F.array(F.lit(7), 1000 + F.col("id")).alias("entry_ids"))
    got, n = shuffled(lambda: rows(joins.prior_insights(insights, sessions, 2).select("session_id", "insight_id", "rank")))
    want = []
    for s in range(300):
        want += [(s, i, r) for r, i in enumerate((299, 199), 1)]
    assert got == sorted(want, key=lambda t: tuple((True, str(x)) for x in t))
    assert n < 10_000  # 90,000 pairs share entry 7


def test_missing_pairs_are_not_shuffled(spark, shuffled):
    left, right = spark.range(300).withColumnRenamed("id", "a"), spark.range(300).withColumnRenamed("id", "b")
    taken = spark.createDataFrame([(a, (a + 10) % 300) for a in range(0, 300, 3)] + [(1, 2), (None, 3), (5, None)], "a long, b long")
    got, n = shuffled(lambda: {(r["a"], r["b"]) for r in joins.missing_pairs(left, right, F.col("a") % 2 == F.col("b") % 2, taken, "a", "b").collect()})
    assert got == {(a, b) for a in range(300) for b in range(300) if a % 2 == b % 2 and not (a % 3 == 0 and b == (a + 10) % 300)}
    assert n < 2000  # 45,000 pairs meet


def test_unsold_parts_shuffle_no_pairs(spark, shuffled, tmp_path):
    spark.range(400).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(400).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(50).select((F.col("id") * 10 + 3).alias("l_partkey"), F.lit(13).cast("long").alias("l_suppkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got, n = shuffled(lambda: registry.QUERIES["unsold_parts"](spark, str(tmp_path)).count())
    assert got == 40 * 400 - 40 and n < 3000  # 16,000 pairs are offered


@pytest.mark.parametrize("sizes", [(256, 16, 256), (4, 2, 2), (9, 1, 1)])
def test_missing_pairs_in_many_units(spark, monkeypatch, sizes):
    for name, n in zip(("SIDE", "UNIT_A", "UNIT_B"), sizes, strict=True):
        monkeypatch.setattr(joins, name, n)
    r = random.Random(5)
    a, b = [r.randrange(90) for _ in range(120)], [r.randrange(70) for _ in range(100)]
    taken = [(r.randrange(90), r.randrange(70)) for _ in range(2000)] + [(4, i) for i in range(70)] + [(i, 7) for i in range(90)]
    left, right = spark.createDataFrame([(x,) for x in [*a, None]], "a int"), spark.createDataFrame([(x,) for x in [*b, None]], "b long")
    sold = spark.createDataFrame([*taken, (None, 3), (5, None)], "a long, b int")
    for on, met in (((F.col("a") % 3, F.col("b") % 3), lambda x, y: x % 3 == y % 3), (F.col("a") < F.col("b"), lambda x, y: x < y)):
        df = joins.missing_pairs(left, right, on, sold, "a", "b")
        assert df.dtypes == [("a", "int"), ("b", "bigint")]
        assert sorted(map(tuple, df.collect())) == sorted((x, y) for x in a for y in b if met(x, y) and (x, y) not in set(taken))
        assert joins.missing_pairs(left.limit(0), right, on, sold, "a", "b").count() == 0


def test_unsold_parts_files_are_small(spark, tmp_path):
    spark.range(5120).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(10_000).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(5120).select(F.col("id").alias("l_partkey"), (F.col("id") + 10).alias("l_suppkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    registry.QUERIES["unsold_parts"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 512 * 10_000 - 5120 and got.distinct().count() == got.count()
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < got.count() // 2  # two bytes a pair with a part's suppliers side by side


def overlap_brute(pairs, min_jaccard, min_shared, max_fanout):
    worn, wearers = defaultdict(set), defaultdict(set)
    for e, t in pairs:
        worn[e].add(t)
        wearers[t].add(e)
    out = []
    for a, b in itertools.combinations(sorted(worn), 2):
        s = worn[a] & worn[b]
        if any(2 <= len(wearers[t]) <= max_fanout for t in s) and len(s) >= min_shared and len(s) / len(worn[a] | worn[b]) >= min_jaccard:
            out.append((a, b, len(s)))
    return out


@pytest.mark.parametrize("width,min_jaccard,min_shared,max_fanout", [(32, 0.3, 2, 6), (3, 0.3, 2, 6), (4, 0.5, 3, 9), (3, 0.2, 1, 5), (5, 0.0, 2, 4), (2, 0.3, 2, 40)])
def test_overlaps_equal_all_pairs(spark, monkeypatch, width, min_jaccard, min_shared, max_fanout):
    monkeypatch.setattr(graph, "TAG_PAIRS", width)
    r = random.Random(width)
    pairs = [(e, int(r.paretovariate(0.6)) % 40) for e in range(60) for _ in range(r.choice((1, 2, 4, 7, 20)))]
    df = spark.createDataFrame(pairs, "entry long, tag long").repartition(3)
    got = sorted((r["a"], r["b"], r["shared"]) for r in graph.tag_overlap_pairs(df, min_jaccard, min_shared, max_fanout).collect())
    assert got and got == overlap_brute(pairs, min_jaccard, min_shared, max_fanout)
    et = df.select(F.col("entry").alias("e"), F.col("tag").alias("t")).distinct()
    touched = mining.touching_pairs(et, et.filter("e < 20"), min_jaccard, min_shared, max_fanout)
    assert sorted((r["a"], r["b"], r["shared"]) for r in touched.collect()) == [p for p in got if p[0] < 20 or p[1] < 20]


def test_entries_that_share_one_tag_are_not_joined(spark, shuffled):
    # 40 entries wear each tag, every two entries share at most one tag: 40 times 780 pairs meet at one tag.
    pairs = spark.range(1600).select(F.expr("id div 40").alias("x"), (F.col("id") % 40).alias("y"), F.col("id").alias("entry"))
    df = pairs.select("entry", F.col("x").alias("tag")).unionByName(pairs.select("entry", (1000 + F.col("y")).alias("tag"))).unionByName(pairs.select("entry", (2000 + F.col("entry")).alias("tag")))
    got, n = shuffled(lambda: graph.tag_overlap_pairs(df).count())
    assert got == 0 and n < 40_000
    et = df.select(F.col("entry").alias("e"), F.col("tag").alias("t"))
    got, n = shuffled(lambda: mining.touching_pairs(et, et.select("e").filter("e < 800")).count())
    assert got == 0 and n < 40_000


def test_a_large_page_is_numbered_where_it_stands(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(mining, "PICKED_ROWS", 2)
    table = mining.PairTable(spark, f"file://{tmp_path}/t")
    et = spark.createDataFrame([(e, e // 2) for e in range(10)] + [(e, 90 + e // 2) for e in range(10)], "e long, t long")
    infos = [table.next_page(et, 4) for _ in range(3)]
    assert [(i["cursor"], i["complete"]) for i in infos] == [(3, False), (7, False), (None, True)]
    assert rows(table.pairs(), "a", "b") == [(0, 1), (2, 3), (4, 5), (6, 7), (8, 9)]


@pytest.mark.parametrize("euclid", [False, True])
def test_scores_of_many_queries_are_held_in_blocks(euclid):
    r = np.random.default_rng(1)
    x = r.integers(-4, 5, (4000, 4)).astype(np.float64)
    q = r.integers(-4, 5, (1500, 4)).astype(np.float64)
    batch = pa.RecordBatch.from_arrays([pa.array(r.permutation(4000)), pa.array(["s"] * 4000), pa.array(x.tolist(), pa.list_(pa.float32()))], ["entry_id", "section_id", "embedding"])
    names = list(range(1500))
    tracemalloc.start()
    hits = [h for b in vectors._best(names, q, batch, 3, euclid) for h in b.to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    ids = batch.column("entry_id").to_numpy()
    scores = vectors.round6(1 / (1 + np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))) if euclid else q @ x.T)
    got = defaultdict(list)
    for h in hits:
        got[h["query_id"]].append((-h["score"], h["entry_id"]))
    for n in names:
        assert sorted(got[n])[:3] == sorted(zip(-scores[n], ids, strict=True))[:3]
    assert most < 100 << 20  # 6,000,000 scores are 48 MB in one table, of which several were held


def test_bm25_shuffles_words_not_products(spark, shuffled, monkeypatch):
    words = [f"w{i}" for i in range(20)]
    docs = spark.createDataFrame([(i, " ".join(words)) for i in range(300)], "id long, text string")
    queries = spark.createDataFrame([(i, " ".join(words[: 10 + i % 10])) for i in range(50)], "query_id long, query string")
    got, n = shuffled(lambda: rows(search.bm25(docs, queries)))
    assert len(got) == 15_000 and n < 15_000  # 15,000 pairs are scored by 10 to 19 words each
    monkeypatch.setattr(search, "SCORED_WORDS", 1)
    key = lambda r: (r[0], r[1], round(r[2], 9))
    assert [key(r) for r in got] == [key(r) for r in rows(search.bm25(docs, queries))]


def test_sets_of_tags_are_counted_where_they_are_made(spark, shuffled):
    r = random.Random(6)
    pairs = [(e, f"t{t:02}") for e in range(200) for t in r.sample(range(20), 18)]
    df = spark.createDataFrame(pairs, "entry int, tag string")
    got, n = shuffled(lambda: graph.frequent_tag_sets(df, 5, k=3).collect())
    assert len(got) == 1140 and sum(x["support"] for x in got) == 200 * 816
    assert n < 40_000  # 30,600 pairs and 163,200 sets of three are worn


@pytest.mark.parametrize("k", [2, 3, 4, 5])
def test_sets_of_tags_in_blocks_and_without_broadcasts(spark, monkeypatch, k):
    monkeypatch.setattr(graph, "PAIR_BLOCK", 3)
    monkeypatch.setattr(graph, "SENT_BYTES", -1)
    r = random.Random(k)
    worn = [(e, int(r.paretovariate(0.5)) % 50) for e in range(50) for _ in range(r.choice((1, 3, 9, 25)))]
    worn += [(100 + e, t) for e in range(5) for t in range(7)] + [(None, 1), (1, None)]
    tags = defaultdict(set)
    for e, t in worn:
        if e is not None and t is not None:
            tags[e].add(t)
    want = defaultdict(int)
    for ts in tags.values():
        for c in itertools.combinations(sorted(ts), k):
            want[c] += 1
    got = {tuple(x)[:k]: x["support"] for x in graph.frequent_tag_sets(spark.createDataFrame(worn, "entry int, tag int"), 5, k=k).collect()}
    assert got == {c: n for c, n in want.items() if n >= 5}


def test_a_citation_meets_reads_until_one_has_it(spark):
    cited = spark.range(400).select((F.col("id") % 2).alias("entry_id"), F.concat(F.lit("word "), F.col("id") % 50).alias("quote"), (F.col("id") % 4).alias("page"))
    reads = spark.range(300).select((F.col("id") % 3).alias("entry_id"), F.concat(F.lit("a Word, "), F.col("id")).alias("text"))
    df = joins.verified_citations(cited, reads)
    want = {(e, f"word {q}", i % 4) for i in range(400) for e, q in [(i % 2, i % 50)] if any(r % 3 == e and str(r).startswith(str(q)) for r in range(300))}
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.count("Aggregate") == 1  # no pairs of a citation and a read are made, so none are made one again
