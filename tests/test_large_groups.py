"""Operators whose groups may be large: the same rows as plain versions, on many small blocks."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import graph, windows
from tests.conftest import rows


@pytest.fixture(autouse=True)
def checkpoints(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))


def test_row_numbers(spark):
    r = random.Random(1)
    pairs = [(r.choice(("a", "b", None)), i) for i in range(500)]
    df = spark.createDataFrame(pairs, "k string, n int").repartition(7)
    got = {(x.k, x.n): x.row for x in windows.row_numbers(df, ["k"], ["n"]).collect()}
    assert got == {(k, n): sum(1 for a, b in pairs if a == k and b <= n) for k, n in pairs}


@pytest.mark.parametrize("context,block", [(2, 3), (0, 1), (5, 4), (3, 4096)])
def test_grep_context_at_block_borders(spark, context, block):
    r = random.Random(context)
    files = {f: [r.choice(("disk full disk", "ok", "Disk", "", "server")) for _ in range(n)] for f, n in (("x", 60), ("y", 1), ("z", 17))}
    lines = spark.createDataFrame([(f, 10 * i, t) for f, ls in files.items() for i, t in enumerate(ls)], "file string, n long, text string").repartition(5)
    want = []
    for f, ls in files.items():
        hits = [(i, p) for i, t in enumerate(ls) for p in range(t.lower().count("disk"))]
        for rank, (i, p) in enumerate(hits, 1):
            want.append((f, 10 * i, p, "\n".join(ls[max(0, i - context) : i + context + 1]), len(hits), rank))
    got = windows.grep_context(lines, "disk", context, block=block)
    assert rows(got, "file", "n", "pos", "context", "total", "rank") == sorted(want, key=lambda t: tuple((True, str(x)) for x in t))
    assert rows(windows.grep_context(lines, "disk", context, max_rows=2, offset=1, block=block).filter("file = 'x'"), "rank") == [(2,), (3,)]


def test_chunks(spark):
    r = random.Random(2)
    texts = [None, "", "\n", "a\nb\n", "x" * 50, "\n\n\n\n", "a\r\nb\x0bc"] + ["\n".join("y" * r.randint(0, 12) for _ in range(r.randint(1, 40))) for _ in range(40)]

    def plain(text, most):
        out, first, cost, lines = [], 0, 0, (text or "").splitlines() or [""]
        for i, line in enumerate(lines):
            if i > first and cost + len(line) + 1 > most:
                out.append((first, i))
                first, cost = i, 0
            cost += len(line) + 1
        return [(k, a + 1, b, "\n".join(lines[a:b])) for k, (a, b) in enumerate([*out, (first, len(lines))])]

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").selectExpr("*", "1 AS id", "2 AS chunk")
    assert rows(windows.chunk_lines(df, 15)) == sorted(((i, *c) for i, t in enumerate(texts) for c in plain(t, 15)), key=lambda t: tuple((True, str(x)) for x in t))
    assert windows.chunk_lines(df.limit(0), 15).isEmpty()
    assert len(windows.line_chunks("ab\n" * 300_000, 300)) == 3000


def test_sections(spark):
    r = random.Random(3)
    docs = [(i, "\n".join(r.choice(("#", "##", "### ", "######", "text", "", "   # in", "    # code", "#no")) + f" t{k} #" for k in range(r.randint(0, 60)))) for i in range(20)] + [(3, "# again"), (99, None)]
    import re

    want = []
    for i, text in docs:
        lines = (text or "").split("\n") if text is not None else []
        heads = [(n, len(m[1]), m[2]) for n, line in enumerate(lines, 1) if (m := re.match(windows.HEADING, line))]
        want += [(i, n, level, title, next((a - 1 for a, b, _ in heads if a > n and b <= level), len(lines))) for n, level, title in heads]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    assert rows(windows.sections_from_headings(df)) == sorted(want, key=lambda t: tuple((True, str(x)) for x in t))


def test_many_headings_in_one_document(spark):
    text = "\n".join("#" * (1 + i % 6) + f" h{i}" for i in range(100_000))
    got = windows.sections_from_headings(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    assert got.agg(F.count("*"), F.sum("line_end")).first()[0] == 100_000
    assert got.filter("line = 1").first().line_end == 6 and got.filter("line = 6").first().line_end == 6


def plain_sets(pairs, least, k):
    by = {}
    for e, t in pairs:
        by.setdefault(e, set()).add(t)
    n = Counter(c for ts in by.values() for c in itertools.combinations(sorted(ts), k))
    return sorted(((*c, x) for c, x in n.items() if x >= least), key=lambda t: tuple((True, str(x)) for x in t))


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5])
def test_frequent_sets(spark, k):
    r = random.Random(4)
    pairs = [(e, f"t{int(r.paretovariate(0.8)) % 12}") for e in range(60) for _ in range(7)]
    df = spark.createDataFrame(pairs, "entry int, tag string")
    assert rows(graph.frequent_tag_sets(df, 5, k=k)) == plain_sets(pairs, 5, k)
    assert rows(graph.frequent_tag_sets(df, 1000, k=k)) == []


def test_pairs_of_wide_arrays(spark, monkeypatch):
    r = random.Random(5)
    arrays = [[r.randrange(40) for _ in range(r.randint(0, 30))] for _ in range(30)] + [[None, 1, 1], None]
    df = spark.createDataFrame([(a,) for a in arrays], "entry_ids array<int>")
    n = Counter(p for a in arrays for p in itertools.combinations(sorted({x for x in a or [] if x is not None}), 2))
    for block in (128, 4, 7):
        monkeypatch.setattr(graph, "PAIR_BLOCK", block)
        for least in (1, 2, 3):
            assert rows(graph.cooccurrence_pairs(df, least=least)) == sorted(((a, b, c) for (a, b), c in n.items() if c >= least), key=lambda t: tuple((True, str(x)) for x in t))


def test_an_array_of_100000_ids(spark):
    wide = spark.range(1).select(F.sequence(F.lit(0), F.lit(99_999)).alias("entry_ids"))
    few = spark.createDataFrame([(list(range(0, 100_000, 500)),), ([7, 500],)], "entry_ids array<int>")
    got = graph.cooccurrence_pairs(wide.unionByName(few))
    assert got.count() == 200 * 199 // 2 + 1 and got.filter("a = 0 AND b = 500").first().n == 2


def test_pairs_of_the_last_days(spark):
    df = spark.createDataFrame([([1, 2], "2024-01-01"), ([1, 2], "2024-02-20"), ([1, 2], "2024-02-25"), ([1, 3], "2024-02-25")], "entry_ids array<int>, at string").withColumn("at", F.col("at").cast("timestamp"))
    now = F.lit("2024-03-01").cast("timestamp")
    assert rows(graph.cooccurrence_pairs(df, at="at", now=now)) == [(1, 2, 2)]
    assert rows(graph.cooccurrence_pairs(df, at="at", now=now, days=8)) == []


def plain_diff(disk, entries):
    """(path, entry_id, state, from_path), one entry after the other."""
    out, seen = [], set()
    left = []
    for i, path, sha, key in entries:
        if path in disk:
            out.append((path, i, "in_sync" if disk[path] == sha else "modified", None))
            seen.add(path)
        else:
            left.append((i, path, sha, key))
    pending = []
    for i, path, sha, key in left:
        if key in disk and disk[key] == sha and key not in seen:
            out.append((key, i, "moved", path))
            seen.add(key)
        else:
            pending.append((i, path, sha))
    owned = {k for *_, k in entries}
    for i, path, sha in pending:
        spare = sorted((p in owned, p) for p, s in disk.items() if s == sha and p not in seen)
        if spare:
            out.append((spare[0][1], i, "moved", path))
            seen.add(spare[0][1])
        else:
            out.append((path, i, "missing", None))
    return out + [(p, None, "new", None) for p in disk if p not in seen]


def test_disk_diff_claims_each_path_once(spark):
    from sparkloom.operators import joins

    r = random.Random(6)
    for _ in range(3):
        paths = [f"p{i:02}" for i in range(30)]
        disk = {p: str(r.randrange(4)) for p in r.sample(paths, 20)}
        entries = [(i, p, str(r.randrange(5)), r.choice([None, *paths])) for i, p in enumerate(r.sample([*paths, *[f"q{i}" for i in range(20)]], 25))]
        d = spark.createDataFrame(list(disk.items()), "path string, sha256 string")
        e = spark.createDataFrame(entries, "entry_id int, path string, sha256 string, storage_key string")
        assert rows(joins.disk_diff(d, e)) == sorted(plain_diff(disk, entries), key=lambda t: tuple((x is not None, str(x)) for x in t))


def test_quantiles(spark):
    import numpy as np

    from sparkloom.operators import aggregates, evaluation

    r = random.Random(7)
    data = [(r.choice(("a", "b", None)), r.choice((None, r.gauss(0, 9), 1.0))) for _ in range(400)] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(6)
    for x in aggregates.quantiles(df, ["g"], "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}).collect():
        own = [v for g, v in data if g == x.g and v is not None]
        assert [x.p0, x.p50, x.p95, x.p100] == pytest.approx(list(np.quantile(own, [0, 0.5, 0.95, 1])))
    assert aggregates.quantiles(df, [], "v", {"m": 0.5}).first().m == pytest.approx(np.median([v for _, v in data if v is not None]))
    got = {x.g: (x["count"], x.median) for x in aggregates.chart(df, ["g"], "v").collect()}
    assert got["none"] == (0, None) and got["one"] == (1, 5.0) and len(got) == 5
    calls = spark.createDataFrame([(float(i), None if i % 2 else 1, i == 9) for i in range(10)], "latency_ms double, first_rank int, error boolean")
    report = evaluation.latency_report(calls, 3).first()
    assert (report.requests, report.p50_ms, report.p95_ms, report.hit) == (10, 4.0, 7.6, 0.5)


def test_quote_forms(spark):
    import unicodedata

    from sparkloom.functions import text as T
    from sparkloom.operators import joins

    texts = ["Hello,  World!", "ﬁne ﬂow", "ＦＵＬＬ １２", "Straße", "STRASSE", "café café", "µ μ", "中文，“x”", "① ½  ", "İ İ", "", None, "\x00\t-_"]

    def plain(t):
        return "".join(c.casefold() for c in unicodedata.normalize("NFKC", t) if not c.isspace() and not unicodedata.category(c).startswith(("P", "Z", "C")))

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {x.i: x.n for x in df.select("i", T.normalize_quote(F.col("t")).alias("n")).collect()}
    assert got == {i: None if t is None else plain(t) for i, t in enumerate(texts)}
    cited = spark.createDataFrame([("e", "straße", 1), ("e", "ﬁne", 2), ("e", " . ", 3), ("f", "fine", 4)], "entry_id string, quote string, page int")
    reads = spark.createDataFrame([("e", "a long STRASSE"), ("e", "so fine"), ("f", "ＦＩＮＥ!"), ("e", None)], "entry_id string, text string")
    assert rows(joins.verified_citations(cited, reads), "page") == [(1,), (2,), (4,)]
    pages = spark.createDataFrame([("e", 2, "Straße"), ("e", 1, "strasse"), ("f", 1, "x")], "doc string, page int, text string")
    quotes = spark.createDataFrame([("e", "STRAßE"), ("f", "y")], "doc string, quote string")
    assert rows(joins.quote_pages(quotes, pages)) == [("e", "STRAßE", 1), ("f", "y", None)]
