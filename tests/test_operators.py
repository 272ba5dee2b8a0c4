"""Small worked examples, with inline expectations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sparkloom.functions import logs
from sparkloom.functions import text as T
from sparkloom.operators import aggregates, evaluation, filters, graph, joins, maintenance, recall, search, sqlrun, vectors, windows
from tests.conftest import rows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tag_overlap(spark):
    wears = {"A": "raft paxos distributed", "B": "raft paxos distributed networking", "C": "raft networking", "D": "python web"}
    pairs = [(e, t) for e, ts in wears.items() for t in ts.split()] + [(f"x{i}", "wide") for i in range(50)] + [("A", "wide"), ("B", "wide")]
    got = graph.tag_overlap_pairs(spark.createDataFrame(pairs, "entry string, tag string"))
    assert rows(got.filter("a < 'x'").select("a", "b", "shared", "weight")) == [("A", "B", 4, 8), ("B", "C", 2, 4)]
    narrow = [p for p in pairs if p[1] != "wide"]
    assert rows(graph.tag_overlap_pairs(spark.createDataFrame(narrow, "entry string, tag string")), "a", "b", "shared", "jaccard", "weight") == [("A", "B", 3, 0.75, 8), ("B", "C", 2, 0.5, 5)]


def test_random_walk_worked_example(spark):
    edges = spark.createDataFrame([("A", "B", 10), ("A", "C", 5), ("B", "D", 5), ("C", "D", 3), ("D", "E", 2)], "a string, b string, n int")
    got = graph.random_walk(graph.symmetric_edges(edges), spark.createDataFrame([("A",)], "seed string"))
    assert {r.node: round(r.score, 4) for r in got.collect()} == {"B": 0.4965, "C": 0.2551, "D": 0.2208, "E": 0.0275}


def test_components_and_shared_tags(spark):
    comp = graph.connected_components(spark.createDataFrame([(1, 2), (2, 3), (5, 6), (9, 9)], "a int, b int"))
    assert rows(comp) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (9, 9)]
    tags = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (3, "y")], "entry int, tag string")
    assert [(r.component, r.members, r.tags) for r in graph.component_shared_tags(comp, tags).collect()] == [(1, 3, ["x"])]


def test_upsert_and_pairs(spark):
    notes = spark.createDataFrame([(["b", "a", "a"],), (["a", "b", "c"],), (None,), ([],)], "entry_ids array<string>")
    assert rows(graph.cooccurrence_pairs(notes)) == [("a", "b", 2)]
    live = spark.createDataFrame([("a",)], "id string")
    assert graph.cooccurrence_pairs(notes, live=live).count() == 0


def test_fusion_quota(spark):
    lex = spark.createDataFrame([(1, "lex1", 1), (1, "both", 2)], "query_id int, entry_id string, rank int")
    sem = spark.createDataFrame([(1, "sem1", 1), (1, "both", 2)], "query_id int, entry_id string, rank int")
    u = recall.union_candidates({"metadata_text": lex, "semantic": sem}).withColumn("s", recall.rrf(F.col("lexical_rank"), F.col("semantic_rank")))
    assert u.orderBy(F.desc("s")).first()["entry_id"] == "both"
    assert recall.quotas(10, (0.4, 0.0, 0.4)) == {"overlap": 4, "tag": 0, "lexical": 4, "semantic": 2}
    many = [(1, f"{b}{i}", m, 5 * k + i + 1) for k, (b, m) in enumerate([("o", ["metadata_text", "semantic"]), ("l", ["metadata_text"]), ("s", ["semantic"])]) for i in range(5)]
    got = recall.quota_select(spark.createDataFrame(many, "query_id int, entry_id string, matched_by array<string>, rank int"), 10, (0.4, 0.0, 0.4))
    assert sorted(r.entry_id[0] for r in got.collect()) == ["l"] * 4 + ["o"] * 4 + ["s"] * 2


def test_recall_score_order(spark):
    data = [(1, "a", ["metadata_text", "semantic"], None, 1, 1, "raft notes", "about raft consensus"), (1, "b", ["semantic"], None, None, 1, "other", "")]
    df = spark.createDataFrame(data, "query_id int, entry_id string, matched_by array<string>, tag_rank int, lexical_rank int, semantic_rank int, display_name string, summary string")
    df = df.withColumns({"terms": T.score_terms(F.array(F.lit("raft"))), "kind": F.lit("text"), "indexed_partial": F.lit(False), "chunk_count": F.lit(0), "truncated": F.lit(False), "rank_score": F.lit(0)})
    got = recall.recall_score(df).orderBy("rank").collect()
    assert [r.entry_id for r in got] == ["a", "b"] and got[0].score > got[1].score


def test_metrics(spark):
    runs = spark.createDataFrame([("q", "d1", 1), ("q", "d2", 2)], "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "d2", 1)], "query_id string, doc_id string, rel int")
    s = evaluation.score_queries(runs, qrels, (1, 2)).first()
    assert (s.first_rank, s.mrr, s.hit_1, s.hit_2, s.recall_2, s.ndcg_2) == (2, 0.5, 0, 1, 1.0, 0.63093)
    queries = spark.createDataFrame([("q",), ("z",)], "query_id string")
    m = evaluation.aggregate_metrics(evaluation.score_queries(runs, qrels, (1, 2)), queries, runs, (1, 2)).first()
    assert (m.evaluated, m.skipped, m.mrr) == (1, 1, 0.5)


def test_latency_report(spark):
    req = spark.createDataFrame([(10.0, 2, False)] * 3 + [(None, None, True)] * 3, "latency_ms double, first_rank int, error boolean")
    rep = evaluation.violations(evaluation.latency_report(req, 3), 1500, 0.9, 0.2).first()
    assert (rep.hit, rep.mrr, rep.error_rate, rep.ok) == (0.5, 0.25, 0.5, False)
    assert rep.violations == ["hit", "error_rate"]


def test_journal_validity(spark):
    t = dt.datetime(2024, 1, 1)
    notes = spark.createDataFrame([(i, t, ids) for i, ids in enumerate([["ok"], ["gone"], ["ed"], ["fd"], ["re"], []])], "note_id int, created_at timestamp, entry_ids array<string>")
    entries = spark.createDataFrame([("ok", "f", None), ("ed", "f", t), ("fd", "g", None), ("re", "h", None)], "id string, file_id string, deleted_at timestamp")
    files = spark.createDataFrame([("f", None, t), ("g", t, t), ("h", None, t + dt.timedelta(days=1))], "file_id string, deleted_at timestamp, ingested_at timestamp")
    got = {r.note_id: (r.is_stale, r.reasons) for r in joins.reference_validity(notes, entries, files).collect()}
    assert got == {0: (False, []), 1: (True, ["missing"]), 2: (True, ["entry_deleted"]), 3: (True, ["file_deleted"]), 4: (True, ["file_reingested_after_note"]), 5: (False, ["unreferenced"])}


def test_hierarchy_with_cycle(spark):
    nodes = spark.createDataFrame([("r", None, "r"), ("a", "r", "a"), ("b", "a", "b"), ("x", "y", "x"), ("y", "x", "y")], "id string, parent_id string, name string")
    closed = joins.closure(nodes)
    assert rows(closed.filter("id = 'b'").select("ancestor", "depth")) == [("a", 1), ("b", 0), ("r", 2)]
    assert {r.id: r.path for r in joins.paths(closed, nodes).collect()}["b"] == "/r/a/b"
    moves = spark.createDataFrame([("r", "b"), ("b", "r")], "child string, new_parent string")
    assert {r.child: r.cycle for r in maintenance.would_cycle(closed, moves).collect()} == {"r": True, "b": False}
    roll = joins.subtree_rollup(closed, spark.createDataFrame([("a", "done"), ("b", "failed")], "folder string, status string"), spark.createDataFrame([("r",), ("b",)], "root string"))
    assert rows(roll.filter("n > 0")) == [("b", "failed", 1), ("r", "done", 1), ("r", "failed", 1)]


def test_disk_diff(spark):
    disk = spark.createDataFrame([("same", "1"), ("edited", "9"), ("new_place", "3"), ("fresh", "7")], "path string, sha256 string")
    exp = spark.createDataFrame([("e1", "same", "1"), ("e2", "edited", "2"), ("e3", "old_place", "3"), ("e4", "lost", "4")], "entry_id string, path string, sha256 string")
    assert rows(joins.disk_diff(disk, exp), "path", "state", "from_path") == [("edited", "modified", None), ("fresh", "new", None), ("lost", "missing", None), ("new_place", "moved", "old_place"), ("same", "in_sync", None)]


def test_vectors(spark):
    rec = spark.createDataFrame([("a", None, [1.0, 0.0]), ("a", "s1", [0.6, 0.8]), ("b", None, [0.0, 1.0]), ("c", None, [1.0])], "entry_id string, section_id string, embedding array<float>")
    q = spark.createDataFrame([(1, [0.6, 0.8])], "query_id bigint, embedding array<float>")
    got = vectors.knn(rec, q, 2).orderBy("rank").collect()
    assert [(r.entry_id, r.section_id, r.rank) for r in got] == [("a", "s1", 1), ("b", None, 2)]
    assert vectors.knn(rec.limit(0), q, 2).count() == 0
    assert one(spark, vectors.l2_normalize(F.array(F.lit(0.0).cast("float")))) == [0.0]


def test_vector_refresh_reuses(spark):
    schema = "record_id string, entry_id string, section_id string, text_hash string, provider string, model string, dims int, embedding array<float>"
    rec = spark.createDataFrame([("r1", "a", None, "h1", "p", "m", 2, [1.0, 0.0]), ("r2", "b", None, "h2", "p", "m", 2, [0.0, 1.0])], schema)
    changed = spark.createDataFrame([("r9", "b", None, "h1"), ("r8", "b", "s", "h5")], "record_id string, entry_id string, section_id string, text_hash string")
    after, todo = vectors.refresh(rec, changed, "p", "m", 2)
    assert rows(after, "record_id") == [("r1",), ("r9",)] and rows(todo, "record_id") == [("r8",)]


def test_sql_guard_and_columns(spark):
    foreign = "reflect('java.lang.System', 'getProperty', 'user.home')"
    wide = ", ".join(f"a{i}" for i in range(60))
    bad = [
        "DELETE FROM t1", "SELECT 1; SELECT 2", "SELECT * FROM read_csv('x')", "EXPLAIN SELECT 1", "SELECT * FROM parquet.`/x`", "SELECT * FROM range(9)", "INSERT INTO t1 VALUES (1)", "SET a=b", "BEGIN SELECT 1; END",
        "SELECT TRANSFORM(a) USING 'cat' FROM t1", "EXECUTE IMMEDIATE 'SELECT 1'", "SELECT * FROM secret", "SELECT * FROM t1, LATERAL (SELECT * FROM secret)", "SELECT * FROM IDENTIFIER('secret')", "SELECT IDENTIFIER('reflect')('a', 'b')",
        "WITH x AS (WITH secret AS (SELECT 1) SELECT * FROM secret) SELECT * FROM secret", "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret", f"SELECT {wide}, {foreign} FROM t1", f"SELECT {foreign.replace('reflect', 'REFLECT ')}",
        "SELECT `reflect`('a', 'b')", "SELECT system.builtin.reflect('a', 'b')", f"SELECT * FROM t1 WHERE a IN (SELECT {foreign})", f"SELECT EXISTS (SELECT 1 WHERE x = {foreign})", f"SELECT a FROM t1 ORDER BY {foreign}", f"VALUES ({foreign})",
        f"SELECT transform(array(1), x -> {foreign})", "SELECT count(*) FILTER (WHERE try_reflect('a', 'b') = '1') FROM t1", f"SELECT * FROM t1 LATERAL VIEW explode(array({foreign})) v AS x", f"SELECT sum(a) OVER (PARTITION BY {foreign}) FROM t1",
    ]
    assert [b for b in bad if not sqlrun.refusal(b, ["t1"])] == []
    good = [
        "WITH a AS (SELECT 'drop; table' AS x) SELECT * FROM a;", "WITH a AS (SELECT 1 x), b AS (SELECT * FROM a) SELECT * FROM a JOIN b USING (x) UNION ALL SELECT 2", "SELECT a, count(*) FROM T1 GROUP BY ROLLUP (a) HAVING count(*) > 1 ORDER BY 1 LIMIT 5",
        "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT * FROM r", "SELECT * FROM t1 WHERE a = (SELECT max(a) FROM t1)", "SELECT sum(a) OVER w FROM t1 WINDOW w AS (ORDER BY b)", "SELECT explode(array(1, 2))",
    ]
    assert [g for g in good if sqlrun.refusal(g, ["t1"])] == []
    staff = spark.createDataFrame([(1, "Ann", 10), (2, "Bo", 20)], "id int, `Full Name` string, salary int")
    page, info = sqlrun.query_tables(spark, [staff], 'SELECT "fullname" AS n, salary FROM t1 ORDER BY salary', limit=1)
    assert [tuple(r) for r in page.collect()] == [("Ann", 10)] and info == {"has_more": True, "next_offset": 1, "fixed": {"fullname": "Full Name"}}
    assert sqlrun.suggest_column("salry", ["salary"]) is None and sqlrun.suggest_column("SAL", ["salary"]) == "salary"


def test_text_functions(spark):
    assert one(spark, T.split_query(F.lit('raft, "two words" Raft；网络'))) == ["raft", "two words", "网络"]
    assert one(spark, T.fts_terms(F.array(F.lit("the"), F.lit("AI"), F.lit("(raft)")))) == ["raft"]
    assert one(spark, T.rank_terms(F.array(F.lit("log v2 of AI 网络")))) == ["log v2 of AI 网络", "v2", "AI"]
    assert one(spark, T.quote_in_source(F.lit("Hello,  World"), F.lit("say hello world!"))) is True
    assert one(spark, T.quote_in_source(F.lit(" . "), F.lit("x"))) is False
    assert one(spark, T.predict_label(F.lit("x\n**Verdict: contradict"))) == "CONTRADICT"
    cited = one(spark, T.parse_citations(F.lit('text[^1]\n[^1]: entry_id=`abc-1` quote="a b" page=3 — why\n[^1]: entry_id=zzz\n[^2]: no')))
    assert [(c.marker, c.entry_id, c.quote, c.page, c.reason) for c in cited] == [("1", "abc-1", "a b", 3, "why")]
    assert one(spark, T.query_patterns(F.lit("what is a.b v2 the Raft"))) == ["what", "v2", "Raft"]
    assert one(spark, T.heading_matches(F.lit("Intro"), F.lit("## Intro: more"))) is True
    assert one(spark, T.safe_display_name(F.lit("a/b c"))) == "a_b_c.txt"
    assert len(one(spark, T.cluster_id(F.array(F.lit("b"), F.lit("a"))))) == 24


def test_logs(spark):
    lines = spark.createDataFrame([("f", 1, "2024-03-12T10:00:01 INFO server starting"), ("f", 2, "2024-03-12T11:00:01Z ERROR failed disk"), ("f", 3, "Mar 12 10:00:00 host warning"), ("f", 4, "plain")], "file string, n int, text string")
    assert [r.l for r in lines.orderBy("n").select(logs.detect_level(F.col("text")).alias("l")).collect()] == ["INFO", "ERROR", "WARN", None]
    got = {r.level: (r.lines, r.first_ts) for r in aggregates.log_summary(lines).collect()}
    assert got["OTHER"] == (1, None) and got["INFO"][1] == "2024-03-12T10:00:01"
    assert rows(aggregates.time_distribution(lines), "bucket", "n") == [("2024-03-12", 2), ("Mar 12", 1)]
    ctx = windows.grep_context(lines, "disk|server", 1).orderBy("rank").collect()
    assert [(r.n, r.match, r.context.count("\n"), r.total) for r in ctx] == [(1, "server", 1, 2), (2, "disk", 2, 2)]


def test_chunks_and_sections(spark):
    doc = spark.createDataFrame([(1, "# A\nx\n## B\ny\n# C\nzzzz")], "doc_id int, text string")
    assert rows(windows.sections_from_headings(doc), "title", "line", "line_end") == [("A", 1, 4), ("B", 3, 4), ("C", 5, 6)]
    assert [(r.line_start, r.line_end) for r in windows.chunk_lines(doc, 7).orderBy("chunk").collect()] == [(1, 2), (3, 4), (5, 5), (6, 6)]


def test_unique_names_skip_taken(spark):
    e = spark.createDataFrame([(1, "f", "a.txt"), (2, "f", "a.txt"), (3, "f", "a (1).txt"), (4, "f", "a.txt")], "id int, folder string, name string")
    assert {r.id: r.unique_name for r in windows.unique_names(e).collect()} == {1: "a.txt", 2: "a (2).txt", 3: "a (1).txt", 4: "a (3).txt"}


def test_filters(spark):
    e = spark.createDataFrame([(1, "x"), (2, "y")], "entry_id int, kind string")
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "entry_id int, tag_id string")
    assert rows(filters.tags_all(e, t, ["a", "b"]), "entry_id") == [(1,)]
    assert rows(filters.tags_none(e, t, ["b"]), "entry_id") == [(2,)]
    assert filters.search_filtered(e, among={"kind": []}).count() == 0 and filters.search_filtered(e, {"kind": None}).count() == 2
    _, info = filters.page(e, ["entry_id"], 1)
    assert info == {"total": 2, "has_more": True, "next_offset": 1}
    ids = spark.createDataFrame([("aabbccdd-0000", "n"), ("aabbccdd-1111", "m"), ("11223344-5555", "k")], "id string, name string")
    asked = spark.createDataFrame([("aabbccdd",), ("1122334455",), ("zz",)], "raw string")
    assert rows(filters.resolve_id_prefix(asked, ids), "raw", "status") == [("1122334455", "resolved"), ("aabbccdd", "ambiguous"), ("zz", "not_found")]


def test_search_short_and_cjk(spark):
    docs = spark.createDataFrame([(1, "AI and 网络 protocols"), (2, "raft consensus"), (3, None)], "id int, text string")
    terms = spark.createDataFrame([(1, "raft"), (2, "sens"), (3, "zz")], "query_id int, term string")
    assert rows(search.trigram_match(docs, terms)) == [(1, "raft", 2), (2, "sens", 2)]
    assert rows(docs.filter(T.substring_match(F.lit("网络"), [F.col("text")])), "id") == [(1,)]
    hits = search.bm25(docs, spark.createDataFrame([(1, "raft")], "query_id int, query string"))
    assert rows(hits, "query_id", "id") == [(1, 2)]


def test_tag_merge(spark):
    tags = spark.createDataFrame([("a", "A", "topic", None), ("b", "B", "topic", None), ("c", "C", "topic", None), ("f", "F", "form", None)], "id string, name string, facet string, alias_of string")
    worn = spark.createDataFrame([("e1", "a"), ("e1", "c"), ("e2", "b"), ("e3", "f")], "entry_id string, tag_id string")
    mapping = spark.createDataFrame([("a", "b"), ("b", "c"), ("f", "a")], "from_id string, to_id string")
    new_tags, new_worn, aliases = maintenance.merge_tags(tags, worn, mapping)
    assert rows(new_worn) == [("e1", "c"), ("e2", "c"), ("e3", "f")]
    assert {r.id: r.alias_of for r in new_tags.collect()} == {"a": "c", "b": "c", "c": None, "f": None}
    assert rows(aliases) == [("A", "c"), ("B", "c")]


def test_lifecycle(spark):
    now = F.lit("2024-06-01").cast("timestamp")
    e = spark.createDataFrame([(1, "active", "2024-01-01"), (2, "active", "2024-05-31"), (3, "active", "2024-01-02")], "id int, lifecycle string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    notes = spark.createDataFrame([([3], "2024-05-30")], "entry_ids array<int>, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    due = maintenance.demote(e, notes, now)
    assert rows(due, "id") == [(1,)]
    after, out = maintenance.apply_transitions(e, spark.createDataFrame([(1, "active", "demoted"), (2, "archived", "active")], "id int, from_state string, to_state string"))
    assert rows(after, "id", "lifecycle") == [(1, "demoted"), (2, "active"), (3, "active")] and rows(out) == [(1, "applied"), (2, "deferred")]


def test_cover(spark):
    c = lambda a, b: one(spark, graph.covered(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    assert c("abcde", "abcd") and not c("abcde", "abc") and not c("a", "z")


def test_funnel(spark):
    from sparkloom.operators import funnel

    queries = spark.createDataFrame([(1, "raft log", [1.0, 0.0])], "query_id int, query string, embedding array<float>")
    entries = spark.createDataFrame([(c, f"{c} raft", "log", "text", False, 0, False) for c in "abc"], "entry_id string, display_name string, summary string, kind string, indexed_partial boolean, chunk_count int, truncated boolean")
    ranked = lambda *ids: spark.createDataFrame([(1, e, i) for i, e in enumerate(ids, 1)], "query_id int, entry_id string, rank int")
    records = spark.createDataFrame([("a", "s1", [1.0, 0.0]), ("b", "s2", [0.1, 1.0])], "entry_id string, section_id string, embedding array<float>")
    pairs = spark.createDataFrame([("a", "z", 4), ("a", "b", 9)], "a string, b string, n int")
    got = funnel.recall_funnel(queries, entries, {"metadata_text": ranked("a", "b"), "semantic": ranked("a", "c")}, funnel.RecallOptions(3), records, relations=pairs)
    assert [(r.entry_id, r.bucket, r.section_id) for r in got.orderBy("pos").collect()][0] == ("a", "overlap", "s1")
    assert rows(got, "entry_id", "source") == [("a", "candidate"), ("b", "candidate"), ("c", "candidate"), ("z", "related")]
    answers = spark.createDataFrame([(1, "see entry_id=`aabbccdd` and entry:99999999")], "answer_id int, answer string")
    known = spark.createDataFrame([("aabbccdd-0000", "n")], "id string, name string")
    assert rows(funnel.cited_docs(answers, known)) == [(1, "aabbccdd-0000")]
    cov = one(spark, funnel.compact_coverage(F.create_map(F.lit("unit"), F.lit("page"), F.lit("other"), F.lit("x"))))
    assert cov == {"unit": "page"}


def test_bundled_joins(spark):
    e = spark.createDataFrame([("aabbccdd-1", "f1", "A", None, "active", "c1"), ("11223344-2", "f2", "B", None, "demoted", "c1"), ("99", "f3", "C", dt.datetime(2024, 1, 1), "active", "c2")], "id string, file_id string, name string, deleted_at timestamp, lifecycle string, catalog_id string")
    f = spark.createDataFrame([("f1", "s1", None, "done"), ("f2", "s2", None, "pending"), ("f3", None, None, "done")], "file_id string, summary string, deleted_at timestamp, ingest_status string")
    wanted = e.select("id")
    assert [joins.lookup(e, wanted, v).count() for v in ("any", "live", "active")] == [3, 2, 1]
    rel = spark.createDataFrame([("aabbccdd-1", "11223344-2", 3), ("aabbccdd-1", "99", 9)], "a string, b string, n int")
    assert rows(joins.relation_endpoints(rel, e, f, 2), "a_name", "b_summary") == [("A", "s2")]
    c = spark.createDataFrame([("aabbccdd",), ("00000000",)], "entry_id string")
    assert rows(joins.cited_entries(c, e), "entry_id", "name", "missing") == [("00000000", None, True), ("aabbccdd", "A", False)]
    assert rows(joins.scoped_files(f, e, spark.createDataFrame([("c1",), ("c2",)], "catalog_id string"), "catalog_id", "done"), "file_id") == [("f1",)]
    edges = rel.withColumns({"vetted": F.when(F.col("n") == 9, True), "last": F.lit("2024-01-01").cast("timestamp")})
    assert rows(graph.direct_unvetted(edges, spark.createDataFrame([("aabbccdd-1",)], "entry string"), 5), "other") == [("11223344-2",)]
    kind = "file_id string, text string, sections array<struct<id:string,title:string,summary:string,key_terms:array<string>,anchor:struct<unit:string,value:string>>>"
    s = lambda i, t: (i, t, "about", ["k"], ("line", "1-2"))
    got = search.section_records(spark.createDataFrame([("f", "body", [s("a", "Intro"), s("a", "Again"), s("b", "Page 3"), s("", "X")])], kind))
    assert rows(got, "record_id", "text")[1] == ("f#section:a", "Intro | about | k | line 1-2")
    assert got.count() == 2


def test_udtfs(spark):
    from sparkloom.sources.extract import register_udtfs

    register_udtfs(spark)
    assert [tuple(r) for r in spark.sql("SELECT line FROM html_lines('<p>a</p><li>b')").collect()] == [("a",), ("- b",)]


def test_trigram_match_beyond_the_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Raft logs"), (2, "a draft, raft"), (2, "RAFT again"), (3, None), (4, "ra"), (5, "\U0001F600\U0001F601 x\ny")], "id int, text string")
    terms = spark.createDataFrame([(1, "raft"), (2, "\U0001F600\U0001F601 x"), (3, "ra"), (4, "x\ny"), (5, "absent"), (6, None)], "query_id int, term string")
    want = [(1, "raft", 1), (1, "raft", 2), (1, "raft", 2), (2, "\U0001F600\U0001F601 x", 5), (4, "x\ny", 5)]
    assert rows(search.trigram_match(docs, terms)) == want
    monkeypatch.setattr(search, "SCAN_TERMS", 0)
    assert rows(search.trigram_match(docs, terms)) == want


def test_text_search(spark):
    from sparkloom.operators.search import text_search

    entries = spark.createDataFrame([("a", "AI report", "raft log"), ("b", "notes", "\u5206\u5e03\u5f0f\u7cfb\u7edf"), ("c", None, "raft raft"), ("d", "x", None), ("e", "raft", "raft")], "id string, name string, body string")
    terms = spark.createDataFrame([(1, "raft"), (1, "ai"), (2, "\u5e03\u5f0f"), (2, "\u5e03\u5f0f"), (3, ""), (3, None), (4, "\u5206\u5e03\u5f0f\u7cfb"), (5, "aft")], "query_id int, term string")
    got = {(r["query_id"], r["id"]): r["score"] for r in text_search(entries, terms, [["name"], ["body"]]).collect()}
    assert set(got) == {(1, "a"), (1, "c"), (1, "e"), (2, "b"), (4, "b")}
    assert got[2, "b"] == got[4, "b"] == 0 and got[1, "e"] > got[1, "c"] > got[1, "a"] > 0
    assert text_search(entries.limit(0), terms, [["name"], ["body"]]).count() == 0
    assert text_search(entries, terms.limit(0), [["name"], ["body"]]).count() == 0


def test_path_to_id(spark):
    asked = spark.createDataFrame([("/a/b",), ("b",), ("c",), ("/no",), (None,), ("c",)], "raw string")
    known = spark.createDataFrame([(1, "/a/b"), (2, "/a/c"), (3, "/c")], "id int, path string")
    got = joins.path_to_id(asked, known)
    assert rows(got) == [(None, "not_found", None), ("/a/b", "resolved", 1), ("/no", "not_found", None), ("b", "resolved", 1), ("c", "ambiguous", None)]
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
