"""Queries of filters, joins, differences, table maintenance and ad-hoc SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import filters, graph, joins, maintenance, recall, sqlrun
from sparkloom.plans.registry import query
from sparkloom.plans.tables import read, with_checkpoints


@query("search_filtered", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    return filters.search_filtered(read(spark, d, "orders"), {"o_orderstatus": "F", "o_custkey": None}, {"o_orderpriority": ["1-URGENT", "2-HIGH"]}).select("o_orderkey", "o_custkey", "o_totalprice")



@query("tag_filters", """SELECT o_orderkey AS entry_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 2)
AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus IN ('O', 'F')) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def tag_filters(spark: SparkSession, d: str) -> DataFrame:
    entries = read(spark, d, "orders").select(F.col("o_orderkey").alias("entry_id"))
    li = read(spark, d, "lineitem")
    tags = li.select(F.col("l_orderkey").alias("entry_id"), F.col("l_returnflag").alias("tag_id"))
    status = li.select(F.col("l_orderkey").alias("entry_id"), F.col("l_linestatus").alias("tag_id"))
    return filters.tags_none(filters.tags_any(filters.tags_all(entries, tags, ["A", "N"]), status, ["O", "F"]), tags, ["R"])


@query("materialized_view", """SELECT p_partkey AS entry_id, p_type AS kind, p_brand AS lifecycle FROM part WHERE p_type = 'ECONOMY' AND p_brand IN ('Brand#1', 'Brand#2') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')""")
def materialized_view(spark: SparkSession, d: str) -> DataFrame:
    entries = read(spark, d, "part").select(F.col("p_partkey").alias("entry_id"), F.col("p_type").alias("kind"), F.col("p_brand").alias("lifecycle"))
    tags = read(spark, d, "lineitem").select(F.col("l_partkey").alias("entry_id"), F.col("l_returnflag").alias("tag_id"))
    return recall.materialize_view(entries, tags, {"kind": "ECONOMY", "lifecycle": ["Brand#1", "Brand#2"], "tags_any": ["A"]})


@query("id_prefixes", """WITH e AS (SELECT md5(o_orderkey::VARCHAR) AS id FROM orders), a AS (SELECT upper(substr(md5(p_partkey::VARCHAR), 1, 8)) AS raw FROM part)
SELECT raw, CASE count(id) WHEN 0 THEN 'not_found' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN count(id) = 1 THEN min(id) END AS id FROM a LEFT JOIN e ON starts_with(id, lower(raw)) GROUP BY 1""")
def id_prefixes(spark: SparkSession, d: str) -> DataFrame:
    entries = read(spark, d, "orders").select(F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("id"), F.lit("order").alias("name"))
    asked = read(spark, d, "part").select(F.upper(F.substring(F.md5(F.col("p_partkey").cast("string").cast("binary")), 1, 8)).alias("raw")).distinct()
    return filters.resolve_id_prefix(asked, entries).select("raw", "status", "id")


@query("keyset_page", "SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-15' OR (ts = TIMESTAMP '2024-01-15' AND event_id < 100) ORDER BY ts DESC, event_id DESC LIMIT 50")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    import datetime

    return filters.keyset_page(read(spark, d, "events").select("event_id", "ts"), "ts", "event_id", 50, (datetime.datetime(2024, 1, 15), 100))


@query("json_filter", "SELECT event_id, user_id FROM events WHERE props->>'$.k' = '7'")
def json_filter(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").filter(filters.json_equals(F.col("props"), "k", "7")).select("event_id", "user_id")


@query("content_seeds", "SELECT sha256(text) AS sha256, arg_min(doc_id, (n_chars, doc_id)) AS seed_id, count(*) AS copies FROM documents GROUP BY 1")
def content_seeds(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("created_at"))
    return joins.content_seeds(rows)


@query("disk_diff", """WITH d AS (SELECT 'p' || doc_id AS path, sha256(text) AS sha FROM documents),
e AS (SELECT doc_id AS entry_id, CASE WHEN m < 2 THEN 'p' ELSE 'q' END || doc_id AS path, sha256(CASE WHEN m IN (1, 4) THEN text || 'x' ELSE text END) AS sha, CASE WHEN m = 2 THEN 'p' || doc_id WHEN m = 3 THEN 'p' || (doc_id + 2) END AS key FROM (SELECT *, doc_id % 6 AS m FROM documents) WHERE m < 5),
s AS (SELECT path, entry_id, CASE WHEN d.sha = e.sha THEN 'in_sync' ELSE 'modified' END AS state FROM e JOIN d USING (path)), rest AS (SELECT * FROM e WHERE path NOT IN (SELECT path FROM d)),
k AS (SELECT key, min(entry_id) AS entry_id FROM rest JOIN d ON d.path = key AND d.sha = rest.sha WHERE key NOT IN (SELECT path FROM e) GROUP BY key),
pending AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY entry_id) AS r FROM rest WHERE entry_id NOT IN (SELECT entry_id FROM k)),
free AS (SELECT path, sha, row_number() OVER (PARTITION BY sha ORDER BY path IN (SELECT key FROM e WHERE key IS NOT NULL), path) AS r FROM d WHERE path NOT IN (SELECT path FROM e) AND path NOT IN (SELECT key FROM k))
SELECT path, entry_id, state, NULL AS from_path FROM s UNION ALL SELECT k.key, entry_id, 'moved', path FROM k JOIN e USING (entry_id)
UNION ALL SELECT coalesce(f.path, p.path), entry_id, CASE WHEN f.path IS NULL THEN 'missing' WHEN entry_id IS NULL THEN 'new' ELSE 'moved' END, CASE WHEN f.path IS NOT NULL THEN p.path END FROM free f FULL JOIN pending p USING (sha, r)""")
def disk_diff(spark: SparkSession, d: str) -> DataFrame:
    """Entries in place, edited, found by their key, by their content, lost; and a sixth of the files new."""
    with_checkpoints(spark)
    docs = read(spark, d, "documents")
    m, k = F.col("doc_id") % 6, F.col("doc_id")
    disk = docs.select(F.concat(F.lit("p"), k.cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"))
    content = F.when(m.isin(1, 4), F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    own = F.when(m == 2, F.concat(F.lit("p"), k.cast("string"))).when(m == 3, F.concat(F.lit("p"), (k + 2).cast("string")))
    expected = docs.filter(m < 5).select(k.alias("entry_id"), F.concat(F.when(m < 2, "p").otherwise("q"), k.cast("string")).alias("path"), F.sha2(content, 256).alias("sha256"), own.alias("storage_key"))
    return joins.disk_diff(disk, expected)


@query("reference_validity", """WITH r AS (SELECT o.o_custkey AS note_id, l.l_partkey AS id, max(o_orderdate) OVER (PARTITION BY o_custkey) AS made FROM orders o LEFT JOIN lineitem l ON l_orderkey = o_orderkey),
m AS (SELECT note_id, CASE WHEN r.id IS NULL THEN 'unreferenced' WHEN p_partkey IS NULL THEN 'missing' WHEN p_size > 45 THEN 'entry_deleted' WHEN p_brand = 'Brand#1' THEN 'file_deleted' WHEN TIMESTAMP '1998-01-01' > made THEN 'file_reingested_after_note' END AS reason FROM r LEFT JOIN part ON p_partkey = r.id WHERE r.id IS NOT NULL OR note_id NOT IN (SELECT note_id FROM r WHERE id IS NOT NULL))
SELECT note_id, count(*) FILTER (reason <> 'unreferenced') > 0 AS is_stale, coalesce(array_to_string(list_sort(list(DISTINCT reason) FILTER (reason IS NOT NULL)), ','), '') AS reasons FROM m GROUP BY 1""")
def reference_validity(spark: SparkSession, d: str) -> DataFrame:
    o, li, p = (read(spark, d, t) for t in ("orders", "lineitem", "part"))
    notes = o.join(li, o["o_orderkey"] == li["l_orderkey"], "left").groupBy(F.col("o_custkey").alias("note_id")).agg(F.max("o_orderdate").alias("created_at"), F.collect_set("l_partkey").alias("entry_ids"))
    day = lambda test, at: F.when(test, F.lit(at).cast("timestamp"))
    entries = p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("file_id"), day(F.col("p_size") > 45, "2000-01-01").alias("deleted_at"))
    files = p.select(F.col("p_partkey").alias("file_id"), day(F.col("p_brand") == "Brand#1", "2000-01-01").alias("deleted_at"), F.lit("1998-01-01").cast("timestamp").alias("ingested_at"))
    return joins.reference_validity(notes, entries, files).withColumn("reasons", F.array_join("reasons", ","))


@query("sync_plan", """SELECT l.doc_id AS id, sha256(l.text) AS sha256, CASE WHEN r.doc_id IS NULL THEN 'new' ELSE 'changed' END AS state FROM documents l LEFT JOIN documents r ON r.doc_id = l.doc_id * 2 WHERE r.doc_id IS NULL OR sha256(r.text) <> sha256(l.text)""")
def sync_plan(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"))
    remote = docs.filter("id = 2 * floor(id / 2)").select((F.col("id") / 2).cast("bigint").alias("id"), "sha256")
    return joins.sync_plan(docs, remote, "new")


@query("orphans", "SELECT p_partkey AS file_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    return joins.orphans(read(spark, d, "part").select(F.col("p_partkey").alias("file_id")), read(spark, d, "lineitem").select(F.col("l_partkey").alias("file_id")))


@query("entry_bundle", """SELECT p_partkey AS id, coalesce(t.tags, '') AS tags, coalesce(r.related, '') AS related FROM part LEFT JOIN (SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS tags FROM lineitem GROUP BY 1) t ON t.l_partkey = p_partkey
LEFT JOIN (SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS related FROM lineitem GROUP BY 1) r ON r.l_partkey = p_partkey""")
def entry_bundle(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    out = joins.bundle(read(spark, d, "part").select(F.col("p_partkey").alias("id")), li.select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("tag")), li.select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("other")))
    return out.select("id", F.array_join("tags", ",").alias("tags"), F.array_join("related", ",").alias("related"))


@query("verified_citations", """SELECT DISTINCT c.l_orderkey AS entry_id, upper(substr(p_name, 1, 5)) AS quote, l_linenumber AS page FROM lineitem c JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
WHERE contains(lower(regexp_replace(o_orderpriority || ' ' || p_name, '[\\s\\p{P}\\p{Z}\\p{C}]+', '', 'g')), lower(regexp_replace(upper(substr(p_name, 1, 5)), '[\\s\\p{P}\\p{Z}\\p{C}]+', '', 'g')))""".replace("\\\\", "\\"))
def verified_citations(spark: SparkSession, d: str) -> DataFrame:
    o, li, p = (read(spark, d, t) for t in ("orders", "lineitem", "part"))
    rows = li.join(p, li["l_partkey"] == p["p_partkey"]).join(o, li["l_orderkey"] == o["o_orderkey"])
    citations = rows.select(F.col("l_orderkey").alias("entry_id"), F.upper(F.substring("p_name", 1, 5)).alias("quote"), F.col("l_linenumber").alias("page"), "p_partkey")
    reads = rows.select(F.col("l_orderkey").alias("entry_id"), F.concat_ws(" ", "o_orderpriority", "p_name").alias("text"))
    return joins.verified_citations(citations.drop("p_partkey"), reads)


@query("upsert_relations", """WITH c AS (SELECT l_partkey AS a, l_suppkey AS b, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2), f AS (SELECT l_partkey AS a, l_suppkey AS b, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT a, b, coalesce(c.n, 0) + coalesce(f.n, 0) AS n, CASE WHEN f.n IS NOT NULL AND c.n IS NULL THEN 'weak' WHEN c.n IS NOT NULL THEN 'strong' END AS note, CASE WHEN c.n IS NULL THEN 'cooccurrence' ELSE 'citation' END AS source FROM c FULL JOIN f USING (a, b)""")
def upsert_relations(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    count = lambda flag: li.filter(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.count("*").alias("n"))
    edges = count("A").withColumns({"note": F.lit("strong"), "source": F.lit("citation"), "last": F.lit("2024-01-01").cast("timestamp")})
    found = count("R").withColumns({"note": F.lit("weak"), "source": F.lit("cooccurrence")})
    return graph.upsert_relations(edges, found, F.lit("2024-02-01").cast("timestamp")).drop("last")


@query("demote", """SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1999-01-01' - INTERVAL 14 DAY
AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' - INTERVAL 30 DAY)""")
def demote(spark: SparkSession, d: str) -> DataFrame:
    entries = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("archived").alias("lifecycle"), F.col("o_orderdate").alias("created_at"))
    notes = read(spark, d, "lineitem").select(F.array("l_orderkey").alias("entry_ids"), F.col("l_shipdate").alias("created_at"))
    return maintenance.demote(entries, notes, F.lit("1999-01-01").cast("timestamp"), cap=None).select("id")


@query("apply_transitions", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 100000 THEN 'X' ELSE o_orderstatus END AS lifecycle FROM orders")
def apply_transitions(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    moves = o.filter("o_totalprice > 100000").select(F.col("o_orderkey").alias("id"), F.lit("O").alias("from_state"), F.lit("X").alias("to_state"))
    return maintenance.apply_transitions(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("lifecycle")), moves)[0]


@query("prune", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY")
def prune(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.prune(read(spark, d, "events"), "ts", F.lit("2024-01-31").cast("timestamp"), 10).select("event_id")


@query("merge_tags", """WITH RECURSIVE m AS (SELECT p_partkey AS f, p_partkey // 2 AS t FROM part WHERE p_partkey > 0 AND p_partkey // 2 < p_partkey), j AS (SELECT m.f, m.t FROM m JOIN part a ON a.p_partkey = f JOIN part b ON b.p_partkey = t AND a.p_type = b.p_type),
r(f, t) AS (SELECT f, t FROM j UNION ALL SELECT r.f, j.t FROM r JOIN j ON j.f = r.t), x AS (SELECT f, min(t) AS t FROM r GROUP BY 1)
SELECT DISTINCT l_orderkey AS entry_id, coalesce(x.t, l_partkey) AS tag_id FROM lineitem LEFT JOIN x ON x.f = l_partkey""")
def merge_tags(spark: SparkSession, d: str) -> DataFrame:
    with_checkpoints(spark)
    p = read(spark, d, "part")
    tags = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("facet"), F.lit(None).cast("bigint").alias("alias_of"))
    mapping = p.filter("p_partkey > 0").select(F.col("p_partkey").alias("from_id"), F.floor(F.col("p_partkey") / 2).alias("to_id"))
    worn = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("entry_id"), F.col("l_partkey").alias("tag_id"))
    return maintenance.merge_tags(tags, worn, mapping)[1]


@query("merge_snapshots", """SELECT l_orderkey AS id, max(l_shipdate) AS at, 'local' AS side FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1 UNION ALL SELECT o_orderkey, o_orderdate, 'remote' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')""")
def merge_snapshots(spark: SparkSession, d: str) -> DataFrame:
    local = read(spark, d, "lineitem").filter("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_shipdate").alias("at")).withColumn("side", F.lit("local"))
    remote = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.lit("remote").alias("side"))
    return maintenance.merge_snapshots(remote, local, "id")


@query("would_cycle", """WITH RECURSIVE c(a, i) AS (SELECT p_partkey, p_partkey FROM part UNION ALL SELECT a // 4, i FROM c WHERE a > 0)
SELECT p_partkey AS child, p_size::BIGINT AS new_parent, EXISTS (SELECT 1 FROM c WHERE c.a = p_partkey AND c.i = p_size) AS cycle FROM part""")
def would_cycle(spark: SparkSession, d: str) -> DataFrame:
    with_checkpoints(spark)
    p = read(spark, d, "part")
    nodes = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 4)).cast("bigint").alias("parent_id"))
    return maintenance.would_cycle(joins.closure(nodes), p.select(F.col("p_partkey").alias("child"), F.col("p_size").cast("bigint").alias("new_parent")))


@query("not_processed", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01')")
def not_processed(spark: SparkSession, d: str) -> DataFrame:
    outcomes = read(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("completed_at"))
    return joins.not_processed(read(spark, d, "customer").select(F.col("c_custkey").alias("id")), outcomes, F.lit("2000-01-01").cast("timestamp"))


@query("cadence_due", """SELECT user_id AS kind FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 30)
AND user_id NOT IN (SELECT user_id FROM events WHERE event_type <> 'error' GROUP BY 1 HAVING epoch(TIMESTAMP '2024-01-31') - floor(epoch(max(ts))) < 86400)""")
def cadence_due(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    status = F.when((F.col("event_type") == "error") & (F.col("value") > 30), "running").when(F.col("event_type") != "error", "done").otherwise("failed")
    tasks = e.select(F.col("user_id").alias("kind"), status.alias("status"), F.col("ts").alias("finished_at"))
    cadence = e.select(F.col("user_id").alias("kind"), F.lit(86400).alias("seconds")).distinct()
    return maintenance.cadence_due(tasks, cadence, F.lit("2024-01-31").cast("timestamp")).select("kind")


@query("adhoc_sql", 'SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)')
def adhoc_sql(spark: SparkSession, d: str) -> DataFrame:
    sql = 'SELECT "L_ReturnFlag" AS l_returnflag, " l_linestatus " AS l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM t1 GROUP BY ROLLUP (l_returnflag, l_linestatus)'
    return sqlrun.query_tables(spark, [read(spark, d, "lineitem")], sql)[0]


@query("sections", r"""WITH t AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^([A-Ia-i])', '# \1', 'g'), '(?m)^([J-Rj-r])', '## \1', 'g'), '(?m)^([S-Zs-z])', '  ### \1', 'g'), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM t),
h AS (SELECT doc_id, n, i AS line, length(regexp_extract(line, '^ *(#+) ', 1)) AS level, regexp_extract(line, '^\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$', 2) AS title FROM l WHERE regexp_matches(line, '^\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$'))
SELECT doc_id, line, level, title, coalesce((SELECT min(x.line) - 1 FROM h x WHERE x.doc_id = h.doc_id AND x.line > h.line AND x.level <= h.level), n) AS line_end FROM h""")
def sections(spark: SparkSession, d: str) -> DataFrame:
    """Documents with lines as headings of three levels, by their first letters."""
    from sparkloom.operators.windows import sections_from_headings

    marked = F.col("text")
    for letters, mark in (("A-Ia-i", "#"), ("J-Rj-r", "##"), ("S-Zs-z", "  ###")):
        marked = F.regexp_replace(marked, f"(?m)^([{letters}])", f"{mark} $1")
    return sections_from_headings(read(spark, d, "documents").select("doc_id", marked.alias("text")))


@query("quote_normalized", r"SELECT item_id, replace(lower(regexp_replace(nfc_normalize(text), '[\s\p{P}\p{Z}\p{C}]+', '', 'g')), 'ß', 'ss') AS norm FROM benchmark")
def quote_normalized(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select("item_id", T.normalize_quote(F.col("text")).alias("norm"))
