"""Queries of records and their files: joins, upkeep, relations, vectors, recall and evaluation, on orders as entries and
customers as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators import aggregates, evaluation, filters, graph, joins, maintenance, recall, search, vectors, windows
from sparkloom.plans.registry import query
from sparkloom.plans.tables import PAIRS_SQL, part_pairs, read, with_checkpoints

NOW = "1998-08-01"
ENTRIES_SQL = """e AS (SELECT o_orderkey AS id, o_custkey AS file_id, 'order ' || o_orderkey AS name, o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS deleted_at,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'active' WHEN '2-HIGH' THEN 'manual_active' WHEN '3-MEDIUM' THEN 'demoted' ELSE 'archived' END AS lifecycle FROM orders),
f AS (SELECT c_custkey AS file_id, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS summary, CASE WHEN c_nationkey = 0 THEN TIMESTAMP '1998-01-01' END AS deleted_at,
  CASE WHEN c_custkey % 3 = 0 THEN 'pending' ELSE 'done' END AS ingest_status FROM customer)"""


def entries(spark: SparkSession, d: str) -> DataFrame:
    state = "CASE o_orderpriority WHEN '1-URGENT' THEN 'active' WHEN '2-HIGH' THEN 'manual_active' WHEN '3-MEDIUM' THEN 'demoted' ELSE 'archived' END AS lifecycle"
    return read(spark, d, "orders").selectExpr("o_orderkey AS id", "o_custkey AS file_id", "concat('order ', o_orderkey) AS name", "o_orderdate AS created_at", "CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS deleted_at", state)


def files(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").selectExpr(
        "c_custkey AS file_id", "CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS summary", "CASE WHEN c_nationkey = 0 THEN TIMESTAMP '1998-01-01' END AS deleted_at",
        "CASE WHEN c_custkey % 3 = 0 THEN 'pending' ELSE 'done' END AS ingest_status",
    )


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


@query("entries_with_files", f"WITH {ENTRIES_SQL} SELECT e.id, file_id, summary FROM e JOIN f USING (file_id) WHERE e.deleted_at IS NULL AND f.deleted_at IS NULL AND lifecycle IN ('active', 'manual_active') AND ingest_status = 'done'")
def entries_with_files(spark: SparkSession, d: str) -> DataFrame:
    return joins.with_files(entries(spark, d), files(spark, d)).filter(filters.indexable()).select("id", "file_id", "summary")


@query("active_entries", f"WITH {ENTRIES_SQL} SELECT id, lifecycle FROM e WHERE deleted_at IS NULL AND lifecycle IN ('active', 'manual_active') AND id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def active_entries(spark: SparkSession, d: str) -> DataFrame:
    wanted = read(spark, d, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("id"))
    return joins.lookup(entries(spark, d), wanted, "active").select("id", "lifecycle")


@query("count_filtered", f"WITH {ENTRIES_SQL} SELECT count(*) FILTER (lifecycle = 'active') AS active, count(*) FILTER (lifecycle IN ('demoted', 'archived')) AS quiet FROM e")
def count_filtered(spark: SparkSession, d: str) -> DataFrame:
    e = entries(spark, d)
    return spark.createDataFrame([(filters.count_filtered(e, {"lifecycle": "active"}), filters.count_filtered(e, among={"lifecycle": ["demoted", "archived"]}))], "active bigint, quiet bigint")


@query("line_range", "SELECT conv_id, turn, text FROM conversations WHERE turn BETWEEN 1 AND 2")
def line_range(spark: SparkSession, d: str) -> DataFrame:
    return filters.line_range(read(spark, d, "conversations").select("conv_id", "turn", "text"), 1, 2, no="turn")


@query("low_quality", "SELECT doc_id AS id, source FROM documents WHERE coalesce(length(trim(substr(text, 1, 200), ' ')), 0) < 60")
def low_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").selectExpr("doc_id AS id", "source", "substring(text, 1, 200) AS summary", "CAST(NULL AS timestamp) AS deleted_at", "n_chars AS ingested_at")
    return filters.low_quality(rows, 60).select("id", "source")


@query("offset_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 60")
def offset_page(spark: SparkSession, d: str) -> DataFrame:
    return filters.page(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 40, 60)[0]


@query("rank_pool", "SELECT o_custkey AS query_id, o_orderkey AS id, r AS base_rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 500")
def rank_pool(spark: SparkSession, d: str) -> DataFrame:
    base = read(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.row_number().over(Window.partitionBy("o_orderstatus").orderBy("o_orderkey")).alias("base_rank"))
    return search.rank_pool(base, 20, 40)


@query("entry_tag_names", f"WITH {ENTRIES_SQL} SELECT e.id AS entry_id, p_partkey AS tag_id, p_name AS name, p_type AS facet FROM e JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = e.id JOIN part ON p_partkey = l_partkey WHERE p_size > 10")
def entry_tag_names(spark: SparkSession, d: str) -> DataFrame:
    tags = read(spark, d, "part").selectExpr("p_partkey AS id", "p_name AS name", "p_type AS facet", "CASE WHEN p_size <= 10 THEN 0 END AS alias_of")
    worn = read(spark, d, "lineitem").selectExpr("l_orderkey AS entry_id", "l_partkey AS tag_id").distinct()
    return joins.entry_tag_names(entries(spark, d).withColumnRenamed("id", "entry_id"), worn, tags)


@query("relation_endpoints", f"WITH {ENTRIES_SQL}, l AS (SELECT e.id, e.name, summary FROM e JOIN f USING (file_id) WHERE e.deleted_at IS NULL AND f.deleted_at IS NULL AND summary IS NOT NULL), {PAIRS_SQL.format(least=2)} SELECT a, b, n, x.name AS a_name, x.summary AS a_summary, y.name AS b_name, y.summary AS b_summary FROM pairs JOIN l x ON x.id = a JOIN l y ON y.id = b WHERE n >= 2")
def relation_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return joins.relation_endpoints(part_pairs(spark, d), entries(spark, d), files(spark, d), 2).select("a", "b", "n", "a_name", "a_summary", "b_name", "b_summary")


@query("mentioning", "SELECT l_orderkey AS note_id, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1 HAVING bool_or(l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7))")
def mentioning(spark: SparkSession, d: str) -> DataFrame:
    notes = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("note_id")).agg(F.collect_set("l_partkey").alias("entry_ids"))
    return joins.mentioning(notes, read(spark, d, "part").filter("p_size = 7").select(F.col("p_partkey").alias("id"))).select("note_id", F.size("entry_ids").cast("bigint").alias("n"))


@query("resolve_tags", """WITH t AS (SELECT lower(p_name) AS n, min(p_partkey) AS d FROM part WHERE p_size > 25 GROUP BY 1), h AS (SELECT lower(p_name) AS n, arg_max(p_partkey, p_retailprice * 1000000 + p_partkey) AS x FROM part WHERE p_size <= 25 GROUP BY 1)
SELECT name, CASE WHEN d IS NOT NULL AND (SELECT p_size FROM part WHERE p_partkey = d) > 40 THEN 1 ELSE coalesce(d, x) END AS tag_id, CASE WHEN d IS NOT NULL THEN 'name' WHEN x IS NOT NULL THEN 'alias_history' END AS via
FROM (SELECT DISTINCT upper(p_name) AS name FROM part UNION SELECT 'nothing') LEFT JOIN t ON t.n = lower(name) LEFT JOIN h ON h.n = lower(name)""")
def resolve_tags(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    asked = part.select(F.upper("p_name").alias("name")).distinct().unionByName(spark.range(1).select(F.lit("nothing").alias("name"))).withColumn("facet", F.lit(None).cast("string"))
    tags = part.filter("p_size > 25").selectExpr("p_partkey AS id", "p_name AS name", "p_type AS facet", "CASE WHEN p_size > 40 THEN CAST(1 AS bigint) END AS alias_of")
    old = part.filter("p_size <= 25").selectExpr("p_name AS from_name", "p_partkey AS to_tag_id", "p_retailprice * 1000000 + p_partkey AS created_at")
    return joins.resolve_tags(asked, tags, old).select("name", "tag_id", "via")


@query("cited_entries", """WITH l AS (SELECT md5(o_orderkey::VARCHAR) AS id, 'order ' || o_orderkey AS name FROM orders WHERE o_orderstatus <> 'F'), c AS (SELECT p_partkey AS marker, substr(md5(p_partkey::VARCHAR), 1, 12) AS entry_id FROM part)
SELECT marker, entry_id, l.name, l.name IS NULL AS missing FROM c LEFT JOIN l ON starts_with(l.id, entry_id)""")
def cited_entries(spark: SparkSession, d: str) -> DataFrame:
    hashed = lambda c: F.md5(F.col(c).cast("string").cast("binary"))
    live = entries(spark, d).select(hashed("id").alias("id"), "name", "deleted_at")
    cites = read(spark, d, "part").select(F.col("p_partkey").alias("marker"), F.substring(hashed("p_partkey"), 1, 12).alias("entry_id"))
    return joins.cited_entries(cites, live).select("marker", "entry_id", "name", "missing")


@query("scoped_files", f"WITH {ENTRIES_SQL} SELECT file_id, ingest_status FROM f WHERE deleted_at IS NULL AND ingest_status = 'done' AND file_id IN (SELECT file_id FROM e WHERE deleted_at IS NULL AND lifecycle = 'demoted')")
def scoped_files(spark: SparkSession, d: str) -> DataFrame:
    scope = read(spark, d, "orders").filter("o_orderpriority = '3-MEDIUM'").select(F.lit("demoted").alias("lifecycle")).distinct()
    return joins.scoped_files(files(spark, d), entries(spark, d), scope, "lifecycle", "done").select("file_id", "ingest_status")


@query("prior_insights", """WITH s AS (SELECT DISTINCT l_suppkey AS session_id, l_partkey AS p FROM lineitem), i AS (SELECT DISTINCT l_orderkey AS insight_id, o_orderdate AS created_at, l_partkey AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
m AS (SELECT DISTINCT session_id, insight_id, created_at FROM s JOIN i USING (p)) SELECT session_id, insight_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, insight_id DESC) AS rank FROM m QUALIFY rank <= 5""")
def prior_insights(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    sessions = li.groupBy(F.col("l_suppkey").alias("session_id")).agg(F.collect_set("l_partkey").alias("entry_ids"))
    dated = li.join(read(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    insights = dated.groupBy(F.col("l_orderkey").alias("insight_id"), F.col("o_orderdate").alias("created_at")).agg(F.collect_set("l_partkey").alias("entry_ids"))
    return joins.prior_insights(insights, sessions, 5).select("session_id", "insight_id", "rank")


@query("quote_pages", """WITH n AS (SELECT conv_id AS doc, turn AS page, text, replace(lower(regexp_replace(text, '[\\s\\pP\\pZ\\pC]+', '', 'g')), 'ß', 'ss') AS t FROM conversations), q AS (SELECT DISTINCT conv_id AS doc, text AS quote FROM conversations WHERE turn % 2 = 1)
SELECT q.doc, quote, min(page) AS page FROM q LEFT JOIN n ON n.doc = q.doc AND replace(lower(regexp_replace(quote, '[\\s\\pP\\pZ\\pC]+', '', 'g')), 'ß', 'ss') <> '' AND contains(t, replace(lower(regexp_replace(quote, '[\\s\\pP\\pZ\\pC]+', '', 'g')), 'ß', 'ss')) GROUP BY 1, 2""")
def quote_pages(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text")
    return joins.quote_pages(turns.filter("page % 2 = 1").select("doc", F.col("text").alias("quote")).distinct(), turns)


@query("capacity", "SELECT count(*) AS files, coalesce(sum(n_chars), 0)::BIGINT AS bytes FROM documents")
def capacity(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.capacity(read(spark, d, "documents"), "n_chars")


@query("text_coverage", "SELECT doc_id, n_chars AS total, least(n_chars, 5000) AS indexed, n_chars > 5000 OR lang = 'de' AS partial, concat_ws(',', CASE WHEN n_chars > 5000 THEN 'size_limit' END, CASE WHEN lang = 'de' THEN 'undecodable' END) AS reasons FROM documents")
def text_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = aggregates.text_coverage(F.col("n_chars"), F.least(F.col("n_chars"), F.lit(5000).cast("bigint")), F.col("lang") != "de")
    rows = read(spark, d, "documents").select("doc_id", c.alias("c"))
    return rows.select("doc_id", "c.total", "c.indexed", "c.partial", F.array_join("c.reasons", ",").alias("reasons"))


@query("inventory", "SELECT 'orders' AS name, count(*) AS rows FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'events', count(*) FROM events")
def inventory(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.inventory({n: read(spark, d, n) for n in ("orders", "part", "events")}).select("name", "rows")


# Notes and lifecycle.
@query("archive", f"WITH {ENTRIES_SQL} SELECT id FROM e WHERE lifecycle = 'demoted' AND created_at <= TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '{NOW}' - INTERVAL 90 DAY)")
def archive(spark: SparkSession, d: str) -> DataFrame:
    notes = read(spark, d, "lineitem").select(F.array("l_orderkey").alias("entry_ids"), F.col("l_shipdate").alias("created_at"))
    return maintenance.archive(entries(spark, d).withColumn("updated_at", F.col("created_at")), notes, now(), None).select("id")


@query("purge_due", f"WITH {ENTRIES_SQL} SELECT id, deleted_at IS NOT NULL AND deleted_at + INTERVAL 400 DAY < TIMESTAMP '{NOW}' AS purged FROM e")
def purge_due(spark: SparkSession, d: str) -> DataFrame:
    stay, gone = maintenance.purge_due(entries(spark, d).withColumn("purge_after", F.expr("deleted_at + INTERVAL 400 DAYS")), now())
    return stay.select("id", F.lit(False).alias("purged")).unionByName(gone.select("id", F.lit(True).alias("purged")))


@query("move_entries", f"WITH {ENTRIES_SQL} SELECT id, CASE WHEN deleted_at IS NULL AND id % 5 = 0 THEN id % 7 ELSE file_id END AS file_id FROM e")
def move_entries(spark: SparkSession, d: str) -> DataFrame:
    moves = read(spark, d, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 7).alias("target"))
    return maintenance.move_entries(entries(spark, d), moves, "file_id").select("id", "file_id")


@query("supersede", "SELECT o_orderkey AS note_id, CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_custkey % 4 = 0 THEN o_custkey WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1 END AS superseded_by_id FROM orders")
def supersede(spark: SparkSession, d: str) -> DataFrame:
    notes = read(spark, d, "orders").selectExpr("o_orderkey AS note_id", "CASE WHEN o_custkey % 4 = 0 AND o_orderstatus <> 'F' THEN o_custkey END AS superseded_by_id", "CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS invalidated_at")
    by = notes.filter("note_id % 3 = 0").select("note_id", (F.col("note_id") + 1).alias("by_id"))
    return maintenance.supersede(notes, by).select("note_id", "superseded_by_id")


@query("due_without_recent", f"SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 2400 HOUR)")
def due_without_recent(spark: SparkSession, d: str) -> DataFrame:
    done = read(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("completed_at"))
    return maintenance.due_without_recent(read(spark, d, "customer").select(F.col("c_custkey").alias("id")), done, now(), "id", hours=2400)


@query("stale_running", f"SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderdate + INTERVAL 30 DAY < TIMESTAMP '{NOW}'")
def stale_running(spark: SparkSession, d: str) -> DataFrame:
    tasks = read(spark, d, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderstatus = 'O' THEN 'running' ELSE 'done' END AS status", "o_orderdate + INTERVAL 30 DAYS AS lease_expires_at")
    return maintenance.stale_running(tasks, now()).select("id")


# Relations.
EDGES_SQL = f"""{PAIRS_SQL.format(least=2)}, g AS (SELECT a, b, n, CASE WHEN a % 2 = 0 THEN true END AS vetted, CASE WHEN a % 2 = 0 THEN TIMESTAMP '{NOW}' - to_days((b % 400)::INTEGER) END AS vetted_at, 1 AS vetted_n, b AS last FROM pairs)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("a") % 2 == 0
    return part_pairs(spark, d).select("a", "b", "n", F.when(even, True).alias("vetted"), F.when(even, now() - F.make_dt_interval((F.col("b") % 400).cast("int"))).alias("vetted_at"), F.lit(1).alias("vetted_n"), F.col("b").alias("last"))


@query("vet_candidates", f"WITH {EDGES_SQL} SELECT a, b, n FROM g WHERE vetted IS NULL OR vetted_at < TIMESTAMP '{NOW}' - INTERVAL 180 DAY OR n >= 2 * vetted_n + 5")
def vet_candidates(spark: SparkSession, d: str) -> DataFrame:
    return graph.vet_candidates(_edges(spark, d), now()).select("a", "b", "n")


@query("direct_unvetted", f"WITH {EDGES_SQL}, s AS (SELECT a AS entry, b AS other, n, last FROM g WHERE vetted IS NULL UNION ALL SELECT b, a, n, last FROM g WHERE vetted IS NULL) SELECT entry, other, n, row_number() OVER (PARTITION BY entry ORDER BY n DESC, last DESC, other) AS rank FROM s WHERE entry IN (SELECT p_partkey FROM part WHERE p_size > 20) QUALIFY rank <= 3")
def direct_unvetted(spark: SparkSession, d: str) -> DataFrame:
    seeds = read(spark, d, "part").filter("p_size > 20").select(F.col("p_partkey").alias("entry"))
    return graph.direct_unvetted(_edges(spark, d), seeds, 3).select("entry", "other", "n", "rank")


@query("without_entries", f"WITH {EDGES_SQL} SELECT a, b, n FROM g WHERE a NOT IN (SELECT p_partkey FROM part WHERE p_size < 10) AND b NOT IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def without_entries(spark: SparkSession, d: str) -> DataFrame:
    return graph.without_entries(_edges(spark, d).select("a", "b", "n"), read(spark, d, "part").filter("p_size < 10").select(F.col("p_partkey").alias("id")))


@query("covered_by_view", """WITH s AS (SELECT l_orderkey AS o, list(DISTINCT l_returnflag || l_linenumber) AS t FROM lineitem GROUP BY 1)
SELECT o, len(list_filter(t, lambda x: x IN ('A1', 'N1', 'R1', 'A2', 'N2'))) >= greatest(1, floor(0.8 * len(t))) AS covered FROM s""")
def covered_by_view(spark: SparkSession, d: str) -> DataFrame:
    tags = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.collect_set(F.concat("l_returnflag", "l_linenumber")).alias("t"))
    return tags.select("o", graph.covered(F.col("t"), F.array(*[F.lit(x) for x in ("A1", "N1", "R1", "A2", "N2")])).alias("covered"))


# Lists of recall.
LISTS_SQL = """x AS (SELECT user_id AS query_id, event_id % 97 AS entry_id, min(event_id) AS pos FROM events WHERE event_type = 'click' GROUP BY 1, 2), y AS (SELECT user_id AS query_id, event_id % 97 AS entry_id, min(event_id) AS pos FROM events WHERE event_type <> 'click' GROUP BY 1, 2)"""


def _list(spark: SparkSession, d: str, test: str) -> DataFrame:
    return read(spark, d, "events").filter(test).groupBy(F.col("user_id").alias("query_id"), (F.col("event_id") % 97).alias("entry_id")).agg(F.min("event_id").alias("pos"))


@query("ordered_distinct", f"WITH {LISTS_SQL}, u AS (SELECT query_id, entry_id, min((s, pos)) AS w FROM (SELECT *, 0 AS s FROM x UNION ALL SELECT *, 1 FROM y) GROUP BY 1, 2) SELECT query_id, entry_id, row_number() OVER (PARTITION BY query_id ORDER BY w, entry_id) AS rank FROM u QUALIFY rank <= 20")
def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    return recall.ordered_distinct([_list(spark, d, "event_type = 'click'"), _list(spark, d, "event_type <> 'click'")], 20)


@query("stale_last", f"WITH {LISTS_SQL} SELECT query_id, entry_id, row_number() OVER (PARTITION BY query_id ORDER BY entry_id % 3 = 0, pos) AS new_pos FROM x")
def stale_last(spark: SparkSession, d: str) -> DataFrame:
    with_checkpoints(spark)
    return recall.stale_last(_list(spark, d, "event_type = 'click'").withColumn("is_stale", F.col("entry_id") % 3 == 0)).select("query_id", "entry_id", "new_pos")


@query("search_notes", "SELECT doc_id FROM documents WHERE n_chars % 5 <> 0 AND (contains(lower(text), 'license') OR lang IN ('fr', 'es'))")
def search_notes(spark: SparkSession, d: str) -> DataFrame:
    notes = read(spark, d, "documents").selectExpr("doc_id", "text AS note", "array(lang) AS tags", "CASE WHEN n_chars % 5 = 0 THEN doc_id END AS superseded_by_id", "CAST(NULL AS timestamp) AS invalidated_at", "n_chars AS created_at")
    return recall.search_notes(notes, ["License"], ["fr", "es"], "any").select("doc_id")


@query("rerank_text", "SELECT doc_id, md5(substr(CASE WHEN doc_id % 2 = 0 AND trim(text, ' ') <> '' THEN trim(text, ' ') ELSE concat_ws(chr(10), nullif(trim(source, ' '), ''), nullif(trim(lang, ' '), '')) END, 1, 1800)) AS text FROM documents")
def rerank_text(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    text = recall.rerank_text(F.when(F.col("doc_id") % 2 == 0, F.col("text")), F.col("source"), F.col("lang"), none, none)
    return read(spark, d, "documents").select("doc_id", F.md5(text.cast("binary")).alias("text"))


# Vectors: the label is the entry, and its parity the model.
VECTORS_SQL = """v AS (SELECT vec_id AS record_id, vec_id // 3 AS entry_id, 'h' || (vec_id % 50) AS text_hash, 'p' AS provider, CASE label % 2 WHEN 0 THEN 'm0' ELSE 'm1' END AS model, 64 AS dims FROM embeddings)"""


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").selectExpr(
        "vec_id AS record_id", "CAST(floor(vec_id / 3) AS bigint) AS entry_id", "CAST(NULL AS string) AS section_id", "concat('h', vec_id % 50) AS text_hash", "'p' AS provider", "CASE label % 2 WHEN 0 THEN 'm0' ELSE 'm1' END AS model", "64 AS dims", "embedding",
    )


@query("vector_refresh", f"""WITH {VECTORS_SQL}, c AS (SELECT record_id, entry_id, CASE WHEN record_id % 2 = 0 THEN text_hash ELSE 'new' || record_id END AS text_hash FROM v WHERE entry_id % 4 = 0), k AS (SELECT DISTINCT text_hash FROM v WHERE model = 'm0')
SELECT record_id, 'kept' AS state FROM v WHERE entry_id NOT IN (SELECT entry_id FROM c) UNION ALL SELECT record_id, CASE WHEN text_hash IN (SELECT text_hash FROM k) THEN 'kept' ELSE 'pending' END FROM c""")
def vector_refresh(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    changed = v.filter("entry_id % 4 = 0").selectExpr("record_id", "entry_id", "section_id", "CASE WHEN record_id % 2 = 0 THEN text_hash ELSE concat('new', record_id) END AS text_hash")
    kept, todo = vectors.refresh(v, changed, "p", "m0", 64)
    return kept.select("record_id", F.lit("kept").alias("state")).unionByName(vectors.pending(todo, kept).select("record_id", F.lit("pending").alias("state")))


@query("vector_manifest", f"WITH {VECTORS_SQL} SELECT provider, model, dims, count(*) AS records, count(DISTINCT entry_id) AS entries, 2 AS version, model = 'm1' AS compatible FROM v GROUP BY 1, 2, 3")
def vector_manifest(spark: SparkSession, d: str) -> DataFrame:
    return vectors.compatible(vectors.manifest(_vectors(spark, d), 2), 2, "p", "m1", 64)


@query("cached_queries", "SELECT item_id AS query_id, item_id % 2 = 0 AS cached FROM benchmark")
def cached_queries(spark: SparkSession, d: str) -> DataFrame:
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    cache = asked.filter("query_id % 2 = 0").select(F.sha2(F.concat(F.lit("p|m0|64|"), "query"), 256).alias("key"), F.array(F.lit(1.0)).alias("embedding")).dropDuplicates(["key"])
    return vectors.cached_queries(asked, cache, "p", "m0", 64).select("query_id", F.col("embedding").isNotNull().alias("cached"))


@query("live_hits", "SELECT vec_id AS entry_id, label AS rank FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def live_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = read(spark, d, "embeddings").select(F.col("vec_id").alias("entry_id"), F.col("label").alias("rank"))
    return vectors.live_hits(hits, read(spark, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("entry_id")))


# Evaluation.
@query("answer_summary", """SELECT count(*) AS answers, round(avg((user_id % 3 <> 0)::INT), 6) AS evidence_hit, round(avg((event_type = 'click')::INT), 6) AS citation_hit, round(avg(CASE WHEN user_id % 3 <> 0 THEN user_id % 3 END), 6) AS mean_first_rank,
round(avg((event_type = 'view')::INT), 6) AS label_accuracy, sum(event_id)::BIGINT AS tokens FROM events""")
def answer_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select(F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 3).alias("evidence_rank"), (F.col("event_type") == "click").alias("cited"), F.col("event_type").alias("label"), F.array(F.lit("view")).alias("expected"), F.col("event_id").alias("tokens"))
    return evaluation.answer_summary(rows)


@query("compare_summary", """SELECT count(*) AS pairs, count(*) FILTER (event_type <> 'error' AND event_type = 'click') AS a_wins, count(*) FILTER (event_type = 'view') AS b_wins, count(*) FILTER (event_type NOT IN ('error', 'click', 'view')) AS ties, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (user_id % 9 = 0) AS timeouts FROM events""")
def compare_summary(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    return evaluation.compare_summary(read(spark, d, "events").select(F.when(t == "click", "a").when(t == "view", "b").alias("winner"), (t == "error").alias("error"), (F.col("user_id") % 9 == 0).alias("timeout")))


@query("expected_labels", """WITH l AS (SELECT o_custkey AS q, CASE o_orderstatus WHEN 'F' THEN 'SUPPORT' WHEN 'O' THEN 'CONTRADICT' ELSE 'other' END AS l FROM orders WHERE o_orderkey % 2 = 0) SELECT q AS query_id, array_to_string(list_sort(list(DISTINCT l)), ',') AS labels FROM l WHERE l <> 'other' GROUP BY 1""")
def expected_labels(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    label = F.struct(F.when(s == "F", " support ").when(s == "O", "Contradict").otherwise("other").alias("label"))
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").cast("string").alias("doc_id"), label.alias("i"))
    queries = o.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("doc_id", F.array("i")))).alias("metadata"))
    return evaluation.expected_labels(queries, o.filter("doc_id % 2 = 0").select("query_id", "doc_id")).withColumn("labels", F.array_join("labels", ","))


# Windows of a text.
@query("char_window", "SELECT doc_id, md5(substr(text, 101, 300)) AS part, CASE WHEN length(text) > 400 THEN 400 END AS next_offset, 1 + length(substr(text, 1, 100)) - length(replace(substr(text, 1, 100), chr(10), '')) AS line_start, 1 + length(substr(text, 1, 400)) - length(replace(substr(text, 1, 400), chr(10), '')) AS line_end FROM documents WHERE text IS NOT NULL")
def char_window(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.char_window(read(spark, d, "documents").select("doc_id", "text").filter("text IS NOT NULL"), 100, 300)
    return rows.select("doc_id", F.md5(F.col("part").cast("binary")).alias("part"), "next_offset", "line_start", "line_end")


@query("line_window", "SELECT doc_id, md5(array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10))) AS part FROM documents WHERE text IS NOT NULL")
def line_window(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.line_window(read(spark, d, "documents").select("doc_id", "text").filter("text IS NOT NULL"), 2, 4)
    return rows.select("doc_id", F.md5(F.col("part").cast("binary")).alias("part"))


@query("section_bodies", "SELECT doc_id, md5(array_to_string(list_slice(string_split(text, chr(10)), 1, 2), chr(10))) AS body FROM documents WHERE text IS NOT NULL")
def section_bodies(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(windows.section_body(F.col("text"), F.lit("1-2"), F.lit("")).cast("binary")).alias("body"))
