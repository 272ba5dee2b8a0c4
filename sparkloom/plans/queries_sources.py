"""Queries of sources and text functions: given tables written to the shared folder in another format and read back, and
columns derived from documents and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import search
from sparkloom.plans.registry import query
from sparkloom.plans.tables import read, scratch
from sparkloom.sources import extract, readers


@query("csv_file", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_file(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    readers.export_csv(read(spark, d, "customer"), path, cap=None)
    return readers.read_csv(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@query("tsv_file", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def tsv_file(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    read(spark, d, "supplier").write.csv(path, header=True, sep="\t")
    return readers.read_tsv(spark, path).withColumn("s_suppkey", F.col("s_suppkey").cast("bigint"))


@query("json_file", "SELECT p_partkey, p_name, p_size::BIGINT AS p_size FROM part")
def json_file(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    read(spark, d, "part").select("p_partkey", "p_name", "p_size").write.json(path)
    return readers.read_json(spark, path).select("p_partkey", "p_name", "p_size")


@query("parquet_file", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O'")
def parquet_file(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_parquet(spark, f"{d}/orders.parquet").filter("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate")


@query("many_as_one", "SELECT 'r' AS __sheet_name, r_regionkey::VARCHAR AS r_regionkey, r_name, NULL AS n_nationkey, NULL AS n_name, NULL AS n_regionkey FROM region UNION ALL SELECT 'n', NULL, NULL, n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR FROM nation")
def many_as_one(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_many_as_one({"r": read(spark, d, "region"), "n": read(spark, d, "nation")})


@query("log_files", "SELECT props AS text, count(*) AS n, count(*) AS numbered FROM events GROUP BY 1")
def log_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    read(spark, d, "events").select("props").write.text(path)
    whole = readers.read_log_lines(spark, path).groupBy("text").agg(F.count("*").alias("n"))
    parts = readers.split_log_lines(spark, path).filter("n >= 1").groupBy("text").agg(F.count("*").alias("numbered"))
    return whole.join(parts, "text")


@query("corpus_files", """SELECT doc_id::VARCHAR AS doc_id, md5('doc_id: ' || doc_id || chr(10) || chr(10) || '# ' || source || CASE WHEN trim(text, ' ') <> '' THEN chr(10) || chr(10) || text ELSE '' END) AS rendered FROM documents""")
def corpus_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("_id"), F.col("source").alias("title"), "text", F.lit(3).alias("metadata")).write.json(path)
    rows = readers.read_corpus_jsonl(spark, path)
    shown = readers.render_document(F.col("doc_id"), F.col("title"), F.col("metadata"), F.col("text"))
    return rows.select("doc_id", F.md5(shown.cast("binary")).alias("rendered"))


@query("query_files", "SELECT item_id::VARCHAR AS query_id, trim(text, ' ') AS text FROM benchmark WHERE trim(text, ' ') <> ''")
def query_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    read(spark, d, "benchmark").select(F.concat(F.lit(" "), "item_id", F.lit(" ")).alias("_id"), "text").write.json(path)
    return readers.read_queries_jsonl(spark, path).select("query_id", "text")


@query("qrels_files", "SELECT 'q' || (doc_id % 50) AS query_id, doc_id::VARCHAR AS doc_id, quality AS rel FROM labels")
def qrels_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    rows = read(spark, d, "labels").select(F.concat(F.lit("q"), F.col("doc_id") % 50).alias("q"), "doc_id", "quality")
    rows.select(F.concat_ws("\t", "q", "doc_id", "quality").alias("value")).unionByName(spark.range(1).select(F.lit("query-id\tcorpus-id\tscore").alias("value"))).write.text(path)
    return readers.read_qrels(spark, path)


@query("snapshot", "SELECT 'customer' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'nation', count(*) FROM nation")
def snapshot(spark: SparkSession, d: str) -> DataFrame:
    return readers.write_snapshot({"customer": read(spark, d, "customer"), "nation": read(spark, d, "nation")}, scratch(spark)).select("name", "rows")


@query("file_tree", """SELECT 'o_orderstatus=' || o_orderstatus AS folder, sum(length('{"o_orderkey":' || o_orderkey || '}') + 1)::BIGINT AS bytes FROM orders GROUP BY 1""")
def file_tree(spark: SparkSession, d: str) -> DataFrame:
    """The bytes of each folder of a tree of files."""
    path = scratch(spark)
    read(spark, d, "orders").select("o_orderkey", "o_orderstatus").write.partitionBy("o_orderstatus").json(path)
    files = readers.scan_files(spark, path).filter("sha256 IS NOT NULL AND path NOT LIKE '%/_SUCCESS'")
    return files.groupBy(F.regexp_extract("path", "/([^/]*)/[^/]*$", 1).alias("folder")).agg(F.sum("length").alias("bytes"))


@query("delimited_file", "SELECT p_partkey::INTEGER AS p_partkey, p_brand, p_size FROM part")
def delimited_file(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    read(spark, d, "part").select(F.col("p_partkey").alias("P Partkey"), F.col("p_brand").alias("P-Brand"), F.col("p_size").alias("P_Size")).write.csv(path, header=True, sep="|")
    return readers.infer_delimited(spark, path)


MEMBERS_SQL = "m AS (SELECT p_brand AS archive, CASE WHEN p_size < 5 THEN 'readme' ELSE 'f' || p_partkey END || '.' || ['md', 'py', 'bin'][1 + (p_partkey % 3)::INTEGER] AS path, p_size * 400 AS size, p_partkey FROM part)"


def _members(spark: SparkSession, d: str) -> DataFrame:
    ext = F.element_at(F.array(F.lit("md"), F.lit("py"), F.lit("bin")), (F.col("p_partkey") % 3 + 1).cast("int"))
    name = F.when(F.col("p_size") < 5, F.lit("readme")).otherwise(F.concat(F.lit("f"), "p_partkey"))
    return read(spark, d, "part").select(F.col("p_brand").alias("archive"), F.concat(name, F.lit("."), ext).alias("path"), (F.col("p_size") * 400).alias("size"))


@query("picked_members", f"""WITH {MEMBERS_SQL}, r AS (SELECT *, CASE WHEN ends_with(path, '.md') THEN 1 WHEN ends_with(path, '.py') THEN 4 ELSE 15 END - CASE WHEN starts_with(path, 'readme') THEN 2 ELSE 0 END AS k FROM m),
w AS (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY k, size, path) AS pick, CASE WHEN max(size) OVER (PARTITION BY archive) < 4096 THEN 16 ELSE 8 END AS cap FROM r) SELECT archive, path, size, pick FROM w WHERE pick <= cap""")
def picked_members(spark: SparkSession, d: str) -> DataFrame:
    return readers.pick_members(_members(spark, d))


@query("listed_members", f"""WITH {MEMBERS_SQL}, h AS (SELECT archive, path, row_number() OVER (PARTITION BY archive ORDER BY path, size) AS row, count(*) OVER (PARTITION BY archive) AS total FROM m WHERE regexp_matches(path, '^f[0-4].*\\.[mp].$')) SELECT archive, path, row, total, total > 5 AS has_more FROM h WHERE row BETWEEN 3 AND 5""")
def listed_members(spark: SparkSession, d: str) -> DataFrame:
    return readers.list_members(_members(spark, d).select("archive", "path"), "f[0-4]*.[mp]?", 3, 2)


@query("reflog", """WITH l AS (SELECT o_custkey AS repo, o_orderkey AS n, substr(sha256((o_orderkey // 2)::VARCHAR), 1, 40) AS new, 'commit: ' || o_orderpriority AS message FROM orders),
o AS (SELECT *, row_number() OVER (PARTITION BY repo, new ORDER BY n DESC) AS k FROM l) SELECT repo, n, new, 800000000 + n AS at, message, row_number() OVER (PARTITION BY repo ORDER BY n DESC) AS rank FROM o WHERE k = 1 QUALIFY rank <= 20""")
def reflog(spark: SparkSession, d: str) -> DataFrame:
    sha = lambda c: F.substring(F.sha2(c.cast("string"), 256), 1, 40)
    k = F.col("o_orderkey")
    line = F.concat(sha(k + 7), F.lit(" "), sha(F.floor(k / 2)), F.lit(" Ann <a@example.com> "), (k + 800_000_000).cast("string"), F.lit(" +0100\tcommit: "), "o_orderpriority")
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("repo"), k.alias("n"), line.alias("text"))
    return readers.parse_reflog(rows).select("repo", "n", "new", "at", "message", "rank")


@query("decoded_text", "SELECT doc_id, md5(text) AS text FROM documents")
def decoded_text(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    content = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "UTF-16"))
    return extract.decode_text(docs.select("doc_id", content.alias("content"))).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"))


# Sections of parts: id, title, summary, key terms, anchor.
def _sections(spark: SparkSession, d: str) -> DataFrame:
    one = "named_struct('id', concat('a', p_size), 'title', IF(p_size % 4 = 0, 'Page 3', p_name), 'summary', IF(p_size % 3 = 0, ' ', p_type), 'key_terms', array(p_brand, lower(p_brand)), 'anchor', named_struct('unit', 'line', 'value', CAST(p_size AS string)))"
    two = "named_struct('id', ' ', 'title', '', 'summary', CAST(NULL AS string), 'key_terms', CAST(NULL AS array<string>), 'anchor', CAST(NULL AS struct<unit: string, value: string>))"
    return read(spark, d, "part").selectExpr("p_partkey", "p_name", "p_type", "p_brand", "p_size", f"array({one}, {two}) AS sections")


LINE_SQL = "concat_ws(' | ', CASE WHEN p_size % 4 = 0 THEN 'Page 3' ELSE p_name END, CASE WHEN p_size % 3 <> 0 THEN p_type END, p_brand || ', ' || lower(p_brand), 'line ' || p_size)"


@query("section_lines", f"SELECT p_partkey, {LINE_SQL} AS line, p_size % 4 <> 0 AS stable, 'about' || chr(10) || {LINE_SQL} AS description FROM part")
def section_lines(spark: SparkSession, d: str) -> DataFrame:
    first = F.col("sections")[0]
    rows = _sections(spark, d).withColumn("one", F.slice("sections", 1, 1))
    return rows.select("p_partkey", T.section_evidence_line(first).alias("line"), T.is_stable_section(first).alias("stable"), T.description_text(F.lit("about"), F.col("one")).alias("description"))


@query("normal_sections", "SELECT p_partkey, 'a' || p_size || ',s2' AS ids, CASE WHEN p_size % 4 = 0 THEN 'Page 3' ELSE p_name END || ',Section 2' AS titles, 'line,section' AS units, 's1,s2' AS numbered, p_brand || ',' || CASE WHEN p_size % 4 = 0 THEN 'Page 3' ELSE p_name END || ',Section 2' AS terms FROM part")
def normal_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = _sections(spark, d).withColumn("s", T.normalize_sections(F.col("sections")))
    joined = lambda c, f: F.array_join(F.transform(c, f), ",")
    return rows.select(
        "p_partkey", joined("s", lambda x: x["id"]).alias("ids"), joined("s", lambda x: x["title"]).alias("titles"), joined("s", lambda x: x["anchor"]["unit"]).alias("units"),
        joined(T.renumber_sections(F.col("s")), lambda x: x["id"]).alias("numbered"), F.array_join(T.section_terms(F.col("s")), ",").alias("terms"),
    )


@query("retrieval_digests", f"SELECT p_partkey, 'all' || chr(10) || p_brand || ', ' || CASE WHEN p_size % 4 = 0 THEN 'Page 3' ELSE p_name END || chr(10) || {LINE_SQL} AS digest, p_type || ' · ' || CASE WHEN p_size % 4 = 0 THEN 'Page 3' ELSE p_name END AS preview FROM part")
def retrieval_digests(spark: SparkSession, d: str) -> DataFrame:
    rows = _sections(spark, d).withColumn("one", F.slice("sections", 1, 1))
    return rows.select("p_partkey", T.retrieval_digest(F.lit("all"), F.col("one")).alias("digest"), T.description_preview(F.col("p_type"), F.col("one")).alias("preview"))


@query("section_records", f"SELECT p_partkey::VARCHAR AS file_id, NULL AS section_id, 'about' || chr(10) || {LINE_SQL} AS text FROM part UNION ALL SELECT p_partkey::VARCHAR, 'a' || p_size, {LINE_SQL} FROM part WHERE p_size % 4 <> 0")
def section_records(spark: SparkSession, d: str) -> DataFrame:
    files = _sections(spark, d).select(F.col("p_partkey").cast("string").alias("file_id"), F.lit("about").alias("text"), F.slice("sections", 1, 1).alias("sections"))
    return search.section_records(files).select("file_id", "section_id", "text")


@query("entry_texts", "SELECT p_partkey, concat_ws(chr(10), 'Name: ' || p_name, 'Summary: ' || p_type, CASE WHEN p_size > 9 THEN 'Extra: ' || p_brand END) AS text FROM part")
def entry_texts(spark: SparkSession, d: str) -> DataFrame:
    text = T.entry_text(F.col("p_name"), F.col("p_type"), F.lit("  "), F.when(F.col("p_size") > 9, F.col("p_brand")))
    return read(spark, d, "part").select("p_partkey", text.alias("text"))


@query("short_term_search", "SELECT doc_id FROM documents WHERE contains(lower(source), 'we') OR contains(lower(lang), 'en')")
def short_term_search(spark: SparkSession, d: str) -> DataFrame:
    terms = T.short_terms(T.split_query(F.lit('longer "EN", we')))
    hit = F.exists(terms, lambda t: T.substring_match(t, [F.col("source"), F.col("lang")]))
    return read(spark, d, "documents").filter(hit).select("doc_id")


@query("rank_terms", "SELECT p_partkey, p_brand || ',' || p_type AS terms, '%' || p_type AS pattern FROM part")
def rank_terms(spark: SparkSession, d: str) -> DataFrame:
    asked = F.array("p_brand", F.lit("about"), "p_type", F.lower("p_type"), F.lit("abc"))
    rows = read(spark, d, "part").withColumn("t", T.rank_terms(asked))
    kept = F.filter("t", lambda t: t.isin(F.col("p_brand"), F.col("p_type")))
    return rows.select("p_partkey", F.array_join(kept, ",").alias("terms"), F.concat(F.lit("%"), F.get(T.query_patterns(F.concat(F.lit("the "), "p_type", F.lit(" of"))), F.lit(0))).alias("pattern"))


@query("citations", """SELECT p_partkey, 'm' || p_size AS marker, p_partkey || '-x' AS entry_id, p_name AS quote, p_size AS page FROM part""")
def citations(spark: SparkSession, d: str) -> DataFrame:
    note = F.concat(F.lit("Text.\n[^m"), "p_size", F.lit("]: entry_id="), "p_partkey", F.lit('-x quote="'), "p_name", F.lit('" page='), "p_size", F.lit(" — said\n[^z]: nothing"))
    rows = read(spark, d, "part").select("p_partkey", F.explode(T.parse_citations(note)).alias("c"))
    return rows.select("p_partkey", "c.marker", "c.entry_id", "c.quote", "c.page")


@query("text_scalars", """SELECT p_partkey, substr(sha1(array_to_string(list_sort([p_brand, p_type]), '|')), 1, 24) AS cluster, p_name <> p_type AS in_source, CASE p_size % 3 WHEN 0 THEN 'deep' WHEN 1 THEN 'quick' END AS mode, p_size % 2 = 0 AS heading,
CASE WHEN p_size BETWEEN 1 AND 3 THEN p_size END AS page FROM part""")
def text_scalars(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size")
    call = lambda mode, extra: F.struct(mode.cast("string").alias("mode"), F.struct(extra.cast("string").alias("mode")).alias("extra"))
    calls = F.array(call(F.lit("other"), F.when(k % 3 == 0, "deep")), call(F.when(k % 3 == 1, "quick"), F.lit(None)))
    return read(spark, d, "part").select(
        "p_partkey", T.cluster_id(F.array("p_type", "p_brand")).alias("cluster"), T.quote_in_source(F.upper("p_name"), F.concat(F.lit("The "), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("."))).alias("in_source"),
        T.last_mode(calls).alias("mode"), T.heading_matches(F.col("p_name"), F.concat(F.lit("## "), F.upper("p_name"), F.when(k % 2 == 0, ": more").otherwise("s"))).alias("heading"),
        T.page_of_label(F.array(F.lit("i"), F.lit("ii"), F.lit("iii")), F.concat(F.lit("p. "), k)).cast("int").alias("page"),
    )


@query("nested_ids", "SELECT o_orderkey, printf('%08d-0000-4000-8000-%012d', o_custkey, o_orderkey) || ',' || printf('%08d-0000-4000-8000-%012d', o_orderkey, 0) AS ids FROM orders")
def nested_ids(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.format_string("%08d-0000-4000-8000-%012d", "o_custkey", "o_orderkey"), F.format_string("%08d-0000-4000-8000-%012d", F.col("o_orderkey"), F.lit(0))
    value = F.struct(F.struct(a.alias("id"), F.lit("x").alias("y")).alias("first"), F.array(F.struct(b.alias("ref"), a.alias("again"))).alias("more"))
    return read(spark, d, "orders").select("o_orderkey", F.array_join(T.ids_in_nested(value), ",").alias("ids"))
