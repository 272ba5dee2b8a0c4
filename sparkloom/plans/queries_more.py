"""Queries of extractors, overviews and review bundles."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import aggregates, filters, funnel, joins, vectors
from sparkloom.plans.registry import query
from sparkloom.plans.tables import read, scratch
from sparkloom.sources import extract, readers


@query("archived_texts", """SELECT doc_id::VARCHAR AS archive, m.path, octet_length(encode(m.body)) AS size, md5(m.body) AS body
FROM (SELECT doc_id, unnest([{'path': 'a/' || lang || '.txt', 'body': coalesce(text, '')}, {'path': 'note.md', 'body': source}]) AS m FROM documents)""")
def archived_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each document packed as an archive, with members that are left out, and unpacked again."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            packed = []
            for text, lang, source in zip(f["text"], f["lang"], f["source"], strict=True):
                with zipfile.ZipFile(data := io.BytesIO(), "w", zipfile.ZIP_DEFLATED) as z:
                    for name, body in ((f"a/{lang}.txt", text or ""), ("note.md", source), ("../up.txt", "x"), ("node_modules/x.js", "x"), (".git/objects/1", "x"), ("a/b.pyc", "x")):
                        z.writestr(name, body)
                packed.append(data.getvalue())
            yield pd.DataFrame({"path": f["path"], "content": packed})

    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", "lang", "source")
    members = extract.explode_archive(docs.mapInPandas(pack, "path string, content binary"))
    return members.select("archive", "path", "size", F.md5("bytes").alias("body"))


@query("mailed_texts", """SELECT doc_id::VARCHAR AS path, 'About ' || source AS subject, lang || '@example.com' AS sender, md5(coalesce(text, '')) AS text, 1::BIGINT AS attachments, doc_id % 7 AS size FROM documents""")
def mailed_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a mail with an attachment, read again."""
    line = "\r\n"
    head = F.concat(F.lit("Subject: About "), "source", F.lit(f"{line}From: "), "lang", F.lit(f'@example.com{line}MIME-Version: 1.0{line}Content-Type: multipart/mixed; boundary="=b="{line}{line}'))
    body = F.concat(F.lit(f"--=b={line}Content-Type: text/plain; charset=utf-8{line}Content-Transfer-Encoding: base64{line}{line}"), F.base64(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    file = F.concat(F.lit(f'{line}--=b={line}Content-Type: application/octet-stream{line}Content-Disposition: attachment; filename="a.bin"{line}{line}'), F.repeat(F.lit("x"), (F.col("doc_id") % 7).cast("int")), F.lit(f"{line}--=b=--{line}"))
    mails = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode(F.concat(head, body, file), "UTF-8").alias("content"))
    return extract.extract_email(mails).select("path", "subject", "sender", F.md5(F.col("text").cast("binary")).alias("text"), F.size("attachments").cast("bigint").alias("attachments"), F.get("attachments", F.lit(0))["size"].alias("size"))


@query("coverage_keys", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN event_type END AS unit, CASE WHEN user_id % 2 = 0 THEN 2 END::INT AS keys FROM events")
def coverage_keys(spark: SparkSession, d: str) -> DataFrame:
    known = F.create_map(F.lit("unit"), "event_type", F.lit("total_rows"), F.col("event_id").cast("string"), F.lit("secret"), "props")
    kept = funnel.compact_coverage(F.when(F.col("user_id") % 2 == 0, known).otherwise(F.create_map(F.lit("secret"), "props")))
    return read(spark, d, "events").withColumn("c", kept).select("event_id", F.element_at("c", "unit").alias("unit"), F.when(F.col("c").isNotNull(), F.size("c")).alias("keys"))


@query("cited_documents", """WITH k AS (SELECT doc_id, md5(doc_id::VARCHAR) AS id FROM documents), a AS (SELECT doc_id AS answer_id, md5(doc_id::VARCHAR)[1:12] AS p FROM labels UNION SELECT doc_id, md5((doc_id + 1)::VARCHAR) FROM labels WHERE quality = 1),
r AS (SELECT answer_id, p, min(id) AS doc_id, count(*) AS n FROM a JOIN k ON starts_with(id, p) GROUP BY 1, 2) SELECT DISTINCT answer_id, doc_id FROM r WHERE n = 1""")
def cited_documents(spark: SparkSession, d: str) -> DataFrame:
    """Answers that cite documents by the begin of their ids, whole ids and begins that are too short."""
    sha = lambda c: F.md5(c.cast("string").cast("binary"))
    k = F.col("doc_id")
    text = F.concat(F.lit("See entry_id = `"), F.substring(sha(k), 1, 12), F.lit("` and entry:"), F.substring(sha(k), 1, 5), F.when(F.col("quality") == 1, F.concat(F.lit(", entry_id="), sha(k + 1), F.lit("."))).otherwise(""))
    known = read(spark, d, "documents").select(sha(k).alias("id"), F.col("source").alias("name"))
    return funnel.cited_docs(read(spark, d, "labels").select(k.alias("answer_id"), text.alias("answer")), known)


def _entries(spark: SparkSession, d: str) -> DataFrame:
    gone = F.when(F.col("c_acctbal") < 0, F.lit("2024-01-01").cast("timestamp"))
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("catalog_id"), gone.alias("deleted_at"), F.col("c_acctbal").alias("created_at"), F.col("c_acctbal").alias("updated_at"))


@query("overview", """SELECT 'entries' AS name, count(*) AS n FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'folders', count(*) FROM nation WHERE n_regionkey > 0 UNION ALL SELECT 'tags', count(*) FROM part UNION ALL SELECT 'tasks:' || o_orderstatus, count(*) FROM orders GROUP BY 1""")
def overview(spark: SparkSession, d: str) -> DataFrame:
    folders = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") == 0, F.lit("2024-01-01")).alias("deleted_at"))
    return funnel.corpus_overview(_entries(spark, d), folders, read(spark, d, "part"), read(spark, d, "orders").withColumn("status", F.col("o_orderstatus")))[0]


def _catalogs(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, "top").otherwise(none).alias("parent_id"), none.alias("deleted_at"))


@query("context_catalogs", "SELECT n_nationkey AS id, n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal >= 0) AS entries FROM nation WHERE n_nationkey % 3 <> 0")
def context_catalogs(spark: SparkSession, d: str) -> DataFrame:
    views, tags = read(spark, d, "region").select(F.col("r_name").alias("name")), read(spark, d, "part").select(F.lit(None).alias("alias_of"), F.col("p_brand").alias("facet"), F.col("p_size").alias("doc_count"), F.col("p_name").alias("name"))
    notes = read(spark, d, "events").select(F.col("event_id").alias("note_id"), F.col("ts").alias("created_at"))
    return funnel.context_snapshot(_catalogs(spark, d), _entries(spark, d), views, tags, notes, F.lit("2024-01-20").cast("timestamp"))["catalogs"].select("id", "name", "entries")


@query("context_tags", """SELECT facet, name, doc_count, row_number() OVER (PARTITION BY facet ORDER BY doc_count DESC, name) AS rank FROM (SELECT p_brand AS facet, p_name || ' ' || p_partkey AS name, p_size AS doc_count FROM part WHERE p_partkey % 5 > 0) QUALIFY rank <= 10""")
def context_tags(spark: SparkSession, d: str) -> DataFrame:
    tags = read(spark, d, "part").select(F.when(F.col("p_partkey") % 5 == 0, 1).alias("alias_of"), F.col("p_brand").alias("facet"), F.col("p_size").alias("doc_count"), F.concat_ws(" ", "p_name", "p_partkey").alias("name"))
    notes = read(spark, d, "events").select(F.col("event_id").alias("note_id"), F.col("ts").alias("created_at"))
    return funnel.context_snapshot(_catalogs(spark, d), _entries(spark, d), read(spark, d, "region").select(F.col("r_name").alias("name")), tags, notes, F.lit("2024-01-20").cast("timestamp"))["tags"].select("facet", "name", "doc_count", "rank")


@query("catalog_review", """WITH e AS (SELECT o_orderkey AS id, o_orderdate AS day FROM orders WHERE o_orderstatus <> 'F' ORDER BY day DESC, id LIMIT 30)
SELECT id, coalesce(array_to_string(list_sort(list(DISTINCT l_returnflag) FILTER (l_returnflag IS NOT NULL)), ','), '') AS tags FROM e LEFT JOIN lineitem ON l_orderkey = id GROUP BY id""")
def catalog_review(spark: SparkSession, d: str) -> DataFrame:
    """The entries updated last, with their tags."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("catalog_id"), F.col("o_orderdate").alias("updated_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("deleted_at"))
    tags = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("entry_id"), F.col("l_returnflag").alias("name"))
    notes = read(spark, d, "events").select(F.col("event_id").alias("note_id"), F.col("ts").alias("created_at"), F.array("event_type").alias("tags"))
    return funnel.catalog_review(_catalogs(spark, d), o, tags, notes)["entries"].select("id", F.coalesce(F.array_join("tags", ","), F.lit("")).alias("tags"))


@query("direct_counts", "SELECT n_nationkey AS id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal >= 0) AS entries FROM nation")
def direct_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.direct_counts(_catalogs(spark, d), _entries(spark, d)).select("id", "entries")


@query("newest_orders", "SELECT * FROM (SELECT o_orderkey AS id, 'new' AS kind FROM orders ORDER BY o_orderdate DESC, id LIMIT 25) UNION ALL SELECT * FROM (SELECT o_orderkey AS id, 'old' FROM orders ORDER BY o_orderdate, id LIMIT 25)")
def newest_orders(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate")
    new, old = filters.newest(o, "o_orderdate", "id", 25), filters.newest(o, "o_orderdate", "id", 25, oldest=True)
    return new.select("id", F.lit("new").alias("kind")).unionByName(old.select("id", F.lit("old").alias("kind")))


@query("unsold_parts", "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_partkey % 10 = s_suppkey % 10 WHERE (p_partkey, s_suppkey) NOT IN (SELECT l_partkey, l_suppkey FROM lineitem)")
def unsold_parts(spark: SparkSession, d: str) -> DataFrame:
    p, s = read(spark, d, "part").select("p_partkey"), read(spark, d, "supplier").select("s_suppkey")
    sold = read(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"))
    return joins.missing_pairs(p, s, (F.col("p_partkey") % 10, F.col("s_suppkey") % 10), sold, "p_partkey", "s_suppkey")


@query("vector_files", "SELECT vec_id, embedding[1] AS x FROM embeddings WHERE label % 2 = 1")
def vector_files(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written by model and read back where the manifest allows it."""
    path = scratch(spark)
    rows = read(spark, d, "embeddings").select("vec_id", F.col("label").alias("entry_id"), F.lit("p").alias("provider"), F.concat(F.lit("m"), F.col("label") % 2).alias("model"), F.lit(64).alias("dims"), "embedding")
    vectors.write_table(rows, path, 2)
    return vectors.read_table(spark, path, 2, "p", "m1", 64).select("vec_id", F.get("embedding", F.lit(0)).alias("x"))


@query("routed_files", """SELECT page_id, 'html' AS pipeline, 1 AS pieces FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'log', len(string_split(url || chr(10) || url, chr(10))) FROM pages WHERE page_id % 3 = 1 UNION ALL SELECT page_id, 'table', 2 FROM pages WHERE page_id % 3 = 2""")
def routed_files(spark: SparkSession, d: str) -> DataFrame:
    """Pages as files of three kinds, each through the extractor of its route."""
    k = F.col("page_id") % 3
    body = F.when(k == 0, F.col("html")).when(k == 1, F.concat_ws("\n", "url", "url")).otherwise(F.concat(F.lit('id,"a\nb"\n1,'), F.lit("x")))
    ext = F.element_at(F.array(F.lit("html"), F.lit("log"), F.lit("csv")), (k + 1).cast("int"))
    files = read(spark, d, "pages").select(F.concat("page_id", F.lit("."), ext).alias("path"), F.encode(body, "UTF-8").alias("content"), readers.route_format(F.lit(""), ext, F.lit("")).alias("pipeline"))
    out = extract.extract_by_route(files)
    parts = [out[name].groupBy("path").agg(F.count("*").cast("int").alias("pieces")).withColumn("pipeline", F.lit(name)) for name in ("html", "log", "table")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(F.substring_index("path", ".", 1).cast("bigint").alias("page_id"), "pipeline", "pieces")
