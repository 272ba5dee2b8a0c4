"""Queries of relation mining, graphs, hierarchies, vectors and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import evaluation, graph, joins, mining, recall, vectors
from sparkloom.plans.registry import query
from sparkloom.plans.tables import PAIRS_SQL, part_pairs, read, scratch, with_checkpoints

PAIRS2, PAIRS3 = PAIRS_SQL.format(least=2), PAIRS_SQL.format(least=3)


_OVERLAP_SQL = """WITH et AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS t FROM lineitem), ok AS (SELECT t FROM et GROUP BY 1 HAVING count(*) BETWEEN 2 AND 40),
seeds AS (SELECT DISTINCT x.e AS a, y.e AS b FROM et x JOIN ok USING (t) JOIN et y ON y.t = x.t AND x.e < y.e), n AS (SELECT e, count(*) AS n FROM et GROUP BY 1),
s AS (SELECT a, b, count(*) AS shared FROM seeds JOIN et x ON x.e = a JOIN et y ON y.e = b AND y.t = x.t GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT a, b, shared, round(shared / (na.n + nb.n - shared), 6) AS jaccard, greatest(1, ceil(round(10 * shared / (na.n + nb.n - shared), 9)))::INT AS weight
FROM s JOIN n na ON na.e = a JOIN n nb ON nb.e = b WHERE shared / (na.n + nb.n - shared) >= 0.3"""


@query("tag_overlap_pairs", _OVERLAP_SQL)
def tag_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    return graph.tag_overlap_pairs(read(spark, d, "lineitem"), entry="l_orderkey", tag="l_partkey").withColumn("jaccard", F.round("jaccard", 6))


@query("mined_pages", _OVERLAP_SQL)
def mined_pages(spark: SparkSession, d: str) -> DataFrame:
    """Three pages of entries, with a change of tags after the first: the same pairs as of all at once."""
    with_checkpoints(spark)
    lines = read(spark, d, "lineitem")
    other = F.when((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "R"), F.col("l_suppkey")).otherwise(F.col("l_partkey"))

    def tags(tag):  # written once: each step reads them several times
        path = scratch(spark)
        lines.select(F.col("l_orderkey").alias("e"), tag.alias("t")).distinct().write.parquet(path)
        return spark.read.parquet(path)

    now, before = tags(F.col("l_partkey")), tags(other)
    state = F.max("_now").alias("added"), F.min("_now").alias("_all")
    both = now.withColumn("_now", F.lit(True)).unionByName(before.withColumn("_now", F.lit(False)))
    changes = both.groupBy("e", "t").agg(*state).filter(F.col("added") == F.col("_all")).drop("_all").checkpoint()
    table = mining.PairTable(spark, scratch(spark))
    third = -(-now.select("e").distinct().count() // 3)
    table.next_page(before, third)
    table.apply(now, changes)
    while not table.next_page(now, third)["complete"]:
        pass
    return table.pairs().withColumn("jaccard", F.round("jaccard", 6))


@query("path_ids", """WITH p AS (SELECT p_partkey AS id, '/' || p_brand || '/' || p_name AS path, p_name AS name FROM part), asked AS (SELECT DISTINCT unnest([path, name, path || '/none']) AS raw FROM p),
m AS (SELECT raw, id FROM asked JOIN p ON raw = path UNION SELECT raw, id FROM asked JOIN p ON raw = name)
SELECT raw, CASE count(id) WHEN 0 THEN 'not_found' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN count(id) = 1 THEN min(id) END AS id FROM asked LEFT JOIN m USING (raw) GROUP BY raw""")
def path_ids(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_name").alias("path"), "p_name")
    return joins.path_to_id(p.select(F.explode(F.array("path", "p_name", F.concat("path", F.lit("/none")))).alias("raw")).distinct(), p.select("id", "path"))


@query("cooccurrence_pairs", f"WITH {PAIRS2} SELECT a, b, n FROM pairs")
def cooccurrence_pairs(spark: SparkSession, d: str) -> DataFrame:
    return part_pairs(spark, d)


@query("neighbours", f"""WITH {PAIRS2}, s AS (SELECT a AS entry, b AS other, n FROM pairs UNION ALL SELECT b, a, n FROM pairs)
SELECT *, row_number() OVER (PARTITION BY entry ORDER BY n DESC, other) AS rank FROM s QUALIFY rank <= 5""")
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    return joins.neighbours(part_pairs(spark, d), 5)


@query("one_hop", f"""WITH {PAIRS2}, s AS (SELECT a AS entry, b AS other, n FROM pairs UNION ALL SELECT b, a, n FROM pairs), q AS (SELECT p_brand || p_type AS query_id, p_partkey AS entry FROM part)
SELECT q.query_id, s.other, max(n) AS count, array_to_string(list_sort(list(DISTINCT s.entry)), ',') AS anchors FROM s JOIN q ON q.entry = s.entry
WHERE NOT EXISTS (SELECT 1 FROM q z WHERE z.query_id = q.query_id AND z.entry = s.other) GROUP BY 1, 2""")
def one_hop(spark: SparkSession, d: str) -> DataFrame:
    anchors = read(spark, d, "part").select(F.concat("p_brand", "p_type").alias("query_id"), F.col("p_partkey").alias("entry"))
    return joins.one_hop(part_pairs(spark, d), anchors).withColumn("anchors", F.array_join("anchors", ","))


@query("frequent_tag_sets", """WITH et AS (SELECT DISTINCT o_custkey AS e, p_brand AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
SELECT x.t AS t1, y.t AS t2, z.t AS t3, count(*) AS support FROM et x JOIN et y ON x.e = y.e AND x.t < y.t JOIN et z ON z.e = x.e AND y.t < z.t GROUP BY 1, 2, 3 HAVING count(*) >= 10""")
def frequent_tag_sets(spark: SparkSession, d: str) -> DataFrame:
    li, o, p = (read(spark, d, t) for t in ("lineitem", "orders", "part"))
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"])
    with_checkpoints(spark)
    return graph.frequent_tag_sets(rows, 10, "o_custkey", "p_brand")


@query("frequent_tag_quads", """WITH et AS (SELECT DISTINCT l_orderkey AS e, p_brand AS t FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT a.t AS t1, b.t AS t2, c.t AS t3, d.t AS t4, count(*) AS support FROM et a JOIN et b ON a.e = b.e AND a.t < b.t JOIN et c ON c.e = a.e AND b.t < c.t JOIN et d ON d.e = a.e AND c.t < d.t GROUP BY 1, 2, 3, 4 HAVING count(*) >= 4""")
def frequent_tag_quads(spark: SparkSession, d: str) -> DataFrame:
    with_checkpoints(spark)
    li, p = read(spark, d, "lineitem"), read(spark, d, "part")
    return graph.frequent_tag_sets(li.join(p, li["l_partkey"] == p["p_partkey"]), 4, "l_orderkey", "p_brand", 4)


@query("recent_pairs", """WITH o AS (SELECT DISTINCT l_suppkey AS s, date_trunc('month', l_shipdate) AS m, l_partkey AS p FROM lineitem WHERE date_trunc('month', l_shipdate) >= TIMESTAMP '2001-12-01' - INTERVAL 900 DAY)
SELECT x.p AS a, y.p AS b, count(*) AS n FROM o x JOIN o y ON x.s = y.s AND x.m = y.m AND x.p < y.p GROUP BY 1, 2 HAVING count(*) >= 2""")
def recent_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a supplier's month together, in the last 900 days."""
    with_checkpoints(spark)
    months = read(spark, d, "lineitem").groupBy("l_suppkey", F.date_trunc("month", "l_shipdate").alias("month")).agg(F.collect_set("l_partkey").alias("entry_ids"))
    return graph.cooccurrence_pairs(months, at="month", now=F.lit("2001-12-01").cast("timestamp"), days=900)


@query("connected_components", f"""WITH RECURSIVE {PAIRS3}, s AS (SELECT a AS u, b AS v FROM pairs UNION SELECT b, a FROM pairs),
r(node, label) AS (SELECT u, u FROM s UNION SELECT s.v, r.label FROM r JOIN s ON s.u = r.node) SELECT node, min(label) AS component FROM r GROUP BY 1""")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    with_checkpoints(spark)
    return graph.connected_components(part_pairs(spark, d, 3))


@query("component_shared_tags", f"""WITH RECURSIVE {PAIRS3}, s AS (SELECT a AS u, b AS v FROM pairs UNION SELECT b, a FROM pairs),
r(node, label) AS (SELECT u, u FROM s UNION SELECT s.v, r.label FROM r JOIN s ON s.u = r.node), c AS (SELECT node, min(label) AS component FROM r GROUP BY 1),
z AS (SELECT component, count(*) AS members FROM c GROUP BY 1 HAVING count(*) >= 2),
t AS (SELECT component, p_type AS tag, count(*) AS n FROM c JOIN part ON p_partkey = node GROUP BY 1, 2)
SELECT component, members, array_to_string(list_sort(list(tag)), ',') AS tags FROM t JOIN z USING (component) WHERE n = members GROUP BY 1, 2""")
def component_shared_tags(spark: SparkSession, d: str) -> DataFrame:
    with_checkpoints(spark)
    tags = read(spark, d, "part").select(F.col("p_partkey").alias("entry"), F.col("p_type").alias("tag"))
    out = graph.component_shared_tags(graph.connected_components(part_pairs(spark, d, 3)), tags, 2)
    return out.withColumn("tags", F.array_join("tags", ","))


def _walk_sql(steps: int) -> str:
    ctes = [f"{PAIRS3}", "e AS (SELECT a AS u, b AS v, n::DOUBLE AS w FROM pairs UNION ALL SELECT b, a, n FROM pairs)", "m AS (SELECT u, v, w / sum(w) OVER (PARTITION BY u) AS p FROM e)", "seeds AS (SELECT DISTINCT u AS seed FROM e)", "at0 AS (SELECT seed, seed AS node, 1.0::DOUBLE AS mass FROM seeds)"]
    for i in range(steps):
        ctes.append(f"mv{i} AS (SELECT seed, v AS node, 0.85 * sum(mass * p) AS mass FROM at{i} JOIN m ON node = u WHERE v <> seed GROUP BY 1, 2)")
        ctes.append(f"at{i + 1} AS (SELECT * FROM mv{i} UNION ALL SELECT s.seed, s.seed, 1 - coalesce(sum(mass), 0) FROM seeds s LEFT JOIN mv{i} ON mv{i}.seed = s.seed GROUP BY 1)")
    union = " UNION ALL ".join(f"SELECT * FROM mv{i}" for i in range(steps))
    return f"WITH {', '.join(ctes)}, v AS ({union}), g AS (SELECT seed, node, sum(mass) AS e FROM v GROUP BY 1, 2), t AS (SELECT *, round(e / sum(e) OVER (PARTITION BY seed), 6) AS score FROM g) SELECT seed, node, score FROM t"


@query("random_walk", _walk_sql(6))
def random_walk(spark: SparkSession, d: str) -> DataFrame:
    with_checkpoints(spark)
    edges = graph.symmetric_edges(part_pairs(spark, d, 3)).checkpoint()
    return graph.random_walk(edges, edges.select(F.col("u").alias("seed")).distinct(), top_k=None).withColumn("score", F.round("score", 6))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 4)).cast("bigint").alias("parent_id"), F.col("p_brand").alias("name"))


_TREE = "nodes AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN p_partkey // 4 END AS parent_id, p_brand AS name FROM part), c(ancestor, id, depth) AS (SELECT id, id, 0 FROM nodes UNION ALL SELECT n.parent_id, c.id, c.depth + 1 FROM c JOIN nodes n ON n.id = c.ancestor WHERE n.parent_id IS NOT NULL)"


@query("subtree_rollup", f"WITH RECURSIVE {_TREE} SELECT ancestor AS root, l_linestatus AS status, count(l_linestatus) AS n FROM c LEFT JOIN lineitem ON l_partkey = c.id GROUP BY 1, 2")
def subtree_rollup(spark: SparkSession, d: str) -> DataFrame:
    with_checkpoints(spark)
    nodes = _nodes(spark, d)
    entries = read(spark, d, "lineitem").select(F.col("l_partkey").alias("folder"), F.col("l_linestatus").alias("status"))
    return joins.subtree_rollup(joins.closure(nodes), entries, nodes.select(F.col("id").alias("root")))


@query("folder_paths", f"WITH RECURSIVE {_TREE} SELECT c.id, '/' || array_to_string(list(n.name ORDER BY depth DESC), '/') AS path FROM c JOIN nodes n ON n.id = c.ancestor GROUP BY 1")
def folder_paths(spark: SparkSession, d: str) -> DataFrame:
    with_checkpoints(spark)
    nodes = _nodes(spark, d)
    return joins.paths(joins.closure(nodes), nodes)


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, d, "embeddings")
    records = e.select(F.col("vec_id").alias("entry_id"), F.col("label").cast("string").alias("section_id"), "embedding")
    return records, e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


_DOT = "list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_DIST = "1 / (1 + sqrt(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))))"


def _knn_sql(score: str, k: int) -> str:
    return f"SELECT q.vec_id AS query_id, e.vec_id AS entry_id, e.label::VARCHAR AS section_id, round({score}, 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({score}, 6) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 QUALIFY rank <= {k}"


@query("knn", _knn_sql(_DOT, 10))
def knn(spark: SparkSession, d: str) -> DataFrame:
    return vectors.knn(*_vectors(spark, d), 10)


@query("knn_distance", _knn_sql(_DIST, 10).replace("round(1 / (1", "round(1 / (1"))
def knn_distance(spark: SparkSession, d: str) -> DataFrame:
    return vectors.knn(*_vectors(spark, d), 10, euclid=True)


@query("l2_normalize", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm, 1.0::DOUBLE AS unit FROM embeddings")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    norm = lambda v: F.sqrt(vectors.dot(v, v))
    v = F.col("embedding")
    return read(spark, d, "embeddings").select("vec_id", F.round(norm(v), 4).alias("norm"), F.round(norm(vectors.l2_normalize(v)), 4).alias("unit"))


def _fused(spark: SparkSession, d: str) -> DataFrame:
    records, queries = _vectors(spark, d)
    semantic, text = vectors.knn(records, queries, 20), vectors.knn(records, queries, 20, euclid=True).withColumn("rank", 21 - F.col("rank"))
    return recall.union_candidates({"semantic": semantic, "metadata_text": text})


_FUSED = f"""s AS ({_knn_sql(_DOT, 20)}), x AS ({_knn_sql(_DIST, 20)}),
u AS (SELECT query_id, entry_id, 'semantic' AS source, rank FROM s UNION ALL SELECT query_id, entry_id, 'metadata_text', 21 - rank FROM x),
f AS (SELECT query_id, entry_id, max((source = 'semantic')::INT) = 1 AS sem, max((source = 'metadata_text')::INT) = 1 AS lex, min(rank) FILTER (source = 'metadata_text') AS lr, min(rank) FILTER (source = 'semantic') AS sr FROM u GROUP BY 1, 2),
g AS (SELECT *, round(1000 * (coalesce(1 / (60.0 + lr), 0) + coalesce(1 / (60.0 + sr), 0)) + CASE WHEN sem AND lex THEN 1.5 ELSE 0 END, 4) AS score, CASE WHEN sem AND lex THEN 'overlap' WHEN lex THEN 'lexical' ELSE 'semantic' END AS bucket FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank FROM g)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    r = recall.rrf(F.col("tag_rank"), F.col("lexical_rank"), F.col("semantic_rank"))
    rows = _fused(spark, d).withColumn("score", F.round(1000 * r + recall.source_overlap(F.col("matched_by")), 4))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id")))


@query("fused_rank", f"WITH {_FUSED} SELECT query_id, entry_id, score, rank FROM h")
def fused_rank(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("query_id", "entry_id", "score", "rank")


@query("quota_select", f"""WITH {_FUSED}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY rank) AS k FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (k <= CASE bucket WHEN 'overlap' THEN 4 WHEN 'lexical' THEN 2 ELSE 2 END) DESC, rank) AS o FROM b QUALIFY o <= 10)
SELECT query_id, entry_id, bucket, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pos FROM o""")
def quota_select(spark: SparkSession, d: str) -> DataFrame:
    return recall.quota_select(_scored(spark, d), 10).select("query_id", "entry_id", "bucket", "pos")


@query("rerank", f"""WITH {_FUSED} SELECT h.query_id, h.entry_id, row_number() OVER (PARTITION BY h.query_id ORDER BY (rank > 10), CASE WHEN rank <= 10 THEN s.score END DESC NULLS LAST, rank) AS new_pos FROM h LEFT JOIN (SELECT query_id, entry_id, score FROM s) s USING (query_id, entry_id)""")
def rerank(spark: SparkSession, d: str) -> DataFrame:
    records, queries = _vectors(spark, d)
    scores = vectors.knn(records, queries, 20).select("query_id", "entry_id", F.col("score").alias("rerank_score"))
    hits = _scored(spark, d).select("query_id", "entry_id", F.col("rank").alias("pos"))
    return recall.rerank_apply(hits, scores, 10).select("query_id", "entry_id", "new_pos")


@query("ablation", f"""WITH {_FUSED}, runs AS (SELECT 'semantic' AS config, query_id, entry_id, rank FROM s UNION ALL SELECT 'distance', query_id, entry_id, rank FROM x UNION ALL SELECT 'fused', query_id, entry_id, rank FROM h),
rel AS (SELECT c.config, q.vec_id AS query_id, e.vec_id AS entry_id FROM (SELECT DISTINCT config FROM runs) c, embeddings q JOIN embeddings e ON e.label = q.label WHERE q.vec_id % 100 = 0),
m AS (SELECT config, query_id, round(coalesce(1.0 / min(rank), 0), 6) AS mrr, round(count(*) FILTER (rank <= 10) / count(*), 6) AS recall_10 FROM rel LEFT JOIN runs USING (config, query_id, entry_id) GROUP BY 1, 2),
a AS (SELECT config, round(avg(mrr), 6) AS mrr, round(avg(recall_10), 6) AS recall_10 FROM m GROUP BY 1)
SELECT config, mrr, recall_10, round(mrr - (SELECT mrr FROM a WHERE config = 'semantic'), 6) AS delta_mrr, round(recall_10 - (SELECT recall_10 FROM a WHERE config = 'semantic'), 6) AS delta_recall_10 FROM a""")
def ablation(spark: SparkSession, d: str) -> DataFrame:
    records, queries = _vectors(spark, d)
    e = read(spark, d, "embeddings").select("vec_id", "label")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    qrels = q.join(e, "label").select("query_id", F.col("vec_id").alias("doc_id"), F.lit(1).alias("rel"))
    runs = {"semantic": vectors.knn(records, queries, 20), "distance": vectors.knn(records, queries, 20, euclid=True), "fused": _scored(spark, d)}
    out = None
    for name, run in runs.items():
        scored = evaluation.score_queries(run.select("query_id", F.col("entry_id").alias("doc_id"), "rank"), qrels, (10,))
        row = scored.agg(F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg("recall_10"), 6).alias("recall_10")).withColumn("config", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return evaluation.ablation(out, "semantic", ["mrr", "recall_10"])


@query("recall_funnel")
def recall_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages as queries; documents by text, and by the vector of the same number."""
    from sparkloom.operators import funnel, search

    docs, bench = read(spark, d, "documents"), read(spark, d, "benchmark")
    records, _ = _vectors(spark, d)
    queries = bench.join(read(spark, d, "embeddings"), F.col("vec_id") == F.col("item_id")).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), "embedding")
    lexical = search.top_per_query(search.bm25(docs, queries, "doc_id").withColumn("score", F.round("score", 6)), 100)
    sources = {"metadata_text": lexical.select("query_id", F.col("id").alias("entry_id"), "rank"), "semantic": vectors.knn(records, queries, 100)}
    entries = docs.select(
        F.col("doc_id").alias("entry_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("display_name"), F.substring("text", 1, 500).alias("summary"), F.col("lang").alias("kind"),
        F.lit(False).alias("indexed_partial"), F.lit(0).alias("chunk_count"), F.lit(False).alias("truncated"),
    )
    return funnel.recall_funnel(queries, entries, sources, funnel.RecallOptions(10), records)
