"""Queries of search, text, logs and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import logs
from sparkloom.functions import text as T
from sparkloom.operators import aggregates, evaluation, search, windows
from sparkloom.plans.registry import query
from sparkloom.plans.tables import LINES_SQL, log_lines, read, with_checkpoints
from sparkloom.sources.readers import route_format

_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_BM25 = rf"""
w AS (SELECT doc_id AS id, {_TOKENS.format("text")} AS ws FROM documents),
total AS (SELECT count(*) AS n, avg(len(ws)) AS avg_len FROM w),
q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS.format("text")}) AS t FROM benchmark),
tf AS (SELECT id, len, t, count(*) AS tf FROM (SELECT id, len(ws) AS len, unnest(ws) AS t FROM w) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
hits AS (SELECT query_id, id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))), 6) AS score
         FROM tf JOIN df USING (t) JOIN q USING (t), total GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hits QUALIFY rank <= 10),
qrels AS (SELECT item_id AS query_id, doc_id, 1 AS rel FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, bench = read(spark, d, "documents"), read(spark, d, "benchmark")
    queries = bench.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = search.bm25(docs, queries, "doc_id").withColumn("score", F.round("score", 6))
    ranked = search.top_per_query(hits, 10)
    terms = queries.select("query_id", F.col("query").alias("term"))
    qrels = _contained(docs, terms)
    return queries, ranked, qrels


def _contained(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, rel) where the text contains the passage as it is: passages are few words, so they are joined
    on one of them and verified. Spark broadcasts them while they are small."""
    word = lambda c: F.filter(F.split(c, "[^\\p{L}\\p{N}]+"), lambda t: t != "")
    inner = F.slice(word(F.col("term")), 2, 100)  # the first and last word may be cut
    asked = terms.select("query_id", "term", F.array_max(F.transform(F.slice(inner, F.lit(1), F.greatest(F.size(inner) - 1, F.lit(0))), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"].alias("w"))
    posting = docs.select("doc_id", "text", F.explode(F.array_distinct(word(F.col("text")))).alias("w"))
    return posting.join(asked, "w").filter(F.contains("text", "term")).select("query_id", "doc_id", F.lit(1).alias("rel"))


@query("bm25_top10", f"WITH {_BM25} SELECT query_id, id, score, rank FROM ranked")
def bm25_top10(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d)[1]


@query("bm25_metrics", f"""WITH {_BM25},
rel AS (SELECT q.*, r.rank, row_number() OVER (PARTITION BY q.query_id ORDER BY rel DESC, q.doc_id) AS i FROM qrels q LEFT JOIN ranked r ON r.query_id = q.query_id AND r.id = q.doc_id),
s AS (SELECT query_id, count(*) AS nr, min(rank) AS first_rank, max(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS h5, max(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS h10,
      round(count(*) FILTER (rank <= 5) / count(*), 6) AS r5, round(count(*) FILTER (rank <= 10) / count(*), 6) AS r10,
      round(coalesce(sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) END), 0) / sum(CASE WHEN i <= 5 THEN 1 / log2(i + 1) END), 6) AS n5,
      round(coalesce(sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END), 0) / sum(CASE WHEN i <= 10 THEN 1 / log2(i + 1) END), 6) AS n10,
      round(coalesce(1.0 / min(rank), 0), 6) AS mrr FROM rel GROUP BY 1)
SELECT count(s.query_id) AS evaluated, count(*) FILTER (s.query_id IS NULL) AS skipped, round(avg(mrr), 6) AS mrr, round(avg(h5), 6) AS hit_5, round(avg(r5), 6) AS recall_5, round(avg(n5), 6) AS ndcg_5,
       round(avg(h10), 6) AS hit_10, round(avg(r10), 6) AS recall_10, round(avg(n10), 6) AS ndcg_10,
       round(count(*) FILTER (s.query_id IS NOT NULL AND b.item_id NOT IN (SELECT query_id FROM ranked)) / greatest(count(s.query_id), 1), 6) AS zero_result_rate
FROM benchmark b LEFT JOIN s ON s.query_id = b.item_id""")  # fmt: skip
def bm25_metrics(spark: SparkSession, d: str) -> DataFrame:
    queries, ranked, qrels = _runs(spark, d)
    runs = ranked.select("query_id", F.col("id").alias("doc_id"), "rank")
    scored = evaluation.score_queries(runs, qrels, (5, 10))
    return evaluation.aggregate_metrics(scored, queries, runs, (5, 10))


@query("trigram_match", "SELECT item_id AS query_id, b.text AS term, doc_id AS id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))")
def trigram_match(spark: SparkSession, d: str) -> DataFrame:
    with_checkpoints(spark)
    terms = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("term"))
    return search.trigram_match(read(spark, d, "documents"), terms, "doc_id")


_TEXT_SQL = rf"""
WITH terms AS (SELECT item_id AS query_id, unnest(list_transform(regexp_split_to_array(text, '[\s,，、;；]+'), lambda x: trim(x, E' \t\r\n.,;:!?()[]{{}}"\''))) AS term FROM benchmark),
kinds AS (SELECT *, length(term) >= 3 AND NOT regexp_matches(term, '[\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}\x{{ac00}}-\x{{d7a3}}\x{{f900}}-\x{{faff}}]') AS word FROM terms WHERE term <> ''),
q AS (SELECT DISTINCT query_id, unnest({_TOKENS.format("term")}) AS t FROM kinds WHERE word),
e AS (SELECT conv_id || ':' || turn AS id, role, coalesce(text, '') AS text FROM conversations),
w AS (SELECT 0 AS g, id, {_TOKENS.format("role")} AS ws FROM e UNION ALL SELECT 1, id, {_TOKENS.format("text")} FROM e),
total AS (SELECT g, count(*) AS n, avg(len(ws)) AS avg_len FROM w GROUP BY g),
tf AS (SELECT g, id, len, t, count(*) AS tf FROM (SELECT g, id, len(ws) AS len, unnest(ws) AS t FROM w) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
df AS (SELECT g, t, count(*) AS df FROM tf GROUP BY ALL),
hits AS (SELECT query_id, id, ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len)) AS s FROM tf JOIN df USING (g, t) JOIN q USING (t) JOIN total USING (g)
         UNION ALL SELECT query_id, id, 0.0 FROM kinds JOIN e ON NOT word AND contains(lower(coalesce(role, '') || chr(10) || text), lower(term))),
summed AS (SELECT query_id, id, round(sum(s), 6) AS score FROM hits GROUP BY 1, 2)"""


@query("text_search", f"""{_TEXT_SQL}
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM summed QUALIFY rank <= 10""")
def text_search(spark: SparkSession, d: str) -> DataFrame:
    return search.top_per_query(_found_turns(spark, d)[0], 10)


def _found_turns(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    turns = read(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "role", "text")
    terms = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.split("text", "[\\s,，、;；]+")).alias("term")).withColumn("term", T.strip_punctuation(F.col("term")))
    return search.text_search(turns, terms, [["role"], ["text"]]).withColumn("score", F.round("score", 6)), terms


@query("ordered_search", f"""{_TEXT_SQL},
o AS (SELECT s.query_id, id, score, row_number() OVER (PARTITION BY s.query_id ORDER BY CASE WHEN s.query_id NOT IN (SELECT query_id FROM kinds WHERE NOT word) THEN score END DESC NULLS LAST, (hash_at * 7919) % 1000 DESC, id) AS rank
      FROM summed s JOIN (SELECT conv_id || ':' || turn AS id, turn + length(text) AS hash_at FROM conversations) USING (id) QUALIFY rank <= 10)
SELECT query_id, id, score, rank FROM o""")
def ordered_search(spark: SparkSession, d: str) -> DataFrame:
    """By score or, for passages with short words, the newest first."""
    hits, terms = _found_turns(spark, d)
    at = (F.col("turn") + F.length("text")) * 7919 % 1000
    updated = read(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), at.alias("updated_at"))
    return search.in_order(hits, terms, updated, 10)


@query("query_terms", r"""
WITH t AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, '[\s,，、;；]+'), lambda x: trim(x, E' \t\r\n.,;:!?()[]{}"''')), lambda x: x <> '') AS ts FROM benchmark),
u AS (SELECT item_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS i FROM t),
f AS (SELECT item_id, arg_min(term, i) AS term FROM u GROUP BY item_id, lower(term))
SELECT item_id, term, round(1.0 + CASE WHEN length(term) >= 7 THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(term, '[0-9]') THEN 1.0 ELSE 0 END + CASE WHEN regexp_matches(term, '\p{Lu}') THEN 0.6 ELSE 0 END
       + CASE WHEN regexp_matches(term, '[/+_.-]') THEN 0.4 ELSE 0 END, 6) AS weight
FROM f WHERE length(term) >= 3 AND lower(term) NOT IN ('about','after','against','and','are','does','from','have','into','than','that','the','their','this','with')""")  # fmt: skip
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = T.first_spelling(T.fts_terms(T.split_query(F.col("text"))))
    rows = read(spark, d, "benchmark").select("item_id", F.explode(terms).alias("term"))
    return rows.withColumn("weight", F.round(T.term_weight(F.col("term")), 6))


@query("summaries", r"""SELECT doc_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 500) AS summary, source || '_' || doc_id || '.txt' AS name,
array_to_string(list_concat(list_filter(['release','rollback','security','support','deploy','incident'], lambda w: contains(lower(source || ' ' || lang || ' ' || substr(text, 1, 4000)), w)), [lang]), '|') AS tags FROM documents""")
def summaries(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    name = T.safe_display_name(F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    return docs.select("doc_id", T.plain_summary(F.col("text")).alias("summary"), name.alias("name"), F.array_join(T.heuristic_tags(F.col("text"), F.col("lang"), F.col("source")), "|").alias("tags"))


@query("answer_labels", """SELECT conv_id, turn, CASE WHEN regexp_matches(l, 'insufficient|cannot be verified|not possible to') THEN 'INSUFFICIENT' WHEN regexp_matches(l, 'contradict|incorrect|does not support') THEN 'CONTRADICT'
WHEN regexp_matches(l, 'support|accurate|consistent with') THEN 'SUPPORT' END AS label FROM (SELECT conv_id, turn, lower(text) AS l FROM conversations)""")
def answer_labels(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", T.predict_label(F.col("text")).alias("label"))


@query("metadata_rank", rf"""
WITH c AS (SELECT item_id AS query_id, doc_id AS id, lower(d.text) AS low FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))),
t AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS.format("text")}) AS term FROM benchmark),
h AS (SELECT query_id, id, term, 22.0 * least((length(low) - length(replace(low, term, ''))) // length(term), 3) AS s, 1.0 + CASE WHEN length(term) >= 7 THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(term, '[0-9]') THEN 1.0 ELSE 0 END AS w FROM c JOIN t USING (query_id))
SELECT query_id, id, round((sum(s * w) + 5.0 * count(*) FILTER (s > 0) / count(*))::DOUBLE, 6)::DOUBLE AS score FROM h GROUP BY 1, 2""")
def metadata_rank(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage, ranked by its words."""
    with_checkpoints(spark)
    bench, docs = read(spark, d, "benchmark"), read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    whole = bench.select(F.col("item_id").alias("query_id"), F.col("text").alias("term"))
    terms = bench.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(search.tokens(F.col("text")))).alias("term"))
    hits = search.trigram_match(docs, whole).select("query_id", "id").distinct().join(docs, "id")
    return search.metadata_rank(hits, terms, [("text", 22.0)]).withColumn("score", F.round("score", 6))


@query("route_format", r"""SELECT page_id, CASE WHEN ext = 'log' THEN 'log' WHEN regexp_matches(name, '\.log\.[0-9]+$') THEN 'log' WHEN ext IN ('html', 'htm') THEN 'html' WHEN ext = 'eml' THEN 'email' WHEN ext IN ('zip', 'tar') THEN 'archive'
WHEN ext IN ('csv', 'tsv') THEN 'table' WHEN ext = 'md' THEN 'text' ELSE 'fallback' END AS pipeline FROM (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '\.([A-Za-z0-9]+)$', 1) AS ext, regexp_replace(url, '[?#].*$', '') AS name FROM pages)""")
def route_formats(spark: SparkSession, d: str) -> DataFrame:
    name = F.regexp_replace("url", "[?#].*$", "")
    return read(spark, d, "pages").select("page_id", route_format(F.lit(""), F.regexp_extract(name, "\\.([A-Za-z0-9]+)$", 1), name).alias("pipeline"))


@query("html_to_text")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    from sparkloom.sources.extract import html_to_text as run

    return run(read(spark, d, "pages"), "page_id")


@query("chunk_lines", """WITH RECURSIVE t AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), chr(10) || '$', ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM t),
r(doc_id, i, first, cost) AS (SELECT doc_id, i, i, length(line) + 1 FROM l WHERE i = 1 UNION ALL
  SELECT l.doc_id, l.i, CASE WHEN cost + length(line) + 1 > 1000 THEN l.i ELSE first END, CASE WHEN cost + length(line) + 1 > 1000 THEN 0 ELSE cost END + length(line) + 1 FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1)::INT AS chunk, first::INT AS line_start, max(i)::INT AS line_end, md5(string_agg(line, chr(10) ORDER BY i)) AS body FROM r JOIN l USING (doc_id, i) GROUP BY doc_id, first""")
def chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    return windows.chunk_lines(read(spark, d, "documents"), 1000).withColumn("body", F.md5(F.col("body").cast("binary")))


@query("grep_context", f"""WITH {LINES_SQL},
w AS (SELECT *, string_agg(text, chr(10)) OVER (PARTITION BY file ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM lines),
m AS (SELECT file, n, 0 AS pos, regexp_extract(text, '(error [^ ]*)', 1) AS match, context FROM w WHERE regexp_matches(text, 'error [^ ]*'))
SELECT *, count(*) OVER (PARTITION BY file) AS total, row_number() OVER (PARTITION BY file ORDER BY n, pos) AS rank FROM m""")
def grep_context(spark: SparkSession, d: str) -> DataFrame:
    with_checkpoints(spark)
    return windows.grep_context(log_lines(spark, d), "(?-i:error) [^ ]*", 2)


@query("log_summary", f"""WITH {LINES_SQL}, l AS (SELECT *, CASE WHEN text LIKE '% ERROR %' OR regexp_matches(text, '(?i)\\berror\\b') THEN 'ERROR' ELSE 'INFO' END AS level, substr(text, 1, 19) AS ts FROM lines)
SELECT file, level, count(*) AS lines, arg_min(ts, n) AS first_ts, arg_max(ts, n) AS last_ts FROM l GROUP BY 1, 2""")
def log_summary(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.log_summary(log_lines(spark, d))


@query("log_window", f"""WITH {LINES_SQL} SELECT file, n, text FROM lines WHERE substr(text, 1, 19) >= '2024-01-10T00:00:00' AND substr(text, 1, 19) < '2024-01-12T12:00:00' AND text LIKE '% ERROR %'""")
def log_window(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("text")
    since, until = F.lit("2024-01-10 00:00:00").cast("timestamp"), F.lit("2024-01-12 12:00:00").cast("timestamp")
    return log_lines(spark, d).filter(logs.has_level(line, "ERROR") & logs.at_or_above(logs.detect_level(line), "ERROR") & logs.in_window(line, since, until))


@query("count_pattern", f"""WITH {LINES_SQL} SELECT file, count(*) FILTER (regexp_matches(text, '(?i)purchase|click')) AS matches, count(*) AS lines, round(100.0 * count(*) FILTER (regexp_matches(text, '(?i)purchase|click')) / count(*), 4) AS percent FROM lines GROUP BY 1""")
def count_pattern(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.count_pattern(log_lines(spark, d), "purchase|click")


@query("top_values", f"""WITH {LINES_SQL}, v AS (SELECT file, n, regexp_extract(text, '"k": ([0-9]+)', 1) AS value FROM lines WHERE regexp_matches(text, '"k": ([0-9]+)')),
c AS (SELECT file, value, count(*) AS n, min(n) AS f FROM v GROUP BY 1, 2)
SELECT file, value, n, count(*) OVER (PARTITION BY file) AS "unique", sum(n) OVER (PARTITION BY file)::BIGINT AS total, row_number() OVER (PARTITION BY file ORDER BY n DESC, f) AS rank FROM c QUALIFY rank <= 5""")
def top_values(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.top_values(log_lines(spark, d), '"k": ([0-9]+)', 1, 5)


@query("time_distribution", f"WITH {LINES_SQL} SELECT file, replace(substr(text, 1, 13), 'T', ' ') || ':00' AS bucket, count(*) AS n FROM lines GROUP BY 1, 2")
def time_distribution(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.time_distribution(log_lines(spark, d), "hour")


@query("latency_report", """SELECT event_type, count(*) AS requests, round(min(v), 6) AS min_ms, round(quantile_cont(v, 0.5), 6) AS p50_ms, round(quantile_cont(v, 0.95), 6) AS p95_ms, round(quantile_cont(v, 0.99), 6) AS p99_ms,
round(max(v), 6) AS max_ms, round(avg(v), 6) AS mean_ms, round(avg(e::INT), 6) AS error_rate, round(count(*) FILTER (r <= 3) / count(*), 6) AS hit, round(coalesce(sum(1.0 / r), 0) / count(*), 6) AS mrr, NULL::DOUBLE AS rps
FROM (SELECT event_type, value, value > 50 AS e, CASE WHEN value <= 50 THEN value END AS v, CASE WHEN value <= 50 THEN 1 + floor(value)::INT END AS r FROM events) GROUP BY 1""")
def latency_report(spark: SparkSession, d: str) -> DataFrame:
    with_checkpoints(spark)
    e = read(spark, d, "events").withColumn("error", F.col("value") > 50)
    rows = e.withColumns({"latency_ms": F.col("value"), "first_rank": F.when(~F.col("error"), 1 + F.floor("value").cast("int"))})
    return evaluation.latency_report(rows, 3, ["event_type"])
