"""Metadata search: posting tables, trigram match, BM25 order, weighted ranking."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T

K1, B = 1.2, 0.75
#: Terms, and their characters, that trigram_match sends to all tasks.
SCAN_TERMS, SCAN_CHARS = 50_000, 8 << 20
#: Words of all queries up to which bm25() sends them to all tasks, and hits that it then leaves to a task at most.
SCORED_WORDS, TASK_HITS = 200_000, 1_000_000


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def trigrams(text: Column) -> Column:
    """Distinct strings of three characters, lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("(?s)(?=(...))"), F.lit(1)))


def _scanned(source: DataFrame, terms: list[str]) -> DataFrame:
    """(id, low): which of the terms each text (id, _low) has; one pass of an automaton of all terms over each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            automaton.add_word(term, i)
        automaton.make_automaton()
        for batch in batches:
            place, found = [], []
            for row, text in enumerate(batch.column(1)):
                hits = {i for _, i in automaton.iter(text.as_py())}
                place += [row] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place, pa.int32())), pa.array([terms[i] for i in found], pa.string())], ["id", "low"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, low string")


def trigram_match(docs: DataFrame, terms: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(query_id, term, id) for the docs whose text contains a term of three characters or more, in any case.
    terms: query_id, term.

    Up to SCAN_TERMS terms of SCAN_CHARS characters in all, which are counted first, every task finds them in one scan
    of its texts, and nothing but hits leaves it. Beyond that a term asks for one of its trigrams, the one in the
    fewest docs: postings are joined, then texts by id, and hits are verified. Null texts have no hits; each
    row is given once a term, also those of a repeated id."""
    source = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(text_col, F.lit(""))).alias("_low"))
    wanted = terms.filter(F.length("term") >= 3).select("query_id", "term", F.lower("term").alias("low"))
    distinct = wanted.select("low").distinct().checkpoint()
    n, chars = distinct.agg(F.count("*"), F.coalesce(F.sum(F.length("low")), F.lit(0))).first()
    if n <= SCAN_TERMS and chars <= SCAN_CHARS:
        if not n:
            return wanted.join(source.select("id").limit(0), F.lit(True)).select("query_id", "term", "id")
        hits = _scanned(source, [r["low"] for r in distinct.collect()])
        return wanted.join(hits, "low").select("query_id", "term", "id")
    asked = distinct.select("low", F.explode(trigrams(F.col("low"))).alias("g"))
    df = source.select(F.explode(trigrams(F.col("_low"))).alias("g")).join(asked.select("g").distinct(), "g", "left_semi").groupBy("g").agg(F.count("*").alias("df"))
    rarest = asked.join(df, "g", "left").groupBy("low").agg(F.min_by("g", F.struct(F.coalesce("df", F.lit(0)), "g")).alias("g")).checkpoint()
    postings = source.select("id", F.explode(trigrams(F.col("_low"))).alias("g")).join(rarest, "g").select("id", "low").distinct()
    hits = postings.join(source, "id").filter(F.contains("_low", "low")).select("id", "low")
    return wanted.join(hits, "low").select("query_id", "term", "id")


def bm25(docs: DataFrame, queries: DataFrame, id_col: str = "id", text_col: str = "text", query_id: str = "query_id", query_text: str = "query") -> DataFrame:
    """(query_id, id, score) by BM25 over distinct query tokens. Only tokens that a query has leave the scan of
    the docs; document lengths are their own aggregate. Queries of up to SCORED_WORDS words, which are counted first, go
    to the documents, and documents are dealt so that a task has TASK_HITS pairs of a document and a query."""
    wanted = queries.select(F.col(query_id), F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("t"))
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("_w"))
    rows = words.select("id", F.size("_w").alias("len"), F.explode("_w").alias("t"))
    asked = wanted.select("t").distinct()
    tf = rows.join(asked, "t", "left_semi").groupBy("id", "len", "t").agg(F.count("*").alias("tf"))
    df = tf.groupBy("t").agg(F.count("*").alias("df"))
    length = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit("[\\p{L}\\p{N}]+"))  # as many as tokens() has, without making them
    total = docs.agg(F.count("*").alias("n"), F.avg(length).alias("avg_len"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    weighted = df.join(F.broadcast(total)).select("t", "df", "n", "avg_len")  # total: one row
    most = wanted.count()
    if most <= SCORED_WORDS:
        # All of a document in one task: what is shuffled is its words, not their products with the queries.
        spark = docs.sparkSession
        parts = max(spark.sparkContext.defaultParallelism, -(-docs.count() * queries.count() // TASK_HITS))
        scored = tf.repartition(parts, "id").join(F.broadcast(wanted.join(weighted, "t")), "t")  # SCORED_WORDS rows
    else:
        scored = tf.join(weighted, "t").join(wanted, "t")
    return scored.groupBy(query_id, "id").agg(F.sum(weight).alias("score"))


def top_per_query(hits: DataFrame, k: int, query_id: str = "query_id", id_col: str = "id") -> DataFrame:
    """The k best hits of each query by score, then id, with their rank."""
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def is_word(term: Column) -> Column:
    """a term of three characters or more without CJK, which is looked up; others are substrings."""
    return (F.length(term) >= 3) & ~T.contains_cjk(term)


def in_order(hits: DataFrame, terms: DataFrame, updated: DataFrame, k: int, query_id: str = "query_id", id_col: str = "id") -> DataFrame:
    """the k first hits of each query with their rank: by score, then the newest, then id. A query with a term that
    isn't looked up has no score for all its hits, so its order is the newest first. updated: id_col, updated_at."""
    mixed = terms.filter(~is_word(F.col("term")) & (F.length("term") > 0)).select(query_id).distinct().withColumn("_mixed", F.lit(True))
    rows = hits.join(mixed, query_id, "left").join(updated.select(id_col, "updated_at"), id_col, "left")
    order = [F.desc_nulls_last(F.when(F.col("_mixed").isNull(), F.col("score"))), F.desc_nulls_last("updated_at"), F.asc(id_col)]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(*order))).filter(F.col("rank") <= k).drop("_mixed", "updated_at")


def text_search(entries: DataFrame, terms: DataFrame, groups: list[list[str]], query_id: str = "query_id", id_col: str = "id") -> DataFrame:
    """(query_id, id, score) of the entries that any term finds. terms: query_id, term.

    Terms of three characters or more are words of a group of fields (the entry's, the file's) and score by bm25() in
    each group, summed; a phrase asks for its words. Terms with CJK characters and shorter ones are substrings of any
    field and score nothing: they are joined on their first one to three characters and verified. Null fields and
    terms are empty, an empty term finds nothing, ids are taken as distinct."""
    term = F.col("term")
    asked = terms.filter(is_word(term)).groupBy(query_id).agg(F.concat_ws(" ", F.collect_set("term")).alias("query"))
    parts = []
    for fields in groups:
        group = entries.select(F.col(id_col).alias("id"), F.concat_ws("\n", *fields).alias("_text"))
        parts.append(bm25(group, asked, "id", "_text", query_id))
    whole = entries.select(F.col(id_col).alias("id"), F.lower(F.concat_ws("\n", *[f for fields in groups for f in fields])).alias("_text"))
    short = terms.filter(~is_word(term) & (F.length(term) > 0)).select(query_id, F.lower(term).alias("_low")).distinct().withColumn("g", F.substring("_low", 1, 3))
    grams = F.array_distinct(F.concat(*[F.regexp_extract_all("_text", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in (1, 2, 3)]))
    found = whole.select("id", "_text", F.explode(grams).alias("g")).join(short, "g").filter(F.contains("_text", "_low"))
    out = found.select(query_id, "id", F.lit(0.0).alias("score"))
    for part in parts:
        out = out.unionByName(part)
    return out.groupBy(query_id, "id").agg(F.sum("score").alias("score"))


def metadata_rank(candidates: DataFrame, terms: DataFrame, fields: list[tuple[str, float]], tags: DataFrame | None = None, query_id: str = "query_id", id_col: str = "id") -> DataFrame:
    """(query_id, id, score). candidates: query_id, id and the fields; terms: query_id, term; tags: id, name,
    facet, requested. Fields count up to three hits each; coverage counts text terms; tags add their facet's weight."""
    counted = terms.groupBy(query_id).agg(F.count("*").alias("n_terms"))
    rows = candidates.join(terms, query_id)
    per_term = sum((F.lit(w) * F.least(T.term_hits(F.col(f).cast("string"), F.col("term")), F.lit(3)) for f, w in fields), F.lit(0.0))
    scored = rows.withColumn("_s", per_term).groupBy(query_id, id_col).agg(F.sum(F.col("_s") * T.term_weight(F.col("term"))).alias("_text"), F.count_if(F.col("_s") > 0).alias("_covered"))
    out = scored.join(counted, query_id).select(query_id, id_col, (F.col("_text") + 5.0 * F.col("_covered") / F.col("n_terms")).alias("_base"))
    if tags is None:
        return out.withColumnRenamed("_base", "score")
    asked = candidates.select(query_id, id_col).join(tags, id_col)
    requested = asked.groupBy(query_id, id_col).agg(F.sum(F.when(F.col("requested"), T.facet_weight(F.col("facet")) + 4.0).otherwise(0.0)).alias("_r"))
    named = asked.join(terms, query_id).filter(T.term_hits(F.col("name"), F.col("term")) > 0).groupBy(query_id, id_col).agg(F.sum(T.facet_weight(F.col("facet")) * T.term_weight(F.col("term"))).alias("_n"))
    both = out.join(requested, [query_id, id_col], "left").join(named, [query_id, id_col], "left")
    return both.select(query_id, id_col, (F.col("_base") + F.coalesce("_r", F.lit(0.0)) + F.coalesce("_n", F.lit(0.0))).alias("score"))


def rank_pool(base: DataFrame, limit: int, offset: int = 0, query_id: str = "query_id", order: str = "base_rank") -> DataFrame:
    """only the first max(limit + offset, 500) rows of the base order are ranked again."""
    return base.filter(F.col(order) <= max(limit + offset, 500))


def section_records(files: DataFrame, most: int = 200) -> DataFrame:
    """(record_id, file_id, section_id, text): a record of each file (file_id, text, sections) and one of each of
    its first stable sections, ids once."""
    whole = files.select(F.col("file_id").alias("record_id"), "file_id", F.lit(None).cast("string").alias("section_id"), T.description_text(F.col("text"), F.col("sections")).alias("text"))
    each = files.select("file_id", F.posexplode("sections").alias("_p", "s")).filter(T.is_stable_section(F.col("s")))
    once = each.withColumn("_d", F.row_number().over(Window.partitionBy("file_id", "s.id").orderBy("_p"))).filter("_d = 1")
    first = once.withColumn("_r", F.row_number().over(Window.partitionBy("file_id").orderBy("_p"))).filter(F.col("_r") <= most)
    return whole.unionByName(first.select(F.concat("file_id", F.lit("#section:"), "s.id").alias("record_id"), "file_id", F.col("s.id").alias("section_id"), T.section_evidence_line(F.col("s")).alias("text")))
