"""Compositions of the other operators: the whole recall, citation lookup, overviews and review bundles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import filters, joins, recall, vectors
from sparkloom.operators.aggregates import direct_counts, top_per_group

# The keys of a coverage record that are shown.
COVERAGE_KEYS = (
    "unit", "total_pages", "indexed_pages", "total_units", "indexed_units", "total_bytes", "indexed_bytes", "total_chars", "indexed_chars", "total_lines", "indexed_lines", "total_rows", "indexed_rows", "indexed_partial",
    "partial_reasons", "source_mode", "max_index_pages", "max_index_bytes", "max_index_chars", "max_rows_per_sheet", "max_sample_lines", "sampled", "chunked", "chunk_count", "text_truncated", "truncated_chunks", "ocr_used", "ocr_pages_done",
)


def compact_coverage(coverage: Column) -> Column:
    """the known keys of a MAP<STRING, STRING> that are there; null when none is."""
    kept = F.map_filter(coverage, lambda k, v: k.isin(*COVERAGE_KEYS))
    return F.when(F.size(kept) > 0, kept)


@dataclass(frozen=True)
class RecallOptions:
    """R13's defaults; R14 takes shares (0.4, 0, 0.4)."""

    limit: int = 20
    shares: tuple[float, float, float] = (0.35, 0.2, 0.25)
    per_source: int = 100
    rerank_top: int = 80
    section_score: float = 0.45


def recall_funnel(
    queries: DataFrame, entries: DataFrame, sources: dict[str, DataFrame], options: RecallOptions = RecallOptions(), records: DataFrame | None = None,
    rerank_scores: DataFrame | None = None, relations: DataFrame | None = None,
) -> DataFrame:
    """(query_id, entry_id, score, bucket, pos, section_id, source) for all queries at once.

    queries: query_id, query, and embedding when records are given; entries: entry_id, display_name, summary, kind,
    indexed_partial, chunk_count, truncated; sources: candidates (query_id, entry_id, rank) by source name, of which the
    first per_source count; records: vector records for sections of lexical hits; rerank_scores: query_id, entry_id,
    rerank_score; relations: vetted pairs (a, b, n), whose neighbours of the selection follow it as source `related`.
    """
    fused = recall.union_candidates({name: df.filter(F.col("rank") <= options.per_source) for name, df in sources.items()})
    terms = queries.select("query_id", T.score_terms(T.split_query(F.col("query"))).alias("terms"))
    rows = fused.join(entries, "entry_id").join(terms, "query_id").withColumn("rank_score", F.lit(0))
    scored = recall.recall_score(rows)
    if rerank_scores is not None:
        hits = recall.rerank_apply(scored.select("query_id", "entry_id", F.col("rank").alias("pos")), rerank_scores, options.rerank_top)
        scored = scored.drop("rank").join(hits.select("query_id", "entry_id", F.col("new_pos").alias("rank")), ["query_id", "entry_id"])
    picked = recall.quota_select(scored, options.limit, options.shares).select("query_id", "entry_id", "score", "bucket", "pos").withColumn("section_id", F.lit(None).cast("string"))
    if records is not None:
        found = vectors.best_section(picked.select("query_id", "entry_id"), records, queries)
        picked = vectors.section_backfill(picked, found, options.section_score)
    picked = picked.withColumn("source", F.lit("candidate"))
    if relations is None:
        return picked
    near = joins.one_hop(relations, picked.select("query_id", F.col("entry_id").alias("entry")))
    w = Window.partitionBy("query_id").orderBy(F.desc("count"), "other")
    last = picked.groupBy("query_id").agg(F.max("pos").alias("_last"))
    more = near.withColumn("_r", F.row_number().over(w)).join(last, "query_id").filter(F.col("_last") + F.col("_r") <= 50)
    none = F.lit(None)
    return picked.unionByName(more.select("query_id", F.col("other").alias("entry_id"), none.cast("double").alias("score"), F.lit("related").alias("bucket"), (F.col("_last") + F.col("_r")).cast("int").alias("pos"), none.cast("string").alias("section_id"), F.lit("related").alias("source")))


def cited_docs(answers: DataFrame, known: DataFrame) -> DataFrame:
    """(answer_id, doc_id): ids, or prefixes that only one known id has, that an answer's text cites. answers:
    answer_id, answer; known: id, name."""
    raw = F.regexp_extract_all("answer", F.lit("(?:entry_id\\s*=\\s*`?|entry:)([0-9a-fA-F][0-9a-fA-F\\-]{6,35})"), F.lit(1))
    cited = answers.select("answer_id", F.explode(F.array_distinct(raw)).alias("raw"))
    found = filters.resolve_id_prefix(cited.select("raw").distinct(), known).filter("status = 'resolved'").select("raw", "id")
    return cited.join(found, "raw").select("answer_id", F.col("id").alias("doc_id")).distinct()


def corpus_overview(entries: DataFrame, folders: DataFrame, tags: DataFrame, tasks: DataFrame, newest: int = 10) -> tuple[DataFrame, DataFrame]:
    """A10: (name, n) of live entries, live folders, tags and tasks by status; and the newest live entries."""
    live = entries.filter("deleted_at IS NULL")
    counts = live.agg(F.lit("entries").alias("name"), F.count("*").alias("n"))
    counts = counts.unionByName(folders.filter("deleted_at IS NULL").agg(F.lit("folders").alias("name"), F.count("*").alias("n"))).unionByName(tags.agg(F.lit("tags").alias("name"), F.count("*").alias("n")))
    counts = counts.unionByName(tasks.groupBy(F.concat(F.lit("tasks:"), "status").alias("name")).agg(F.count("*").alias("n")))
    return counts, live.orderBy(F.desc("created_at"), "id").limit(newest)


def context_snapshot(catalogs: DataFrame, entries: DataFrame, views: DataFrame, tags: DataFrame, notes: DataFrame, before, per_facet: int = 10) -> dict[str, DataFrame]:
    """50 top catalogs with their direct entries, 30 views by name, the top tags of each facet, the 10 newest notes
    before a time."""
    return {
        "catalogs": direct_counts(catalogs.filter("deleted_at IS NULL AND parent_id IS NULL").orderBy("name", "id").limit(50), entries), "views": views.orderBy("name").limit(30),
        "tags": top_per_group(tags.filter("alias_of IS NULL"), ["facet"], [F.desc("doc_count"), F.asc("name")], per_facet),
        "notes": notes.filter(F.col("created_at") < before).orderBy(F.desc("created_at"), F.desc("note_id")).limit(10),
    }


def catalog_review(catalogs: DataFrame, entries: DataFrame, entry_tags: DataFrame, notes: DataFrame, newest: int = 30) -> dict[str, DataFrame]:
    """Live catalogs with direct counts, notes with a `hint:` tag among the 40 newest, and the entries updated last
    with their tags. entry_tags: entry_id, name."""
    latest = notes.orderBy(F.desc("created_at"), F.desc("note_id")).limit(40)
    recent = entries.filter("deleted_at IS NULL").orderBy(F.desc("updated_at"), "id").limit(newest)
    worn = entry_tags.groupBy("entry_id").agg(F.array_sort(F.collect_set("name")).alias("tags"))
    return {
        "catalogs": direct_counts(catalogs, entries),
        "hints": latest.filter(F.exists("tags", lambda t: F.startswith(t, F.lit("hint:")))), "entries": recent.join(worn.withColumnRenamed("entry_id", "id"), "id", "left"),
    }


def stage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """What a retriever under test must return: query_id, entry_id, rank, and nothing else."""
    missing = set(columns) - set(df.columns)
    if missing:
        raise ValueError(f"the retriever lacks {sorted(missing)}")
    return df.select(*columns)
