"""Fusion of candidate lists: reciprocal ranks, scores, quotas, reranking, expansion. Batched over query_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators.windows import row_numbers

RRF_K = 60
SOURCES = {"metadata_tags": "tag_rank", "metadata_text": "lexical_rank", "semantic": "semantic_rank"}


def union_candidates(sources: dict[str, DataFrame]) -> DataFrame:
    """(query_id, entry_id, matched_by, tag_rank, lexical_rank, semantic_rank) from (query_id, entry_id, rank)
    per source."""
    rows = None
    for name, df in sources.items():
        part = df.select("query_id", "entry_id", F.lit(name).alias("source"), F.col("rank").cast("int").alias("rank"))
        rows = part if rows is None else rows.unionByName(part)
    ranks = [F.min(F.when(F.col("source") == s, F.col("rank"))).alias(c) for s, c in SOURCES.items()]
    return rows.groupBy("query_id", "entry_id").agg(F.array_sort(F.collect_set("source")).alias("matched_by"), *ranks)


def ordered_distinct(parts: list[DataFrame], limit: int | None = None) -> DataFrame:
    """(query_id, entry_id, rank) of lists (query_id, entry_id, pos), one after the other, each entry
    where it first stands."""
    rows = None
    for i, df in enumerate(parts):
        part = df.select("query_id", "entry_id", F.lit(i).alias("src"), F.col("pos").cast("bigint").alias("pos"))
        rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy("query_id", "entry_id").agg(F.min(F.struct("src", "pos")).alias("at"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "entry_id"))).drop("at")
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def rrf(*ranks: Column, k: int = RRF_K) -> Column:
    """R1."""
    out = F.lit(0.0)
    for r in ranks:
        out = out + F.coalesce(F.when(r > 0, 1.0 / (k + r)), F.lit(0.0))
    return out


def source_overlap(matched_by: Column) -> Column:
    """R2."""
    has = lambda s: F.array_contains(matched_by, s)
    tags, text, semantic = has("metadata_tags"), has("metadata_text"), has("semantic")
    part = lambda test, value: F.when(test, value).otherwise(0.0)
    return part(tags, 1.2) + part(text & semantic, 1.5) + part(tags & text, 0.8) + part(tags & semantic, 0.5)


def field_match(terms: Column, name: Column, summary: Column, kind: Column) -> Column:
    """Terms of the query (R6) in the fields, at most 2, plus the share of terms covered."""
    each = F.transform(terms, lambda t: F.struct(
        (2.4 * F.least(T.term_hits(name, t), F.lit(2)) + 1.4 * F.least(T.term_hits(summary, t), F.lit(2)) + 0.2 * F.least(T.term_hits(kind, t), F.lit(2))).alias("s"),
        T.recall_term_weight(t).alias("w")))

    def score(hits: Column) -> Column:
        raw = F.aggregate(hits, F.lit(0.0), lambda a, h: a + h["s"] * h["w"])
        return F.least(raw, F.lit(2.0)) + F.size(F.filter(hits, lambda h: h["s"] > 0)) / F.size(hits)

    return F.when(F.size(terms) > 0, T.let(each, score)).otherwise(0.0)


def evidence_utility(summary: Column, partial: Column, chunks: Column, cut: Column) -> Column:
    """R4."""
    part = lambda test, value: F.when(F.coalesce(test, F.lit(False)), value).otherwise(0.0)
    return part(F.trim(summary) != "", 0.4) + part(~partial, 0.3) + part(chunks > 0, 0.2) - part(cut, 0.2)


def recall_score(rows: DataFrame) -> DataFrame:
    """Adds rrf_score, score (4 decimals) and rank. rows: union_candidates() with terms, display_name, summary,
    kind, indexed_partial, chunk_count, truncated, rank_score."""
    r = rrf(F.col("tag_rank"), F.col("lexical_rank"), F.col("semantic_rank"))
    score = 1000 * r + source_overlap(F.col("matched_by")) + field_match(F.col("terms"), F.col("display_name"), F.col("summary"), F.col("kind")) + evidence_utility(F.col("summary"), F.col("indexed_partial"), F.col("chunk_count"), F.col("truncated"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("rrf_score"), F.desc("rank_score"), "display_name", "entry_id")
    return rows.withColumn("rrf_score", r).withColumn("score", F.round(score, 4)).withColumn("rank", F.row_number().over(w))


def quotas(limit: int, shares: tuple[float, float, float] = (0.35, 0.2, 0.25)) -> dict[str, int]:
    """Places for overlap, tag, lexical and semantic hits; halves are rounded to even."""
    if limit <= 1:
        return {"overlap": limit, "tag": 0, "lexical": 0, "semantic": 0}
    overlap, tag, lexical = (max(1, round(limit * s)) if s else 0 for s in shares)
    return {"overlap": overlap, "tag": tag, "lexical": lexical, "semantic": max(0, limit - overlap - tag - lexical)}


def bucket(matched_by: Column) -> Column:
    has = lambda s: F.array_contains(matched_by, s)
    return F.when(has("metadata_text") & has("semantic"), "overlap").when(has("metadata_tags"), "tag").when(has("metadata_text"), "lexical").when(has("semantic"), "semantic").otherwise("other")


def quota_select(rows: DataFrame, limit: int, shares: tuple[float, float, float] = (0.35, 0.2, 0.25)) -> DataFrame:
    """The best of each bucket up to its quota, the rest of the places by rank; in the order of rank. rows: query_id,
    entry_id, matched_by, rank."""
    quota = F.lit(0)
    for name, n in quotas(limit, shares).items():
        quota = F.when(F.col("bucket") == name, F.lit(n)).otherwise(quota)
    ranked = rows.withColumn("bucket", bucket(F.col("matched_by"))).withColumn("_b", F.row_number().over(Window.partitionBy("query_id", "bucket").orderBy("rank")))
    picked = ranked.withColumn("_p", (F.col("_b") <= quota).cast("int"))
    out = picked.withColumn("_o", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_p"), "rank"))).filter(F.col("_o") <= limit)
    return out.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).drop("_b", "_p", "_o")


def rerank_apply(hits: DataFrame, scores: DataFrame, top_n: int = 80) -> DataFrame:
    """The first top_n by their new score, those without one after them in the old order, then the tail. hits:
    query_id, entry_id, pos; scores: query_id, entry_id, rerank_score."""
    joined = hits.join(scores, ["query_id", "entry_id"], "left")
    head = F.col("pos") <= top_n
    w = Window.partitionBy("query_id").orderBy(~head, F.when(head, F.col("rerank_score")).desc_nulls_last(), "pos")
    return joined.withColumn("new_pos", F.row_number().over(w))


def rerank_text(section: Column, title: Column, summary: Column, description: Column, extras: Column, limit: int = 1800) -> Column:
    """The matched section's text, else the entry's."""
    whole = F.concat_ws("\n", F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(summary), F.lit("")), F.nullif(F.trim(description), F.lit("")), F.nullif(F.trim(extras), F.lit("")))
    return F.substring(F.coalesce(F.nullif(F.trim(section), F.lit("")), whole), 1, limit)


def expand_ranked(ranked: DataFrame, pairs: DataFrame, limit: int, per_anchor: int = 10) -> DataFrame:
    """After each query's list, the strongest neighbours of its entries in their order, distinct, up to limit."""
    from sparkloom.operators.joins import neighbours

    near = neighbours(pairs, min(per_anchor, limit)).select(F.col("entry").alias("entry_id"), "other", F.col("rank").alias("_r"))
    more = ranked.join(near, "entry_id").select("query_id", F.col("other").alias("entry_id"), (F.col("pos") * 1000 + F.col("_r")).alias("pos"))
    return ordered_distinct([ranked, more], limit)


def search_notes(notes: DataFrame, terms: list[str], tags: list[str], match: str = "all", since=None) -> DataFrame:
    """Active notes whose text has any term, with any tag; `any`: either. notes: note, tags, superseded_by_id,
    invalidated_at, created_at."""
    text = F.lit(False)
    for term in terms:
        text = text | F.contains(F.lower("note"), F.lit(term.lower()))
    tagged = F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])) if tags else F.lit(False)
    parts = ([text] if terms else []) + ([tagged] if tags else [])
    out = notes.filter("superseded_by_id IS NULL AND invalidated_at IS NULL")
    if parts:
        test = parts[0]
        for p in parts[1:]:
            test = test & p if match == "all" else test | p
        out = out.filter(F.coalesce(test, F.lit(False)))
    return out if since is None else out.filter(F.col("created_at") >= since)


def stale_last(notes: DataFrame, pos: str = "pos", stale: str = "is_stale") -> DataFrame:
    """new_pos, stale notes after the others, in each query if there is a query_id; a list of any length."""
    return row_numbers(notes, ["query_id"] if "query_id" in notes.columns else [], [stale, pos], "new_pos")


def materialize_view(entries: DataFrame, entry_tags: DataFrame, spec: dict, closed: DataFrame | None = None) -> DataFrame:
    """Entries of a filter spec: tags_all, tags_any, tags_none, lifecycle, kind, catalog_subtree."""
    from sparkloom.operators import filters

    out = filters.search_filtered(entries, {"kind": spec.get("kind")}, {"lifecycle": spec.get("lifecycle")})
    out = filters.tags_all(out, entry_tags, spec.get("tags_all") or [])
    out = filters.tags_any(out, entry_tags, spec.get("tags_any") or [])
    out = filters.tags_none(out, entry_tags, spec.get("tags_none") or [])
    if spec.get("catalog_subtree") and closed is not None:
        inside = closed.filter(F.col("ancestor").isin(*spec["catalog_subtree"])).select(F.col("id").alias("catalog_id"))
        out = out.join(inside, "catalog_id", "left_semi")
    return out
