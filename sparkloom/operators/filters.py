"""Liveness, conjunctive filters, tag conditions, id resolution, paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE = ("active", "manual_active")


def live(deleted_at: str = "deleted_at") -> Column:
    """not soft-deleted."""
    return F.col(deleted_at).isNull()


def active() -> Column:
    return live() & F.col("lifecycle").isin(*ACTIVE)


def indexable() -> Column:
    return active() & (F.col("ingest_status") == "done")


def search_filtered(entries: DataFrame, equals: dict[str, object] | None = None, among: dict[str, Sequence] | None = None, is_null: Sequence[str] = ()) -> DataFrame:
    """all conditions at once; None leaves one out, an empty list matches nothing."""
    out = entries
    for column, value in (equals or {}).items():
        if value is not None:
            out = out.filter(F.col(column) == value)
    for column, values in (among or {}).items():
        if values is not None:
            out = out.filter(F.col(column).isin(*values)) if len(values) else out.limit(0)
    for column in is_null:
        out = out.filter(F.col(column).isNull())
    return out


def tags_all(entries: DataFrame, entry_tags: DataFrame, ids: Sequence, entry: str = "entry_id", tag: str = "tag_id") -> DataFrame:
    """entries with every tag; no tags, no condition."""
    wanted = list(dict.fromkeys(ids))
    if not wanted:
        return entries
    has = entry_tags.filter(F.col(tag).isin(*wanted)).groupBy(entry).agg(F.count_distinct(tag).alias("_n")).filter(F.col("_n") == len(wanted))
    return entries.join(has.select(entry), entry, "left_semi")


def tags_any(entries: DataFrame, entry_tags: DataFrame, ids: Sequence, entry: str = "entry_id", tag: str = "tag_id") -> DataFrame:
    """F6."""
    return entries.join(entry_tags.filter(F.col(tag).isin(*ids)).select(entry), entry, "left_semi") if ids else entries


def tags_none(entries: DataFrame, entry_tags: DataFrame, ids: Sequence, entry: str = "entry_id", tag: str = "tag_id") -> DataFrame:
    """F7."""
    return entries.join(entry_tags.filter(F.col(tag).isin(*ids)).select(entry), entry, "left_anti") if ids else entries


def resolve_id_prefix(asked: DataFrame, entries: DataFrame, raw: str = "raw", id_col: str = "id", name_col: str = "name", hints: int = 5) -> DataFrame:
    """per raw id, status resolved, ambiguous or not_found, the id, and up to `hints` names of which what isn't
    hexadecimal is a word. Prefixes have eight digits or more; dashes don't count."""
    bare = F.lower(F.replace(F.col(raw), F.lit("-"), F.lit("")))
    hexed = asked.select(raw, bare.alias("_p")).filter("_p RLIKE '^[0-9a-f]{8,32}$'").withColumn("_k", F.substring("_p", 1, 8))
    known = entries.select(F.col(id_col).alias("_id"), F.lower(F.replace(F.col(id_col), F.lit("-"), F.lit(""))).alias("_b")).withColumn("_k", F.substring("_b", 1, 8))
    hits = hexed.join(known, "_k").filter(F.startswith("_b", "_p")).groupBy(raw).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    others = asked.filter(~bare.rlike("^[0-9a-f]{8,32}$")).select(raw).distinct()
    words = entries.select(F.col(name_col).alias("_name"), F.explode(F.array_distinct(F.split(F.lower(name_col), "[^\\p{L}\\p{N}]+"))).alias("_w"))
    found = others.withColumn("_w", F.lower(raw)).join(words, "_w")
    named = found.groupBy(raw).agg(F.slice(F.array_sort(F.collect_set("_name")), 1, hints).alias("hints"))
    out = asked.join(hits, raw, "left").join(named, raw, "left")
    status = F.when(F.col("_n") == 1, "resolved").when(F.col("_n") > 1, "ambiguous").otherwise("not_found")
    return out.select(raw, status.alias("status"), F.when(F.col("_n") == 1, F.col("_first")).alias("id"), "hints")


def json_equals(payload: Column, path: str, value: str) -> Column:
    """F29."""
    return F.get_json_object(payload, f"$.{path}") == value


def low_quality(files: DataFrame, shorter: int = 40, limit: int | None = None) -> DataFrame:
    """live, ingested files without a summary of that length, oldest first."""
    out = files.filter(live() & F.col("ingested_at").isNotNull() & (F.coalesce(F.length(F.trim("summary")), F.lit(0)) < shorter)).orderBy("ingested_at", "id")
    return out if limit is None else out.limit(limit)


def page(df: DataFrame, order: Sequence, limit: int, offset: int = 0) -> tuple[DataFrame, dict]:
    """The rows of a page, and total, has_more, next_offset."""
    total = df.count()
    end = min(total, offset + limit)
    return df.orderBy(*order).offset(offset).limit(limit), {"total": total, "has_more": end < total, "next_offset": end if end < total else None}


def keyset_page(df: DataFrame, ts: str, id_col: str, limit: int, after: tuple | None = None) -> DataFrame:
    """Rows after (ts, id) in descending order."""
    if after is not None:
        df = df.filter((F.col(ts) < F.lit(after[0])) | ((F.col(ts) == F.lit(after[0])) & (F.col(id_col) < F.lit(after[1]))))
    return df.orderBy(F.desc(ts), F.desc(id_col)).limit(limit)


def count_filtered(entries: DataFrame, equals: dict[str, object] | None = None, among: dict[str, Sequence] | None = None, is_null: Sequence[str] = ()) -> int:
    """rows of search_filtered()."""
    return search_filtered(entries, equals, among, is_null).count()


def line_range(lines: DataFrame, first: int | None = None, last: int | None = None, no: str = "n") -> DataFrame:
    """lines first..last, both included."""
    if first is not None:
        lines = lines.filter(F.col(no) >= first)
    return lines if last is None else lines.filter(F.col(no) <= last)


def newest(df: DataFrame, at: str, key: str, n: int, oldest: bool = False) -> DataFrame:
    """The n newest rows (or the oldest) by time, then key; rows without a time come last. Each task gives its own n."""
    return df.orderBy(F.asc_nulls_last(at) if oldest else F.desc_nulls_last(at), key).limit(n)
