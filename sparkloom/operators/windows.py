"""Ordered rows: context lines, cursors, sections, chunks, budgets, unique names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import logs


def cursors(events: DataFrame, key: str, *order: str) -> DataFrame:
    """Cursor 1.. per key."""
    return events.withColumn("cursor", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def row_numbers(df: DataFrame, keys: list[str], order: list[str], out: str = "row") -> DataFrame:
    """Numbers from 1 in each group of keys, by order, where a group may be too large for a task. Rows are dealt by
    ranges of keys and order and numbered where they stand (written by checkpoint(), so that this holds), and the rows
    of the group in the parts before are added."""
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_m", F.monotonically_increasing_id()).checkpoint()
    dealt = dealt.withColumn("_p", F.shiftrightunsigned("_m", 33))
    parts = dealt.groupBy(*keys, "_p").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_p").alias("_q"), (before - F.col("_first") + 1).alias("_add"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return dealt.join(known, [F.col("_p") == F.col("_q"), *same]).select(*df.columns, (F.col("_m") + F.col("_add")).alias(out))


def grep_context(
    lines: DataFrame, pattern: str, context: int = 2, file: str = "file", no: str = "n", line: str = "text", max_rows: int | None = None, offset: int = 0, block: int = 4096
) -> DataFrame:
    """Each match (several a line, cut to 200 characters) with the lines around it; total per file.

    A file may have any size: its lines are handled in blocks, and a line near a block's border is also sent to the
    next block, as context."""
    block = max(block, context + 1)
    at = F.col("_i") - 1
    rows = row_numbers(lines.select(file, no, line), [file], [no], "_i")
    dealt = rows.withColumn("_b", F.explode(F.sequence(F.floor(F.greatest(at - context, F.lit(0)) / block), F.floor((at + context) / block))))
    w = Window.partitionBy(file, "_b").orderBy("_i")
    around = F.array_join(F.collect_list(line).over(w.rowsBetween(-context, context)), "\n")
    found = dealt.withColumn("context", around).filter((F.col("_b") == F.floor(at / block)) & logs.matches(F.col(line), pattern))
    out = found.select(file, no, F.posexplode(F.regexp_extract_all(line, F.lit(f"(?i)({pattern})"), F.lit(1))).alias("pos", "match"), "context")
    ranked = row_numbers(out.withColumn("match", F.substring("match", 1, 200)), [file], [no, "pos"], "rank")
    total = ranked.groupBy(F.col(file).alias("_f")).agg(F.count("*").alias("total"))
    out = ranked.join(total, F.col(file).eqNullSafe(F.col("_f"))).select(file, no, "pos", "match", "context", "total", "rank")
    return out if max_rows is None else out.filter(F.col("rank").between(offset + 1, offset + max_rows))


def char_window(docs: DataFrame, offset: int, size: int, text: str = "text") -> DataFrame:
    """A part of the text by characters, with next_offset and its lines."""
    part = F.substring(text, offset + 1, size)
    before = F.substring(text, 1, offset)
    newlines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return docs.withColumns({
        "part": part, "next_offset": F.when(F.length(text) > offset + size, F.lit(offset + size)),
        "line_start": newlines(before) + 1, "line_end": newlines(before) + newlines(part) + 1,
    })


def line_window(docs: DataFrame, first: int, last: int, text: str = "text") -> DataFrame:
    """Lines first..last."""
    return docs.withColumn("part", F.array_join(F.slice(F.split(text, "\n"), first, max(0, last - first + 1)), "\n"))


# Fixed value: a Markdown heading, its marks and its title.
HEADING = r"^\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$"


def sections_from_headings(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Markdown headings with the lines they reach: to before the next heading of the same or a higher level.

    Read from the end, the nearest heading of each of the six levels or a higher one is a running minimum, so a text's
    headings take time in proportion. A null text has none; rows with equal ids are texts of their own."""
    rows = docs.select(doc, F.monotonically_increasing_id().alias("_row"), F.split(text, "\n").alias("_lines"))
    rows = rows.withColumn("_n", F.size("_lines")).select(doc, "_row", "_n", F.posexplode("_lines").alias("_i", "_l"))  # counted before they are rows
    heads = rows.filter(F.col("_l").rlike(HEADING))
    heads = heads.select(doc, "_row", "_n", (F.col("_i") + 1).alias("line"), F.length(F.regexp_extract("_l", HEADING, 1)).alias("level"), F.regexp_extract("_l", HEADING, 2).alias("title"))
    later = Window.partitionBy("_row").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    nearest = [F.min(F.when(F.col("level") <= k, F.col("line"))).over(later) for k in range(1, 7)]
    return heads.withColumn("_next", F.array(*nearest)).select(doc, "line", "level", "title", F.coalesce(F.element_at("_next", F.col("level")) - 1, F.col("_n")).alias("line_end"))


def section_body(text, anchor, title):
    """The lines of an anchor `a-b`, else 4096 characters from the title on."""
    a, b = F.regexp_extract(anchor, "([0-9]+)-([0-9]+)", 1), F.regexp_extract(anchor, "([0-9]+)-([0-9]+)", 2)
    sliced = F.array_join(F.slice(F.split(text, "\n"), a.try_cast("int"), b.try_cast("int") - a.try_cast("int") + 1), "\n")
    return F.when(a != "", sliced).when(F.contains(text, title), F.substring(text, F.call_function("locate", title, text), F.lit(4096)))


def line_chunks(text: str, max_chars: int) -> list[tuple[int, int, str]]:
    """(first line, last line, body) of greedy chunks: the costs of all lines are summed up once, and where a chunk
    ends is searched in the sums."""
    lines = text.splitlines() or [""]
    until = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1)
    out, first = [], 0
    while first < len(lines):
        before = int(until[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(until, before + max_chars, side="right")))
        out.append((first + 1, last, "\n".join(lines[first:last])))
        first = last
    return out


def chunk_lines(docs: DataFrame, max_chars: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Greedy chunks of whole lines, each line costing its length and one; (doc, chunk, line_start, line_end,
    body). A longer line is a chunk of its own. A null or empty text is one chunk of an empty line; repeated rows give
    repeated chunks. Time is in proportion to the text."""
    rows = docs.select(F.col(doc).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_chunks(t.as_py(), max_chars) for t in batch.column(1)]
            place = pa.array([i for i, f in enumerate(found) for _ in f], pa.int32())
            number = [k for f in found for k in range(len(f))]
            first, last, body = zip(*[c for f in found for c in f], strict=True) if number else ((),) * 3
            columns = [batch.column(0).take(place), *[pa.array(c, pa.int32()) for c in (number, first, last)], pa.array(body, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "chunk", "line_start", "line_end", "body"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, chunk int, line_start int, line_end int, body string").withColumnRenamed("id", doc)


def within_budget(rows: DataFrame, key: str, order, cost: str, budget: int, newest_first: bool = True) -> DataFrame:
    """Rows of each key while the running cost stays within the budget; it stops at the first that doesn't."""
    w = Window.partitionBy(key).orderBy(F.desc(order) if newest_first else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(cost).over(w)).filter(F.col("running") <= budget)


def first_lines(lines: DataFrame, limit: int = 400, file: str = "file", no: str = "n", line: str = "text") -> DataFrame:
    """The first lines as `L<n>: text`, and a marker row when there are more."""
    w = Window.partitionBy(file).orderBy(no)
    ranked = lines.withColumns({"_r": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(file))})
    shown = F.when(F.col("_r") <= limit, F.concat(F.lit("L"), F.col(no).cast("string"), F.lit(": "), F.col(line))).otherwise(F.concat(F.lit("... "), (F.col("_n") - limit).cast("string"), F.lit(" more lines")))
    return ranked.filter(F.col("_r") <= limit + 1).select(file, F.col("_r").alias("row"), shown.alias("shown"))


def size_cap(rows: DataFrame, key: str, order: str, chars: str, cap: int = 40000) -> DataFrame:
    """The first floor(rows * cap / chars) rows of each key, one at least, all when they fit."""
    whole = Window.partitionBy(key)
    keep = F.when(F.sum(chars).over(whole) <= cap, F.count("*").over(whole)).otherwise(F.greatest(F.lit(1), F.floor(F.count("*").over(whole) * cap / F.sum(chars).over(whole))))
    ranked = rows.withColumns({"_keep": keep, "_r": F.row_number().over(whole.orderBy(order))})
    return ranked.filter("_r <= _keep").drop("_keep", "_r")


def unique_names(entries: DataFrame, folder: str = "folder", name: str = "name", order: str = "id") -> DataFrame:
    """The first row of a name in a folder keeps it; others get ` (N)` before the extension, with the N that no
    other row of the folder has."""
    stem = F.regexp_replace(name, "(\\.[^.]*)$", "")
    ext = F.regexp_extract(name, "(\\.[^.]*)$", 1)
    ranked = entries.withColumn("_r", F.row_number().over(Window.partitionBy(folder, name).orderBy(order)))
    extra = ranked.filter("_r > 1")
    most = ranked.groupBy(folder, name).agg(F.max("_r").alias("_n")).filter("_n > 1")
    # Of 1.. up to rows plus names taken, the free ones by order are given to the rows by order.
    tried = most.join(entries.groupBy(folder).agg(F.count_if(F.col(name).rlike(" \\([0-9]+\\)(\\.[^.]*)?$")).alias("_t")), folder).withColumn("k", F.explode(F.sequence(F.lit(1), (F.col("_n") - 1 + F.col("_t")).cast("int"))))
    tried = tried.withColumn("_new", F.concat(stem, F.lit(" ("), F.col("k").cast("string"), F.lit(")"), ext))
    taken = entries.select(folder, F.col(name).alias("_new")).distinct()
    free = tried.join(taken, [folder, "_new"], "left_anti").withColumn("_r", F.row_number().over(Window.partitionBy(folder, name).orderBy("k")) + 1)
    named = extra.join(free.select(folder, name, "_r", "_new"), [folder, name, "_r"]).select(*entries.columns, F.col("_new").alias("unique_name"))
    return ranked.filter("_r = 1").select(*entries.columns, F.col(name).alias("unique_name")).unionByName(named)


def session_notes(notes: DataFrame, session: str = "session_id", at: str = "created_at", note: str = "note_id", ids: str = "entry_ids", most: int = 60, most_ids: int = 30) -> DataFrame:
    """Per session its first notes and their distinct ids in order of first mention."""
    first = notes.withColumn("_r", F.row_number().over(Window.partitionBy(session).orderBy(at, note))).filter(F.col("_r") <= most)
    each = F.array_sort(F.collect_list(F.struct("_r", F.col(note).alias("_note"), F.col(ids).alias("_ids"))))
    rows = first.groupBy(session).agg(each.alias("_e"))
    return rows.select(session, F.transform("_e", lambda s: s["_note"]).alias("notes"), F.slice(F.array_distinct(F.flatten(F.transform("_e", lambda s: s["_ids"]))), 1, most_ids).alias("ids"))
