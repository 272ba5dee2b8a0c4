"""Readers and writers: delimited, JSON, Parquet, logs, evaluation sets, snapshots, scans of file trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str | Sequence[str], sep: str = ",") -> DataFrame:
    """Types inferred from all rows; a column of mixed types is a string."""
    return spark.read.csv(path, header=True, inferSchema=True, samplingRatio=1.0, sep=sep)


def read_tsv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """S2."""
    return read_csv(spark, path, "\t")


def read_json(spark: SparkSession, path: str | Sequence[str], array: bool = False) -> DataFrame:
    """S3: records by line, or with array one JSON value a file."""
    return spark.read.json(path, multiLine=array)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S4."""
    return spark.read.parquet(path)


def read_many_as_one(parts: dict[str, DataFrame], name_col: str = "__sheet_name") -> DataFrame:
    """Union by column name, missing columns null, all cells strings, with the part's name."""
    out = None
    for name, df in parts.items():
        part = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns], F.lit(name).alias(name_col))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_log_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, n, text) for files that fit a row each; gzip by extension. Large single files: split_log_lines()."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split(F.regexp_replace("value", "\\R$", ""), "\\R").alias("_l"))
    return rows.select("file", F.posexplode("_l").alias("n", "text")).withColumn("n", F.col("n") + 1)


def split_log_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """S6 for files of any size: lines numbered by the counts of the blocks before theirs. monotonically_increasing_id()
    orders lines within a partition; counts per partition give each its start."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_i"), F.col("value").alias("text"))
    starts = lines.groupBy("file", "block").agg(F.count("*").alias("_c"), F.min("_i").alias("_first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    return lines.join(starts, ["file", "block"]).select("file", (F.col("_before") + F.col("_i") - F.col("_first") + 1).alias("n"), "text")


def read_corpus_jsonl(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(doc_id, title, text, metadata)."""
    raw = spark.read.text(path).select(F.from_json("value", "_id string, id string, title string, text string, metadata string").alias("r"))
    doc_id = F.coalesce("r._id", "r.id")
    meta = F.when(F.startswith(F.ltrim("r.metadata"), F.lit("{")), F.col("r.metadata"))
    out = raw.select(doc_id.alias("doc_id"), F.coalesce("r.title", F.lit("")).alias("title"), F.coalesce("r.text", F.lit("")).alias("text"), meta.alias("metadata")).filter("doc_id <> ''")
    return out if limit is None else out.limit(limit)


def read_queries_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text, metadata) with neither blank."""
    raw = read_corpus_jsonl(spark, path).select(F.trim("doc_id").alias("query_id"), F.trim("text").alias("text"), "metadata")
    return raw.filter("query_id <> '' AND text <> ''")


def parse_qrels(lines: DataFrame, line: str = "value", order: str | None = None) -> DataFrame:
    """(query_id, doc_id, rel) of three or four fields, without a header and bad rows; of a repeated pair the last."""
    n = F.col(order) if order else F.monotonically_increasing_id()
    f = F.split(F.trim(line), "\\s+")
    four = (F.size(f) >= 4) & F.get(f, F.lit(1)).isin("0", "Q0")
    rows = lines.select(n.alias("_n"), F.get(f, F.lit(0)).alias("query_id"), F.when(four, F.get(f, F.lit(2))).otherwise(F.get(f, F.lit(1))).alias("doc_id"), F.when(four, F.get(f, F.lit(3))).otherwise(F.get(f, F.lit(2))).alias("_rel"))
    rows = rows.withColumn("rel", F.col("_rel").try_cast("double").cast("int")).filter("rel IS NOT NULL AND query_id <> ''")
    return rows.groupBy("query_id", "doc_id").agg(F.max_by("rel", "_n").alias("rel"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    return parse_qrels(spark.read.text(path))


def render_document(doc_id: Column, title: Column, metadata: Column, text: Column) -> Column:
    """Id line, title, metadata, body."""
    some = lambda c, prefix: F.when(F.trim(c) != "", F.concat(F.lit(prefix), c))
    return F.concat_ws("\n\n", some(doc_id, "doc_id: "), some(title, "# "), some(metadata, "metadata: "), some(text, ""))


def scan_files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path, length, modified, sha256) of a tree, without dot files and folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kept = files.filter(~F.col("path").rlike("/\\.[^/]")) if "/." not in root else files
    out = kept.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), *(["content"] if content else []))
    return out


def export_csv(df: DataFrame, path: str, cap: int | None = 100_000) -> bool:
    """Writes at most cap rows with a header (None: all, by all tasks); whether there were more."""
    if cap is None:
        df.write.csv(path, header=True)
        return False
    more = not df.offset(cap).limit(1).isEmpty()
    (df.limit(cap) if more else df).write.csv(path, header=True)
    return more


def write_snapshot(tables: dict[str, DataFrame], path: str, blobs: DataFrame | None = None) -> DataFrame:
    """One JSON folder per table and a manifest (name, rows, bytes) as DataFrame; blobs (sha256, content) once."""
    counts = None
    for name, df in tables.items():
        df.write.json(f"{path}/{name}")
        part = df.sparkSession.read.text(f"{path}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("bytes"))
        counts = part if counts is None else counts.unionByName(part)
    if blobs is not None:
        once = blobs.dropDuplicates(["sha256"])
        once.write.parquet(f"{path}/blobs")
        counts = counts.unionByName(once.agg(F.lit("blobs").alias("name"), F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes")))
    return counts


def snapshot_scope(folders: DataFrame, entries: DataFrame, relations: DataFrame, notes: DataFrame, conversations: DataFrame, sessions: DataFrame) -> dict[str, DataFrame]:
    """What of each table a snapshot holds: live rows, relations with both ends live, conversations that notes
    refer to and their sessions."""
    live = entries.filter("deleted_at IS NULL")
    ids = live.select("id")
    rel = relations.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    conv = conversations.join(notes.select("conversation_id").dropna(), "conversation_id", "left_semi")
    return {"folders": folders.filter("deleted_at IS NULL"), "entries": live, "relations": rel, "notes": notes, "conversations": conv, "sessions": sessions.join(conv.select("session_id"), "session_id", "left_semi")}


#: (pipeline, level, kind, pattern): level 1 wins over 7. Fixed order of precedence: overriding extension, overriding
#: file name, exact type, type prefix, extension, file name, fallback.
ROUTES = (
    ("log", 1, "ext", "log"), ("log", 2, "name", "\\.log\\.[0-9]+$"), ("log", 2, "name", "\\.log-[0-9]{4}(-?[0-9]{2}){2}$"),
    ("html", 3, "mime", "text/html"), ("email", 3, "mime", "message/rfc822"), ("archive", 3, "mime", "application/zip"), ("table", 3, "mime", "text/csv"),
    ("image", 4, "prefix", "image/"), ("text", 4, "prefix", "text/"),
    ("html", 5, "ext", "html"), ("html", 5, "ext", "htm"), ("email", 5, "ext", "eml"), ("archive", 5, "ext", "zip"), ("archive", 5, "ext", "tar"), ("table", 5, "ext", "csv"), ("table", 5, "ext", "tsv"), ("text", 5, "ext", "md"),
    ("archive", 6, "name", "\\.tar\\.gz$"), ("fallback", 7, "any", ""),
)


def route_format(mime: Column, ext: Column, name: Column, routes=ROUTES) -> Column:
    """The pipeline of a file."""
    tests = {
        "ext": lambda p: F.lower(F.ltrim(ext, F.lit("."))) == p, "name": lambda p: F.lower(name).rlike(p), "mime": lambda p: F.lower(mime) == p,
        "prefix": lambda p: F.startswith(F.lower(mime), F.lit(p)), "any": lambda p: F.lit(True),
    }
    out = None
    for pipeline, _, kind, pattern in sorted(routes, key=lambda r: r[1]):
        test = F.coalesce(tests[kind](pattern), F.lit(False))
        out = F.when(test, pipeline) if out is None else out.when(test, pipeline)
    return out


#: Extensions that say most about an archive, in order; names that do are two places better.
MEMBER_EXTS = ("md", "txt", "rst", "py", "ts", "js", "go", "rs", "java", "json", "yaml", "toml", "csv", "html")


def pick_members(members: DataFrame, archive: str = "archive", path: str = "path", size: str = "size") -> DataFrame:
    """Per archive the members to read: by extension and telling name, then size; 8, or 16 when all are small."""
    ext = F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(e) for e in MEMBER_EXTS]), ext), F.lit(0)), F.lit(len(MEMBER_EXTS) + 1))
    named = F.lower(F.regexp_extract(path, "([^/]+)$", 1)).rlike("^(readme|index|main|package|pyproject|changelog)")
    cap = F.when(F.max(size).over(Window.partitionBy(archive)) < 4096, 16).otherwise(8)
    w = Window.partitionBy(archive).orderBy(rank - F.when(named, 2).otherwise(0), size, path)
    return members.withColumns({"pick": F.row_number().over(w), "_cap": cap}).filter("pick <= _cap").drop("_cap")


def glob_pattern(glob: str) -> str:
    """A glob as regular expression: * any run, ? one character, [..] a class."""
    import re

    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2)
        if c == "[" and end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]"
            i = end
        else:
            out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
        i += 1
    return f"^(?s:{out})$"


def list_members(members: DataFrame, glob: str, limit: int, offset: int = 0, archive: str = "archive", path: str = "path") -> DataFrame:
    """A page of each archive's members that match, with total and has_more."""
    hit = members.filter(F.col(path).rlike(glob_pattern(glob)))
    ranked = hit.withColumns({"row": F.row_number().over(Window.partitionBy(archive).orderBy(path)), "total": F.count("*").over(Window.partitionBy(archive))})
    return ranked.filter(F.col("row").between(offset + 1, offset + limit)).withColumn("has_more", F.col("total") > offset + limit)


def parse_reflog(lines: DataFrame, repo: str = "repo", line: str = "text", no: str = "n", most: int = 20) -> DataFrame:
    """(repo, old, new, who, at, message) newest first, each new hash once."""
    p = "^([0-9a-f]{40}) ([0-9a-f]{40}) (.*) ([0-9]+) [+-][0-9]{4}\\t(.*)$"
    g = lambda i: F.regexp_extract(line, p, i)
    rows = lines.filter(F.col(line).rlike(p)).select(repo, no, g(1).alias("old"), g(2).alias("new"), g(3).alias("who"), g(4).cast("long").alias("at"), g(5).alias("message"))
    once = rows.withColumn("_d", F.row_number().over(Window.partitionBy(repo, "new").orderBy(F.desc(no)))).filter("_d = 1").drop("_d")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(repo).orderBy(F.desc(no)))).filter(F.col("rank") <= most)


def infer_delimited(spark: SparkSession, path: str, sample: int = 20) -> DataFrame:
    """A delimited file: tab, pipe or comma, whichever the first lines have alike and most; header if its names
    are distinct, not empty and no numbers while data has some."""
    import re

    lines = [r["value"] for r in spark.read.text(path).limit(sample).collect() if r["value"].strip()]
    counts = {d: [line.count(d) for line in lines] for d in "\t|,"}
    even = [d for d, c in counts.items() if c and min(c) == max(c) > 0]
    sep = max(even or counts, key=lambda d: sum(counts[d]))
    number = lambda s: bool(re.fullmatch(r"\s*[+-]?[0-9.]+\s*", s))
    head = lines[0].split(sep) if lines else []
    header = len(set(head)) == len(head) and all(h.strip() and not number(h) for h in head) and any(number(c) for line in lines[1:] for c in line.split(sep))
    df = spark.read.csv(path, sep=sep, header=header, inferSchema=True)
    names = [re.sub(r"\W+", "_", h.strip().lower()).strip("_") or f"col_{i}" for i, h in enumerate(head, 1)] if header else [f"col_{i}" for i in range(1, len(df.columns) + 1)]
    return df.toDF(*names)
