"""Extractors of binary and marked-up content, as mapInPandas over files or rows."""

from __future__ import annotations

import csv
import email
import email.policy
import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What an archive's members are skipped for.
SKIP_DIRS = ("__MACOSX", "node_modules", "__pycache__", ".venv", "venv", ".idea", ".vscode", "dist", "build", "target")
SKIP_NAMES = (".DS_Store", "Thumbs.db", "desktop.ini")
SKIP_EXTS = ("pyc", "pyo", "class", "o", "so", "dll", "exe")
MEMBER_BYTES, MEMBER_ROWS = 4 << 20, 2000  # of members sent on at once; at least one


def decode(data: bytes) -> str:
    """UTF-16 only with a mark; then UTF-8, Windows-1252, Latin-1."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    for name in ("utf-8-sig", "cp1252"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1")


def decode_text(df: DataFrame, content: str = "content", out: str = "text") -> DataFrame:
    """Valid UTF-8 without a mark is decoded in SQL; only the rest meets Python."""
    plain = F.is_valid_utf8(F.col(content).cast("string")) & ~F.hex(F.substring(content, 1, 3)).rlike("^(EFBBBF|FFFE|FEFF)")
    other = F.pandas_udf(lambda s: s.map(lambda b: None if b is None else decode(b)), "string")
    return df.withColumn(out, F.when(plain, F.col(content).cast("string")).otherwise(other(F.when(~plain, F.col(content)))))


# The elements that begin a line.
LINE_TAGS = ("br", "p", "div", "tr", "h1", "h2", "h3", "h4", "h5", "h6")


class _LineCollector(HTMLParser):
    """Lines of words. The parser gives a script or style sheet as one run of data up to its end tag."""

    def reset(self):
        super().reset()
        self.lines: list[list[str]] = [[]]
        self.silent: str | None = None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.silent = tag
        elif tag in LINE_TAGS:
            self.lines.append([])
        elif tag == "li":
            self.lines.append(["- "])

    def handle_endtag(self, tag):
        if tag == self.silent:
            self.silent = None

    def handle_data(self, data):
        if self.silent:
            return
        first, *more = data.split("\n")
        self.lines[-1].append(first)
        self.lines += [[x] for x in more]


def html_text(html: str | None) -> str:
    """A line for each block, list item and line break; words one space apart, no blank lines."""
    collector = _LineCollector()
    collector.feed(html or "")
    collector.close()
    words = ("".join(line).split() for line in collector.lines)
    return "\n".join(" ".join(w) for w in words if w)


def html_to_text(df: DataFrame, id_col: str, html: str = "html") -> DataFrame:
    """(id, text) of HTML rows."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({id_col: f[id_col], "text": f[html].map(html_text)})

    return df.select(id_col, html).mapInPandas(run, f"{id_col} {kind}, text string")


def _skipped(path: str) -> bool:
    parts = path.replace("\\", "/").split("/")
    if path.startswith("/") or re.match(r"^[A-Za-z]:", path) or ".." in parts or any(p in SKIP_DIRS for p in parts[:-1]):
        return True
    git = ".git" in parts and "/".join(parts[parts.index(".git") + 1 :]) not in ("HEAD", "config", "logs/HEAD")
    return git or parts[-1] in SKIP_NAMES or parts[-1].rpartition(".")[2].lower() in SKIP_EXTS


def archive_members(name: str, data: bytes) -> Iterator[tuple[str, int, bytes]]:
    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i in z.infolist():
                if not i.is_dir() and not _skipped(i.filename):
                    yield i.filename, i.file_size, z.read(i)
        return
    try:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                if m.isfile() and not _skipped(m.name):
                    yield m.name, m.size, t.extractfile(m).read()
    except tarfile.TarError:
        return


def explode_archive(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(archive, path, size, bytes), one row per member, of zip and tar files; what is neither gives none."""
    names = ["archive", "path", "size", "bytes"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        members, held = [], 0
        for f in frames:
            for name, data in zip(f[path], f[content], strict=True):
                for member in archive_members(name, data or b""):
                    members.append((name, *member))
                    held += len(member[2])
                    if held >= MEMBER_BYTES or len(members) >= MEMBER_ROWS:
                        yield pd.DataFrame(members, columns=names)
                        members, held = [], 0
        if members:
            yield pd.DataFrame(members, columns=names)

    return files.select(path, content).mapInPandas(run, "archive string, path string, size bigint, bytes binary")


# A mail's structure is asked of its headers again and again, and the library parses a header each time it is asked.
_header = lru_cache(maxsize=512)(email.policy.default.header_fetch_parse)


class _ParsedOnce(email.policy.EmailPolicy):
    """The default policy; what it made of a short header is kept for a while."""

    def header_fetch_parse(self, name, value):
        return _header(name, value) if type(value) is str and len(value) <= 500 else super().header_fetch_parse(name, value)


_POLICY = _ParsedOnce()


def parse_email(data: bytes) -> tuple:
    m = email.message_from_bytes(data, policy=_POLICY)
    text, html, files = None, None, []
    for part in m.walk():
        if part.is_multipart():
            continue
        if part.get_content_disposition() == "attachment" or part.get_filename():
            body = part.get_payload(decode=True) or b""
            files.append({"name": part.get_filename() or "", "type": part.get_content_type(), "size": len(body)})
        elif part.get_content_type() == "text/plain" and text is None:
            text = decode(part.get_payload(decode=True) or b"")
        elif part.get_content_type() == "text/html" and html is None:
            html = decode(part.get_payload(decode=True) or b"")
    body = text if text is not None else html_text(html)
    return str(m["subject"] or ""), str(m["from"] or ""), str(m["to"] or ""), str(m["date"] or ""), body, files


def extract_email(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, subject, sender, recipients, date, text, attachments)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *parse_email(b or b"")) for p, b in zip(f[path], f[content], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "subject", "sender", "recipients", "date", "text", "attachments"])

    return files.select(path, content).mapInPandas(run, "path string, subject string, sender string, recipients string, date string, text string, attachments array<struct<name:string,type:string,size:bigint>>")


def _texts(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    return decode_text(files.select(path, content), content)


def extract_html(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, text) of HTML files."""
    return html_to_text(_texts(files, path, content), path, "text")


def extract_log(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, n, text): the lines of log files that fit a row each."""
    lines = F.split(F.regexp_replace("text", "\\R$", ""), "\\R")
    return _texts(files, path, content).select(path, F.posexplode(lines).alias("n", "text")).withColumn("n", F.col("n") + 1)


def extract_table(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, n, cells): the rows of delimited files that fit a row each, header first; tabs separate where the name
    ends in tsv. A quoted cell may hold separators and line breaks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, text in zip(f[path], f["text"], strict=True):
                cells = list(csv.reader(io.StringIO(text or "", newline=""), delimiter="\t" if name.lower().endswith("tsv") else ","))
                yield pd.DataFrame({path: name, "n": range(1, len(cells) + 1), "cells": cells})

    return _texts(files, path, content).select(path, "text").mapInPandas(run, f"{path} string, n int, cells array<string>")


def extract_nothing(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, text) with no text: what needs a model to be read, and what no one knows."""
    return files.select(path, F.lit(None).cast("string").alias("text"))


#: Extractors by S16's pipeline names; all take (files, path, content).
EXTRACTORS = {
    "email": extract_email, "archive": explode_archive, "html": extract_html, "log": extract_log, "table": extract_table, "text": _texts, "image": extract_nothing, "fallback": extract_nothing,
}


def extract_by_route(files: DataFrame, pipeline: str = "pipeline") -> dict[str, DataFrame]:
    """Files (path, content, pipeline from route_format()) through the extractor of each route."""
    return {name: run(files.filter(F.col(pipeline) == name)) for name, run in EXTRACTORS.items()}


def embed_with(df: DataFrame, embed, text: str = "text", out: str = "embedding") -> DataFrame:
    """A column of vectors from embed(list of texts) -> list of vectors, a batch at a time."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(embed(s.fillna("").tolist())))

    return df.withColumn(out, run(F.col(text)))


def rerank_with(hits: DataFrame, score, top_n: int = 80) -> DataFrame:
    """(query_id, entry_id, rerank_score) from score(query, texts) over each query's first top_n hits (query_id,
    query, entry_id, text, pos)."""
    kinds = ", ".join(f"{c} {hits.schema[c].dataType.simpleString()}" for c in ("query_id", "entry_id"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("pos")
        return pd.DataFrame({"query_id": f["query_id"], "entry_id": f["entry_id"], "rerank_score": [float(x) for x in score(f["query"].iloc[0], f["text"].tolist())]})

    return hits.filter(F.col("pos") <= top_n).groupBy("query_id").applyInPandas(run, f"{kinds}, rerank_score double")


def register_udtfs(spark) -> None:
    """SQL-facing table functions: archive_members(bytes) gives path and size, html_lines(html) the lines of S21."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="path: string, size: bigint")
    class ArchiveMembers:
        def eval(self, data: bytes):
            for path, size, _ in archive_members("", bytes(data or b"")):
                yield path, size

    @udtf(returnType="n: int, line: string")
    class HtmlLines:
        def eval(self, html: str):
            yield from enumerate(html_text(html).split("\n"), 1)

    spark.udtf.register("archive_members", ArchiveMembers)
    spark.udtf.register("html_lines", HtmlLines)
