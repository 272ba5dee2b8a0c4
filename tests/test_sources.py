"""Readers, extractors and streams on small files."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile

from pyspark.sql import functions as F

from sparkloom.sources import extract, readers
from sparkloom.streaming import jobs
from tests.conftest import rows


def test_delimited_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,x\n2,3\n")
    assert readers.read_csv(spark, str(tmp_path / "a.csv")).dtypes == [("id", "int"), ("v", "string")]
    (tmp_path / "b.txt").write_text("Name|Age\nann|3\nbo|4\n")
    got = readers.infer_delimited(spark, str(tmp_path / "b.txt"))
    assert got.columns == ["name", "age"] and rows(got) == [("ann", 3), ("bo", 4)]
    both = readers.read_many_as_one({"s1": spark.createDataFrame([(1,)], "a int"), "s2": spark.createDataFrame([("z",)], "b string")})
    assert rows(both, "__sheet_name", "a", "b") == [("s1", "1", None), ("s2", None, "z")]


def test_logs(spark, tmp_path):
    (tmp_path / "x.log").write_text("a\nb\n")
    with gzip.open(tmp_path / "y.log.gz", "wt") as f:
        f.write("c\n")
    got = readers.read_log_lines(spark, str(tmp_path))
    assert sorted((r.n, r.text) for r in got.collect()) == [(1, "a"), (1, "c"), (2, "b")]
    assert sorted((r.n, r.text) for r in readers.split_log_lines(spark, str(tmp_path / "x.log")).collect()) == [(1, "a"), (2, "b")]


def test_beir(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"_id": "1", "text": "t", "metadata": {"a": 1}}\n{"id": "2", "title": "T", "metadata": 3}\n{"text": "no id"}\n')
    assert rows(readers.read_corpus_jsonl(spark, str(tmp_path / "c.jsonl"))) == [("1", "", "t", '{"a":1}'), ("2", "T", "", None)]
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1.0\nq1\td1\t2\nq2 0 d2 1\nbad\n")
    assert rows(readers.read_qrels(spark, str(tmp_path / "q.tsv"))) == [("q1", "d1", 2), ("q2", "d2", 1)]


def test_archives_email_html(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        for name in ("ok.txt", "../up.txt", "node_modules/x.js", ".git/HEAD", ".git/objects/x", "a.pyc"):
            f.writestr(name, b"data")
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        i = tarfile.TarInfo("in.md")
        i.size = 2
        f.addfile(i, io.BytesIO(b"hi"))
    files = spark.createDataFrame([("z", bytearray(z.getvalue())), ("t", bytearray(t.getvalue())), ("n", bytearray(b"nothing"))], "path string, content binary")
    assert rows(extract.explode_archive(files), "archive", "path", "size") == [("t", "in.md", 2), ("z", ".git/HEAD", 4), ("z", "ok.txt", 4)]
    raw = b"Subject: Hi\r\nFrom: a@example.com\r\nContent-Type: text/html\r\n\r\n<p>One</p><li>two &amp; three"
    mail = extract.extract_email(spark.createDataFrame([("m", bytearray(raw))], "path string, content binary")).first()
    assert (mail.subject, mail.text) == ("Hi", "One\n- two & three")
    raw = spark.createDataFrame([(1, bytearray("é".encode())), (2, bytearray("é".encode("cp1252"))), (3, bytearray("﻿x".encode("utf-16-le"))), (4, bytearray(b"\xef\xbb\xbfy"))], "id int, content binary")
    assert rows(extract.decode_text(raw), "id", "text") == [(1, "é"), (2, "é"), (3, "x"), (4, "y")]


def test_routes_members_reflog(spark):
    f = spark.createDataFrame([("text/plain", "log", "app.log"), ("text/plain", "1", "app.log.1"), ("text/html", "x", "x"), ("", "csv", "a.csv"), ("image/png", "", "p"), (None, None, None)], "mime string, ext string, name string")
    assert [r.p for r in f.select(readers.route_format(F.col("mime"), F.col("ext"), F.col("name")).alias("p")).collect()] == ["log", "log", "html", "table", "image", "fallback"]
    m = spark.createDataFrame([("z", f"f{i}.py", 10_000) for i in range(20)] + [("z", "README.md", 5000)], "archive string, path string, size long")
    got = readers.pick_members(m).orderBy("pick").collect()
    assert len(got) == 8 and got[0].path == "README.md"
    assert rows(readers.list_members(m, "f1?.py", 3), "path", "has_more") == [("f10.py", True), ("f11.py", True), ("f12.py", True)]
    h = ["0" * 40, "1" * 40, "2" * 40]
    log = spark.createDataFrame([("r", 1, f"{h[0]} {h[1]} Al <a@x> 10 +0000\tone"), ("r", 2, f"{h[1]} {h[2]} Al <a@x> 20 +0000\ttwo"), ("r", 3, "junk")], "repo string, n int, text string")
    assert [r.message for r in readers.parse_reflog(log).orderBy("rank").collect()] == ["two", "one"]


def test_snapshot(spark, tmp_path):
    t = spark.createDataFrame([(1, "a")], "id int, x string")
    m = readers.write_snapshot({"t": t}, str(tmp_path / "s"), spark.createDataFrame([("h", bytearray(b"ab")), ("h", bytearray(b"ab"))], "sha256 string, content binary"))
    assert rows(m, "name", "rows") == [("blobs", 1), ("t", 1)]
    assert readers.export_csv(spark.range(5), str(tmp_path / "o"), 3) is True


def test_streams_equal_batches(spark, tmp_path):
    e = spark.createDataFrame([(i, f"2024-01-0{1 + i // 4} 0{i % 4}:10:00", i % 2, float(i)) for i in range(12)], "event_id int, ts string, user_id int, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    got = jobs.run_once(jobs.buckets(stream, "ts", "1 hour", "user_id"), str(tmp_path / "c1"), "b1", "complete")
    assert rows(got) == rows(jobs.buckets(e, "ts", "1 hour", "user_id"))
    seen: list[int] = []
    for n in (1, 2):
        src = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")).select(F.col("user_id").cast("string").alias("sha256"))
        jobs.ingest_new(src, str(tmp_path / "known"), str(tmp_path / f"c{n + 1}"), lambda df, number: seen.append(df.count())).start().awaitTermination()
    assert seen == [2, 0]


def test_cooldown(spark, tmp_path):
    e = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 01:00:00"), ("a", "2024-01-02 02:00:00"), ("b", "2024-01-01 00:00:00")], "k string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    got = jobs.run_once(jobs.cooldown(stream, "k", "ts"), str(tmp_path / "c"), "cool")
    assert [(r.k, str(r.ts)) for r in got.orderBy("k", "ts").collect()] == [("a", "2024-01-01 00:00:00"), ("a", "2024-01-02 02:00:00"), ("b", "2024-01-01 00:00:00")]
