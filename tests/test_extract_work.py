"""What the extractors do for each mail and each archive's member."""

from __future__ import annotations

import base64
import email.headerregistry
import email.policy
import io
import zipfile

import pandas as pd

from sparkloom.sources import extract


class Files:
    """Stands for a DataFrame: gives the function that Spark would run."""

    def select(self, *columns):
        return self

    def mapInPandas(self, run, schema):
        return run


def archive(*bodies):
    with zipfile.ZipFile(data := io.BytesIO(), "w", zipfile.ZIP_DEFLATED) as z:
        for i, body in enumerate(bodies):
            z.writestr(f"{i}.txt", body)
    return data.getvalue()


def test_members_are_sent_on_together(monkeypatch):
    files = pd.DataFrame({"path": [f"f{i}" for i in range(50)] + ["empty", "none"], "content": [archive("a", "bc")] * 50 + [archive(), None]})
    want = [(f"f{i}", f"{j}.txt", 1 + j, (b"a", b"bc")[j]) for i in range(50) for j in range(2)]
    run = extract.explode_archive(Files())
    frames = list(run(iter([files.iloc[:30], files.iloc[30:]])))
    assert len(frames) == 1 and [tuple(r) for f in frames for r in f.itertuples(index=False)] == want
    monkeypatch.setattr(extract, "MEMBER_ROWS", 7)
    frames = list(run(iter([files])))
    assert len(frames) == 15 and [tuple(r) for f in frames for r in f.itertuples(index=False)] == want
    monkeypatch.setattr(extract, "MEMBER_BYTES", 3)
    assert [len(f) for f in run(iter([files]))] == [2] * 50
    assert list(run(iter([files.iloc[50:]]))) == []


def mail(subject, sender, kind=b"text/plain", more=b""):
    return (
        b"Subject: " + subject + b"\r\nFrom: " + sender + b"\r\n" + more + b'MIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary="b' + str(len(subject)).encode()
        + b'"\r\n\r\n--b%d\r\nContent-Type: %s; charset=utf-8\r\n\r\n<p>body</p>\r\n--b%d\r\nContent-Disposition: attachment; filename="a b.bin"\r\n\r\nxyz\r\n--b%d--\r\n' % (len(subject), kind, len(subject), len(subject))
    )


MAILS = [
    b"", b"no header", mail(b"plain", b"a@example.com"), mail(b"=?utf-8?q?caf=C3=A9?= x", b"=?utf-8?b?w6k=?= <a@example.com>, b@example.com"), mail(b"raw \xe9\xff", b"group: a@example.com, b@example.com;"),
    mail(b"folded\r\n  on " * 3, b"bad <a@", b"text/html"), mail(b"long " * 300, b"a@example.com", b"text/html", b"To: " + b"a@example.com, " * 100 + b"z@example.com\r\nDate: 1 Jan 2024 00:00:00 +0000\r\n"),
    mail(b"", b"", b"no type", b"Subject: again\r\nDate: never\r\n"),
]


def test_headers_kept_give_what_the_default_policy_gives(monkeypatch):
    kept = [extract.parse_email(m) for m in MAILS + MAILS]
    monkeypatch.setattr(extract, "_POLICY", email.policy.default)
    assert kept == [extract.parse_email(m) for m in MAILS + MAILS]


def test_a_header_is_parsed_once(monkeypatch):
    parsed, call = [], email.headerregistry.HeaderRegistry.__call__

    def counted(self, name, value):
        parsed.append(name)
        return call(self, name, value)

    monkeypatch.setattr(email.headerregistry.HeaderRegistry, "__call__", counted)
    for i in range(20):
        extract.parse_email(mail(b"s" * (i + 1) + b" once", b"s%d@example.com" % i))
    assert len(parsed) <= 20 * 7  # of 7 headers each, and 4 of their types are alike


def test_a_mails_text_is_whole():
    long = "é <b> " * 50_000 + "end"
    for kind, want in ((b"text/plain", long), (b"text/html", "é " * 49_999 + "é end")):
        data = b"Subject: s\r\nMIME-Version: 1.0\r\nContent-Type: " + kind + b"; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n" + base64.encodebytes(long.encode())
        assert extract.parse_email(data)[4] == want
