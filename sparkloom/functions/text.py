"""Column functions on text and nested values: query terms, weights, summaries, sections, citations."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOPWORDS_SEARCH = ("about", "after", "against", "and", "are", "does", "from", "have", "into", "than", "that", "the", "their", "this", "with")
STOPWORDS_RANK = ("about", "after", "and", "are", "consisting", "does", "from", "have", "into", "larger", "than", "that", "the", "their", "this", "with")
STOPWORDS_SCORE = ("about", "after", "and", "are", "does", "from", "have", "into", "than", "that", "the", "their", "this", "with")
TOPIC_WORDS = ("release", "rollback", "security", "support", "deploy", "incident")
FACET_WEIGHTS = {"topic": 8.0, "source": 5.0, "time": 4.0, "extra": 4.0, "form": 1.5, "language": 0.5}
EDGE_PUNCTUATION = ".,;:!?()[]{}\"'"
CJK = "[\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uac00-\\ud7a3\\uf900-\\ufaff]"
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def let(value: Column, body) -> Column:
    """body(value), value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_spelling(terms: Column) -> Column:
    """Distinct terms regardless of case, each in its first spelling, in order."""
    return let(terms, lambda t: let(F.transform(t, lambda x: F.lower(x)), lambda low: F.filter(t, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)))


def split_query(text: Column) -> Column:
    """OR-terms of a query: quoted phrases whole, else split at white space and separators (F8)."""
    raw = F.regexp_extract_all(text, F.lit('"[^"]+"|[^\\s,，、;；"]+'), F.lit(0))
    terms = F.filter(F.transform(raw, lambda t: F.trim(F.replace(t, F.lit('"'), F.lit("")))), lambda t: t != "")
    return first_spelling(F.coalesce(terms, F.array().cast("array<string>")))


def strip_punctuation(term: Column) -> Column:
    return F.btrim(term, F.lit(" \t\r\n" + EDGE_PUNCTUATION))


def fts_terms(terms: Column) -> Column:
    """Terms for the full-text match: no stop words, at least three characters."""
    return F.filter(F.transform(terms, strip_punctuation), lambda t: (F.length(t) >= 3) & ~F.lower(t).isin(*STOPWORDS_SEARCH))


def short_terms(terms: Column) -> Column:
    """Terms under three characters, to be matched as substrings."""
    return F.filter(F.transform(terms, strip_punctuation), lambda t: (F.length(t) > 0) & (F.length(t) < 3))


def contains_cjk(text: Column) -> Column:
    """F11."""
    return text.rlike(CJK)


def substring_match(term: Column, fields: list[Column]) -> Column:
    """Any field contains the term, ignoring case; % and _ mean themselves."""
    hits = [F.coalesce(F.contains(F.lower(f), F.lower(term)), F.lit(False)) for f in fields]
    out = hits[0]
    for hit in hits[1:]:
        out = out | hit
    return out


def _terms(terms: Column, stopwords: tuple[str, ...]) -> Column:
    with_tokens = F.flatten(F.transform(terms, lambda t: F.concat(F.array(F.trim(t)), F.regexp_extract_all(t, F.lit("[A-Za-z0-9][A-Za-z0-9+_./-]*"), F.lit(0)))))
    clean = F.filter(F.transform(with_tokens, lambda t: F.btrim(t, F.lit(EDGE_PUNCTUATION))), lambda t: (t != "") & ~F.lower(t).isin(*stopwords))
    return first_spelling(F.filter(clean, lambda t: (F.length(t) >= 4) | t.rlike("[0-9]") | t.rlike("\\p{Lu}") | contains_cjk(t)))


def rank_terms(terms: Column) -> Column:
    """Whole terms, then their tokens, for ranking (F16)."""
    return _terms(terms, STOPWORDS_RANK)


def score_terms(terms: Column) -> Column:
    """As rank_terms(), with the shorter stop list of recall scoring."""
    return _terms(terms, STOPWORDS_SCORE)


def _weight(term: Column, long: float, digit: float, upper: float, mark: float) -> Column:
    part = lambda test, value: F.when(test, value).otherwise(0.0)
    return F.lit(1.0) + part(F.length(term) >= 7, long) + part(term.rlike("[0-9]"), digit) + part(term.rlike("\\p{Lu}"), upper) + part(term.rlike("[/+_.\\-]"), mark)


def term_weight(term: Column) -> Column:
    """F17."""
    return _weight(term, 0.5, 1.0, 0.6, 0.4)


def recall_term_weight(term: Column) -> Column:
    """R3's weights of a term."""
    return _weight(term, 0.35, 0.6, 0.4, 0.3)


def term_hits(field: Column, term: Column) -> Column:
    """Occurrences of the term in the field, ignoring case, not overlapping."""
    low, needle = F.lower(F.coalesce(field, F.lit(""))), F.lower(term)
    return F.when(F.length(needle) > 0, ((F.length(low) - F.length(F.replace(low, needle, F.lit("")))) / F.length(needle)).cast("int")).otherwise(0)


def facet_weight(facet: Column) -> Column:
    out = F.lit(2.0)
    for name, weight in FACET_WEIGHTS.items():
        out = F.when(facet == name, F.lit(weight)).otherwise(out)
    return out


def plain_summary(text: Column, limit: int = 500) -> Column:
    """White space collapsed, cut."""
    return F.substring(F.trim(F.regexp_replace(text, "\\s+", " ")), 1, limit)


def entry_text(name: Column, summary: Column, description: Column, extras: Column, limit: int = 6000) -> Column:
    """Labelled parts that are there, one a line (F32)."""
    part = lambda label, value: F.when(F.trim(value) != "", F.concat(F.lit(label + ": "), value))
    return F.substring(F.concat_ws("\n", part("Name", name), part("Summary", summary), part("Description", description), part("Extra", extras)), 1, limit)


def is_generic_title(title: Column) -> Column:
    low = F.trim(F.regexp_replace(F.lower(title), "\\s+", " "))
    return low.isin("document", "full document", "entire document") | low.rlike("^(lines [0-9]+-[0-9]+|page [0-9]+|section [0-9]+|ocr page [0-9]+)$")


def section_evidence_line(section: Column) -> Column:
    """title | summary | terms | anchor, the non-empty ones (F34). section: STRUCT<id,title,summary,key_terms,anchor>."""
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    anchor = F.when(F.trim(section["anchor"]["value"]) != "", F.concat_ws(" ", section["anchor"]["unit"], section["anchor"]["value"]))
    return F.concat_ws(" | ", some(section["title"]), some(section["summary"]), some(F.array_join(section["key_terms"], ", ")), anchor)


def is_stable_section(section: Column) -> Column:
    """Has an id and evidence, and a title of its own."""
    has = (F.trim(section["summary"]) != "") | (F.size(section["key_terms"]) > 0) | (F.trim(section["title"]) != "")
    return F.coalesce((F.trim(section["id"]) != "") & has & ~is_generic_title(section["title"]), F.lit(False))


def description_text(text: Column, sections: Column) -> Column:
    """Text, then one line for each section that says something."""
    said = F.filter(sections, lambda s: ~is_generic_title(s["title"]) | (F.trim(s["summary"]) != "") | (F.size(s["key_terms"]) > 0))
    return F.concat_ws("\n", text, F.array_join(F.transform(said, section_evidence_line), "\n"))


def normalize_sections(sections: Column, limit: int = 200, terms: int = 20) -> Column:
    """Default titles, ids and anchors; at most limit sections and terms."""

    def one(s: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        return F.struct(
            F.coalesce(F.nullif(F.trim(s["id"]), F.lit("")), F.concat(F.lit("s"), n)).alias("id"),
            F.coalesce(F.nullif(F.trim(s["title"]), F.lit("")), F.concat(F.lit("Section "), n)).alias("title"),
            F.coalesce(F.trim(s["summary"]), F.lit("")).alias("summary"),
            F.slice(F.coalesce(s["key_terms"], F.array().cast("array<string>")), 1, terms).alias("key_terms"),
            F.coalesce(s["anchor"], F.struct(F.lit("section").alias("unit"), n.alias("value"))).alias("anchor"),
        )

    return F.transform(F.slice(sections, 1, limit), one)


def renumber_sections(sections: Column) -> Column:
    """Ids s1..sN."""
    return F.transform(sections, lambda s, i: s.withField("id", F.concat(F.lit("s"), (i + 1).cast("string"))))


def section_terms(sections: Column) -> Column:
    """Key terms, then titles, each once regardless of case."""
    terms = F.flatten(F.transform(sections, lambda s: F.coalesce(s["key_terms"], F.array().cast("array<string>"))))
    return first_spelling(F.filter(F.concat(terms, F.transform(sections, lambda s: s["title"])), lambda t: F.trim(t) != ""))


def retrieval_digest(coverage: Column, sections: Column) -> Column:
    """Coverage line, at most 160 terms, at most 80 section bits of 220 characters."""
    bits = F.transform(F.slice(sections, 1, 80), lambda s: F.substring(section_evidence_line(s), 1, 220))
    return F.concat_ws("\n", coverage, F.array_join(F.slice(section_terms(sections), 1, 160), ", "), F.array_join(bits, "\n"))


def heuristic_tags(body: Column, kind: Column, name: Column) -> Column:
    """Topic words in name, kind or the body's first 4000 characters, then the kind; else document."""
    source = F.lower(F.concat_ws(" ", name, kind, F.substring(body, 1, 4000)))
    found = F.filter(F.array(*[F.lit(w) for w in TOPIC_WORDS]), lambda w: F.contains(source, w))
    tags = F.array_distinct(F.concat(found, F.when(F.coalesce(kind, F.lit("")) != "", F.array(kind)).otherwise(F.array().cast("array<string>"))))
    return F.when(F.size(tags) > 0, F.slice(tags, 1, 12)).otherwise(F.array(F.lit("document")))


_DROPPED = r"[\s\p{P}\p{Z}\p{C}]+"
#: Texts of these characters have no compatibility forms and fold as they are lowered: ASCII, Latin letters with accents
#: but for the sharp s, and Chinese characters.
_PLAIN = r"^[\x00-\x7F\u00C0-\u00D6\u00D8-\u00DE\u00E0-\u00F6\u00F8-\u00FF\u4E00-\u9FFF]*$"


@lru_cache(maxsize=1)
def _folded():
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        import unicodedata

        import regex

        dropped = regex.compile(_DROPPED)
        return texts.map(lambda t: None if t is None else dropped.sub("", unicodedata.normalize("NFKC", t)).casefold())

    return run


def normalize_quote(text: Column) -> Column:
    """Compatibility forms resolved (NFKC), without white space, punctuation, separators and control characters, case
    folded (F42). Plain texts are done in SQL; only the others meet Python."""
    plain = text.rlike(_PLAIN)
    return F.when(plain, F.lower(F.regexp_replace(text, _DROPPED, ""))).otherwise(_folded()(F.when(~plain, text)))


def quote_in_source(quote: Column, source: Column, normal: bool = False) -> Column:
    """F43; an empty quote is in nothing. normal: both are normalize_quote() forms already."""
    q, s = (quote, source) if normal else (normalize_quote(quote), normalize_quote(source))
    return F.coalesce((q != "") & F.contains(s, q), F.lit(False))


def parse_citations(text: Column) -> Column:
    """Footnote lines with an entry_id: array of (marker, entry_id, quote, page, section_id, reason), the first of
    each marker (F44)."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("^\\[\\^[^\\]]+\\]:.*entry_id\\s*="))

    def field(line: Column, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))

    def one(line: Column) -> Column:
        return F.struct(
            field(line, "^\\[\\^([^\\]]+)\\]:").alias("marker"), field(line, "entry_id\\s*=\\s*`?([0-9A-Za-z\\-]+)").alias("entry_id"), field(line, 'quote\\s*=\\s*"([^"]*)"').alias("quote"),
            field(line, "page\\s*=\\s*`?([0-9]+)").cast("int").alias("page"), field(line, "section_id\\s*=\\s*`?([0-9A-Za-z_\\-]+)").alias("section_id"), field(line, " [—–-] ([^—–]+)$").alias("reason"),
        )

    return let(F.transform(lines, one), lambda c: let(F.transform(c, lambda x: x["marker"]), lambda m: F.filter(c, lambda x, i: F.array_position(m, x["marker"]) == i + 1)))


def predict_label(answer: Column) -> Column:
    """A Verdict: line, else the first keyword class that is met."""
    said = F.upper(F.regexp_extract(answer, "(?im)^\\s*(?:\\*\\*)?\\s*Verdict\\s*:\\s*(SUPPORT|CONTRADICT|INSUFFICIENT)\\b", 1))
    low = F.lower(answer)
    has = lambda *words: low.rlike("|".join(words))
    return F.when(said != "", said).when(has("insufficient", "cannot be verified", "not possible to"), "INSUFFICIENT").when(has("contradict", "incorrect", "does not support"), "CONTRADICT").when(has("support", "accurate", "consistent with"), "SUPPORT")


def query_patterns(query: Column) -> Column:
    """The first 8 informative tokens, escaped for use as patterns."""
    tokens = F.transform(F.regexp_extract_all(query, F.lit("[A-Za-z0-9][A-Za-z0-9+_./,-]*"), F.lit(0)), lambda t: F.btrim(t, F.lit(EDGE_PUNCTUATION)))
    good = F.filter(tokens, lambda t: (t != "") & ~F.lower(t).isin(*STOPWORDS_SEARCH) & ((F.length(t) >= 4) | t.rlike("[0-9]") | t.rlike("\\p{Lu}")))
    return F.transform(F.slice(first_spelling(good), 1, 8), lambda t: F.regexp_replace(t, "([.+*?^$()\\[\\]{}|\\\\/-])", "\\\\$1"))


def heading_matches(title: Column, heading: Column) -> Column:
    """Equal once normalised, or a prefix before a delimiter; CJK titles also as compact prefixes."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), "[\\s#*_`]+", " "))
    t, h = norm(title), norm(heading)
    after = F.substring(h, F.length(t) + 1, F.lit(1))
    compact = F.startswith(F.regexp_replace(h, "\\s", ""), F.regexp_replace(t, "\\s", ""))
    return F.coalesce((t != "") & ((t == h) | (F.startswith(h, t) & after.rlike("[\\s:：.\\-–—(（]")) | (contains_cjk(t) & compact)), F.lit(False))


def last_mode(calls: Column) -> Column:
    """The last mode among auto, deep, quick of calls ARRAY<STRUCT<mode, extra STRUCT<mode>>>."""
    modes = F.transform(calls, lambda c: F.coalesce(F.when(c["mode"].isin("auto", "deep", "quick"), c["mode"]), F.when(c["extra"]["mode"].isin("auto", "deep", "quick"), c["extra"]["mode"])))
    return F.try_element_at(F.array_compact(modes), F.lit(-1))


def description_preview(text: Column, sections: Column) -> Column:
    """Text and the first three sections, cut to 320 characters with an ellipsis."""
    whole = F.concat_ws(" · ", F.nullif(F.trim(text), F.lit("")), F.nullif(F.array_join(F.transform(F.slice(sections, 1, 3), lambda s: s["title"]), " · "), F.lit("")))
    return F.when(F.length(whole) > 320, F.concat(F.substring(whole, 1, 319), F.lit("…"))).otherwise(whole)


def safe_display_name(doc_id: Column) -> Column:
    """A file name: others than letters, digits, . _ - as _, .txt, 255 characters; a hash when nothing is left."""
    clean = F.btrim(F.regexp_replace(doc_id, "[^A-Za-z0-9._-]+", "_"), F.lit("_"))
    return F.concat(F.when(clean == "", F.sha1(doc_id.cast("binary"))).otherwise(F.substring(clean, 1, 251)), F.lit(".txt"))


def cluster_id(tag_ids: Column) -> Column:
    """24 hex digits of the sorted ids' SHA-1."""
    return F.substring(F.sha1(F.array_join(F.array_sort(tag_ids), "|").cast("binary")), 1, 24)


def ids_in_nested(value: Column, limit: int = 50) -> Column:
    """UUID-shaped strings at any depth, in order, each once."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.to_json(value), F.lit(f"({UUID})"), F.lit(1))), 1, limit)


def page_of_label(labels: Column, value: Column) -> Column:
    """The page with that label, if only one has it, else the number itself if there is such a page."""
    n = F.regexp_extract(value, "([0-9]+)", 1)
    same = F.filter(F.transform(labels, lambda x: F.lower(F.trim(x))), lambda x: x == n)
    return F.when(F.size(same) == 1, F.array_position(F.transform(labels, lambda x: F.lower(F.trim(x))), n)).when((n != "") & n.try_cast("int").between(1, F.size(labels)), n.try_cast("long"))
