"""Licence recognition by sentence rules.

Each sentence of a text is normalised and looked up among known licence sentences; the identifiers found, in the order
of the text, are then matched against ordered rules. All of it is built-in expressions on one row: no shuffle.

One-line notices are looked up line by line. Sentences of licence texts (license_phrases) may be wrapped: they are
searched in sentences that end at a blank line or at . ! or ? only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.license_phrases import PHRASES, TEXT_RULES, WORDS

#: Known sentences, normalised: lower case, runs of other characters than a-z, 0-9 as one space.
SENTENCES = {
    "MIT_NAME": "released under the mit license",
    "MIT_GRANT": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "MIT_NOTICE": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "AS_IS": "the software is provided as is without warranty of any kind express or implied",
    "APACHE_2": "licensed under the apache license version 2 0",
    "APACHE_USE": "you may not use this file except in compliance with the license",
    "GPL_3": "this work is licensed under the gnu general public license version 3",
    "GPL_FREE": "this program is free software you can redistribute it and or modify it",
    "CC_BY_NC_4": "licensed under cc by nc 4 0",
}
#: (licence, its sentences in order, with no other known sentence between them).
RULES = (
    ("MIT", ("MIT_NAME",)),
    ("MIT", ("MIT_GRANT", "MIT_NOTICE", "AS_IS")),
    ("Apache-2.0", ("APACHE_2",)),
    ("Apache-2.0-header", ("APACHE_2", "APACHE_USE")),
    ("GPL-3.0", ("GPL_3",)),
    ("GPL-3.0", ("GPL_FREE", "GPL_3")),
    ("CC-BY-NC-4.0", ("CC_BY_NC_4",)),
)
#: A sentence ends at a line's end, or at . ! or ? before white space.
BREAK = r"\n|[.!?][ \t\r\f]+"


#: A sentence that may be wrapped ends at a line without letters and digits, or at . ! or ? before white space; the
#: lines of such sentences are those of BREAK.
WRAPPED_BREAK = r"\n[^a-z0-9\n]*\n|[.!?][ \t\r\f\n]+"


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _normal(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def sentences(text: Column) -> Column:
    """The normalised, non-empty sentences of a text."""
    return F.filter(F.transform(F.split(_lower(text), BREAK), _normal), lambda s: s != "")


def _struct_array(pairs, first: str, second: str) -> Column:
    return F.array(*[F.struct(F.lit(a).alias(first), F.lit(b).alias(second)) for a, b in pairs])


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] = SENTENCES, rules=RULES + TEXT_RULES, phrases=PHRASES, words=WORDS) -> DataFrame:
    """Per row of df: id_col, n_sentences, n_known, sentence_ids and licenses (both joined by |).

    A null text is empty: no sentences, empty strings. Repeated rows give repeated results and
    null ids stay; texts may have any length. An empty table gives an empty result, other columns are ignored.
    n_sentences counts the pieces that BREAK makes, as if no sentence were wrapped. known are whole pieces or whole
    wrapped sentences, phrases stand anywhere in a wrapped sentence, and all of these have one of words in them.
    Licences stand in the order of the rules, each once.
    """
    ids = F.create_map(*[F.lit(x) for name, sentence in known.items() for x in (sentence, name)])
    wanted = _struct_array(phrases, "name", "phrase")

    def named(parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda s: s.isin(*known.values())), lambda s: F.element_at(ids, s))

    def has_word(s: Column) -> Column:
        return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(s, w))

    def of_wrapped(part: Column) -> Column:
        # What the sentence as a whole gives besides its lines, then what these give.
        def whole(s: Column) -> Column:
            inside = F.filter(wanted, lambda p: F.contains(F.concat(F.lit(" "), s, F.lit(" ")), F.concat(F.lit(" "), p["phrase"], F.lit(" "))))
            return F.array_union(named(F.array(s)), F.transform(inside, lambda p: p["name"]))

        lines = named(F.transform(F.split(part, "\n"), _normal))
        return F.when(has_word(part), F.concat(F.array_except(F.flatten(F.transform(F.array(_normal(part)), whole)), lines), lines)).otherwise(lines)

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col), sentences(text).alias("_s"), _lower(text).alias("_t"))
    wrapped = F.flatten(F.transform(F.split("_t", WRAPPED_BREAK), of_wrapped))
    found = rows.select(id_col, F.size("_s").alias("n_sentences"), F.when(has_word(F.col("_t")), wrapped).otherwise(named(F.col("_s"))).alias("_k"))
    found = found.select(id_col, F.col("n_sentences").cast("long"), F.size("_k").cast("long").alias("n_known"), F.array_join("_k", "|").alias("sentence_ids"))
    line = F.concat(F.lit("|"), F.col("sentence_ids"), F.lit("|"))
    tests = _struct_array([(name, "|" + "|".join(sequence) + "|") for name, sequence in rules], "name", "ids")
    hits = F.transform(F.filter(tests, lambda r: F.contains(line, r["ids"])), lambda r: r["name"])
    return found.withColumn("licenses", F.when(F.col("sentence_ids") == "", F.lit("")).otherwise(F.array_join(F.array_distinct(hits), "|")))


def _sql() -> str:
    names = ", ".join(f"'{s}': '{n}'" for n, s in SENTENCES.items())
    inside = ", ".join(f"'{s}'" for s in SENTENCES.values())
    licences = list(dict.fromkeys(name for name, _ in RULES))
    tests = {name: " OR ".join(f"contains(line, '|{'|'.join(seq)}|')" for n, seq in RULES if n == name) for name in licences}
    hits = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in tests.items())
    return rf"""
WITH s AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\n|[.!?][ \t\r\f]+'),
         lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS parts FROM documents
), k AS (
  SELECT doc_id, len(parts) AS n_sentences, list_filter(parts, lambda x: x IN ({inside})) AS known FROM s
), j AS (
  SELECT doc_id, n_sentences, len(known) AS n_known,
         coalesce(array_to_string(list_transform(known, lambda x: (MAP {{{names}}})[x]), '|'), '') AS sentence_ids FROM k
), l AS (SELECT *, '|' || sentence_ids || '|' AS line FROM j)
SELECT doc_id, n_sentences::BIGINT AS n_sentences, n_known::BIGINT AS n_known, sentence_ids,
       coalesce(array_to_string(list_filter([{hits}], lambda x: x IS NOT NULL), '|'), '') AS licenses
FROM l
"""


SQL = _sql()
