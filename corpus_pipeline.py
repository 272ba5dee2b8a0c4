"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet in the
shared folder and gives it to the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import exact_dedup, ngram_join, packing, quality_rules, suffix_dedup
from sparkloom.llm.common import discard, stored


#: Bytes of a repeated string. Passages of over 50 words count as repeats, and 51 words of prose have 265 bytes or more
#: in 19 cases of 20 in the languages here, 230 in 99 of 100.
REPEAT_BYTES = 240


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and blank texts have no words and go; repeated rows and texts of
    any length are judged alike; an empty table stays empty. Other columns are kept, whatever their names."""
    return quality_rules.quality_rules(docs, quality_rules.trusted_ids(spark, sf_dir), keep=docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space: the longest, then the smallest id (a null
    id is larger than all), then any one of equal rows. Null and empty texts are a group. Other columns are kept."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the smallest id; a null id is larger than all. Texts without words are
    near nothing and stay. Other columns are kept."""
    return ngram_join.near_dedup(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without strings of REPEAT_BYTES bytes that stand elsewhere too; n_chars follows the text.

    Every copy of such a string goes, the first one too: what many pages share is mostly boilerplate, and no copy is
    the original. A document that is repeated text and nothing else stays as an empty one. Null texts stay null. The
    table must have the column n_chars."""
    cut = suffix_dedup.suffix_dedup(docs, length=REPEAT_BYTES)
    return cut.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of packed sequences; a null or empty text is one piece of one token. Rows with equal ids are
    documents of their own, an empty table gives no pieces."""
    return packing.best_fit_packing(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("suffix_array_dedup", repeats), ("best_fit_packing", pack)]

#: Hashed n-gram scores and token ids can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)  # no later stage reads it
        before = docs
    return docs
