"""The corpus pipeline: quality rules, language ID, n-gram Jaccard join, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept, which is written and read again in
between. All but the last return the columns of ``docs``; other columns than doc_id, text, lang, source and n_chars are
carried along whatever their names. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binforge.llm import jaccard, langid, packing, quality, substrings
from binforge.llm.common import stage, without


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line frequencies let pass, without their lines above the limit."""
    return quality.clean(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a language; the labels of held-out documents are not learnt from."""
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("key"), "text")
    return without(docs, langid.predict(rows, model, keep=("doc_id", "key")).where("rejected"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component, and all documents without words."""
    found = stage(jaccard.join(docs), "components").where("n_shingles > 0")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = stage(found.groupBy(F.col("component").alias("_c")).agg(F.min(row).alias("_first")), "first")
    docs = without(docs, found.join(first, F.col("component") == F.col("_c")).where(row != F.col("_first")))
    # Repeated rows stand for themselves above; one of each stays.
    again = found.groupBy("doc_id", "key").count().where("count > 1")
    return docs if again.isEmpty() else docs.dropDuplicates(["doc_id", "text"])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those of nothing but such passages go."""
    found = substrings.dedup(docs)
    text = F.when(F.size("spans") > 0, F.col("kept")).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return found.where("n_words = 0 or kept <> ''").select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, packed."""
    return packing.packed_documents(docs)


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("n-gram Jaccard join", near_duplicates), ("substring dedup", substring_dedup), ("packing", pack)]

#: Tokens, languages and components are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
