"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns the documents it keeps.

All but the last return the columns of `documents`; the last returns each kept document's rate. A stage's
result is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import decontaminate, langid, mixing, ngram_join, pii
from foliospark.llm.common import crc_bucket, noted, release, stored, table

LEAST_SHARE = 0.4  # of a document's letters in its main language
NEAR_K, NEAR_PERCENT = 5, 80
SMALL = 1_000_000  # ids that are broadcast (8 bytes each); more are joined by a shuffle


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is among ids; rows without doc_id stay."""
    ids = stored(ids.select("doc_id").where("doc_id IS NOT NULL").distinct(), "rejected")
    return docs.join(F.broadcast(ids) if ids.count() <= SMALL else ids, "doc_id", "left_anti").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or without a main language; learns from the labelled two thirds."""
    held = F.coalesce(crc_bucket(F.col("doc_id"), 3) == 1, F.lit(False))
    found = langid.label_languages(docs, langid.train(docs.where(~held)))
    return _without(docs, found.where((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SHARE)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the smallest id, once.

    Where ids are null or repeat, rows are told apart by numbers of their own; of one group the row with the
    smallest id stays, null ids last.
    """
    n, distinct = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if n == distinct:
        found = ngram_join.similar_documents(docs, k=NEAR_K, percent=NEAR_PERCENT)
        return _without(docs, found.where("component_id < doc_id"))
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = ngram_join.similar_documents(rows.select(F.col("_row").alias("doc_id"), "text"), k=NEAR_K, percent=NEAR_PERCENT)
    named = found.select(F.col("doc_id").alias("_row"), "component_id").join(rows.select("_row", "doc_id"), "_row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_row"))
    return rows.join(first.select("_row"), "_row", "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item."""
    return _without(docs, decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by their kinds; n_chars follows the text."""
    clean = pii.redact(pii.find_personal_data(docs, pii.train(spark)))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's rate for the target mixture."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", rates),
]

#: Language labels, boosted spans and fitted rates have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Beside them one stored corpus is left at the end, and two while a stage runs: what a
    stage has made and the documents it was given are released when its own result is stored."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        with noted() as made:
            found = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return found
        before, docs = docs, stored(found, name)
        release(*made, before)
