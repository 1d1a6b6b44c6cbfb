"""A corpus pipeline: language, toxicity, near-duplicates, decontamination, packing.

Each stage works on all that its predecessor kept, written as Parquet and read again. Stages that
filter return the columns of documents; the last one returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import decontam, langid, near, packing, simhash, toxicity
from tidepool.llm.common import fresh_path, numbered, table, whole_row
from tidepool.llm.queries import language_model, toxicity_model
from tidepool.session import swept

#: A document whose words have less than this mean posterior in its best language is rejected.
LANGUAGE_SCORE = 0.3
TOXIC_SCORE = 0.7


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and a language; others, null and empty texts included, go. Null ids and repeated rows are judged by their text like all others; further columns go along; an empty table stays empty. Without a document of a known language nothing is known of any, and all go."""
    judged = langid.predict(whole_row(docs, "doc_id", "text"), language_model(docs), with_runs=False, carry="whole")
    return judged.where((F.col("lang") != langid.UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE)).select("whole.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic. Null texts count as empty and stay; null ids and repeated rows are judged by their text; further columns go along; an empty table stays empty."""
    scored = toxicity.score(whole_row(docs, "doc_id", "text"), toxicity_model(docs, table(spark, sf_dir, "labels")), carry="whole")
    return scored.where(F.col("score") < TOXIC_SCORE).select("whole.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more over five-word shingles: the first in the order of the rows. Fingerprints and MinHash bands find candidates, the exact similarity decides. Null and empty texts, and texts without words, are copies of each other; ids play no part, so null and repeated ones are like all others; further columns go along; an empty table stays empty."""
    rows = numbered(docs, "near-rows")
    texts = rows.select("row", "whole.text")
    close = simhash.near_duplicates(texts, id_col="row").where("doc_id <> component_id")
    groups = near.near_duplicates(texts, id_col="row", more=close.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias("row"))
    return rows.join(kept, "row", "left_semi").select("whole.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null texts count as empty and stay; ids play no part; of repeated rows all stay or all go; further columns go along; an empty table stays empty."""
    rows = numbered(docs, "decontam-rows")
    leaks = decontam.contained(rows.select("row", "whole.text"), table(spark, sf_dir, "benchmark"), id_col="row")
    return rows.join(leaks.select(F.col("doc_id").alias("row")), "row", "left_anti").select("whole.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents. Null texts count as empty and give one piece, their end id; null ids stay null; repeated rows are packed each for itself; further columns are left out."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("packing", packed)]

#: Trained models and hashes are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    folder, docs = fresh_path(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with swept(spark):  # what the stage wrote on its way goes with it
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
