"""The queries of this part, op1 to op13, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import ann, decontam, kdtree, langid, licenses, negatives, packing, repair, simhash, token_counts, toxicity, url_filter, warc
from tidepool.llm.common import crc32_mod, pick, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: (verdict, rule). Fixed values.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages"))).drop("url")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.base)
    starts = F.transform(base, lambda s: s.start)
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s.label))), ",")
    score = F.coalesce(F.array_max(F.transform("spans", lambda s: s.coverage)), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("spans")).alias("labels"), score.alias("score"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learned from the rows that are not held out."""
    taught = pick(labels, doc_id=("doc_id", "long"), toxic=("toxic", "int")).where(crc32_mod(F.col("doc_id"), 3) != 1)
    return toxicity.fit(pick(docs, doc_id=("doc_id", "long"), text=("text", "string")).fillna("", ["text"]), taught)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc32_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def language_model(docs: DataFrame) -> langid.Model:
    """Learned from the rows that are not held out."""
    taught = pick(docs, doc_id=("doc_id", "long"), text=("text", "string"), lang=("lang", "string")).where(crc32_mod(F.col("doc_id"), 5) != 0)
    return langid.fit(taught)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, language_model(docs), with_runs=False)
    return found.select("doc_id", (crc32_mod(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("lang").alias("lang_pred"), "score")


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), every=50, label=moved)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_simhash, op3_nearest, op4_token_counts, op5_decontamination, op6_warc, op7_url_filter, op8_licenses, op9_toxicity, op10_language, op11_exact_top_k, op12_conversation_repair, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": decontam.ORACLE, "op6_warc": warc.ORACLE, "op7_url_filter": url_filter.oracle(URL_RULES), "op8_licenses": licenses.ORACLE, "op11_exact_top_k": kdtree.ORACLE, "op13_hard_negatives": negatives.ORACLE}
