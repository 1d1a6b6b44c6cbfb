"""Joins on a key that holds most rows are split by adaptive execution."""

import pytest
from pyspark.sql import functions as F

from tidepool.llm import near, simhash, warc

SPLIT = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
    "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "16k",
}


@pytest.fixture(autouse=True)
def small_parts(spark):
    """Sizes from which a partition counts as large, small enough for small tables."""
    for name, value in SPLIT.items():
        spark.conf.set(name, value)
    yield
    for name in SPLIT:
        spark.conf.unset(name) if name != "spark.sql.shuffle.partitions" else spark.conf.set(name, "4")


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_digest_of_most_pages(spark):
    pages = spark.range(60_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a/"), F.col("id")).alias("url"), F.when(F.col("id") % 5 > 0, F.lit("x" * 120)).otherwise(F.concat(F.lit("y" * 100), F.col("id"))).alias("html"))
    archive = warc.write(pages)
    assert "skew=true" in final_plan(warc.read(archive))


def test_a_component_of_most_fingerprints(spark, monkeypatch):
    prints = spark.range(60_000).select(F.col("id").alias("doc_id"), F.col("id").alias("fp"))
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: prints)
    monkeypatch.setattr(simhash, "links", lambda *_: prints.where("fp > 0 and fp < 50000").select(F.col("fp").alias("a"), F.lit(0).cast("long").alias("b")))
    found = simhash.near_duplicates(prints.withColumn("text", F.lit("")))
    assert "skew=true" in final_plan(found)
    assert found.where("component_id = 0").count() == 50_000


def test_a_band_of_most_sets(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(near, "connected_components", lambda pairs: seen.append(pairs) or pairs.select(F.col("a").alias("v"), F.col("b").alias("root")))
    common = F.lit(" ".join(f"w{i}" for i in range(60)))
    rare = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("r"), F.hash("id", i))), " ")
    texts = spark.range(2000, numPartitions=2).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 9 > 0, F.concat(common, F.lit(" "), "id")).otherwise(rare).alias("text"))
    near.near_duplicates(texts)
    assert "skew=true" in final_plan(seen[0])
