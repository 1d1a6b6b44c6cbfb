"""Folders that are polled: files that are new or have changed since the last time.

A file is known by a fingerprint of its size and time. Spark's own file streams read a path once; this
also takes files that were written anew. The state is a versioned table, so that a poll that fails
leaves it as it was, and what it took is taken again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators.store import Versions

#: Files smaller than this are left alone. Fixed value.
SMALLEST = 1


def listed(spark: SparkSession, folder: str, glob: str = "*.jsonl") -> DataFrame:
    """(path, fingerprint) of the files in a folder and below; nothing of them is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    mark = F.md5(F.concat_ws(":", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")))
    return files.where(F.col("length") >= SMALLEST).select("path", mark.alias("fingerprint"))


def poll(spark: SparkSession, folder: str, state: Versions, take: Callable[[list[str]], None], glob: str = "*.jsonl") -> DataFrame:
    """(path, fingerprint, status) of files that are new or changed; `take` gets their paths before the state moves on."""
    now = listed(spark, folder, glob)
    known = state.read()
    known = known.withColumnRenamed("fingerprint", "before") if known is not None else spark.createDataFrame([], "path string, before string")
    found = now.join(known, "path", "left").where("before is null or before <> fingerprint")
    found = found.select("path", "fingerprint", F.when(F.col("before").isNull(), "new").otherwise("changed").alias("status"))
    rows = found.collect()  # what is new since the last poll
    if rows:
        take([r.path for r in rows])
        fresh = spark.createDataFrame([(r.path, r.fingerprint) for r in rows], "path string, fingerprint string")
        state.merge(fresh, ["path"])
    return spark.createDataFrame(rows, found.schema)
