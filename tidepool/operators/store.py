"""Append-only tables: append, supersede, delete, latest, content addressing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators.text import let
from tidepool.session import new_path, remove


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the session's shared folder."""
    return new_path(spark, name)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def appended(spark: SparkSession, name: str, *parts: DataFrame) -> DataFrame:
    """The parts written one after the other and read back as one table."""
    path = scratch(spark, name)
    for part in parts:
        append(part, path)
    return spark.read.schema(parts[0].schema).parquet(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so that it is computed once, however often it is used."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def superseded(table: DataFrame, changes: DataFrame, id_col: str, status: str = "status") -> DataFrame:
    """Old rows named by changes.old_id become superseded; the new rows come beside them."""
    old = changes.select(F.col("old_id").alias(id_col), F.lit("superseded").alias("mark"))
    kept = table.join(old, id_col, "left").withColumn(status, F.coalesce("mark", status)).drop("mark")
    return kept.unionByName(changes.drop("old_id"))


def stale(entries: DataFrame, reads: DataFrame, id_col: str, as_of: Column, days: int = 120, most: int = 0) -> DataFrame:
    """(id, days, access_count) of the entries (id, written) that are older than so many days and were read (id, access_count) no more than `most` times."""
    age = F.datediff(as_of, "written").cast("long")
    found = entries.withColumn("days", age).where(F.col("days") > days).join(reads, id_col, "left")
    return found.select(id_col, "days", F.coalesce("access_count", F.lit(0)).cast("long").alias("access_count")).where(F.col("access_count") <= most)


def addressed(df: DataFrame, content: Column) -> DataFrame:
    """(sha, content, n_refs): each content once under its SHA-256."""
    return df.select(content.alias("content")).groupBy(F.sha2("content", 256).alias("sha"), "content").agg(F.count("*").alias("n_refs"))


class Versions:
    """A table as numbered versions below a folder. A write makes the next version and leaves the last one as it is, so readers of it go on; the newest whole version counts, and `keep` of them stay."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2) -> None:
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def numbers(self) -> list[int]:
        """Whole versions, which Spark marks by a file of its own when a write is complete."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v*/_SUCCESS")
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
        return sorted(int(f.getPath().getParent().getName()[1:]) for f in found or [])

    def read(self) -> DataFrame | None:
        n = self.numbers()
        return self.spark.read.parquet(f"{self.folder}/v{n[-1]:06d}") if n else None

    def write(self, df: DataFrame) -> DataFrame:
        n = self.numbers()
        df.write.mode("overwrite").parquet(f"{self.folder}/v{(n[-1] if n else 0) + 1:06d}")
        for old in n[: 1 - self.keep] if self.keep > 1 else []:
            remove(self.spark, f"{self.folder}/v{old:06d}")
        return self.read()

    def merge(self, rows: DataFrame, key: list[str], **columns: Column) -> DataFrame:
        """Rows into the table by key. `columns` say how the rows of a key make one, as aggregates over them and `newer` (1 for the rows that come, 0 for those that are there); other columns are the newest row's, of several the largest."""
        both = rows.withColumn("newer", F.lit(1))
        old = self.read()
        if old is not None:
            both = old.withColumn("newer", F.lit(0)).unionByName(both, allowMissingColumns=True)
        return self.write(merged(both, key, **columns).select(*(old if old is not None else rows).columns))


def merged(both: DataFrame, key: list[str], **columns: Column) -> DataFrame:
    """One row a key of rows with a column `newer`, see Versions.merge."""
    plain = [c for c in both.columns if c not in {*key, *columns, "newer"}]
    last = F.max(F.struct("newer", *plain)).alias("last")
    out = both.groupBy(*key).agg(last, *[c.alias(name) for name, c in columns.items()])
    return out.select(*key, *[F.col(f"last.{c}").alias(c) for c in plain], *columns)


def new_wins(value: Column) -> Column:
    """Aggregate: maps merged into one, keys of newer rows first."""
    ordered = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct(F.col("newer"), F.map_entries(value).alias("m"))))), lambda x: x.m)
    every = F.flatten(ordered)
    pick = lambda e, keys: F.map_from_entries(F.filter(e, lambda x, i: F.array_position(keys, x.key) == i + 1))
    return let(lambda e: let(pick, e, F.transform(e, lambda x: x.key)), every)


def ordered_union(values: Column, order: Column) -> Column:
    """Aggregate: arrays joined in order, each element once."""
    return F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), values.alias("v")))), lambda x: x.v)))
