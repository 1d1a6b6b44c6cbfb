"""What the operators share: table access, the shared folder, input columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.session import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, what: str) -> str:
    return new_path(spark, what)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, **columns: tuple[str, T.DataType]) -> DataFrame:
    """The named columns under internal names and types; all others, clashing names included, are left out."""
    return df.select(*[df[source].cast(kind).alias(name) for name, (source, kind) in columns.items()])


def crc32_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def whole_row(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns of df beside a struct `whole` of all its columns, to travel through an operator under one name."""
    return df.select(*[df[c] for c in columns], F.struct(*[df[c] for c in df.columns]).alias("whole"))


def numbered(df: DataFrame, what: str) -> DataFrame:
    """row (a unique long) and whole (a struct of all columns), written to the shared folder: however often it is read, a row keeps its number."""
    return materialise(whole_row(df).withColumn("row", F.monotonically_increasing_id()), what)


def finite_vectors(df: DataFrame, id_col: str, vector_col: str, **more: tuple[str, T.DataType]) -> DataFrame:
    """vec_id, embedding (single or double precision, as given) and further columns of the rows whose vector is there, without null or non-finite components."""
    kind = df.schema[vector_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = pick(df, vec_id=(id_col, "long"), embedding=(vector_col, T.ArrayType(T.FloatType() if single else T.DoubleType())), **more)
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.where(F.col("embedding").isNotNull() & ~bad)
