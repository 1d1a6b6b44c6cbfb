"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.session import new_path, remove

#: Rounds needed are logarithmic in the longest chain; a run that has not ended by then is an error.
MAX_ROUNDS = 60


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = MAX_ROUNDS) -> DataFrame:
    """(v, root) for every vertex with a link to another one; root is the least vertex of its component.

    Vertices are longs; direction, repeats, self-links and null ends do not matter. Every round is
    written to the shared folder, so lineage stays short and a lost executor costs one round at
    most; the round before it is deleted. Minima are aggregated before they are shuffled, and dealt
    anew before they are joined, so that adaptive execution can split the links of a vertex with very
    many neighbours. RuntimeError if the rounds do not suffice.
    """
    spark = edges.sparkSession
    folder = new_path(spark, "components")

    def kept(df: DataFrame, k: int) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{k}")
        return spark.read.schema("a long, b long").parquet(f"{folder}/{k}")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 30)), F.sum(F.hash("b", "a").cast("long"))).first())

    plain = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    now = kept(plain.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), 0)
    before = None
    for k in range(1, rounds + 1):
        is_now = state(now)
        if is_now == before or not is_now[0]:
            break
        if k == rounds:
            raise RuntimeError(f"the components are not complete after {rounds} rounds")
        before = is_now
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).repartition("a", "m")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).repartition("a", "m")
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now = kept(small, k)
        remove(spark, f"{folder}/{k - 1}")
    roots = now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("v"), F.col("b").alias("root")).union(roots)
