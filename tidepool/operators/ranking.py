"""Ranked lists: normalisation, fusion, re-ranking, de-duplication, budgets.

A ranked list is a DataFrame with a query column, an id and a score. Ties go to the smaller id.
Every window is partitioned by query (or session), never global.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LN2 = 0.6931471805599453


def rank(df: DataFrame, by: list[str], *order: Column, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(df: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group, with their rank."""
    return rank(df, by, *order).where(F.col("rank") <= k)


def successors(ids: DataFrame, id_col: str) -> DataFrame:
    """(id, next) of every id but the last: the next larger one there is. Ids are sorted by range; what passes between partitions is the least id of each."""
    from tidepool.operators import store

    df = ids.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    sorted_ = store.kept(df.repartitionByRange("id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id()), "successors")
    least = sorted_.groupBy("part").agg(F.min("id").alias("least"))  # a row a partition
    after = least.select("part", F.lead("least").over(Window.orderBy("part")).alias("after"))
    own = F.lead("id").over(Window.partitionBy("part").orderBy("id"))
    return sorted_.withColumn("next", own).join(F.broadcast(after), "part").select("id", F.coalesce("next", "after").alias("next")).where("next is not null")


def rank_normalised(hits: DataFrame, by: list[str], id_col: str = "id") -> DataFrame:
    """score := 1 / rank within each group, so that scores of different sources compare."""
    return rank(hits, by, F.desc("score"), F.asc(id_col)).withColumn("score", 1.0 / F.col("rank"))


def fuse(lists: dict[str, tuple[DataFrame, float]], query: str, id_col: str, k: float, boost: float = 1.0) -> DataFrame:
    """Reciprocal rank fusion: sum of weight / (k + rank), times `boost` for ids in several lists.

    lists: name -> (DataFrame with `query`, `id_col`, `score`, weight). Ranks count from 1.
    """
    parts = [rank(df, [query], F.desc("score"), F.asc(id_col)).select(query, id_col, F.lit(name).alias("list"), (F.lit(float(w)) / (F.lit(float(k)) + F.col("rank"))).alias("part")) for name, (df, w) in lists.items()]
    both = reduce(DataFrame.unionByName, parts)
    out = both.groupBy(query, id_col).agg(F.sum("part").alias("score"), F.count_distinct("list").alias("n_lists"))
    return out.withColumn("score", F.col("score") * F.when(F.col("n_lists") > 1, boost).otherwise(1.0))


def decay(created_at: Column, as_of: Column, half_life_hours: float = 336.0, floor: float = 0.2) -> Column:
    """Exponential age decay with a floor; no date, no decay."""
    hours = F.greatest(F.lit(0.0), (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(created_at.cast("timestamp"))) / F.lit(3.6e9))
    return F.coalesce(F.greatest(F.lit(floor), F.exp(-F.lit(LN2) * hours / F.lit(max(1.0, half_life_hours)))), F.lit(1.0))


def access_boost(hits: Column, per_hit: float = 0.05, cap: float = 2.0) -> Column:
    return F.least(F.lit(cap), F.lit(1.0) + F.lit(per_hit) * F.greatest(F.lit(0), F.coalesce(hits, F.lit(0))))


def first_per_key(df: DataFrame, by: list[str], key: Column, *order: Column) -> DataFrame:
    """The best row per de-duplication key within each group."""
    return df.withColumn("_key", key).withColumn("_nth", F.row_number().over(Window.partitionBy(*by, "_key").orderBy(*order))).where("_nth = 1").drop("_nth", "_key")


def dedupe_key(doc_id: Column, source: Column, content: Column, row_id: Column) -> Column:
    """Document id, else source, else content hash, else the row's own id."""
    some = lambda c: F.when(F.length(F.trim(c)) > 0, c)
    return F.coalesce(F.concat(F.lit("doc:"), some(doc_id)), F.concat(F.lit("source:"), some(source)), F.concat(F.lit("content:"), F.sha1(F.lower(F.trim(some(content))))), F.concat(F.lit("id:"), row_id))


def diversified(df: DataFrame, by: list[str], session: str, k: int, least: int, *order: Column) -> DataFrame:
    """Up to k rows a group, the best row of each of the first `least` sessions before all others."""
    w = Window.partitionBy(*by)
    out = df.withColumn("place", F.row_number().over(w.orderBy(*order)))
    out = out.withColumn("in_session", F.row_number().over(Window.partitionBy(*by, session).orderBy("place")))
    out = out.withColumn("session_no", F.when(F.col("in_session") == 1, F.sum((F.col("in_session") == 1).cast("int")).over(w.orderBy("place"))))
    late = F.coalesce((F.col("session_no") > least), F.lit(True)).cast("int")
    return out.withColumn("rank", F.row_number().over(w.orderBy(late, "place"))).where(F.col("rank") <= k).drop("place", "in_session", "session_no")


def within_budget(df: DataFrame, by: list[str], cost: Column, budget: int, *order: Column, keep_first: bool = True) -> DataFrame:
    """Rows in order for as long as the running cost stays within the budget; the first always, if wanted."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn("used", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fits = F.col("used") <= budget
    return out.withColumn("_nth", F.row_number().over(w)).where(fits | ((F.col("_nth") == 1) & F.lit(keep_first))).drop("_nth")


def truncated_budget(df: DataFrame, by: list[str], text: str, budget: int, *order: Column) -> DataFrame:
    """Rows in order until the characters are used up; the row that overflows is cut."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("before", F.coalesce(F.sum(F.length(text)).over(w), F.lit(0)))
    return out.where(F.col("before") < budget).withColumn("kept", F.expr(f"substring({text}, 1, {budget} - before)"))
