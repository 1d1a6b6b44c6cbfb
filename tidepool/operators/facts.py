"""Facts over time: current and historical values, conflicts, admission, supersession, typed edges.

A fact has an id, entity, relation, value, fact_date (text, may be empty), confidence, status and
created_at. Groups are (entity, relation) without regard to case. Aggregations combine before they are
shuffled; the windows sort a group in one task, on disk if need be, and carry narrow rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relations that hold one value at a time. Fixed values.
SINGLE = ("location", "lives_in", "works_at", "role", "relationship_status", "status", "prefers", "uses", "owner", "employer", "home_city")
GROUP = ["entity_key", "relation_key"]


def keyed(facts: DataFrame) -> DataFrame:
    return facts.withColumn("entity_key", F.lower(F.trim("entity"))).withColumn("relation_key", F.lower(F.trim("relation")))


def groups(facts: DataFrame) -> DataFrame:
    """Number of facts and of different values of each group."""
    return keyed(facts).groupBy(*GROUP).agg(F.count("*").alias("n_facts"), F.count_distinct("value").alias("n_values"), F.max("fact_date").alias("last_date"))


def with_current(facts: DataFrame) -> DataFrame:
    """`is_current`: explicit `current` rows, if any; else of those not historical (all, if all are) the rows of the latest non-empty date; without dates the newest row."""
    w = Window.partitionBy(*GROUP)
    out = keyed(facts).withColumn("explicit", F.max((F.col("status") == "current").cast("int")).over(w))
    out = out.withColumn("alive", F.max((F.col("status") != "historical").cast("int")).over(w))
    pool = (F.col("alive") == 0) | (F.col("status") != "historical")
    out = out.withColumn("latest", F.max(F.when(pool & (F.col("fact_date") != ""), F.col("fact_date"))).over(w))
    order = w.orderBy(F.when(pool, 0).otherwise(1), F.desc("created_at"), F.desc("confidence"), F.desc("fact_id"))
    out = out.withColumn("newest", F.row_number().over(order))
    is_current = F.when(F.col("explicit") == 1, F.col("status") == "current").when(F.col("latest").isNotNull(), pool & (F.col("fact_date") == F.col("latest"))).otherwise(F.col("newest") == 1)
    return out.withColumn("is_current", is_current).drop("explicit", "alive", "latest", "newest")


def truth(facts: DataFrame) -> DataFrame:
    """Current and historical values of each group, as sorted lists."""
    values = lambda want: F.array_sort(F.collect_set(F.when(F.col("is_current") == want, F.col("value"))))
    return with_current(facts).groupBy(*GROUP).agg(values(True).alias("current_values"), values(False).alias("historical_values"))


def conflicts(facts: DataFrame) -> DataFrame:
    """Groups with more than one different current value."""
    now = with_current(facts).where("is_current")
    return now.groupBy(*GROUP).agg(F.count_distinct(F.trim("value")).alias("n_current")).where("n_current > 1")


def intervals(facts: DataFrame, by: list[str], at: str, id_col: str) -> DataFrame:
    """Slowly changing form: each row holds from its time to that of the next row of its group."""
    w = Window.partitionBy(*by).orderBy(at, id_col)
    out = facts.withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(w))
    return out.withColumn("status", F.when(F.col("valid_to").isNull(), "active").otherwise("inactive"))


def as_of(facts: DataFrame, when: Column, by: list[str], at: str, id_col: str) -> DataFrame:
    """The last row of each group at a time."""
    row = F.struct(at, id_col, "value")
    return facts.where(F.col(at) <= when).groupBy(*by).agg(F.max(row).alias("last")).select(*by, F.col(f"last.{id_col}").alias(id_col), "last.value")


def closed(facts: DataFrame, single: tuple[str, ...] = SINGLE) -> DataFrame:
    """Facts of relations with one value at a time, without those that repeat the value: superseded_by, transaction_to (when the next was written) and valid_to (the next one's date, else the day it was written) are null for the fact that holds."""
    w = Window.partitionBy(*GROUP).orderBy("created_at", "fact_id")
    out = keyed(facts).where(F.col("relation_key").isin(*single)).withColumn("value_key", F.lower(F.trim("value")))
    out = out.withColumn("known", F.coalesce(F.col("value_key").eqNullSafe(F.lag("value_key").over(w)) & (F.row_number().over(w) > 1), F.lit(False))).where("not known")
    date = F.lead("fact_date").over(w)
    valid_to = F.when(F.lead("fact_id").over(w).isNotNull(), F.coalesce(F.when(date != "", date), F.date_format(F.lead("created_at").over(w), "yyyy-MM-dd")))
    return out.withColumn("superseded_by", F.lead("fact_id").over(w)).withColumn("transaction_to", F.lead("created_at").over(w)).withColumn("valid_to", valid_to).drop("known")


def admission(facts: DataFrame, least_confidence: float = 0.55, single: tuple[str, ...] = SINGLE) -> DataFrame:
    """Decision for each fact against the facts before it: DENY below the confidence, NOOP if the value was there, SUPERSEDE if a single-valued relation changes, else ALLOW; `target` is the earlier fact concerned."""
    before = Window.partitionBy(*GROUP).orderBy("created_at", "fact_id").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(*GROUP, "value_key").orderBy("created_at", "fact_id").rowsBetween(Window.unboundedPreceding, -1)
    good = F.when(F.col("confidence") >= least_confidence, F.col("fact_id"))
    out = keyed(facts).withColumn("value_key", F.lower(F.trim("value")))
    out = out.withColumn("same_id", F.first(good, ignorenulls=True).over(same)).withColumn("last_id", F.last(good, ignorenulls=True).over(before))
    action = F.when(F.col("confidence") < least_confidence, "DENY").when(F.col("same_id").isNotNull(), "NOOP").when(F.col("relation_key").isin(*single) & F.col("last_id").isNotNull(), "SUPERSEDE").otherwise("ALLOW")
    return out.withColumn("action", action).withColumn("target", F.when(F.col("action") == "NOOP", F.col("same_id")).when(F.col("action") == "SUPERSEDE", F.col("last_id")))


def upsert(facts: DataFrame) -> DataFrame:
    """One row per (chunk, entity, relation, value, date): the first id, the newest creation, the largest confidence."""
    key = ["chunk_id", "entity_key", "relation_key", "value", "fact_date"]
    return keyed(facts).groupBy(*key).agg(F.min("fact_id").alias("fact_id"), F.max("created_at").alias("created_at"), F.max("confidence").alias("confidence"), F.count("*").alias("n_writes"))


def contradictions(edges: DataFrame, evidence: int = 8) -> DataFrame:
    """(src, relation) with several different dst, the last time, and the newest edges as evidence."""
    groups_ = edges.groupBy("src", "relation").agg(F.count_distinct("dst").alias("n_dst"), F.max("created_at").alias("last_seen")).where("n_dst > 1")
    w = Window.partitionBy("src", "relation").orderBy(F.desc("created_at"), F.desc("edge_id"))
    newest = edges.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= evidence)
    listed = newest.groupBy("src", "relation").agg(F.array_sort(F.collect_list("edge_id")).alias("evidence"))
    return groups_.join(listed, ["src", "relation"])


def resolve(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Winners become current, losers historical; decisions: winner_id, loser_id. Pairs of different groups decide nothing."""
    f = keyed(facts)
    side = lambda name: f.select(F.col("fact_id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in GROUP])
    valid = decisions.join(side("winner_id"), "winner_id").join(side("loser_id"), "loser_id").where("winner_id_entity_key = loser_id_entity_key and winner_id_relation_key = loser_id_relation_key")
    marks = valid.select(F.explode(F.array(F.struct(F.col("winner_id").alias("fact_id"), F.lit("current").alias("mark")), F.struct(F.col("loser_id").alias("fact_id"), F.lit("historical").alias("mark")))).alias("m")).select("m.*")
    marks = marks.groupBy("fact_id").agg(F.min("mark").alias("mark"))
    return f.join(marks, "fact_id", "left").withColumn("status", F.coalesce("mark", "status")).drop("mark")
