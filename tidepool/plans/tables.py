"""The library's tables, derived from the driver's; each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators import text

AS_OF = "2024-02-01 00:00:00"
QUERIES = [(1, "the and with"), (2, "le la de que"), (3, "license version software released under"), (4, "der die das und"), (5, "ing ation this worthless")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task of a dealt table.
DEALT = 4096


def dealt(df: DataFrame, *keys: str, rows: int = DEALT) -> DataFrame:
    """A table dealt into tasks of about so many rows each, for work that takes long a row: a file is read by no more tasks than it has row groups, however many rows these hold."""
    return df.repartition(max(1, -(-df.count() // rows)), *keys)


def as_of() -> Column:
    return F.to_timestamp(F.lit(AS_OF))


_NUMBERS = "[" + ", ".join(f"'{w}'" for w in text.NUMBER_WORDS) + "]"


def normalised_sql(x: str) -> str:
    words = f"string_split(trim(regexp_replace(translate(lower(coalesce({x}, '')), '{text.FOLD[0]}', '{text.FOLD[1]}'), '[^a-z0-9]+', ' ', 'g')), ' ')"
    return f"array_to_string(list_transform(list_filter({words}, lambda w: w NOT IN ('a', 'an', 'the', '')), lambda w: CASE WHEN list_position({_NUMBERS}, w) > 0 THEN (list_position({_NUMBERS}, w) - 1)::varchar ELSE w END), ' ')"


def queries_frame(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("query_id"), F.lit(q).alias("query")) for i, q in QUERIES])))


QUERIES_SQL = "queries AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::bigint, '{q}')" for i, q in QUERIES) + ") AS v(query_id, query))"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as facts: (user, event type, value) with a date, a confidence and a status."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(k % 29 == 0, "historical").when(k % 31 == 5, "current").otherwise("")
    date = F.when(k % 7 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return e.select(F.col("event_id").alias("fact_id"), (F.col("event_id") % 997).alias("chunk_id"), F.concat(F.lit("User_"), F.col("user_id")).alias("entity"), F.col("event_type").alias("relation"), F.floor(F.col("value") / 10).cast("string").alias("value"), date.alias("fact_date"), (0.5 + (k % 50) / 100.0).alias("confidence"), status.alias("status"), F.col("ts").alias("created_at"))


FACTS_SQL = """k AS (SELECT *, json_extract_string(props, '$.k')::int AS k FROM events),
facts AS (SELECT event_id AS fact_id, event_id % 997 AS chunk_id, 'User_' || user_id AS entity, event_type AS relation, floor(value / 10)::bigint::varchar AS value,
  CASE WHEN k % 7 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS fact_date, 0.5::double + (k % 50) / 100.0::double AS confidence,
  CASE WHEN k % 29 = 0 THEN 'historical' WHEN k % 31 = 5 THEN 'current' ELSE '' END AS status, ts AS created_at, 'user_' || user_id AS entity_key, event_type AS relation_key FROM k)"""

CURRENT_SQL = (
    FACTS_SQL
    + """,
marked AS (SELECT *, max((status = 'current')::int) OVER g AS explicit, max((status <> 'historical')::int) OVER g AS alive FROM facts WINDOW g AS (PARTITION BY entity_key, relation_key)),
pooled AS (SELECT *, (alive = 0 OR status <> 'historical') AS pool FROM marked),
dated AS (SELECT *, max(CASE WHEN pool AND fact_date <> '' THEN fact_date END) OVER (PARTITION BY entity_key, relation_key) AS latest,
  row_number() OVER (PARTITION BY entity_key, relation_key ORDER BY CASE WHEN pool THEN 0 ELSE 1 END, created_at DESC, confidence DESC, fact_id DESC) AS newest FROM pooled),
cur AS (SELECT *, CASE WHEN explicit = 1 THEN status = 'current' WHEN latest IS NOT NULL THEN pool AND fact_date = latest ELSE newest = 1 END AS is_current FROM dated)"""
)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the star schema as typed edges: nation in region, supplier and customer in nation, order by customer."""
    t = lambda name: table(spark, sf_dir, name)
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    base = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    edge = lambda df, src, relation, dst, at: df.select(src.alias("src"), F.lit(relation).alias("relation"), dst.alias("dst"), at.alias("created_at"))
    parts = [
        edge(t("nation"), node("n", "n_nationkey"), "in_region", node("r", "n_regionkey"), base),
        edge(t("supplier"), node("s", "s_suppkey"), "based_in", node("n", "s_nationkey"), base),
        edge(t("customer"), node("c", "c_custkey"), "based_in", node("n", "c_nationkey"), base),
        edge(t("orders"), node("c", "o_custkey"), "ordered_with", node("p", "o_orderpriority"), F.col("o_orderdate").cast("timestamp")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("edge_id", F.concat_ws("|", "src", "relation", "dst", F.date_format("created_at", "yyyy-MM-dd")))


EDGES_SQL = """e0 AS (
  SELECT 'n' || n_nationkey AS src, 'in_region' AS relation, 'r' || n_regionkey AS dst, TIMESTAMP '2024-01-01' AS created_at FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'based_in', 'n' || s_nationkey, TIMESTAMP '2024-01-01' FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'based_in', 'n' || c_nationkey, TIMESTAMP '2024-01-01' FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'ordered_with', 'p' || o_orderpriority, o_orderdate::timestamp FROM orders),
edges AS (SELECT *, src || '|' || relation || '|' || dst || '|' || strftime(created_at, '%Y-%m-%d') AS edge_id FROM e0)"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as log lines with their template and slots."""
    e = table(spark, sf_dir, "events")
    value = F.format_string("%d.%02d", F.floor("value").cast("int"), (F.round(F.col("value") * 100).cast("long") % 100).cast("int"))
    k = F.get_json_object("props", "$.k")
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("Error: timeout for server-"), F.col("user_id"), F.lit(" after "), value, F.lit(" ms"))).otherwise(F.concat(F.lit("User u"), F.col("user_id"), F.lit(" did "), F.col("event_type"), F.lit(" value="), value, F.lit(" k="), k))
    template = F.when(F.col("event_type") == "error", "Error: timeout for <*> after <*> ms").otherwise("User <*> did <*> value=<*> k=<*>")
    slots = F.when(F.col("event_type") == "error", F.array(F.concat(F.lit("server-"), F.col("user_id")), value)).otherwise(F.array(F.concat(F.lit("u"), F.col("user_id")), F.col("event_type"), value, k))
    return e.select(F.col("event_id").alias("line_no"), text.alias("text"), template.alias("template"), slots.alias("slots"), "user_id", "ts", "event_type")


LINES_SQL = """v AS (SELECT *, floor(value)::int || '.' || lpad((round(value * 100)::bigint % 100)::varchar, 2, '0') AS vs, json_extract_string(props, '$.k') AS k FROM events),
lines AS (SELECT event_id AS line_no, CASE WHEN event_type = 'error' THEN 'Error: timeout for server-' || user_id || ' after ' || vs || ' ms' ELSE 'User u' || user_id || ' did ' || event_type || ' value=' || vs || ' k=' || k END AS text,
  CASE WHEN event_type = 'error' THEN 'Error: timeout for <*> after <*> ms' ELSE 'User <*> did <*> value=<*> k=<*>' END AS template,
  CASE WHEN event_type = 'error' THEN ['server-' || user_id, vs] ELSE ['u' || user_id, event_type, vs, k] END AS slots, user_id, ts, event_type FROM v)"""


MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
#: Sentences of the notes; {i} is the customer, {n} its nation, {s} its segment, {m} a month, {d} a day, {y} a year.
NOTES = (
    "User moved from {n} to {s}ville last month.",
    "My espresso drink now is {s} latte with oat milk, mostly.",
    "Clerk-{i} works at {n} and Clerk-{i} has {d} boats.",
    "I switched from a brown notebook to the {s} journal.",
    "We are currently based in {n}.",
    "Alice painted the {s} sunset on {m} {d}, {y}.",
    "Before winter, movie nights usually meant popcorn; the green bag became the {s} backpack.",
    "They met on 3/{d} and again on {y}-06-{d}.",
    "Airport kit stays consistent: {s} pack, anker charger, muji notebook, aisle seat.",
    "Clerk-{i} bought a lamp for the {n} office. It was a bargain!",
    "Since last spring, my home base has been {n}.",
    "Bob prefers {s} tea and the crew depends on Alice.",
)


def _rendered(template: str, parts: dict[str, Column]) -> Column:
    import re

    return F.concat(*[parts[x[1:-1]] if x[0] == "{" else F.lit(x) for x in re.split(r"(\{\w\})", template) if x])


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as notes: note_id and text, a third of the sentences each, two lines."""
    c = dealt(table(spark, sf_dir, "customer"), "c_custkey").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    i = F.col("c_custkey")
    parts = {"i": i.cast("string"), "n": F.col("n_name"), "s": F.lower("c_mktsegment"), "m": F.element_at(F.array(*[F.lit(m) for m in MONTHS]), (i % 12 + 1).cast("int")), "d": (i % 27 + 2).cast("string"), "y": (2000 + i % 24).cast("string")}
    said = F.array_compact(F.array(*[F.when((i * 7 + k * (k + 1)) % 3 == 0, _rendered(t, parts)) for k, t in enumerate(NOTES)]))
    half = F.floor(F.size(said) / 2).cast("int")
    text = F.concat(F.array_join(F.slice(said, F.lit(1), half), " "), F.lit("\n"), F.array_join(F.slice(said, half + 1, F.size(said)), " "))
    return c.select(i.alias("note_id"), text.alias("text"))


def _notes_sql() -> str:
    import re

    parts = {"i": "c_custkey", "n": "n_name", "s": "lower(c_mktsegment)", "m": "['" + "', '".join(MONTHS) + "'][(c_custkey % 12 + 1)::int]", "d": "(c_custkey % 27 + 2)", "y": "(2000 + c_custkey % 24)"}
    lit = lambda t: " || ".join(parts[x[1:-1]] if x[0] == "{" else f"'{x}'" for x in re.split(r"(\{\w\})", t) if x)
    said = ", ".join(f"CASE WHEN (c_custkey * 7 + {k * (k + 1)}) % 3 = 0 THEN {lit(t)} END" for k, t in enumerate(NOTES))
    return f"""said AS (SELECT c_custkey AS note_id, list_filter([{said}], lambda x: x IS NOT NULL) AS a FROM customer JOIN nation ON c_nationkey = n_nationkey),
notes AS (SELECT note_id, array_to_string(a[1:len(a) // 2], ' ') || chr(10) || array_to_string(a[len(a) // 2 + 1:len(a)], ' ') AS text FROM said)"""


NOTES_SQL = _notes_sql()
