"""Streams: state that goes on from batch to batch, and folders that are polled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.operators import store
from tidepool.plans.registry import query
from tidepool.plans.tables import LINES_SQL, log_lines, table
from tidepool.sources import watch
from tidepool.streaming import stateful


def _folder(spark) -> str:
    return store.scratch(spark, "stream")


def _stream(spark, rows: DataFrame, by, parts: int = 3) -> DataFrame:
    """Rows as a stream of several batches: written one part after the other, read a write at a time."""
    path = store.scratch(spark, "stream-in")
    for i in range(parts):
        rows.where(by == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _events(spark, sf) -> DataFrame:
    """Events in three batches, in the order of their numbers."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    third = F.floor(F.col("event_id") * 3 / (e.agg(F.max("event_id")).first()[0] + 1))
    return _stream(spark, e, third)


_Z = "WITH w AS (SELECT user_id, event_id, value, count(value) OVER g AS n, avg(value) OVER g AS m, stddev_pop(value) OVER g AS d FROM events WINDOW g AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)), z AS (SELECT user_id, event_id, (value - m) / CASE WHEN d = 0 THEN 0.001 ELSE d END AS z FROM w WHERE n >= 5) SELECT user_id, event_id, round(z, 4) AS z, CASE WHEN z < -2 THEN 'low' WHEN z > 3 THEN 'high' END AS alert FROM z"


@query("str_anomaly", _Z)
def _(spark, sf):
    out = stateful.drained(stateful.anomalies(_events(spark, sf), "user_id", "ts", "event_id", "value"), "append", _folder(spark))
    return out.select("user_id", "event_id", F.round("z", 4).alias("z"), "alert")


_LAGS = ", ".join(f"lag(event_type, {i}) OVER g AS e{i}" for i in range(1, 10))
_PATTERNS = " UNION ALL ".join(f"SELECT user_id, event_id, ts, {n} AS n, {chr(32).join(f'e{i} || chr(62) ||' for i in range(n - 1, 0, -1))} event_type AS pattern FROM l WHERE e{n - 1} IS NOT NULL" for n in range(3, 11))


@query("str_motif_observe", f"WITH l AS (SELECT *, {_LAGS} FROM events WINDOW g AS (PARTITION BY user_id ORDER BY ts, event_id)), p AS ({_PATTERNS}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, pattern ORDER BY ts, event_id) AS nth FROM p) SELECT user_id, event_id, arg_max(pattern, n) AS motif FROM r WHERE nth > 1 GROUP BY ALL")
def _(spark, sf):
    """Patterns of three to ten events."""
    found = stateful.drained(stateful.patterns(_events(spark, sf), "user_id", "ts", "event_id", "event_type"), "append", _folder(spark))
    return stateful.motifs(found, "user_id", "ts", "event_id")


@query("str_access", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def _(spark, sf):
    """Running counts: what the last of three batches gives."""
    return stateful.drained(stateful.access_counts(_events(spark, sf), "user_id"), "complete", _folder(spark))


# Chunks and codecs


def _lines(spark, sf) -> DataFrame:
    """Conversations as lines, dealt over three batches by turn; the last line of each is marked."""
    c = table(spark, sf, "conversations")
    end = c.groupBy("conv_id").agg(F.max("turn").alias("end"))
    rows = c.join(end, "conv_id").select("conv_id", "turn", F.repeat("text", 4).alias("text"), (F.col("turn") == F.col("end")).alias("last"))
    return _stream(spark, rows, F.least(F.floor(F.col("turn") / 2), F.lit(2)))


_WHOLE = "w AS (SELECT conv_id, string_agg(repeat(text, 4) || chr(10), '' ORDER BY turn) AS whole FROM conversations GROUP BY conv_id)"


@query("str_dedup_feed", f"WITH {_WHOLE} SELECT conv_id, true AS prefix, true AS bounded FROM w WHERE strlen(whole) >= 16384")
def _(spark, sf):
    """What is out before a stream ends: its chunks are the beginning of its bytes, none larger than the largest. Streams of a chunk's largest size or more have some."""
    out = stateful.drained(stateful.chunked(_lines(spark, sf), "conv_id", "turn", "text", "last"), "append", _folder(spark))
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.concat(F.repeat(x.text, F.lit(4)), F.lit("\n"))), "").alias("whole"))
    fed = out.where("kind = 'feed'").groupBy("conv_id").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.hex("chunk").alias("x")))), lambda x: x.x), "")).alias("fed"), (F.max("size") <= 16_384).alias("bounded"))
    long = c.where(F.octet_length("whole") >= 16_384)
    return long.join(fed, "conv_id", "left").select("conv_id", F.startswith(F.col("whole").cast("binary"), F.col("fed")).alias("prefix"), "bounded")


@query("str_dedup_finish", f"WITH {_WHOLE} SELECT conv_id, sha256(whole) AS sha, strlen(whole)::bigint AS size FROM w")
def _(spark, sf):
    """Streams put together again from all their chunks, of which equal ones are stored once."""
    out = stateful.drained(stateful.chunked(_lines(spark, sf), "conv_id", "turn", "text", "last"), "append", _folder(spark))
    held = store.appended(spark, "store", out.groupBy("sha").agg(F.hex(F.first("chunk")).alias("x")))
    back = out.select("conv_id", "nth", "sha").join(held, "sha").groupBy("conv_id").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "x"))), lambda y: y.x), "")).alias("whole"))
    return back.select("conv_id", F.sha2("whole", 256).alias("sha"), F.length("whole").cast("long").alias("size"))


@query("str_state_codec", f"WITH {LINES_SQL} SELECT user_id, line_no AS number, text FROM lines")
def _(spark, sf):
    """Each user's lines over three batches, packed with state, and out again."""
    lines = log_lines(spark, sf).select("line_no", "user_id", "template", "slots")
    third = F.floor(F.col("line_no") * 3 / (lines.agg(F.max("line_no")).first()[0] + 1))
    out = stateful.drained(stateful.packed(_stream(spark, lines, third), "user_id", "line_no"), "append", _folder(spark))
    return stateful.unpacked(out, "user_id").select("user_id", "number", "text")


@query("cmp_stream", f"WITH {LINES_SQL} SELECT user_id, line_no AS number, text FROM lines WHERE event_type = 'error'")
def _(spark, sf):
    """The same codec over one kind of line, in one batch."""
    lines = log_lines(spark, sf).where("event_type = 'error'").select("line_no", "user_id", "template", "slots")
    out = stateful.drained(stateful.packed(_stream(spark, lines, F.lit(0), 1), "user_id", "line_no"), "append", _folder(spark))
    return stateful.unpacked(out, "user_id").select("user_id", "number", "text")


# Folders


def _written(spark, rows: DataFrame, folder: str, name: str) -> None:
    """Each conversation of `rows` as one file below the folder, in a place of its own; what is there is written anew."""
    rows.select("conv_id", F.to_json(F.struct("turn", "role", "text")).alias("value")).repartition("conv_id").write.mode("overwrite").partitionBy("conv_id").text(f"{folder}/{name}")


def _polls(spark, sf) -> tuple[store.Versions, list[DataFrame], str]:
    """Three polls: all conversations; nothing new; some written anew and some new ones."""
    folder, lines = store.scratch(spark, "watched"), store.scratch(spark, "lines")
    c = table(spark, sf, "conversations")
    state, seen = store.Versions(spark, store.scratch(spark, "watch-state")), []

    def take(paths: list[str]) -> None:
        spark.read.text(paths).select(F.input_file_name().alias("path"), "value").withColumn("round", F.lit(len(seen))).write.mode("append").parquet(lines)

    for i in range(3):
        if i == 0:
            _written(spark, c.where("conv_id % 4 < 2"), folder, "a")
            _written(spark, c.where("conv_id % 4 = 2"), folder, "b")
        if i == 2:
            _written(spark, c.where("conv_id % 4 = 2").withColumn("role", F.lit("again")), folder, "b")
            _written(spark, c.where("conv_id % 4 = 3"), folder, "c")
        seen.append(watch.poll(spark, folder, state, take, "*.txt"))
    return state, seen, lines


def _conv():
    return F.regexp_extract("path", r"conv_id=(\d+)", 1).cast("long").alias("conv_id")


@query("src_watch_dir", "SELECT DISTINCT conv_id, 0 AS round FROM conversations WHERE conv_id % 4 < 3 UNION ALL SELECT DISTINCT conv_id, 2 FROM conversations WHERE conv_id % 4 >= 2")
def _(spark, sf):
    """Which files each of three polls takes."""
    _, seen, _ = _polls(spark, sf)
    out = [s.select(_conv(), F.lit(i).alias("round")) for i, s in enumerate(seen)]
    return out[0].union(out[1]).union(out[2])


@query("str_file_poll", "SELECT conv_id, 0 AS round, count(*) AS n FROM conversations WHERE conv_id % 4 < 3 GROUP BY conv_id UNION ALL SELECT conv_id, 2, count(*) FROM conversations WHERE conv_id % 4 >= 2 GROUP BY conv_id")
def _(spark, sf):
    """Lines that came in by each poll: a file that is as it was brings none."""
    _, _, lines = _polls(spark, sf)
    return spark.read.parquet(lines).groupBy(_conv(), "round").agg(F.count("*").alias("n"))


@query("str_session_delta", "SELECT conv_id, turn, CASE WHEN conv_id % 4 = 2 THEN 'again' ELSE role END AS role FROM conversations")
def _(spark, sf):
    """Turns as they are after all polls: those of the last poll that took a session."""
    _, _, lines = _polls(spark, sf)
    rows = spark.read.parquet(lines).select(_conv(), "round", F.from_json("value", "turn long, role string").alias("v")).select("conv_id", "round", "v.*")
    last = rows.groupBy("conv_id").agg(F.max("round").alias("round"))
    return rows.join(last, ["conv_id", "round"]).select("conv_id", "turn", "role")
