"""Streams of events and lines: running counts, windows, anomalies, motifs, chunks and codecs with state.

State is bounded for each key: the last values, the last events, the bytes of one unfinished chunk, the
templates of a session. Results go to Parquet in the shared folder, batch by batch, never to the
driver. Rows of a batch are put in the order of their time and number; a batch is taken to follow the
batch before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidepool.functions import chunks, codecs

#: Values that an anomaly looks back on, and those it needs. Fixed values.
WINDOW, LEAST = 50, 5


def access_counts(events: DataFrame, key: str) -> DataFrame:
    """Running counts; update or complete mode."""
    return events.groupBy(key).agg(F.count("*").alias("n"))


def windowed(events: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window; rows later than the watermark are left out, as they are of no open window."""
    w = events.withWatermark(at, late).groupBy(key, F.window(at, width).alias("w"))
    return w.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w"))
    return w.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _keyed(rows: DataFrame, key: str, step, out: str, state: str) -> DataFrame:
    return rows.groupBy(key).applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)


def anomalies(events: DataFrame, key: str, at: str, number: str, value: str) -> DataFrame:
    """z of each value against the last values of its key; the state is those values only."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values([at, number])
        out = []
        for i, v in zip(rows[number], rows[value], strict=True):
            if len(recent) >= LEAST:
                mean = sum(recent) / len(recent)
                dev = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 or 0.001
                z = (v - mean) / dev
                out.append((k[0], i, v, z, "low" if z < -2 else "high" if z > 3 else None))
            recent = [*recent, v][-WINDOW:]
        state.update((recent,))
        yield pd.DataFrame(out, columns=[key, number, value, "z", "alert"])

    rows = events.select(key, F.col(at).cast("timestamp").alias(at), number, value)
    return _keyed(rows, key, step, f"{key} long, {number} long, {value} double, z double, alert string", "recent array<double>")


def patterns(events: DataFrame, key: str, at: str, number: str, event: str, least: int = 3, most: int = 10) -> DataFrame:
    """(key, number, at, pattern): all patterns of `least` to `most` events that each event completes; the state is the last events only."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values([at, number])
        out = []
        for t, i, e in zip(rows[at], rows[number], rows[event], strict=True):
            recent = [*recent, e][-most:]
            out += [(k[0], i, t, ">".join(recent[-n:])) for n in range(least, len(recent) + 1)]
        state.update((recent,))
        yield pd.DataFrame(out, columns=[key, number, at, "pattern"])

    rows = events.select(key, F.col(at).cast("timestamp").alias(at), number, event)
    return _keyed(rows, key, step, f"{key} long, {number} long, {at} timestamp, pattern string", "recent array<string>")


def motifs(found: DataFrame, key: str, at: str, number: str) -> DataFrame:
    """(key, number, motif): for each event the longest pattern it completes that the key has had before. A window for each key and pattern, so that no key's history is in one place."""
    before = F.row_number().over(Window.partitionBy(key, "pattern").orderBy(at, number)) > 1
    again = found.withColumn("again", before).where("again").withColumn("n", F.size(F.split("pattern", ">")))
    return again.groupBy(key, number).agg(F.max_by("pattern", "n").alias("motif"))


def chunked(lines: DataFrame, key: str, number: str, line: str, last: str) -> DataFrame:
    """(key, nth, kind, sha, size, chunk): content-defined chunks of each key's lines as soon as they end (`feed`), and the rest when the key's last line has come (`finish`). The state is the unfinished chunk and a count."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import hashlib

        held, nth = (bytes(state.get[0]), state.get[1]) if state.exists else (b"", 0)
        rows = pd.concat(list(parts)).sort_values(number)
        held += b"".join(x.encode() + b"\n" for x in rows[line])
        ends, out = chunks.cuts(held), []
        for a, b in zip([0, *ends], ends):  # noqa: B905
            out.append((k[0], nth, "feed", hashlib.sha256(held[a:b]).hexdigest(), b - a, held[a:b]))
            nth += 1
        held = held[ends[-1] :] if ends else held
        if rows[last].any() and held:
            out.append((k[0], nth, "finish", hashlib.sha256(held).hexdigest(), len(held), held))
            held, nth = b"", nth + 1
        state.update((held, nth))
        yield pd.DataFrame(out, columns=[key, "nth", "kind", "sha", "size", "chunk"])

    return _keyed(lines.select(key, number, line, last), key, step, f"{key} long, nth long, kind string, sha string, size long, chunk binary", "held binary, nth long")


def packed(lines: DataFrame, key: str, number: str) -> DataFrame:
    """(key, seq, numbers, blob): each batch of a key's lines (template, slots) as one window of a codec whose state goes on."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, templates, recent, last = state.get if state.exists else (0, [], [], [])
        rows = pd.concat(list(parts)).sort_values(number)
        stream = codecs.Stream.of(templates, recent, last)
        blob = stream.write([(t, list(s)) for t, s in zip(rows["template"], rows["slots"], strict=True)])
        state.update((seq + 1, *stream.state()))
        yield pd.DataFrame([(k[0], seq, list(rows[number]), blob)], columns=[key, "seq", "numbers", "blob"])

    return _keyed(lines.select(key, number, "template", "slots"), key, step, f"{key} long, seq long, numbers array<long>, blob binary", "seq long, templates array<string>, recent array<long>, last array<array<string>>")


def unpacked(windows: DataFrame, key: str) -> DataFrame:
    """(key, number, text) of a stored packed stream; a key's windows are read in their order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        stream, out = codecs.Stream(), []
        for numbers, blob in rows.sort_values("seq")[["numbers", "blob"]].itertuples(index=False):
            out += [(rows[key].iloc[0], n, codecs.rendered(t, s)) for n, (t, s) in zip(numbers, stream.read(bytes(blob)), strict=True)]
        return pd.DataFrame(out, columns=[key, "number", "text"])

    return windows.groupBy(key).applyInPandas(run, f"{key} long, number long, text string")


def stored(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends to Parquet what has come since the checkpoint, then stops."""
    stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def drained(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """The rows of a stream over what is there, by way of Parquet below the folder. Append mode adds; complete and update mode write each batch under its number, so that a batch that is run again writes the same, and give the last (complete) or all of them (update)."""
    spark, schema, columns = stream.sparkSession, stream.schema, stream.columns
    out, check = f"{folder}/rows", f"{folder}/checkpoint"
    if mode == "append":
        stored(stream, out, check)
        return spark.read.schema(schema).parquet(out)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    every = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).option("basePath", out).parquet(out)
    if mode == "complete":
        last = every.agg(F.max("batch").alias("batch"))
        every = every.join(F.broadcast(last), "batch", "left_semi")  # one row
    return every.select(*columns)
