from pyspark.sql import functions as F

from tidepool.sources import sessions
from tidepool.streaming import stateful

SF = "/root/testdata/sf0.001"


def _stream(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{SF}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def test_counts_and_windows(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    got = stateful.drained(stateful.access_counts(_stream(spark), "event_type"), "complete", str(tmp_path / "a"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in batch.groupBy("event_type").count().collect()}
    wide = stateful.drained(stateful.windowed(_stream(spark), "ts", "event_type"), "update", str(tmp_path / "b"))
    assert wide.agg(F.sum("n")).first()[0] == batch.count()
    held = stateful.drained(stateful.sessions(_stream(spark), "ts", "user_id"), "append", str(tmp_path / "c"))
    assert held.where("start >= end").count() == 0 and 0 < held.agg(F.sum("n")).first()[0] <= batch.count()


def test_no_stream_ends_on_the_driver():
    import inspect

    assert '"memory"' not in inspect.getsource(stateful)


def test_chunks_of_a_stream_equal_those_of_the_whole(spark, tmp_path):
    from tidepool.functions import chunks

    lines = [(1, i, f"line {i * 7919 % 613} " * 40, i == 199) for i in range(200)] + [(2, i, "short", False) for i in range(3)]
    df = spark.createDataFrame(lines, "k long, n long, line string, last boolean")
    for i in range(4):
        df.where(F.floor(F.col("n") / 50) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stateful.drained(stateful.chunked(stream, "k", "n", "line", "last"), "append", str(tmp_path / "out")).orderBy("k", "nth").collect()
    whole = "".join(x + "\n" for k, _, x, _ in lines if k == 1).encode()
    ends = chunks.boundaries(whole)
    assert [bytes(r.chunk) for r in out] == [whole[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905
    assert [r.kind for r in out] == ["feed"] * (len(out) - 1) + ["finish"]  # key 2 has not ended


def test_watched_folder_reads_each_file_once(spark, tmp_path):
    folder, check = tmp_path / "in", str(tmp_path / "c")
    folder.mkdir()
    (folder / "a.jsonl").write_text("one\ntwo\n")
    out = str(tmp_path / "out")
    stateful.stored(sessions.watched(spark, str(folder)), out, check)
    assert spark.read.parquet(out).count() == 2
    (folder / "b.jsonl").write_text("three\n")
    stateful.stored(sessions.watched(spark, str(folder)), out, check)
    assert sorted(r.line for r in spark.read.parquet(out).collect()) == ["one", "three", "two"]
