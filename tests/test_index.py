"""The stored index: the same rows as a search through everything, after every kind of change; what is left unread."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import index, search

WORDS = [f"w{i}" for i in range(300)]


def texts(n, seed):
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, 301)
    return [" ".join(rng.choice(WORDS, int(rng.integers(1, 60)), p=p / p.sum())) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(texts(700, 1))] + [(700, None), (701, ""), (702, "!?"), (703, "w1 w1 w1"), (704, "w1 w1 w1"), (-5, "W299 w298")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def asks(spark):
    return spark.createDataFrame([(1, "w1 w2 w299"), (2, "w280"), (3, "w298 w299 w297 w296"), (4, "w1"), (5, "nowhere"), (6, ""), (7, None), (8, "w5 nowhere"), (9, "w2 w2 w290")], "query_id long, query string")


def same(ix, docs, asks, **more):
    got = {tuple(r) for r in ix.search(asks, "doc_id", **more).collect()}
    every = {tuple(r) for r in ix.search(asks, "doc_id", pruned=False, **more).collect()}
    want = {(r.query_id, r.doc_id, r.score, r["rank"]) for r in search.bm25(search.postings(docs, "doc_id", "text"), asks, "doc_id", **more).collect()}
    assert got == every == want and want
    return got


@pytest.mark.parametrize(("k", "range_", "require_all"), [(10, 128, False), (3, 8, False), (1000, 16, False), (5, 8, True)])
def test_as_a_search_through_everything(spark, tmp_path, docs, asks, k, range_, require_all):
    ix = index.Index(spark, f"file://{tmp_path}/ix", range_=range_).append(docs, "doc_id", "text")
    same(ix, docs, asks, k=k, require_all=require_all)


def test_changes(spark, tmp_path, docs, asks):
    """Appended, deleted, replaced and compacted: always as if the documents that live had been indexed at once."""
    folder = f"file://{tmp_path}/ix"
    ix = index.Index(spark, folder, range_=8, buckets=16)
    assert ix.search(asks, "doc_id").collect() == [] and ix.generations() == {}
    first, second = docs.where("doc_id < 300"), docs.where("doc_id >= 300")
    ix.append(first, "doc_id", "text").append(second, "doc_id", "text")
    same(ix, docs, asks, k=7)
    gone = spark.createDataFrame([(i,) for i in (*range(0, 700, 3), 99_999, 3)], "doc_id long")
    left = docs.join(gone, "doc_id", "left_anti")
    same(ix.delete(gone, "doc_id"), left, asks, k=7)
    new = spark.createDataFrame([(i, t) for i, t in zip(range(1, 200, 2), texts(100, 2), strict=True)] + [(9000, "w299 w1")], "doc_id long, text string")
    now = left.join(new, "doc_id", "left_anti").unionByName(new)
    same(ix.update(new, "doc_id", "text"), now, asks, k=7)
    same(ix.update(new, "doc_id", "text"), now, asks, k=7)  # the same once more
    assert len(ix.generations()) == 7
    before = same(index.Index(spark, folder, range_=8, buckets=16), now, asks, k=7)
    assert same(ix.compact(), now, asks, k=7) == before and len(ix.generations()) == 1
    same(ix.delete(now.where("doc_id % 2 = 0"), "doc_id"), now.where("doc_id % 2 <> 0"), asks, k=7)
    assert ix.delete(now, "doc_id").search(asks, "doc_id").collect() == []


def test_nothing_to_index(spark, tmp_path, docs, asks):
    ix = index.Index(spark, f"file://{tmp_path}/ix").append(docs.where("doc_id between 700 and 702"), "doc_id", "text")
    assert ix.search(asks, "doc_id").collect() == [] and ix.delete(docs, "doc_id").compact().search(asks, "doc_id").collect() == []


def test_writers_do_not_meet_and_halves_do_not_count(spark, tmp_path, docs, asks):
    ix, other = (index.Index(spark, f"file://{tmp_path}/ix") for _ in range(2))
    numbers = [ix._claim(), other._claim(), ix._claim()]
    assert numbers == [1, 2, 3]
    (tmp_path / "ix" / "000002" / "stats-half").write_text("{")
    assert ix.generations() == {}
    same(ix.append(docs, "doc_id", "text"), docs, asks)
    assert list(other.generations()) == [4]


def test_most_is_left_unread(spark, tmp_path):
    """A rare and a frequent word: of the frequent one's postings only blocks whose bound reaches the tenth score are opened; other words' folders stay closed."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(["the"] * int(rng.integers(1, 4)) + [f"x{int(rng.integers(0, 2000))}" for _ in range(int(rng.integers(3, 80)))])) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asks = spark.createDataFrame([(i, f"the x{i}") for i in range(20)], "query_id long, query string")
    ix, read = index.Index(spark, f"file://{tmp_path}/ix", range_=16).append(docs, "doc_id", "text"), {}
    got = {tuple(r) for r in ix.search(asks, "doc_id", counters=read).collect()}
    assert got == {tuple(r) for r in ix.search(asks, "doc_id", pruned=False).collect()}
    assert read["folders"] <= 21 and read["opened"] < 0.05 * len(asks.collect()) * read["postings"] and read["opened"] < 0.7 * read["asked"], read


def test_found_again_by_its_files(spark, tmp_path, docs, asks):
    """The same files are indexed once; other files, columns or terms have indexes of their own."""
    source = f"{tmp_path}/docs.parquet"
    docs.write.parquet(source)
    one = index.of(spark, source, spark.read.parquet(source), "doc_id", "text")
    two = index.of(spark, source, spark.read.parquet(source).where("false"), "doc_id", "text")
    assert one.folder == two.folder and list(two.generations()) == [1]
    same(two, docs, asks)
    assert index.of(spark, source, docs, "doc_id", "text", what="other").folder != one.folder
    stemmed = index.of(spark, source, docs.withColumn("text", F.lit("licenses licensing")), "doc_id", "text", terms=index.stems)
    assert stemmed.folder != one.folder
    assert stemmed.search(spark.createDataFrame([(1, "licensed")], "query_id long, query string"), "doc_id").count() == 10


def test_ranges_by_size():
    """Sizes next to each other share a range up to its bound; a size of more documents has ranges of its own, next to nothing else."""
    rng = np.random.default_rng(3)
    sizes = [(i, int(n)) for i, n in enumerate(rng.integers(1, 60, 50), 1)]
    out = {s: (first, parts) for s, first, parts in index._ranges(sizes, 16)}
    held = {}
    for s, n in sizes:
        first, parts = out[s]
        assert (parts > 1) == (n > 16) and n / parts <= 16
        for r in range(first, first + parts):
            held.setdefault(r, []).append((s, n / parts))
    assert sorted(held) == list(range(max(held) + 1)) and all(sum(n for _, n in x) <= 16 for x in held.values())
    assert all(len(x) == 1 for r, x in held.items() if out[x[0][0]][1] > 1) and index._ranges([], 16) == []


def test_a_block_travels_once_for_all_queries(spark, tmp_path):
    """Postings are arrays of numbers; many queries with the same word get its blocks as one row a range, and sums are made there."""
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("the"), F.concat(F.lit("x"), F.col("id") % 50), F.concat(F.lit("y"), F.col("id") % 7)).alias("text"))
    asks = spark.createDataFrame([(i, f"the x{i} y{i % 7}") for i in range(50)], "query_id long, query string")
    ix = index.Index(spark, f"file://{tmp_path}/ix", range_=16).append(docs, "doc_id", "text")
    blocks = ix._part("blocks", ix.generations())
    assert {"ids", "tfs", "sizes"} <= set(blocks.columns) and blocks.where("size(ids) <> n OR n > 32").count() == 0
    got = ix.search(asks, "doc_id", pruned=False)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [generation" in plan and "Join" not in plan.split("RepartitionByExpression [generation")[0]
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in ix.search(asks, "doc_id").collect()}
    first = {r.query_id: r.doc_id for r in got.where("rank = 1").collect()}
    assert len(first) == 50 and all(d % 50 == q and (d % 7 == q % 7 or q >= 50) for q, d in first.items())


def test_terms_travel_as_one_string(spark, tmp_path, monkeypatch):
    """Terms are not shuffled as arrays, and come back as they were: those of one letter, repeated ones, a single one."""
    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, "x_1 b b")], "doc_id long, text string")
    seen, frame, plain = [], type(docs), type(docs).repartition
    monkeypatch.setattr(frame, "repartition", lambda df, *a: (seen.append(df.dtypes), plain(df, *a))[1])
    ix = index.Index(spark, f"file://{tmp_path}/ix").append(docs, "doc_id", "text")
    held = {(r.term, i): n for r in ix._part("blocks", ix.generations()).collect() for i, n in zip(r.ids, r.tfs, strict=True)}
    assert held == {("a", 1): 2, ("b", 1): 1, ("b", 2): 1, ("x_1", 3): 1, ("b", 3): 2}
    assert seen and not any("array" in t for types in seen for _, t in types)


def test_blocks_do_not_move_to_meet_their_queries(spark, tmp_path, monkeypatch):
    """Blocks are filtered where they are read and moved once, to where their range is; with too many pairs of a query and a range they are joined, with the same rows."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("the"), F.concat(F.lit("x"), F.col("id") % 30), F.concat(F.lit("y"), F.col("id") % 7)).alias("text"))
    asks = spark.createDataFrame([(i, f"the x{i} y{i % 7}") for i in range(30)], "query_id long, query string")
    ix, got = index.Index(spark, f"file://{tmp_path}/ix", range_=16).append(docs, "doc_id", "text"), {}
    for most in (index.NAMED, 0):
        monkeypatch.setattr(index, "NAMED", most)
        for every in (False, True):
            hits = ix.search(asks, "doc_id", require_all=every)
            plan = hits._jdf.queryExecution().optimizedPlan().toString()
            assert ("array_contains" in plan) == (most > 0)
            got.setdefault(every, []).append(sorted(tuple(r) for r in hits.collect()))
    assert got[False][0] == got[False][1] and got[True][0] == got[True][1] and len(got[False][0]) == 300
