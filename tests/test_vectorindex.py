"""The stored index of vectors: recall and what is read, appends and removals, odd rows."""

import numpy as np
import pytest

from tidepool.operators.vectorindex import VectorIndex

SCHEMA = "vec_id long, embedding array<float>"


def truth(rows, asks, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at = {i: n for n, i in enumerate(ids)}
    out = {}
    for q in asks:
        score = x @ x[at[q]]
        score[at[q]] = -np.inf
        out[q] = ids[np.lexsort((ids, -score))[:k]].tolist()
    return out


def recall(got, want):
    found: dict = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    return np.mean([len(found.get(q, set()) & set(x)) / len(x) for q, x in want.items()])


def ask(ix, df, k=10, every=25, **more):
    return ix.search(df.where(f"vec_id % {every} = 0").withColumnRenamed("vec_id", "query_id"), k, "vec_id", "embedding", "query_id", **more)


def clustered(n, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, 24))
    return [(i, (base[i % 60] + 0.6 * rng.normal(size=24)).tolist()) for i in range(n)]


def test_recall_and_share(spark, tmp_path):
    """Nine tenths of the true neighbours at least; the share of the rows that is read falls as the table grows."""
    shares = []
    for n in (500, 2000, 8000):
        rows, read = clustered(n), {}
        df = spark.createDataFrame(rows, SCHEMA)
        ix = VectorIndex(spark, f"file://{tmp_path}/{n}").build(df, "vec_id", "embedding", k=10)
        got = ask(ix, df, every=n // 40, counters=read).collect()
        want = truth(rows, range(0, n, n // 40), 10)
        assert recall(got, want) >= 0.9
        assert all(r.score == pytest.approx(float(np.dot(rows[r.query_id][1], rows[r.vec_id][1]) / np.linalg.norm(rows[r.query_id][1]) / np.linalg.norm(rows[r.vec_id][1])), abs=1e-5) for r in got[:50])
        shares.append(read["read"] / read["of_rows"])
    assert shares == sorted(shares, reverse=True) and shares[-1] < 0.25, shares


def test_changes_and_odd_rows(spark, tmp_path):
    rows = clustered(600)
    odd = [(9000, None), (9001, [0.0] * 24), (9002, [float("nan")] * 24), (9003, [1.0, 2.0]), (None, rows[1][1])]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    folder = f"file://{tmp_path}/ix"
    first = VectorIndex(spark, folder)
    assert first.model is None and ask(first, df).collect() == []
    first.build(df.where("vec_id < 400 OR vec_id >= 9000 OR vec_id IS NULL"), "vec_id", "embedding", k=10)
    ix = VectorIndex(spark, folder).append(df.where("vec_id between 400 and 8999"), "vec_id", "embedding")  # opened again, the model is there
    every = ix.search(df.where("vec_id % 25 = 0").withColumnRenamed("vec_id", "query_id"), 10, "vec_id", "embedding", "query_id", probes=10_000, rerank=1000).collect()
    want = truth(rows, range(0, 600, 25), 10)
    got: dict = {}
    for r in sorted(every, key=lambda r: (r.query_id, r.rank)):
        if r.vec_id is not None:
            got.setdefault(r.query_id, []).append(r.vec_id)
    assert got.keys() == want.keys() and recall(every, want) > 0.98
    ix.remove(df.where("vec_id % 2 = 1"), "vec_id")
    left = ask(VectorIndex(spark, folder), df, probes=10_000, rerank=1000).collect()
    assert left and all(r.vec_id is None or r.vec_id % 2 == 0 for r in left)
    want = truth([r for r in rows if r[0] % 2 == 0], range(0, 600, 50), 10)
    assert recall([r for r in left if r.query_id % 50 == 0], want) > 0.98


def test_copies_in_one_cell_are_dealt_into_blocks(spark, tmp_path, monkeypatch):
    from tidepool.operators import vectorindex

    monkeypatch.setattr(vectorindex, "BLOCK", 50)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(700)] + [(700 + i, [float(i % 7), 1.0, -2.0, float(i % 5)]) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = ask(VectorIndex(spark, f"file://{tmp_path}/ix").build(df, "vec_id", "embedding", k=10), df, every=100).collect()
    first = sorted((r.query_id, r["rank"], r.vec_id) for r in got if r.query_id == 0)
    assert len(first) == 10 and all(i < 700 for _, _, i in first)
    assert {r.query_id for r in got} == set(range(0, 1000, 100)) and len(got) == 100


def test_nothing_to_index(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], SCHEMA)
    ix = VectorIndex(spark, f"file://{tmp_path}/ix").build(df, "vec_id", "embedding")
    assert ix.model is None and ask(ix, df).collect() == []
