"""Vector searches against brute force."""

import numpy as np
import pytest

from tidepool.operators import search
from tidepool.plans import registry


def exact(rows, asks, k):
    """query id -> its k best (score, id)."""
    vectors = np.array([v for _, v in rows], float)
    out = {}
    for i, v in asks:
        scores = np.round(vectors @ np.array(v, float), 6)
        out[i] = sorted((-s, j) for (j, _), s in zip(rows, scores.tolist(), strict=True) if j != i)[:k]
    return out


def stored(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]


@pytest.mark.parametrize("block", [(1024, 8192), (3, 50), (7, 10)])
def test_blocks(spark, block):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=6).round(3).tolist()) for i in range(200)]
    rows += [(200 + i, rows[0][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asks = df.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    got: dict = {}
    for r in search.knn_blocks(df, asks, 20, "vec_id", "embedding", "query_id", block=block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    held = [tuple(r) for r in df.collect()]
    want = exact(held, [r for r in held if r[0] % 10 == 0], 20)
    assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}
    assert search.knn_blocks(df, asks.limit(0), 20, "vec_id", "embedding", "query_id").collect() == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_recall_of_cells(spark, sf):
    rows = stored(spark, sf)
    want = exact(rows, [r for r in rows if r[0] % 50 == 0], 20)
    got: dict = {}
    for r in registry.queries()["top_ivf"](spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == set(want)
    assert np.mean([len(got[q] & {i for _, i in x}) / len(x) for q, x in want.items()]) >= 0.9


def test_search_answers_every_fiftieth_row(spark):
    sf = "/root/testdata/sf0.1"
    rows = stored(spark, sf)
    want = exact(rows, [r for r in rows if r[0] % 50 == 0], 20)
    got: dict = {}
    for r in registry.queries()["top_knn"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert len(got) == 40 and got == {q: [i for _, i in x] for q, x in want.items()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    content = {(r.query_id, r.vec_id, r.lang) for r in registry.queries()["jn_vector_content"](spark, sf).collect()}
    assert content == {(q, i, langs[i]) for q, x in got.items() for i in x if i in langs}
