"""The ten queries themselves over tables with odd rows: against the libraries, DuckDB and plain versions."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from tests.llm.fixture import documents, empty_tables, held_out, plain_language, plain_toxicity, tables  # noqa: F401
from tests.llm.test_near import slow_components, slow_print
from tests.llm.test_new import damage, slow_repair
from tests.llm.test_tokens import BYTE, WORD, plain
from tidepool.llm import queries

DOCS = [(i, t or "") for i, t, *_ in documents()]


def number(x):
    return -1 if x is None else x


def test_op1(spark, tables):
    got = queries.op1_packing(spark, tables).collect()
    want = Counter()
    for i, t in DOCS:
        ids = [*plain(WORD, t), 1]
        want[number(i), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    pieces: dict = {}
    for r in got:
        pieces.setdefault((number(r.doc_id), r.doc_tokens, r.start), []).append(r)
    for (i, n, start), rows in pieces.items():
        same = [np.array([*plain(WORD, t), 1], "<u4") for j, t in DOCS if number(j) == i]
        same = [x for x in same if len(x) == n]
        assert len(rows) <= len(same)
        for r in rows:
            assert r.ids_crc32 in {zlib.crc32(x[start : start + r.length].tobytes()) for x in same}
    assert sum(r.length for r in got) == sum(n * c for (_, n, _), c in want.items())
    for s, rows in ((s, sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset)) for s in {r.sequence_id for r in got}):
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))], s
        assert sum(r.length for r in rows) <= 2048


def test_op2(spark, tables):
    got = Counter((number(r.doc_id), r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, tables).collect())
    prints = [slow_print(t) for _, t in DOCS]
    classes = slow_components(prints, 3)
    least = {c: min(i for (i, _), k in zip(DOCS, classes, strict=True) if k == c and i is not None) for c in classes}
    assert got == Counter((number(i), f"{p:016x}", least[c]) for (i, _), p, c in zip(DOCS, prints, classes, strict=True))


def test_op3(spark, tables):
    """Scores and order are exact; of the true neighbours nine tenths at least are found."""
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect() if r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)]
    got: dict = {}
    for r in queries.op3_nearest(spark, tables).collect():
        got.setdefault(r.query_id, {}).setdefault(r.rank, []).append((r.vec_id, r.score))
    asked = {q for q, _ in rows if q % 20 == 0}
    assert set(got) == asked
    hits = all_of_them = 0
    for q in asked:
        vectors = [v for i, v in rows if i == q]
        best = [{(j, round(float((w * v).sum()), 9)) for j, w in rows if j != q} for v in vectors]
        assert sorted(got[q]) == list(range(1, 21)) and all(len(x) == len(vectors) for x in got[q].values())
        found = {(j, round(s, 9)) for x in got[q].values() for j, s in x}
        assert found <= set().union(*best)
        true = set().union(*[set(sorted(b, key=lambda x: (-x[1], x[0]))[:20]) for b in best])
        hits, all_of_them = hits + len(found & true), all_of_them + len(true)
        if len(vectors) == 1:
            scores = [got[q][k][0] for k in range(1, 21)]
            assert scores == sorted(scores, key=lambda x: (-x[1], x[0]))
    assert hits >= 0.9 * all_of_them


def test_op4(spark, tables):
    got = Counter((number(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op4_token_counts(spark, tables).collect())
    assert got == Counter((number(i), len(t.encode()), n := len(plain(BYTE, t)), n > 1024) for i, t in DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, tables, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet/*.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, tables).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    flat = lambda df: Counter(tuple("null" if pd.isna(x) else f"{float(x):.9g}" if not isinstance(x, str) else x for x in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert flat(got) == flat(want)


def test_op9(spark, tables):
    model = queries.toxicity_model(queries.table(spark, tables, "documents"), queries.table(spark, tables, "labels"))
    got = Counter((number(r.doc_id), r.held_out, round(r.score, 6), r.predicted) for r in queries.op9_toxicity(spark, tables).collect())
    want = [(i, plain_toxicity(model, t)) for i, t in DOCS]
    assert got == Counter((number(i), held_out(i, 3, 1), round(float(s), 6), int(s >= 0.7)) for i, s in want)
    assert all((s >= 0.7) == (i % 8 in (0, 3)) for i, s in want if i is not None and i < 240 and held_out(i, 3, 1))


def test_op10(spark, tables):
    model = queries.language_model(queries.table(spark, tables, "documents"))
    got = Counter((number(r.doc_id), r.held_out, r.lang_pred, round(r.score, 3)) for r in queries.op10_language(spark, tables).collect())
    want = [(i, *plain_language(model, t)) for i, t in DOCS]
    assert got == Counter((number(i), held_out(i, 5, 0), lang, round(float(s), 3)) for i, lang, s in want)
    assert all(lang == ("aa", "bb")[i % 2] for i, lang, _ in want if i is not None and i < 240)


def test_op12(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/conversations.parquet").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, tables).collect()}
    assert got == {conv: slow_repair(damage([r for r in rows if r[0] == conv])) for conv in {r[0] for r in rows}}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, empty_tables, name):
    assert queries.queries()[name](spark, empty_tables).collect() == []


def test_token_files_are_public():
    assert WORD == public_tokenizers.path("word_bpe_49k.json") and BYTE == public_tokenizers.path("byte_bpe_50k.json")
