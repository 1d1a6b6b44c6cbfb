"""SimHash, nearest neighbours, decontamination and licences against brute force."""

import re

import duckdb
import numpy as np
import pytest
import xxhash

from tidepool.llm import ann, decontam, licenses, simhash


def slow_print(text, n=3):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints, distance):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def check(df, distance, **more):
    rows = df.select("doc_id", "text").collect()
    got = simhash.near_duplicates(df, distance=distance, **more).collect()
    prints = [slow_print(r.text) for r in rows]
    classes = slow_components(prints, distance)
    least: dict = {}
    for r, c in zip(rows, classes, strict=True):
        if r.doc_id is not None:
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = sorted((-1 if r.doc_id is None else r.doc_id, p, least.get(c, -1)) for r, p, c in zip(rows, prints, classes, strict=True))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fp % (1 << 64), -1 if r.component_id is None else r.component_id) for r in got) == want


@pytest.mark.parametrize(("distance", "bucket"), [(3, None), (3, 2), (6, None), (6, 4)])
def test_components_of_texts(spark, distance, bucket):
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(400)]
    base = [[vocab[i] for i in rng.integers(0, 400, 120)] for _ in range(6)]
    rows = []
    for i in range(90):
        words = list(base[i % 6])
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(0, 120))] = "changed"
        rows.append((i + 10, " ".join(words)))
    rows += [(1, None), (2, ""), (3, "one two"), (4, "ONE two"), (None, "one two"), (500, rows[0][1])]
    check(spark.createDataFrame(rows, "doc_id long, text string"), distance, bucket=bucket)


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs, 3)
    assert simhash.near_duplicates(no_docs).collect() == []


def test_masks_cover_all_close_pairs():
    rng = np.random.default_rng(0)
    for distance in simhash.BLOCKS:
        for _ in range(300):
            flips = sum({1 << int(b) for b in rng.choice(64, distance, replace=False)})
            assert any(flips & m == 0 for _, m in simhash.masks(distance)[0])


def exact(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, v in ok:
        if i is not None and i % every == 0:
            scored = sorted((-(w * v).sum(), j) for j, w in ok if j != i)
            out[i] = scored[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=12).tolist()) for i in range(600)]
    rows += [(600 + i, rows[0][1]) for i in range(30)]
    rows += [(700, None), (720, [0.0] * 12), (740, [None] + [1.0] * 11), (760, [float("nan")] * 12), (780, [1.0] * 5), (781, [1.0, 2.0, 1.0, 1.0, 1.0]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumnRenamed("embedding", "v")
    df = df.withColumnsRenamed({"v": "embedding"})
    got = ann.nearest(df.selectExpr("*", "0 AS row", "1 AS rank", "2 AS score", "3 AS asks"), 20, 20, block=256, queries=10).collect()
    assert {r.query_id for r in got if r.vec_id == 781} == {780} and [(r.query_id, r.rank, r.vec_id, r.score) for r in got if r.query_id == 780] == [(780, 1, 781, 6.0)]
    got = [r for r in got if r.query_id != 780]
    stored = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding is None or len(r.embedding) == 12]
    want = {i: s for i, s in exact([(i, v) for i, v in stored if i is not None], 20, 20).items()}
    found = {i: {r.vec_id for r in got if r.query_id == i} for i in want}
    assert {r.query_id for r in got} == set(want)
    recall = np.mean([len(found[i] & {j for _, j in s}) / len(s) for i, s in want.items()])
    assert recall >= 0.9
    for i in want:
        mine = sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(mine) + 1))
        assert [r.score for r in mine] == sorted((r.score for r in mine), reverse=True)
    assert ann.nearest(df.limit(0), 20, 20).collect() == []


def test_few_neighbours_are_all_found(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(15)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, 20, 5).collect()
    assert {q: sum(r.query_id == q for r in got) for q in (0, 5, 10)} == {0: 14, 5: 14, 10: 14}
    ties = [(r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0 and r.score == 1.0]
    assert ties == sorted(ties)


@pytest.mark.parametrize("distance", [0, 1, 3])
def test_probing_is_complete_and_selective(distance):
    rng = np.random.default_rng(5)
    code = rng.integers(0, 1 << 16, (4000, 6)).astype(np.uint16)
    near = code[:5] ^ np.uint16(1 << 7 | 3)
    code[100:105] = near
    queries = code[:5]
    apart = np.bitwise_count(queries[:, None] ^ code[None])
    radius = (distance + 1) * code.shape[1] - 1
    got = ann.MultiIndex(code).retrieve(queries, radius)
    assert (got == (apart.min(axis=2) <= distance)).all()
    assert got[apart.sum(axis=2) <= radius].all()
    assert got.mean() < (0.001, 0.003, 0.08)[(0, 1, 3).index(distance)]


@pytest.mark.parametrize("radius", range(0, 15, 2))
def test_every_radius_is_complete(radius):
    code = np.random.default_rng(8).integers(0, 1 << 16, (500, 5)).astype(np.uint16)
    code[:200] = code[200] ^ (np.uint16(1) << np.random.default_rng(9).integers(0, 16, (200, 5)).astype(np.uint16)) * (np.arange(200)[:, None] % 6 > np.arange(5))
    got = ann.MultiIndex(code).retrieve(code[:50], radius)
    assert (got == (ann.needed(code[:50, None], code[None]) <= radius)).all()
    assert got[np.bitwise_count(code[:50, None] ^ code[None]).sum(axis=2) <= radius].all()


def test_probing_rises_until_there_are_enough_rows():
    code = np.random.default_rng(6).integers(0, 1 << 16, (3000, 4)).astype(np.uint16)
    got = ann.MultiIndex(code).retrieve(code[:8], 0, 200)
    assert (got.sum(axis=1) >= 200).all() and got.mean() < 0.5
    assert ann.MultiIndex(code).retrieve(code[:8], 0, 3000).all()


def test_codes_hold_no_constant_bits():
    x = np.random.default_rng(7).normal(size=(2000, 64))
    code = ann.codes(ann.lifted(x), ann.learn(ann.lifted(x[:500]), steps=3))
    assert code.shape == (2000, ann.BITS // ann.SUB_BITS)
    bits = np.unpackbits(code.view(np.uint8), axis=1).mean(axis=0)
    assert 0.02 < bits.min() and bits.max() < 0.98


def test_recall_and_share_of_the_index():
    """In the index's own terms, at several sizes: true neighbours among the rows that probing retrieves, and the share of all rows that these are, which falls as a table grows."""
    rng, shares = np.random.default_rng(4), []
    every = np.hstack([rng.normal(size=(32_768, 24)), 0.4 * rng.normal(size=(32_768, 40))])
    for n in (500, 2000, 10_000, 32_768):
        x = every[:n]
        rotations = ann.learn(ann.lifted(x[:2000]), steps=5)
        index, asks = ann.MultiIndex(ann.codes(ann.lifted(x), rotations)), np.arange(0, len(x), len(x) // 80)
        got = index.retrieve(ann.codes(ann.asked(x[asks]), rotations), ann.measured(x[: ann.SAMPLE], rotations, 20), 21)
        score = x[asks] @ x.T
        score[np.arange(len(asks)), asks] = -np.inf
        best = np.argsort(-score, axis=1)[:, :20]
        assert np.take_along_axis(got, best, 1).mean() >= 0.9
        shares.append(got.mean())
    assert shares == sorted(shares, reverse=True) and shares[0] < 0.6 and shares[-1] < 0.6 * shares[0], shares


def test_recall_on_the_vectors_given(spark):
    """The query itself on the largest table at hand."""
    from tidepool.llm import queries

    x = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got: dict = {}
    for r in queries.op3_nearest(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact(x, 20, 20)
    assert {len(v) for v in got.values()} == {20} and set(got) == set(want)
    assert np.mean([len(got[i] & {j for _, j in s}) / 20 for i, s in want.items()]) >= 0.9


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_contained(spark, odd_docs, no_docs):
    rng = np.random.default_rng(2)
    item = [f"t{i}" for i in rng.integers(0, 900, 40)]
    other = [f"u{i}" for i in range(12)]
    listed = [(1, " ".join(item)), (2, " ".join(other)), (3, "Too short!"), (4, None), (2, " ".join(other)), (5, "..."), (None, "one two three four"), (6, "u3")]
    items = spark.createDataFrame(listed, "item_id long, text string")
    filler = [f"f{i}" for i in range(300)]
    broken = [w if i % 13 else "x" for i, w in enumerate(item)]
    nearly = item[:-1] + ["y"]
    rows = [(1, " ".join(filler + item + filler)), (2, " ".join(broken)), (3, " ".join(nearly).upper()), (4, " ".join(other[:10])), (5, "; ".join(filler + other)), (6, None), (1, " ".join(item)), (7, "too short"), (7, "too, SHORT of"), (8, "too"), (None, "zero one two three four"), (None, "zero one two three four"), (9, "short too " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = []
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    for d, t in rows:
        for i, s in set(listed):
            n = min(5, len(words(s or "")))
            if n:
                share = len(grams(words(s), n) & grams(words(t), n)) / len(grams(words(s), n))
                if share >= 0.8:
                    want.append((d or -1, i or -1, round(share, 9)))
    for broadcast in (decontam.BROADCAST, 0):
        found = decontam.contained(docs.selectExpr("*", "1 AS item_id", "2 AS h", "3 AS k1", "4 AS words"), items, broadcast=broadcast).collect()
        assert sorted((r.doc_id or -1, r.item_id or -1, round(r.containment, 9)) for r in found) == sorted(want)
    assert decontam.contained(odd_docs, items).collect() == []
    assert decontam.contained(no_docs, items).collect() == []
    assert decontam.contained(docs, items.limit(0)).collect() == []


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("broadcast", [0, decontam.BROADCAST])
def test_contained_is_native_and_moves_no_texts_in_search(spark, odd_docs, broadcast):
    items = spark.createDataFrame([(1, "a b c d e f"), (2, "x y")], "item_id long, text string")
    plan = plan_of(decontam.contained(odd_docs.select("doc_id", "text"), items))
    assert "ArrowEval" not in plan and "MapIn" not in plan and "BatchEval" not in plan
    wanted, lengths = decontam.item_shingles(items)
    assert lengths == [2, 5]
    wanted = decontam.materialise(wanted, "test")
    search = decontam.candidates(decontam.materialise(odd_docs.select("doc_id", "text"), "test"), wanted, lengths, broadcast=broadcast)
    sent = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", spark._jvm.PythonSQLUtils.explainString(search._jdf.queryExecution(), "formatted"))
    assert sent and {re.sub(r"#\d+L?", "", c) for columns in sent for c in columns.split(", ")} <= {"k1", "k2", "h", "item_id", "item"}


def test_the_sketch_is_smaller_than_the_item_and_never_missed(spark):
    rng = np.random.default_rng(4)
    item = [f"t{i}" for i in rng.permutation(900)[:204]]
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    wanted, lengths = decontam.item_shingles(items)
    assert wanted.count() == 200 and wanted.where("sketched").count() == 52  # floor(0.2 * 256) + 1
    docs = spark.createDataFrame([(i, " ".join(item[a : a + 164])) for i, a in enumerate(range(0, 41, 4))], "doc_id long, text string")  # 160 of 200 shingles
    assert {r.doc_id for r in decontam.contained(docs, items).collect()} == set(range(11))


TEXTS = [
    "Released under the MIT License.", "mit license MIT-License mit  license", "license mit", None, "", "Licensed under the Apache License, Version 2.0.", "GENERAL public license general public license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without any restriction",
    "Licensed under CC BY-NC 4.0.", "éMIT license", "mit licenseé", "K" * 5000 + " mit license", "mit\x00license",
]


def test_licenses(spark, odd_docs, no_docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, TEXTS[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.scan(df).collect()
    assert len(got) == len(rows)
    phrases = {tuple(p.split()): label for p, label in licenses.PHRASES.items()}
    by_id = {r.doc_id: r for r in got}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = sorted(p for phrase in phrases for p in range(len(w)) if tuple(w[p : p + len(phrase)]) == phrase)
        assert by_id[i].n_words == len(w)
        assert sorted(s.start for s in by_id[i].spans if s.base) == places
    label = lambda i: {s.label for s in by_id[i].spans}
    assert label(7) == {"mit"} and label(8) == {"cc-by-nc"} and label(5) == {"apache"}
    assert len(licenses.scan(odd_docs).collect()) == odd_docs.count()
    assert licenses.scan(no_docs).collect() == []


def test_licence_spans_are_verified(spark):
    line = "released under the mit license"
    rows = [(1, f"{line} {line} {line}"), (2, "mit license under the mit license released"), (3, "released under the very same mit license"), (4, "license mit the under released"), (5, "you may not use this file and also not except in compliance with the license you may obtain a copy of the license at")]
    got = {r.doc_id: sorted((s.start, s.end, s.template.split()[0]) for s in r.spans if not s.base) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == [(0, 5, "released"), (5, 10, "released"), (10, 15, "released")]
    assert got[2] == got[3] == got[4] == [] and got[5] == [(0, 24, "you")]


def test_sql_forms_on_odd_rows(spark):
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(TEXTS)), "text": TEXTS}))
    want = {r[0]: r[1] for r in con.sql(f"SELECT doc_id, n_base FROM ({licenses.ORACLE})").fetchall()}
    got = licenses.scan(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()
    assert {r.doc_id: sum(s.base for s in r.spans) for r in got} == want
