"""The stages of the pipeline against plain versions, on tables with odd rows and on the smallest tables given."""

import re
from collections import Counter

import pytest

import corpus_pipeline as pipe
from tests.llm.fixture import empty_tables, plain_language, plain_toxicity, tables  # noqa: F401
from tests.llm.test_near_jaccard import slow_groups

SF = "/root/testdata/sf0.001"
STAGES = dict(pipe.STAGES)


def bag(rows):
    return Counter(tuple(r) for r in rows)


def leaks(texts, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    wanted = [(n, grams(w, n)) for w in map(words, items) if (n := min(5, len(w)))]
    return [any(len(g & grams(words(t), n)) >= 0.8 * len(g) - 1e-9 for n, g in wanted) for t in texts]


def of_language(spark, rows, docs, sf):
    model = pipe.language_model(docs)
    found = [plain_language(model, r.text) for r in rows]
    return [r for r, (lang, score) in zip(rows, found, strict=True) if lang != "und" and score >= pipe.LANGUAGE_SCORE]


def not_toxic(spark, rows, docs, sf):
    model = pipe.toxicity_model(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    return [r for r in rows if plain_toxicity(model, r.text) < pipe.TOXIC_SCORE]


def without_leaks(spark, rows, docs, sf):
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    return [r for r, leak in zip(rows, leaks([r.text for r in rows], items), strict=True) if not leak]


@pytest.mark.parametrize("source", ["odd", "given"])
def test_stages(spark, tables, source):
    sf = tables if source == "odd" else SF
    docs = spark.read.parquet(f"{sf}/documents.parquet").coalesce(1)
    for name, plain in (("language", of_language), ("toxicity", not_toxic), ("near_duplicates", None), ("decontamination", without_leaks)):
        rows = docs.collect()
        out = STAGES[name](spark, docs, sf)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert not bag(got) - bag(rows), name  # nothing changes on the way
        if plain:
            assert bag(got) == bag(plain(spark, rows, docs, sf)), name
        else:  # the first of each group, whatever the order of reading was: one text of each class
            groups = slow_groups([r.text for r in rows])
            of = {r.text: g for r, g in zip(rows, groups, strict=True)}
            assert Counter(of[r.text] for r in got) == Counter(set(groups))
        docs = spark.createDataFrame(got, docs.schema).coalesce(1)
        assert docs.count() or source == "odd"
    pieces = STAGES["packing"](spark, docs, sf).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in got}


def test_every_stage_with_nulls_and_repeats(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    odd = docs.where("doc_id is null or doc_id >= 400 or doc_id = 7")
    kept = {name: Counter(r.doc_id for r in STAGES[name](spark, odd, tables).collect()) for name in ("toxicity", "near_duplicates", "decontamination")}
    assert kept["toxicity"] == Counter(r.doc_id for r in odd.collect())
    assert kept["decontamination"][7] == 3 and kept["decontamination"][401] == 1 and kept["decontamination"][406] == 0  # 406 holds a one-word item
    blank = [i for i in (401, 402, 403) if kept["near_duplicates"][i]]
    assert kept["near_duplicates"][7] == 1 and len(blank) == 1 and kept["near_duplicates"][None] == 1
    languages = STAGES["language"](spark, docs, tables)
    assert not {401, 402, 403, 404} & {r.doc_id for r in languages.collect()} and languages.where("doc_id is null").count() == 1


def test_empty_tables(spark, empty_tables):
    docs = spark.read.parquet(f"{empty_tables}/documents.parquet")
    for name, stage in pipe.STAGES:
        assert stage(spark, docs, empty_tables).collect() == [], name
    assert pipe.run(spark, empty_tables).collect() == []


def test_run_equals_the_stages(spark, tables):
    got = pipe.run(spark, tables)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kept = {r.doc_id for r in got.collect()}
    docs = {i: t for i, t, *_ in (tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").collect())}
    assert kept <= set(docs) and not {401, 402, 403, 404, 406} & kept
    assert not any(re.search("vilething|grimwort", docs[i] or "") for i in kept if i is not None and i < 240)
    assert not any("question0 word0" in (docs[i] or "") for i in kept)
