"""Near-duplicates of the pipeline against exact five-word Jaccard similarity."""

import numpy as np
import pytest

from tidepool.llm import near, simhash


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def slow_groups(texts):
    """The least index of each text's component over all pairs at 0.8."""
    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if both >= 0.8 * (len(s) + len(sets[j]) - both) - 1e-9:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def texts():
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(500)]
    base = [[vocab[i] for i in rng.integers(0, 500, n)] for n in (60, 100, 150, 400)]
    out = []
    for i in range(160):
        words = list(base[i % 4])
        for _ in range(int(rng.integers(0, 6))):
            words[int(rng.integers(0, len(words)))] = f"new{int(rng.integers(0, 9))}"
        out.append(" ".join(words))
    return [*out, out[3], out[3].upper(), None, "", "one two", "ONE  two", "one two three"]


def linked_by_prints(a, b, distance=6):
    return (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count() <= distance


@pytest.mark.parametrize("block", [near.BLOCK, 7])
def test_groups_against_brute_force(spark, block):
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near.near_duplicates(df, block=block).collect()}
    assert [got[i] for i in range(len(rows))] == slow_groups(rows)


def test_parts_are_bounded_by_shingles(spark, monkeypatch):
    """Few but long sets are cut into parts as many short ones are."""
    monkeypatch.setattr(near, "SHINGLES", 900)
    rows = texts()
    got = {r.doc_id: r.component_id for r in near.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == slow_groups(rows)


def test_stage_keeps_by_similarity_not_by_fingerprint(spark):
    import corpus_pipeline as pipe

    rows = texts()
    sets = [grams(t) for t in rows]
    pairs = [(i, j, len(sets[i] & sets[j]) / len(sets[i] | sets[j])) for i in range(160) for j in range(i)]
    missed = [(i, j) for i, j, s in pairs if s >= 0.8 and not linked_by_prints(rows[i], rows[j])]
    wrong = [(i, j) for i, j, s in pairs if s < 0.8 and linked_by_prints(rows[i], rows[j])]
    assert missed and wrong
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    kept = {r.doc_id for r in pipe.near_duplicates(spark, df, "").collect()}
    assert kept == set(slow_groups(rows))
    for pair in (*missed[:3], *wrong[:3]):  # two documents alone
        stage = pipe.near_duplicates(spark, df.where(df.doc_id.isin(*pair)), "")
        assert stage.count() == (1 if pair in missed else 2)


def test_odd_rows(spark, no_docs):
    assert near.near_duplicates(no_docs).collect() == []
