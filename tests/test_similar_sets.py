"""Similar sets, near vectors and clusters against brute force; what is compared on the way."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import cluster, lsh, setsim


def rows():
    """Sets from a few frequent and many rare elements, some of them copies or near copies, and odd ones."""
    rng = np.random.default_rng(2)
    out = [(i, [f"hot{j}" for j in range(4) if rng.random() < 0.7] + [f"x{int(x)}" for x in rng.integers(0, 900, int(rng.integers(0, 14)))]) for i in range(250)]
    out += [(250 + i, [*out[i][1], f"y{i}"]) for i in range(80)] + [(330 + i, list(reversed(out[i][1]))) for i in range(40)]
    return [*out, (400, None), (401, []), (402, [None, "hot0"]), (403, ["hot0", "hot0"]), (404, ["hot0"]), (405, ["hot0", "hot1"])]


SETS = {i: {x for x in s or [] if x is not None} for i, s in rows()}


@pytest.fixture(scope="module")
def sets(spark):
    return spark.createDataFrame([(i, s, 0) for i, s in rows()], "id long, items array<string>, n int").cache()


@pytest.mark.parametrize("threshold", [0.35, 0.5, 0.8, 1.0])
def test_similar(sets, threshold):
    got = setsim.similar(sets, "id", F.col("items"), threshold)
    want = {}
    for (i, a), (j, b) in itertools.combinations(sorted((i, s) for i, s in SETS.items() if s), 2):
        if len(a & b) >= threshold * len(a | b) - 1e-9:
            want[i, j] = (len(a & b), round(len(a & b) / len(a | b), 9))
    pairs = got.expanded().collect()
    assert {(r.a, r.b): (r.common, round(r.jaccard, 9)) for r in pairs} == want and len(pairs) == len(want) > 40
    n = len({frozenset(s) for s in SETS.values() if s})
    assert got.candidates.count() < (0.5 if threshold == 0.35 else 0.1) * n * (n - 1) / 2


@pytest.mark.parametrize("least", [1, 2, 5])
def test_overlapping(sets, least):
    got = {(r.a, r.b): r.common for r in setsim.overlapping(sets, "id", F.col("items"), least).expanded(F.col("n") >= least).collect()}
    assert got == {(i, j): len(a & b) for (i, a), (j, b) in itertools.combinations(sorted(SETS.items()), 2) if len(a & b) >= least}


def test_a_frequent_element_makes_no_candidates(spark):
    """All sets hold the same elements beside one of their own: with half in common none is a candidate by the frequent ones."""
    df = spark.range(2000).select("id", F.array(F.lit("all"), F.concat(F.lit("own"), "id"), F.concat(F.lit("own_too"), "id")).alias("items"))
    assert setsim.similar(df, "id", F.col("items"), 0.5).candidates.count() == 0
    copies = spark.range(2000).select("id", F.array(F.lit("all"), F.concat(F.lit("g"), F.col("id") % 3)).alias("items"))
    found = setsim.similar(copies, "id", F.col("items"), 0.9)
    assert found.candidates.count() == 0 and found.stars().count() == 1997


def test_no_sets(sets):
    found = setsim.similar(sets.limit(0), "id", F.col("items"), 0.5)
    assert found.pairs.collect() == found.expanded().collect() == found.stars().collect() == []


def classes(ids, edges):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {i: find(i) for i in ids}


def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 16))
    out = [(i, (base[i % 12] + rng.normal(size=16) * 0.35).tolist()) for i in range(240)]
    out += [(240 + i, (base[0] + rng.normal(size=16) * 0.01).tolist()) for i in range(120)] + [(400 + i, out[0][1]) for i in range(50)]
    return [*out, (500, None), (501, [0.0] * 16), (502, [1.0, 2.0]), (503, [2.0, 4.1]), (504, (-np.array(out[0][1])).tolist())]


@pytest.mark.parametrize("small", [32, 3])
def test_near_links(spark, small):
    held, read = vectors(), {}
    df = spark.createDataFrame(held, "id long, v array<double>")
    links = [(r.a, r.b) for r in cluster.near_links(df, "id", "v", 0.84, bits=8, small=small, counters=read).collect()]
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in held if v is not None and any(v)}
    close = [(a, b) for a, b in itertools.combinations(unit, 2) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.84]
    assert {tuple(sorted(x)) for x in links} <= {tuple(sorted(x)) for x in close}
    assert classes(unit, links) == classes(unit, close)
    assert len(links) < len(close)  # a forest of the copies, not all pairs


def test_the_chance_of_a_miss():
    """Pairs just at the threshold share one of the keys that the formula asks for."""
    rng = np.random.default_rng(1)
    n_keys = cluster.keys_needed(0.84)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.84 * x + np.sqrt(1 - 0.84**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    planes = rng.normal(size=(64, n_keys * cluster.BITS))
    same = ((x @ planes >= 0) == (y @ planes >= 0)).reshape(400, n_keys, cluster.BITS).all(axis=2).any(axis=1)
    assert same.mean() > 0.99


def test_four_sources(spark):
    """Each source links on its own, and chains across sources make one cluster."""
    rows = [
        (1, "Alpha beta gamma delta", ["A"]), (2, "delta GAMMA beta alpha 42", []),  # the same words
        (3, "one two three four", ["P", "Q", "R"]), (4, "five six seven eight", ["P", "Q"]),  # entities
        (5, "red green blue black white", []), (6, "red green blue black yellow", ["Z"]),  # words
        (7, "nothing like that here", []), (8, "another matter altogether", []),  # vectors
        (9, "12 34", []), (10, " 12 34", []), (11, "12 35", []),  # texts without words
        (12, None, None), (13, "", None), (14, "five lonely", ["A", "B", "C"]),
    ]
    docs = spark.createDataFrame(rows, "id long, text string, entities array<string>")
    vecs = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.9, 0.1]), (5, [0.0, 1.0]), (99, [1.0, 0.0]), (4, [-1.0, 0.0]), (6, [-0.9, -0.5])], "id long, v array<double>")
    got = {r.id: r.cluster for r in cluster.semantic(docs, "id", "text", vecs, "v", F.col("entities")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 3, 7: 7, 8: 7, 9: 9, 10: 9, 11: 11, 12: 12, 13: 12, 14: 14}


@pytest.mark.parametrize("block", [7, 8192])
def test_fingerprints_by_blocks(spark, block):
    """A value of a band that most fingerprints have is shared out; pairs come once, nearest ones without the pairs; no join of rows with rows is in the plan."""
    rng = np.random.default_rng(5)
    h = [int(x) for x in rng.integers(0, 1 << 56, 12)]
    h = [x ^ (1 << int(b)) ^ (1 << int(c)) for x in h for b, c in rng.integers(0, 63, (8, 2))] + [0, -1, h[0]]
    df = spark.createDataFrame([*enumerate(h), (500, None), (501, h[3])], "id long, h long")
    first = {}
    for i, x in enumerate(h):
        first.setdefault(x & (1 << 64) - 1, i)
    want = {}
    for (x, i), (y, j) in itertools.combinations(sorted(first.items(), key=lambda p: p[1]), 2):
        if (x ^ y).bit_count() <= 8 and any(not (x ^ y) >> 8 * k & 255 for k in range(8)):
            want[i, j] = (x ^ y).bit_count()
    pairs = lsh.similar(df, "id", "h", block=block)
    rows = pairs.collect()
    assert {(r.a, r.b): r.distance for r in rows} == want and len(rows) == len(want) > 100
    best = {i: min((d, b if a == i else a) for (a, b), d in want.items() if i in (a, b)) for i in {x for p in want for x in p}}
    assert {r.a: (r.distance, r.b) for r in lsh.nearest_similar(df, "id", "h", block=block).collect()} == best
    assert "SortMergeJoin" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert lsh.similar(df.limit(0), "id", "h").collect() == lsh.nearest_similar(df.limit(0), "id", "h").collect() == []


def test_candidates_are_verified_by_cells(spark, sets, monkeypatch):
    """Candidates are dealt by cells of two blocks and meet their blocks' sets; no set is joined to each of its candidates. Small blocks change nothing."""
    monkeypatch.setattr(setsim, "BLOCK", 16)
    monkeypatch.setattr(setsim, "ELEMENTS", 60)
    _, one = setsim._ordered(sets, "id", F.col("items"))
    found = one.select(F.col("class").alias("a")).join(one.select(F.col("class").alias("b")), F.col("a") < F.col("b"))
    got = {(r.a, r.b): r.common for r in setsim._verified(found, one, lambda common, both: common * 1.5 >= 0.5 * both - setsim.NEAR).collect()}
    first = {}
    for i, s in SETS.items():
        first.setdefault(frozenset(s), i)
    each = sorted((i, s) for s, i in first.items() if s)
    assert got == {(i, j): len(a & b) for (i, a), (j, b) in itertools.combinations(each, 2) if len(a & b) * 1.5 >= 0.5 * (len(a) + len(b)) - 1e-9} and got


@pytest.mark.parametrize("most", [3, 256])
def test_copies_are_paired_as_lists(spark, monkeypatch, most):
    """Behind the last exchange lists of ids are paired; lists of any length give each pair once."""
    monkeypatch.setattr(setsim, "PACKED", most)
    df = spark.range(40).select("id", F.when(F.col("id") % 3 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("items"))
    pairs = setsim.similar(df, "id", F.col("items"), 0.5).expanded()
    rows = pairs.collect()
    assert {(r.a, r.b): r.jaccard for r in rows} == {(i, j): 1.0 if (i % 3 == 0) == (j % 3 == 0) else 2 / 3 for i, j in itertools.combinations(range(40), 2)} and len(rows) == 780
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("Union")[1].split("Repartition")[0] and "Generate explode(ib" in plan.split("RepartitionByExpression")[0]


@pytest.mark.parametrize("most", [3, 256])
def test_shared_elements_are_counted_where_they_lie(spark, sets, monkeypatch, most):
    """With few common elements wanted, the sets of an element are paired as lists and counted; the sets themselves go into no join."""
    monkeypatch.setattr(setsim, "PACKED", most)
    found = setsim.overlapping(sets, "id", F.col("items"), 2)
    assert not any(x in found.pairs._jdf.queryExecution().optimizedPlan().toString() for x in ("array_intersect", "hs#"))
    assert {(r.a, r.b): r.common for r in found.expanded(F.col("n") >= 2).collect()} == {(i, j): len(a & b) for (i, a), (j, b) in itertools.combinations(sorted(SETS.items()), 2) if len(a & b) >= 2}


@pytest.mark.parametrize("threshold, blocks", [(0.35, 1), (0.35, 9), (0.8, 9)])
def test_links_without_candidates(spark, sets, monkeypatch, threshold, blocks):
    """Blocks of sets meet in memory, and a forest of their links comes out: it connects what pairs of similar sets connect, and no candidate is written."""
    monkeypatch.setattr(setsim, "BLOCKS", blocks)
    monkeypatch.setattr(setsim, "LINKED", (8, 4096))
    monkeypatch.setattr(setsim, "HELD", (40, 1_000_000))
    links = setsim.linked(sets, "id", F.col("items"), threshold)
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "CoGroup" not in plan and "set-candidates" not in plan
    got, near = [(r.a, r.b) for r in links.collect()], [(i, j) for (i, a), (j, b) in itertools.combinations(sorted((i, s) for i, s in SETS.items() if s), 2) if len(a & b) >= threshold * len(a | b) - 1e-9]
    assert {tuple(sorted(x)) for x in got} <= set(near)
    assert classes(SETS, got) == classes(SETS, near)
    assert setsim.linked(sets.limit(0), "id", F.col("items"), threshold).collect() == []


def test_block_cells():
    """Each size lies in one block or in blocks of its own, and blocks of sizes that can be similar meet."""
    places, cells = setsim._blocked([(1, 3), (2, 100_000), (7, 10), (50, 4)], 0.35)
    assert [p for _, _, p in places][1] > 1 and places[0][1:] == (0, 1)
    at = {s: range(f, f + p) for s, f, p in places}
    assert all((i, j) in cells for x in (1, 2) for y in (2, 7) if x < y and x >= 0.35 * y for i in at[x] for j in at[y])
    assert not any((i, j) in cells for i in at[2] for j in at[50]) and setsim._blocked([], 0.5) == ([], [])


@pytest.mark.parametrize("threshold, few", [(0.35, 2000), (0.5, 2000), (1.0, 2000), (0.5, 3)])
def test_pairs_of_sets_as_bits(spark, sets, monkeypatch, threshold, few):
    """Sets of few elements are compared as bits of any number of words, by blocks, and pairs are moved no more; more elements go the other way with the same pairs."""
    monkeypatch.setattr(setsim, "FEW", few)
    monkeypatch.setattr(setsim, "BITS", (60, 90))
    monkeypatch.setattr(setsim, "AT_ONCE", 500)
    got = setsim.pairs(sets, "id", F.col("items"), threshold)
    rows = got.collect()
    want = {(i, j): len(a & b) / len(a | b) for (i, a), (j, b) in itertools.combinations(sorted((i, s) for i, s in SETS.items() if s), 2) if len(a & b) >= threshold * len(a | b) - 1e-9}
    assert {(r.a, r.b): r.jaccard for r in rows} == want and len(rows) == len(want) > 40
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert few == 3 or "Join" not in plan.split("RepartitionByExpression")[0] and "MapInArrow" in plan.split("RepartitionByExpression")[0]
    assert setsim.pairs(sets.limit(0), "id", F.col("items"), threshold).collect() == []
