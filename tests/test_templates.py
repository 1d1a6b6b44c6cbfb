"""Templates of lines against a plain miner; patterns that they make."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidepool.operators import events as ev


def lines():
    rng = random.Random(3)
    out = []
    for i in range(300):
        n, host, path = rng.randint(0, 500), f"node-{rng.randint(1, 9)}", rng.choice(["/a", "/b", "/c/d"])
        out.append(
            rng.choice([
                f"disk {n} on {host} is {rng.choice(['full', 'fine', 'gone'])}", f"GET {path} took {n} ms", f"PUT {path} took {n} ms (cached)", f"job {n}: {rng.choice(['started', 'stopped'])} by {host}",
                "heartbeat", "a b c d e f", "a b c x y z", f"cost is $5.{n} [ok] (a+b)*c", "",
            ])
        )
    return [*enumerate(out), (1000, None), (1001, "alone and unlike all others here")]


def plain(rows, threshold):
    """Pairs of all shapes, joined into groups; then the groups' templates."""
    shapes = defaultdict(list)
    for i, text in rows:
        if text is not None:
            shapes[re.sub("[0-9]+", "0", text)].append((i, text.split(" ")))
    names, root = list(shapes), {s: s for s in shapes}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for a in names:
        for b in names:
            x, y = a.split(" "), b.split(" ")
            if len(x) == len(y) and sum(p == q for p, q in zip(x, y, strict=True)) >= threshold * len(x) - 1e-9:
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for s in names:
        groups[find(s)] += shapes[s]
    out = set()
    for members in groups.values():
        places = list(zip(*(w for _, w in members), strict=True))
        template = " ".join(p[0] if len(set(p)) == 1 else "<*>" for p in places)
        out.add((min(i for i, _ in members), len(places), places[0][0] if len(set(places[0])) == 1 else "<*>", template, len(members)))
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.4, 0.5, 0.7, 1.0])
def test_mined(spark, threshold):
    rows = lines()
    want = plain(rows, threshold)
    for order in (rows, rows[::-1], random.Random(1).sample(rows, len(rows))):
        df = spark.createDataFrame(order, "id long, text string").repartition(3)
        assert {tuple(r) for r in ev.mined(df, "id", "text", threshold).collect()} == want
        if threshold != 0.4:
            break


def test_no_lines(spark):
    assert ev.mined(spark.createDataFrame([], "id long, text string"), "id", "text").collect() == []


def test_patterns_give_the_parameters(spark):
    df = spark.createDataFrame([("cost is <*> [ok] (a+b)*c", "cost is $5.20 [ok] (a+b)*c"), ("<*> by <*>", "x by y"), ("no wildcard?", "no wildcard?"), ("a <*>", "b c"), ("<*>", "a\\b")], "t string, s string")
    got = df.select(ev.parameters("s", "t").alias("p"), F.call_function("regexp_like", "s", ev.pattern_of("t")).alias("fits")).collect()
    assert [r.fits for r in got] == [True, True, True, False, True]
    assert [r.p for r in got] == [["$5.20"], ["x", "y"], [], [""], ["a\\b"]]
