"""Exact top-k by KD-trees, repaired conversations, hard negatives: against plain versions on odd tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from tidepool.llm import kdtree, negatives, repair

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, score string, row string, d string"


def vectors():
    """Clusters, many copies of one vector, ties, nulls, zero and empty vectors, other lengths, repeated rows."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 5)) * 4
    rows = [(i, (centres[i % 6] + rng.normal(size=5) * 0.3).round(2).tolist(), i % 4) for i in range(300)]
    rows += [(300 + i, [1.5, -2.0, 0.25, 1.0, 3.0], i % 3) for i in range(150)]
    rows += [(450, None, 1), (500, [0.0] * 5, 2), (550, [1.0, None, 0.0, 0.0, 0.0], 1), (600, [float("nan")] + [1.0] * 4, 1), (650, [float("inf")] + [1.0] * 4, 0)]
    rows += [(700, [1.0, 2.0], 1), (701, [3.0, -2.0], 1), (702, [3.0, 2.0], 2), (750, [], 1), (751, [], 1), (None, centres[0].tolist(), 0), (None, centres[0].tolist(), 3), (800, centres[0].tolist(), None)]
    rows += [(100, rows[100][1], rows[100][2]), (900, [1e9, -1e9, 3e8, 1.0, 7e7], 1), (901, [1e9, -1e9, 3e8, 1.0, 7e7], 1), (902, [1e9, -9e8, 3e8, 1.0, 7e7], 2)]
    return [(i, v, label, "a", "b", "c", "d") for i, v, label in rows]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(vectors(), SCHEMA).repartition(3).cache()


def whole(scale, labels=False):
    """(id, whole components, label) of the rows that take part."""
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    return [(i, [int(np.floor(scale * x)) for x in v], label) for i, v, label, *_ in vectors() if ok(v) and (label is not None or not labels)]


def inner(a, b):
    return max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True))))


def by(pair):
    return -pair[0], pair[1] is None, pair[1] or 0


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize("sizes", [{}, {"shard": 40, "group": 2, "leaf": 8, "queries": 3}, {"shard": 7, "group": 3, "leaf": 1, "queries": 100, "sample": 20}])
def test_top_k(table, sizes):
    got = sorted((tuple(r) for r in kdtree.nearest(table, k=6, every=50, **sizes).collect()), key=key)
    rows, want = whole(1024), []
    for n, (q, x, _) in enumerate(rows):
        if q is not None and q % 50 == 0:
            found = sorted(((inner(x, y), i) for m, (i, y, _) in enumerate(rows) if m != n and len(y) == len(x)), key=by)[:6]
            want += [(q, rank, i, s) for rank, (s, i) in enumerate(found, 1)]
    assert got == sorted(want, key=key)


def test_trees_leave_out_what_lies_below():
    rng = np.random.default_rng(1)
    x = np.floor(1024 * (np.repeat(rng.normal(size=(40, 8)) * 3, 100, axis=0) + rng.normal(size=(4000, 8)) * 0.05))
    trees = [kdtree.Tree(x[i::4], np.arange(4000)[i::4], 16) for i in range(4)]
    of = sum(child < 0 for t in trees for child in t.left)
    for q in x[:20]:
        found, leaves = kdtree.best(trees, q, 10)
        assert [f[:2] for f in found] == sorted((-s, i) for i, s in enumerate(x @ q))[:10]
        assert leaves < 0.2 * of
        again, fewer = kdtree.best(trees, q, 10, kth=found[-1][:2])
        assert again == found and fewer <= leaves


def test_copies_are_left_out_by_their_ids():
    trees = [kdtree.Tree(np.ones((5000, 3)), np.arange(5000), 16)]
    found, leaves = kdtree.best(trees, np.ones(3), 10)
    assert [f[1] for f in found] == list(range(10)) and leaves <= 2


def test_no_vectors(table):
    empty = table.limit(0)
    assert kdtree.nearest(empty, k=3, every=5).collect() == [] and negatives.mine(empty, every=5).collect() == []


@pytest.mark.parametrize("sizes", [{}, {"anchors": 4, "candidates": 50}])
def test_negatives(table, sizes):
    from pyspark.sql import functions as F

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 4).otherwise(F.col("label"))
    got = sorted((tuple(r) for r in negatives.mine(table, every=25, label=moved, **sizes).collect()), key=key)
    rows = [(i, x, (label + 1) % 4 if i is not None and i % 7 == 0 else label) for i, x, label in whole(256, True)]
    want = []
    for n, (a, x, label) in enumerate(rows):
        if a is None or a % 25:
            continue
        scores = [(inner(x, y), i, other) for m, (i, y, other) in enumerate(rows) if m != n and len(y) == len(x)]
        for ps, p, _ in sorted((s for s in scores if s[2] == label), key=by)[:5]:
            fits = [s for s in scores if s[2] != label and 50 * ps <= 100 * s[0] <= 95 * ps]
            want += [(a, p, rank, i, ps, ns) for rank, (ns, i, _) in enumerate(sorted(fits, key=by)[:3], 1)]
    assert got == sorted(want, key=key) and len(want) > 100


BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def conversations():
    rng = np.random.default_rng(5)
    texts = ["Yes.", "No!", "What now?", "and then", "", " \t", None, "Yes.\n", "a.b\u0085", "Yes."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "User"]
    rows = []
    for conv in range(120):
        for turn in range(int(rng.integers(1, 7))):
            rows.append((conv, turn * int(rng.integers(1, 3)), roles[int(rng.integers(0, len(roles)))] if conv % 3 else ("user", "assistant")[turn % 2], texts[int(rng.integers(0, len(texts)))]))
    rows += [(200, None, "user", "Hi."), (200, None, "assistant", "Ho."), (200, 4, "user", "Hi."), (None, 1, "user", "Hm."), (None, 1, "user", "Hm."), (None, None, None, None), (201, 2**62, "user", "x" * 100_000 + "."), (201, -(2**62), "system", "Be.")]
    return rows


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)

    def order(row):
        conv = "" if row[0] is None else str(row[0])
        return row[1] is not None, row[1] or 0, hashlib.sha256(f"{conv}:{len(row[2])}:{row[2]}:{row[3]}".encode() if row[0] is not None else f":{len(row[2])}:{row[2]}:{row[3]}".encode()).digest()

    return sorted(out, key=order)


def slow_repair(rows):
    """All edits are tried, the cheapest first, until the least of the cheapest are known."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(BLANK)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = [(2 * len(rows), "D" * len(rows), [])]

    def go(i, cost, audit, out):
        if cost > best[0][0]:
            return
        initials = "".join(r[:1] if r else "?" for r, _ in out)
        if not re.fullmatch("s?(ua)*u?", initials):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            best[0] = min(best[0], (cost, audit, out))
        if audit.count("I") < 3:
            for role in ("user", "assistant"):
                go(i, cost + 5, audit + "I", [*out, (role, "")])
        if i < len(rows):
            _, _, role, text = rows[i]
            go(i + 1, cost + 2, audit + "D", out)
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                go(i + 1, cost + more, audit + "K", [*out, (role, text)])
                for new in ("user", "assistant"):
                    go(i + 1, cost + 1 + more, audit + "R", [*out, (new, text)])

    go(0, 0, "", [])
    cost, audit, out = best[0]
    turns = {t for _, t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    first = [r[:1] for _, _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
    return min(gaps, 2**63 - 1), faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


@pytest.mark.parametrize("sizes", [{}, {"chunk": 2, "fan": 2}])
def test_repair(spark, sizes):
    rows = conversations()
    table = spark.createDataFrame([(*r, "x", 0, True) for r in rows], "conv_id long, turn long, role string, text string, same string, row int, gone boolean").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in repair.repair(table, **sizes).collect()}
    assert got == {conv: slow_repair(damage([r for r in rows if r[0] == conv])) for conv in {r[0] for r in rows}}


def test_long_conversation_is_cut(spark):
    """A conversation of many chunks has the edits of one fold from end to end."""
    rng = np.random.default_rng(7)
    rows = [(1, i, ("user", "assistant", "system")[int(rng.choice(3, p=[0.5, 0.45, 0.05]))], f"t{int(rng.integers(0, 2000))}" + ("." if rng.random() < 0.8 else "")) for i in range(3000)] + [(c, 0, "user", "Hi.") for c in (0, 2)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    whole, cut = (sorted(tuple(r) for r in repair.repair(table, **sizes).collect()) for sizes in ({"chunk": 100_000}, {"chunk": 16, "fan": 3}))
    assert whole == cut and len(whole) == 3
    part, seen = repair.Part(), set()
    for _, turn, role, text in damage(rows[:3000]):
        part.add(role[:1], turn, "blank" if not text else "duplicate" if (role, text) in seen else "truncated" if text[-1] != "." else "")
        seen.add((role, text))
    end = repair.times(part.matrix, repair.CLOSURE)[0]
    assert whole[1][6:8] == min(end[0], end[3]) and len(whole[1][7].replace("I", "")) == part.count["rows"]


def test_no_conversations(spark):
    assert repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
