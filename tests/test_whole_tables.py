"""Queries that once read a fixed range of ids, against brute force over whole tables."""

import itertools
import re
from collections import Counter, defaultdict

import pytest

from tidepool.plans import registry

SF = "/root/testdata/sf0.01"


def test_pairs_of_chunks_by_entities(spark):
    chunks = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id").collect():
        chunks[r.user_id].add(r.event_id % 997)
    n = Counter(p for c in chunks.values() for p in itertools.combinations(sorted(c), 2))
    got = {(r.a, r.b): r.shared for r in registry.queries()["jn_pair_entities"](spark, SF).collect()}
    assert got == {p: k for p, k in n.items() if k >= 2}
    assert max(b for _, b in got) == 996


def test_jaccard_of_every_next_document(spark):
    t = {r.doc_id: set(re.findall("[a-z0-9_]+", (r.text or "").lower())) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {i: len(t[i] & t[i + 1]) / len(t[i] | t[i + 1]) if t[i] | t[i + 1] else None for i in t if i + 1 in t}
    got = {r.a: r.jaccard for r in registry.queries()["set_jaccard_tokens"](spark, SF).collect()}
    assert len(got) > 79 and got == {i: None if s is None else pytest.approx(s) for i, s in want.items()}


def test_tables_are_dealt_for_long_work(spark, tmp_path):
    """A file of one row group is one task; notes and packed rows are shared out by their number, and no batch grows with the table."""
    from tidepool.plans import registry, tables

    assert tables.dealt(spark.range(10_000), "id").rdd.getNumPartitions() == 3 and tables.dealt(spark.range(0)).rdd.getNumPartitions() == 1
    spark.createDataFrame([(i, i % 2, "A") for i in range(9000)], "c_custkey long, c_nationkey int, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "X"), (1, "Y")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    each = tables.notes(spark, str(tmp_path))
    assert each.rdd.getNumPartitions() == 3 and each.count() == 9000
    spark.range(9000).selectExpr("id AS event_id", "concat('a', chr(10), 'b', id) AS props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(5).selectExpr("id % 2 AS doc_id").write.parquet(f"{tmp_path}/labels.parquet")
    spark.range(0).selectExpr("id AS item_id").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registry.queries()["ded_recursive"](spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {("events", 9000, 9000), ("labels", 5, 5), ("benchmark", 0, 0)}
    assert "collect_list" not in got._jdf.queryExecution().toString()
