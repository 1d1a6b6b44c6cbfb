"""Extraction on sentences whose facts are known."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidepool.operators import extract
from tidepool.plans import q_extract


def found(spark, said):
    return [(r.entity, r.relation, r.value) for r in extract.facts(spark.createDataFrame([(1, said)], "id long, text string"), "id", "text").orderBy("place").collect()]


@pytest.mark.parametrize(
    ("said", "stated"),
    [
        ("Caroline moved from Sweden to Denver.", ("Caroline", "location", "Denver")),
        ("User moved from Denver to Santa Fe last month. It was cold.", ("User", "location", "Santa Fe")),
        ("I moved from the old town to Lisbon", ("User", "moved_from", "old town")),
        ("My default coffee is a flat white, always.", ("User", "coffee_order", "flat white")),
        ("Melanie painted the sunset.", ("Melanie", "painted", "sunset")),
        ("I had switched from oat milk to whole milk.", ("User", "coffee_order", "whole milk")),
        ("Gear: the old pack became a briefcase; more", ("User", "bag", "briefcase")),
        ("Current travel profile: latte, aisle, sling, anker brick, muji pad, Oslo base", ("User", "location", "Oslo")),
        ("We're currently based in New York.", ("User", "location", "New York")),
    ],
)
def test_facts(spark, said, stated):
    assert stated in found(spark, said)


def test_facts_are_told_once_and_ten_at_most(spark):
    assert len(found(spark, "Bob bought a lamp. Bob bought the lamp. BOB bought Lamp.")) == 1
    assert len(found(spark, " ".join(f"Bob bought thing{i}." for i in range(20)))) == 10
    for nothing in (None, "", "Nothing to see here.", "my notebook was green"):
        assert found(spark, nothing) == []


def test_graph(spark):
    df = spark.createDataFrame([(1, "Alice Smith prefers Oolong Tea. The build uses Gradle. NASA is old."), (2, None), (3, "is is is")], "id long, text string")
    edges = {(r.src, r.relation, r.dst): r.confidence for r in extract.relations(df, "id", "text").collect()}
    assert edges["Alice Smith", "prefers", "Oolong Tea"] == pytest.approx(0.86)
    assert edges["build", "uses", "Gradle"] == pytest.approx(0.88) and edges["NASA", "is", "old"] == pytest.approx(0.66)
    steps = spark.createDataFrame([(1, 1, "Bob", "prefers", "tea", 0.9), (2, 1, "bob", "prefers", "Tea", 0.9), (3, 1, "Bob", "prefers", "milk", 0.9), (4, 1, "Bob", "likes", "x", 0.9), (5, 1, "Bob", "likes", "y", 0.9), (6, 1, "Bob", "likes", "x", 0.9), (7, 1, "Bob", "likes", "z", 0.1)], "id long, place int, src string, relation string, dst string, confidence double")
    got = {(r.relation, r.dst): (r.valid_from, r.valid_to, r.status) for r in extract.applied(steps, ["id", "place"]).collect()}
    assert got == {("prefers", "tea"): (1, 3, "inactive"), ("prefers", "milk"): (3, None, "active"), ("likes", "x"): (4, None, "active"), ("likes", "y"): (5, None, "active")}


def test_mentions(spark):
    df = spark.createDataFrame([(1, "We met on March 5, 2024 and followed up on 3/12."), (2, "sept 1st and 2/30 and 1999-12-31 and 13/1/05"), (3, "nothing")], "id long, text string")
    got = {(r.id, r.raw): r.parsed for r in extract.mentions(df, "id", "text").collect()}
    day = datetime.date
    assert got == {(1, "March 5, 2024"): day(2024, 3, 5), (1, "3/12"): day(2024, 3, 12), (2, "sept 1st"): day(1999, 9, 1), (2, "1999-12-31"): day(1999, 12, 31)}
    assert [(r.id, r.days) for r in extract.day_gaps(extract.mentions(df, "id", "text"), "id").where("id = 1").collect()] == [(1, 7)]


def test_tables(spark):
    said = "Notes\n| Day | Morning | Night |\n|:---|---|---:|\n| Mon | Ann | Bob |\n| Tue | Cy |\n| Wed |  | `Di` |\nend\n| no | table |\nx | y\n---|---\n1 | 2"
    got = {(r.label, r.header): r.cell for r in extract.table_cells(spark.createDataFrame([(1, said), (2, None)], "id long, text string"), "id", "text").collect()}
    assert got == {("Mon", "Day"): "Mon", ("Mon", "Morning"): "Ann", ("Mon", "Night"): "Bob", ("Wed", "Day"): "Wed", ("Wed", "Night"): "Di", ("1", "x"): "1", ("1", "y"): "2"}


def test_words_that_patterns_need():
    assert [extract.needed(p) for p in (r"\bmy(?: own)?\s+(?:tea|coffee)s?\s+is\b", r"([A-Z]\w+(?: [a-z]+)?)\s+bought\s+x{2,3}", r"(?:a|bc)\d", "one|other", "Colou?r", r"[\]a-z]+?by")] == ["my", "bought", "", "", "colo", "by"]
    assert sum(extract.needed(p) == "" for p, _ in extract.STATEMENTS + extract.RELATIONS) == 1


def test_facts_are_dealt_once_and_searched_where_their_words_are(spark):
    df = spark.createDataFrame([(1, "BOB BOUGHT a lamp. Ann PAINTED the sky.")], "id long, text string")
    found = extract.facts(df, "id", "text", extract.RELATIONS)
    assert [(r.entity, r.relation, r.value) for r in found.orderBy("place").collect()] == [("BOB", "bought", "lamp"), ("Ann", "painted", "sky")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


def test_documents_are_dealt_before_relations_are_looked_for(spark):
    """10,000 documents are one row group of sf0.1."""
    plan = q_extract._edges(spark, "/root/testdata/sf0.1")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc_id" in plan and ", 10" in plan[plan.index("RepartitionByExpression") :].split("\n")[0], plan


def test_entities_stop_at_the_most(spark):
    names = spark.range(1).select(extract.entities(F.array(*[F.lit(f"word{i} Name{i} word{i}") for i in range(30)])).alias("e")).first().e
    assert names == [x for i in range(16) for x in (f"Name{i}", f"word{i}", f"name{i}")][:16]
