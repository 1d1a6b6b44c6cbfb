"""Operators on small literal tables, with the values that users of the earlier system rely on."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidepool.functions import chunks
from tidepool.operators import cql, events, facts, graph, lsh, questions, ranking, search, text
from tidepool.operators.components import connected_components
from tidepool.sources import sessions

ROWS = [
    (1, "User alice logged in from 10.0.0.1", "User <*> logged in from <*>", ["alice", "10.0.0.1"]),
    (2, "User bob logged in from 10.0.0.2", "User <*> logged in from <*>", ["bob", "10.0.0.2"]),
    (3, "Error: connection timeout for server-1", "Error: connection timeout for <*>", ["server-1"]),
    (4, "Metric: cpu_usage=95.2 host=web-01", "Metric: cpu_usage=<*> host=<*>", ["95.2", "web-01"]),
    (5, "Metric: cpu_usage=72.5 host=web-02", "Metric: cpu_usage=<*> host=<*>", ["72.5", "web-02"]),
    (6, "Error: disk full on server-2", "Error: disk full on <*>", ["server-2"]),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "line_no long, text string, template string, slots array<string>")


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("SELECT count()", 6.0),
        ("SELECT avg(slot[0]) WHERE text LIKE '%cpu%'", 83.85),
        ("SELECT min(slot[0]) WHERE text LIKE '%cpu%'", 72.5),
        ("SELECT max(slot[0]) WHERE text LIKE '%cpu%'", 95.2),
        ("SELECT avg(slot[0]) WHERE text LIKE '%logged%'", None),
        ("SELECT count() LIMIT 3", 3.0),
    ],
)
def test_cql_values(rows, query, want):
    assert cql.execute(rows, query).first()[0] == (pytest.approx(want) if want is not None else None)


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("SELECT lines WHERE slot[0] > 80", [4]),
        ("SELECT lines WHERE slot[0] = 'alice' OR slot[0] = 'bob'", [1, 2]),
        ("SELECT lines WHERE text NOT LIKE '%error%' AND template LIKE 'metric%'", [4, 5]),
        ("SELECT lines WHERE NOT slot[0] = 'alice'", [1]),
        ("SELECT lines WHERE text LIKE '%nothing%'", []),
        ("SELECT lines WHERE slot[9] = ''", [1, 2, 3, 4, 5, 6]),
    ],
)
def test_cql_lines(rows, query, want):
    assert sorted(r.line_no for r in cql.execute(rows, query).collect()) == want


@pytest.mark.parametrize("query", ["lines", "SELECT", "SELECT sum(x)", "SELECT lines WHERE", "SELECT lines LIMIT x", "SELECT lines ; drop"])
def test_cql_errors(query):
    with pytest.raises(cql.CqlError):
        cql.parse(query)


def test_match_expression(spark):
    ask = lambda q: spark.range(1).select(search.match_expression(F.lit(q))).first()[0]
    assert ask("alpha beta") == "alpha beta"
    assert ask("what does Melanie prefer in sessions") == "what* OR does* OR melanie* OR prefer* OR in OR sessions*"
    assert ask("!!") == '""'
    assert ask("Tea tea TEA") == "tea"


def test_fusion_boost(spark):
    a = spark.createDataFrame([(1, i, 100.0 - i) for i in range(40)] + [(1, 99, 0.5)], "q int, id int, score double")
    b = spark.createDataFrame([(1, 100 + i, 100.0 - i) for i in range(40)] + [(1, 99, 0.5)], "q int, id int, score double")
    first = lambda boost: ranking.top_k(ranking.fuse({"a": (a, 0.5), "b": (b, 0.5)}, "q", "id", 30, boost), ["q"], 1, F.desc("score"), F.asc("id")).first().id
    assert first(1.0) != 99
    assert first(2.0) == 99


def test_decay_and_access(spark):
    df = spark.createDataFrame([("old", 1.0, 24), ("fresh", 0.8, 0)], "id string, score double, hours int")
    at = F.to_timestamp(F.lit("2024-01-02 00:00:00"))
    made = F.timestamp_add("HOUR", -F.col("hours"), at)
    order = lambda hits: [r.id for r in df.withColumn("s", F.col("score") * ranking.decay(made, at, 1.0, 0.5) * ranking.access_boost(F.when(F.col("id") == "old", hits).otherwise(0), 0.05 * 10, 2.0)).orderBy(F.desc("s")).collect()]
    assert order(0) == ["fresh", "old"]
    assert order(10) == ["old", "fresh"]


def test_anomalies(spark):
    def alerts(values):
        df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, i int, v double")
        return [r.alert for r in events.anomalies(df, ["k"], "v", F.asc("i")).orderBy("i").collect()]

    assert alerts([20.0] * 25 + [1.0])[-1] == "low"
    assert alerts([5.0] * 25 + [500.0])[-1] == "high"
    assert set(alerts([7.0] * 30)) == {None}
    assert set(alerts([1.0, 99.0])) == {None}


def test_motifs(spark):
    df = spark.createDataFrame([(1, i, e) for i, e in enumerate(["search", "read", "think"] * 5)], "k int, i int, e string")
    found = {r.pattern: r.occurrences for r in events.motifs(df, ["k"], "e", F.asc("i")).collect()}
    assert found["search>read>think"] == 5
    assert found["read>think>search"] == 4


def test_plans(spark):
    ask = lambda q: spark.range(1).select(questions.plan(F.lit(q)).alias("p")).select("p.*").first()
    p = ask("What drink does the user currently prefer?")
    assert (p.route, p.answer_type) == ("current_state", "preference")
    assert ask("In the schedule table, which shift is mine?").route == "table_lookup"
    assert ask("How many days passed between June 1 and June 9?").route == "temporal_math"
    assert "cross_session" in ask("What was mentioned before in our previous chat?").intents


def test_normal_form_and_match(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.normalised(F.lit("The Quick, Brown Fox!"))) == "quick brown fox"
    assert one(text.normalised(F.lit("Seven cafés"))) == "7 cafes"
    assert one(questions.exact_match(F.lit("2"), F.lit("two"))) == 1.0
    assert one(questions.exact_match(F.lit(""), F.lit("x"))) == 0.0
    kind = lambda pred, cand, final: one(questions.failure_kind(F.lit(pred), F.lit("blue"), F.array(F.lit("e")), F.array(F.lit(cand)), F.array(F.lit(final)), F.lit("supported")))
    assert [kind("blue", "e", "e"), kind("red", "x", "x"), kind("red", "e", "x"), kind("red", "e", "e")] == ["success", "retrieval_miss", "rerank_miss", "evidence_present_answer_wrong"]


def test_admission(spark):
    rows = [(1, "chunk-a", "Desmond", "prefers", "coffee", "", 0.9, "", 1), (2, "chunk-a", "Desmond", "prefers", "coffee", "", 0.9, "", 2), (3, "c", "Desmond", "prefers", "tea", "", 0.9, "", 3), (4, "c", "Desmond", "knows", "Ann", "", 0.2, "", 4)]
    df = spark.createDataFrame(rows, "fact_id int, chunk_id string, entity string, relation string, value string, fact_date string, confidence double, status string, created_at int")
    got = {r.fact_id: (r.action, r.target) for r in facts.admission(df).collect()}
    assert got == {1: ("ALLOW", None), 2: ("NOOP", 1), 3: ("SUPERSEDE", 2), 4: ("DENY", None)}


def test_bfs(spark):
    e = spark.createDataFrame([(i, f"n{i}", f"n{i + 1}", i) for i in range(5)], "edge_id int, src string, dst string, created_at int")
    found = {r.node: r.depth for r in graph.bfs(e, spark.createDataFrame([("n2",)], "seed string"), 2).collect()}
    assert found == {"n2": 0, "n1": 1, "n3": 1, "n0": 2, "n4": 2}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(100, 101), (101, 100)]])
def test_components(spark, edges):
    got = {r.v: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    group: dict[int, set[int]] = {}
    for a, b in edges:
        if a != b:
            joined = group.get(a, {a}) | group.get(b, {b})
            group.update(dict.fromkeys(joined, joined))
    assert got == {v: min(g) for v, g in group.items()}


def test_greedy_and_codes(spark):
    hits = spark.createDataFrame([(1, 1, 1, ["a", "b", "c"]), (1, 2, 2, ["a", "b", "c"]), (1, 3, 3, ["x"])], "q int, id int, rank int, terms array<string>")
    assert sorted(r.id for r in lsh.greedy_distinct(hits, "q", "terms").collect()) == [1, 3]
    seq = spark.createDataFrame([(1, i, e) for i, e in enumerate("abcabcx")], "k long, i int, e string")
    patterns = [("a", "b"), ("a", "b", "c")]
    coded = lsh.motif_encoded(seq, "k", "e", ["i"], patterns)
    assert coded.first().tokens == ["M0", "M0", "x"]
    assert lsh.motif_decoded(coded, "k", patterns).first().events == list("abcabcx")


@given(st.text(alphabet="ab. \n", max_size=900), st.integers(40, 120))
@settings(max_examples=60, deadline=None)
def test_windows_cover(value, size):
    parts = chunks.windows(value, size, size // 10)
    assert len(value) <= size or all(0 < len(p) <= size for p in parts)
    joined = "".join(parts)
    assert {c for c in value if not c.isspace()} == {c for c in joined if not c.isspace()} or len(value) <= size


@given(st.binary(max_size=60_000))
@settings(max_examples=30, deadline=None)
def test_boundaries_match_a_rolling_scan(data):
    data = data * 20
    ends, start, fp = [], 0, 0
    for i, byte in enumerate(data):
        fp = ((fp << 1) ^ byte) & (1 << 64) - 1
        if i - start + 1 >= 1024 and (i - start + 1 >= 16_384 or fp & 4095 == 0):
            ends.append(i + 1)
            start, fp = i + 1, 0
    assert chunks.boundaries(data) == ends + [len(data)] * (start < len(data))


def test_transcripts(spark, tmp_path):
    lines = [
        '{"type":"session","session_id":"s1"}',
        '{"type":"message","message":{"role":"user","content":"please look at the failing build"}}',
        "not json",
        '{"type":"message","message":{"role":"assistant","content":[{"type":"text","text":"looking at the failing build now"},{"type":"toolCall","name":"run","arguments":{"cmd":"make"}}]}}',
        '{"type":"message","message":{"role":"toolResult","content":"short"}}',
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text('{"text":"a plain note of more than twenty characters"}\n')
    got = sessions.transcripts(spark, str(tmp_path)).orderBy("session_id", "index").collect()
    assert [(r.session_id, r["index"], r.role) for r in got] == [("b", 0, "unknown"), ("s1", 0, "user"), ("s1", 1, "assistant"), ("s1", 2, "tool_call")]


def test_spans_and_templates(spark, tmp_path):
    line = spark.range(1).select(sessions.span_line(F.lit("call"), F.lit("t1"), F.lit("s1"), F.lit("ok"), F.create_map(F.lit("k"), F.lit("v"))).alias("line"))
    p = line.select(sessions.parse_span(F.col("line")).alias("p")).select("p.*").first()
    assert (p.name, p.fields) == ("call", {"trace": "t1", "span": "s1", "status": "ok", "k": "v"})
    (tmp_path / "t.csv").write_text("EventId,EventTemplate\nE1,a <*> b <*>\nE2,a long text <*>\n")
    assert [r.EventId for r in sessions.template_bank(spark, str(tmp_path / "t.csv")).orderBy("specificity").collect()] == ["E2", "E1"]


def test_plan_of_search_has_no_python(spark):
    from tidepool.plans import registry

    plan = registry.queries()["ret_hybrid"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
