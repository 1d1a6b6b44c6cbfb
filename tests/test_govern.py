"""Agents, clusters, chains, merges, benchmarks and polls on small tables."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import agents, cluster, integrity, search, store
from tidepool.plans.q_codecs import numbered
from tidepool.plans.q_govern import followed, negative
from tidepool.sources import benchmarks, sessions, watch


@pytest.mark.parametrize("block", [4096, 7])
def test_links_connect_what_is_near(spark, block):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist(), i % 2) for i, x in enumerate(v)], "id long, v array<double>, g int")
    links = [(r.a, r.b) for r in cluster.links(df, "id", "v", 0.9, F.col("g"), block).collect()]
    assert all(v[a] @ v[b] >= 0.9 and a % 2 == b % 2 for a, b in links)

    def classes(pairs):
        root = list(range(60))
        for a, b in pairs:
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
        return root

    every = [(a, b) for a, b in itertools.combinations(range(60), 2) if a % 2 == b % 2 and v[a] @ v[b] >= 0.9]
    assert classes(links) == classes(every) and len(links) <= 60 * 9
    got = {r.id: r.cluster for r in cluster.clusters(df, "id", "v", 0.9, F.col("g")).collect()}
    assert [got[i] for i in range(60)] == classes(every)


def test_pointers_are_followed_to_their_end(spark):
    rows = [(i, i + 1 if i < 99 else None) for i in range(100)] + [(200, None)]
    got = {r.id: (r.last, r.depth) for r in followed(spark.createDataFrame(rows, "id long, next long")).collect()}
    assert got == {i: (99, 99 - i) for i in range(100)} | {200: (200, 0)}
    with pytest.raises(RuntimeError, match="circle"):
        followed(spark.createDataFrame([(1, 2), (2, 1)], "id long, next long"))


def test_components_say_when_they_are_not_done(spark):
    from tidepool.operators.components import connected_components

    chain = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    assert {r.root for r in connected_components(chain).collect()} == {0}
    with pytest.raises(RuntimeError, match="not complete"):
        connected_components(chain, rounds=2)


def test_numbers_in_order_of_first_places(spark):
    rows = [(f"v{i * 7 % 50}", i) for i in range(300)]
    want = {v: n for n, v in enumerate(dict.fromkeys(v for v, _ in rows))}
    assert {r.v: r.id for r in numbered(spark.createDataFrame(rows, "v string, at long").repartition(5), "v", "at").collect()} == want


def test_tables_by_version(spark, tmp_path):
    t = store.Versions(spark, str(tmp_path / "t"), keep=2)
    assert t.read() is None
    one = lambda *rows: spark.createDataFrame(rows, "k long, name string, tags map<string,string>, ids array<long>")
    merge = lambda df: t.merge(df, ["k"], tags=store.new_wins(F.col("tags")), ids=store.ordered_union(F.col("ids"), F.col("newer")))
    merge(one((1, "a", {"x": "1", "y": "1"}, [1, 2]), (2, "b", {}, [])))
    merge(one((1, "A", {"y": "2"}, [2, 3])))
    got = {r.k: r for r in merge(one((3, "c", {"z": "1"}, [9]))).collect()}
    assert (got[1].name, got[1].tags, got[1].ids) == ("A", {"x": "1", "y": "2"}, [1, 2, 3]) and got[2].name == "b" and len(got) == 3
    assert t.numbers() == [2, 3]
    (tmp_path / "t" / "v000009").mkdir()  # a write that did not end
    assert t.numbers() == [2, 3] and t.read().count() == 3


def test_polls_take_what_is_new_or_changed(spark, tmp_path):
    folder, state, taken = tmp_path / "in", store.Versions(spark, str(tmp_path / "state")), []
    (folder / "deep").mkdir(parents=True)
    (folder / "a.jsonl").write_text("{}\n")
    (folder / "deep" / "b.jsonl").write_text("{}\n")
    (folder / "c.txt").write_text("no")
    (folder / "empty.jsonl").write_text("")
    poll = lambda: {(r.path.rsplit("/", 1)[1], r.status) for r in watch.poll(spark, str(folder), state, taken.append).collect()}
    assert poll() == {("a.jsonl", "new"), ("b.jsonl", "new")} and poll() == set()
    (folder / "a.jsonl").write_text('{"more": 1}\n')

    def fails(paths):
        raise OSError("disk")

    with pytest.raises(OSError, match="disk"):
        watch.poll(spark, str(folder), state, fails)
    assert poll() == {("a.jsonl", "changed")} and len(taken) == 2


def test_transcripts_by_their_first_line(spark, tmp_path):
    long = "words that are long enough to count"
    (tmp_path / "n.jsonl").write_text('{"type":"session","session_id":"s1"}\nnot json\n{"type":"message","message":{"role":"assistant","content":[{"type":"text","text":"%s"},{"type":"toolCall","name":"t","arguments":"{\\"b\\":2,\\"a\\":\\"x\\"}"}]}}\n{"type":"message","message":{"role":"user","content":"short"}}\n{"type":"user","message":{"content":"%s"}}\n' % (long, long))
    (tmp_path / "e.jsonl").write_text('{"type":"user","message":{"content":[{"type":"tool_result","content":"%s"},{"type":"image"}]}}\n{"type":"message","message":{"role":"user","content":"%s"}}\n' % (long, long))
    (tmp_path / "g.jsonl").write_text('{"kind":"other","summary":"%s"}\n{"text":"x"}\n' % long)
    got = [(r.session_id, r["index"], r.role, r.content) for r in sessions.transcripts(spark, str(tmp_path)).orderBy("session_id", "index").collect()]
    assert got == [("e", 0, "user", long), ("g", 0, "unknown", long), ("s1", 0, "assistant", long), ("s1", 1, "tool_call", "Tool: t\n  a: x\n  b: 2")]


def test_benchmarks(spark):
    turns = "array<array<struct<role:string,content:string>>>"
    rows = spark.createDataFrame([(0, "q", " Why? ", " since ", ["s1", "gone"], ["s1", "s2"], [[("user", " a "), ("user", " ")], [(None, "b")]]), (1, "r", "No answer?", "x", ["gone"], [], [])], f"row int, question_id string, question string, answer string, answer_session_ids array<string>, haystack_session_ids array<string>, haystack_sessions {turns}")
    t = benchmarks.long_sessions(rows)
    assert sorted(r.source_id for r in t.corpus.collect()) == ["lme:q:s1:turn:0000", "lme:q:s2:turn:0000"]
    assert [tuple(r) for r in t.answers.collect()] == [("__LME_CASE_0000__ Why?", ["lme_q_s1"], ["since"])] and t.evals.count() == 1
    rows = spark.createDataFrame([(3, "q", "Which?", "Blue", ["s1", "s2", "s3"], ["", "not here", ""], [[("user", "a BLUE one")], [("user", "blue")], []]), (4, "n", "?", "Not answerable", ["s1"], ["not answerable"], [[]])], f"row int, question_id string, question string, answer string, haystack_session_ids array<string>, haystack_session_summaries array<string>, haystack_sessions {turns}")
    t = benchmarks.choices(rows)
    assert {r.doc_id: r.text.split("\n")[1] for r in t.corpus.collect()} == {"locomo_q_s1": "user: a BLUE one", "locomo_q_s2": "not here", "locomo_n_s1": "not answerable"}
    assert [tuple(r) for r in t.evals.collect()] == [("__LOCOMO_CASE_0003__ Which?", ["locomo_q_s1", "locomo_q_s2"])]
    rows = spark.createDataFrame([(7, "Who?", ["Ann ", ""], [("1", "T", "x", False, True), ("2", None, None, None, None)])], "row int, question string, answers array<string>, ctxs array<struct<id:string,title:string,text:string,hasanswer:boolean,isgold:boolean>>")
    t = benchmarks.open_domain(rows)
    assert [tuple(r) for r in t.answers.collect()] == [("__DMR_CASE_00007__ Who?", ["dmr_00007_00"], ["Ann"])] and t.corpus.count() == 2


def test_carry_over(spark):
    steps = [(["a", "b"], [], ["q1"]), (["b", "c"], ["q1"], ["q2"]), ([f"f{i}" for i in range(39)], [], ["q2", "q3"])]
    df = spark.createDataFrame([(steps,)], "s array<struct<facts:array<string>,resolved:array<string>,asked:array<string>>>")
    got = df.select(agents.folded(F.col("s")).alias("c")).first().c
    assert got.facts == ["c", *[f"f{i}" for i in range(39)]] and got.questions == ["q2", "q3"]
    text = df.select(agents.rendered(F.lit(2), F.lit("Sum"), F.array(F.lit("a")), F.array().cast("array<string>")).alias("t")).first().t
    assert text == "## Carry-Over Summary (step 2)\n\nSum\n\n### Key Facts\n- a"


def test_a_fact_that_went_does_not_come_back(spark):
    """The SQL of cos_merge and cos_render counts a fact where it is first said."""
    steps = [(["a"], [], ["q"]), ([f"f{i}" for i in range(40)], [], []), (["a", "z"], [], [])]
    df = spark.createDataFrame([(steps,)], "s array<struct<facts:array<string>,resolved:array<string>,asked:array<string>>>")
    got = df.select(agents.once_folded(F.col("s")).alias("c")).first().c
    assert got.facts == [*[f"f{i}" for i in range(1, 40)], "z"] and got.questions == ["q"]


def test_a_fitted_scorer_leaves_no_model_in_the_plan(spark):
    from tidepool.plans import q_govern

    rows = spark.range(600).selectExpr("id", "cast(id % 3 as double) AS label", "cast(id % 3 as double) AS x", "IF(id % 50 = 0, null, cast(id % 7 as double)) AS y", "1.0D AS w", "5.0D AS still")
    got = q_govern._fitted(rows, ["x", "y", "still"], "id", "multinomial", "w")
    assert got.where("label = prediction").count() == 600 and "UDF" not in got._jdf.queryExecution().toString()
    two = q_govern._fitted(rows.where("label < 2"), ["x", "y"], "id", "binomial")
    assert two.where("label = prediction").count() == 400 and {r.prediction for r in two.select("prediction").distinct().collect()} == {0.0, 1.0}


def test_engine(spark):
    chunks = spark.createDataFrame([(1, "green tea in the morning"), (2, "black coffee")], "chunk_id long, content string")
    e = agents.Engine(spark, chunks, most_steps=2)
    s = e.run("tea", [agents.Step("green tea", "x" * 300, facts=["f", "f"], resolved=["tea"], asked=["why?"], title="t", content="c", evidence=["e"]), agents.Step("coffee", "done", title="", content="c" * 100_001)])
    assert s.found == [1, 1] and s.facts == ["f"] and s.questions == ["why?"] and len(s.summaries[1]) == len("Step 0: ") + 200
    assert s.written == [("t", "c")] and s.refused == [("", "no title; too large; no evidence")]
    with pytest.raises(RuntimeError, match="2 steps"):
        e.step(s, agents.Step("more", "x"))


def test_hooks_fall_back(spark):
    df = spark.createDataFrame([(1, "Bob bought a lamp."), (2, "Ann bought a hat."), (3, None)], "id long, text string")
    plain = {tuple(r) for r in agents.facts_by(df, "id", "text").collect()}
    assert plain == {(1, "Bob", "bought", "lamp", "patterns"), (2, "Ann", "bought", "hat", "patterns")}

    def hook(texts):
        return ['{"facts": [{"entity": "B", "relation": "r", "value": "v"}]}' if "Bob" in t else "sorry {" for t in texts]

    assert {tuple(r) for r in agents.facts_by(df, "id", "text", hook).collect()} == {(1, "B", "r", "v", "hook"), (2, "Ann", "bought", "hat", "patterns")}
    assert agents.lenient('x {"a": {"b": 1}} y') == {"a": {"b": 1}} and agents.lenient("{ {") is None and agents.lenient("[1]") is None


def test_chains(spark):
    rows = spark.createDataFrame([(u, i, f"h{u}{i}") for u in (1, 2) for i in range(10)], "u long, n long, h string")
    packed = integrity.packets(rows, "u", "n", "h", 3)
    chain = spark.createDataFrame(integrity.links(packed, "u", "i", "digest").collect(), "u long, i long, link string")
    assert all(r.intact for r in integrity.verified(chain, packed, "u", "i", "digest").collect())
    changed = integrity.packets(rows.withColumn("h", F.when((F.col("u") == 1) & (F.col("n") == 4), "x").otherwise(F.col("h"))), "u", "n", "h", 3)
    assert [(r.u, r.i) for r in integrity.verified(chain, changed, "u", "i", "digest").where("not intact").collect()] == [(1, 1)]
    assert [(r.u, r.i) for r in integrity.verified(chain, changed.where("u = 2 or i <> 3"), "u", "i", "digest").where("not intact").orderBy("i").collect()] == [(1, 1), (1, 3)]


def test_polarity(spark):
    df = spark.createDataFrame([("I can't, really",), ("Never!",), ("nothing nowhere",), (None,)], "t string")
    assert [r.n for r in df.select(negative(F.col("t")).alias("n")).collect()] == [True, True, False, False]


def test_fulltext(spark):
    docs = spark.createDataFrame([(1, "She prefers green teas in the morning"), (2, "the preference of many sessions"), (3, "green paint"), (4, "")], "id long, text string")
    post = search.postings(docs, "id", "text")
    asks = spark.createDataFrame([(1, "green tea"), (2, "green; paint!!"), (3, "did they prefer session notes"), (4, "?!"), (5, "green harbour")], "query_id long, query string")
    got: dict = {}
    for r in search.fulltext(post, asks, "id").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {1: [1], 2: [3], 3: [2, 1]}


def test_written_folders_are_swept(spark, tmp_path):
    import os

    from tidepool.session import sweep

    path = store.scratch(spark, "gone")
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path.removeprefix("file://"))
    sweep(spark)
    assert not os.path.exists(path.removeprefix("file://")) and sweep(spark) == 0
