from pyspark.sql import functions as F

from tidepool.api import Memory


def test_ingest_recall_augment(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"))
    m.ingest(spark.createDataFrame([("d1", "the quick brown fox likes green tea"), ("d2", "rain in the old harbour")], "doc_id string, text string"))
    q = spark.createDataFrame([(1, "green tea"), (2, "harbour rain")], "query_id int, query string")
    assert {r.query_id: r.chunk_id for r in m.recall(q, 1).collect()} == {1: "d1#0", 2: "d2#0"}
    assert m.augment(q).where("query_id = 1").first().context.startswith('<memories><memory id="d1#0">')
    assert m.status().first().chunks == 2


def test_facts_and_graph(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"))
    rows = [(1, "c", "Ann", "lives_in", "Rome", "2024-01-01", 0.9, "", 1), (2, "c", "ann", "lives_in", "Oslo", "2024-02-01", 0.9, "", 2)]
    m.add_facts(spark.createDataFrame(rows, "fact_id int, chunk_id string, entity string, relation string, value string, fact_date string, confidence double, status string, created_at int"))
    assert [r.value for r in m.current().collect()] == ["Oslo"]
    assert m.truth().first().historical_values == ["Rome"]
    assert m.conflicts().count() == 0
    m.add_edges(spark.createDataFrame([(1, "a", "b", 1), (2, "b", "c", 2)], "edge_id int, src string, dst string, created_at int"))
    assert m.graph_query(spark.range(1).select(F.lit("a").alias("seed")), 2).count() == 3


def test_facts_are_merged_and_learned(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"))
    schema = "fact_id int, chunk_id string, entity string, relation string, value string, fact_date string, confidence double, status string, created_at int"
    for confidence in (0.6, 0.9, 0.7):
        m.add_facts(spark.createDataFrame([(int(confidence * 10), "c", "Ann", "Lives_in ", "Rome", "", confidence, "", 1)], schema))
    (only,) = m.truth().collect()
    assert only.current_values == ["Rome"] and [(r.fact_id, r.confidence) for r in m.current().collect()] == [(6, 0.9)]
    n = Memory(spark, str(tmp_path / "n"))
    n.ingest(spark.createDataFrame([("d", "Caroline moved from Sweden to Denver. Bob bought a lamp.")], "doc_id string, text string"))
    n.learn()
    n.learn()
    assert {(r.entity, r.relation, r.value) for r in n.current().collect()} == {("Caroline", "moved_from", "Sweden"), ("Caroline", "location", "Denver"), ("Bob", "bought", "lamp")}


def test_recall_with_vectors(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"))
    m.ingest(spark.createDataFrame([("a", "green tea"), ("b", "black coffee"), ("c", "red wine")], "doc_id string, text string"))
    m.add_vectors(spark.createDataFrame([("a#0", [1.0, 0.0]), ("b#0", [0.0, 1.0]), ("c#0", [0.1, 0.9])], "chunk_id string, embedding array<double>"))
    q = spark.createDataFrame([(1, "green", [0.0, 1.0]), (2, "wine", None)], "query_id int, query string, embedding array<double>")
    got: dict = {}
    for r in m.recall(q, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert set(got[1]) == {"a#0", "b#0", "c#0"} and got[2] == ["c#0"]
