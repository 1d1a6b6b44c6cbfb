"""Facts, truth, conflicts, graph, sinks and status queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators import facts as fx
from tidepool.operators import graph, setsim, store
from tidepool.plans.registry import query
from tidepool.plans.tables import AS_OF, CURRENT_SQL, EDGES_SQL, FACTS_SQL, as_of, edges, facts, table


@query("agg_fact_groups", f"WITH {FACTS_SQL} SELECT entity_key, relation_key, count(*) AS n_facts, count(DISTINCT value) AS n_values, max(fact_date) AS last_date FROM facts GROUP BY ALL")
def _(spark, sf):
    return fx.groups(facts(spark, sf))


@query("agg_current_facts", f"WITH {CURRENT_SQL} SELECT fact_id, entity_key, relation_key, value FROM cur WHERE is_current")
def _(spark, sf):
    return fx.with_current(facts(spark, sf)).where("is_current").select("fact_id", "entity_key", "relation_key", "value")


@query("agg_truth", f"WITH {CURRENT_SQL} SELECT entity_key, relation_key, coalesce(array_to_string(list_sort(list_distinct(list(value) FILTER (is_current))), ','), '') AS current_values, coalesce(array_to_string(list_sort(list_distinct(list(value) FILTER (NOT is_current))), ','), '') AS historical_values FROM cur GROUP BY ALL")
def _(spark, sf):
    return fx.truth(facts(spark, sf)).select("entity_key", "relation_key", F.array_join("current_values", ",").alias("current_values"), F.array_join("historical_values", ",").alias("historical_values"))


_CONFLICTS = f"WITH {CURRENT_SQL} SELECT entity_key, relation_key, count(DISTINCT trim(value)) AS n_current FROM cur WHERE is_current GROUP BY ALL HAVING count(DISTINCT trim(value)) > 1"


@query("agg_conflicts", _CONFLICTS)
def _(spark, sf):
    return fx.conflicts(facts(spark, sf))


@query("ret_wiki_lint", f"WITH {CURRENT_SQL} SELECT 'conflict' AS issue, entity_key, relation_key, count(DISTINCT trim(value)) AS n FROM cur WHERE is_current GROUP BY ALL HAVING count(DISTINCT trim(value)) > 1 UNION ALL SELECT 'low_confidence', entity_key, relation_key, count(*) FROM cur WHERE is_current AND confidence < 0.65 GROUP BY ALL")
def _(spark, sf):
    now = fx.with_current(facts(spark, sf)).where("is_current")
    low = now.where("confidence < 0.65D").groupBy(*fx.GROUP).agg(F.count("*").alias("n")).select(F.lit("low_confidence").alias("issue"), *fx.GROUP, "n")
    return fx.conflicts(facts(spark, sf)).select(F.lit("conflict").alias("issue"), *fx.GROUP, F.col("n_current").alias("n")).unionByName(low)


@query("ret_wiki_pages", f"WITH {CURRENT_SQL} SELECT regexp_replace(entity_key, '[^a-z0-9]+', '-', 'g') AS slug, count(*) AS n_claims, count(DISTINCT relation_key) AS n_relations, sum(is_current::int)::bigint AS n_current, max(fact_date) AS updated FROM cur GROUP BY entity_key")
def _(spark, sf):
    f = fx.with_current(facts(spark, sf))
    return f.groupBy("entity_key").agg(F.count("*").alias("n_claims"), F.count_distinct("relation_key").alias("n_relations"), F.sum(F.col("is_current").cast("int")).alias("n_current"), F.max("fact_date").alias("updated")).withColumn("slug", F.regexp_replace("entity_key", "[^a-z0-9]+", "-")).drop("entity_key")


@query("ret_wiki_search", f"WITH {FACTS_SQL}, e AS (SELECT entity_key AS id, 'page' AS kind, 200.0::double + count(*) AS score FROM facts WHERE contains(entity_key, '_1') GROUP BY entity_key), c AS (SELECT fact_id::varchar AS id, 'claim' AS kind, 120.0::double + confidence AS score FROM facts WHERE relation_key = 'error' AND contains(entity_key, '_1')), u AS (SELECT * FROM e UNION ALL SELECT * FROM c), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, kind, id) AS rank FROM u) SELECT id, kind, round(score, 6) AS score, rank FROM r WHERE rank <= 50")
def _(spark, sf):
    f = fx.keyed(facts(spark, sf)).where(F.contains("entity_key", F.lit("_1")))
    pages = f.groupBy(F.col("entity_key").alias("id")).agg((200.0 + F.count("*")).alias("score")).select("id", F.lit("page").alias("kind"), "score")
    claims = f.where("relation_key = 'error'").select(F.col("fact_id").cast("string").alias("id"), F.lit("claim").alias("kind"), (120.0 + F.col("confidence")).alias("score"))
    top = pages.unionByName(claims).orderBy(F.desc("score"), "kind", "id").limit(50)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "kind", "id"))).withColumn("score", F.round("score", 6))


_SCD2 = f"WITH {FACTS_SQL} SELECT fact_id, entity_key, relation_key, created_at AS valid_from, lead(created_at) OVER g AS valid_to, CASE WHEN lead(created_at) OVER g IS NULL THEN 'active' ELSE 'inactive' END AS status FROM facts WINDOW g AS (PARTITION BY entity_key, relation_key ORDER BY created_at, fact_id)"


def _scd2(spark, sf) -> DataFrame:
    return fx.intervals(fx.keyed(facts(spark, sf)), fx.GROUP, "created_at", "fact_id").select("fact_id", *fx.GROUP, "valid_from", "valid_to", "status")


query("win_scd2_edges", _SCD2)(_scd2)


@query("snk_edge_add", f"WITH {EDGES_SQL} SELECT edge_id, src, dst, CASE WHEN lead(edge_id) OVER (PARTITION BY src, relation ORDER BY created_at, edge_id) IS NULL THEN 'active' ELSE 'inactive' END AS status FROM (SELECT DISTINCT * FROM edges)")
def _(spark, sf):
    return fx.intervals(edges(spark, sf).distinct(), ["src", "relation"], "created_at", "edge_id").select("edge_id", "src", "dst", "status")


_UPSERT = f"WITH {FACTS_SQL} SELECT chunk_id, entity_key, relation_key, value, fact_date, min(fact_id) AS fact_id, max(created_at) AS created_at, max(confidence) AS confidence, count(*) AS n_writes FROM facts GROUP BY ALL"


@query("snk_fact_upsert", _UPSERT.replace("SELECT chunk_id", "SELECT chunk_id % 10 AS chunk_id"))
def _(spark, sf):
    return fx.upsert(facts(spark, sf).withColumn("chunk_id", F.col("chunk_id") % 10))


@query("gov_admission_fact", f"""WITH {FACTS_SQL}, w AS (SELECT *, first(CASE WHEN confidence >= 0.6 THEN fact_id END IGNORE NULLS) OVER (PARTITION BY entity_key, relation_key, lower(trim(value)) ORDER BY created_at, fact_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same_id,
last_value(CASE WHEN confidence >= 0.6 THEN fact_id END IGNORE NULLS) OVER (PARTITION BY entity_key, relation_key ORDER BY created_at, fact_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_id FROM facts),
a AS (SELECT fact_id, same_id, last_id, CASE WHEN confidence < 0.6 THEN 'DENY' WHEN same_id IS NOT NULL THEN 'NOOP' WHEN relation_key IN ('signup', 'error') AND last_id IS NOT NULL THEN 'SUPERSEDE' ELSE 'ALLOW' END AS action FROM w)
SELECT fact_id, action, CASE WHEN action = 'NOOP' THEN same_id WHEN action = 'SUPERSEDE' THEN last_id END AS target FROM a""")
def _(spark, sf):
    return fx.admission(facts(spark, sf), 0.6, ("signup", "error")).select("fact_id", "action", "target")


@query("snk_resolve_conflict", f"WITH {FACTS_SQL}, d AS (SELECT min(fact_id) AS loser, max(fact_id) AS winner FROM facts GROUP BY entity_key, relation_key HAVING count(*) > 1) SELECT f.fact_id, CASE WHEN f.fact_id IN (SELECT winner FROM d) THEN 'current' WHEN f.fact_id IN (SELECT loser FROM d) THEN 'historical' ELSE status END AS status FROM facts f")
def _(spark, sf):
    f = facts(spark, sf)
    decisions = fx.keyed(f).groupBy(*fx.GROUP).agg(F.min("fact_id").alias("loser_id"), F.max("fact_id").alias("winner_id"), F.count("*").alias("n")).where("n > 1").select("winner_id", "loser_id")
    return fx.resolve(f, decisions).select("fact_id", "status")


@query("agg_contradictions", f"WITH {EDGES_SQL}, g AS (SELECT src, relation, count(DISTINCT dst) AS n_dst, max(created_at) AS last_seen FROM edges GROUP BY ALL HAVING count(DISTINCT dst) > 1), n AS (SELECT *, row_number() OVER (PARTITION BY src, relation ORDER BY created_at DESC, edge_id DESC) AS nth FROM edges) SELECT src, relation, n_dst, last_seen, string_agg(edge_id, ';' ORDER BY edge_id) AS evidence FROM g JOIN n USING (src, relation) WHERE nth <= 8 GROUP BY ALL")
def _(spark, sf):
    return fx.contradictions(edges(spark, sf)).withColumn("evidence", F.array_join("evidence", ";"))


@query("jn_edge_nodes", "SELECT 'c' || c_custkey AS src, c_name AS src_name, n_name AS dst_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, sf):
    names = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("dst"), F.col("n_name").alias("dst_name"))
    people = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("src"), F.col("c_name").alias("src_name"))
    return edges(spark, sf).where("relation = 'based_in'").join(people, "src").join(names, "dst").select("src", "src_name", "dst_name")


@query("ret_graph_bfs", f"""WITH RECURSIVE {EDGES_SQL}, b AS (SELECT src, dst FROM edges WHERE relation <> 'ordered_with' UNION SELECT dst, src FROM edges WHERE relation <> 'ordered_with'),
h1 AS (SELECT DISTINCT dst AS node FROM b WHERE src = 'r1'), h2 AS (SELECT DISTINCT dst AS node FROM b JOIN h1 ON src = node),
al AS (SELECT 'r1' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) SELECT 'r1' AS seed, node, min(depth) AS depth FROM al GROUP BY node""")
def _(spark, sf):
    return graph.bfs(edges(spark, sf).where("relation <> 'ordered_with'"), spark.range(1).select(F.lit("r1").alias("seed")), 2)


@query("ret_graph_context", f"WITH {EDGES_SQL}, d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node) SELECT node, degree, 1.0::double + least(degree / 10.0::double, 1.0) AS score FROM d")
def _(spark, sf):
    return graph.context_scores(edges(spark, sf))


@query("top_current_rank", f"WITH {CURRENT_SQL}, s AS (SELECT fact_id, relation_key, round(3.0 + confidence + CASE WHEN relation_key = 'error' THEN 1.15 ELSE 0.78 END::double, 6) AS score FROM cur WHERE is_current), r AS (SELECT *, row_number() OVER (PARTITION BY relation_key ORDER BY score DESC, fact_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 5")
def _(spark, sf):
    from tidepool.operators import ranking

    score = F.round(F.lit(3.0) + F.col("confidence") + F.when(F.col("relation_key") == "error", 1.15).otherwise(0.78), 6)
    now = fx.with_current(facts(spark, sf)).where("is_current").select("fact_id", "relation_key", score.alias("score"))
    return ranking.top_k(now, ["relation_key"], 5, F.desc("score"), F.asc("fact_id"))


@query("clu_probes", f"WITH {CURRENT_SQL} SELECT fact_id, 'What is the ' || relation_key || ' of ' || entity || '?' AS probe, value AS expected FROM cur WHERE is_current")
def _(spark, sf):
    return fx.with_current(facts(spark, sf)).where("is_current").select("fact_id", F.concat(F.lit("What is the "), F.col("relation_key"), F.lit(" of "), F.col("entity"), F.lit("?")).alias("probe"), F.col("value").alias("expected"))


_ACCESS = "SELECT user_id AS id, count(*) AS access_count, max(ts) AS last_access FROM events GROUP BY user_id"


def _access(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("access_count"), F.max("ts").alias("last_access"))


query("snk_access_incr", _ACCESS)(_access)


@query("jn_left_access", "SELECT doc_id, coalesce(n, 0) AS access_count FROM documents LEFT JOIN (SELECT event_id % 2000 AS id, count(*) AS n FROM events GROUP BY 1) ON doc_id = id")
def _(spark, sf):
    hits = table(spark, sf, "events").groupBy((F.col("event_id") % 2000).alias("doc_id")).agg(F.count("*").alias("n"))
    return table(spark, sf, "documents").select("doc_id").join(hits, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("access_count"))


@query("clu_forget", f"WITH e AS (SELECT o_custkey AS id, max(o_orderdate) AS written FROM orders GROUP BY 1), a AS (SELECT user_id AS id, count(*) AS n FROM events GROUP BY 1) SELECT e.id, date_diff('day', written::date, DATE '{AS_OF[:10]}') AS days, coalesce(n, 0) AS access_count FROM e LEFT JOIN a ON a.id = e.id WHERE date_diff('day', written::date, DATE '{AS_OF[:10]}') > 120 AND coalesce(n, 0) <= 0")
def _(spark, sf):
    """Customers as entries, written when they last ordered and read by the events of their number: those that are old and were never read."""
    written = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("written"))
    reads = table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("access_count"))
    return store.stale(written, reads, "id", as_of())


@query("agg_counts", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'conversations', count(*) FROM conversations")
def _(spark, sf):
    one = lambda name: table(spark, sf, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return one("documents").union(one("embeddings")).union(one("events")).union(one("conversations"))


@query("agg_status", "SELECT (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(DISTINCT conv_id) FROM conversations) AS sessions, (SELECT count(*) FROM events) AS facts")
def _(spark, sf):
    for name in ("documents", "embeddings", "conversations", "events"):
        table(spark, sf, name).createOrReplaceTempView(f"status_{name}")
    return spark.sql("SELECT (SELECT count(*) FROM status_documents) AS chunks, (SELECT count(*) FROM status_embeddings) AS vectors, (SELECT count(DISTINCT conv_id) FROM status_conversations) AS sessions, (SELECT count(*) FROM status_events) AS facts")


_CONSISTENCY = "SELECT doc_id AS id, 'no_vector' AS issue FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'no_chunk' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT vec_id, 'dimension' FROM embeddings WHERE len(embedding) <> 64"


def _consistency(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.size("embedding").alias("d"))
    none = d.join(e, "id", "left_anti").withColumn("issue", F.lit("no_vector"))
    return none.union(e.select("id").join(d, "id", "left_anti").withColumn("issue", F.lit("no_chunk"))).union(e.where("d <> 64").select("id", F.lit("dimension").alias("issue")))


query("jn_consistency", _CONSISTENCY)(_consistency)
query("set_except_stores", _CONSISTENCY)(_consistency)


@query("jn_cache_miss", "SELECT d.doc_id, l.doc_id IS NOT NULL AS hit FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, sf):
    cached = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("hit"))
    return table(spark, sf, "documents").select("doc_id").join(cached, "doc_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


@query("jn_mention_entity", f"WITH {FACTS_SQL} SELECT chunk_id, string_agg(DISTINCT entity_key, ',' ORDER BY entity_key) AS entities FROM facts WHERE chunk_id IN (SELECT doc_id FROM documents WHERE lang = 'fr') GROUP BY chunk_id")
def _(spark, sf):
    wanted = table(spark, sf, "documents").where("lang = 'fr'").select(F.col("doc_id").alias("chunk_id"))
    return fx.keyed(facts(spark, sf)).join(wanted, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_set("entity_key")), ",").alias("entities"))


@query("jn_explain_prov", f"WITH {FACTS_SQL} SELECT fact_id, chunk_id, source FROM facts LEFT JOIN documents ON doc_id = chunk_id WHERE relation_key = 'error'")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "source")
    return facts(spark, sf).where("relation = 'error'").join(d, "chunk_id", "left").select("fact_id", "chunk_id", "source")


@query("jn_pair_entities", f"WITH {FACTS_SQL}, m AS (SELECT DISTINCT chunk_id, entity_key FROM facts) SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS shared FROM m a JOIN m b ON a.entity_key = b.entity_key AND a.chunk_id < b.chunk_id GROUP BY ALL HAVING count(*) >= 2")
def _(spark, sf):
    m = fx.keyed(facts(spark, sf)).groupBy("chunk_id").agg(F.collect_set("entity_key").alias("entities"))
    pairs = setsim.overlapping(m, "chunk_id", F.col("entities"), 2).expanded(F.col("n") >= 2)
    return pairs.select("a", "b", F.col("common").cast("long").alias("shared"))


@query("src_list_chunks", "SELECT doc_id, source FROM documents WHERE source = 'src3' ORDER BY doc_id DESC LIMIT 20")
def _(spark, sf):
    return table(spark, sf, "documents").where("source = 'src3'").orderBy(F.desc("doc_id")).limit(20).select("doc_id", "source")


@query("src_point_get", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = 42")
def _(spark, sf):
    return table(spark, sf, "documents").where("doc_id = 42").select("doc_id", "lang", "n_chars")


@query("src_list_sessions", "SELECT conv_id, count(*) AS n_chunks, min(role) AS first_role FROM conversations GROUP BY conv_id")
def _(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_chunks"), F.min("role").alias("first_role"))


@query("prd_entity_like", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '99') ORDER BY length(c_name), c_custkey LIMIT 20")
def _(spark, sf):
    return table(spark, sf, "customer").where(F.contains(F.lower("c_name"), F.lit("99"))).orderBy(F.length("c_name"), "c_custkey").limit(20).select("c_custkey", "c_name")


@query("prd_role_filter", "SELECT role, count(*) AS n, role IN ('user', 'assistant') AS kept FROM conversations GROUP BY role")
def _(spark, sf):
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n")).withColumn("kept", F.col("role").isin("user", "assistant"))


@query("prd_min_score_roles", "WITH r AS (SELECT conv_id, turn, role, length(text) / 1000.0::double AS score FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS rank FROM r WHERE role IN ('user', 'assistant') AND score >= 0.2) SELECT conv_id, turn, role, rank FROM k WHERE rank <= 3")
def _(spark, sf):
    from tidepool.operators import ranking

    rows = table(spark, sf, "conversations").withColumn("score", F.length("text") / 1000.0).where(F.col("role").isin("user", "assistant") & (F.col("score") >= 0.2))
    return ranking.top_k(rows, ["conv_id"], 3, F.desc("score"), F.asc("turn")).select("conv_id", "turn", "role", "rank")


@query("prd_session_filter", "SELECT conv_id, turn FROM conversations WHERE contains(conv_id::varchar, '7')")
def _(spark, sf):
    return table(spark, sf, "conversations").where(F.contains(F.col("conv_id").cast("string"), F.lit("7"))).select("conv_id", "turn")


@query("win_latest_cos", "SELECT conv_id, arg_max(md5(text), turn) AS latest FROM conversations GROUP BY conv_id")
def _(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.max_by(F.md5("text"), "turn").alias("latest"))


@query("ctx_objective", "SELECT conv_id, arg_max(md5(text), turn) AS objective FROM conversations WHERE role = 'user' GROUP BY conv_id")
def _(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.max_by(F.md5("text"), "turn").alias("objective"))


@query("ctx_active_query", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS nth FROM conversations WHERE role IN ('user', 'assistant')) SELECT conv_id, md5(string_agg(role || ': ' || substr(text, 1, 120), chr(10) ORDER BY turn)) AS text_md5, count(*) AS n FROM r WHERE nth <= CASE WHEN role = 'user' THEN 3 ELSE 2 END GROUP BY conv_id")
def _(spark, sf):
    w = Window.partitionBy("conv_id", "role").orderBy(F.desc("turn"))
    recent = table(spark, sf, "conversations").where(F.col("role").isin("user", "assistant")).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= F.when(F.col("role") == "user", 3).otherwise(2))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x.role, F.lit(": "), F.substring(x.text, 1, 120)))
    return recent.groupBy("conv_id").agg(F.md5(F.array_join(parts, "\n")).alias("text_md5"), F.count("*").alias("n"))


@query("agg_session_lessons", "SELECT conv_id, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, count(*) FILTER (role = 'system') AS n_system FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') >= 1 AND count(*) >= 3")
def _(spark, sf):
    n = lambda r: F.count_if(F.col("role") == r).alias(f"n_{r}")
    return table(spark, sf, "conversations").groupBy("conv_id").agg(n("user"), n("assistant"), n("system"), F.count("*").alias("n")).where("n_user >= 1 and n >= 3").drop("n")


@query("agg_fix_promotion", "SELECT event_type AS project, floor(value / 50)::bigint AS signature, count(*) AS occurrences, count(DISTINCT user_id) AS sessions FROM events WHERE event_type IN ('error', 'purchase') GROUP BY ALL HAVING count(*) >= 2 OR count(DISTINCT user_id) >= 2")
def _(spark, sf):
    e = table(spark, sf, "events").where(F.col("event_type").isin("error", "purchase"))
    return e.groupBy(F.col("event_type").alias("project"), F.floor(F.col("value") / 50).alias("signature")).agg(F.count("*").alias("occurrences"), F.count_distinct("user_id").alias("sessions")).where("occurrences >= 2 or sessions >= 2")


@query("snk_purge_rules", "SELECT CASE WHEN text ILIKE '%licensed under%' THEN 'license' WHEN length(text) < 200 THEN 'short' WHEN text LIKE '%###%' THEN 'noise' ELSE 'kept' END AS rule, count(*) AS n FROM documents GROUP BY 1")
def _(spark, sf):
    rule = F.when(F.col("text").ilike("%licensed under%"), "license").when(F.length("text") < 200, "short").when(F.col("text").like("%###%"), "noise").otherwise("kept")
    return table(spark, sf, "documents").groupBy(rule.alias("rule")).agg(F.count("*").alias("n"))


@query("snk_chunk_delete", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def _(spark, sf):
    gone = table(spark, sf, "labels").where("quality = 0").select("doc_id")
    return table(spark, sf, "documents").select("doc_id").join(gone, "doc_id", "left_anti")
