"""Question analysis, verification, policy and clustering queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool.operators import agents, ranking
from tidepool.operators import questions as qs
from tidepool.plans.registry import query
from tidepool.plans.tables import dealt, normalised_sql, table

#: Forms of questions, of every kind.
QUESTIONS = ["What drink does user currently prefer?", "In schedule table, which shift is mine?", "How many days passed between June 1 and June 9?", "What did we mention before in our previous chat?", "Who is account owner of ACME?", "when did it happen", "Where is 'home base' now", "is it true", "list all projects", "explain ideas behind caching", "what year was it", "number of boats", "where did she live", "find build-42 status", "are they married", "which year did it start", "old city", "how does NASA plan", "did she use to run", "my favorite notebook"]
_FORMS = "[" + ", ".join("'" + q.rstrip("?").replace("'", "''") + "'" for q in QUESTIONS) + "]"
_Q = f"""questions AS (SELECT 'item ' || item_id AS question_id, text AS question FROM benchmark UNION ALL SELECT 'turn ' || conv_id || ' ' || turn, text FROM conversations WHERE role = 'user'
  UNION ALL SELECT 'customer ' || c_custkey, {_FORMS}[(c_custkey % {len(QUESTIONS)} + 1)::int] || ' in ' || lower(n_name) || '?' FROM customer JOIN nation ON n_nationkey = c_nationkey),
n AS (SELECT *, {normalised_sql('question')} AS q, regexp_extract_all(lower(question), '[a-z0-9_\\-]+') AS t FROM questions)"""


def _questions(spark, sf):
    """What is asked: every benchmark item, every turn of a user, and a question of one of the forms about the country of every customer."""
    items = table(spark, sf, "benchmark").select(F.concat(F.lit("item "), "item_id").alias("question_id"), F.col("text").alias("question"))
    turns = dealt(table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", "text"), "conv_id", "turn").select(F.concat(F.lit("turn "), "conv_id", F.lit(" "), "turn"), "text")
    form = F.element_at(F.array(*[F.lit(q.rstrip("?")) for q in QUESTIONS]), (F.col("c_custkey") % len(QUESTIONS) + 1).cast("int"))
    asked = dealt(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return items.union(turns).union(asked.select(F.concat(F.lit("customer "), "c_custkey"), F.concat(form, F.lit(" in "), F.lower("n_name"), F.lit("?"))))


def _any(terms, of="q"):
    return "(" + " OR ".join(f"contains({of}, '{t}')" for t in terms) + ")"


def _list(terms):
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


_INTENT = f"CASE WHEN contains(question, '\"') OR contains(question, chr(39)) THEN 'entity_lookup' WHEN len(list_intersect(t, {_list(qs.TEMPORAL)})) > 0 THEN 'temporal' WHEN len(list_intersect(t, {_list(qs.ENTITY)})) > 0 THEN 'entity_lookup' WHEN regexp_matches(lower(question), '[a-z]+[-_][a-z0-9]+') THEN 'entity_lookup' WHEN regexp_matches(question, '(^|[^A-Za-z0-9_])[A-Z]{{2,}}([^A-Za-z0-9_]|$)') THEN 'entity_lookup' ELSE 'conceptual' END"
_TYPE = f"CASE WHEN q = '' THEN 'free_text' WHEN starts_with(q, 'how many') OR contains(' ' || q || ' ', ' number of ') THEN 'count' WHEN starts_with(q, 'what year') OR contains(q, 'which year') THEN 'year' WHEN starts_with(q, 'when') OR contains(q, 'what date') THEN 'date' WHEN starts_with(q, 'who') THEN 'person' WHEN starts_with(q, 'where') THEN 'location' WHEN {_any(qs.RELATIONSHIP)} THEN 'relationship_status' WHEN {_any(qs.PREFERENCE)} THEN 'preference' WHEN string_split(q, ' ')[1] IN ({_list(qs.YES_NO)[1:-1]}) THEN 'yes_no' ELSE 'free_text' END"


@query("ret_intent", f"WITH {_Q} SELECT question_id, {_INTENT} AS intent FROM n")
def _(spark, sf):
    return _questions(spark, sf).select("question_id", qs.intent(F.col("question")).alias("intent"))


@query("qa_answer_type", f"WITH {_Q} SELECT question_id, {_TYPE} AS answer_type FROM n")
def _(spark, sf):
    return _questions(spark, sf).select("question_id", qs.answer_type(F.col("question")).alias("answer_type"))


@query("ret_weights", f"WITH {_Q}, i AS (SELECT question_id, {_INTENT} AS i FROM n), w AS (SELECT question_id, 0.3 * CASE i WHEN 'entity_lookup' THEN 2.0 WHEN 'temporal' THEN 1.3 ELSE 0.6 END::double AS k, 0.7 * CASE i WHEN 'entity_lookup' THEN 0.5 WHEN 'temporal' THEN 0.9 ELSE 1.5 END::double AS v FROM i) SELECT question_id, round(k / (k + v), 9) AS keyword, round(v / (k + v), 9) AS vector FROM w")
def _(spark, sf):
    k, v = qs.weights(qs.intent(F.col("question")))
    return _questions(spark, sf).select("question_id", F.round(k, 9).alias("keyword"), F.round(v, 9).alias("vector"))


@query("ret_plan", f"""WITH {_Q}, a AS (SELECT *, {_any(qs.TABLE)} AS tb, {_any(tuple(f' {t} ' for t in qs.LIST), "' ' || q || ' '")} AS ls, {_any(qs.TIME)} AS tm, {_any(qs.SPAN)} AS sp, {_any(qs.NOW)} AS nw, {_any(qs.PAST)} AS ps, regexp_matches(q, '(^| )(session|conversation|chat|round|turn|said earlier|mentioned before)( |$)') AS se FROM n),
b AS (SELECT *, CASE WHEN tb THEN 'table_lookup' WHEN ls THEN 'list_lookup' ELSE 'direct_recall' END AS r1 FROM a), c AS (SELECT *, CASE WHEN tm AND (r1 = 'direct_recall' OR sp) THEN 'temporal_math' ELSE r1 END AS r2 FROM b), d AS (SELECT *, CASE WHEN nw AND r2 = 'direct_recall' THEN 'current_state' ELSE r2 END AS r3 FROM c),
e AS (SELECT *, CASE WHEN ps AND r3 IN ('direct_recall', 'current_state') THEN 'historical_state' ELSE r3 END AS r4 FROM d), f AS (SELECT *, CASE WHEN se AND r4 = 'direct_recall' THEN 'multi_session' ELSE r4 END AS route FROM e)
SELECT question_id, route, {_TYPE} AS answer_type, greatest(CASE WHEN tb THEN 0.78 WHEN ls THEN 0.62 ELSE 0.35 END, CASE WHEN r2 <> r1 THEN 0.70 ELSE 0 END, CASE WHEN r3 <> r2 OR r4 <> r3 THEN 0.72 ELSE 0 END, CASE WHEN route <> r4 THEN 0.66 ELSE 0 END)::double AS confidence FROM f""")
def _(spark, sf):
    return _questions(spark, sf).select("question_id", qs.plan(F.col("question")).alias("p")).select("question_id", "p.route", "p.answer_type", "p.confidence")


@query("win_first_temporal", "WITH d AS (SELECT user_id, ts::date AS day, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) SELECT a.event_id AS a, b.event_id AS b, date_diff('day', a.day, b.day) AS days FROM d a JOIN d b ON a.user_id = b.user_id AND b.i BETWEEN a.i + 1 AND a.i + 3")
def _(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    later = F.array_compact(F.array(*[F.when(F.lead("event_id", i).over(w).isNotNull(), F.struct(F.lead("event_id", i).over(w).alias("b"), F.lead("day", i).over(w).alias("day_b"))) for i in (1, 2, 3)]))
    return e.withColumn("later", later).select(F.col("event_id").alias("a"), "day", F.inline("later")).select("a", "b", F.datediff("day_b", "day").cast("long").alias("days"))


def _budgets_sql() -> str:
    (low, most), (part, least) = agents.OBJECTIVE[1:], agents.WORKSPACE
    one = lambda mode, m, s, w: f"SELECT conv_id, '{mode}' AS mode, {w} = 1 AS with_workspace, total, least({most}, greatest({low}, total * {agents.OBJECTIVE[0]} // 100))::bigint AS objective, greatest({agents.MEMORY}, total * {m} // 100)::bigint AS memory, greatest({agents.SESSION}, total * {s} // 100)::bigint AS session, ({w} * greatest({least}, total * {part} // 100))::bigint AS workspace FROM c"
    return f"WITH c AS (SELECT conv_id, greatest({agents.TOTAL}, 4 * (sum(length(coalesce(text, ''))) // 4))::bigint AS total FROM conversations GROUP BY conv_id) " + " UNION ALL ".join(one(mode, m, s, w) for mode, (m, s) in agents.MODES.items() for w in (0, 1))


@query("ctx_budgets", _budgets_sql())
def _(spark, sf):
    """What every conversation's own length, taken as a budget of tokens, leaves to the parts of a context in each mode, with and without a workspace."""
    tokens = F.floor(F.sum(F.length(F.coalesce("text", F.lit("")))) / 4)
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(tokens.alias("tokens"))
    ways = [F.struct(F.lit(mode).alias("mode"), F.lit(w).alias("with_workspace"), *agents.budgets(F.col("tokens"), mode, w)) for mode in agents.MODES for w in (False, True)]
    return c.select("conv_id", F.inline(F.array(*ways)))


@query("clu_cluster_key", "SELECT conv_id, 'conv_' || conv_id || ':' || substr(sha1(string_agg(turn::varchar, ',' ORDER BY turn)), 1, 20) AS cluster_key FROM conversations GROUP BY conv_id")
def _(spark, sf):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda x: x.cast("string")), ",")
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.concat(F.lit("conv_"), F.first("conv_id").cast("string"), F.lit(":"), F.substring(F.sha1(ids), 1, 20)).alias("cluster_key"))


@query("ret_infer_scope", "SELECT doc_id, CASE WHEN regexp_matches(lower(source), 'src[0-4]$') THEN 'personal' WHEN regexp_matches(lower(source), 'src1') THEN 'shared' ELSE '' END AS scope FROM documents")
def _(spark, sf):
    s = F.lower("source")
    return table(spark, sf, "documents").select("doc_id", F.when(s.rlike("src[0-4]$"), "personal").when(s.rlike("src1"), "shared").otherwise("").alias("scope"))


@query("ret_scope_mult", "SELECT doc_id, (CASE WHEN regexp_matches(source, 'src[0-4]$') THEN 1.45 WHEN regexp_matches(source, 'src1') THEN 0.92 ELSE 1.0 END * CASE WHEN lang = 'en' THEN 1.1 ELSE 1.0 END)::double AS multiplier FROM documents")
def _(spark, sf):
    m = F.when(F.col("source").rlike("src[0-4]$"), 1.45).when(F.col("source").rlike("src1"), 0.92).otherwise(1.0) * F.when(F.col("lang") == "en", 1.1).otherwise(1.0)
    return table(spark, sf, "documents").select("doc_id", m.alias("multiplier"))


@query("ret_explain", "SELECT doc_id, array_to_string(list_filter([CASE WHEN lang = 'en' THEN 'language' END, CASE WHEN n_chars > 1000 THEN 'long' END, CASE WHEN source = 'src0' THEN 'main source' END], lambda x: x IS NOT NULL), ',') AS reasons FROM documents")
def _(spark, sf):
    reasons = F.array_compact(F.array(F.when(F.col("lang") == "en", "language"), F.when(F.col("n_chars") > 1000, "long"), F.when(F.col("source") == "src0", "main source")))
    return table(spark, sf, "documents").select("doc_id", F.array_join(reasons, ",").alias("reasons"))


@query("top_skill_candidates", "WITH c AS (SELECT conv_id, count(*) AS size, len(regexp_extract_all(string_agg(text, ' ' ORDER BY turn), '[Tt]h')) AS verbs FROM conversations GROUP BY conv_id), s AS (SELECT conv_id, round(least(0.99, 0.18 * size + 0.06 * verbs)::double, 9) AS score FROM c) SELECT conv_id, score, row_number() OVER (ORDER BY score DESC, conv_id) AS rank FROM s QUALIFY rank <= 20")
def _(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("size"), F.sum(F.size(F.regexp_extract_all("text", F.lit("[Tt]h"), F.lit(0)))).alias("verbs"))
    score = F.round(F.least(F.lit(0.99), F.lit(0.18) * F.col("size") + F.lit(0.06) * F.col("verbs")), 9)
    top = c.select("conv_id", score.alias("score")).orderBy(F.desc("score"), "conv_id").limit(20)
    return ranking.rank(top.withColumn("one", F.lit(1)), ["one"], F.desc("score"), F.asc("conv_id")).drop("one")
