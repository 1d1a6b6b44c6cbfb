"""Sources, sinks, packets, consolidation and context queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators import facts as fx
from tidepool.operators import ranking, search, store, text
from tidepool.operators.questions import CORE_STOP
from tidepool.plans.q_questions import _Q, _questions
from tidepool.plans.registry import query
from tidepool.plans.tables import CURRENT_SQL, EDGES_SQL, FACTS_SQL, LINES_SQL, edges, facts, log_lines, table
from tidepool.sources import sessions

# Sources


def _jsonl(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    line = F.when(F.col("event_id") % 5 == 0, "not json").when(F.col("event_id") % 5 == 1, "[1, 2]").otherwise(F.to_json(F.struct("event_id", "event_type")))
    path = store.scratch(spark, "jsonl")
    e.select(line.alias("value")).write.text(path)
    return sessions.json_lines(spark, path)


@query("src_jsonl", "SELECT event_id, event_type FROM events WHERE event_id % 5 > 1")
def _(spark, sf):
    return _jsonl(spark, sf).select(F.try_variant_get("entry", "$.event_id", "long").alias("event_id"), F.try_variant_get("entry", "$.event_type", "string").alias("event_type"))


@query("src_corpus_docs", "WITH m AS (SELECT 'c' || conv_id AS doc_id, list(role ORDER BY turn) AS memories FROM conversations GROUP BY conv_id), e AS (SELECT doc_id, len(memories) AS n, unnest(memories) AS text, unnest(range(len(memories))) AS nth FROM m) SELECT CASE WHEN n > 1 THEN doc_id || '#' || nth ELSE doc_id END AS doc_id, text, count(*) AS n_seen FROM e GROUP BY ALL")
def _(spark, sf):
    m = table(spark, sf, "conversations").groupBy(F.concat(F.lit("c"), "conv_id").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x.role).alias("memories"))
    return sessions.corpus(m)


@query("src_log_lines", f"WITH {LINES_SQL} SELECT line_no, text FROM lines ORDER BY line_no LIMIT 100")
def _(spark, sf):
    return log_lines(spark, sf).orderBy("line_no").limit(100).select("line_no", "text")


@query("src_template_csv")
def _(spark, sf):
    path = store.scratch(spark, "templates")
    log_lines(spark, sf).groupBy("template").agg(F.min("line_no").alias("n")).select(F.concat(F.lit("E"), "n").alias("EventId"), F.col("template").alias("EventTemplate")).coalesce(1).write.option("header", True).csv(path)
    return sessions.template_bank(spark, path)


_SPAN = "'SPAN ' || event_type || ' trace=' || user_id || ' span=' || event_id || ' status=ok k=' || json_extract_string(props, '$.k')"


def _spans(spark, sf) -> DataFrame:
    line = sessions.span_line(F.col("event_type"), F.col("user_id").cast("string"), F.col("event_id").cast("string"), F.lit("ok"), F.from_json("props", "map<string,string>"))
    return table(spark, sf, "events").select("event_id", line.alias("line"))


query("src_spans", f"SELECT event_id, {_SPAN} AS line FROM events")(_spans)


@query("src_spans_parse", "SELECT event_id, event_type AS name, user_id::varchar AS trace, json_extract_string(props, '$.k') AS k FROM events")
def _(spark, sf):
    p = _spans(spark, sf).select("event_id", sessions.parse_span(F.col("line")).alias("p"))
    return p.select("event_id", "p.name", F.col("p.fields")["trace"].alias("trace"), F.col("p.fields")["k"].alias("k"))


@query("src_vault_get", "SELECT DISTINCT sha256(text) AS sha, length(text) AS n FROM documents WHERE starts_with(sha256(text), '0a')")
def _(spark, sf):
    v = store.addressed(table(spark, sf, "documents"), F.col("text"))
    return v.where(F.startswith("sha", F.lit("0a"))).select("sha", F.length("content").cast("long").alias("n"))


# Sinks

@query("snk_supersede", "SELECT doc_id, CASE WHEN quality = 0 THEN 'superseded' ELSE 'active' END AS status FROM labels UNION ALL SELECT doc_id + 1000000, 'active' FROM labels WHERE quality = 0")
def _(spark, sf):
    lab = table(spark, sf, "labels")
    new = lab.where("quality = 0").select(F.col("doc_id").alias("old_id"), (F.col("doc_id") + 1_000_000).alias("doc_id"), F.lit("active").alias("status"))
    return store.superseded(lab.select("doc_id", F.lit("active").alias("status")), new, "doc_id")


@query("snk_vault_put", "SELECT sha256(text) AS sha, count(*) AS n_refs FROM documents GROUP BY 1")
def _(spark, sf):
    return store.appended(spark, "vault", store.addressed(table(spark, sf, "documents"), F.col("text"))).select("sha", "n_refs")


@query("snk_wiki_compile", f"WITH {CURRENT_SQL} SELECT entity_key, md5('# ' || entity_key || chr(10) || string_agg('- ' || relation_key || ': ' || value, chr(10) ORDER BY relation_key, fact_id)) AS page FROM cur WHERE is_current GROUP BY entity_key")
def _(spark, sf):
    now = fx.with_current(facts(spark, sf)).where("is_current")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("relation_key", "fact_id", "value"))), lambda x: F.concat(F.lit("- "), x.relation_key, F.lit(": "), x.value))
    return now.groupBy("entity_key").agg(F.md5(F.concat(F.lit("# "), F.first("entity_key"), F.lit("\n"), F.array_join(lines, "\n"))).alias("page"))


# Predicates


@query("prd_case_expr", "SELECT event_id, '\"' || array_to_string(string_split(event_type || '_case_' || event_id, '_'), '\" \"') || '\"' AS expression FROM events")
def _(spark, sf):
    token = F.concat("event_type", F.lit("_case_"), "event_id")
    return table(spark, sf, "events").select("event_id", F.concat(F.lit('"'), F.array_join(F.split(token, "_"), '" "'), F.lit('"')).alias("expression"))


@query("prd_sanitise_wrap", "SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n]+', ' ', 'g'))) AS plain FROM pages")
def _(spark, sf):
    bare = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[ \t\n]+", " "))
    return table(spark, sf, "pages").select("page_id", F.md5(bare).alias("plain"))


@query("prd_plain_kw", f"WITH {LINES_SQL} SELECT line_no FROM lines WHERE contains(lower(text), 'click') OR contains(lower(text), 'purchas')")
def _(spark, sf):
    stem = lambda w: [w, *[w[: -len(s)] for s in ("ing", "ed", "es", "s") if w.endswith(s) and len(w) > len(s) + 2]]
    variants = F.array(*[F.lit(v) for w in ("clicks", "purchasing") for v in stem(w)])
    return log_lines(spark, sf).where(F.exists(variants, lambda v: F.contains(F.lower("text"), v))).select("line_no")


# Windows and tops


@query("win_frame_support", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS running, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")
def _(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("running"), F.lag("event_id").over(w).alias("previous"))


@query("win_line_delta", "WITH l AS (SELECT conv_id, turn, string_split(text, chr(10)) AS l, lag(string_split(text, chr(10))) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) SELECT conv_id, turn, len(list_filter(list_zip(l, coalesce(p, [])), lambda x: x[1] IS DISTINCT FROM x[2])) AS n_changed FROM l")
def _(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("l", F.split("text", "\n")).withColumn("p", F.coalesce(F.lag("l").over(w), F.array().cast("array<string>")))
    changed = F.filter(F.zip_with("l", "p", lambda a, b: ~a.eqNullSafe(b)), lambda x: x)
    return c.select("conv_id", "turn", F.size(changed).cast("long").alias("n_changed"))


@query("top_truth_rank", f"WITH {CURRENT_SQL}, g AS (SELECT entity_key, relation_key, round(3.2 + max(confidence) + 0.1 * count(*) FILTER (is_current), 6) AS score FROM cur GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY relation_key ORDER BY score DESC, entity_key) AS rank FROM g) SELECT * FROM r WHERE rank <= 5")
def _(spark, sf):
    g = fx.with_current(facts(spark, sf)).groupBy(*fx.GROUP).agg(F.round(F.lit(3.2) + F.max("confidence") + 0.1 * F.count_if("is_current"), 6).alias("score"))
    return ranking.top_k(g, ["relation_key"], 5, F.desc("score"), F.asc("entity_key"))


_SENT = r"s AS (SELECT doc_id, unnest(range(len(s))) AS nth, unnest(s) AS sentence FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents))"


def _top_sentences(spark, sf, k: int, terms: tuple[str, ...], bonus: float) -> DataFrame:
    each = table(spark, sf, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("nth", "sentence"))
    words = F.array_distinct(search.tokens(F.col("sentence")))
    score = F.size(F.array_intersect(words, F.array(*[F.lit(t) for t in terms]))) + F.when(F.col("sentence").rlike("[0-9]"), bonus).otherwise(0.0)
    return ranking.top_k(each.withColumn("score", score), ["doc_id"], k, F.desc("score"), F.asc("nth")).select("doc_id", "nth", "score")


for _name, _k, _terms, _b in (("top_sentences", 3, ("the", "and", "license", "of"), 0.5), ("top_claims", 5, ("this", "that", "under"), 1.0)):
    _list = "[" + ", ".join(f"'{t}'" for t in _terms) + "]"
    query(_name, f"WITH {_SENT}, c AS (SELECT *, len(list_intersect(list_distinct(regexp_extract_all(lower(sentence), '[a-z0-9_]+')), {_list})) + CASE WHEN regexp_matches(sentence, '[0-9]') THEN {_b} ELSE 0 END::double AS score FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, nth) AS rank FROM c) SELECT doc_id, nth, score FROM r WHERE rank <= {_k}")(lambda spark, sf, k=_k, t=_terms, b=_b: _top_sentences(spark, sf, k, t, b))


# Query analysis


@query("ret_core_terms", f"WITH {_Q} SELECT question_id, array_to_string(list_filter(list_filter(t, (lambda x, i: list_position(t, x) = i)), lambda x: length(x) > 2 AND x NOT IN ({', '.join(repr(s) for s in CORE_STOP)}))[1:12], ' ') AS terms FROM n")
def _(spark, sf):
    t = F.filter(F.regexp_extract_all(F.lower("question"), F.lit(r"[a-z0-9_\-]+"), F.lit(0)), lambda x: F.length(x) > 2)
    return _questions(spark, sf).select("question_id", F.array_join(F.slice(F.array_except(t, F.array(*[F.lit(s) for s in CORE_STOP])), 1, 12), " ").alias("terms"))


@query("ret_structured_dedupe", f"WITH {FACTS_SQL}, r AS (SELECT fact_id, row_number() OVER (PARTITION BY entity_key, relation_key, value ORDER BY confidence DESC, fact_id) AS nth FROM facts) SELECT fact_id FROM r WHERE nth = 1")
def _(spark, sf):
    f = fx.keyed(facts(spark, sf))
    return ranking.top_k(f, ["entity_key", "relation_key", "value"], 1, F.desc("confidence"), F.asc("fact_id")).select("fact_id")


@query("ret_wiki_get", f"WITH {CURRENT_SQL} SELECT fact_id, relation_key, value FROM cur WHERE entity_key = 'user_7' AND is_current")
def _(spark, sf):
    return fx.with_current(facts(spark, sf)).where("entity_key = 'user_7' and is_current").select("fact_id", "relation_key", "value")


@query("ret_render", "SELECT conv_id, md5('<memories>' || string_agg('<memory role=\"' || role || '\">' || substr(text, 1, 50) || '</memory>', '' ORDER BY turn) || '</memories>') AS context FROM conversations GROUP BY conv_id")
def _(spark, sf):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(F.lit('<memory role="'), x.role, F.lit('">'), F.substring(x.text, 1, 50), F.lit("</memory>")))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.md5(F.concat(F.lit("<memories>"), F.array_join(parts, ""), F.lit("</memories>"))).alias("context"))


# Extraction


@query("ext_bm_shingles", "SELECT item_id, f AS feature, count(*) AS n FROM (SELECT item_id, unnest(list_concat(t, list_transform(range(len(t) - 1), lambda i: t[i + 1] || ' ' || t[i + 2]))) AS f FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM benchmark) WHERE len(t) > 1) GROUP BY ALL")
def _(spark, sf):
    t = table(spark, sf, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("t")).where(F.size("t") > 1)
    two = F.zip_with(F.slice("t", F.lit(1), F.size("t") - 1), F.slice("t", F.lit(2), F.size("t") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return t.select("item_id", F.explode(F.concat("t", two)).alias("feature")).groupBy("item_id", "feature").agg(F.count("*").alias("n"))


@query("ext_action", f"WITH {LINES_SQL} SELECT CASE WHEN regexp_matches(lower(text), 'error|timeout') THEN 'tool_error' WHEN regexp_matches(text, 'did (signup|purchase)') THEN 'fix' ELSE 'result' END AS action, count(*) AS n FROM lines GROUP BY 1")
def _(spark, sf):
    action = F.when(F.lower("text").rlike("error|timeout"), "tool_error").when(F.col("text").rlike("did (signup|purchase)"), "fix").otherwise("result")
    return log_lines(spark, sf).groupBy(action.alias("action")).agg(F.count("*").alias("n"))


# Consolidation, governance, context


@query("clu_probe_eval", f"WITH {CURRENT_SQL}, v AS (SELECT entity_key, relation_key, string_agg(value, ' ' ORDER BY fact_id) AS said FROM facts GROUP BY ALL) SELECT fact_id, contains(said, value) AS passed FROM cur JOIN v USING (entity_key, relation_key) WHERE is_current")
def _(spark, sf):
    f = fx.keyed(facts(spark, sf))
    said = f.groupBy(*fx.GROUP).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fact_id", "value"))), lambda x: x.value), " ").alias("said"))
    return fx.with_current(facts(spark, sf)).where("is_current").join(said, fx.GROUP).select("fact_id", F.contains("said", "value").alias("passed"))


@query("gov_admission_edge", f"WITH {EDGES_SQL}, d AS (SELECT edge_id, src, relation, dst, created_at FROM edges GROUP BY ALL), w AS (SELECT edge_id, relation, count(*) OVER (PARTITION BY src, relation ORDER BY created_at, edge_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY src, relation, dst ORDER BY created_at, edge_id) AS nth FROM d) SELECT edge_id, CASE WHEN nth > 1 THEN 'NOOP' WHEN relation = 'based_in' AND before > 0 THEN 'SUPERSEDE' ELSE 'ALLOW' END AS action FROM w")
def _(spark, sf):
    e = edges(spark, sf).distinct()
    before = F.count("*").over(Window.partitionBy("src", "relation").orderBy("created_at", "edge_id").rowsBetween(Window.unboundedPreceding, -1))
    nth = F.row_number().over(Window.partitionBy("src", "relation", "dst").orderBy("created_at", "edge_id"))
    e = e.withColumn("before", before).withColumn("nth", nth)
    return e.select("edge_id", F.when(F.col("nth") > 1, "NOOP").when((F.col("relation") == "based_in") & (F.col("before") > 0), "SUPERSEDE").otherwise("ALLOW").alias("action"))


@query("qa_context", "WITH r AS (SELECT conv_id, turn, least(length(text), 400) AS n FROM conversations), s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY n DESC, turn) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, turn) AS nth FROM r) SELECT conv_id, turn FROM s WHERE used <= 1200 OR nth = 1")
def _(spark, sf):
    c = table(spark, sf, "conversations").withColumn("n", F.least(F.length("text"), F.lit(400)))
    return ranking.within_budget(c, ["conv_id"], F.col("n"), 1200, F.desc("n"), F.asc("turn")).select("conv_id", "turn")


# Packing, integrity, streams


@query("ded_decode", "SELECT doc_id, sha256(text) AS sha FROM documents")
def _(spark, sf):
    """Chunks stored once by content and put together again in order."""
    from tidepool.functions.chunks import content_chunks

    each = table(spark, sf, "documents").select("doc_id", F.posexplode(content_chunks(F.col("text").cast("binary"))).alias("nth", "chunk")).withColumn("h", F.sha2("chunk", 256))
    stored = each.groupBy("h").agg(F.min("chunk").alias("chunk"))
    back = each.select("doc_id", "nth", "h").join(stored, "h").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("nth", F.hex("chunk").alias("x")))).alias("p"))
    return back.select("doc_id", F.sha2(F.unhex(F.array_join(F.transform("p", lambda x: x.x), "")), 256).alias("sha"))


query("int_fleet_demux", "SELECT user_id AS agent, string_agg(event_type, ',' ORDER BY ts, event_id) AS stream FROM events GROUP BY user_id")(lambda spark, sf: table(spark, sf, "events").groupBy(F.col("user_id").alias("agent")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x.event_type), ",").alias("stream")))


@query("cmp_predict_slots", f"WITH {LINES_SQL}, c AS (SELECT template, i, s, count(*) AS n FROM (SELECT template, unnest(range(len(slots))) AS i, unnest(slots) AS s FROM lines) GROUP BY ALL), m AS (SELECT template, i, first(s ORDER BY n DESC, s) AS mode FROM c GROUP BY ALL) SELECT template, i AS slot, sum(n * CASE WHEN s = mode THEN 1 ELSE 1 + length(s) END)::bigint AS size FROM c JOIN m USING (template, i) GROUP BY ALL")
def _(spark, sf):
    c = log_lines(spark, sf).select("template", F.posexplode("slots").alias("slot", "s")).groupBy("template", "slot", "s").agg(F.count("*").alias("n"))
    mode = c.groupBy("template", "slot").agg(F.min_by("s", F.struct(-F.col("n"), F.col("s"))).alias("mode"))
    return c.join(mode, ["template", "slot"]).groupBy("template", "slot").agg(F.sum(F.col("n") * F.when(F.col("s") == F.col("mode"), 1).otherwise(1 + F.length("s"))).alias("size"))


@query("ded_predict", "WITH o AS (SELECT DISTINCT user_id, floor(value / 20)::bigint AS item FROM events), c AS (SELECT a.item AS a, b.item AS b, count(*) AS n FROM o a JOIN o b ON a.user_id = b.user_id AND a.item <> b.item GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rank FROM c) SELECT a, string_agg(b::varchar, ',' ORDER BY rank) AS ids FROM r WHERE rank <= 5 GROUP BY a")
def _(spark, sf):
    from tidepool.operators.events import cooccurrence

    c = cooccurrence(table(spark, sf, "events").withColumn("item", F.floor(F.col("value") / 20)), "user_id", "item")
    top = ranking.top_k(c, ["a"], 5, F.desc("n"), F.asc("b"))
    return top.groupBy("a").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "b"))), lambda x: x.b.cast("string")), ",").alias("ids"))
