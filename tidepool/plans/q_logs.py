"""Log lines, query language, events, de-duplication and integrity queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool.operators import cql, ranking, setsim
from tidepool.operators import events as ev
from tidepool.plans.registry import query
from tidepool.plans.tables import LINES_SQL, log_lines, table

_N = r"'^\s*[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$'"


def _slot(n: int) -> str:
    return f"coalesce(slots[{n + 1}], '')"


def _num(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, {_N}) THEN try_cast(trim({x}) AS DOUBLE) END)"


_CQL = {
    "cql_execute": ("SELECT lines WHERE slot[2] > 80", f"SELECT line_no, text FROM lines WHERE {_num(_slot(2))} > 80"),
    "cql_like": ("SELECT lines WHERE text LIKE 'error%server-1 %'", "SELECT line_no, text FROM lines WHERE text ILIKE 'error%server-1 %'"),
    "cql_target": ("SELECT avg(slot[2]) WHERE template LIKE 'User%'", f"SELECT avg({_num(_slot(2))}) AS value FROM lines WHERE template ILIKE 'User%'"),
    "cql_where_or": ("SELECT count() WHERE slot[1] = 'click' OR slot[1] = 'view'", f"SELECT count(*)::double AS value FROM lines WHERE {_slot(1)} = 'click' OR {_slot(1)} = 'view'"),
    "cql_where_and": ("SELECT lines WHERE slot[1] = 'signup' AND slot[2] < 5 AND text NOT LIKE '%k=1%'", f"SELECT line_no, text FROM lines WHERE {_slot(1)} = 'signup' AND {_num(_slot(2))} < 5 AND NOT text ILIKE '%k=1%'"),
    "cql_parse": ("SELECT count() WHERE text LIKE '%user%' LIMIT 7", "SELECT count(*)::double AS value FROM (SELECT * FROM lines WHERE text ILIKE '%user%' ORDER BY line_no LIMIT 7)"),
    "cql_field": ("SELECT max(slot[3])", f"SELECT max({_num(_slot(3))}) AS value FROM lines"),
    "cql_compare": ("SELECT lines WHERE slot[0] >= 'u14'", f"SELECT line_no, text FROM lines WHERE {_slot(0)} < 'u14'"),
    "cql_tokenize": ("SELECT min(slot[1]) WHERE (template LIKE 'Error%' AND slot[0] != 'server-3') OR slot[3] = 5", f"SELECT min({_num(_slot(1))}) AS value FROM lines WHERE (template ILIKE 'Error%' AND {_slot(0)} <> 'server-3') OR (CASE WHEN {_num(_slot(3))} IS NOT NULL THEN {_num(_slot(3))} = 5 ELSE {_slot(3)} = '5' END)"),
}
for _name, (_q, _s) in _CQL.items():
    query(_name, f"WITH {LINES_SQL} {_s}")(lambda spark, sf, q=_q: cql.execute(log_lines(spark, sf), q))


def _logs(name: str, sql: str):
    return query(name, f"WITH {LINES_SQL} {sql}")


@_logs("agg_template_stats", "SELECT count(DISTINCT template) AS n_templates, count(*) AS n_lines, sum(len(slots))::bigint AS n_slots, avg(len(slots)) AS mean_slots, 1.0 - count(DISTINCT template)::double / count(*) AS reuse FROM lines")
def _(spark, sf):
    return log_lines(spark, sf).agg(F.count_distinct("template").alias("n_templates"), F.count("*").alias("n_lines"), F.sum(F.size("slots")).alias("n_slots"), F.avg(F.size("slots")).alias("mean_slots"), (1.0 - F.count_distinct("template") / F.count("*")).alias("reuse"))


@_logs("agg_slot_mode", "SELECT template, i AS slot, first(s ORDER BY n DESC, s) AS mode, max(n)::double / sum(n) AS share FROM (SELECT template, i, s, count(*) AS n FROM (SELECT template, unnest(range(len(slots))) AS i, unnest(slots) AS s FROM lines) GROUP BY ALL) GROUP BY template, i")
def _(spark, sf):
    c = log_lines(spark, sf).select("template", F.posexplode("slots").alias("slot", "s")).groupBy("template", "slot", "s").agg(F.count("*").alias("n"))
    return c.groupBy("template", "slot").agg(F.min_by("s", F.struct(-F.col("n"), F.col("s"))).alias("mode"), (F.max("n") / F.sum("n")).alias("share"))


@_logs("ext_channel_type", f"SELECT template, i AS slot, CASE WHEN bool_and(regexp_matches(s, '^[0-9]+$')) THEN 'INT' WHEN bool_and(regexp_matches(s, '^[0-9.]+$')) THEN 'NUMBER' WHEN count(DISTINCT s) <= 16 THEN 'DICT' ELSE 'RAW' END AS kind FROM (SELECT template, unnest(range(len(slots))) AS i, unnest(slots) AS s FROM lines) GROUP BY template, i")
def _(spark, sf):
    each = log_lines(spark, sf).select("template", F.posexplode("slots").alias("slot", "s"))
    kind = F.when(F.every(F.col("s").rlike("^[0-9]+$")), "INT").when(F.every(F.col("s").rlike("^[0-9.]+$")), "NUMBER").when(F.count_distinct("s") <= 16, "DICT").otherwise("RAW")
    return each.groupBy("template", "slot").agg(kind.alias("kind"))


@_logs("ext_slot_types", "SELECT template, i AS slot, CASE WHEN count(*) FILTER (regexp_matches(s, '^[0-9]+$')) >= 50 THEN 'INT' ELSE 'DICT' END AS kind FROM (SELECT template, unnest(range(len(slots))) AS i, unnest(slots) AS s FROM lines) GROUP BY template, i")
def _(spark, sf):
    each = log_lines(spark, sf).select("template", F.posexplode("slots").alias("slot", "s"))
    return each.groupBy("template", "slot").agg(F.when(F.count_if(F.col("s").rlike("^[0-9]+$")) >= 50, "INT").otherwise("DICT").alias("kind"))


@_logs("ext_template_norm", "SELECT regexp_replace(text, '[0-9]+', '{}', 'g') AS template, count(*) AS n FROM lines GROUP BY 1")
def _(spark, sf):
    return log_lines(spark, sf).groupBy(F.regexp_replace("text", "[0-9]+", "{}").alias("template")).agg(F.count("*").alias("n"))


@_logs("ext_template_num", "SELECT line_no, regexp_replace(text, '[0-9]+', '{}', 'g') AS template, array_to_string(regexp_extract_all(text, '[0-9]+'), ',') AS slots FROM lines")
def _(spark, sf):
    return log_lines(spark, sf).select("line_no", F.regexp_replace("text", "[0-9]+", "{}").alias("template"), F.array_join(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), ",").alias("slots"))


@_logs("ext_template_merge", "SELECT a.line_no, array_to_string(list_transform(list_zip(string_split(a.text, ' '), string_split(b.text, ' ')), lambda p: CASE WHEN p[1] = p[2] THEN p[1] ELSE '<*>' END), ' ') AS merged FROM (SELECT *, lead(line_no) OVER (ORDER BY line_no) AS next FROM lines) a JOIN lines b ON b.line_no = a.next AND a.template = b.template")
def _(spark, sf):
    x = log_lines(spark, sf)
    first = x.join(ranking.successors(x, "line_no").withColumnRenamed("id", "line_no"), "line_no")
    both = first.alias("a").join(x.alias("b"), (F.col("b.line_no") == F.col("a.next")) & (F.col("a.template") == F.col("b.template")))
    merged = F.zip_with(F.split("a.text", " "), F.split("b.text", " "), lambda p, q: F.when(p == q, p).otherwise("<*>"))
    return both.select(F.col("a.line_no").alias("line_no"), F.array_join(merged, " ").alias("merged"))


@_logs("ext_template_params", "SELECT line_no, array_to_string(slots, ',') AS params FROM lines")
def _(spark, sf):
    """The parameters of every line, by the pattern that its template makes."""
    return log_lines(spark, sf).select("line_no", F.array_join(ev.parameters("text", "template"), ",").alias("params"))


@_logs("jn_template_match", "SELECT line_no, CASE WHEN regexp_matches(text, '^Error: timeout for .* after .* ms$') THEN 'E1' WHEN regexp_matches(text, '^User .* did .* value=.* k=.*$') THEN 'E2' END AS event_id FROM lines")
def _(spark, sf):
    bank = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("event_id"), F.lit(p).alias("pattern"), F.lit(w).alias("wildcards")) for i, p, w in (("E1", "^Error: timeout for .* after .* ms$", 2), ("E2", "^User .* did .* value=.* k=.*$", 4))])))
    hits = log_lines(spark, sf).join(F.broadcast(bank), F.expr("text rlike pattern"), "left")
    return hits.groupBy("line_no").agg(F.min_by("event_id", F.struct("wildcards", "event_id")).alias("event_id"))


@_logs("ret_tpl_fast", "SELECT line_no, text FROM lines WHERE template IN (SELECT DISTINCT template FROM lines WHERE contains(lower(template), 'timeout')) AND contains(text, 'server-9 ')")
def _(spark, sf):
    x = log_lines(spark, sf)
    few = x.select("template").distinct().where(F.contains(F.lower("template"), F.lit("timeout")))
    return x.join(few, "template", "left_semi").where(F.contains("text", F.lit("server-9 "))).select("line_no", "text")


@_logs("ret_tpl_event", "SELECT line_no FROM lines WHERE template = 'Error: timeout for <*> after <*> ms' ORDER BY line_no LIMIT 25")
def _(spark, sf):
    return log_lines(spark, sf).where(F.col("template") == "Error: timeout for <*> after <*> ms").orderBy("line_no").limit(25).select("line_no")


@_logs("top_template_cand", "SELECT template, len(list_intersect(string_split(lower(template), ' '), ['user', 'did', 'timeout'])) AS matched FROM (SELECT DISTINCT template FROM lines)")
def _(spark, sf):
    asked = F.array(*[F.lit(x) for x in ("user", "did", "timeout")])
    return log_lines(spark, sf).select("template").distinct().select("template", F.size(F.array_intersect(F.split(F.lower("template"), " "), asked)).cast("long").alias("matched"))


@_logs("ret_tool_select", "SELECT line_no, slots[2] AS tool FROM lines WHERE slots[2] IN ('click', 'purchase')")
def _(spark, sf):
    return log_lines(spark, sf).withColumn("tool", F.try_element_at("slots", F.lit(2))).where(F.col("tool").isin("click", "purchase")).select("line_no", "tool")


@_logs("ret_tool_index", "SELECT event_type AS tool, count(DISTINCT line_no // 512) AS n_packets, string_agg(DISTINCT (line_no // 512)::varchar, ',' ORDER BY (line_no // 512)::varchar) AS packets FROM lines GROUP BY event_type")
def _(spark, sf):
    packets = F.collect_set(F.floor(F.col("line_no") / 512).cast("string"))
    return log_lines(spark, sf).groupBy(F.col("event_type").alias("tool")).agg(F.size(packets).cast("long").alias("n_packets"), F.array_join(F.array_sort(packets), ",").alias("packets"))


@query("prd_struct_tokens", "SELECT event_id FROM events WHERE event_type = 'click' AND json_extract_string(props, '$.k')::int = 17")
def _(spark, sf):
    flat = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").where((F.col("event_type") == "click") & F.exists(F.map_entries(flat), lambda e: (e.key == "k") & (e.value == "17"))).select("event_id")


@query("ext_flatten_json", "SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("path", "value"))


@query("win_anomaly_z", "WITH w AS (SELECT event_id, value, count(value) OVER g AS n, avg(value) OVER g AS m, stddev_pop(value) OVER g AS d FROM events WINDOW g AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)), z AS (SELECT event_id, CASE WHEN n >= 5 THEN (value - m) / CASE WHEN d = 0 THEN 0.001 ELSE d END END AS z FROM w) SELECT event_id, round(z, 4) AS z, CASE WHEN z < -2 THEN 'low' WHEN z > 3 THEN 'high' END AS alert, CASE WHEN z >= -2 AND z <= 3 OR z IS NULL THEN NULL WHEN abs(z) > 5 THEN 'high' WHEN abs(z) > 3.5 THEN 'medium' ELSE 'low' END AS severity FROM z")
def _(spark, sf):
    return ev.anomalies(table(spark, sf, "events"), ["user_id"], "value", F.asc("ts"), F.asc("event_id")).select("event_id", F.round("z", 4).alias("z"), "alert", "severity")


@query("agg_drift", "WITH h AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 2 > count(*) OVER (PARTITION BY user_id) AS late FROM events), d AS (SELECT user_id, avg(value) AS mean, stddev_pop(value) AS dev, avg(value) FILTER (late) - avg(value) FILTER (NOT late) AS trend FROM h GROUP BY user_id) SELECT user_id, round(mean, 6) AS mean, round(dev, 6) AS dev, round(trend, 6) AS trend, abs(trend) > 0.1 * abs(mean) AS drifting FROM d")
def _(spark, sf):
    return ev.drift(table(spark, sf, "events"), ["user_id"], "value", F.asc("ts"), F.asc("event_id")).select("user_id", *[F.round(c, 6).alias(c) for c in ("mean", "dev", "trend")], "drifting")


_LEADS = ", ".join(f"lead(event_type, {i}) OVER g AS e{i}" for i in range(1, 10))
_NGRAMS = " UNION ALL ".join(f"SELECT {n} AS n_events, {' || chr(62) || '.join(f'e{i}' for i in range(n))} AS pattern FROM l" for n in range(3, 11))
_MOTIF = f"l AS (SELECT event_type AS e0, {_LEADS} FROM events WINDOW g AS (PARTITION BY user_id ORDER BY ts, event_id)), p AS ({_NGRAMS}), m AS (SELECT pattern, n_events, count(*) AS occurrences, count(*) * n_events AS weight FROM p WHERE pattern IS NOT NULL GROUP BY pattern, n_events HAVING count(*) >= 2)"


def _motifs(spark, sf):
    return ev.motifs(table(spark, sf, "events"), ["user_id"], "event_type", F.asc("ts"), F.asc("event_id"))


query("agg_motif_ngrams", f"WITH {_MOTIF} SELECT * FROM m")(_motifs)
query("top_motifs", f"WITH {_MOTIF} SELECT * FROM m ORDER BY weight DESC, pattern LIMIT 20")(lambda s, d: _motifs(s, d).orderBy(F.desc("weight"), "pattern").limit(20))


@query("win_delta_encode", "SELECT event_id, value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS delta FROM events")
def _(spark, sf):
    return ev.deltas(table(spark, sf, "events"), ["user_id"], "value", F.asc("ts"), F.asc("event_id")).select("event_id", "delta")


@query("win_rle", "WITH s AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER g AND row_number() OVER g > 1 THEN 0 ELSE 1 END AS st FROM events WINDOW g AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM s) SELECT user_id, run::bigint AS run, event_type, count(*) AS n FROM r GROUP BY ALL")
def _(spark, sf):
    return ev.runs(table(spark, sf, "events"), ["user_id"], "event_type", F.asc("ts"), F.asc("event_id"))


_CO = "o AS (SELECT DISTINCT user_id, floor(value / 20)::bigint AS item FROM events), c AS (SELECT a.item AS a, b.item AS b, count(*) AS n FROM o a JOIN o b ON a.user_id = b.user_id AND a.item <> b.item GROUP BY ALL)"


def _co(spark, sf):
    return ev.cooccurrence(table(spark, sf, "events").withColumn("item", F.floor(F.col("value") / 20)), "user_id", "item")


query("agg_cooccurrence", f"WITH {_CO} SELECT * FROM c")(_co)


@query("top_predicted", f"WITH {_CO}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rank FROM c) SELECT * FROM r WHERE rank <= 5")
def _(spark, sf):
    return ranking.top_k(_co(spark, sf), ["a"], 5, F.desc("n"), F.asc("b"))


_STORE = "s AS (SELECT sha256(text) AS sha, count(*) AS refs, max(strlen(text))::bigint AS size, min(doc_id) AS first_id FROM documents GROUP BY 1)"


def _store(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("refs"), F.max(F.octet_length("text")).cast("long").alias("size"), F.min("doc_id").alias("first_id"))


query("ded_store", f"WITH {_STORE} SELECT * FROM s")(_store)
query("ded_sha", "SELECT doc_id, sha256(text) AS sha FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha")))
_TIER = "CASE WHEN refs >= 5 THEN 'hot' WHEN refs >= 2 THEN 'warm' ELSE 'cold' END"


def _tier():
    return F.when(F.col("refs") >= 5, "hot").when(F.col("refs") >= 2, "warm").otherwise("cold")


query("ded_tiering", f"WITH {_STORE} SELECT sha, {_TIER} AS tier FROM s")(lambda s, d: _store(s, d).select("sha", _tier().alias("tier")))
query("agg_dedup_stats", f"WITH {_STORE} SELECT {_TIER} AS tier, count(*) AS n, sum(size)::bigint AS bytes, sum(refs)::bigint AS refs FROM s GROUP BY 1")(lambda s, d: _store(s, d).groupBy(_tier().alias("tier")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.sum("refs").alias("refs")))
query("agg_compression_stats", "SELECT source, count(*) AS n, sum(strlen(text))::bigint AS raw, sum(length(text))::bigint AS chars, sum(length(text))::double / sum(strlen(text)) AS ratio FROM documents GROUP BY source")(lambda s, d: table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("raw"), F.sum(F.length("text")).alias("chars"), (F.sum(F.length("text")) / F.sum(F.octet_length("text"))).alias("ratio")))
query("jn_shared_chunks", "WITH l AS (SELECT DISTINCT user_id, floor(value / 10)::bigint AS c FROM events), s AS (SELECT user_id, count(*) AS n FROM l GROUP BY user_id), p AS (SELECT a.user_id AS a, b.user_id AS b, count(*) AS m FROM l a JOIN l b ON a.c = b.c AND a.user_id < b.user_id GROUP BY ALL) SELECT a, b, m::double / (x.n + y.n - m) AS jaccard FROM p JOIN s x ON x.user_id = a JOIN s y ON y.user_id = b WHERE m::double / (x.n + y.n - m) >= 0.5")(lambda s, d: _shared(s, d, 0.5))
query("set_jaccard_chunks", "WITH l AS (SELECT DISTINCT user_id, floor(value / 10)::bigint AS c FROM events), s AS (SELECT user_id, count(*) AS n FROM l GROUP BY user_id), p AS (SELECT a.user_id AS a, b.user_id AS b, count(*) AS m FROM l a JOIN l b ON a.c = b.c AND a.user_id < b.user_id GROUP BY ALL) SELECT a, b, m::double / (x.n + y.n - m) AS jaccard FROM p JOIN s x ON x.user_id = a JOIN s y ON y.user_id = b WHERE m::double / (x.n + y.n - m) >= 0.7")(lambda s, d: _shared(s, d, 0.7))


def _shared(spark, sf, least):
    chunks = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set(F.floor(F.col("value") / 10)).alias("chunks"))
    return setsim.pairs(chunks, "user_id", F.col("chunks"), least)


_KV = "o AS (SELECT user_id AS key, arg_max(value, event_id) AS v FROM events WHERE event_id % 2 = 0 GROUP BY user_id), n AS (SELECT user_id AS key, arg_max(value, event_id) AS v FROM events WHERE event_id % 3 = 0 GROUP BY user_id)"


def _kv(spark, sf):
    e = table(spark, sf, "events")
    last = lambda m, name: e.where(F.col("event_id") % m == 0).groupBy(F.col("user_id").alias("key")).agg(F.max_by("value", "event_id").alias(name))
    return last(2, "old"), last(3, "new")


@query("set_kv_delta", f"WITH {_KV} SELECT coalesce(o.key, n.key) AS key, CASE WHEN n.key IS NULL THEN 'delete' ELSE 'set' END AS op, n.v AS value FROM o FULL JOIN n ON o.key = n.key WHERE n.key IS NULL OR o.key IS NULL OR o.v <> n.v")
def _(spark, sf):
    old, new = _kv(spark, sf)
    both = old.join(new, "key", "full").where("new is null or old is null or old <> new")
    return both.select("key", F.when(F.col("new").isNull(), "delete").otherwise("set").alias("op"), F.col("new").alias("value"))


@query("set_kv_apply", f"WITH {_KV} SELECT key, v AS value FROM n")
def _(spark, sf):
    old, new = _kv(spark, sf)
    delta = old.join(new, "key", "full").where("new is null or old is null or old <> new")
    kept = old.join(delta, "key", "left_anti").select("key", F.col("old").alias("value"))
    return kept.union(delta.where("new is not null").select("key", F.col("new").alias("value")))


@query("int_timetravel", "SELECT event_type, count(*) AS n FROM events WHERE event_id <= 1234 GROUP BY event_type")
def _(spark, sf):
    return table(spark, sf, "events").where("event_id <= 1234").groupBy("event_type").agg(F.count("*").alias("n"))


@query("int_fleet_mux", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, user_id AS agent FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("turn"), F.col("user_id").alias("agent"))


@query("top_budgeted_decode", "SELECT doc_id, used::bigint AS used FROM (SELECT doc_id, source, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents) WHERE used <= 20000")
def _(spark, sf):
    return ranking.within_budget(table(spark, sf, "documents"), ["source"], F.octet_length("text"), 20_000, F.asc("doc_id"), keep_first=False).select("doc_id", "used")


@query("set_federation_lookup", "WITH u AS (SELECT doc_id % 300 AS key, 0 AS tier, doc_id AS v FROM documents WHERE lang = 'fr' UNION ALL SELECT doc_id % 300, 1, doc_id FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tier, v) AS nth FROM u) SELECT key, tier, v FROM r WHERE nth = 1")
def _(spark, sf):
    d = table(spark, sf, "documents")
    u = d.where("lang = 'fr'").select((F.col("doc_id") % 300).alias("key"), F.lit(0).alias("tier"), F.col("doc_id").alias("v")).union(d.select(F.col("doc_id") % 300, F.lit(1), "doc_id"))
    return ranking.top_k(u, ["key"], 1, F.asc("tier"), F.asc("v")).select("key", "tier", "v")


@query("str_windows", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def _(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


@query("ext_olap_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _(spark, sf):
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("ext_asof_fact", "WITH f AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), g AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') SELECT f.event_id, arg_max(g.value, g.ts) AS last_value FROM f LEFT JOIN g ON g.user_id = f.user_id AND g.ts <= f.ts GROUP BY f.event_id")
def _(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)  # as-of as one window instead of a range join
    e = table(spark, sf, "events").where(F.col("event_type").isin("click", "purchase"))
    return e.withColumn("last_value", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w)).where("event_type = 'click'").select("event_id", "last_value")
