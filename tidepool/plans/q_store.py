"""Sources and sinks: transcripts, files, benchmarks; records with their own schema, merges into tables that are there."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions.chunks import chunk_text
from tidepool.operators import facts as fx
from tidepool.operators import store
from tidepool.plans.registry import query
from tidepool.plans.tables import FACTS_SQL, facts, table
from tidepool.sources import benchmarks, sessions

# Transcripts of three kinds


def _lines(c: DataFrame, kind: str) -> DataFrame:
    """conversations as transcript lines: (conv_id, turn, value)."""
    obj = lambda **kv: F.struct(*[v.alias(k) for k, v in kv.items()])
    block = lambda kind, **kv: F.to_json(obj(type=F.lit(kind), **kv))
    if kind == "nested":
        role = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 3), "toolResult").otherwise(F.col("role"))
        head = c.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("turn"), F.to_json(obj(type=F.lit("session"), session_id=F.concat(F.lit("conv_"), "conv_id"))).alias("value"))
        return head.unionByName(c.select("conv_id", "turn", F.to_json(obj(type=F.lit("message"), message=obj(role=role, content=F.col("text")))).alias("value")))
    if kind == "entries":
        call = block("tool_use", name=F.lit("look"), input=obj(b=F.col("turn").cast("string"), a=F.lit("x")))
        blocks = F.concat(F.lit("["), F.concat_ws(",", block("text", text=F.col("text")), F.when(F.col("role") == "assistant", call)), F.lit("]"))
        return c.select("conv_id", "turn", F.concat(F.lit('{"type":"'), F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise("file-history-snapshot"), F.lit('","message":{"content":'), blocks, F.lit("}}")).alias("value"))
    return c.select("conv_id", "turn", F.to_json(obj(text=F.col("text"))).alias("value"))


def _parsed(spark, *lines: DataFrame) -> DataFrame:
    path = store.scratch(spark, "transcripts")
    for part in lines:
        part.repartition("conv_id").sortWithinPartitions("conv_id", "turn").select("conv_id", "value").write.mode("append").partitionBy("conv_id").text(path)
    got = sessions.transcripts(spark, path)
    return got.select(F.regexp_extract("file", r"conv_id=(\d+)", 1).cast("long").alias("conv_id"), F.col("index").cast("long").alias("index"), "role", F.md5("content").alias("content"))


def _turns_sql(kind: str, where: str = "true") -> str:
    if kind == "nested":
        each = f"SELECT conv_id, turn, 0 AS nth, CASE WHEN role = 'assistant' AND turn % 4 = 3 THEN 'tool_result' ELSE role END AS role, text FROM conversations WHERE {where} AND role IN ('user', 'assistant') AND length(text) >= 20 AND (role = 'user' OR turn % 4 <> 3 OR length(text) <= 2000)"
    elif kind == "entries":
        each = f"SELECT conv_id, turn, 0 AS nth, role, text FROM conversations WHERE {where} AND role IN ('user', 'assistant') AND length(text) >= 20 UNION ALL SELECT conv_id, turn, 1, 'tool_call', 'Tool: look' || chr(10) || '  a: x' || chr(10) || '  b: ' || turn FROM conversations WHERE {where} AND role = 'assistant'"
    else:
        each = f"SELECT conv_id, turn, 0 AS nth, 'unknown' AS role, substr(text, 1, 5000) AS text FROM conversations WHERE {where} AND length(text) >= 20"
    return f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, nth) - 1 AS index, role, md5(trim(text)) AS content FROM ({each})"


for _name, _kind in {"src_session_fmt_a": "nested", "src_session_fmt_b": "entries", "src_session_generic": "generic"}.items():
    query(_name, _turns_sql(_kind))(lambda spark, sf, k=_kind: _parsed(spark, _lines(table(spark, sf, "conversations"), k)))

_KINDS = ("nested", "entries", "generic")


@query("src_session_auto", " UNION ALL ".join(f"({_turns_sql(k, f'conv_id % 3 = {i}')})" for i, k in enumerate(_KINDS)))
def _(spark, sf):
    """Files of all three kinds in one folder; each is told by its first line."""
    c = table(spark, sf, "conversations")
    return _parsed(spark, *[_lines(c.where(F.col("conv_id") % 3 == i), k) for i, k in enumerate(_KINDS)])


@query("src_text_file", "SELECT item_id, sha256(text || chr(10)) AS sha, strlen(text) + 1 AS size, true AS in_vault FROM benchmark")
def _(spark, sf):
    """Files read whole, put into the vault under their hash, registered, and cut into chunks that give them back."""
    path = store.scratch(spark, "files")
    table(spark, sf, "benchmark").select("item_id", "text").repartition("item_id").write.partitionBy("item_id").text(path)
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"item_id=(\d+)", 1).cast("long").alias("item_id"), F.col("value").alias("content"))
    vault = store.appended(spark, "vault", store.addressed(whole, F.col("content")))
    registered = store.Versions(spark, store.scratch(spark, "register")).merge(whole.select(F.sha2("content", 256).alias("sha"), "item_id", F.octet_length("content").cast("long").alias("size")), ["sha", "item_id"])
    chunked = whole.select("item_id", F.get(chunk_text("content"), F.lit(0)).alias("first"), "content").select("item_id", F.startswith("content", "first").alias("cut"))
    kept = registered.join(vault.select("sha"), "sha").join(chunked, "item_id")
    return kept.select("item_id", "sha", "size", F.col("cut").alias("in_vault"))


# Benchmarks: questions about conversations, written as JSON and converted


def _json(spark, rows: DataFrame, name: str) -> DataFrame:
    path = store.scratch(spark, name)
    rows.write.json(path)
    return spark.read.schema(rows.schema).json(path)


def _sessions(spark, sf) -> DataFrame:
    """Four conversations a question, as nested turns."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda t: F.struct(t.role.alias("role"), t.content.alias("content")))
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("turns"), F.min_by("text", "turn").alias("opening"), F.max_by("role", "turn").alias("closing"))
    each = F.array_sort(F.collect_list(F.struct("conv_id", "turns", "opening", "closing")))
    g = c.groupBy(F.floor(F.col("conv_id") / 4).alias("row")).agg(each.alias("s"))
    of = lambda f: F.transform("s", f)
    sid = lambda x: F.concat(F.lit("s"), x.conv_id)
    return g.select("row", F.concat(F.lit("q"), "row").alias("question_id"), F.concat(F.lit(" What came of s"), F.get("s", F.lit(0)).conv_id, F.lit("? ")).alias("question"), of(sid).alias("haystack_session_ids"), of(lambda x: x.turns).alias("haystack_sessions"), of(lambda x: F.when(x.conv_id % 2 == 0, F.substring(x.opening, 1, 80)).otherwise("")).alias("haystack_session_summaries"), F.get("s", F.lit(0)).closing.alias("closing"), F.substring(F.get("s", F.lit(0)).opening, 5, 12).alias("piece"))


_Q = "c AS (SELECT *, conv_id // 4 AS row FROM conversations), q AS (SELECT row, 'q' || row AS question_id, min(conv_id) AS first FROM c GROUP BY row)"
_LONG_TOKEN, _CHOICE_TOKEN, _OPEN_TOKEN = (f"printf('{t[1]}', row)" for t in (benchmarks.LONG, benchmarks.CHOICE, benchmarks.OPEN))


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("text", F.md5("text"))


@query(
    "src_official_a",
    f"""WITH {_Q}, d AS (SELECT c.row, question_id, conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth, role, trim(text) AS t FROM c JOIN q USING (row)),
e AS (SELECT row, {_LONG_TOKEN} || ' What came of s' || first || '?' AS query, 'lme_' || question_id || '_s' || first AS ids, (SELECT arg_max(role, turn) FROM conversations WHERE conv_id = first) AS answer FROM q)
SELECT 'corpus' AS part, 'lme:' || question_id || ':s' || conv_id || ':turn:' || lpad(nth::varchar, 4, '0') AS id, 'lme_' || question_id || '_s' || conv_id AS ids,
  md5({_LONG_TOKEN} || chr(10) || 'Question id: ' || question_id || chr(10) || 'Session id: s' || conv_id || chr(10) || 'Turn index: ' || nth || chr(10) || role || ': ' || t) AS text FROM d WHERE t <> ''
UNION ALL SELECT 'eval', query, ids, md5('') FROM e UNION ALL SELECT 'qa', query, ids, md5(answer) FROM e""",
)
def _(spark, sf):
    s = _sessions(spark, sf)
    rows = s.select("row", "question_id", "question", F.concat(F.lit(" "), "closing").alias("answer"), F.array(F.get("haystack_session_ids", F.lit(0)), F.lit("elsewhere")).alias("answer_session_ids"), "haystack_session_ids", "haystack_sessions")
    return _hashed(benchmarks.long_sessions(_json(spark, rows, "bench-a")).union())


@query(
    "src_official_b",
    f"""WITH {_Q}, s AS (SELECT row, conv_id, string_agg(role || ': ' || trim(text), chr(10) ORDER BY turn) FILTER (trim(text) <> '') AS said, arg_min(text, turn) AS opening FROM c GROUP BY ALL),
b AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN substr(opening, 1, 80) ELSE '' END AS summary FROM s), p AS (SELECT q.row, question_id, first, lower(trim(substr(opening, 5, 12))) AS piece, substr(opening, 5, 12) AS raw FROM q JOIN s ON s.conv_id = first),
h AS (SELECT b.*, question_id, first, piece, raw, CASE WHEN trim(summary) <> '' THEN trim(summary) ELSE trim(said) END AS body, piece <> '' AND contains(lower(summary || chr(10) || coalesce(said, '')), piece) AS holds FROM b JOIN p USING (row)),
e AS (SELECT row, {_CHOICE_TOKEN} || ' What came of s' || first || '?' AS query, string_agg('locomo_' || question_id || '_s' || conv_id, ',' ORDER BY conv_id) FILTER (holds) AS ids, max(trim(raw)) AS answer FROM h WHERE body <> '' GROUP BY row, first)
SELECT 'corpus' AS part, 'locomo:' || question_id || ':s' || conv_id AS id, 'locomo_' || question_id || '_s' || conv_id AS ids, md5({_CHOICE_TOKEN} || chr(10) || body) AS text FROM h WHERE body <> ''
UNION ALL SELECT 'eval', query, ids, md5('') FROM e WHERE ids IS NOT NULL UNION ALL SELECT 'qa', query, ids, md5(answer) FROM e WHERE ids IS NOT NULL AND answer <> ''""",
)
def _(spark, sf):
    rows = _sessions(spark, sf).select("row", "question_id", "question", F.col("piece").alias("answer"), "haystack_session_ids", "haystack_session_summaries", "haystack_sessions")
    return _hashed(benchmarks.choices(_json(spark, rows, "bench-b")).union())


@query(
    "src_official_c",
    f"""WITH x AS (SELECT item_id AS row, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) - 1 AS nth, d.source, trim(d.text) AS t, doc_id % 3 = 0 AS has, substr(b.text, 1, 30) AS question FROM benchmark b JOIN documents d ON d.doc_id % (SELECT count(*) FROM benchmark) = item_id),
e AS (SELECT row, {_OPEN_TOKEN} || ' ' || trim(any_value(question)) AS query, string_agg(printf('dmr_%05d_%02d', row, nth), ',' ORDER BY nth) FILTER (has) AS ids, string_agg(source, ',' ORDER BY nth) AS gold FROM x GROUP BY row)
SELECT 'corpus' AS part, printf('dmr:%05d:%02d', row, nth) AS id, printf('dmr_%05d_%02d', row, nth) AS ids, md5({_OPEN_TOKEN} || chr(10) || source || chr(10) || coalesce(t, '')) AS text FROM x
UNION ALL SELECT 'eval', query, ids, md5('') FROM e WHERE ids IS NOT NULL UNION ALL SELECT 'qa', query, ids, md5(gold) FROM e WHERE ids IS NOT NULL""",
)
def _(spark, sf):
    b = table(spark, sf, "benchmark")
    n = b.agg(F.count("*").alias("n"))
    d = table(spark, sf, "documents").crossJoin(F.broadcast(n))  # one row
    ctx = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.col("text").alias("text"), (F.col("doc_id") % 3 == 0).alias("hasanswer"), F.lit(False).alias("isgold"))
    each = d.groupBy((F.col("doc_id") % F.col("n")).alias("item_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", ctx.alias("c")))), lambda x: x.c).alias("ctxs"))
    rows = each.join(b, "item_id").select(F.col("item_id").alias("row"), F.substring("text", 1, 30).alias("question"), F.transform("ctxs", lambda x: x.title).alias("answers"), "ctxs")
    return _hashed(benchmarks.open_domain(_json(spark, rows, "bench-c")).union())


# Records, each with its own schema, appended in two writes


def _appended(spark, name: str, rows: DataFrame, late) -> DataFrame:
    return store.appended(spark, name, rows.where(~late), rows.where(late))


@query("snk_chunk_insert", "SELECT 'd' || doc_id AS chunk_id, source AS source_id, sha1(text) AS content_hash, length(text) AS n_chars FROM documents")
def _(spark, sf):
    rows = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("chunk_id"), F.col("source").alias("source_id"), F.sha1("text").alias("content_hash"), F.length("text").cast("long").alias("n_chars"), "doc_id")
    return _appended(spark, "chunks", rows, F.col("doc_id") % 2 == 1).drop("doc_id")


@query("snk_audit", "SELECT event_id AS audit_id, 'u' || user_id AS actor, event_type AS action, 'value' AS target_type, floor(value)::bigint::varchar AS target_id, ts AS at, 'k=' || json_extract_string(props, '$.k') AS detail FROM events")
def _(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("audit_id"), F.concat(F.lit("u"), "user_id").alias("actor"), F.col("event_type").alias("action"), F.lit("value").alias("target_type"), F.floor("value").cast("string").alias("target_id"), F.col("ts").alias("at"), F.concat(F.lit("k="), F.get_json_object("props", "$.k")).alias("detail"))
    return _appended(spark, "audit", rows, F.col("audit_id") % 2 == 1)


@query("snk_cos_insert", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS sequence, md5(text) AS summary FROM conversations WHERE role = 'assistant'")
def _(spark, sf):
    """Carry-over summaries: what comes later goes on with the sequence that is there."""
    c = table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.md5("text").alias("summary"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    first = c.where("turn < 4").withColumn("sequence", F.row_number().over(w) - 1).drop("turn")
    there = store.appended(spark, "cos", first)
    last = there.groupBy("conv_id").agg(F.max("sequence").alias("last"))
    then = c.where("turn >= 4").join(last, "conv_id", "left").withColumn("sequence", F.row_number().over(w) + F.coalesce("last", F.lit(-1))).select(*first.columns)
    return there.unionByName(store.appended(spark, "cos", then)).select("conv_id", F.col("sequence").cast("long").alias("sequence"), "summary")


@query("snk_skill_insert", "SELECT sha1('skill ' || item_id) AS skill_id, 'skill ' || item_id AS name, len(list_filter(string_split(text, '.'), lambda x: trim(x) <> '')) AS n_steps, 'active' AS status FROM benchmark")
def _(spark, sf):
    name = F.concat(F.lit("skill "), "item_id")
    steps = F.filter(F.split("text", r"\."), lambda x: F.trim(x) != "")
    rows = table(spark, sf, "benchmark").select("item_id", F.sha1(name).alias("skill_id"), name.alias("name"), steps.alias("steps"), F.lit("active").alias("status"))
    return _appended(spark, "skills", rows, F.col("item_id") % 2 == 1).select("skill_id", "name", F.size("steps").cast("long").alias("n_steps"), "status")


@query("snk_evidence_insert", "SELECT source AS claim, count(*) AS n_sources, min('d' || doc_id) AS first_source, round(avg(quality), 9) AS confidence FROM documents JOIN labels USING (doc_id) GROUP BY source")
def _(spark, sf):
    """Evidence packs: a claim, its sources, a confidence."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("source", F.concat(F.lit("d"), "doc_id").alias("id"), "quality")
    packs = d.groupBy(F.col("source").alias("claim")).agg(F.array_sort(F.collect_list("id")).alias("sources"), F.round(F.avg("quality"), 9).alias("confidence"))
    return store.appended(spark, "evidence", packs).select("claim", F.size("sources").cast("long").alias("n_sources"), F.get("sources", F.lit(0)).alias("first_source"), "confidence")


@query("snk_reasoning_insert", "SELECT item_id AS entry_id, substr(text, 1, 40) AS title, md5(text) AS content, 'active' AS status, 'e' || item_id || ',e' || (item_id + 1) AS evidence FROM benchmark")
def _(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("entry_id"), F.substring("text", 1, 40).alias("title"), F.md5("text").alias("content"), F.array(F.concat(F.lit("e"), "item_id"), F.concat(F.lit("e"), F.col("item_id") + 1)).alias("evidence_ids"), F.lit("active").alias("status"))
    return _appended(spark, "reasoning", b, F.col("entry_id") % 2 == 1).select("entry_id", "title", "content", "status", F.array_join("evidence_ids", ",").alias("evidence"))


@query("snk_file_register", "SELECT sha256(html) AS sha, min(page_id) AS first_page, count(*) AS n_seen, max(strlen(html))::bigint AS size FROM pages GROUP BY 1")
def _(spark, sf):
    """Files by hash; a second registration counts and keeps the first place."""
    seen = table(spark, sf, "pages").select(F.sha2("html", 256).alias("sha"), F.col("page_id").alias("first_page"), F.lit(1).cast("long").alias("n_seen"), F.octet_length("html").cast("long").alias("size"))
    register = store.Versions(spark, store.scratch(spark, "register"))
    for late in (0, 1):
        out = register.merge(seen.where(F.col("first_page") % 2 == late), ["sha"], first_page=F.min("first_page"), n_seen=F.sum("n_seen"), size=F.max("size"))
    return out


# Merges into tables that are there


@query("snk_session_start_end", "SELECT conv_id, min(turn) AS started, CASE WHEN count(*) > 2 THEN max(turn) END AS ended, count(*) > 2 AS closed FROM conversations GROUP BY conv_id")
def _(spark, sf):
    """Sessions are opened, then those of more than two turns are closed."""
    c = table(spark, sf, "conversations")
    opened = c.groupBy("conv_id").agg(F.min("turn").alias("started")).withColumn("ended", F.lit(None).cast("long")).withColumn("closed", F.lit(False))
    closed = c.groupBy("conv_id").agg(F.max("turn").alias("ended"), F.count("*").alias("n")).where("n > 2").select("conv_id", F.lit(None).cast("long").alias("started"), "ended", F.lit(True).alias("closed"))
    known = store.Versions(spark, store.scratch(spark, "sessions"))
    known.merge(opened, ["conv_id"])
    return known.merge(closed, ["conv_id"], started=F.min("started"), ended=F.max("ended"), closed=F.max("closed"))


@query(
    "snk_consolidated_upsert",
    "SELECT source AS cluster_key, count(*) AS n_chunks, md5(string_agg(doc_id::varchar, ',' ORDER BY doc_id % 2, doc_id)) AS chunk_ids, CASE WHEN bool_or(doc_id % 2 = 1) THEN 'second' ELSE 'first' END AS summary FROM documents GROUP BY source",
)
def _(spark, sf):
    """Consolidated memories by cluster: a later run replaces the summary and adds its chunks."""
    d = table(spark, sf, "documents")
    run = lambda late, summary: d.where(F.col("doc_id") % 2 == late).groupBy(F.col("source").alias("cluster_key")).agg(F.array_sort(F.collect_list("doc_id")).alias("chunk_ids")).withColumn("summary", F.lit(summary))
    known = store.Versions(spark, store.scratch(spark, "consolidated"))
    for late, summary in ((0, "first"), (1, "second")):
        out = known.merge(run(late, summary), ["cluster_key"], chunk_ids=store.ordered_union(F.col("chunk_ids"), F.col("newer")))
    return out.select("cluster_key", F.size("chunk_ids").cast("long").alias("n_chunks"), F.md5(F.array_join("chunk_ids", ",")).alias("chunk_ids"), "summary")


@query(
    "snk_entity_upsert",
    """WITH h AS (SELECT lower(trim(source)) AS name, doc_id % 2 AS late, max(n_chars) AS longest, min(doc_id) AS first FROM documents GROUP BY ALL)
SELECT name AS normalized_name, max(CASE WHEN late = 1 THEN '  ' || upper(name) ELSE name || ' ' END) FILTER (late = (SELECT max(late) FROM h x WHERE x.name = h.name)) AS name, arg_max(longest, late)::varchar AS longest, min(first) FILTER (late = 0)::varchar AS first, max(first) FILTER (late = 1)::varchar AS last FROM h GROUP BY name""",
)
def _(spark, sf):
    """Entities by normalised name; of their metadata the newer values win, older keys stay."""
    d = table(spark, sf, "documents").withColumn("n", F.lower(F.trim("source")))
    meta = lambda late: F.create_map(F.lit("longest"), F.max("n_chars").cast("string"), F.lit("last" if late else "first"), F.min("doc_id").cast("string"))
    shown = lambda late: F.concat(F.lit("  "), F.upper("normalized_name")) if late else F.concat("normalized_name", F.lit(" "))
    known = store.Versions(spark, store.scratch(spark, "entities"))
    for late in (0, 1):
        rows = d.where(F.col("doc_id") % 2 == late).groupBy(F.col("n").alias("normalized_name")).agg(meta(late).alias("metadata")).withColumn("name", shown(late))
        out = known.merge(rows, ["normalized_name"], metadata=store.new_wins(F.col("metadata")))
    return out.select("normalized_name", "name", *[F.col("metadata")[k].alias(k) for k in ("longest", "first", "last")])


@query("snk_embed_cache", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'second' ELSE 'first' END AS model, round(embedding[1] * CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END, 6)::double AS head FROM embeddings")
def _(spark, sf):
    """Cached vectors by text; a vector that is computed anew replaces the one that is there."""
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    cache = store.Versions(spark, store.scratch(spark, "embed-cache"))
    cache.merge(v.withColumn("model", F.lit("first")), ["vec_id"])
    out = cache.merge(v.where("vec_id % 3 = 0").select("vec_id", F.transform("embedding", lambda x: x * 2).alias("embedding"), F.lit("second").alias("model")), ["vec_id"])
    return out.select("vec_id", "model", F.round(F.get("embedding", F.lit(0)), 6).alias("head"))


@query("snk_mark_chunk_superseded", "SELECT doc_id, 'e' || doc_id % 50 AS entry, CASE WHEN (doc_id % 50) % 7 = 0 THEN 'superseded' ELSE 'active' END AS status, source FROM documents")
def _(spark, sf):
    """Chunks carry their reasoning entry in their metadata; that of a superseded entry gets a status there, the rest of it stays."""
    meta = F.to_json(F.struct(F.concat(F.lit("e"), F.col("doc_id") % 50).alias("reasoning_entry_id"), F.lit("active").alias("entry_status"), "source"))
    chunks = store.appended(spark, "chunks", table(spark, sf, "documents").select("doc_id", meta.alias("metadata")))
    gone = spark.range(50).where("id % 7 = 0").select(F.concat(F.lit("e"), "id").alias("entry"), F.lit("superseded").alias("mark"))
    m = F.from_json("metadata", "map<string,string>")
    linked = chunks.select("doc_id", m.alias("m")).withColumn("entry", F.col("m")["reasoning_entry_id"]).join(F.broadcast(gone), "entry", "left")  # 8 rows
    status = F.map_from_arrays(F.array(F.lit("entry_status")), F.array("mark"))
    merged = F.when(F.col("mark").isNotNull(), F.map_concat(F.map_filter("m", lambda k, _: k != "entry_status"), status)).otherwise(F.col("m"))
    return linked.select("doc_id", F.to_json(merged).alias("metadata")).select("doc_id", *[F.get_json_object("metadata", p).alias(n) for n, p in (("entry", "$.reasoning_entry_id"), ("status", "$.entry_status"), ("source", "$.source"))])


@query("jn_reasoning_link", "SELECT doc_id, b.item_id AS entry_id, md5(b.text) AS content FROM documents JOIN benchmark b ON b.item_id = doc_id % 50")
def _(spark, sf):
    """Chunks and the reasoning entries that their metadata names."""
    meta = F.to_json(F.struct((F.col("doc_id") % 50).alias("reasoning_entry_id"), "source"))
    chunks = table(spark, sf, "documents").select("doc_id", F.try_variant_get(F.parse_json(meta), "$.reasoning_entry_id", "long").alias("item_id"))
    return chunks.join(table(spark, sf, "benchmark"), "item_id").select("doc_id", F.col("item_id").alias("entry_id"), F.md5("text").alias("content"))


@query(
    "snk_fact_supersede",
    f"""WITH {FACTS_SQL}, g AS (SELECT *, lower(trim(value)) AS vk FROM facts WHERE confidence >= 0.55 AND relation_key = 'signup'),
c AS (SELECT *, vk IS DISTINCT FROM lag(vk) OVER w OR row_number() OVER w = 1 AS new FROM g WINDOW w AS (PARTITION BY entity_key, relation_key ORDER BY created_at, fact_id)),
n AS (SELECT fact_id, lead(fact_id) OVER w AS superseded_by, lead(created_at) OVER w AS transaction_to, CASE WHEN lead(fact_id) OVER w IS NOT NULL THEN coalesce(nullif(lead(fact_date) OVER w, ''), strftime(lead(created_at) OVER w, '%Y-%m-%d')) END AS valid_to FROM c WHERE new WINDOW w AS (PARTITION BY entity_key, relation_key ORDER BY created_at, fact_id))
SELECT * FROM n""",
)
def _(spark, sf):
    """Facts of a relation with one value at a time: the fact that changes the value closes the one before, in the time it speaks of and in the time it was written."""
    return fx.closed(facts(spark, sf).where("confidence >= 0.55"), ("signup",)).select("fact_id", "superseded_by", "transaction_to", "valid_to")


# Compressed vault


def _codecs() -> dict:
    import zstandard

    return {"raw": (bytes, bytes), "zstd": (zstandard.ZstdCompressor(10).compress, zstandard.ZstdDecompressor().decompress), "gzip": (lambda b: gzip.compress(b, 9, mtime=0), gzip.decompress), "zlib": (lambda b: zlib.compress(b, 9), zlib.decompress)}


def packed(content: Column) -> Column:
    """struct(codec, data): the smallest form of the bytes."""

    @F.pandas_udf(T.StructType().add("codec", "string").add("data", "binary"))
    def run(s: pd.Series) -> pd.DataFrame:
        codecs = _codecs()
        return pd.DataFrame([min(((name, enc(bytes(b))) for name, (enc, _) in codecs.items()), key=lambda x: (len(x[1]), x[0])) for b in s], columns=["codec", "data"])

    return run(content)


def unpacked(codec: Column, data: Column) -> Column:
    @F.pandas_udf("binary")
    def run(c: pd.Series, d: pd.Series) -> pd.Series:
        codecs = _codecs()
        return pd.Series([codecs[name][1](bytes(b)) for name, b in zip(c, d, strict=True)])

    return run(codec, data)


@query("snk_vault_compressed", "SELECT DISTINCT sha256(text) AS sha, sha256(text) AS back, strlen(text)::bigint AS size FROM documents")
def _(spark, sf):
    """Contents stored once in the smallest of four forms, read back and unpacked."""
    once = store.addressed(table(spark, sf, "documents"), F.col("text"))
    stored = store.appended(spark, "vault", once.select("sha", packed(F.col("content").cast("binary")).alias("p")).select("sha", "p.*"))
    back = stored.select("sha", unpacked(F.col("codec"), F.col("data")).alias("content"))
    return back.select("sha", F.sha2("content", 256).alias("back"), F.length("content").cast("long").alias("size"))
