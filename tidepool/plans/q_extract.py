"""Extraction queries over whole texts: facts, graph, dates, tables, typed tokens, templates of chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.operators import extract
from tidepool.plans.registry import query
from tidepool.plans.tables import LINES_SQL, NOTES_SQL, dealt, log_lines, notes, table

#: Documents of a task that reads whole texts for relations.
TEXTS = 1024


def sentences_sql(text: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace(coalesce({text}, ''), '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _cleaned_sql(x: str) -> str:
    x = rf"regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '^[ ,;:.]+|[ ,;:.]+$', '', 'g')"
    return rf"regexp_replace(regexp_replace({x}, '(?i)^(?:and|but|or)\s+', ''), '(?i)^(?:the|a|an)\s+', '')"


def _place_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace({_cleaned_sql(x)}, '(?i)\s+(?:last|this|next)\s+(?:day|week|month|year|spring|summer|fall|autumn|winter)\b.*$', ''), '(?i)\s+(?:today|yesterday|recently|currently)\b.*$', '')"


def _preference_sql(x: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({x}), '{w}')" for w in words) + f" THEN '{relation}'" for relation, words in extract.PREFERENCES) + " END"


def _facts_sql(source: str, id_col: str, patterns) -> str:
    parts = []
    for k, (p, stated) in enumerate(patterns):
        group = lambda g, p=p: f"regexp_extract(sentence, '(?i){_q(p)}', {g})"
        for j, (entity, relation, value, confidence) in enumerate(stated):
            two = f"{group(1)} || ' ' || {group(2)}" if len(stated) > 1 else group(1)
            kind = _preference_sql(two) if relation is None else f"CASE WHEN {_preference_sql(group(value))} = 'notebook' THEN 'notebook' END" if relation == "notebook?" else f"'{relation}'"
            raw = f"regexp_replace({group(value)}, '^[A-Za-z][A-Za-z ]{{0,40}}:\\s*', '')" if "became" in p else group(value)
            who = f"'{entity}'" if isinstance(entity, str) else f"regexp_replace(trim({group(entity)}), '\\s+', ' ', 'g')"
            what = _place_sql(raw) if relation == "location" else _cleaned_sql(raw)
            parts.append(f"SELECT {id_col}, nth, date, {10 * k + j} AS k, {who} AS who, {kind} AS relation, {what} AS value, {confidence}::double AS confidence FROM sent WHERE regexp_matches(sentence, '(?i){_q(p)}')")
    hint = "coalesce(" + ", ".join(f"nullif(regexp_extract(sentence, '(?i){_q(p)}'), '')" for p in extract.DATES) + ", '')"
    selves = ", ".join(f"'{s}'" for s in extract.SELF)
    return f"""sent0 AS (SELECT {id_col}, unnest(range(len(s))) AS nth, unnest(s) AS sentence FROM (SELECT {id_col}, {sentences_sql('text')} AS s FROM {source})),
sent AS (SELECT *, {hint} AS date FROM sent0),
found AS (SELECT * EXCLUDE (who), CASE WHEN lower(who) IN ({selves}) THEN 'User' ELSE who END AS entity FROM ({' UNION ALL '.join(parts)})),
once AS (SELECT *, row_number() OVER (PARTITION BY {id_col}, lower(entity), relation, lower(value), lower(date) ORDER BY nth, k) AS again FROM found WHERE entity <> '' AND relation IS NOT NULL AND value <> ''),
placed AS (SELECT *, row_number() OVER (PARTITION BY {id_col} ORDER BY nth, k) AS place FROM once WHERE again = 1)
SELECT {id_col}, place, entity, relation, value, date, confidence FROM placed WHERE place <= {extract.MOST_FACTS}"""


@query("ext_facts", f"WITH {NOTES_SQL}, {_facts_sql('notes', 'note_id', extract.STATEMENTS + extract.RELATIONS)}")
def _(spark, sf):
    return extract.facts(notes(spark, sf), "note_id", "text")


@query("ext_fact_relations", f"WITH {NOTES_SQL}, {_facts_sql('notes', 'note_id', extract.RELATIONS)}")
def _(spark, sf):
    return extract.facts(notes(spark, sf), "note_id", "text", extract.RELATIONS)


_STOP = ", ".join(f"'{w}'" for w in extract.STOP)
_MASKED = r"regexp_replace({}, '[^\x00-\x7F\P{{L}}]', '_', 'g')"
_ENTITIES = rf"""es AS (SELECT doc_id, unnest(range(len(s))) AS nth, unnest(s) AS sentence FROM (SELECT doc_id, {sentences_sql('text')} AS s FROM documents)),
en AS (SELECT doc_id, nth, list_concat(list_filter(regexp_extract_all({_MASKED.format('sentence')}, '\b(?:[A-Z][a-z0-9]+(?:\s+[A-Z][a-z0-9]+){{0,3}}|[A-Z]{{2,6}}\d*)\b'), lambda x: lower(x) NOT IN ({_STOP})),
  list_filter(regexp_extract_all(lower(sentence), '[a-z0-9_\-]{{4,}}'), lambda x: x NOT IN ({_STOP}) AND NOT regexp_matches(x, '^[0-9]+$'))) AS names FROM es),
ee AS (SELECT doc_id, entity, min(nth * 100000 + i) AS first FROM (SELECT doc_id, nth, unnest(range(len(names))) AS i, unnest(names) AS entity FROM en) GROUP BY ALL),
entities AS (SELECT doc_id, entity, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS place, CASE WHEN regexp_matches(entity, '^[A-Z0-9 ]+$') THEN 0.82 WHEN regexp_matches(entity, '^[A-Z]') THEN 0.74 ELSE 0.42 END::double AS confidence FROM ee QUALIFY place <= {extract.ENTITIES})"""


def _entities(spark, sf):
    each = table(spark, sf, "documents").select("doc_id", F.posexplode(extract.entities(extract.text.sentences(F.col("text")))).alias("place", "entity"))
    return each.select("doc_id", "entity", (F.col("place") + 1).alias("place"), extract.entity_confidence(F.col("entity")).alias("confidence"))


query("ext_graph", f"WITH {_ENTITIES} SELECT * FROM entities")(_entities)


def _anchor_sql(side: str, left: bool) -> str:
    tokens = rf"list_filter(regexp_extract_all({side}, '[A-Za-z0-9_\-]{{2,}}'), lambda x: lower(x) NOT IN ({_STOP}))"
    near = f"{tokens}[-3:]" if left else f"{tokens}[1:3]"
    return f"(SELECT coalesce(CASE WHEN len(w) >= 2 AND regexp_matches(w[1], '^[A-Z]') AND regexp_matches(w[2], '^[A-Z]') THEN w[1] || ' ' || w[2] ELSE w[{'len(w)' if left else '1'}] END, '') FROM (SELECT {near} AS w))"


def _edges_sql() -> str:
    parts = []
    for k, (verb, relation, confidence) in enumerate(extract.VERBS):
        p = rf"(?i)^(.*?)\b(?:{verb})\b"
        parts.append(f"SELECT doc_id, nth, {k} AS k, '{relation}' AS relation, {confidence}::double AS base, substr(sentence, 1, length(regexp_extract(plain, '{p}', 1))) AS l, substr(sentence, length(regexp_extract(plain, '{p}', 0)) + 1) AS r FROM masked WHERE regexp_matches(plain, '{p}')")
    bonus = lambda side: f"CASE WHEN EXISTS (SELECT 1 FROM entities e WHERE e.doc_id = x.doc_id AND e.entity = x.{side}) THEN 0.08 ELSE 0.0 END::double"
    return f"""masked AS (SELECT *, {_MASKED.format('sentence')} AS plain FROM es), sides AS ({' UNION ALL '.join(parts)}),
ends AS (SELECT *, {_anchor_sql('l', True)} AS src, {_anchor_sql('r', False)} AS dst FROM sides),
rel AS (SELECT *, row_number() OVER (PARTITION BY doc_id, src, relation, dst ORDER BY nth, k) AS again FROM ends WHERE src <> '' AND dst <> '' AND lower(src) <> lower(dst)),
edges AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY nth, k) AS place, src, relation, dst, round(greatest(0.05, least(0.99, base + {bonus('src')} + {bonus('dst')})), 6) AS confidence FROM rel x WHERE again = 1 QUALIFY place <= {extract.EDGES})"""


def _edges(spark, sf):
    return extract.relations(dealt(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", rows=TEXTS), "doc_id", "text")


query("ext_graph_anchor", f"WITH {_ENTITIES}, {_edges_sql()} SELECT * FROM edges")(_edges)

_CALIBRATED = f"""WITH {_ENTITIES}, {_edges_sql()}, m AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)
SELECT doc_id, place, round(greatest(0.2, least(0.99, confidence + CASE WHEN quality = 1 THEN 0.08 ELSE 0.0 END + CASE WHEN quality = 0 THEN 0.08 ELSE 0.0 END + CASE WHEN source IS NOT NULL THEN 0.02 ELSE 0.0 END)), 6)::double AS confidence FROM edges JOIN documents USING (doc_id) LEFT JOIN m USING (doc_id)"""


@query("ext_graph_calibrate", _CALIBRATED)
def _(spark, sf):
    """The origin of a document is told by its label: of quality as reasoning, without as evidence; a source stands for a session."""
    origin = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = _edges(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").join(origin, "doc_id", "left")
    score = extract.calibrated(F.col("confidence"), "edge", F.col("quality") == 1, F.col("quality") == 0, F.col("source").isNotNull())
    return rows.select("doc_id", "place", F.round(score, 6).alias("confidence"))


@query(
    "ext_graph_apply",
    f"""WITH {_ENTITIES}, {_edges_sql()}, n AS (SELECT doc_id, place, lower(src) AS src, relation, lower(dst) AS dst, confidence FROM edges WHERE confidence >= 0.55),
f AS (SELECT *, CASE WHEN relation IN ('is', 'prefers', 'owns') THEN dst IS NOT DISTINCT FROM lag(dst) OVER (PARTITION BY src, relation ORDER BY doc_id, place) ELSE row_number() OVER (PARTITION BY src, relation, dst ORDER BY doc_id, place) > 1 END AS known FROM n),
v AS (SELECT *, CASE WHEN relation IN ('is', 'prefers', 'owns') THEN lead(doc_id) OVER (PARTITION BY src, relation ORDER BY doc_id, place) END AS valid_to FROM f WHERE NOT known)
SELECT src, relation, dst, doc_id AS valid_from, valid_to, CASE WHEN valid_to IS NULL THEN 'active' ELSE 'inactive' END AS status, confidence FROM v""",
)
def _(spark, sf):
    return extract.applied(_edges(spark, sf), ["doc_id", "place"])


def _mentions_sql(source: str, id_col: str) -> str:
    parts = []
    for p, y, m, d in extract.KINDS:
        every = lambda g, p=p: f"regexp_extract_all(text, '(?i){_q(p)}', {g})"
        parts.append(f"SELECT {id_col}, unnest({every(0)}) AS raw, unnest({every(y)}) AS y, unnest({every(m)}) AS m, unnest({every(d)}) AS d FROM {source}")
    months = "['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec']"
    return f"""every AS ({' UNION ALL '.join(parts)}),
dated AS (SELECT {id_col}, raw, CASE WHEN try_cast(y AS INT) < 70 THEN try_cast(y AS INT) + 2000 WHEN try_cast(y AS INT) < 100 THEN try_cast(y AS INT) + 1900 ELSE try_cast(y AS INT) END AS year,
  CASE WHEN regexp_matches(m, '^[0-9]+$') THEN try_cast(m AS INT) ELSE list_position({months}, lower(substr(m, 1, 3))) END AS month, try_cast(d AS INT) AS day FROM every),
usual AS (SELECT {id_col}, first(year ORDER BY n DESC, year) AS usual FROM (SELECT {id_col}, year, count(*) AS n FROM dated WHERE year IS NOT NULL GROUP BY ALL) GROUP BY {id_col}),
mentions AS (SELECT DISTINCT {id_col}, raw, try_cast(printf('%04d-%02d-%02d', coalesce(year, usual, 2000)::int, month::int, day) AS DATE) AS parsed FROM dated LEFT JOIN usual USING ({id_col}))"""


@query("ext_temporal", f"WITH {NOTES_SQL}, {_mentions_sql('notes', 'note_id')} SELECT note_id, raw, strftime(parsed, '%Y-%m-%d') AS parsed FROM mentions WHERE parsed IS NOT NULL")
def _(spark, sf):
    return extract.mentions(notes(spark, sf), "note_id", "text").withColumn("parsed", F.date_format("parsed", "yyyy-MM-dd"))


@query(
    "qa_temporal_enrich",
    f"""WITH {NOTES_SQL}, {_mentions_sql('notes', 'note_id')}, o AS (SELECT note_id, parsed, row_number() OVER (PARTITION BY note_id ORDER BY parsed) AS nth FROM (SELECT DISTINCT note_id, parsed FROM mentions WHERE parsed IS NOT NULL)),
p AS (SELECT a.note_id, a.parsed AS a, b.parsed AS b, date_diff('day', a.parsed, b.parsed) AS days FROM o a JOIN o b ON a.note_id = b.note_id AND b.nth > a.nth AND b.nth <= a.nth + 3)
SELECT note_id, string_agg('- ' || a || ' to ' || b || ': ' || days || ' days (' || days // 7 || CASE WHEN days // 7 = 1 THEN ' week)' ELSE ' weeks)' END, chr(10) ORDER BY a, b) AS facts FROM p GROUP BY note_id""",
)
def _(spark, sf):
    gaps = extract.day_gaps(extract.mentions(notes(spark, sf), "note_id", "text"), "note_id")
    weeks = F.floor(F.col("days") / 7)
    line = F.concat(F.lit("- "), F.col("a").cast("string"), F.lit(" to "), F.col("b").cast("string"), F.lit(": "), "days", F.lit(" days ("), weeks, F.when(weeks == 1, " week)").otherwise(" weeks)"))
    listed = F.array_sort(F.collect_list(F.struct("a", "b", line.alias("line"))))
    return gaps.groupBy("note_id").agg(F.array_join(F.transform(listed, lambda x: x.line), "\n").alias("facts"))


def _sheets(spark, sf):
    """A rota of each nation's suppliers as markdown, between two lines of prose."""
    s = table(spark, sf, "supplier")
    row = F.concat(F.lit("| "), "s_name", F.lit(" | "), F.round("s_acctbal").cast("long"), F.lit(" | day "), F.col("s_suppkey") % 7, F.lit(" |"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("row")))), lambda x: x.row), "\n")
    head = "Rota of the week.\n| Name | Balance | Shift |\n|---|:---:|---|\n"
    return s.groupBy(F.col("s_nationkey").alias("sheet_id")).agg(F.concat(F.lit(head), rows, F.lit("\nThat is all. | no table\n| a | b |")).alias("text"))


@query("ext_tables", "SELECT s_nationkey AS sheet_id, 3 + row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS line, unnest(['Name', 'Balance', 'Shift']) AS header, unnest([s_name, round(s_acctbal)::bigint::varchar, 'day ' || s_suppkey % 7]) AS cell, s_name AS label FROM supplier")
def _(spark, sf):
    return extract.table_cells(_sheets(spark, sf), "sheet_id", "text")


_RAW = "raw AS (SELECT event_id AS line_no, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z ' || event_type || ' rid=' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || ' sig=' || substr(h, 1, 20) || ' n=' || (event_id + 12345678) || ' u' || user_id AS line FROM (SELECT *, md5(event_id::varchar) AS h FROM events))"


def _raw_lines(spark, sf):
    h = F.md5(F.col("event_id").cast("string"))
    part = lambda a, n: F.substring(h, a, n)
    uuid = F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z "), "event_type", F.lit(" rid="), uuid, F.lit(" sig="), part(1, 20), F.lit(" n="), F.col("event_id") + 12345678, F.lit(" u"), "user_id")
    return table(spark, sf, "events").select(F.col("event_id").alias("line_no"), line.alias("line"))


@query(
    "ext_canon_typed",
    rf"WITH {_RAW}, t AS (SELECT line_no, line, regexp_replace(line, '{extract.TYPED_PATTERN}', '<@>', 'g') AS canonical, regexp_extract_all(line, '{extract.TYPED_PATTERN}') AS raw FROM raw) SELECT line_no, canonical, array_to_string(list_transform(raw, lambda x: CASE WHEN contains(x, ':') THEN 'TS' WHEN contains(x, '-') THEN 'UUID' WHEN length(x) >= 16 THEN 'HEX' ELSE 'INT' END || '=' || x), ';') AS tokens, true AS same FROM t",
)
def _(spark, sf):
    """Lines, their typed tokens, and whether the two give the line again."""
    canonical, tokens = extract.typed(F.col("line"))
    rows = _raw_lines(spark, sf).select("line_no", "line", canonical.alias("canonical"), tokens.alias("t"))
    return rows.select("line_no", "canonical", F.array_join(F.transform("t", lambda x: F.concat(x.kind, F.lit("="), x.raw)), ";").alias("tokens"), (extract.reinflated(F.col("canonical"), F.col("t")) == F.col("line")).alias("same"))


@query(
    "ext_template_chunk",
    f"""WITH {LINES_SQL}, w AS (SELECT line_no // 64 AS chunk, line_no, string_split(text, ' ') AS t FROM lines), p AS (SELECT chunk, len(t) AS n, t[1] AS head, line_no, unnest(range(len(t))) AS i, unnest(t) AS token FROM w),
m AS (SELECT chunk, n, head, i, CASE WHEN count(DISTINCT token) = 1 THEN min(token) ELSE '<*>' END AS token, count(*) AS n_lines FROM p GROUP BY ALL)
SELECT chunk, string_agg(token, ' ' ORDER BY i) AS template, max(n_lines) AS n_lines, count(*) FILTER (token = '<*>') AS n_slots FROM m GROUP BY chunk, n, head""",
)
def _(spark, sf):
    """Templates of every 64 lines: lines of a length and a first token are one template, whose other tokens stay where all lines agree."""
    lines = log_lines(spark, sf).select(F.floor(F.col("line_no") / 64).alias("chunk"), F.split("text", " ").alias("t"))
    each = lines.select("chunk", F.size("t").alias("n"), F.get("t", F.lit(0)).alias("head"), F.posexplode("t").alias("i", "token"))
    place = each.groupBy("chunk", "n", "head", "i").agg(F.when(F.min("token") == F.max("token"), F.min("token")).otherwise("<*>").alias("token"), F.count("*").alias("n_lines"))
    tokens = F.transform(F.array_sort(F.collect_list(F.struct("i", "token"))), lambda x: x.token)
    return place.groupBy("chunk", "n", "head").agg(F.array_join(tokens, " ").alias("template"), F.max("n_lines").alias("n_lines"), F.count_if(F.col("token") == "<*>").alias("n_slots")).select("chunk", "template", "n_lines", "n_slots")


@query("ret_chain_entities", r"""WITH f AS (SELECT doc_id, list_filter(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F\P{L}]', '_', 'g'), '\b([A-Z][\w-]+(?:[ \t\n]+[A-Z][\w-]+){0,3})\b'), lambda x: x NOT IN ('The', 'This', 'That', 'And', 'A', 'An', 'I')) AS l FROM documents),
e AS (SELECT doc_id, entity, min(i) AS first FROM (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS entity FROM f) GROUP BY ALL) SELECT doc_id, entity, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS place FROM e QUALIFY place <= 8""")
def _(spark, sf):
    """The first eight different capitalised spans of every text."""
    stop = F.array(*[F.lit(w) for w in ("The", "This", "That", "And", "A", "An", "I")])
    found = F.regexp_extract_all(extract.masked(F.col("text")), F.lit(r"\b([A-Z][\w-]+(?:[ \t\n]+[A-Z][\w-]+){0,3})\b"), F.lit(0))
    first = F.slice(F.array_distinct(F.filter(found, lambda x: ~F.array_contains(stop, x))), 1, 8)
    return table(spark, sf, "documents").select("doc_id", F.posexplode(first).alias("place", "entity")).select("doc_id", "entity", (F.col("place") + 1).alias("place"))
