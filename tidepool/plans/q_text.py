"""Text, extraction, question and summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.operators import ranking, search, text
from tidepool.plans.registry import query
from tidepool.plans.tables import table

_LINES = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def _docs(spark, sf):
    return table(spark, sf, "documents")


@query("ext_sentences", r"SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", text.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query("ext_token_est", r"SELECT doc_id, greatest(ceil(length(regexp_replace(text, '[ \n\t\r]', '', 'g')) / 4.0)::bigint, len(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS n FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", text.token_estimate(F.col("text")).alias("n"))


_PII = "SELECT doc_id, kind, n FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, len(regexp_extract_all(text, '{p}')) AS n FROM documents" for k, p in text.PII.items()) + ") WHERE n > 0"


@query("ext_pii", _PII)
def _(spark, sf):
    return text.pii(_docs(spark, sf), "doc_id", "text")


_RED = "text"
for _k, _p in text.PII.items():
    _RED = f"regexp_replace({_RED}, '{_p}', '[{_k.upper()}]', 'g')"


@query("cmp_redact", f"SELECT doc_id, md5({_RED}) AS digest FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(text.redacted(F.col("text"))).alias("digest"))


_CANON = "text"
for _p, _to in ((r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?", "<TS>"), (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<UUID>"), (r"0x[0-9a-fA-F]+", "<HEX>"), (r"[0-9]+", "<INT>"), (r"[ \t]+", " ")):
    _CANON = f"regexp_replace({_CANON}, '{_p}', '{_to}', 'g')"


@query("ext_canon_lossy", f"SELECT page_id, md5(trim({_CANON.replace('text', 'html', 1)})) AS digest FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(text.canonical(F.col("html"))).alias("digest"))


@query("ext_canon_lossless", "SELECT doc_id, md5(regexp_replace(text, '[0-9]+', '{}', 'g')) AS digest, array_to_string(regexp_extract_all(text, '[0-9]+'), ',') AS numbers FROM documents")
def _(spark, sf):
    template, numbers = text.number_template(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.md5(template).alias("digest"), F.array_join(numbers, ",").alias("numbers"))


@query("ext_date_hint", r"SELECT page_id, coalesce(nullif(regexp_extract(html, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), ''), nullif(regexp_extract(html, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}'), ''), nullif(regexp_extract(html, '(19|20)[0-9]{2}'), '')) AS hint FROM pages")
def _(spark, sf):
    hit = lambda p: F.nullif(F.regexp_extract("html", p, 0), F.lit(""))
    return table(spark, sf, "pages").select("page_id", F.coalesce(hit("[0-9]{4}-[0-9]{2}-[0-9]{2}"), hit("[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}"), hit("(19|20)[0-9]{2}")).alias("hint"))


@query("ext_role", "SELECT conv_id, turn, nullif(regexp_extract(role || ': ' || text, '^(user|assistant):', 1), '') AS role_prefix FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.nullif(F.regexp_extract(F.concat("role", F.lit(": "), "text"), "^(user|assistant):", 1), F.lit("")).alias("role_prefix"))


@query("ext_episode_meta", "SELECT conv_id, turn, 'conv_' || conv_id AS session_id, turn AS turn_index, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS speaker FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("conv_"), "conv_id").alias("session_id"), F.col("turn").alias("turn_index"), F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("speaker"))


@query("ext_labels", r"SELECT page_id, len(regexp_extract_all(html, '<li><a href=\"([^\"]*)\">', 1)) AS n_links, coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('<li><a href="([^"]*)">'), F.lit(1))).cast("long").alias("n_links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("ext_skeleton", f"SELECT doc_id, coalesce(l[1], '') AS header, len(l) AS n_lines, len(list_filter(l, lambda x: contains(lower(x), 'under'))) AS n_witness FROM (SELECT doc_id, {_LINES} AS l FROM documents)")
def _(spark, sf):
    d = _docs(spark, sf).select("doc_id", text.lines(F.col("text")).alias("l"))
    return d.select("doc_id", F.coalesce(F.try_element_at("l", F.lit(1)), F.lit("")).alias("header"), F.size("l").cast("long").alias("n_lines"), F.size(F.filter("l", lambda x: F.contains(F.lower(x), F.lit("under")))).cast("long").alias("n_witness"))


@query("ext_lines_n", f"SELECT doc_id, i // 3 AS chunk, count(*) AS n_lines FROM (SELECT doc_id, unnest(range(len({_LINES}))) AS i FROM documents) GROUP BY ALL")
def _(spark, sf):
    each = _docs(spark, sf).select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("i", "line"))
    return each.groupBy("doc_id", F.floor(F.col("i") / 3).alias("chunk")).agg(F.count("*").alias("n_lines"))


@query("ext_paragraphs", "SELECT doc_id, len(list_filter(string_split(text, chr(10) || chr(10)), lambda x: trim(x) <> '')) AS n FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(F.filter(F.split("text", "\n\n"), lambda x: F.trim(x) != "")).cast("long").alias("n"))


_SCORES = f"""l AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, {_LINES} AS ls FROM documents)),
w AS (SELECT doc_id, line_no, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS word FROM l), df AS (SELECT doc_id, word, count(DISTINCT line_no) AS df FROM w GROUP BY ALL),
sc AS (SELECT doc_id, line_no, sum(df) / count(*) AS score FROM w JOIN df USING (doc_id, word) GROUP BY ALL),
al AS (SELECT l.doc_id, l.line_no, coalesce(score, 0.0) AS score, count(*) OVER (PARTITION BY l.doc_id) AS n FROM l LEFT JOIN sc USING (doc_id, line_no))"""


@query("agg_word_df_score", f"WITH {_SCORES} SELECT doc_id, line_no, round(score, 9) AS score FROM al")
def _(spark, sf):
    return text.line_scores(_docs(spark, sf), "doc_id", "text").select("doc_id", "line_no", F.round("score", 9).alias("score"))


_SUM = f"WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, line_no) AS nth FROM al) SELECT doc_id, line_no, round(score, 9) AS score FROM r WHERE nth <= least({{}}, greatest({{}}, ceil(n * {{}})))"


@query("top_summary_lines", _SUM.format(50, 1, 0.3))
def _(spark, sf):
    return text.summary(_docs(spark, sf), "doc_id", "text", 0.3)


@query("top_gist", _SUM.format(5, 5, 0.0))
def _(spark, sf):
    return text.summary(_docs(spark, sf), "doc_id", "text", 0.0, 5, 5)


@query("top_summary_kw", f"SELECT doc_id, i AS line_no FROM (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, {_LINES} AS ls FROM documents)) WHERE regexp_matches(lower(line), 'license|licensed') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 3")
def _(spark, sf):
    each = _docs(spark, sf).select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("line_no", "line")).where(F.lower("line").rlike("license|licensed"))
    return ranking.top_k(each, ["doc_id"], 3, F.asc("line_no")).select("doc_id", "line_no")


@query("agg_repetitiveness", f"SELECT doc_id, max(n)::double / sum(n) AS share, sum(n)::bigint AS n_lines FROM (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest({_LINES}) AS line FROM documents) GROUP BY ALL) GROUP BY doc_id")
def _(spark, sf):
    return text.repetitiveness(_docs(spark, sf), "doc_id", "text")


@query("agg_keyword_df", "SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents) GROUP BY term HAVING count(DISTINCT doc_id) >= 5")
def _(spark, sf):
    return search.counted(search.postings(_docs(spark, sf), "doc_id", "text"), "doc_id").groupBy("term").agg(F.count("*").alias("df")).where("df >= 5")


@query("agg_novelty", "SELECT count(DISTINCT t)::double / count(*) AS novelty, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM documents)")
def _(spark, sf):
    p = search.counted(search.postings(_docs(spark, sf), "doc_id", "text"), "doc_id").groupBy("term").agg(F.sum("tf").alias("n"))
    return p.agg((F.count("*") / F.sum("n")).alias("novelty"), F.sum("n").alias("n"))


@query("set_jaccard_tokens", "WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t, lead(doc_id) OVER (ORDER BY doc_id) AS next FROM documents) SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.t, b.t))::double / len(list_distinct(list_concat(a.t, b.t))) AS jaccard FROM t a JOIN t b ON b.doc_id = a.next")
def _(spark, sf):
    t = _docs(spark, sf).select("doc_id", F.array_distinct(search.tokens(F.col("text"))).alias("t"))
    both = t.join(ranking.successors(t, "doc_id").withColumnRenamed("id", "doc_id"), "doc_id").alias("a").join(t.alias("b"), F.col("b.doc_id") == F.col("a.next"))
    return both.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"), F.try_divide(F.size(F.array_intersect("a.t", "b.t")), F.size(F.array_union("a.t", "b.t"))).alias("jaccard"))


@query("src_chat_messages", "SELECT conv_id, turn, md5('[' || role || '] ' || text) AS line, role AS role_back FROM conversations")
def _(spark, sf):
    line = F.concat(F.lit("["), "role", F.lit("] "), "text")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(line).alias("line"), F.regexp_extract(line, r"^\[(\w+)\]", 1).alias("role_back"))


@query("qa_f1", r"""WITH p AS (SELECT b.item_id, regexp_extract_all(lower(b.text), '[a-z0-9]+') AS g, regexp_extract_all(lower(d.text), '[a-z0-9]+') AS p FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
gc AS (SELECT item_id, t, count(*) AS n FROM (SELECT item_id, unnest(g) AS t FROM p) GROUP BY ALL), pc AS (SELECT item_id, t, count(*) AS n FROM (SELECT item_id, unnest(p) AS t FROM p) GROUP BY ALL),
c AS (SELECT item_id, sum(least(gc.n, pc.n)) AS common FROM gc JOIN pc USING (item_id, t) GROUP BY item_id)
SELECT item_id, round(coalesce(2.0 * common / (len(g) + len(p)), 0.0), 9) AS f1 FROM p LEFT JOIN c USING (item_id)""")
def _(spark, sf):
    toks = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    p = table(spark, sf, "benchmark").select("item_id", toks("text").alias("g")).join(_docs(spark, sf).select(F.col("doc_id").alias("item_id"), toks("text").alias("p")), "item_id")
    count = lambda c: p.select("item_id", F.explode(c).alias("t")).groupBy("item_id", "t").agg(F.count("*").alias(f"n_{c}"))
    common = count("g").join(count("p"), ["item_id", "t"]).groupBy("item_id").agg(F.sum(F.least("n_g", "n_p")).alias("common"))
    return p.join(common, "item_id", "left").select("item_id", F.round(F.coalesce(2.0 * F.col("common") / (F.size("g") + F.size("p")), F.lit(0.0)), 9).alias("f1"))
