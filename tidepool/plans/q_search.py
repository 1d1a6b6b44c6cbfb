"""Search, fusion and re-ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators import index, ranking, search, store
from tidepool.plans.registry import query
from tidepool.plans.tables import AS_OF, QUERIES_SQL, as_of, queries_frame, table

_TOK = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9_]+')"


def _bm25_sql(source: str, text: str, id_col: str, k: int, name: str = "bm25") -> str:
    return f"""{QUERIES_SQL}, toks AS (SELECT {id_col} AS id, {_TOK.format(text)} AS t FROM {source}),
post AS (SELECT id, len(t) AS size, term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM toks) GROUP BY id, size, term),
stat AS (SELECT count(*) AS n, avg(size) AS m FROM (SELECT DISTINCT id, size FROM post)),
qt AS (SELECT DISTINCT query_id, unnest({_TOK.format('query')}) AS term FROM queries),
dfs AS (SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM qt) GROUP BY term),
sc AS (SELECT query_id, id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / m))), 6) AS score FROM qt JOIN post USING (term) JOIN dfs USING (term), stat GROUP BY query_id, id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= {k})"""


def documents_index(spark, sf) -> index.Index:
    return index.of(spark, f"{sf}/documents.parquet", table(spark, sf, "documents"), "doc_id", "text")


def _hits(spark, sf, k=10) -> DataFrame:
    return documents_index(spark, sf).search(queries_frame(spark), "doc_id", k=k)


@query("ret_bm25_chunks", f"WITH {_bm25_sql('documents', 'text', 'doc_id', 10)} SELECT query_id, id AS doc_id, score, rank FROM bm25")
def _(spark, sf):
    return _hits(spark, sf)


@query("ret_bm25_consolidated", f"WITH src AS (SELECT conv_id, string_agg(role || ' ' || text, ' ' ORDER BY turn) AS body FROM conversations GROUP BY conv_id), {_bm25_sql('src', 'body', 'conv_id', 10)} SELECT query_id, id AS conv_id, score, rank FROM bm25")
def _(spark, sf):
    each = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat_ws(" ", x.role, x.text)), " ").alias("body"))
    return index.of(spark, f"{sf}/conversations.parquet", each, "conv_id", "body", what="role and text by turn").search(queries_frame(spark), "conv_id")


@query("ret_bm25_reasoning", f"WITH src AS (SELECT page_id, url || ' ' || html AS body FROM pages WHERE url LIKE 'https%'), {_bm25_sql('src', 'body', 'page_id', 5)} SELECT query_id, id AS page_id, score, rank FROM bm25")
def _(spark, sf):
    active = table(spark, sf, "pages").where(F.col("url").startswith("https"))
    return index.of(spark, f"{sf}/pages.parquet", active, "page_id", "url", "html", what="https").search(queries_frame(spark), "page_id", k=5)


@query("ret_bm25_facts", f"WITH src AS (SELECT event_id, 'user ' || user_id || ' ' || event_type || ' the ' || floor(value)::int AS body FROM events), {_bm25_sql('src', 'body', 'event_id', 5)} SELECT query_id, id AS event_id, score, rank FROM bm25")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("user "), F.col("user_id"), F.lit(" "), F.col("event_type"), F.lit(" the "), F.floor("value").cast("string")).alias("body"))
    return index.of(spark, f"{sf}/events.parquet", e, "event_id", "body", what="user, type, value").search(queries_frame(spark), "event_id", k=5)


@query("ret_bm25_skills", f"WITH src AS (SELECT item_id, 'skill ' || text AS body FROM benchmark), {_bm25_sql('src', 'body', 'item_id', 5)} SELECT query_id, id AS item_id, score, rank FROM bm25")
def _(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("skill "), F.col("text")).alias("body"))
    return index.of(spark, f"{sf}/benchmark.parquet", b, "item_id", "body", what="skills").search(queries_frame(spark), "item_id", k=5)


_ITEMS = _bm25_sql("documents", "text", "doc_id", 10).replace(QUERIES_SQL, "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)")


@query("ret_bm25_items", f"WITH {_ITEMS} SELECT query_id, id AS doc_id, score, rank FROM bm25")
def _(spark, sf):
    """Every benchmark item asked of the index of documents."""
    asks = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return documents_index(spark, sf).search(asks, "doc_id")


@query("ret_index_changed", f"WITH moved AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN text || ' the and with license' ELSE text END AS text FROM documents WHERE doc_id % 3 <> 1 OR doc_id % 2 = 0), {_bm25_sql('(SELECT * FROM moved WHERE doc_id % 5 <> 2)', 'text', 'doc_id', 10)} SELECT query_id, id AS doc_id, score, rank FROM bm25")
def _(spark, sf):
    """An index that two thirds of the documents made, then half of the others joined, some were replaced by longer ones, and some deleted; asked after it was compacted, and deleted from once more."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    ix = index.Index(spark, store.scratch(spark, "changed")).append(d.where("doc_id % 3 <> 1"), "doc_id", "text").append(d.where("doc_id % 3 = 1 AND doc_id % 2 = 0"), "doc_id", "text")
    ix.update(d.where("doc_id % 6 = 0").withColumn("text", F.concat("text", F.lit(" the and with license"))), "doc_id", "text")
    ix.delete(d.where("doc_id % 10 = 2"), "doc_id").compact().delete(d.where("doc_id % 10 = 7"), "doc_id")
    return ix.search(queries_frame(spark), "doc_id")


@query("jn_fts_content", f"WITH {_bm25_sql('documents', 'text', 'doc_id', 10)} SELECT query_id, id AS doc_id, score, source, substr(text, 1, 60) AS head FROM bm25 JOIN documents ON id = doc_id")
def _(spark, sf):
    return _hits(spark, sf).join(table(spark, sf, "documents"), "doc_id").select("query_id", "doc_id", "score", "source", F.substring("text", 1, 60).alias("head"))


@query("win_rank_norm", f"WITH {_bm25_sql('documents', 'text', 'doc_id', 60)}, s AS (SELECT query_id, id AS doc_id, source, score FROM bm25 JOIN documents ON id = doc_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS rk FROM s) SELECT query_id, doc_id, source, 1.0::double / rk AS score FROM r")
def _(spark, sf):
    hits = _hits(spark, sf, 60).drop("rank").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return ranking.rank_normalised(hits, ["query_id", "source"], "doc_id").select("query_id", "doc_id", "source", "score")


_KNN = """qv AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id {where}),
kn AS (SELECT query_id, vec_id, round(list_inner_product(embedding::double[], q::double[]), 6) AS score FROM embeddings, qv WHERE vec_id <> query_id),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM kn) WHERE rank <= {k})"""


#: The vector of a query in words is that of the row with its number; searches by vectors alone ask for every fiftieth row.
_OF_QUERIES, _FIFTIETH = "IN (SELECT query_id FROM queries)", "% 50 = 0"


def _knn(spark, sf, k=20) -> DataFrame:
    """Neighbours of the queries' vectors among all rows."""
    v = table(spark, sf, "embeddings")
    asks = v.join(F.broadcast(queries_frame(spark).select(F.col("query_id").alias("vec_id"))), "vec_id", "left_semi")  # the queries, a parameter
    return search.knn(v, asks.select(F.col("vec_id").alias("query_id"), "embedding"), k, "vec_id", "embedding", "query_id")


def _knn_all(spark, sf, k=20) -> DataFrame:
    """Every row whose id is divisible by 50 against all rows."""
    v = table(spark, sf, "embeddings")
    return search.knn_blocks(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), k, "vec_id", "embedding", "query_id")


@query("top_knn", f"WITH {_KNN.format(where=_FIFTIETH, k=20)} SELECT query_id, vec_id, score, rank FROM knn")
def _(spark, sf):
    return _knn_all(spark, sf)


@query("jn_vector_content", f"WITH {_KNN.format(where=_FIFTIETH, k=20)} SELECT query_id, vec_id, score, d.lang FROM knn JOIN documents d ON d.doc_id = vec_id")
def _(spark, sf):
    return _knn_all(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "lang"), "vec_id").select("query_id", "vec_id", "score", "lang")


@query("ret_embed_buckets", "SELECT vec_id, list_sum([CASE WHEN embedding[i + 1] > 0 THEN (1 << i) ELSE 0 END FOR i IN range(16)])::bigint AS bucket FROM embeddings")
def _(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", search.sign_bucket("embedding", 16).alias("bucket"))


def _fusion_sql(k: int, w1: float, w2: float, boost: float, n: int) -> str:
    return f"""WITH {_bm25_sql('documents', 'text', 'doc_id', 40)}, {_KNN.format(where=_OF_QUERIES, k=40)},
kwl AS (SELECT query_id, id, rank FROM bm25), vel AS (SELECT query_id, vec_id AS id, rank FROM knn),
u AS (SELECT query_id, id, {w1}::double / ({k} + rank) AS part, 'kw' AS l FROM kwl UNION ALL SELECT query_id, id, {w2}::double / ({k} + rank), 'vec' FROM vel),
f AS (SELECT query_id, id, sum(part) * CASE WHEN count(DISTINCT l) > 1 THEN {boost} ELSE 1.0 END AS score, count(DISTINCT l) AS n_lists FROM u GROUP BY query_id, id),
r AS (SELECT query_id, id, round(score, 9) AS score, n_lists, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM f) SELECT * FROM r WHERE rank <= {n}"""


def _fusion(spark, sf, k, w1, w2, boost, n) -> DataFrame:
    kw = _hits(spark, sf, 40).select("query_id", F.col("doc_id").alias("id"), "score")
    vec = _knn(spark, sf, 40).select("query_id", F.col("vec_id").alias("id"), "score")
    fused = ranking.fuse({"kw": (kw, w1), "vec": (vec, w2)}, "query_id", "id", k, boost).withColumn("score", F.round("score", 9))
    return ranking.top_k(fused, ["query_id"], n, F.desc("score"), F.asc("id")).select("query_id", "id", "score", "n_lists", "rank")


for _name, _args in {"win_rrf": (30, 0.3, 0.7, 1.25, 20), "jn_outer_merge": (30, 0.3, 0.7, 1.25, 40), "win_recall_variant": (60, 1.0, 0.6, 1.0, 20), "top_overfetch": (30, 0.3, 0.7, 1.25, 5)}.items():
    query(_name, _fusion_sql(*_args))(lambda spark, sf, a=_args: _fusion(spark, sf, *a))


@query("win_variant_fusion", f"WITH {_bm25_sql('documents', 'text', 'doc_id', 20)}, v AS (SELECT query_id - 1 AS variant, id, rank FROM bm25), f AS (SELECT id, max(1.0::double / rank) + sum(CASE WHEN variant = 0 THEN 1.0 ELSE 0.6 END::double / (60 + rank)) + 0.01 * sum(CASE WHEN variant = 0 THEN 1.0::double / rank ELSE 0 END) AS score FROM v GROUP BY id) SELECT id AS doc_id, round(score, 9) AS score FROM f")
def _(spark, sf):
    hits = _hits(spark, sf, 20)
    first = F.col("query_id") == 1
    score = F.max(1.0 / F.col("rank")) + F.sum(F.when(first, 1.0).otherwise(0.6) / (60 + F.col("rank"))) + 0.01 * F.sum(F.when(first, 1.0 / F.col("rank")).otherwise(0.0))
    return hits.groupBy("doc_id").agg(F.round(score, 9).alias("score"))


_DECAY = f"""acc AS (SELECT user_id, count(*) AS hits FROM events GROUP BY user_id),
dec AS (SELECT event_id, value, greatest(0.2, exp(-0.6931471805599453 * greatest(0.0, epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 3.6e9 / 336.0)) AS decay, least(2.0, 1.0 + 0.05 * coalesce(hits, 0)) AS boost FROM events LEFT JOIN acc USING (user_id))"""


def _decayed(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    hits = e.groupBy("user_id").agg(F.count("*").alias("hits"))
    return e.join(hits, "user_id", "left").select("event_id", "value", ranking.decay(F.col("ts"), as_of()).alias("decay"), ranking.access_boost(F.col("hits")).alias("boost"))


@query("win_decay", f"WITH {_DECAY} SELECT event_id, round(decay, 9) AS decay, round(boost, 9) AS boost, round(value * decay * boost, 6) AS score FROM dec")
def _(spark, sf):
    return _decayed(spark, sf).select("event_id", F.round("decay", 9).alias("decay"), F.round("boost", 9).alias("boost"), F.round(F.col("value") * F.col("decay") * F.col("boost"), 6).alias("score"))


_HYBRID = _fusion_sql(30, 0.3, 0.7, 1.25, 40).replace("SELECT * FROM r WHERE rank <= 40", f"""SELECT query_id, id, round(score * decay * boost, 9) AS score, rank2 AS rank FROM (
SELECT r.query_id, r.id, r.score, coalesce(decay, 1.0) AS decay, coalesce(boost, 1.0) AS boost, row_number() OVER (PARTITION BY query_id ORDER BY round(r.score * coalesce(decay, 1.0) * coalesce(boost, 1.0), 9) DESC, r.id) AS rank2 FROM r LEFT JOIN dec ON event_id = id WHERE rank <= 40) WHERE rank2 <= 20""").replace("r AS (SELECT query_id", _DECAY + ", r AS (SELECT query_id", 1)


def hybrid(spark, sf) -> DataFrame:
    """Keyword and vector lists fused, then weighed by age and use."""
    fused = _fusion(spark, sf, 30, 0.3, 0.7, 1.25, 40).drop("rank", "n_lists").join(_decayed(spark, sf).withColumnRenamed("event_id", "id"), "id", "left")
    score = F.round(F.col("score") * F.coalesce("decay", F.lit(1.0)) * F.coalesce("boost", F.lit(1.0)), 9)
    return ranking.top_k(fused.withColumn("score", score), ["query_id"], 20, F.desc("score"), F.asc("id")).select("query_id", "id", "score", "rank")


query("ret_hybrid", _HYBRID)(hybrid)


@query("win_dedupe_first", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY n_chars DESC, doc_id) AS nth FROM documents) WHERE nth = 1")
def _(spark, sf):
    key = ranking.dedupe_key(F.lit(""), F.lit(None).cast("string"), F.col("text"), F.col("doc_id").cast("string"))
    return ranking.first_per_key(table(spark, sf, "documents").withColumn("all", F.lit(1)), ["all"], key, F.desc("n_chars"), F.asc("doc_id")).select("doc_id")


_DIV = """WITH o AS (SELECT query_id, conv_id, turn, row_number() OVER (PARTITION BY query_id ORDER BY len DESC, conv_id, turn) AS place FROM (SELECT conv_id // 10 AS query_id, conv_id, turn, length(text) AS len FROM conversations)),
s AS (SELECT *, row_number() OVER (PARTITION BY query_id, conv_id ORDER BY place) AS in_s FROM o),
n AS (SELECT *, CASE WHEN in_s = 1 THEN sum(CASE WHEN in_s = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY place) END AS no FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(no > {0}, true), place) AS rank FROM n) SELECT query_id, conv_id, turn, rank FROM r WHERE rank <= {1}"""


def _diverse(spark, sf, least, k):
    c = table(spark, sf, "conversations").withColumn("query_id", F.floor(F.col("conv_id") / 10)).withColumn("len", F.length("text"))
    return ranking.diversified(c, ["query_id"], "conv_id", k, least, F.desc("len"), F.asc("conv_id"), F.asc("turn")).select("query_id", "conv_id", "turn", "rank")


query("win_session_diverse", _DIV.format(3, 10))(lambda s, d: _diverse(s, d, 3, 10))
query("win_context_diverse", _DIV.format(2, 6))(lambda s, d: _diverse(s, d, 2, 6))


@query("win_budget_prefix", "WITH s AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations) SELECT conv_id, turn, used::bigint AS used FROM s WHERE used <= 3000 OR nth = 1")
def _(spark, sf):
    return ranking.within_budget(table(spark, sf, "conversations"), ["conv_id"], F.length("text"), 3000, F.asc("turn")).select("conv_id", "turn", "used")


@query("win_token_budget_tail", "WITH s AS (SELECT conv_id, turn, sum(greatest(8, ceil(length(text) / 4.0))) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM conversations) SELECT conv_id, turn, used::bigint AS used FROM s WHERE used <= 800")
def _(spark, sf):
    cost = F.greatest(F.lit(8).cast("long"), F.ceil(F.length("text") / 4.0))
    return ranking.within_budget(table(spark, sf, "conversations"), ["conv_id"], cost, 800, F.desc("turn"), keep_first=False).select("conv_id", "turn", "used")


@query("win_episode_budget", "WITH s AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM conversations) SELECT conv_id, turn, md5(substr(text, 1, (3600 - b)::bigint)) AS kept, least(length(text), 3600 - b)::bigint AS n FROM s WHERE b < 3600")
def _(spark, sf):
    out = ranking.truncated_budget(table(spark, sf, "conversations"), ["conv_id"], "text", 3600, F.asc("turn"))
    return out.select("conv_id", "turn", F.md5("kept").alias("kept"), F.length("kept").cast("long").alias("n"))


@query("jn_neighbor_range", "SELECT a.conv_id, a.turn, b.turn AS neighbour, b.role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 AND a.turn <> b.turn")
def _(spark, sf):
    c = table(spark, sf, "conversations")
    wanted = c.select("conv_id", "turn", F.explode(F.array(F.col("turn") - 1, F.col("turn") + 1)).alias("neighbour"))  # the range as an equi-join
    return wanted.join(c.select("conv_id", F.col("turn").alias("neighbour"), "role"), ["conv_id", "neighbour"]).select("conv_id", "turn", "neighbour", "role")


@query("prd_fts_sanitise", r"""WITH t AS (SELECT item_id, list_filter(list_transform(string_split_regex(trim(regexp_replace(lower(text), '[^a-z0-9_\s]', ' ', 'g')), '\s+'), lambda x: regexp_replace(x, '^_+|_+$', '', 'g')), lambda x: length(x) >= 2 OR regexp_matches(x, '^[0-9]$')) AS t0 FROM benchmark),
d AS (SELECT item_id, list_filter(t0, lambda x, i: list_position(t0, x) = i)[1:24] AS t FROM t)
SELECT item_id, CASE WHEN len(t) = 0 THEN '""' WHEN len(t) <= 3 THEN array_to_string(t, ' ') ELSE array_to_string(list_transform(t, lambda x: CASE WHEN regexp_matches(x, '^[a-z]{4,}$') THEN x || '*' ELSE x END), ' OR ') END AS expression FROM d""")
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", search.match_expression(F.col("text")).alias("expression"))


@query("ret_features", f"WITH {_bm25_sql('documents', 'text', 'doc_id', 10)}, w AS (SELECT b.query_id, b.id, b.score, b.rank, list_distinct({_TOK.format('q.query')}) AS qt, list_distinct({_TOK.format('d.text')}) AS dt, d.n_chars FROM bm25 b JOIN queries q USING (query_id) JOIN documents d ON d.doc_id = b.id) SELECT query_id, id AS doc_id, rank, len(list_intersect(qt, dt)) AS overlap, len(list_intersect(qt, dt))::double / len(qt) AS share, ln(1 + n_chars)::double AS log_length FROM w")
def _(spark, sf):
    q = queries_frame(spark).withColumn("qt", F.array_distinct(search.tokens(F.col("query"))))
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.array_distinct(search.tokens(F.col("text"))).alias("dt"))
    both = F.size(F.array_intersect("qt", "dt"))
    return _hits(spark, sf).join(q, "query_id").join(d, "doc_id").select("query_id", "doc_id", "rank", both.cast("long").alias("overlap"), (both / F.size("qt")).alias("share"), F.log1p("n_chars").alias("log_length"))


@query("top_lex_rerank", f"WITH {_bm25_sql('documents', 'text', 'doc_id', 30)}, m AS (SELECT b.*, max(score) OVER (PARTITION BY query_id) AS top, len(list_intersect(list_distinct({_TOK.format('q.query')}), list_distinct({_TOK.format('d.text')})))::double / len(list_distinct({_TOK.format('q.query')})) AS ov FROM bm25 b JOIN queries q USING (query_id) JOIN documents d ON d.doc_id = b.id), s AS (SELECT query_id, id, round(0.65 * score / greatest(top, 1e-9) + 0.35 * ov, 9) AS score FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id AS doc_id, score, rank FROM r WHERE rank <= 10")
def _(spark, sf):
    q = queries_frame(spark).withColumn("qt", F.array_distinct(search.tokens(F.col("query"))))
    d = table(spark, sf, "documents").select("doc_id", F.array_distinct(search.tokens(F.col("text"))).alias("dt"))
    hits = _hits(spark, sf, 30).drop("rank").withColumn("top", F.max("score").over(Window.partitionBy("query_id"))).join(q, "query_id").join(d, "doc_id")
    score = F.round(0.65 * F.col("score") / F.greatest("top", F.lit(1e-9)) + 0.35 * F.size(F.array_intersect("qt", "dt")) / F.size("qt"), 9)
    return ranking.top_k(hits.withColumn("score", score), ["query_id"], 10, F.desc("score"), F.asc("doc_id")).select("query_id", "doc_id", "score", "rank")


@query("ret_augment", f"WITH {_bm25_sql('documents', 'text', 'doc_id', 5)} SELECT query_id, '<memories>' || string_agg('<memory rank=\"' || rank || '\" id=\"' || id || '\">' || substr(text, 1, 40) || '</memory>', '' ORDER BY rank) || '</memories>' AS context FROM bm25 JOIN documents ON doc_id = id GROUP BY query_id")
def _(spark, sf):
    each = _hits(spark, sf, 5).join(table(spark, sf, "documents"), "doc_id").withColumn("one", F.concat(F.lit('<memory rank="'), F.col("rank"), F.lit('" id="'), F.col("doc_id"), F.lit('">'), F.substring("text", 1, 40), F.lit("</memory>")))
    return each.groupBy("query_id").agg(F.concat(F.lit("<memories>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "one"))), lambda x: x.one), ""), F.lit("</memories>")).alias("context"))


@query("agg_retrieval_metrics", f"WITH {_bm25_sql('documents', 'text', 'doc_id', 10)}, rel AS (SELECT query_id, min(rank) FILTER (quality = 1) AS first FROM bm25 LEFT JOIN labels ON doc_id = id GROUP BY query_id) SELECT count(*) AS n, avg(CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0.0 END)::double AS recall, round(avg(coalesce(1.0::double / first, 0.0)), 9) AS mrr FROM rel")
def _(spark, sf):
    good = table(spark, sf, "labels").select("doc_id", "quality")
    first = _hits(spark, sf).join(good, "doc_id", "left").groupBy("query_id").agg(F.min(F.when(F.col("quality") == 1, F.col("rank"))).alias("first"))
    return first.agg(F.count("*").alias("n"), F.avg(F.col("first").isNotNull().cast("double")).alias("recall"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 9).alias("mrr"))
