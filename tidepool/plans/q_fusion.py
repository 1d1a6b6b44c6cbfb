"""Lists of several kinds brought together: three keyword sources, graph, facts, second hops, routes, recall."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.operators import index, extract, ranking, search
from tidepool.operators import questions as qs
from tidepool.plans.q_answers import _ASKED, _DRINK, _HINTED, _SELF, _any, _has
from tidepool.plans.q_govern import bm25_sql
from tidepool.plans.q_questions import _questions
from tidepool.plans.q_search import _HYBRID, documents_index, hybrid
from tidepool.plans.registry import query
from tidepool.plans.tables import FACTS_SQL, QUERIES_SQL, facts, queries_frame, table

# Three keyword sources

_BODIES = "cv AS (SELECT conv_id, string_agg(role || ' ' || text, ' ' ORDER BY turn) AS body FROM conversations GROUP BY conv_id)"
_THREE = f"""{QUERIES_SQL}, {_BODIES}, {bm25_sql('a', 'documents', 'text', 'doc_id', 10)}, {bm25_sql('b', 'benchmark', 'text', 'item_id', 10)}, {bm25_sql('c', 'cv', 'body', 'conv_id', 10)},
three AS (SELECT query_id, 'chunk' AS source, id, 1.0::double / rank AS score FROM al UNION ALL SELECT query_id, 'entry', id, 1.0::double / rank FROM bl UNION ALL SELECT query_id, 'summary', id, 1.0::double / rank FROM cl)"""


def _three(spark, sf) -> DataFrame:
    """query_id, source, id and score: the ten best of documents, entries and conversations, each by its rank, so that the scores compare."""
    asks = queries_frame(spark)
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat_ws(" ", x["role"], x["text"]))
    talks = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(turns, " ").alias("body"))
    entries = index.of(spark, f"{sf}/benchmark.parquet", table(spark, sf, "benchmark"), "item_id", "text")
    lists = (("chunk", documents_index(spark, sf), "doc_id"), ("entry", entries, "item_id"), ("summary", index.of(spark, f"{sf}/conversations.parquet", talks, "conv_id", "body", what="role and text by turn"), "conv_id"))
    out = None
    for source, ix, i in lists:
        hits = ix.search(asks, i, k=10)
        one = hits.select("query_id", F.lit(source).alias("source"), F.col(i).alias("id"), (1.0 / F.col("rank")).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


query("set_union_sources", f"WITH {_THREE} SELECT * FROM three")(_three)
_ORDER = "ORDER BY score DESC, source, id"


@query("ret_keyword_all", f"WITH {_THREE} SELECT *, row_number() OVER (PARTITION BY query_id {_ORDER}) AS rank FROM three QUALIFY rank <= 20")
def _(spark, sf):
    return ranking.top_k(_three(spark, sf), ["query_id"], 20, F.desc("score"), F.asc("source"), F.asc("id"))


@query("top_keyword_all", f"WITH {_THREE} SELECT query_id, source, id, row_number() OVER (PARTITION BY query_id, source {_ORDER}) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id {_ORDER}) AS rank FROM three QUALIFY rank <= 10)")
def _(spark, sf):
    """Of the ten best of all sources together, the places within each source."""
    ten = ranking.top_k(_three(spark, sf), ["query_id"], 10, F.desc("score"), F.asc("source"), F.asc("id")).drop("rank")
    return ranking.rank(ten, ["query_id", "source"], F.desc("score"), F.asc("id"), name="place").select("query_id", "source", "id", "place")


# Graph and facts beside memory

#: Weights of memory and of the other list, by intent; the constant of the fusion. Fixed values.
GRAPH = {"temporal": (0.60, 0.40), "entity_lookup": (0.70, 0.30), "conceptual": (0.85, 0.20)}
FACT = {"temporal": (0.72, 0.35), "entity_lookup": (0.72, 0.35), "conceptual": (0.85, 0.20)}
K, HOP = 60, 30


def beside(memory: DataFrame, other: DataFrame, queries: DataFrame, weights: dict[str, tuple[float, float]], kind: str, k: int) -> DataFrame:
    """query_id, key, score and rank: two ranked lists (query_id, id, rank) whose rows are never the same, fused by reciprocal ranks with the weights of the query's intent."""
    intent = queries.select("query_id", qs.intent(F.col("query")).alias("intent"))
    of = lambda i: F.element_at(F.create_map(*[x for n, w in weights.items() for x in (F.lit(n), F.lit(w[i]))]), F.col("intent"))
    part = lambda df, name, i: df.join(intent, "query_id").select("query_id", F.concat(F.lit(name), F.col("id").cast("string")).alias("key"), F.round(of(i) / (K + F.col("rank")), 9).alias("score"))
    return ranking.top_k(part(memory, "", 0).unionByName(part(other, f"{kind}:", 1)), ["query_id"], k, F.desc("score"), F.asc("key"))


def _hits(spark, sf, queries: DataFrame, k: int) -> DataFrame:
    return documents_index(spark, sf).search(queries, "doc_id", k=k).withColumnRenamed("doc_id", "id")


_NAME, _NOT = r"\b([A-Z][\w-]+(?:[ \t\n]+[A-Z][\w-]+){0,3})\b", ("The", "This", "That", "And", "A", "An", "I")


def _names(spark, sf) -> DataFrame:
    """(id, place, name): the first eight different capitalised spans of every document."""
    stop = F.array(*[F.lit(w) for w in _NOT])
    found = F.filter(F.regexp_extract_all(extract.masked(F.col("text")), F.lit(_NAME), F.lit(0)), lambda x: ~F.array_contains(stop, x))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.posexplode(F.slice(F.array_distinct(found), 1, 8)).alias("place", "name"))


_NAMED = rf"""nf AS (SELECT doc_id, list_filter(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F\P{{L}}]', '_', 'g'), '{_NAME}'), lambda x: x NOT IN ({', '.join(f"'{w}'" for w in _NOT)})) AS l FROM documents),
nm AS (SELECT doc_id AS id, name, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS place FROM (SELECT doc_id, name, min(i) AS first FROM (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS name FROM nf) GROUP BY doc_id, name) QUALIFY place < 8)"""


def graph_list(hits: DataFrame, names: DataFrame, k: int, seeds: int = 3) -> DataFrame:
    """query_id, id, score and rank: rows that share names with the first rows of a query, by how many."""
    asked = hits.where(F.col("rank") <= seeds).join(names.select("id", "name"), "id").select("query_id", "name").distinct()
    shared = names.select("id", "name").join(asked, "name").groupBy("query_id", "id").agg(F.count("*").alias("score"))
    return ranking.top_k(shared, ["query_id"], k, F.desc("score"), F.asc("id"))


_MEMORY = f"{QUERIES_SQL}, {bm25_sql('a', 'documents', 'text', 'doc_id', 20)}, memory AS (SELECT query_id, id, rank FROM al)"
_GRAPH = f"{_NAMED}, ga AS (SELECT DISTINCT query_id, name FROM memory JOIN nm USING (id) WHERE rank <= 3), graph AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, id) AS rank FROM (SELECT query_id, id, count(*) AS n FROM nm JOIN ga USING (name) GROUP BY ALL) QUALIFY rank <= 20)"
_FACTS = f"{FACTS_SQL.replace('k AS (', 'fk AS (').replace('FROM k)', 'FROM fk)')}, fb AS (SELECT fact_id, entity || ' ' || relation || ' the ' || value AS body FROM facts), {bm25_sql('f', 'fb', 'body', 'fact_id', 20)}"


def _beside_sql(memory: str, other: str, weights: tuple[float, float], kind: str, k: int) -> str:
    """Both lists of queries that are all conceptual."""
    return f"SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM (SELECT query_id, id::varchar AS key, round({weights[0]}::double / ({K} + rank), 9) AS score FROM {memory} UNION ALL SELECT query_id, '{kind}:' || id, round({weights[1]}::double / ({K} + rank), 9) FROM {other}) QUALIFY rank <= {k}"


def _graph(spark, sf) -> DataFrame:
    return graph_list(_hits(spark, sf, queries_frame(spark), 20), _names(spark, sf), 20)


def _fact(spark, sf) -> DataFrame:
    body = facts(spark, sf).select("fact_id", F.concat_ws(" ", "entity", "relation", F.lit("the"), "value").alias("body"))
    return index.of(spark, f"{sf}/events.parquet", body, "fact_id", "body", what="facts").search(queries_frame(spark), "fact_id", k=20).withColumnRenamed("fact_id", "id")


@query("win_graph_fusion", f"WITH {_MEMORY}, {_GRAPH} {_beside_sql('memory', 'graph', GRAPH['conceptual'], 'graph', 20)}")
def _(spark, sf):
    q = queries_frame(spark)
    return beside(_hits(spark, sf, q, 20), _graph(spark, sf), q, GRAPH, "graph", 20)


@query("win_fact_fusion", f"WITH {_MEMORY}, {_FACTS} {_beside_sql('memory', 'fl', FACT['conceptual'], 'fact', 20)}")
def _(spark, sf):
    q = queries_frame(spark)
    return beside(_hits(spark, sf, q, 20), _fact(spark, sf), q, FACT, "fact", 20)


@query(
    "ret_search",
    f"WITH {_MEMORY}, hy AS ({_HYBRID}), {_GRAPH}, {_FACTS}, g AS ({_beside_sql('hy', 'graph', GRAPH['conceptual'], 'graph', 20)}), g2 AS (SELECT query_id, key AS id, rank FROM g) {_beside_sql('g2', 'fl', FACT['conceptual'], 'fact', 20)}",
)
def _(spark, sf):
    """Keyword and vector lists by age and use, then what the graph adds, then what the facts add."""
    q = queries_frame(spark)
    first = beside(hybrid(spark, sf), _graph(spark, sf), q, GRAPH, "graph", 20)
    return beside(first.select("query_id", F.col("key").alias("id"), "rank"), _fact(spark, sf), q, FACT, "fact", 20)


# Second hops


def second_hop(hits: DataFrame, names: DataFrame, queries: DataFrame, seeds: int = 3, most: int = 5) -> DataFrame:
    """query_id and query: each query with the first names of its first rows that it does not have itself."""
    found = hits.where(F.col("rank") <= seeds).join(names, "id").join(queries, "query_id").where(~F.contains(F.lower("query"), F.lower("name")))
    first = ranking.first_per_key(found, ["query_id"], F.col("name"), F.asc("rank"), F.asc("place"))
    few = first.withColumnRenamed("rank", "row")
    few = ranking.top_k(few, ["query_id"], most, F.asc("row"), F.asc("place"))
    more = few.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "place", "name"))), lambda x: x["name"]), " ").alias("names"))
    return queries.join(more, "query_id", "left").select("query_id", F.concat_ws(" ", "query", "names").alias("query"))


def _chained(spark, sf, k: int) -> DataFrame:
    q = queries_frame(spark)
    first = _hits(spark, sf, q, 20)
    wider = second_hop(first, _names(spark, sf), q)
    second = _hits(spark, sf, wider, 20)
    fused = ranking.fuse({"first": (first.drop("rank"), 1.0), "second": (second.drop("rank"), 1.0)}, "query_id", "id", HOP).withColumn("score", F.round("score", 9))
    return ranking.top_k(fused, ["query_id"], k, F.desc("score"), F.asc("id")).select("query_id", "id", "score", "rank")


def _chained_sql(k: int) -> str:
    return f"""WITH {_MEMORY}, {_NAMED}, hs AS (SELECT query_id, rank, place, name, row_number() OVER (PARTITION BY query_id, name ORDER BY rank, place) AS again FROM memory JOIN nm USING (id) JOIN queries USING (query_id) WHERE rank <= 3 AND NOT contains(lower(query), lower(name))),
hf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, place) AS nth FROM hs WHERE again = 1 QUALIFY nth <= 5), hw AS (SELECT query_id, query || coalesce(' ' || (SELECT string_agg(name, ' ' ORDER BY rank, place) FROM hf WHERE hf.query_id = queries.query_id), '') AS query FROM queries),
{bm25_sql('z', 'documents', 'text', 'doc_id', 20, 'hw')}, u AS (SELECT query_id, id, 1.0::double / ({HOP} + rank) AS s FROM memory UNION ALL SELECT query_id, id, 1.0::double / ({HOP} + rank) FROM zl), f AS (SELECT query_id, id, round(sum(s), 9) AS score FROM u GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= {k}"""


query("win_hop_fusion", _chained_sql(20))(lambda spark, sf: _chained(spark, sf, 20))
query("ret_chained", _chained_sql(10))(lambda spark, sf: _chained(spark, sf, 10))


@query("ret_recall", f"WITH h AS ({_HYBRID}), s AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id) AS nth FROM h JOIN documents ON doc_id = id) SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE nth = 1 QUALIFY rank <= 10")
def _(spark, sf):
    """The hybrid list, the best row of each source, ranked anew."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    first = ranking.first_per_key(hybrid(spark, sf).drop("rank").join(d, "id"), ["query_id"], F.col("source"), F.desc("score"), F.asc("id"))
    return ranking.top_k(first, ["query_id"], 10, F.desc("score"), F.asc("id")).select("query_id", "id", "score", "rank")


# Routes

_HINTS = f"list_filter([{', '.join(_HINTED)}, {_DRINK}], lambda x: x IS NOT NULL)"


@query(
    "ret_structured_route",
    f"WITH {_ASKED}, p AS (SELECT question_id, {_SELF} AS me, {_SELF} AND ({_has(qs.STATE_PAST)} OR {_any(qs.STATE_PAST_PHRASES)}) AS past, {_SELF} AND ({_has(qs.STATE_NOW)} OR {_any(qs.STATE_NOW_PHRASES)}) AS now, len(t) >= 5 AND {_any((' and ', ',', ' plus '))} AS many, {_HINTS} AS hints FROM a) SELECT question_id, CASE WHEN NOT me OR len(hints) = 0 THEN 'search' WHEN past THEN 'truth' WHEN now OR many THEN 'current' ELSE 'search' END AS route, CASE WHEN me AND len(hints) > 0 AND (past OR now OR many) THEN array_to_string(hints, ',') ELSE '' END AS relations FROM p",
)
def _(spark, sf):
    """Where a question goes: one about oneself and a known kind of fact to the facts, in their history or as they are now; any other to search."""
    asked = _questions(spark, sf).select("question_id", qs.profile(F.col("question")).alias("p"), qs.relation_hints(F.col("question")).alias("hints"))
    own = F.col("p.first_person") & (F.size("hints") > 0)
    route = F.when(~own, "search").when(F.col("p.history"), "truth").when(F.col("p.current") | F.col("p.facets"), "current").otherwise("search")
    return asked.select("question_id", route.alias("route"), F.when(route != "search", F.array_join("hints", ",")).otherwise("").alias("relations"))


# Scorers


def cross_scored(pairs: DataFrame, query_col: str, text_col: str, scorer=None) -> DataFrame:
    """Pairs with a score of a model over both texts, in Arrow batches; without a model the share of the query's letters that the text has."""

    def letters(a: list[str], b: list[str]) -> list[float]:
        return [len(set(x) & set(y)) / max(1, len(set(x))) for x, y in zip(a, b, strict=True)]

    model = scorer or letters
    run = F.pandas_udf(lambda a, b: pd.Series(model(a.fillna("").tolist(), b.fillna("").tolist())), T.DoubleType())
    return pairs.withColumn("score", F.round(run(query_col, text_col), 9))


@query("top_cross_encoder", f"WITH {QUERIES_SQL}, {bm25_sql('a', 'documents', 'text', 'doc_id', 20)}, s AS (SELECT query_id, id, round(len(list_intersect(list_distinct(string_split(query, '')), list_distinct(string_split(text, ''))))::double / len(list_distinct(string_split(query, ''))), 9) AS score FROM al JOIN queries USING (query_id) JOIN documents ON doc_id = id) SELECT query_id, id AS doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 5")
def _(spark, sf):
    q = queries_frame(spark)
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    pairs = _hits(spark, sf, q, 20).drop("score", "rank").join(d, "id").join(q, "query_id")
    best = ranking.top_k(cross_scored(pairs, "query", "text"), ["query_id"], 5, F.desc("score"), F.asc("id"))
    return best.select("query_id", F.col("id").alias("doc_id"), "score", "rank")




@query("ext_tool_call", "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN event_type END AS tool, CASE event_id % 4 WHEN 0 THEN 'r' || event_id WHEN 2 THEN 'x' END AS rid, CASE WHEN event_id % 4 = 0 THEN json_extract_string(props, '$.k')::int END AS k FROM events")
def _(spark, sf):
    """Tool, request and payload of log lines, whole, broken or without a call."""
    i, t = F.col("event_id") % 4, F.col("event_type")
    line = F.when(i == 0, F.concat(F.lit("tool_call::"), t, F.lit(" rid=r"), "event_id", F.lit(" payload="), "props")).when(i == 1, F.concat(F.lit("note tool_call::"), t, F.lit(" without a payload"))).when(i == 2, F.concat(F.lit("tool_call::"), t, F.lit(" rid=x payload={broken"))).otherwise(F.concat(F.lit("plain line "), "event_id"))
    some = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    rows = table(spark, sf, "events").select("event_id", line.alias("line"))
    payload = F.try_parse_json(some(r"payload=(.*)$"))
    return rows.select("event_id", some(r"tool_call::(\S+)").alias("tool"), some(r"\brid=(\S+)").alias("rid"), F.try_variant_get(payload, "$.k", "int").alias("k"))
