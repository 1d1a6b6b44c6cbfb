"""Keyword and vector search over many queries at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.operators import ranking, store

K1, B = 1.2, 0.75
TOKEN = "[a-z0-9_]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def postings(docs: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """(id, size, terms): each document's tokens in one row; size is their number."""
    terms = tokens(F.concat_ws(" ", *columns))
    return docs.select(F.col(id_col), terms.alias("terms")).select(id_col, F.size("terms").alias("size"), "terms")


def counted(post: DataFrame, id_col: str) -> DataFrame:
    """(id, size, term, tf): one row per document and term."""
    return post.select(id_col, "size", F.explode("terms").alias("term")).groupBy(id_col, "size", "term").agg(F.count("*").alias("tf"))


def _sizes(post: DataFrame) -> DataFrame:
    """One row: documents with any token, and their mean size."""
    return post.where("size > 0").agg(F.count("*").alias("n_docs"), F.avg("size").alias("mean_size"))


def _score() -> Column:
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    return idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean_size")))


#: Terms of all queries together up to which they are sent to every task; more are met by a shuffle.
TERMS = 100_000


def _asked(terms: DataFrame) -> DataFrame:
    """The queries' terms, sent to all tasks if they are few; they are counted."""
    return F.broadcast(terms) if terms.count() <= TERMS else terms


def bm25(post: DataFrame, queries: DataFrame, id_col: str, query_id: str = "query_id", query: str = "query", k: int = 10, require_all: bool = False) -> DataFrame:
    """query_id, id, score, rank. The texts are read once: tokens meet the queries' terms where they are made, and what goes on is a count for each document and term asked for, and one for the rest of each document, which tells the collection's size and mean length."""
    wanted = queries.select(query_id, F.explode(F.array_distinct(tokens(F.col(query)))).alias("term"))
    asked = _asked(wanted.select(F.col("term").alias("hit")).distinct())
    each = post.select(id_col, "size", F.explode("terms").alias("word")).join(asked, F.col("word") == F.col("hit"), "left")
    counts = store.kept(each.groupBy(id_col, "size", F.col("hit").alias("term")).agg(F.count("*").alias("tf")), "postings")
    sizes = counts.select(id_col, "size").distinct().agg(F.count("*").alias("n_docs"), F.avg("size").alias("mean_size"))
    few = counts.where("term is not null")
    df = few.groupBy("term").agg(F.count("*").alias("df"))
    hits = few.join(df, "term").join(wanted, "term").crossJoin(F.broadcast(sizes))  # one row
    scored = hits.groupBy(query_id, id_col).agg(F.round(F.sum(_score()), 6).alias("score"), F.count("*").alias("found"))
    if require_all:
        n_terms = wanted.groupBy(query_id).agg(F.count("*").alias("n_terms"))
        scored = scored.join(n_terms, query_id).where("found = n_terms").drop("n_terms")
    return ranking.top_k(scored.drop("found"), [query_id], k, F.desc("score"), F.asc(id_col))


#: Terms up to which all have to be found, and letters of a term that matches as a prefix beyond. Fixed values.
ALL_TERMS, PREFIX = 3, 4


def fulltext(post: DataFrame, queries: DataFrame, id_col: str, query_id: str = "query_id", query: str = "query", k: int = 10) -> DataFrame:
    """query_id, id, score, rank, as a full-text index answers: queries are cleaned (`match_terms`), words count by their stems, up to three terms all have to be found, beyond that any, and then letter words also match as prefixes.

    Equality and prefixes are both equi-joins, on the stem and on its first letters.
    """
    terms = queries.select(query_id, match_terms(F.col(query)).alias("t")).withColumn("n_terms", F.size("t"))
    wanted = terms.select(query_id, "n_terms", F.explode("t").alias("raw"))
    loose = (F.col("n_terms") > ALL_TERMS) & F.col("raw").rlike(f"^[a-z]{{{PREFIX},}}$")
    wanted = wanted.select(query_id, "n_terms", stem(F.col("raw")).alias("term"), loose.alias("prefix")).distinct()
    each = post.select(id_col, "size", F.explode("terms").alias("word")).select(id_col, "size", stem(F.col("word")).alias("word"))
    whole = _asked(wanted.where("not prefix").select("term").distinct())
    begun = _asked(wanted.where("prefix").select("term").distinct().withColumn("head", F.substring("term", 1, PREFIX - 1)))
    same = each.join(whole, each.word == whole.term).select(id_col, "size", "term", F.lit(False).alias("prefix"))
    starts = each.withColumn("head", F.substring("word", 1, PREFIX - 1)).join(begun, "head").where(F.startswith("word", "term")).select(id_col, "size", "term", F.lit(True).alias("prefix"))
    few = store.kept(same.union(starts).groupBy(id_col, "size", "term", "prefix").agg(F.count("*").alias("tf")), "postings")
    df = few.groupBy("term", "prefix").agg(F.count("*").alias("df"))
    hits = few.join(df, ["term", "prefix"]).join(wanted, ["term", "prefix"]).crossJoin(F.broadcast(_sizes(post)))  # one row
    needed = wanted.groupBy(query_id).agg(F.count("*").alias("needed"))
    scored = hits.groupBy(query_id, id_col).agg(F.round(F.sum(_score()), 6).alias("score"), F.count("*").alias("found"), F.first("n_terms").alias("n_terms")).join(needed, query_id)
    kept = scored.where((F.col("n_terms") > ALL_TERMS) | (F.col("found") == F.col("needed")))
    return ranking.top_k(kept.select(query_id, id_col, "score"), [query_id], k, F.desc("score"), F.asc(id_col))


def stem(word: Column) -> Column:
    """A word without its commonest endings, if three letters stay: s, es, ed, ing, and y as i."""
    out = word
    for ending in ("s", "es", "ed", "ing"):
        out = F.when((F.length(word) >= len(ending) + 3) & F.endswith(word, F.lit(ending)) & ~F.endswith(word, F.lit("ss")), F.substring(word, F.lit(1), F.length(word) - len(ending))).otherwise(out)
    return F.when((F.length(out) > 3) & F.endswith(out, F.lit("e")), F.substring(out, F.lit(1), F.length(out) - 1)).when((F.length(out) > 3) & F.endswith(out, F.lit("y")), F.concat(F.substring(out, F.lit(1), F.length(out) - 1), F.lit("i"))).otherwise(out)


def match_terms(query: Column) -> Column:
    """Terms of a full-text query: distinct without regard to case, no single letters, 24 at most. Beyond three terms, letter words of four or more match as prefixes."""
    clean = F.split(F.trim(F.regexp_replace(F.lower(query), r"[^a-z0-9_\s]", " ")), r"\s+")
    bare = F.transform(clean, lambda t: F.regexp_replace(t, "^_+|_+$", ""))
    kept = F.filter(F.array_distinct(bare), lambda t: (F.length(t) >= 2) | t.rlike("^[0-9]$"))
    return F.slice(kept, 1, 24)


def match_expression(query: Column) -> Column:
    """The query as an expression: all terms where there are up to three, any (with prefixes) beyond."""
    terms = match_terms(query)
    prefixed = F.transform(terms, lambda t: F.when(t.rlike("^[a-z]{4,}$"), F.concat(t, F.lit("*"))).otherwise(t))
    return F.when(F.size(terms) == 0, '""').when(F.size(terms) <= 3, F.array_join(terms, " ")).otherwise(F.array_join(prefixed, " OR "))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column | str) -> Column:
    size = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(0.0))


def knn(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector: str, query_id: str, digits: int = 6) -> DataFrame:
    """Exact inner-product neighbours of a stated, bounded set of queries: the vectors are scanned once, and each task keeps k of each query before the exchange. A set of more than QUERIES goes by blocks."""
    if queries.limit(QUERIES + 1).count() > QUERIES:
        return knn_blocks(vectors, queries, k, id_col, vector, query_id, digits)
    asks = F.broadcast(queries.select(F.col(query_id), F.col(vector).alias("asked")))  # QUERIES rows at most
    scored = vectors.select(F.col(id_col), F.col(vector).alias("v")).join(asks, F.col(id_col) != F.col(query_id)).select(query_id, id_col, F.round(dot("v", "asked"), digits).alias("score"))
    return ranking.top_k(scored, [query_id], k, F.desc("score"), F.asc(id_col))


#: Queries and vectors that one task of a blocked search holds.
QUERIES, VECTORS = 1024, 8192


def knn_blocks(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector: str, query_id: str, digits: int = 6, centres: np.ndarray | None = None, probes: int = 0, block: tuple[int, int] = (QUERIES, VECTORS)) -> DataFrame:
    """Inner-product neighbours of a set of queries that may grow with the vectors: each block of queries meets each block of vectors in a task, which keeps k of each query.

    With `centres`, vectors have their `cell`, and a query meets those of its `probes` nearest cells only. Null vectors are left out.
    """
    both = lambda df, i, **more: df.where(F.col(vector).isNotNull()).select(F.col(i).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), (F.col("cell").cast("int") if more.get("cell") else F.lit(0)).alias("cell"))
    asks, rows = both(queries, query_id), both(vectors, id_col, cell=centres is not None)
    n_asks, n_rows = (max(1, -(-df.count() // size)) for df, size in zip((asks, rows), block, strict=True))
    dealt = lambda df, own, n_own, other, n_other: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
        out: list[list[np.ndarray]] = [[], [], []]
        if len(left) and len(right):
            ask, row, ask_ids, row_ids = matrix(left), matrix(right), left.column("id").to_numpy(), right.column("id").to_numpy()
            scores = np.full((len(ask), len(row)), -np.inf)
            if centres is None:
                scores = np.round(ask @ row.T, digits)
            else:
                probed = np.argsort(-(ask @ centres.T), axis=1, kind="stable")[:, :probes]
                cell = right.column("cell").to_numpy()
                for c in np.unique(cell):
                    q, x = np.flatnonzero((probed == c).any(axis=1)), np.flatnonzero(cell == c)
                    scores[np.ix_(q, x)] = np.round(ask[q] @ row[x].T, digits)
            scores[ask_ids[:, None] == row_ids[None]] = -np.inf
            for i, s in enumerate(scores):
                few = np.flatnonzero((s >= (np.partition(s, -k)[-k] if len(s) > k else -np.inf)) & (s > -np.inf))
                few = few[np.lexsort((row_ids[few], -s[few]))[:k]]
                for o, x in zip(out, (np.full(len(few), ask_ids[i]), row_ids[few], s[few]), strict=True):
                    o.append(x)
        one = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
        return pa.table({query_id: one(out[0], pa.int64()), id_col: one(out[1], pa.int64()), "score": one(out[2], pa.float64())})

    left, right = dealt(asks, "qb", n_asks, "vb", n_rows), dealt(rows, "vb", n_rows, "qb", n_asks)
    found = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(best, f"{query_id} long, {id_col} long, score double")
    return ranking.top_k(found, [query_id], k, F.desc("score"), F.asc(id_col))


def sign_bucket(vector: Column | str, bits: int) -> Column:
    """The first `bits` signs as a number."""
    return F.aggregate(F.transform(F.slice(vector, 1, bits), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
