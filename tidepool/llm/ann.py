"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Fit: rotations are learned (iterative quantisation) on a bounded sample of about SAMPLE vectors; the
signs of BITS rotated components make a code. Vectors of unequal length get one more component,
sqrt(M^2 - |x|^2) with M the largest norm of their block, and queries a zero, so that the largest
inner product is the smallest angle.

Search: every code is cut into m substrings of SUB_BITS bits, and each substring has an index of its
own from value to rows. For a Hamming radius r, the first r mod m + 1 indexes are probed with all values
within r div m bits of the query's, the others within one bit less: by the pigeonhole principle this
retrieves every code within r. All rows retrieved are reranked by the inner products of the original vectors in
double precision.

The radius is measured, not given: on the sample, by the true neighbours of PROBERS of its rows, it is the least one
that retrieves the share TARGET of them. In a larger table neighbours are nearer, so more of them are
found. A query that retrieves fewer than k rows of a block goes on with larger radii until it has k (all, if fewer).
Vectors of other lengths than most measure their radius in their own block.

Rows are dealt into blocks of about BLOCK and queries into blocks of QUERIES; a cell of the two
builds its indexes, and returns its k best for each query. A window merges the cells. Memory is that
of a cell. A row travels once for each block of queries, and a query once for each block of rows.

Vectors null, zero, or with null or non-finite components take no part; vectors of different lengths
have no inner product and are not compared. A candidate with the query's own id is left out. A
repeated id as query gives its list once per row. Null ids are no queries but may be found. An empty
table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm.common import materialise, pick

SAMPLE, STEPS = 16_384, 20
SUB_BITS = 16
#: 96 substrings.
BITS = 96 * SUB_BITS
#: Rows of the sample that ask for their neighbours there, and the share of these that the radius has to retrieve.
PROBERS, TARGET = 256, 0.95
BLOCK, QUERIES = 32_768, 32_768
#: Queries that are probed together.
TOGETHER = 64
_FOUND = "row long, query_id long, vec_id long, score double"


def learn(sample: np.ndarray, bits: int = BITS, steps: int = STEPS, seed: int = 0) -> np.ndarray:
    """Rotations side by side, cut to `bits` columns: each turns the sample so that its signs lose least. Without a sample they are random."""
    rng, d = np.random.default_rng(seed), sample.shape[1]
    out = []
    for _ in range(-(-bits // d)):
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(steps if len(sample) else 0):
            u, _, vt = np.linalg.svd(sample.T @ np.where(sample @ r >= 0, 1.0, -1.0))
            r = u @ vt
        out.append(r)
    return np.hstack(out)[:, :bits]


def lifted(x: np.ndarray) -> np.ndarray:
    """The component that turns inner products into angles."""
    x = x / np.linalg.norm(x, axis=1).max(initial=np.finfo(float).tiny)
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))])


def asked(y: np.ndarray) -> np.ndarray:
    """Queries among lifted vectors: their direction alone."""
    return np.hstack([y / np.linalg.norm(y, axis=1, keepdims=True), np.zeros((len(y), 1))])


def codes(x: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """Substrings of every row."""
    bits = np.concatenate([np.packbits(x[i : i + 4096] @ rotations >= 0, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros((0, rotations.shape[1] // 8), np.uint8)
    return bits.view(np.uint16)


def ring(distance: int) -> np.ndarray:
    """Substrings with exactly so many ones."""
    return np.array([sum(1 << b for b in bits) for bits in itertools.combinations(range(SUB_BITS), distance)], np.uint16)


class MultiIndex:
    """One index for each substring of a block of codes."""

    def __init__(self, code: np.ndarray) -> None:
        self.n, self.m = code.shape
        self.rows = [np.argsort(code[:, j], kind="stable").astype(np.int32) for j in range(self.m)]
        self.begin = [np.concatenate([[0], np.cumsum(np.bincount(code[:, j], minlength=1 << SUB_BITS))]).astype(np.int32) for j in range(self.m)]

    def probe(self, j: int, queries: np.ndarray, masks: np.ndarray, seen: np.ndarray) -> None:
        """Marks in `seen` (query, row) the rows whose substring j differs from the query's in one of the masks."""
        values = (queries[:, j, None] ^ masks).ravel()
        first = self.begin[j][values]
        size = self.begin[j][values.astype(np.int64) + 1] - first
        some = np.flatnonzero(size)
        own, first, size = some // len(masks), first[some], size[some]
        place = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
        seen[np.repeat(own, size), self.rows[j][place]] = True

    def widen(self, queries: np.ndarray, seen: np.ndarray, done: int, radius: int) -> None:
        """Marks what the radius retrieves beyond the radius `done`."""
        for j in range(self.m):
            for distance in range((done - j) // self.m + 1, (radius - j) // self.m + 1):
                self.probe(j, queries, ring(distance), seen)

    def retrieve(self, queries: np.ndarray, radius: int, least: int = 0) -> np.ndarray:
        """(query, row): whether the row is retrieved. Every row within the radius is, and at least `least` rows (all, if fewer)."""
        seen = np.zeros((len(queries), self.n), bool)
        self.widen(queries, seen, -1, radius)
        while len(few := np.flatnonzero(seen.sum(axis=1) < min(least, self.n))):
            more = seen[few]
            self.widen(queries[few], more, radius, radius + self.m)
            seen[few] = more
            radius += self.m
        return seen


def needed(queries: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The least radius whose probing retrieves each row for its query; both are codes, row by row."""
    m = code.shape[-1]
    return (np.bitwise_count(queries ^ code).astype(np.int32) * m + np.arange(m, dtype=np.int32)).min(axis=-1)


def measured(x: np.ndarray, rotations: np.ndarray, k: int, probers: int = PROBERS, target: float = TARGET) -> int:
    """The least radius that retrieves the share `target` of the k true neighbours of rows of x, and all of them where x has no more than k others."""
    code, asks = codes(lifted(x), rotations), np.unique(np.linspace(0, max(len(x) - 1, 0), min(probers, len(x))).astype(int))
    m, all_of_it = code.shape[1], (SUB_BITS + 1) * code.shape[1] - 1
    if len(x) <= k + 1:
        return all_of_it
    score = x[asks] @ x.T
    score[np.arange(len(asks)), asks] = -np.inf
    best = np.argpartition(-score, k, axis=1)[:, :k]
    own = codes(asked(x[asks]), rotations)
    radii = np.sort(np.concatenate([needed(own[i], code[best[i]]) for i in range(len(asks))]))
    return int(radii[int(np.ceil(target * len(radii))) - 1]) if m else 0


def _best(x: np.ndarray, rows: np.ndarray, y: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k rows of largest inner product with y and their scores; ties go to the smaller `order`."""
    near = x[rows] @ y
    if len(rows) > k:
        worst = np.partition(near, len(rows) - k)[len(rows) - k]
        rows = rows[near >= worst - 1e-9 * (1 + abs(worst))]
    score = (x[rows] * y).sum(axis=1)  # of equal vectors exactly equal
    top = np.lexsort((order[rows], -score))[:k]
    return rows[top], score[top]


def _search(k: int, learnt):
    def run(cell: pa.Table) -> pa.Table:
        asks = cell.column("asks").to_numpy()
        matrix = lambda t: t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1).astype(np.float64)
        queries, data = cell.filter(pa.array(asks)), cell.filter(pa.array(~asks))
        row, query_id, vec_id, scores = [[] for _ in range(4)]
        if queries.num_rows and data.num_rows:
            x, y = matrix(data), matrix(queries)
            d = x.shape[1]
            rotations, radius = learnt.value
            if rotations.shape[0] != d + 1:
                rotations = learn(np.zeros((0, d + 1)))
                radius = measured(x, rotations, k)
            null = data.column("vec_id").is_null().to_numpy()
            order = data.column("vec_id").fill_null(np.iinfo(np.int64).max).to_numpy()
            own, rows = queries.column("vec_id").to_numpy(), queries.column("row").to_numpy()
            index, asked_codes = MultiIndex(codes(lifted(x), rotations)), codes(asked(y), rotations)
            for at in range(0, len(y), TOGETHER):
                for i, found in enumerate(index.retrieve(asked_codes[at : at + TOGETHER], radius, k + 1), at):
                    found &= (order != own[i]) | null
                    best, score = _best(x, np.flatnonzero(found), y[i], order, k)
                    row.append(np.full(len(best), rows[i]))
                    query_id.append(np.full(len(best), own[i]))
                    vec_id.append(pa.array(order[best], mask=null[best]))
                    scores.append(score)
        flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        ids = pa.chunked_array(vec_id, pa.int64()).combine_chunks()
        return pa.table({"row": flat(row, pa.int64()), "query_id": flat(query_id, pa.int64()), "vec_id": ids, "score": flat(scores, pa.float64())})

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and embedding (single or double precision, as given) of the vectors that take part."""
    kind = vectors.schema[vector_col].dataType
    element = kind.elementType if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else T.DoubleType()
    rows = pick(vectors, vec_id=(id_col, "long"), embedding=(vector_col, T.ArrayType(element)))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.where(F.col("embedding").isNotNull() & ~bad).where(F.exists("embedding", lambda v: v != 0))


def nearest(vectors: DataFrame, k: int, every: int, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for every row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = materialise(usable(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "ann-rows")
    ask = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    kinds = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"), F.count_if(ask).alias("asks")).collect()  # a row per vector length
    if not kinds:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    most = max(kinds, key=lambda x: (x.n, x.d))
    spread = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    taken = rows.where((F.size("embedding") == most.d) & (spread < min(1.0, sample / most.n))).select("embedding").toPandas()  # about `sample` rows
    few = np.array(taken.embedding.tolist(), np.float64).reshape(-1, most.d)
    rotations = learn(lifted(few))
    learnt = spark.sparkContext.broadcast((rotations, measured(few, rotations, k)))
    data_blocks, query_blocks = max(-(-x.n // block) for x in kinds), max(1, *(-(-x.asks // queries) for x in kinds))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = [F.size("embedding").alias("d"), "row", "vec_id", "embedding"]
    data = rows.select(*columns, F.lit(False).alias("asks"), deal(data_blocks).alias("at"), each(query_blocks).alias("q"))
    asks = rows.where(ask).select(*columns, F.lit(True).alias("asks"), each(data_blocks).alias("at"), deal(query_blocks).alias("q"))
    found = data.union(asks).groupBy("d", "at", "q").applyInArrow(_search(k, learnt), _FOUND)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
