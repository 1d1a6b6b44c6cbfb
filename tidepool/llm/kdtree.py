"""Exact search for the largest whole-number inner products by KD-trees, one per shard.

Components become floor(scale * x). Shards: median splits of a bounded sample of SAMPLE rows route every
row to one of at most ROUTES regions (they only say where a row lies, not what is found); a region of more
than SHARD rows, such as one that holds thousands of copies of a vector, is dealt into several shards.

Tree: a shard is split at the median of its widest component (equal values go by id) down to LEAF rows;
every node has the tight box of its rows and their smallest id. A query's inner product with any row of a box is
at most q+ . high + q- . low. Traversal is best-first by that bound, and ends at the first node that can hold
nothing better than the k-th found, by score and then by id.

Two rounds: each query first meets the shard of its own row. The k-th score found there goes with it to all
other shards as the bound from which their traversals begin, so that a shard whose box lies below is left at its
root. A task has the roots of GROUP shards in one queue, so the bound also passes from shard to shard. A window
merges what the tasks return. Nothing is approximate: a node is only left out on its bound.

Queries go in blocks of QUERIES; a task holds GROUP shards and one block. A row travels once for each block of
queries, a query once for each group of shards. Memory is that of a group and a block.

Vectors null or with null or non-finite components take no part; zero and empty ones do. Vectors of different
lengths have no inner product and are not compared. A query leaves out its own row, not others that repeat it; a
repeated row is a query of its own. Null ids are no queries and rank last among ties. Sums of products that could reach 2^53 are made of
Python's whole numbers, and scores beyond a long are cut to its ends. An empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm.common import finite_vectors, materialise
from tidepool.llm.integral import EXACT, MOST, exact, floors, ids, longs

SAMPLE, ROUTES = 16_384, 256
SHARD, GROUP, LEAF, QUERIES = 8192, 4, 128, 32_768
_FOUND = "row long, query_id long, vec_id long, score long"


class Tree:
    """Nodes in arrays: the range of sorted rows, tight box, smallest id and children of each."""

    def __init__(self, x: np.ndarray, order: np.ndarray, leaf: int = LEAF) -> None:
        """x: rows; order: what ties go by."""
        self.rows, self.leaf = np.arange(len(x)), leaf
        self.begin, self.end, self.left, self.low, self.high, self.least = [], [], [], [], [], []
        if len(x):
            self._grow(x, order)
        self.x, self.order = x[self.rows], order[self.rows]
        self.low, self.high = (np.stack(side) if side else x[:0] for side in (self.low, self.high))

    def _grow(self, x: np.ndarray, order: np.ndarray) -> None:
        self._node(x, order, 0, len(x))
        at = 0
        while at < len(self.begin):  # children of a node lie side by side
            a, b = self.begin[at], self.end[at]
            if b - a > self.leaf:
                own = self.rows[a:b]
                widest = int(np.argmax(self.high[at] - self.low[at])) if x.shape[1] else 0
                key = x[own, widest] if x.shape[1] else order[own]
                by = np.lexsort((order[own], key)) if key.dtype != object else np.array(sorted(range(b - a), key=lambda i: (key[i], order[own[i]])))
                self.rows[a:b] = own[by]
                self.left[at] = len(self.begin)
                middle = (a + b) // 2
                self._node(x, order, a, middle)
                self._node(x, order, middle, b)
            at += 1

    def _node(self, x: np.ndarray, order: np.ndarray, a: int, b: int) -> None:
        own = self.rows[a:b]
        self.begin.append(a)
        self.end.append(b)
        self.left.append(-1)
        self.low.append(x[own].min(axis=0))
        self.high.append(x[own].max(axis=0))
        self.least.append(order[own].min())

    def children(self, at: int, above: np.ndarray, below: np.ndarray) -> list[tuple]:
        """The two children of a node as (-bound, smallest id, node)."""
        child = self.left[at]
        bounds = self.high[child : child + 2] @ above + self.low[child : child + 2] @ below
        return [(-bounds[i], self.least[child + i], child + i) for i in (0, 1)]


def best(trees: list[Tree], q: np.ndarray, k: int, kth: tuple | None = None, own: tuple[int, int] = (-1, -1)) -> tuple[list[tuple], int]:
    """The k best rows of some trees as (-score, order, tree, row), and the number of leaves read. kth: (-score, order) that a row has to reach or pass, from searches elsewhere. own: a tree and row that is left out."""
    found: list[tuple] = []
    above, below = np.where(q > 0, q, 0), np.where(q < 0, q, 0)
    heap = [(-(t.high[0] @ above + t.low[0] @ below), t.least[0], i, 0) for i, t in enumerate(trees) if t.begin]
    heapq.heapify(heap)
    leaves = 0
    while heap and (kth is None or heap[0][:2] <= kth):
        _, _, i, at = heapq.heappop(heap)
        t = trees[i]
        if t.left[at] >= 0:
            for bound, least, child in t.children(at, above, below):
                if kth is None or (bound, least) <= kth:
                    heapq.heappush(heap, (bound, least, i, child))
            continue
        leaves += 1
        a, b = t.begin[at], t.end[at]
        score = t.x[a:b] @ q
        few = range(b - a) if kth is None else np.flatnonzero(score >= -kth[0])
        hits = [(-score[j], t.order[a + j], i, t.rows[a + j]) for j in few]
        found = sorted([*found, *(h for h in hits if h[2:] != own and (kth is None or h[:2] <= kth))])[:k]
        if len(found) == k and (kth is None or found[-1][:2] < kth):
            kth = found[-1][:2]
    return found, leaves


def routes(sample: np.ndarray, most: int) -> list[tuple[int, float, int, int]]:
    """Median splits of a sample into at most `most` regions: (component, value, child below, child from there); children under 0 are regions -1 - child."""
    splits: list[tuple[int, float, int, int]] = []
    regions = 0

    def grow(x: np.ndarray, parts: int) -> int:
        nonlocal regions
        spread = x.max(axis=0) - x.min(axis=0) if len(x) and x.shape[1] else np.zeros(0)
        if parts > 1 and len(spread) and spread.max() > 0:
            at = int(spread.argmax())
            value = float(np.median(x[:, at]))
            if not (x[:, at] < value).any():
                value = float(np.unique(x[:, at])[1])
            me = len(splits)
            splits.append((at, value, 0, 0))
            below = x[:, at] < value
            splits[me] = (at, value, grow(x[below], parts // 2), grow(x[~below], parts - parts // 2))
            return me
        regions += 1
        return -regions

    grow(sample, most)
    return splits


def routed(x: np.ndarray, splits: list[tuple[int, float, int, int]]) -> np.ndarray:
    """The region of every row."""
    out = np.zeros(len(x), np.int32)
    todo = [(0, np.arange(len(x)))] if splits else []
    while todo:
        node, rows = todo.pop()
        at, value, *children = splits[node]
        below = x[rows, at] < value
        for child, own in zip(children, (rows[below], rows[~below]), strict=True):
            if child < 0:
                out[own] = -1 - child
            else:
                todo.append((child, own))
    return out


def _router(splits, d: int):
    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            size = table.column("d").to_numpy()
            region = np.zeros(len(size), np.int32)
            here = np.flatnonzero(size == d)
            if len(here):
                region[here] = routed(floors(table.take(here), d, 1), splits.value)
            yield batch.append_column("region", pa.array(region, pa.int32()))

    return run


def _search(k: int, scale: int, leaf: int, home: bool):
    """Of a cell of shards and queries: the k best of each query, in the shard of its own row or in all others."""

    def run(key, asks: pa.Table, data: pa.Table) -> pa.Table:
        d = key[0].as_py()
        out: list[list] = [[] for _ in range(4)]
        if asks.num_rows and data.num_rows:
            x, q = exact(floors(data, d, scale), floors(asks, d, scale))
            order, null = ids(data)
            shard, rows = data.column("shard").to_numpy(), data.column("row").to_numpy()
            members = {s: np.flatnonzero(shard == s) for s in np.unique(shard).tolist()}
            trees = {s: Tree(x[m], order[m], leaf) for s, m in members.items()}
            asked = [asks.column(c).to_pylist() for c in ("row", "vec_id", "shard", "floor_score", "floor_id")]
            for i, (row, query_id, own, score, least) in enumerate(zip(*asked, strict=True)):
                names = [own] if home else [s for s in trees if s != own]
                me = (0, int(np.flatnonzero(rows[members[own]] == row)[0])) if home else (-1, -1)
                for minus, _, tree, at in best([trees[s] for s in names], q[i], k, None if score is None else (-score, least), me)[0]:
                    place = members[names[tree]][at]
                    for values, v in zip(out, (row, query_id, None if null[place] else int(order[place]), -minus), strict=True):
                        values.append(v)
        return pa.table([*[pa.array(v, pa.int64()) for v in out[:3]], longs(out[3])], ["row", "query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, k: int, every: int, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, group: int = GROUP, leaf: int = LEAF, queries: int = QUERIES, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score of the k largest inner products for every row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    usable = finite_vectors(vectors, id_col, vector_col).withColumn("d", F.size("embedding"))
    rows = materialise(usable.withColumn("row", F.monotonically_increasing_id()), "kd-rows")
    sizes = rows.groupBy("d").count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    d, n = sizes[0]
    spread = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    taken = rows.where((F.col("d") == d) & (spread < min(1.0, sample / n))).select("embedding").toPandas()  # about `sample` rows
    splits = spark.sparkContext.broadcast(routes(np.array(taken.embedding.tolist(), np.float64).reshape(-1, d), min(ROUTES, max(1, -(-n // shard)))))
    placed = materialise(rows.mapInArrow(_router(splits, d), T.StructType([*rows.schema, T.StructField("region", T.IntegerType())])), "kd-placed")
    # A row for each region, of which there are ROUTES at most, and for each other length.
    begin, regions = Counter(), []
    for r in placed.groupBy("d", "region").count().orderBy("d", "region").collect():
        parts = -(-r["count"] // shard)
        regions.append((r.d, r.region, parts, begin[r.d]))
        begin[r.d] += parts
    dealt = F.broadcast(spark.createDataFrame(regions, "d int, region int, parts long, begin long"))
    groups = F.broadcast(spark.createDataFrame([(size, -(-total // group)) for size, total in begin.items()], "d int, groups long"))
    data = placed.join(dealt, ["d", "region"]).withColumn("shard", F.col("begin") + F.pmod(F.xxhash64("row"), F.col("parts"))).drop("region", "parts", "begin")
    asks = data.where(F.coalesce(F.col("vec_id") % every == 0, F.lit(False))).select(*[F.col(c).alias(c) for c in data.columns])  # columns of its own beside data's
    null = F.lit(None).cast("long")
    first = asks.withColumns({"floor_score": null, "floor_id": null}).groupBy("d", "shard").cogroup(data.groupBy("d", "shard"))
    home = materialise(first.applyInArrow(_search(k, scale, leaf, True), _FOUND), "kd-home")
    kth = F.max(F.struct((-F.col("score")).alias("minus"), F.coalesce("vec_id", F.lit(MOST)).alias("id")))
    known = home.groupBy("row").agg(F.count("*").alias("n"), kth.alias("kth")).where((F.col("n") == k) & (F.abs("kth.minus") < EXACT))
    known = known.select("row", (-F.col("kth.minus")).alias("floor_score"), F.col("kth.id").alias("floor_id"))
    blocks = max(1, -(-asks.count() // queries))
    every_one = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    away = asks.join(known, "row", "left").join(groups, "d").withColumns({"block": F.pmod(F.xxhash64("row", F.lit(2)), F.lit(blocks)), "at": every_one(F.col("groups"))})
    there = data.withColumns({"at": F.floor(F.col("shard") / group), "block": every_one(F.lit(blocks).cast("long"))})
    found = home.union(away.groupBy("d", "at", "block").cogroup(there.groupBy("d", "at", "block")).applyInArrow(_search(k, scale, leaf, False), _FOUND))
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""
