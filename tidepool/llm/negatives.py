"""Hard negatives by blocked dense matrix products.

Components become floor(scale * x). Anchors go in blocks of ANCHORS, each of which is sent to every block of
CANDIDATES rows; a task holds one of each and multiplies them in double precision, TOGETHER anchors at a time.

First pass: every task keeps the `positives` best rows of each anchor's own label; a window merges them. Second pass: the
same products again, now with the positives' scores: for each positive, the task keeps the `negatives` best rows of another label
whose score lies within the window [low, high] per cent of the positive's; a window merges them. The products are not
stored: a pass costs less than writing a score for every pair. What travels is a row for each block of anchors and an
anchor for each block of rows, and a bounded list for each anchor and task.

Rows with a null label, or a vector that is null or has null or non-finite components take no part; zero and empty vectors do. Vectors of
different lengths have no inner product and are not compared. Null ids are no anchors, keep their label, and rank last among ties. An anchor leaves out
its own row, not others that repeat it; a repeated row is an anchor of its own. Sums of products that could reach 2^53 are
made of Python's whole numbers, and scores beyond a long are cut to its ends. An empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm.common import finite_vectors, materialise
from tidepool.llm.integral import exact, floors, ids, longs

ANCHORS, CANDIDATES, TOGETHER = 16_384, 16_384, 128


def _first(k: int, rows: np.ndarray, score: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The k of `rows` with the largest scores, ties to the smaller order."""
    if len(rows) > k and score.dtype != object:
        rows = rows[score[rows] >= np.partition(score[rows], len(rows) - k)[len(rows) - k]]
    if score.dtype == object:
        return np.array(sorted(rows.tolist(), key=lambda i: (-score[i], order[i]))[:k], int)
    return rows[np.lexsort((order[rows], -score[rows]))[:k]]


def _blocks(asks: pa.Table, data: pa.Table, d: int, scale: int):
    """For each anchor of a cell: its number and its products with all rows of the cell."""
    a, c = exact(floors(asks, d, scale), floors(data, d, scale))
    for at in range(0, len(a), TOGETHER):
        yield from enumerate(a[at : at + TOGETHER] @ c.T, at)


def _positives(k: int, scale: int):
    def run(key, asks: pa.Table, data: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(3)]
        if asks.num_rows and data.num_rows:
            (order, null), rows = ids(data), data.column("row").to_numpy()
            labels, own = data.column("label").to_numpy(), asks.column("label").to_numpy()
            same = {label: np.flatnonzero(labels == label) for label in np.unique(own).tolist()}
            anchors = asks.column("row").to_pylist()
            for i, score in _blocks(asks, data, key[0].as_py(), scale):
                few = same[own[i]]
                for j in _first(k, few[rows[few] != anchors[i]], score, order):
                    for values, v in zip(out, (anchors[i], None if null[j] else int(order[j]), score[j]), strict=True):
                        values.append(v)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), longs(out[2])], ["row", "positive_id", "positive_score"])

    return run


def _negatives(k: int, scale: int, low: int, high: int):
    def run(key, asks: pa.Table, data: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(4)]
        if asks.num_rows and data.num_rows:
            (order, null), labels = ids(data), data.column("label").to_numpy()
            own, anchors, windows = asks.column("label").to_numpy(), asks.column("row").to_pylist(), asks.column("scores").to_pylist()
            for i, score in _blocks(asks, data, key[0].as_py(), scale):
                other = np.flatnonzero(labels != own[i])
                for place, positive in enumerate(windows[i]):
                    least, most = -(-low * positive // 100), high * positive // 100  # whole scores within the window
                    if least > most:
                        continue
                    for j in _first(k, other[(score[other] >= least) & (score[other] <= most)], score, order):
                        for values, v in zip(out, (anchors[i], place, None if null[j] else int(order[j]), score[j]), strict=True):
                            values.append(v)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), longs(out[3])], ["row", "place", "negative_id", "negative_score"])

    return run


def mine(vectors: DataFrame, every: int, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchors: int = ANCHORS, candidates: int = CANDIDATES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors, rows whose id is divisible by `every`: of each of their best `positives` of the same label the best `negatives` of another label with scores of `low` to `high` per cent of the positive's. `label`: what becomes of a row's label first, from columns vec_id and label."""
    usable = finite_vectors(vectors, id_col, vector_col, label=(label_col, T.LongType())).where(F.col("label").isNotNull())
    if label is not None:
        usable = usable.withColumn("label", label.cast("long"))
    rows = materialise(usable.withColumns({"d": F.size("embedding"), "row": F.monotonically_increasing_id()}), "negatives-rows")
    asks = rows.where(F.coalesce(F.col("vec_id") % every == 0, F.lit(False))).select(*[F.col(c).alias(c) for c in rows.columns])  # columns of its own beside rows'
    # By length, as vectors of a length meet only their like: a row for each.
    n = rows.groupBy("d").agg(F.count("*").alias("rows"), F.count_if(F.coalesce(F.col("vec_id") % every == 0, F.lit(False))).alias("asks"))
    most = n.agg(F.max("rows"), F.max("asks")).first()
    n_data, n_asks = max(1, -(-(most[0] or 0) // candidates)), max(1, -(-(most[1] or 0) // anchors))
    deal = lambda df, own, n_own, other, n_other: df.withColumns({own: F.pmod(F.xxhash64("row"), F.lit(n_own)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))})
    data = deal(rows, "at", n_data, "block", n_asks).groupBy("d", "at", "block")
    met = lambda df: deal(df, "block", n_asks, "at", n_data).groupBy("d", "at", "block").cogroup(data)

    found = met(asks).applyInArrow(_positives(positives, scale), "row long, positive_id long, positive_score long")
    best = Window.partitionBy("row").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    kept = found.withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < positives)
    lists = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("best"))  # `positives` at most
    asked = materialise(asks.join(lists, "row").withColumn("scores", F.col("best.positive_score")), "negatives-anchors")

    found = met(asked.drop("best")).applyInArrow(_negatives(negatives, scale, low, high), "row long, place int, negative_id long, negative_score long")
    best = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    kept = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    of = asked.select("row", F.col("vec_id").alias("anchor_id"), F.posexplode("best").alias("place", "one"))
    return kept.join(of, ["row", "place"]).select("anchor_id", F.col("one.positive_id").alias("positive_id"), "rank", "negative_id", F.col("one.positive_score").alias("positive_score"), "negative_score")


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
     s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, c.vec_id, c.label, list_inner_product(a.e, c.e)::BIGINT AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 50 = 0),
     p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 3
"""
