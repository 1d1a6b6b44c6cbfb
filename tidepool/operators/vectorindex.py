"""A stored inverted-file index of vectors: cells as folders, product-quantised residuals, exact reranking.

Fitted once, on a bounded sample of SAMPLE vectors: centres of cells, about as many as the square root of the rows, codebooks for the
residuals of PARTS slices of the dimensions, and the number of cells that a query probes, which is measured: the least that
holds the share TARGET of the true neighbours within the sample. All this is one small file. Rows are written once, in a folder for each cell,
with their code of a byte a slice beside the vector; an append writes files beside them under the same model, a removal a list of ids.

A search opens the folders of the probed cells alone and reads ids and codes of these; what a code says of the inner product is the sum of
entries in a table for the query. The best RERANK times k by that are looked up and scored by their vectors. A cell of more than
BLOCK rows, as copies make one, is dealt into blocks, each of which meets the cell's queries in a task.

A query probes further cells until they hold k rows. Vectors are scaled to length 1, so scores are cosines; null, zero or non-finite ones, those
of another length than the model, and rows without an id are left out.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators import ranking, search, store

SAMPLE, PARTS, CODES, STEPS = 16_384, 16, 256, 12
LEAST_CELLS, MOST_CELLS = 16, 4096
PROBERS, TARGET, RERANK, BLOCK = 256, 0.95, 10, 8192


def centres(x: np.ndarray, k: int, steps: int = STEPS, seed: int = 7) -> np.ndarray:
    """k-means of a sample; a centre without rows stays where it is."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        near = nearest(x, c)
        for i in np.unique(near):
            c[i] = x[near == i].mean(axis=0)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


class VectorIndex:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        at, fs = self._file("model")
        self.model = None
        if fs.exists(at):
            stream = fs.open(at)
            raw = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            self.model = {"probes": raw["probes"], "centres": np.array(raw["centres"]), "books": [np.array(b) for b in raw["books"]]}

    def _file(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    # Writing

    def build(self, vectors: DataFrame, id_col: str, vector: str, sample: int = SAMPLE, target: float = TARGET, k: int = 20) -> VectorIndex:
        """Fits the model and writes all rows."""
        rows = self._rows(vectors, id_col, vector)
        sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
        if not sizes:
            return self
        d, n = sizes[0]
        spread = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
        taken = rows.where((F.size("v") == d) & (spread < min(1.0, sample / n))).select("v").toPandas()  # about `sample` rows
        x = np.array(taken.v.tolist(), float).reshape(-1, d)
        c = centres(x, min(MOST_CELLS, max(LEAST_CELLS, int(n**0.5))))
        cell = nearest(x, c)
        books = [centres(part, CODES) for part in np.array_split(x - c[cell], min(PARTS, d), axis=1)]
        self.model = {"probes": probes_needed(x, c, cell, k, target), "centres": c, "books": books}
        at, fs = self._file("model")
        out = fs.create(at.suffix("-half"), True)
        out.write(json.dumps({"probes": self.model["probes"], "centres": c.tolist(), "books": [b.tolist() for b in books]}).encode())
        out.close()
        fs.delete(at, False)
        fs.rename(at.suffix("-half"), at)
        return self.append(vectors, id_col, vector)

    def _rows(self, vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
        fine = ~F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
        return vectors.where(F.col(vector).isNotNull() & fine & F.exists(F.col(vector), lambda x: x != 0) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), search.normalised(vector).alias("v"))

    def append(self, vectors: DataFrame, id_col: str, vector: str) -> VectorIndex:
        """More rows under the model that is there."""
        c, books = self.model["centres"], self.model["books"]
        sent = self.spark.sparkContext.broadcast((c, books))

        def run(batches):
            c, books = sent.value
            cuts = np.cumsum([b.shape[1] for b in books])[:-1]
            for batch in batches:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), c.shape[1])
                cell = nearest(x, c)
                code = np.stack([nearest(part, b) for part, b in zip(np.split(x - c[cell], cuts, axis=1), books, strict=True)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(cell.astype(np.int32))], ["id", "v", "code", "cell"])

        placed = self._rows(vectors, id_col, vector).where(F.size("v") == c.shape[1]).mapInArrow(run, "id long, v array<double>, code binary, cell int")
        placed.hint("rebalance", "cell").write.mode("append").option("compression", "zstd").partitionBy("cell").parquet(f"{self.folder}/rows")
        return self

    def remove(self, ids: DataFrame, id_col: str) -> VectorIndex:
        """These rows are found no more; an id stays out until the index is built anew."""
        ids.select(F.col(id_col).cast("long").alias("id")).distinct().write.mode("append").parquet(f"{self.folder}/gone")
        return self

    # Reading

    def rows(self) -> DataFrame:
        rows = self.spark.read.schema("id long, v array<double>, code binary, cell int").parquet(f"{self.folder}/rows")
        at, fs = self._file("gone")
        return rows.join(self.spark.read.parquet(f"{self.folder}/gone").distinct(), "id", "left_anti") if fs.exists(at) else rows

    def search(self, queries: DataFrame, k: int, id_col: str, vector: str, query_id: str, probes: int | None = None, rerank: int = RERANK, digits: int = 6, counters: dict | None = None) -> DataFrame:
        """query_id, id, score and rank of the k nearest found for each query, the row of its own id left out. `counters` gets the cells and rows whose codes were read, summed over the queries, and all there are."""
        spark, kind = self.spark, f"{query_id} long, {id_col} long, score double"
        if self.model is None:
            return spark.createDataFrame([], f"{kind}, rank int")
        c, books = self.model["centres"], self.model["books"]
        probes = min(len(c), probes or self.model["probes"])
        held = {r.cell: r["count"] for r in self.rows().groupBy("cell").count().collect()}  # a row a cell
        sent = spark.sparkContext.broadcast((c, books, np.array([held.get(i, 0) for i in range(len(c))])))

        def probe(batches):
            c, _, held = sent.value
            for batch in batches:
                q = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), c.shape[1])
                cells = np.argsort(-(q @ c.T), axis=1, kind="stable").astype(np.int32)
                enough = np.maximum(probes, (np.cumsum(held[cells], axis=1) <= k).sum(axis=1) + 1)  # its own row beside k others
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array([x[:n] for x, n in zip(cells, enough, strict=True)], pa.list_(pa.int32()))], ["query", "q", "cells"])

        asks = store.kept(self._rows(queries, query_id, vector).where(F.size("v") == c.shape[1]).mapInArrow(probe, "query long, q array<double>, cells array<int>"), "ivf-asks")
        each = asks.select("query", "q", F.explode("cells").alias("cell"))
        opened = [r.cell for r in each.select("cell").distinct().collect()]  # MOST_CELLS at most
        mine = self.rows().where(F.col("cell").isin(opened))
        blocks = F.broadcast(spark.createDataFrame([(i, n, -(-n // BLOCK)) for i, n in held.items()], "cell int, n long, blocks int"))
        if counters is not None:
            read = each.join(blocks, "cell").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            counters.update(cells=len(opened), of_cells=len(c), probes=probes, read=read, of_rows=asks.count() * sum(held.values()))
        most = rerank * k

        def best(key, left: pa.Table, right: pa.Table) -> pa.Table:
            c, books, _ = sent.value
            out: list[list[np.ndarray]] = [[], [], []]
            if len(left) and len(right):
                ids = right.column("id").to_numpy()
                codes = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(len(ids), len(books))
                cuts = np.cumsum([b.shape[1] for b in books])[:-1]
                asked = left.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(left), c.shape[1])
                for query, q in zip(left.column("query").to_numpy(), asked, strict=True):
                    score = sum((b @ part)[codes[:, j]] for j, (part, b) in enumerate(zip(np.split(q, cuts), books, strict=True))) + q @ c[key[0].as_py()]
                    score = np.where(ids == query, -np.inf, score)
                    few = np.argpartition(-score, most - 1)[:most] if len(score) > most else np.arange(len(score))
                    few = few[score[few] > -np.inf]
                    for values, v in zip(out, (np.full(len(few), query), ids[few], score[few]), strict=True):
                        values.append(v)
            one = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
            return pa.table({"query": one(out[0], pa.int64()), "id": one(out[1], pa.int64()), "about": one(out[2], pa.float64())})

        left = each.join(blocks, "cell").select("query", "q", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        right = mine.select("id", "code", "cell").join(blocks, "cell").select("id", "code", F.col("cell").alias("cell"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
        about = left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(best, "query long, id long, about double")
        few = ranking.top_k(about, ["query"], most, F.desc("about"), F.asc("id")).select("query", "id")
        found = few.join(mine.select("id", "v"), "id").join(asks.select("query", "q"), "query").select(F.col("query").alias(query_id), F.col("id").alias(id_col), F.round(search.dot("v", "q"), digits).alias("score"))
        return ranking.top_k(found, [query_id], k, F.desc("score"), F.asc(id_col))


def probes_needed(x: np.ndarray, c: np.ndarray, cell: np.ndarray, k: int, target: float, probers: int = PROBERS) -> int:
    """Cells to probe, so that the share `target` of the k nearest rows of rows of x is in them."""
    if len(x) <= k + 1:
        return len(c)
    asks = np.unique(np.linspace(0, len(x) - 1, min(probers, len(x))).astype(int))
    score = x[asks] @ x.T
    score[np.arange(len(asks)), asks] = -np.inf
    best = np.argpartition(-score, k, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(x[asks] @ c.T), axis=1, kind="stable"), axis=1)
    need = np.sort(np.concatenate([place[i, cell[best[i]]] for i in range(len(asks))]))
    return int(need[int(np.ceil(target * len(need))) - 1]) + 1
