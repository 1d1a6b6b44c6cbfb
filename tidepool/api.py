"""A facade over the operators: ingest, recall, augment, facts, graph, log queries. Every answer is a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions.chunks import chunk_text
from tidepool.operators import cql, extract, facts, graph, ranking, search
from tidepool.operators import questions as qs
from tidepool.operators.store import Versions
from tidepool.sources import sessions


@dataclass
class Memory:
    """Tables below one folder: chunks, vectors, facts, edges. Chunks, vectors and edges are appended; facts are merged by their key. Reads see what was written."""

    spark: SparkSession
    folder: str

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(name))

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = None) -> None:
        """Cuts texts into chunks and appends them."""
        source = F.col(source_col) if source_col else F.lit("")
        each = docs.select(F.col(id_col).cast("string").alias("doc_id"), source.alias("source_id"), F.posexplode(chunk_text(text_col)).alias("nth", "content"))
        each.withColumn("chunk_id", F.concat_ws("#", "doc_id", "nth")).withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(self._path("chunks"))

    def ingest_sessions(self, path: str) -> None:
        """Appends the turns of transcript files as chunks."""
        turns = sessions.transcripts(self.spark, path).where(F.col("role").isin("user", "assistant"))
        turns.select(F.col("session_id").alias("doc_id"), F.col("file").alias("source_id"), F.col("index").alias("nth"), "content", F.concat_ws("#", "session_id", "index").alias("chunk_id"), F.current_timestamp().alias("created_at")).write.mode("append").parquet(self._path("chunks"))

    def add_vectors(self, rows: DataFrame) -> None:
        """chunk_id and embedding."""
        rows.select("chunk_id", "embedding").write.mode("append").parquet(self._path("vectors"))

    def recall(self, queries: DataFrame, k: int = 20, session: str | None = None) -> DataFrame:
        """query_id, chunk_id, content, score, rank: full-text hits of all queries at once, and neighbours of their vectors where both have some (`embedding`), fused with the weights of each query's intent; the best chunk of each document, weighed by age."""
        chunks = self._read("chunks")
        if session:
            chunks = chunks.where(F.contains("doc_id", F.lit(session)))
        n = max(100, 5 * k)
        hits = search.fulltext(search.postings(chunks, "chunk_id", "content"), queries, "chunk_id", k=n)
        if "embedding" in queries.columns:
            hits = self._fused(hits, queries, chunks, n)
        full = hits.select("query_id", "chunk_id", "score").join(chunks, "chunk_id").withColumn("score", F.col("score") * ranking.decay(F.col("created_at"), F.current_timestamp()))
        first = ranking.first_per_key(full, ["query_id"], F.col("doc_id"), F.desc("score"), F.asc("chunk_id"))
        return ranking.top_k(first, ["query_id"], k, F.desc("score"), F.asc("chunk_id")).select("query_id", "chunk_id", "content", "score", "rank")

    def _fused(self, hits: DataFrame, queries: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
        """Keyword and vector lists by reciprocal ranks."""
        vectors = self._read("vectors").join(chunks.select("chunk_id"), "chunk_id", "left_semi")
        numbers = vectors.select("chunk_id", F.xxhash64("chunk_id").alias("number"), "embedding")
        asks = queries.where("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), "embedding")
        near = search.knn_blocks(numbers, asks, n, "number", "embedding", "query_id").join(numbers.select("number", "chunk_id"), "number")
        keyword, vector = qs.weights(qs.intent(F.col("query")))
        weight = queries.select(F.col("query_id").cast("long").alias("query_id"), keyword.alias("kw"), vector.alias("vec"))
        part = lambda df, w: df.select(F.col("query_id").cast("long").alias("query_id"), "chunk_id", "rank").join(weight, "query_id").select("query_id", "chunk_id", (F.col(w) / (30 + F.col("rank"))).alias("score"))
        both = part(hits, "kw").unionByName(part(near, "vec"))
        return both.groupBy("query_id", "chunk_id").agg((F.sum("score") * F.when(F.count("*") > 1, 1.25).otherwise(1.0)).alias("score"))

    def augment(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """query_id and one block of context."""
        row = F.struct("rank", F.concat(F.lit('<memory id="'), "chunk_id", F.lit('">'), "content", F.lit("</memory>")).alias("text"))
        blocks = F.transform(F.array_sort(F.collect_list(row)), lambda x: x.text)
        return self.recall(queries, k).groupBy("query_id").agg(F.concat(F.lit("<memories>"), F.array_join(blocks, ""), F.lit("</memories>")).alias("context"))

    def _facts(self) -> Versions:
        return Versions(self.spark, self._path("facts"))

    def add_facts(self, rows: DataFrame) -> None:
        """Facts by chunk, entity, relation, value and date: one that is there keeps its id and first time, and takes the larger confidence and the newer status."""
        key = ["chunk_id", "entity_key", "relation_key", "value", "fact_date"]
        self._facts().merge(facts.keyed(rows), key, fact_id=F.min("fact_id"), confidence=F.max("confidence"), created_at=F.min("created_at"))

    def learn(self, source: str = "chunks") -> None:
        """Facts out of all chunks into the table of facts."""
        chunks = self._read(source)
        found = extract.facts(chunks, "chunk_id", "content").join(chunks.select("chunk_id", "created_at"), "chunk_id")
        named = found.select(F.xxhash64("chunk_id", "entity", "relation", "value", "date").alias("fact_id"), "chunk_id", "entity", "relation", "value", F.col("date").alias("fact_date"), "confidence", F.lit("").alias("status"), "created_at")
        self.add_facts(named)

    def _known(self) -> DataFrame:
        found = self._facts().read()
        if found is None:
            raise ValueError("no facts have been added")
        return found

    def current(self) -> DataFrame:
        return facts.with_current(self._known()).where("is_current")

    def truth(self) -> DataFrame:
        return facts.truth(self._known())

    def conflicts(self) -> DataFrame:
        return facts.conflicts(self._known())

    def add_edges(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self._path("edges"))

    def graph_query(self, seeds: DataFrame, depth: int = 2, per_hop: int = 200) -> DataFrame:
        return graph.bfs(self._read("edges"), seeds, depth, per_hop)

    def status(self) -> DataFrame:
        return self._read("chunks").agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"), F.max("created_at").alias("newest"))

    def log_query(self, rows: DataFrame, query: str) -> DataFrame:
        return cql.execute(rows, query)
