"""A stored inverted index in blocks, with the bounds that let a search leave most of them unread.

A generation is what one append has written: the documents with their terms (`forward`), and the postings (`blocks`). Documents of a
generation are cut by their size into ranges of about RANGE; those of one size that are more are dealt by a hash of the id. A block holds the postings of one term in
one range (ids, how often, sizes) and, beside them, the largest frequency and the smallest size, which bound the
score of any document in it whatever the collection's statistics become. Blocks lie in one folder for each of BUCKETS hashes of
terms, sorted by term, so that a search opens the folders of its terms alone.

A deletion is a generation too: ids with the generation up to which they are gone, and what their terms lose in
document frequency, which `forward` tells. `compact` writes all that lives as one generation that replaces those before.
A generation counts once its statistics are written, as the last of its files; its number is claimed by creating a file, so two
writers never write the same one, and readers never see half of one.

Search (BM25 over whole terms): the blocks' bounds are read without the postings, and added up by query and range. The
best ranges of each query are scored, which gives a k-th score; of all others only those whose bound reaches it are read. Blocks of one
range meet in an equi-join, so nothing is gathered in one task, and a frequent term is spread over its ranges.
Results are those of a search through everything.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators import ranking, search, store
from tidepool.session import remove, shared_dir

BUCKETS, RANGE = 64, 128
#: Indexes of another format are not opened.
FORMAT = "4"
#: Tokens of a task that makes blocks, and postings of one that scores them; tasks of a fixed size keep their tables in memory, however large the collection.
TOKENS, SCORED = 2_000_000, 8_000_000
#: What stands between terms that travel; no term holds it.
JOINT = "\n"
#: Ranges of each query that are scored first.
SEEDS = 3
#: Terms that a scan looks for by name; with more of them, their folders are read and joined.
PUSHED = 1000
#: Pairs of a query and a range up to which they are sent to all tasks that read blocks.
NAMED = 2_000_000
#: Scores are rounded to so many digits, as their ties go by id.
DIGITS = 6


def stems(text: Column) -> Column:
    """Terms without their commonest endings."""
    return F.transform(search.tokens(text), search.stem)


def _ranges(sizes: list[tuple[int, int]], most: int) -> list[tuple[int, int, int]]:
    """(size, first range, ranges) of each size of documents (size, how many): sizes next to each other share a range of `most` documents, a size of more has ranges of its own, among which ids are dealt."""
    out, at, held = [], -1, most
    for size, n in sizes:
        parts = -(-n * 5 // (4 * most)) if n > most else 1  # four fifths full, as hashes deal unevenly
        if parts > 1 or held + n > most:
            at, held = at + 1, 0
        out.append((size, at, parts))
        at, held = at + parts - 1, (most if parts > 1 else held + n)
    return out


class Index:
    """An index below a folder; `terms` makes an array of terms of a text, for documents and queries alike."""

    def __init__(self, spark: SparkSession, folder: str, terms: Callable[[Column], Column] = search.tokens, buckets: int = BUCKETS, range_: int = RANGE) -> None:
        self.spark, self.folder, self.terms, self.buckets, self.range = spark, folder.rstrip("/"), terms, buckets, range_

    # Generations

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _claim(self) -> int:
        """The next number that no writer has."""
        at, fs = self._fs(f"{self.folder}/*/claim")
        n = max([0, *(int(f.getPath().getParent().getName()) for f in fs.globStatus(at) or [])]) + 1
        while True:
            at, fs = self._fs(f"{self.folder}/{n:06d}/claim")
            fs.mkdirs(at.getParent())
            if fs.createNewFile(at):
                return n
            n += 1

    def _commit(self, n: int, **stats: int) -> None:
        """The statistics of a generation, written whole under another name first: from then on it counts."""
        at, fs = self._fs(f"{self.folder}/{n:06d}/stats")
        half = at.suffix("-half")
        out = fs.create(half, True)
        out.writeBytes(json.dumps({"replaces": 0, "postings": 0} | stats))
        out.close()
        if not fs.rename(half, at):
            raise RuntimeError(f"generation {n} cannot be written to {self.folder}")

    def generations(self) -> dict[int, dict]:
        """The statistics of all whole generations that no later one replaces; a small file each."""
        at, fs = self._fs(f"{self.folder}/*/stats")
        found = {}
        for f in fs.globStatus(at) or []:
            stream = fs.open(f.getPath())
            found[int(f.getPath().getParent().getName())] = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
        last = max((x["replaces"] for x in found.values()), default=0)
        return {n: found[n] for n in sorted(found) if n > last}

    def _part(self, part: str, live: dict[int, dict]) -> DataFrame | None:
        """A part of all generations that have it."""
        paths = [self._at(part, n) for n in live if part in live[n]["parts"]]
        return self.spark.read.option("basePath", f"{self.folder}/{part}").parquet(*paths) if paths else None

    def _at(self, part: str, n: int) -> str:
        return f"{self.folder}/{part}/generation={n}"

    # Writing

    def append(self, docs: DataFrame, id_col: str, *columns: str) -> Index:
        """Documents with an id that the index does not have; those without a term are left out."""
        terms = self.terms(F.concat_ws(" ", *columns))
        return self._add(docs.select(F.col(id_col).cast("long").alias("id"), terms.alias("terms")).select("id", F.size("terms").alias("size"), "terms").where("size > 0"))

    def _add(self, docs: DataFrame, replaces: int = 0) -> Index:
        n = self._claim()
        docs.write.option("compression", "zstd").parquet(self._at("forward", n))
        forward = self.spark.read.parquet(self._at("forward", n))
        sizes = sorted((r["size"], r["count"]) for r in forward.groupBy("size").count().collect())  # a row a length
        docs, size = sum(c for _, c in sizes), sum(s * c for s, c in sizes)
        ranges = self.spark.createDataFrame(_ranges(sizes, self.range), "size int, first long, parts long")
        # Documents are dealt once, by range; all that is counted lies within one.
        placed = forward.join(F.broadcast(ranges), "size").withColumn("range", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")))
        # Their terms travel as one string, without the places of an array.
        moved = placed.select("range", "id", "size", F.array_join("terms", JOINT).alias("terms")).repartition(1 + size // TOKENS, "range")
        each = moved.select("range", "id", "size", F.explode(F.split("terms", JOINT)).alias("term"))
        counts = each.groupBy("term", "range", "id", "size").agg(F.count("*").cast("int").alias("tf"))
        held = F.sort_array(F.collect_list(F.struct("id", "tf", "size")))  # about RANGE at most
        blocks = counts.groupBy("term", "range").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("size").alias("min_size"), held.alias("held"))
        blocks = blocks.select("term", "range", "n", "max_tf", "min_size", *[F.col(f"held.{c}").alias(f"{c}s") for c in ("id", "tf", "size")])  # as arrays of numbers, a third of their size as rows
        blocks = blocks.withColumn("bucket", self._bucket(F.col("term"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "range")
        blocks.write.option("compression", "zstd").partitionBy("bucket").parquet(self._at("blocks", n))
        postings = self.spark.read.parquet(self._at("blocks", n)).agg(F.sum("n")).first()[0] if docs else 0
        self._commit(n, docs=docs, size=size, postings=postings, replaces=replaces, parts=["forward", "blocks"] if docs else [])
        return self

    def delete(self, ids: DataFrame, id_col: str) -> Index:
        """The documents with these ids are found no more; ids that are not there change nothing."""
        live = self._live(self.generations())
        if live is None:
            return self
        gone = store.kept(live.join(ids.select(F.col(id_col).cast("long").alias("id")).distinct(), "id").select("id", "size", F.array_distinct("terms").alias("terms")), "index-gone")
        n = self._claim()
        gone.select("id", F.lit(n).alias("until")).write.parquet(self._at("gone", n))
        lost = gone.select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count("*")).alias("n"))
        lost.withColumn("bucket", self._bucket(F.col("term"))).write.parquet(self._at("lost", n))
        docs, size = gone.agg(-F.count("*"), F.coalesce(-F.sum("size"), F.lit(0))).first()
        self._commit(n, docs=docs, size=size, parts=["gone", "lost"])
        return self

    def update(self, docs: DataFrame, id_col: str, *columns: str) -> Index:
        """Documents in place of those with their ids, or beside them."""
        return self.delete(docs, id_col).append(docs, id_col, *columns)

    def compact(self) -> Index:
        """All that lives as one generation; those before go."""
        old = self.generations()
        live = self._live(old)
        if live is not None:
            self._add(live.select("id", "size", "terms"), replaces=max(old))
            for n, x in old.items():
                for part in x["parts"]:
                    remove(self.spark, self._at(part, n))
        return self

    def _live(self, live: dict[int, dict]) -> DataFrame | None:
        docs = self._part("forward", live)
        return None if docs is None else self._without_gone(docs.select("id", "size", "terms", "generation"), live)

    def _without_gone(self, hits: DataFrame, live: dict[int, dict]) -> DataFrame:
        """Rows with id and generation that no later deletion names."""
        gone = self._part("gone", live)
        if gone is None:
            return hits
        last = gone.groupBy("id").agg(F.max("until").alias("until"))
        return hits.join(last, "id", "left").where("until IS NULL OR generation > until").drop("until")

    # Reading

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def search(self, queries: DataFrame, id_col: str, k: int = 10, query_id: str = "query_id", query: str = "query", require_all: bool = False, pruned: bool = True, seeds: int = SEEDS, counters: dict | None = None) -> DataFrame:
        """query_id, id, score and rank of the k best documents of every query; with `require_all` only those that hold all its terms. `counters` gets what was read: folders, postings of the queries' terms and of the blocks that were opened, both summed over the queries, and all postings there are."""
        spark, live = self.spark, self.generations()
        wanted = queries.select(query_id, F.explode(F.array_distinct(self.terms(F.col(query)))).alias("term")).withColumn("bucket", self._bucket(F.col("term")))
        rows = wanted.limit(search.TERMS + 1).collect()
        few = len(rows) <= search.TERMS
        wanted = spark.createDataFrame(rows, wanted.schema) if few else store.kept(wanted, "index-asked")
        blocks = self._part("blocks", live)
        if blocks is None or not rows:
            return spark.createDataFrame([], f"{query_id} {queries.schema[query_id].dataType.simpleString()}, {id_col} long, score double, rank int")
        folders = sorted({r.bucket for r in rows}) if few else list(range(self.buckets))
        words = {r.term for r in rows} if few else set()
        mine = blocks.where(F.col("bucket").isin(folders))
        if 0 < len(words) <= PUSHED:
            mine = mine.where(F.col("term").isin(sorted(words)))
        n_docs, size, every = (sum(x[c] for x in live.values()) for c in ("docs", "size", "postings"))
        mean = size / max(n_docs, 1)
        asked = wanted.select("term").distinct()
        heads = mine.select("term", "generation", "range", "n", "max_tf", "min_size").join(F.broadcast(asked) if few else asked, "term", "left_semi")
        counts = heads.groupBy("term").agg(F.sum("n").alias("df"))
        lost = self._part("lost", live)
        if lost is not None:
            less = lost.where(F.col("bucket").isin(folders)).groupBy("term").agg(F.sum("n").alias("less"))
            counts = counts.join(less, "term", "left").select("term", (F.col("df") + F.coalesce("less", F.lit(0))).alias("df")).where("df > 0")
        idf = F.greatest(F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        weights = wanted.select(query_id, "term").join(counts, "term").select(query_id, "term", idf.alias("idf"))
        part = lambda tf, size: F.col("idf") * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * size / F.lit(mean)))
        bounds = store.kept(heads.join(weights, "term").select(query_id, "generation", "range", "term", "idf", "n", part(F.col("max_tf"), F.col("min_size")).alias("bound")), "index-bounds")
        place = [query_id, "generation", "range"]
        ranges = bounds.groupBy(*place).agg(F.sum("bound").alias("bound"), F.count("*").alias("terms"))
        n_terms = wanted.groupBy(query_id).agg(F.count("*").alias("n_terms"))
        if require_all:
            ranges = ranges.join(n_terms, query_id).where("terms = n_terms").drop("n_terms")

        def scored(some: DataFrame) -> DataFrame:
            """Scores of all documents in some ranges of queries."""
            some = store.kept(some.select(*place), "index-ranges")
            need = bounds.join(some, place, "left_semi")
            n_asked = need.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            lists = mine.select("term", "generation", "range", "ids", "tfs", "sizes")
            if few and some.count() <= NAMED:
                # Who asks for a term and who for a range is told apart, so that blocks are not moved to meet their queries.
                who = weights.groupBy("term").agg(F.collect_list(F.struct(query_id, "idf")).alias("all"))
                where = some.groupBy("generation", "range").agg(F.collect_set(query_id).alias("of"))
                lists = lists.join(F.broadcast(who), "term").join(F.broadcast(where), ["generation", "range"])
                lists = lists.withColumn("asks", F.filter("all", lambda x: F.array_contains("of", x[query_id]))).where("size(asks) > 0").drop("all", "of")
            else:
                asks = need.groupBy("term", "generation", "range").agg(F.collect_list(F.struct(query_id, "idf")).alias("asks"))
                lists = lists.join(asks, ["term", "generation", "range"])
            # A block travels once for all queries that ask it, to where its range is; documents are added up there.
            post = lists.repartition(1 + n_asked // SCORED, "generation", "range").select("generation", "range", "ids", "tfs", "sizes", F.inline("asks"))
            post = post.select(query_id, "generation", "range", "idf", F.inline(F.arrays_zip("ids", "tfs", "sizes"))).withColumnsRenamed({"ids": "id", "tfs": "tf", "sizes": "size"})
            hits = post.groupBy(query_id, "generation", "range", "id").agg(F.round(F.sum(part(F.col("tf"), F.col("size"))), DIGITS).alias("score"), F.count("*").alias("found")).drop("range")
            hits = self._without_gone(hits, live)
            return hits.join(n_terms, query_id).where("found = n_terms").drop("n_terms") if require_all else hits

        best = lambda hits: ranking.top_k(hits.select(query_id, F.col("id").alias(id_col), "score"), [query_id], k, F.desc("score"), F.asc(id_col))
        if not pruned:
            return best(scored(ranges))
        first = ranking.top_k(ranges, [query_id], seeds, F.desc("bound"), F.asc("generation"), F.asc("range")).drop("rank")
        hits = store.kept(scored(first), "index-hits")
        kth = ranking.top_k(hits, [query_id], k, F.desc("score"), F.asc("id")).where(F.col("rank") == k).select(query_id, F.col("score").alias("kth"))
        rest = ranges.join(kth, query_id, "left").where(f"kth IS NULL OR bound >= kth - {2 * 10**-DIGITS}").join(first.select(*place), place, "left_anti")
        if counters is not None:
            total = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            opened = bounds.join(first.select(*place).union(rest.select(*place)), place, "left_semi")
            counters.update(folders=len(folders), of_folders=self.buckets, asked=total(bounds), opened=total(opened), postings=every)
        return best(hits.union(scored(rest)))


def source_folder(spark: SparkSession, source: str, *what: str) -> str:
    """The folder, in the shared one, of what is made of the files at `source` in the way that `what` tells: other files have another."""
    at = spark._jvm.org.apache.hadoop.fs.Path(source)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files, state = fs.listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        state.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    path = f"{shared_dir(spark)}/index-" + hashlib.sha256("\n".join([*sorted(state), FORMAT, *what]).encode()).hexdigest()[:32]
    context = spark.sparkContext
    if path not in getattr(context, "_tidepool_paths", []):
        context._tidepool_paths = [*getattr(context, "_tidepool_paths", []), path]
    return path


def of(spark: SparkSession, source: str, docs: DataFrame, id_col: str, *columns: str, what: str = "", terms: Callable[[Column], Column] = search.tokens) -> Index:
    """The index of documents that are made of the files at `source` (`what` tells how): the one in the shared folder, if these files were indexed before, else a new one."""
    index = Index(spark, source_folder(spark, source, what, id_col, *columns, terms.__name__), terms)
    return index if index.generations() else index.append(docs, id_col, *columns)
