"""Clusters of vectors and texts, their facts and summaries.

Linking compares blocks of vectors, each two of them in a task, and lets only a spanning forest of the
links out: at most one row for each vector of the two blocks, however many pairs there are. `near_links`
finds them by an index of signs; `semantic` clusters by four kinds of likeness.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.operators import ranking, search, setsim, store, text
from tidepool.operators.components import connected_components

#: Vectors of a block.
BLOCK = 4096
#: What makes a sentence a fact, the least length of one, and facts of a cluster. Fixed values.
NUMBER = (r"\b[0-9]+(?:\.[0-9]+)?(?:%|x|ms|s|m|h|d)?(?:[^a-z0-9_]|$)", 1.2)
STATES = (r"\b(?:is|are|was|were|has|have|uses|depends|causes|prefers|owns)\b", 1.0)
RULES = (r"\b(?:should|must|always|never|before|after)\b", 0.7)
SHORTEST, FACTS, HEAD = 24, 12, 180


def _forest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest (a, b) of the graph between two lists of ids."""
    a, b = [], []
    open_l, open_r = np.ones(len(left), bool), np.ones(len(right), bool)
    for start in range(len(left)):
        if not open_l[start]:
            continue
        open_l[start] = False
        front = [(True, start)]
        while front:
            of_left, i = front.pop()
            hits = np.flatnonzero((near[i] & open_r) if of_left else (near[:, i] & open_l))
            (open_r if of_left else open_l)[hits] = False
            own, others = (left[i], right[hits]) if of_left else (right[i], left[hits])
            a += [int(own)] * len(hits)
            b += others.tolist()
            front += [(not of_left, int(x)) for x in hits]
    return a, b


def links(vectors: DataFrame, id_col: str, vector: str, threshold: float, same: Column | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect what inner products of at least the threshold connect, within rows of an equal `same`."""
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), (F.lit(0) if same is None else same).cast("string").alias("same"))
    rows = store.kept(rows.where("same IS NOT NULL"), "linked-vectors")
    blocks = store.kept(rows.groupBy("same").agg(F.ceil(F.count("*") / block).cast("int").alias("n")), "linked-blocks")  # each group is cut by its own size
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(F.least(i, F.col("part")).alias("i"), F.greatest(i, F.col("part")).alias("j")))
    each = rows.join(blocks, "same").withColumn("part", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).select("id", "v", "same", "part", F.inline(pairs))

    def run(g: pa.Table) -> pa.Table:
        ids, parts = g.column("id").to_numpy(), g.column("part").to_numpy()
        v = g.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        i, j = g.column("i")[0].as_py(), g.column("j")[0].as_py()
        x, y = parts == i, parts == j
        near = v[x] @ v[y].T >= threshold
        if i == j:
            np.fill_diagonal(near, False)
        a, b = _forest(near, ids[x], ids[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return each.groupBy("same", "i", "j").applyInArrow(run, "a long, b long").where("a <> b")


#: Vectors of a block whose candidates are verified together.
VERIFIED = 16_384
#: Bits of a key of signs, the chance that two vectors at the threshold share no key, and rows of a key up to which all its pairs are candidates.
BITS, MISS, SMALL = 16, 1e-3, 32


def keys_needed(threshold: float, bits: int = BITS, miss: float = MISS) -> int:
    """Keys of so many random signs of which two unit vectors with this inner product share none with the chance `miss`; nearer ones share more."""
    same = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log(1 - same)) if same < 1 else 1


def _close(met: DataFrame, one: DataFrame, n: int, threshold: float) -> DataFrame:
    """Candidates (a, b) of equal length whose inner products reach the threshold. They are dealt by cells of two blocks, so that a vector travels once a block and not once a candidate."""
    n_blocks = max(1, -(-n // VERIFIED))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(n_blocks)).cast("int")
    cell = lambda i, j: (F.least(i, j).alias("i"), F.greatest(i, j).alias("j"))
    asked = met.select("a", "b", *cell(block("a"), block("b")))
    dealt = one.select("id", "v", block("id").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("other")).select("id", "v", *cell(F.col("own"), F.col("other")))

    def run(pairs: pa.Table, held: pa.Table) -> pa.Table:
        a, b = pairs.column("a").to_numpy(), pairs.column("b").to_numpy()
        good = np.zeros(len(a), bool)
        if len(a):
            ids, v = held.column("id").to_numpy(), held.column("v").combine_chunks()
            starts, sizes = v.offsets.to_numpy()[:-1].astype(np.int64), np.diff(v.offsets.to_numpy())
            values, order = v.values.to_numpy(zero_copy_only=False), np.argsort(ids)
            x, y = (order[np.searchsorted(ids, p, sorter=order)] for p in (a, b))
            for d in np.unique(sizes):
                for few in np.array_split(at := np.flatnonzero((sizes[x] == d) & (sizes[y] == d)), 1 + len(at) // 65_536):
                    of = lambda p: values[starts[p[few]][:, None] + np.arange(d)]  # noqa: B023, E731
                    good[few] = np.einsum("ij,ij->i", of(x), of(y)) >= threshold
        return pa.table({"a": a[good], "b": b[good]})

    return asked.groupBy("i", "j").cogroup(dealt.groupBy("i", "j")).applyInArrow(run, "a long, b long")


def near_links(vectors: DataFrame, id_col: str, vector: str, threshold: float, bits: int = BITS, miss: float = MISS, small: int = SMALL, seed: int = 0, counters: dict | None = None) -> DataFrame:
    """(a, b): links that connect what cosines of at least the threshold connect, found by an index in place of all pairs.

    Vectors that are equal are one. Each has keys, the signs of its products with random directions; those that share a key are
    candidates, whose cosine decides. Keys with more than `small` rows, as groups of near copies make, are not paired: their rows are
    compared in blocks that let a forest out (`links`), once for keys that hold the same rows. Two vectors at the threshold are
    missed with the chance `miss`. Null and zero vectors have no links.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), search.normalised(vector).alias("v")).where(F.exists("v", lambda x: x != 0))
    rows = rows.withColumn("key", F.sha2(F.to_json("v"), 256))
    one = rows.groupBy("key").agg(F.min("id").alias("id"), F.first("v").alias("v"))
    one = store.kept(one, "near-vectors")
    copies = rows.select("id", "key").join(one.select("key", F.col("id").alias("first")), "key").where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    n_of = one.groupBy(F.size("v").alias("d")).count().collect()  # a row a length
    sizes = [r.d for r in n_of]
    n_keys = keys_needed(threshold, bits, miss)
    planes = {d: np.random.default_rng((seed, d)).normal(size=(d, n_keys * bits)) for d in sizes}
    sent = spark.sparkContext.broadcast(planes)

    def run(batches):
        weight = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            for d in np.unique(pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)):
                part = batch.filter(pc.equal(pc.list_value_length(batch.column("v")), int(d)))
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                for at in range(0, len(part), 256):
                    signs = (v[at : at + 256] @ sent.value[int(d)] >= 0).reshape(-1, n_keys, bits)
                    key = (signs @ weight) + (np.arange(n_keys, dtype=np.int64) << bits) + (int(d) << 48)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("id").to_numpy()[at : at + 256], n_keys)), pa.array(key.ravel())], ["id", "k"])

    keyed = store.kept(one.select("id", "v").mapInArrow(run, "id long, k long"), "near-keys")
    held = store.kept(keyed.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("rows"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("more")).where("n > 1"), "near-held")
    few = keyed.join(held.where(F.col("n") <= small).select("k", "n"), "k").drop("n")
    met = few.join(few.withColumnsRenamed({"id": "other"}), "k").where("id < other").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()
    met = store.kept(met, "near-candidates")
    close = _close(met, one, sum(r["count"] for r in n_of), threshold)
    if counters is not None:
        counters.update(candidates=met.count(), keys=n_keys, vectors=one.count())
    # Of keys that hold the same rows one is compared.
    large = held.where(F.col("n") > small).groupBy("n", "rows", "more").agg(F.min("k").alias("k")).select("k", "n")
    grouped = keyed.join(large, "k").select("id", "k").join(one.select("id", "v"), "id")
    return close.union(links(grouped, "id", "v", threshold, F.col("k"))).union(copies)


#: Elements of a signature, characters of the signature of a text without words. Fixed values.
SIGNED, BARE = 80, 200
#: From which similarity chunks belong together: vectors, entities, words. Fixed values.
COSINE, ENTITIES, WORDS = 0.84, 0.50, 0.35


def words(text_col: Column) -> Column:
    """A text's different words of three letters or more, without numbers."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(r"[a-z0-9_\-]{3,}"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~w.rlike("^[0-9]+$")))


def signature(tokens: Column, text_col: Column) -> Column:
    """A digest of the first words in order, or of how a text without words begins."""
    base = F.when(F.size(tokens) > 0, F.array_join(F.slice(F.array_sort(tokens), 1, SIGNED), " ")).otherwise(F.substring(F.trim(F.lower(F.coalesce(text_col, F.lit("")))), 1, BARE))
    return F.substring(F.sha1(base), 1, 20)


def semantic(chunks: DataFrame, id_col: str, text_col: str, vectors: DataFrame, vector: str, entities: Column, cosine: float = COSINE, overlap: float = ENTITIES, lexical: float = WORDS) -> DataFrame:
    """(id, cluster): chunks that share a signature, are near by their vectors (rows with an id of `vectors`), or have similar sets of entities or of words belong together, and so do those that others connect; a cluster has its least id's name."""
    rows = store.kept(chunks.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), words(F.col(text_col)).alias("words"), entities.alias("entities")), "cluster-rows")
    signed = rows.select("id", signature(F.col("words"), F.col("text")).alias("sig"))
    least = signed.groupBy("sig").agg(F.min("id").alias("least")).repartition("sig", "least")  # dealt anew, so that the join can split a signature
    edges = signed.join(least, "sig").where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    mine = vectors.join(rows.select(F.col("id").alias(id_col)), id_col, "left_semi")
    edges = edges.union(near_links(mine, id_col, vector, cosine))
    edges = edges.union(setsim.linked(rows, "id", F.col("entities"), overlap)).union(setsim.linked(rows, "id", F.col("words"), lexical))
    roots = connected_components(edges).select(F.col("v").alias("id"), "root")
    return rows.select("id").join(roots, "id", "left").select(F.col("id").alias(id_col), F.coalesce("root", "id").alias("cluster"))


def clusters(vectors: DataFrame, id_col: str, vector: str, threshold: float, same: Column | None = None) -> DataFrame:
    """(id, cluster): the least id reachable over links."""
    roots = connected_components(links(vectors, id_col, vector, threshold, same)).select(F.col("v").alias(id_col), "root")
    return vectors.select(id_col).join(roots, id_col, "left").select(id_col, F.coalesce("root", id_col).alias("cluster"))


def fact_sentences(members: DataFrame, cluster: str, member: str, text_col: str, most: int = FACTS) -> DataFrame:
    """(cluster, place, fact): the best sentences of a cluster, each once, by what they state; of equal scores the earlier member's and the earlier one."""
    said = F.transform(text.sentences(F.regexp_replace(F.col(text_col), "\n", " ")), lambda s: F.regexp_replace(s, r"^[. ]+|[. ]+$", ""))
    each = members.select(cluster, member, F.posexplode(said).alias("nth", "fact")).where(F.length("fact") >= SHORTEST)
    each = ranking.first_per_key(each, [cluster], F.lower("fact"), F.asc(member), F.asc("nth"))
    low = F.lower("fact")
    score = F.round(sum((F.when(low.rlike(p), w).otherwise(0.0) for p, w in (NUMBER, STATES, RULES)), F.least(F.length("fact") / 240.0, F.lit(0.6))), 6)
    return ranking.top_k(each.withColumn("score", score), [cluster], most, F.desc("score"), F.asc(member), F.asc("nth")).select(cluster, F.col("rank").alias("place"), "fact")


def summary(head: Column, n: Column, n_facts: Column, names: Column) -> Column:
    """A line on a cluster: how it begins, how much it holds, who is named most."""
    flat = F.trim(F.regexp_replace(head, "\n", " "))
    short = F.when(F.length(flat) > HEAD, F.concat(F.substring(flat, 1, HEAD - 3), F.lit("..."))).otherwise(flat)
    facts = F.when(n_facts > 0, F.concat(F.lit("; "), n_facts, F.lit(" key facts"))).otherwise("")
    named = F.when((n_facts > 0) & (F.size(names) > 0), F.concat(F.lit("; entities: "), F.array_join(names, ", "))).otherwise("")
    return F.concat(short, F.lit(" (consolidated "), n, F.lit(" episodes"), facts, named, F.lit(")"))
