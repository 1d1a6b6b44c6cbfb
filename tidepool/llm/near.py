"""Near-duplicate documents by exact Jaccard similarity of their word shingles.

1. One narrow pass over the texts: the different five-word shingles as 64-bit hashes, a 128-bit hash of
   that set, and MinHash bands of it. Equal sets become one row before any pairing.
2. Candidates: sets that share a band, each linked to the least of the band, and any links that the
   caller adds. A pair at the threshold misses all bands with a chance of 0.0007, one above it less.
   The candidates' connected components only say which sets are compared.
3. Within each of them pairs are compared exactly. A component of more than `block` sets, or of
   more than SHINGLES in its sets, is cut into parts; the sets of a part are compared with each other, then one set of each class that this makes
   with those of the other parts, which joins the classes of a large group of near copies. What is
   still apart is compared across: the sets of all classes but the largest with every part. A pair at
   the threshold is thus in one part, or in one class already, or in one of these last comparisons.
   Only spanning forests of the pairs at the threshold go out, and these links alone are joined into
   components. A group of near copies is sent twice, not once for each of its parts.

Words are ASCII lower case between ASCII blanks. A text of fewer words than a shingle is one shingle; null
texts count as empty, and texts without words are copies of each other. Other columns are left out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import materialise, pick
from tidepool.operators.components import connected_components

SEED, SHINGLE, THRESHOLD = 42, 5, 0.8
#: MinHash bands and the rows of each: a similarity of 0.8 shares a band with a chance of 0.9993.
BANDS, ROWS = 24, 6
#: Sets of a candidate component that are compared in one task, and the shingles in them; beyond either, the component is cut into parts.
BLOCK, SHINGLES = 1000, 4_000_000


def shingles(text: bytes, words: int = SHINGLE) -> np.ndarray:
    """The different shingles' hashes, sorted."""
    import xxhash

    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    each = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) >= words else [b" ".join(found)]  # noqa: B905
    return np.unique(np.fromiter(map(functools.partial(xxhash.xxh64_intdigest, seed=SEED), each), np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """A signed long for each band, none for an empty set."""
    import xxhash

    if not len(hashes):
        return []
    rng = np.random.default_rng(SEED)
    factor, plus = (rng.integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64) << np.uint64(1)) | np.uint64(1)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[at : at + 2048] * factor + plus).min(axis=1))
    rows = least.astype("<u8").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), seed=i) for i, row in enumerate(rows)], np.uint64).view(np.int64).tolist()


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        sets = [shingles(t.as_py()) for t in batch.column(1)]
        same = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), same, pa.array([bands(h) for h in sets], pa.list_(pa.int64())), pa.array([len(h) for h in sets], pa.int64())], ["doc_id", "same", "bands", "n"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = pa.array([shingles(t.as_py()).astype("<u8").tobytes() for t in batch.column(1)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), h], ["doc_id", "root", "parts", "h"])


def spanning_links(ids: np.ndarray, sets: list[np.ndarray], threshold: float = THRESHOLD) -> tuple[list[int], list[int]]:
    """Each id beside the first of its component over all pairs at the threshold, for those that are not that themselves."""
    sizes = np.array([len(s) for s in sets])
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    dense = np.split(flat, np.cumsum(sizes)[:-1])
    held = np.zeros(len(words), bool)
    a, b, rest = [], [], np.arange(len(ids))
    while len(rest):
        root, front, rest = rest[0], [rest[0]], rest[1:]
        flat, starts = flat[sizes[root] :], None
        while front and len(rest):
            one = front.pop()
            if starts is None:
                starts = np.r_[0, np.cumsum(sizes[rest])[:-1]]
            held[dense[one]] = True
            common = np.add.reduceat(held[flat], starts, dtype=np.int64)
            held[dense[one]] = False
            near = common * (1 + threshold) >= threshold * (sizes[rest] + sizes[one]) - 1e-9
            if near.any():
                new, rest = rest[near], rest[~near]
                a += ids[new].tolist()
                b += [int(ids[root])] * len(new)
                front.extend(new)
                flat, starts = np.concatenate([dense[i] for i in rest]) if len(rest) else flat[:0], None
    return a, b


def _verified(group: pa.Table) -> pa.Table:
    ids = group.column("doc_id").to_numpy()
    a, b = spanning_links(ids, [np.frombuffer(h.as_py(), "<u8") for h in group.column("h")])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _dealt(n: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id"), n).cast("int")


def _cut(sets: Column, shingles: Column, block: int) -> Column:
    """Parts that so many sets with so many shingles make."""
    return F.ceil(F.greatest(sets / block, shingles / SHINGLES)).cast("int")


def _linked(hashed: DataFrame, block: int) -> DataFrame:
    """Links (a, b) that connect what pairs at the threshold connect; hashed has doc_id, root, parts and h."""
    out = "a long, b long"
    within = hashed.select("doc_id", "root", "h", _dealt(F.col("parts")).alias("part")).groupBy("root", "part").applyInArrow(_verified, out)
    large = hashed.where("parts > 1")
    if large.isEmpty():
        return within
    within = materialise(within, "near-links")

    def classes(links: DataFrame) -> DataFrame:
        """Sets of large components with their class: the least set that links lead to."""
        found = connected_components(links).select(F.col("v").alias("doc_id"), F.col("root").alias("least"))
        return large.join(found, "doc_id", "left").withColumn("class", F.coalesce("least", "doc_id")).drop("least")

    # one set of each class with those of all others, block by block
    first = classes(within).where("doc_id = class").select("doc_id", "root", "h")
    n = first.groupBy("root").agg(_cut(F.count("*"), F.sum(F.octet_length("h")) / 8, block).alias("n"))
    two = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(F.least(i, F.col("at")).alias("i"), F.greatest(i, F.col("at")).alias("j")))
    cells = first.join(n, "root").withColumn("at", _dealt(F.col("n"))).select("doc_id", "root", "h", F.inline(two))
    links = materialise(within.union(cells.groupBy("root", "i", "j").applyInArrow(_verified, out)), "near-links")

    # all classes but the largest with every part
    known = materialise(classes(links), "near-classes")
    sizes = known.groupBy("root", "class").agg(F.count("*").alias("n"), (F.sum(F.octet_length("h")) / 8).alias("shingles"))
    most = sizes.groupBy("root").agg(F.max(F.struct("n", "class", "shingles")).alias("most"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles")).where("most.n < n")
    blocks = _cut(F.col("n") - F.col("most.n"), F.col("shingles") - F.col("most.shingles"), block)
    apart = known.join(most.select("root", F.col("most.class").alias("most"), blocks.alias("blocks")).repartition("root", "most"), "root")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    others = apart.where("class <> most").select("doc_id", "root", "h", _dealt(F.col("blocks")).alias("i"), F.explode(every(F.col("parts"))).alias("j"))
    whole = apart.select("doc_id", "root", "h", F.explode(every(F.col("blocks"))).alias("i"), _dealt(F.col("parts")).alias("j"))
    return links.union(others.union(whole).groupBy("root", "i", "j").applyInArrow(_verified, out))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id and component_id (the smallest id reachable over pairs at the threshold) of every row; ids are unique longs, `more` has further candidates (a, b)."""
    rows = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string")).fillna("", ["text"]).select("doc_id", F.col("text").cast("binary").alias("text"))
    prints = materialise(rows.mapInArrow(_sketched, "doc_id long, same binary, bands array<long>, n long"), "near-prints")
    copies = materialise(prints.groupBy("same").agg(F.min("doc_id").alias("first")), "near-sets")
    firsts = prints.join(copies.select(F.col("first").alias("doc_id")), "doc_id", "left_semi").where(F.size("bands") > 0)
    sets = materialise(firsts.select("doc_id", "n", "bands"), "near-bands")
    keyed = sets.select("doc_id", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n").repartition("band", "least")  # dealt anew, so that the join can split a band
    pairs = keyed.join(shared, "band").where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    groups = connected_components(pairs if more is None else pairs.union(more.select("a", "b"))).select(F.col("v").alias("doc_id"), "root")
    groups = materialise(groups.join(sets.select("doc_id", "n"), "doc_id"), "near-groups")  # without further copies, and texts without words
    parts = groups.groupBy("root").agg(_cut(F.count("*"), F.sum("n"), block).alias("parts"), F.count("*").alias("n")).where("n > 1").drop("n").repartition("root", "parts")
    members = groups.join(parts, "root").select("doc_id", "root", "parts")
    hashed = materialise(rows.join(members, "doc_id").select("doc_id", "text", "root", "parts").mapInArrow(_hashed, "doc_id long, root long, parts int, h binary"), "near-hashes")
    links = _linked(hashed, block)
    roots = connected_components(links).select(F.col("v").alias("first"), "root")
    classes = copies.join(roots, "first", "left").select("same", F.coalesce("root", "first").alias("component_id"))
    return prints.join(classes, "same").select("doc_id", "component_id")
