"""Benchmark passages inside long documents: size-partitioned MinHash containment search.

Index: an item is the set of its different five-word shingles. Items are partitioned by the size of
that set (powers of two), and each partition has a sketch length that follows from its largest size U:
an item keeps its floor((1 - t) U) + 1 smallest shingle hashes, its bottom-k MinHash. A document that
holds at least the share t of an item's shingles misses fewer than that many, so it meets the sketch
at least once: the search loses nothing, however long the document is.

Search: the shingles of all documents probe the sketches alone. A document and an item that meet are
a candidate; candidates are written to the shared folder.

Verification: only documents with a candidate are read again. Their different shingles are joined with
all shingles of their own candidates by (document, hash), compared word by word, and counted. As the
document is part of the key, a shingle that many items or documents share makes no hot key.

Documents are known by two 64-bit hashes of id and text, so that both readings agree. Words are runs
of letters and digits in lower case. An item of one to four words has one shingle, all its words in a
row; items without words have no evidence and are never found. Null texts count as empty. Null ids are
kept, repeated documents are each found, repeated items (same id and text) give one row, an empty
table gives an empty result; other columns are left out.

Only JVM expressions run. Hashes move, never the words of a document: sketches of at most BROADCAST
rows, a counted bound, are broadcast, others are joined by a shuffle of (document, hash).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import materialise, pick

SHINGLE, THRESHOLD = 5, 0.8
BROADCAST = 200_000
SEPARATOR = r"[^\p{L}\p{N}]+"
KEY = ["k1", "k2"]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SEPARATOR), "")


def _hash(n: int) -> Column:
    """Of the n words from the 0-based place `at` on."""
    return F.xxhash64(F.lit(n), *[F.get("words", F.col("at") + i) for i in range(n)])


def shingled(rows: DataFrame, lengths: list[int], *keep: str, gram: bool = False) -> DataFrame:
    """A row per place and length: `keep`, h and, if asked for, the words. Places without so many words give none."""
    size = F.size("words")
    each = rows.where(size >= min(lengths)).select(*keep, "words", F.posexplode("words").alias("at", "first")).where(F.col("at") <= size - min(lengths))
    part = lambda n: F.struct(_hash(n).alias("h"), *([F.array_join(F.slice("words", F.col("at") + 1, n), " ").alias("gram")] if gram else []))
    if len(lengths) == 1:
        return each.select(*keep, part(lengths[0]).alias("one")).select(*keep, "one.*")
    parts = F.array(*[F.when(F.col("at") <= size - n, part(n)) for n in lengths])  # no lambda: the whole chain has to stay in one piece of generated code, or the words would be copied for every place
    return each.select(*keep, F.inline(parts)).where("h is not null")


def item_shingles(items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, list[int]]:
    """Per item and different shingle: item_id, item (a hash of both), n_item, gram, h and whether the sketch has it; and the lengths of shingles that occur."""
    rows = pick(items, item_id=(id_col, "long"), text=(text_col, "string")).fillna("", ["text"]).distinct()
    rows = rows.select("item_id", F.xxhash64("item_id", "text").alias("item"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(shingle))
    lengths = sorted(r.n for r in rows.select(n.alias("n")).distinct().collect())  # `shingle` values at most
    if not lengths:
        lengths = [shingle]
    of = F.element_at(F.create_map(*[x for i in lengths for x in (F.lit(i), _hash(i))]), n)
    each = rows.select("item_id", "item", "words", F.posexplode("words").alias("at", "first")).where(F.col("at") <= F.size("words") - n)
    each = each.select("item_id", "item", of.alias("h"), F.array_join(F.slice("words", F.col("at") + 1, n), " ").alias("gram")).distinct()
    sets = each.groupBy("item_id", "item").agg(F.sort_array(F.collect_list(F.struct("h", "gram"))).alias("all"))
    largest = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("all").cast("double"))))  # of the item's partition
    length = (F.floor(largest * (1 - threshold) + 1e-9) + 1).cast("int")
    sets = sets.select("item_id", "item", F.size("all").alias("n_item"), length.alias("sketch"), F.posexplode("all").alias("place", "one"))
    return sets.select("item_id", "item", "n_item", (F.col("place") < F.col("sketch")).alias("sketched"), "one.h", "one.gram"), lengths


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string")).fillna("", ["text"])
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(1), "doc_id").alias("k2"), words(F.col("text")).alias("words"))


def candidates(docs: DataFrame, wanted: DataFrame, lengths: list[int], id_col: str = "doc_id", text_col: str = "text", broadcast: int = BROADCAST) -> DataFrame:
    """k1, k2, item_id and item of every document that meets the sketch of the item."""
    sketch = wanted.where("sketched").select("h", "item_id", "item")
    if sketch.count() <= broadcast:
        sketch = F.broadcast(sketch)
    return shingled(_documents(docs, id_col, text_col), lengths, *KEY).join(sketch, "h").select(*KEY, "item_id", "item").distinct()


def contained(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, item_id, n_item (the item's different shingles), n_found (of them in the document) and containment, for containments of at least the threshold."""
    wanted, lengths = item_shingles(items, shingle, threshold)
    wanted = materialise(wanted, "decontam-items")
    met = materialise(candidates(docs, wanted, lengths, id_col, text_col, broadcast), "decontam-candidates")
    again = materialise(_documents(docs, id_col, text_col).join(met.select(*KEY).distinct(), KEY, "left_semi"), "decontam-documents")
    held = shingled(again, lengths, *KEY, gram=True).distinct()
    asked = met.join(wanted.drop("sketched", "item_id"), "item")
    counted = held.join(asked, [*KEY, "h", "gram"]).groupBy(*KEY, "item_id", "item", "n_item").agg(F.count("*").alias("n_found"))
    share = F.col("n_found") / F.col("n_item")
    found = counted.where(share >= threshold - 1e-9).select(*KEY, "item_id", F.col("n_item").cast("long").alias("n_item"), "n_found", share.alias("containment"))
    return found.join(again.select("doc_id", *KEY), KEY).drop(*KEY).select("doc_id", "item_id", "n_item", "n_found", "containment")


ORACLE = r"""
WITH item_words AS (SELECT DISTINCT item_id, text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
item_grams AS (SELECT DISTINCT item_id, text, k, w[i:i+k-1] AS g FROM (SELECT *, least(len(w), 5) AS k, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM item_words WHERE len(w) > 0)),
sized AS (SELECT *, count(*) OVER (PARTITION BY item_id, text) AS n_item FROM item_grams),
doc_words AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
doc_grams AS (SELECT DISTINCT doc_id, r, k, w[i:i+k-1] AS g FROM (SELECT doc_id, r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, (SELECT DISTINCT k FROM item_grams) WHERE len(w) >= k))
SELECT doc_id, item_id, n_item, count(*) AS n_found, count(*) / n_item AS containment
FROM doc_grams JOIN sized USING (k, g) GROUP BY doc_id, r, item_id, text, n_item HAVING count(*) / n_item >= 0.8 - 1e-9
"""
