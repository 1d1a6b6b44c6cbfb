"""Chains of hashes over packets of a stream, and checks of stored chunks.

Packets are made in parallel; the chain itself goes over one digest a packet, so that what has to be
in one place is 64 characters for each packet of a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ZERO = "0" * 64
#: Growth of a chunk when it is unpacked, and references that a chunk may have as a base of others. Fixed values.
EXPANSION, REFERENCES = 100.0, 1000


def packets(rows: DataFrame, stream: str, order: str, digest: str, size: int) -> DataFrame:
    """(stream, i, digest): the hash of the hashes of every `size` rows of a stream."""
    place = F.row_number().over(Window.partitionBy(stream).orderBy(order)) - 1
    each = rows.select(stream, order, digest, F.floor(place / size).alias("i"))
    held = F.transform(F.array_sort(F.collect_list(F.struct(order, digest))), lambda x: x[digest])
    return each.groupBy(stream, "i").agg(F.sha2(F.array_join(held, ""), 256).alias("digest"))


def links(packed: DataFrame, stream: str, i: str, digest: str) -> DataFrame:
    """(stream, i, link): each link is the hash of the link before and the packet's digest."""
    each = packed.groupBy(stream).agg(F.array_sort(F.collect_list(F.struct(F.col(i).alias("i"), F.col(digest).alias("d")))).alias("p"))
    step = lambda acc, x: F.concat(acc, F.array(F.sha2(F.concat(F.element_at(acc, -1), x.d), 256)))
    chain = F.aggregate("p", F.array(F.lit(ZERO)), step)
    pairs = F.arrays_zip(F.transform("p", lambda x: x.i).alias("i"), F.slice(chain, F.lit(2), F.size("p")).alias("link"))
    return each.select(stream, F.inline(pairs))


def roots(packed: DataFrame, stream: str, i: str, digest: str) -> DataFrame:
    """(stream, n, root) of each chain."""
    return links(packed, stream, i, digest).groupBy(stream).agg(F.count("*").alias("n"), F.max_by("link", "i").alias("root"))


def verified(chain: DataFrame, packed: DataFrame, stream: str, i: str, digest: str) -> DataFrame:
    """(stream, i, intact): whether a packet, with the stored link before it, gives its stored link. A packet without a link, and a link without a packet, are not intact."""
    before = F.coalesce(F.lag("link").over(Window.partitionBy(stream).orderBy("i")), F.lit(ZERO))
    stored = chain.select(stream, "i", "link", before.alias("before"))
    both = stored.join(packed.select(stream, F.col(i).alias("i"), F.col(digest).alias("digest")), [stream, "i"], "full")
    return both.select(stream, "i", F.coalesce(F.sha2(F.concat("before", "digest"), 256) == F.col("link"), F.lit(False)).alias("intact"))


def checked(opened: DataFrame, sha: str, size: str, data: str) -> DataFrame:
    """Unpacked chunks with `intact` (they have their hash) and `within` (they did not grow beyond the bound)."""
    return opened.withColumn("intact", F.sha2(data, 256) == F.col(sha)).withColumn("within", F.length(data) <= EXPANSION * F.greatest(F.lit(1), F.col(size)))
