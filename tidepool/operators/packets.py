"""Lines in packets and blocks, found by keywords: filters choose blocks, then packets; the lines of these alone are looked at.

Index: a filter for each packet over what stands for its words (the word, its stem, the first letters
of both), and for each block the union of its packets' filters. A filter may let a packet pass that
has nothing, never the other way round, so the lines that come out are exactly those with the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import bloom, codecs

#: Lines of a packet, packets of a block. Fixed values.
PACKET, BLOCK = 256, 4


def _groups(keywords: list[str], prefix: int) -> list[Column]:
    return [bloom.variants(F.lit(k.strip().lower()), prefix) for k in keywords if k.strip()]


def _each(tests: list[Column], every: bool) -> Column:
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), tests) if tests else F.lit(False)


def line_has(text: Column, keywords: list[str], every: bool = True, prefix: int = bloom.PREFIX) -> Column:
    """Whether a line has every (or any) keyword, in one of the forms that stand for it."""
    held = F.flatten(F.transform(bloom.tokens(text), lambda w: bloom.variants(w, prefix)))
    from tidepool.operators.text import let

    return let(lambda words: _each([F.arrays_overlap(words, g) for g in _groups(keywords, prefix)], every), held)


def filter_has(filter_: Column, keywords: list[str], every: bool = True, prefix: int = bloom.PREFIX, bits: int = bloom.BITS) -> Column:
    return _each([F.exists(g, lambda v: bloom.has(filter_, v, bits)) for g in _groups(keywords, prefix)], every)


def index(lines: DataFrame, number: str, text: str, size: int = PACKET, prefix: int = bloom.PREFIX, bits: int = bloom.BITS) -> DataFrame:
    """(packet, filter) of numbered lines."""
    words = lines.select(F.floor(F.col(number) / size).alias("packet"), F.explode(bloom.tokens(F.col(text))).alias("w"))
    return bloom.filters(words.select("packet", F.explode(bloom.variants(F.col("w"), prefix)).alias("word")), "packet", "word", bits)


def blocks(packets: DataFrame, group: int = BLOCK, bits: int = bloom.BITS) -> DataFrame:
    """(block, filter): unions of neighbouring packets' filters."""
    return bloom.merged(packets.withColumn("block", F.floor(F.col("packet") / group)), "block", bits)


def packets_with(packets: DataFrame, keywords: list[str], every: bool = True, prefix: int = bloom.PREFIX, bits: int = bloom.BITS) -> DataFrame:
    """Packets whose filter may have the keywords."""
    return packets.where(filter_has(F.col("filter"), keywords, every, prefix, bits)).select("packet")


def recalled(lines: DataFrame, packets: DataFrame, block_filters: DataFrame | None, keywords: list[str], number: str, text: str, every: bool = True, size: int = PACKET, group: int = BLOCK, prefix: int = bloom.PREFIX, loose: bool = False, bits: int = bloom.BITS, block_bits: int = bloom.BITS) -> DataFrame:
    """Lines with the keywords, from the packets that pass both levels. `loose` lets a packet pass with any of the keywords, where blocks have been strict."""
    passing = packets_with(packets, keywords, every and not loose, prefix, bits)
    if block_filters is not None:
        good = block_filters.where(filter_has(F.col("filter"), keywords, every, prefix, block_bits)).select("block")
        passing = passing.withColumn("block", F.floor(F.col("packet") / group)).join(good, "block", "left_semi").select("packet")
    few = lines.withColumn("packet", F.floor(F.col(number) / size)).join(passing, "packet", "left_semi").drop("packet")
    return few.where(line_has(F.col(text), keywords, every, prefix))


# Packed


def packed(lines: DataFrame, size: int = PACKET) -> DataFrame:
    """(packet, n, templates, blob) of lines with line_no, template and slots; a packet is at most `size` lines, so a group is small."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("line_no", "template", "slots")), strict=True))
        return pa.table({"packet": pa.array([rows[0][0] // size], pa.int64()), "n": pa.array([len(rows)], pa.int64()), "templates": pa.array([sorted({t for _, t, _ in rows})], pa.list_(pa.string())), "blob": pa.array([codecs.packet(rows)], pa.binary())})

    dealt = lines.select(F.floor(F.col("line_no") / size).alias("packet"), F.col("line_no").cast("long").alias("line_no"), "template", "slots")
    return dealt.groupBy("packet").applyInArrow(run, "packet long, n long, templates array<string>, blob binary")


def unpacked(packets: DataFrame, blob: str = "blob") -> DataFrame:
    """(line_no, text) of packed lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                lines = codecs.read_packet(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _, _ in lines], pa.int64()), pa.array([codecs.rendered(t, s) for _, t, s in lines], pa.string())], ["line_no", "text"])

    return packets.select(blob).mapInArrow(run, "line_no long, text string")


def shards(packets: DataFrame, group: int = 16) -> DataFrame:
    """(shard, ids, data): containers of `group` packets each, behind an index."""

    def run(g: pa.Table) -> pa.Table:
        rows = sorted(zip(g.column("packet").to_pylist(), g.column("blob").to_pylist(), strict=True))
        return pa.table({"shard": pa.array([rows[0][0] // group], pa.int64()), "ids": pa.array([[i for i, _ in rows]], pa.list_(pa.int64())), "data": pa.array([codecs.container([b for _, b in rows])], pa.binary())})

    return packets.select(F.floor(F.col("packet") / group).alias("shard"), "packet", "blob").groupBy("shard").applyInArrow(run, "shard long, ids array<long>, data binary")


def from_shards(containers: DataFrame, wanted: DataFrame, group: int = 16) -> DataFrame:
    """(packet, line_no, text, n_read): lines of the packets asked for. Shards without any are not opened; of an opened one only those packets are read, n_read of them."""
    asked = wanted.select("packet", F.floor(F.col("packet") / group).alias("shard")).groupBy("shard").agg(F.collect_set("packet").alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, asked, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                lazy, out = codecs.Lazy(data), []
                for i, packet in enumerate(ids):
                    if packet in set(asked):
                        out += [(packet, n, codecs.rendered(t, s)) for n, t, s in lazy[i]]
                columns = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array([len(lazy.read)] * len(out), pa.int64())], ["packet", "line_no", "text", "n_read"])

    return containers.join(asked, "shard").select("ids", "asked", "data").mapInArrow(run, "packet long, line_no long, text string, n_read long")
