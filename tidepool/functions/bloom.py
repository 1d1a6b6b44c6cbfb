"""Bloom filters over keywords, one per group, in JVM expressions: arrays of 64-bit words, merged by bit_or."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits and hashes of a packet's filter. Fixed values.
BITS, HASHES = 8192, 4
#: Letters of a prefix that is indexed beside its word. Fixed value.
PREFIX = 5
TOKEN = "[a-z0-9_]{3,}"


def places(word: Column, bits: int = BITS, hashes: int = HASHES) -> Column:
    """The bits of a word, by double hashing."""
    a, b = F.xxhash64(word), F.xxhash64(F.lit(1), word).bitwiseOR(F.lit(1))
    return F.array(*[F.pmod(F.shiftrightunsigned(a, 32) + i * F.shiftrightunsigned(b, 32), F.lit(bits)) for i in range(hashes)])


def filters(words: DataFrame, group: str | list[str], word: str, bits: int = BITS, hashes: int = HASHES) -> DataFrame:
    """(group, filter): the filter of each group's words. Bits are merged in each task before they are shuffled, one row for each 64 of them that has any."""
    by = [group] if isinstance(group, str) else group
    each = words.select(*by, F.explode(places(F.col(word), bits, hashes)).alias("bit"))
    return _dense(each.groupBy(*by, F.floor(F.col("bit") / 64).cast("int").alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("w")), by, bits)


def _dense(words: DataFrame, by: list[str], bits: int) -> DataFrame:
    held = words.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("i", "w"))).alias("m"))
    return held.select(*by, F.transform(F.sequence(F.lit(0), F.lit(bits // 64 - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("filter"))


def merged(packets: DataFrame, group: str, bits: int = BITS) -> DataFrame:
    """(group, filter): the union of filters; `packets` has the group and a filter."""
    each = packets.select(group, F.posexplode("filter").alias("i", "w")).groupBy(group, "i").agg(F.bit_or("w").alias("w"))
    return _dense(each, [group], bits)


def has(filter_: Column, word: Column, bits: int = BITS, hashes: int = HASHES) -> Column:
    """Whether the filter may hold the word."""
    return F.forall(places(word, bits, hashes), lambda p: _bit(filter_, p))


def _bit(filter_: Column, place: Column) -> Column:
    word = F.get(filter_, F.floor(place / 64).cast("int"))
    return F.call_function("shiftrightunsigned", word, (place % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def may_contain(filter_: str | Column, words: list[str], bits: int = BITS, hashes: int = HASHES) -> Column:
    """All words may be in the filter."""
    column = F.col(filter_) if isinstance(filter_, str) else filter_
    return F.forall(F.array(*[F.lit(w) for w in words]), lambda w: has(column, w, bits, hashes))


def expected_rate(n: int, bits: int = BITS, hashes: int = HASHES) -> float:
    return (1 - math.exp(-hashes * n / bits)) ** hashes


def stem(word: Column) -> Column:
    """A word without ing, ed, es or s, if more than two letters stay."""
    out = word
    for ending in ("s", "es", "ed", "ing"):
        out = F.when((F.length(word) > max(3, len(ending) + 2)) & F.endswith(word, F.lit(ending)), F.substring(word, F.lit(1), F.length(word) - len(ending))).otherwise(out)
    return out


def variants(word: Column, prefix: int = PREFIX) -> Column:
    """What stands for a word: itself, its stem, and the first letters of both."""
    first = lambda w: F.when(F.length(w) >= prefix, F.concat(F.lit("pref:"), F.substring(w, 1, prefix)))
    return F.array_distinct(F.array_compact(F.array(word, stem(word), first(word), first(stem(word)))))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
