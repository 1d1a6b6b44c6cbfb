"""Near-duplicate documents by SimHash and pigeonhole blocks.

1. Fingerprints: one narrow pass over the texts.
2. Equal fingerprints are pre-aggregated, so that copies become one row before any pairing.
3. The 64 bits are cut into blocks, more of them than bits may differ, so close fingerprints agree in
   some whole blocks. For a distance of 3 there are six blocks, of which at least three agree, so
   close pairs share at least one of the twenty keys made of three blocks; for a distance of 6 there
   are eight, of which two agree, and 28 keys. Rows are dealt and sorted by key and scanned as a
   stream; a bucket of up to `bucket` rows is linked in place.
4. A larger bucket is not linked, nor cut short: its rows go to a next level, where the bits that are
   still free are cut into as many blocks again, of which as many have to agree. For a distance of
   3 the third level leaves at most nine free bits, so its buckets hold at most 512 different
   fingerprints. Buckets hold eight bytes a row, and a dense one is linked in few comparisons.
5. From each bucket only a spanning forest of its links goes out (never all pairs), and the links
   are joined into components.

Null text counts as empty; texts without words have fingerprint zero and are linked like any other.
A null id keeps its fingerprint and gets the component's smallest id; it is null if the component
has no other. Repeated rows give repeated results, an empty table an empty one; other columns are
left out.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import materialise, pick
from tidepool.operators.components import connected_components

SEED, SHINGLE, DISTANCE = 42, 3, 3
#: By distance: blocks, how many of them agree at least, rows of a bucket that are linked in place.
BLOCKS = {3: (6, 3, 4096), 6: (8, 2, 65_536)}
LEVELS = 3
#: Buckets of up to this size are compared all together before any is linked.
SMALL = 16


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    """SimHash of a text: ASCII lower case, words between ASCII blanks, shingles with repeats."""
    import xxhash

    found = text.lower().split()
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) >= words else [b" ".join(found)]  # noqa: B905
    h = np.fromiter(map(functools.partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    rows = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string")).fillna("", ["text"])
    return rows.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


@functools.lru_cache(maxsize=None)
def masks(distance: int) -> dict[int, list[tuple[int, int]]]:
    """combo -> its (child combo, mask) pairs; combo 0 is the start. A mask has the bits that a child's rows agree in."""
    blocks, agree, _ = BLOCKS[distance]
    out: dict[int, list[tuple[int, int]]] = {}
    number = itertools.count(1)

    def grow(combo: int, free: list[int], level: int) -> None:
        parts = [p.tolist() for p in np.array_split(free, blocks)]
        out[combo] = []
        for kept in itertools.combinations(range(blocks), agree):
            rest = [bit for i, part in enumerate(parts) if i not in kept for bit in part]
            child = next(number)
            out[combo].append((child, ~sum(1 << bit for bit in rest) & (1 << 64) - 1))
            if level < LEVELS:
                grow(child, rest, level + 1)

    grow(0, list(range(64)), 1)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning_links(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """For unsigned fingerprints: each one beside the first of its component, for those that are not that themselves."""
    a, b, rest = [], [], fps
    while len(rest):
        root, front, rest = rest[0], [rest[0]], rest[1:]
        while front and len(rest):
            near = np.bitwise_count(rest ^ front.pop()) <= distance
            if near.any():
                new = rest[near]
                a.append(new)
                b.append(np.full(len(new), root))
                front.extend(new)
                rest = rest[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def _linked(keyed: DataFrame, distance: int, bucket: int) -> DataFrame:
    """Rows dealt by key: links (combo null, a, b) of small buckets, rows of the next level (combo, key, fp in a) of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = masks(distance)
        held = [np.zeros(0, np.int64)] * 3
        over: tuple[int, int] | None = None  # the key whose rows all go to the next level

        def out(combo, key, a, b) -> pa.RecordBatch:
            none = np.zeros(len(a), bool) if combo is not None else np.ones(len(a), bool)
            zero = np.zeros(len(a), np.int64)
            cols = [pa.array(zero if combo is None else combo, pa.int32(), mask=none), pa.array(zero if key is None else key), pa.array(a), pa.array(a if b is None else b)]
            return pa.RecordBatch.from_arrays(cols, ["combo", "key", "a", "b"])

        def deeper(combo: int, fp: np.ndarray) -> pa.RecordBatch:
            children = tree[combo]
            keys = np.concatenate([fp & np.int64(_signed(m)) for _, m in children])
            return out(np.repeat([c for c, _ in children], len(fp)), keys, np.tile(fp, len(children)), None)

        def links(combo: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(fp):
                return
            edges = np.flatnonzero((np.diff(combo) != 0) | (np.diff(key) != 0)) + 1
            starts, ends = np.r_[0, edges], np.r_[edges, len(fp)]
            size, u = ends - starts, fp.view(np.uint64)
            near = size > SMALL  # buckets that may have a link
            of = np.repeat(np.arange(len(size)), size)
            for apart in range(1, min(SMALL, int(size.max()))):
                close = (of[apart:] == of[:-apart]) & (np.bitwise_count(u[apart:] ^ u[:-apart]) <= distance)
                near[of[:-apart][close]] = True
            a, b = [fp[:0]], [fp[:0]]
            for s, e in zip(starts[near], ends[near], strict=True):
                if e - s > bucket and combo[s] in tree:
                    yield deeper(int(combo[s]), fp[s:e])
                    continue
                x, y = spanning_links(u[s:e], distance)
                a.append(x.view(np.int64))
                b.append(y.view(np.int64))
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                yield out(None, None, a, b)

        for batch in batches:
            cols = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
            combo, key, fp = cols
            if not len(fp):
                continue
            first = int(np.argmax((combo == combo[-1]) & (key == key[-1])))  # where the last bucket, which may go on, begins
            done = 0
            if over is not None:
                same = (combo == over[0]) & (key == over[1])
                done = int(np.argmin(same)) if not same.all() else len(fp)
                if done:
                    yield deeper(over[0], fp[:done])
                first = max(first, done)
            yield from links(combo[done:first], key[done:first], fp[done:first])
            if len(fp) - first > bucket and int(combo[-1]) in tree:
                over = (int(combo[-1]), int(key[-1]))
                yield deeper(over[0], fp[first:])
                first = len(fp)
            elif first < len(fp):
                over = None
            held = [c[first:] for c in cols]
        yield from links(*held)

    dealt = keyed.repartition("combo", "key").sortWithinPartitions("combo", "key")
    return dealt.mapInArrow(run, "combo int, key long, a long, b long")


def links(distinct: DataFrame, distance: int = DISTANCE, bucket: int | None = None) -> DataFrame:
    """A spanning forest (a, b) of all pairs of different fingerprints within the distance; `distinct` has one row per fp."""
    keys = [F.struct(F.lit(c).alias("combo"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for c, m in masks(distance)[0]]
    keyed = distinct.select("fp", F.inline(F.array(*keys))).select("combo", "key", "fp")
    found = None
    for _ in range(LEVELS):
        level = materialise(_linked(keyed, distance, bucket or BLOCKS[distance][2]), "simhash-links")
        edges = level.where("combo is null").select("a", "b")
        found = edges if found is None else found.union(edges)
        keyed = level.where("combo is not null").select("combo", "key", F.col("a").alias("fp"))
        if keyed.isEmpty():
            break
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, distance: int = DISTANCE, bucket: int | None = None) -> DataFrame:
    """doc_id, fp and component_id (the smallest id reachable over links, its own included) of every row."""
    prints = materialise(fingerprints(docs, id_col, text_col, words), "simhash-prints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(distinct.select("fp"), distance, bucket)).select(F.col("v").alias("fp"), "root")
    classes = materialise(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-classes")
    least = classes.groupBy("root").agg(F.min("least").alias("component_id")).repartition("root", "component_id")  # dealt anew, so that the join can split a large component
    classes = classes.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")
