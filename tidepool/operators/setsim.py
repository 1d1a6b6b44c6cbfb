"""Set-similarity joins by rank-ordered prefixes.

Equal sets become one class first; pairs are between classes, and `members` says who belongs to them, so that copies never meet each
other. Elements are ordered from the rarest to the most frequent, everywhere alike. Two sets that are as similar as asked have their
first common element within a prefix of both, whose length follows from the sets' sizes; frequent elements stand behind the prefixes, and
are joined only where a set has nothing rarer. Sizes go into the join as bands, as similar sets lie in the same band or in two
neighbouring ones. What the place of a common element leaves possible drops further pairs within the join. Candidates are then verified on the
whole sets, by cells of two blocks of sets, so that a set travels once for each block and not once for each of its candidates. Elements travel as
64-bit hashes; a collision makes a candidate that does not pass.

Where only what is connected counts (`linked`) no candidate leaves the task that finds it: blocks of sets of like size meet two by two, and a
spanning forest of the links between two of them comes out.

Where few common elements suffice (`overlapping`) a prefix is nearly the whole set; there the sets of each element are paired where they
lie, and what goes on is a count for each pair.

Null elements do not count, repeated ones count once, and empty or null sets have no partner. Frequencies are written before they are joined, so
that adaptive execution can split an element that very many sets hold.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.operators import store

NEAR = 1e-9
#: Sets and elements of a block whose candidates are verified together.
BLOCK, ELEMENTS = 4096, 1_000_000
#: Blocks whose links are looked for in memory: about so many, as long as each has no fewer and no more sets, and elements, than these; bits in the sketch of a set for each element.
BLOCKS, LINKED, HELD, SKETCH = 12, (2048, 65_536), (250_000, 5_000_000), 6
#: Elements up to which sets travel as bits and all pairs are compared; sets of a block of them; pairs that are compared at once.
FEW, BITS, AT_ONCE = 512, (256, 4096), 262_144
#: Ids of a list that is paired with another one, and pairs that a task makes of such lists.
PACKED, MADE = 256, 4_000_000


def _packed(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, part, values, n): the values of each key in lists of about PACKED, n of them in all."""
    parts = F.ceil(F.col("n") / PACKED).cast("int")
    sized = rows.join(rows.groupBy(key).agg(F.count("*").alias("n")), key)
    return store.kept(sized.groupBy(key, "n", F.pmod(F.xxhash64(value), parts).cast("int").alias("part")).agg(F.collect_list(value).alias("values")), name)


def _pairs_within(packed: DataFrame, key: str, *more: str) -> DataFrame:
    """(a, b, more), a < b: all pairs of the values of each key, made where two of its lists meet."""
    n_pairs = packed.groupBy(key).agg(F.first("n").alias("n")).agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2)).first()[0] or 0
    left = packed.where("n > 1").repartition(1 + int(n_pairs // MADE), key, "part")
    parts = F.sequence(F.lit(0), F.ceil(F.col("n") / PACKED).cast("int") - 1)
    asks = left.select(key, *more, F.col("part").alias("p"), F.col("values").alias("x"), F.explode(F.filter(parts, lambda q: q >= F.col("part"))).alias("part"))
    met = asks.join(packed.select(key, "part", F.col("values").alias("y")), [key, "part"])
    each = met.select(*more, "p", "part", "y", F.explode("x").alias("i")).select(*more, "p", "part", "i", F.explode("y").alias("j"))
    return each.where("p < part OR i < j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), *more)


@dataclass
class Links:
    """pairs: (a, b, common, jaccard) of classes, a < b, each named by its least id; members: (id, class, n) of every set; candidates: pairs that were verified."""

    pairs: DataFrame
    members: DataFrame
    candidates: DataFrame

    def stars(self) -> DataFrame:
        """(a, b): links that connect what is similar, with one for each further copy."""
        return self.pairs.select("a", "b").union(self.members.where("id <> class").select(F.col("id").alias("a"), F.col("class").alias("b")))

    def expanded(self, within: Column | None = None) -> DataFrame:
        """(a, b, common, jaccard) of all pairs of ids, copies included; as many rows as there are pairs. `within`: which classes' copies are pairs, by n."""
        m = self.members
        packed = _packed(m.select("class", "id"), "class", "id", "set-members")
        side = lambda c: packed.select(F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("values").alias(f"i{c}"))
        sizes = packed.select("class", "n").distinct()
        pairs = self.pairs.join(sizes.select(F.col("class").alias("a"), F.col("n").alias("ma")), "a").join(sizes.select(F.col("class").alias("b"), F.col("n").alias("mb")), "b")
        pairs = store.kept(pairs, "set-pairs")
        made = pairs.agg(F.sum(F.col("ma").cast("double") * F.col("mb"))).first()[0] or 0
        # The last exchange deals lists; pairs of ids are made behind it and not moved.
        both = pairs.join(side("a"), "a").join(side("b"), "b").repartition(1 + int(made // MADE), "ia", "ib")
        across = both.select("common", "jaccard", "ib", F.explode("ia").alias("i")).select("common", "jaccard", "i", F.explode("ib").alias("j"))
        across = across.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "common", "jaccard")
        own = m if within is None else m.where(within)
        held = packed.join(own.select("class", F.col("n").cast("int").alias("common")).distinct(), "class")
        return across.union(_pairs_within(held, "class", "common").select("a", "b", "common", F.lit(1.0)))


def _classes(sets: DataFrame, id_col: str, items: Column) -> tuple[DataFrame, DataFrame]:
    """members (id, class, n), and of each class its set."""
    rows = sets.select(F.col(id_col).cast("long").alias("id"), F.array_sort(F.array_distinct(F.array_compact(items.cast("array<string>")))).alias("s")).where(F.size("s") > 0)
    rows = store.kept(rows.withColumn("key", F.sha2(F.to_json("s"), 256)), "sets")
    first = store.kept(rows.groupBy("key").agg(F.min("id").alias("class")), "set-classes")
    members = rows.select("id", "key", F.size("s").alias("n")).join(first, "key").select("id", "class", "n")
    one = store.kept(rows.join(first, "key").where("id = class").groupBy("class").agg(F.first("s").alias("s")), "set-firsts")  # a repeated id has the sets of all its rows; one counts
    return members, one


def _ordered(sets: DataFrame, id_col: str, items: Column) -> tuple[DataFrame, DataFrame]:
    """members (id, class, n), and of each class its set and its elements' hashes from the rarest on."""
    members, one = _classes(sets, id_col, items)
    each = store.kept(one.select("class", F.explode(F.transform("s", lambda e: F.xxhash64(e))).alias("h")), "set-elements")
    df = store.kept(each.groupBy("h").agg(F.count("*").alias("df")), "set-frequencies")
    order = each.join(df, "h").groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "h"))), lambda x: x.h).alias("hs"))
    return members, store.kept(one.join(order, "class").select("class", "s", F.size("hs").alias("n"), "hs"), "set-orders")


def _joined(sets: DataFrame, smaller: Column, larger: Column, band: Column | None, fits: Column) -> DataFrame:
    """(a, b) candidates: a the smaller set (the smaller class, of equal sizes). smaller, larger: prefix lengths by n."""
    bands = F.array(F.lit(0)) if band is None else F.array(band, band - 1)  # of the larger set: its own, and that of a smaller one
    part = lambda length: F.posexplode(F.slice("hs", F.lit(1), F.greatest(length, F.lit(0)).cast("int")))
    x = sets.select(F.col("class").alias("a"), F.col("n").alias("na"), F.element_at(bands, 1).alias("band"), part(smaller).alias("pa", "h"))
    y = sets.select("class", "n", "hs", F.explode(bands).alias("band")).select(F.col("class").alias("b"), F.col("n").alias("nb"), "band", part(larger).alias("pb", "h"))
    met = x.join(y, ["h", "band"]).where(((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))) & fits)
    return store.kept(met.select("a", "b").distinct(), "set-candidates")


def _common(ids: np.ndarray, held: pa.ListArray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many elements the sets of each pair have in common, and how many both have together."""
    starts, sizes = held.offsets.to_numpy()[:-1].astype(np.int64), np.diff(held.offsets.to_numpy()).astype(np.int64)
    values, elements = np.unique(held.values.to_numpy(zero_copy_only=False), return_inverse=True)
    order = np.argsort(ids, kind="stable")
    x, y = (order[np.searchsorted(ids, p, sorter=order)] for p in (a, b))
    common, by_x = np.zeros(len(a), np.int64), np.argsort(x, kind="stable")
    mark = np.zeros(len(values), bool)
    for one in np.split(by_x, np.flatnonzero(np.diff(x[by_x])) + 1) if len(a) else ():
        own = elements[starts[x[one[0]]] :][: sizes[x[one[0]]]]
        mark[own] = True
        for at in range(0, len(one), 256):
            few = one[at : at + 256]
            n = sizes[y[few]]
            begin = np.cumsum(n) - n
            hits = mark[elements[np.arange(n.sum()) + np.repeat(starts[y[few]] - begin, n)]]
            common[few] = np.add.reduceat(hits, begin, dtype=np.int64)
        mark[own] = False
    return common, sizes[x] + sizes[y]


def _verified(found: DataFrame, sets: DataFrame, passes) -> DataFrame:
    """Candidates that pass (common, size of both together), first by their hashes, with one more common element for collisions, then by their elements.

    `passes` is asked with numbers of a block and with columns.
    """
    n_sets, n_elements = sets.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_blocks = max(1, -(-n_sets // BLOCK), -(-n_elements // ELEMENTS))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(n_blocks)).cast("int")
    cell = lambda i, j: (F.least(i, j).alias("i"), F.greatest(i, j).alias("j"))
    asked = found.select("a", "b", *cell(block("a"), block("b")))
    dealt = sets.select("class", "hs", block("class").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("other")).select("class", "hs", *cell(F.col("own"), F.col("other")))

    def run(pairs: pa.Table, held: pa.Table) -> pa.Table:
        a, b = pairs.column("a").to_numpy(), pairs.column("b").to_numpy()
        good = np.zeros(0, bool)
        if len(a):
            common, both = _common(held.column("class").to_numpy(), held.column("hs").combine_chunks(), a, b)
            good = passes(common + 1, both)
        return pa.table({"a": pa.array(a[good], pa.int64()), "b": pa.array(b[good], pa.int64())})

    near = store.kept(asked.groupBy("i", "j").cogroup(dealt.groupBy("i", "j")).applyInArrow(run, "a long, b long"), "set-near")
    left, right = (sets.select(F.col("class").alias(name), F.col("s").alias(f"s{name}")) for name in ("a", "b"))
    true = near.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("common"), (F.size("sa") + F.size("sb")).alias("both"))
    true = true.where(passes(F.col("common"), F.col("both")))
    return true.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "common", (F.col("common") / (F.col("both") - F.col("common"))).alias("jaccard"))


def similar(sets: DataFrame, id_col: str, items: Column, threshold: float) -> Links:
    """Sets whose common elements are the share `threshold` (over 0) of all that the two have."""
    members, one = _ordered(sets, id_col, items)
    n, t = F.col("n"), threshold
    need = lambda x: F.ceil(x - NEAR)
    rest = F.lit(1) + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1)  # places count from 0
    fits = (F.col("na") >= t * F.col("nb") - NEAR) & (rest >= t / (1 + t) * (F.col("na") + F.col("nb")) - NEAR)
    band = F.floor(F.log(n) / math.log(1 / t) + NEAR) if t < 1 else None
    found = _joined(one, n - need(n * (2 * t / (1 + t))) + 1, n - need(n * t) + 1, band, fits)
    return Links(_verified(found, one, lambda common, both: common * (1 + t) >= t * both - NEAR), members, found)


def overlapping(sets: DataFrame, id_col: str, items: Column, least: int) -> Links:
    """Sets with at least so many common elements."""
    members, one = _classes(sets, id_col, items)
    held = _packed(one.select("class", F.explode("s").alias("e")), "e", "class", "set-lists")
    counts = store.kept(_pairs_within(held, "e").groupBy("a", "b").agg(F.count("*").cast("int").alias("common")), "set-candidates")
    size = lambda c: one.select(F.col("class").alias(c), F.size("s").alias(f"n{c}"))
    both = counts.where(F.col("common") >= least).join(size("a"), "a").join(size("b"), "b")
    return Links(both.select("a", "b", "common", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("jaccard")), members, counts)


def _hashes(rows: DataFrame, items: Column) -> Column:
    """Sorted hashes of the elements, by a seed with which no two elements have the same."""
    kinds = store.kept(rows.select(F.explode(items).alias("e")).distinct(), "set-kinds")
    n = kinds.count()
    seed = next(k for k in itertools.count() if kinds.select(F.xxhash64("e", F.lit(k))).distinct().count() == n)
    return F.array_sort(F.transform(items, lambda e: F.xxhash64(e, F.lit(seed))))


def _blocked(sizes: list[tuple[int, int]], threshold: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(size, first block, blocks) of each size of sets (size, how many), from the smallest on; and the cells (i, j), i <= j, of two blocks that can hold similar sets."""
    cut = lambda total, least, most: min(most, max(least, -(-total // BLOCKS)))
    most, held = cut(sum(n for _, n in sizes), *LINKED), cut(sum(s * n for s, n in sizes), *HELD)
    out, low, high, n_sets, n_elements = [], [], [], 0, 0
    for size, n in sizes:
        parts = max(-(-n // most), -(-n * size // held))
        if parts > 1 or not low or n_sets + n > most or n_elements + n * size > held:
            low, high, n_sets, n_elements = [*low, *[size] * parts], [*high, *[size] * parts], 0, 0
        out.append((size, len(low) - parts, parts))
        high[-1], n_sets, n_elements = size, n_sets + (n if parts == 1 else most), n_elements + n * size
    return out, [(i, j) for j in range(len(low)) for i in range(j + 1) if high[i] >= threshold * low[j] - NEAR]


def _forest(ids: np.ndarray, held: pa.ListArray, right: np.ndarray, alone: bool, t: float) -> tuple[list[int], list[int]]:
    """A spanning forest (a, b) of the similar pairs of a cell: one set of its smaller block, one of its larger (`right`); of two sets of one block, if it is alone. Bits in which two sketches differ are elements that only one of the sets has; where there are too many of them, or both sets are connected by now, a pair is left out, else it is compared element by element."""
    n = np.diff(held.offsets.to_numpy()).astype(np.int64)
    order = np.lexsort((ids, n, right))
    starts = held.offsets.to_numpy()[:-1].astype(np.int64)[order]
    ids, n, first = ids[order], n[order], 0 if alone else int((~right).sum())
    begin = np.concatenate([[0], np.cumsum(n)])
    values = held.values.to_numpy(zero_copy_only=False)[np.arange(begin[-1]) + np.repeat(starts - begin[:-1], n)]
    kinds, flat = np.unique(values, return_inverse=True)
    words = 1 << int(np.clip(np.round(np.log2(SKETCH * n.mean() / 64)), 0, 8))
    sketch = np.zeros(words * len(n), np.uint64)
    np.bitwise_or.at(sketch, ((values >> 6) & (words - 1)) * len(n) + np.repeat(np.arange(len(n)), n), np.uint64(1) << (values & 63).astype(np.uint64))
    sketch = sketch.reshape(words, -1)
    del values
    apart = n * ((1 - t) / (1 + t)) + NEAR
    last = np.searchsorted(n[first:], np.floor(n / t + NEAR), side="right") + first
    label, mark = np.arange(len(n)), np.zeros(len(kinds), bool)
    odd, bits, sums = np.empty(len(n), np.uint64), np.empty(len(n), np.uint8), np.empty(len(n), np.uint16)
    a, b = [], []
    for x in range(len(n) if alone else first):
        low, high = x + 1 if alone else first, last[x]
        if high <= low:
            continue
        some_odd, some_bits, some = odd[: high - low], bits[: high - low], sums[: high - low]
        some[:] = 0
        for k in range(words):
            np.bitwise_xor(sketch[k, low:high], sketch[k, x], out=some_odd)
            np.bitwise_count(some_odd, out=some_bits)
            np.add(some, some_bits, out=some)
        found = np.flatnonzero(some <= apart[low:high] + apart[x]) + low
        own = flat[begin[x] : begin[x + 1]]
        mark[own] = True
        for at in range(0, len(found), 1024):
            few = found[at : at + 1024]
            few = few[label[few] != label[x]]
            if not len(few):
                continue
            place = np.cumsum(n[few]) - n[few]
            common = np.add.reduceat(mark[flat[np.arange(n[few].sum()) + np.repeat(begin[few] - place, n[few])]], place, dtype=np.int64)
            few = few[common * (1 + t) >= t * (n[few] + n[x]) - NEAR]
            trees, at_first = np.unique(label[few], return_index=True)
            if len(trees):
                a += [int(ids[x])] * len(trees)
                b += ids[few[at_first]].tolist()
                label[np.isin(label, trees)] = label[x]
        mark[own] = False
    return a, b


def linked(sets: DataFrame, id_col: str, items: Column, threshold: float) -> DataFrame:
    """(a, b): links that connect what `similar` sets connect, with one for each further copy; of a cell of two blocks at most one row a set, however many pairs are candidates or similar."""
    rows = sets.select(F.col(id_col).cast("long").alias("id"), F.array_distinct(F.array_compact(items.cast("array<string>"))).alias("s")).where(F.size("s") > 0)
    rows = store.kept(rows.select("id", _hashes(rows, F.col("s")).alias("hs")).withColumn("key", F.unhex(F.sha2(F.to_json("hs"), 256))), "sets")
    first = store.kept(rows.groupBy("key").agg(F.min("id").alias("class")), "set-classes")
    copies = rows.select("id", "key").join(first, "key").where("id <> class").select(F.col("id").alias("a"), F.col("class").alias("b"))
    one = store.kept(rows.join(first.select(F.col("class").alias("id"), "key"), ["id", "key"], "left_semi").select("id", "hs", F.size("hs").alias("n")), "set-firsts")
    spark = sets.sparkSession
    places, cells = _blocked(sorted((r["n"], r["count"]) for r in one.groupBy("n").count().collect()), threshold)  # a row a size
    if not cells:
        return copies
    of = [(k, c, k == j, i == j) for c, (i, j) in enumerate(cells) for k in {i, j}]
    places, of = spark.createDataFrame(places, "n int, first int, parts int"), spark.createDataFrame(of, "block int, cell int, right boolean, alone boolean")
    placed = one.join(F.broadcast(places), "n").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int"))
    dealt = placed.join(F.broadcast(of), "block").select("cell", "right", "alone", "id", "hs").repartition(min(400, 2 * len(cells)), "cell")

    def run(g: pa.Table) -> pa.Table:
        a, b = _forest(g.column("id").to_numpy(), g.column("hs").combine_chunks(), g.column("right").to_numpy(), g.column("alone")[0].as_py(), threshold)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("cell").applyInArrow(run, "a long, b long").union(copies)


def pairs(sets: DataFrame, id_col: str, items: Column, threshold: float) -> DataFrame:
    """(a, b, jaccard) of all pairs of ids, copies included, whose sets are as similar as asked (over 0); an id has one set.

    Where all sets are made of few elements, nearly all share one, prefixes leave nothing out and most pairs are part of the result. There sets travel as
    bits, a block of them once for each other block, and pairs go from where they are compared to the result, a batch at a time; none is joined or moved.
    """
    rows = sets.select(F.col(id_col).cast("long").alias("id"), F.array_distinct(F.array_compact(items.cast("array<string>"))).alias("s")).where("id IS NOT NULL AND size(s) > 0")
    rows = store.kept(rows, "sets")
    kinds = sorted(r["e"] for r in rows.select(F.explode("s").alias("e")).distinct().limit(FEW + 1).collect())
    n = rows.count()
    if len(kinds) > FEW or not n:
        return similar(rows, "id", F.col("s"), threshold).expanded().select("a", "b", "jaccard")
    words = -(-len(kinds) // 64)
    n_blocks = -(-n // min(BITS[1], max(BITS[0], n // 16)))
    known = [F.array(*[F.lit(e) for e in kinds[64 * w : 64 * w + 64]]) for w in range(words)]
    bit = F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    place = lambda k: F.filter(F.transform("s", lambda e: F.array_position(k, e).cast("int")), lambda at: at > 0)
    bits = F.array(*[F.aggregate(place(k), F.lit(0).cast("long"), lambda acc, at: acc.bitwiseOR(F.element_at(bit, at))) for k in known])
    block = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")
    packed = rows.select(block.alias("block"), "id", bits.alias("bits")).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("id", "bits"))).alias("h"))
    packed = store.kept(packed.select("block", F.col("h.id").alias("ids"), F.flatten("h.bits").alias("bits")), "set-bits")
    left = packed.select(F.col("block").alias("i"), F.col("ids").alias("ia"), F.col("bits").alias("sa"), F.explode(F.sequence(F.col("block"), F.lit(n_blocks - 1))).alias("block"))
    cells = left.join(packed.withColumnsRenamed({"ids": "ib", "bits": "sb"}), "block").repartition(n_blocks * (n_blocks + 1) // 2, "i", "block")

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                of = lambda c: batch.column(c)[k].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                same = batch.column("i")[k].as_py() == batch.column("block")[k].as_py()
                ia, ib, sa, sb = of("ia"), of("ib"), of("sa").view(np.uint64).reshape(-1, words), of("sb").view(np.uint64).reshape(-1, words)
                na, nb = (np.bitwise_count(x).sum(axis=1, dtype=np.int16) for x in (sa, sb))
                step = max(1, AT_ONCE // len(ib))
                for at in range(0, len(ia), step):
                    few = slice(at, at + step)
                    common = sum(np.bitwise_count(sa[few, w, None] & sb[None, :, w]).astype(np.int16) for w in range(words))
                    jaccard = common / (na[few, None] + nb - common)
                    p, q = np.nonzero((jaccard >= threshold) & (ia[few, None] < ib) if same else jaccard >= threshold)
                    x, y = ia[few][p], ib[q]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(jaccard[p, q])], ["a", "b", "jaccard"])

    return cells.select("i", "block", "ia", "ib", "sa", "sb").mapInArrow(run, "a long, b long, jaccard double")
