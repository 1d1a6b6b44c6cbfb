"""URL rules by a Bloom filter cascade.

A rule is a host and a path prefix; it fits the host, all its subdomains, and paths that start with
the prefix. A rule's shape is the number of its host's labels and the length of its path. For every
shape among the rules a URL has at most one key: so many last labels of its host, joined with so long
a prefix of its path. The URL's rules are those of its keys that are listed.

Membership is answered by cascades alone, one for each verdict; the rules themselves are not sent.
Level 0 holds the listed keys; level 1 the keys of the corpus that pass level 0 wrongly; level 2 the
listed keys that pass level 1; and so on until no key of the corpus's complete key universe is judged
wrongly. The first pass finds the corpus's keys that pass a level 0. Its rate is set by the number of
keys, so that about as many wrong keys as rules are expected, whatever the size of the corpus; they
are counted before they reach the driver, and level 0 is built anew with a lower rate where they are
too many. The second pass judges. Both read the URL column alone, in narrow tasks; only passing keys
are shuffled, after they are made distinct in each task. There is no join.

Null URLs and URLs without `://` have an empty host and path and fit no rule; null ids are kept,
repeated rows are each judged, an empty table gives an empty result, no rules allow everything;
other columns are left out. A very long host or path costs time in proportion: a key has no more
labels than its shape.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import pick

ALLOW, BLOCK = "allow", "block"
#: Wrong keys of level 0 that may reach the driver, beside a multiple of the number of rules.
WRONG = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path as text between the marks."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


class Bloom:
    def __init__(self, keys: Iterable[str], rate: float, seed: int) -> None:
        keys = list(keys)
        self.m = max(8, math.ceil(-len(keys) * math.log(rate) / math.log(2) ** 2))
        self.k, self.seed = max(1, round(-math.log2(rate))), seed
        self.bits = bytearray((self.m + 7) // 8)
        for key in keys:
            for i in self._places(key):
                self.bits[i >> 3] |= 1 << (i & 7)

    def _places(self, key: str) -> Iterator[int]:
        import xxhash

        h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"), seed=self.seed)
        a, b = h >> 64, (h & (1 << 64) - 1) | 1
        return ((a + i * b) % self.m for i in range(self.k))

    def __contains__(self, key: str) -> bool:
        return all(self.bits[i >> 3] >> (i & 7) & 1 for i in self._places(key))


class Cascade:
    """Exact for the listed keys and for the universe it was built over."""

    def __init__(self, listed: set[str], first: Bloom, wrong: set[str]) -> None:
        self.levels, inside, outside = [first], wrong, listed
        while inside:  # the keys that the last level passes wrongly
            level = Bloom(inside, 0.5, len(self.levels))
            self.levels.append(level)
            inside, outside = {k for k in outside if k in level}, inside

    def __contains__(self, key: str) -> bool:
        for i, level in enumerate(self.levels):
            if key not in level:
                return i % 2 == 1
        return len(self.levels) % 2 == 1


def shape(rule: str) -> tuple[int, int]:
    """Labels of the host and length of the path prefix, the first slash included."""
    host, path = rule.split("/", 1)
    return host.count(".") + 1, len(path) + 1


def keys(host: str, path: str, shapes: list[tuple[int, int]]) -> Iterator[str]:
    """One key at most for a shape, longest first."""
    if not host:
        return
    most = max(labels for labels, _ in shapes)
    last = host.rsplit(".", most)[-most:]
    suffix = {n: ".".join(last[-n:]) for n in {labels for labels, _ in shapes} if n <= len(last)}
    found = {suffix[labels] + path[:n] for labels, n in shapes if labels in suffix and n <= len(path)}
    yield from sorted(found, key=lambda k: (-len(k), k))


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row; rules are (verdict, host/path-prefix)."""
    listed = {verdict: {rule for v, rule in rules if v == verdict} for verdict in (ALLOW, BLOCK)}
    every = listed[ALLOW] | listed[BLOCK]
    rows = pick(pages, page_id=(id_col, "long"), url=(url_col, "string"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    if not every:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(ALLOW).alias("verdict"))
    sc, shapes = pages.sparkSession.sparkContext, sorted({shape(rule) for rule in every})

    def passing(levels: list[Bloom]) -> DataFrame:
        shared = sc.broadcast(levels)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = {k for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k in keys(h, p, shapes) if any(k in level for level in shared.value)}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["key"])

        return rows.select("host", "path").mapInArrow(run, "key string").distinct()

    most = 8 * len(every) + WRONG
    rate = min(0.25, len(every) / (max(1, pages.count()) * len(shapes)))
    while True:
        first = {verdict: Bloom(listed[verdict], rate, i) for i, verdict in enumerate(listed) if listed[verdict]}
        found = {r.key for r in passing(list(first.values())).limit(most + 1).collect()}
        if len(found) <= most:
            break
        rate /= 64
    cascades = sc.broadcast([(verdict, Cascade(listed[verdict], level, {k for k in found - listed[verdict] if k in level})) for verdict, level in first.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [next(((k, verdict) for k in keys(h, p, shapes) for verdict, cascade in cascades.value if k in cascade), (None, ALLOW)) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k for k, _ in judged], pa.string()), pa.array([v for _, v in judged], pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def oracle(rules: list[tuple[str, str]]) -> str:
    listed = ", ".join(f"('{v}', '{r}', '{r[: r.index('/')]}', '{r[r.index('/') :]}')" for v, r in rules)
    return rf"""
WITH rules AS (SELECT * FROM (VALUES {listed}) AS v(verdict, rule, rule_host, rule_path)),
cut AS (SELECT page_id, row_number() OVER () AS r, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, r, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM cut),
fits AS (SELECT r, arg_max(struct_pack(rule := rule, verdict := rules.verdict), length(rule)) AS best FROM parts JOIN rules
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY r)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (r)
"""
