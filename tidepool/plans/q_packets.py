"""Lines in packets: keyword recall through filters, packed and sharded forms and their way back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.functions import bloom
from tidepool.operators import packets as pk
from tidepool.operators import search, store
from tidepool.plans.registry import query
from tidepool.plans.tables import LINES_SQL, log_lines, table

_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9_]{{3,}}')"


def _stem_sql(w: str) -> str:
    out = w
    for ending in ("s", "es", "ed", "ing"):
        out = f"CASE WHEN length({w}) > {max(3, len(ending) + 2)} AND ends_with({w}, '{ending}') THEN substr({w}, 1, length({w}) - {len(ending)}) ELSE {out} END"
    return out


def _variants_sql(w: str) -> str:
    s = _stem_sql(w)
    return f"[{w}, {s}, CASE WHEN length({w}) >= 5 THEN 'pref:' || substr({w}, 1, 5) END, CASE WHEN length({s}) >= 5 THEN 'pref:' || substr({s}, 1, 5) END]"


#: Every line with what stands for its words.
_HELD = f"{LINES_SQL}, h AS (SELECT line_no, text, list_distinct(flatten(list_transform({_TOKENS.format('text')}, lambda w: {_variants_sql('w')}))) AS held FROM lines)"


def _has_sql(keywords: list[str], every: bool = True, held: str = "held") -> str:
    quoted = [f"'{k}'" for k in keywords]
    return "(" + (" AND " if every else " OR ").join(f"len(list_intersect({held}, {_variants_sql(k)})) > 0" for k in quoted) + ")"


_WORDS = ["purchases", "u12"]
_PACKETS = f"{_HELD}, p AS (SELECT line_no // 256 AS packet, list_distinct(flatten(list(held))) AS held FROM h GROUP BY 1)"


def _index(spark, sf):
    return pk.index(log_lines(spark, sf), "line_no", "text")


def _sure(spark, sf, found, keywords, size=pk.PACKET):
    """Packets among those found whose lines have all keywords: filters alone may let others pass."""
    lines = log_lines(spark, sf).withColumn("packet", F.floor(F.col("line_no") / size)).join(found, "packet", "left_semi")
    tests = [F.max(pk.line_has(F.col("text"), [k])).alias(f"k{i}") for i, k in enumerate(keywords)]
    out = lines.groupBy("packet").agg(*tests)
    for i in range(len(keywords)):
        out = out.where(F.col(f"k{i}"))
    return out.select("packet")


@query("ret_sas_packets", f"WITH {_PACKETS} SELECT packet FROM p WHERE {_has_sql(_WORDS)}")
def _(spark, sf):
    return _sure(spark, sf, pk.packets_with(_index(spark, sf), _WORDS), _WORDS)


@query("ret_block_bloom")
def _(spark, sf):
    """Filters of blocks as unions of their packets' filters: set bits, and the share of strange words that pass."""
    b = pk.blocks(_index(spark, sf))
    strange = F.array(*[F.lit(f"strange{i}") for i in range(40)])
    rate = F.size(F.filter(strange, lambda w: bloom.has(F.col("filter"), w))) / 40.0
    return b.select("block", F.aggregate("filter", F.lit(0), lambda s, w: s + F.bit_count(w)).cast("long").alias("n_bits"), rate.alias("rate"))


@query("ret_block_query", f"WITH {_HELD}, b AS (SELECT line_no // 1024 AS block, list_distinct(flatten(list(held))) AS held FROM h GROUP BY 1) SELECT block FROM b WHERE {_has_sql(['u77', 'purchasing'])}")
def _(spark, sf):
    words = ["u77", "purchasing"]
    b = pk.blocks(_index(spark, sf))
    passing = b.where(pk.filter_has(F.col("filter"), words)).select(F.col("block").alias("packet"))
    return _sure(spark, sf, passing, words, pk.PACKET * pk.BLOCK).select(F.col("packet").alias("block"))


def _recall(spark, sf, keywords, every=True, **more):
    packets = _index(spark, sf)
    return pk.recalled(log_lines(spark, sf), packets, pk.blocks(packets), keywords, "line_no", "text", every, **more).select("line_no")


@query("ret_two_level", f"WITH {_HELD} SELECT line_no FROM h WHERE {_has_sql(_WORDS)}")
def _(spark, sf):
    """Blocks, then packets, then lines."""
    return _recall(spark, sf, _WORDS)


@query("ret_two_level_pf0", f"WITH {_HELD} SELECT line_no FROM h WHERE {_has_sql(['timeouts', 'click'], False)}")
def _(spark, sf):
    """Both levels of an index that is written once and read for every recall; here any keyword is enough."""
    kept = store.appended(spark, "packets", _index(spark, sf))
    above = store.appended(spark, "blocks", pk.blocks(kept))
    return pk.recalled(log_lines(spark, sf), kept, above, ["timeouts", "click"], "line_no", "text", every=False).select("line_no")


@query("ret_two_level_mr", f"WITH {_HELD} SELECT line_no FROM h WHERE {_has_sql(['signup', 'u33'])}")
def _(spark, sf):
    """Two resolutions: wide filters of blocks are strict, narrow ones of packets let any keyword pass."""
    x = log_lines(spark, sf)
    narrow = pk.index(x, "line_no", "text", bits=2048)
    wide = pk.blocks(pk.index(x, "line_no", "text", bits=16_384), bits=16_384)
    return pk.recalled(x, narrow, wide, ["signup", "u33"], "line_no", "text", loose=True, bits=2048, block_bits=16_384).select("line_no")


@query("ret_decoded_lines", f"WITH {_HELD} SELECT line_no FROM h WHERE {_has_sql(['errors', 'server'])}")
def _(spark, sf):
    """Lines out of packed packets, looked at when they are unpacked."""
    packets = pk.packed(log_lines(spark, sf))
    few = packets.join(pk.packets_with(_index(spark, sf), ["errors", "server"]), "packet", "left_semi")
    return pk.unpacked(few).where(pk.line_has(F.col("text"), ["errors", "server"])).select("line_no")


_FIRST = ["purchase", "u12"]


@query("ret_bloom_kw", f"WITH {_HELD} SELECT line_no FROM h WHERE {_has_sql(_FIRST)} ORDER BY line_no LIMIT 50")
def _(spark, sf):
    """The first fifty lines with all words."""
    packets = _index(spark, sf)
    return pk.recalled(log_lines(spark, sf), packets, None, _FIRST, "line_no", "text").orderBy("line_no").limit(50).select("line_no")


_ROUTED = ((1, ["timeout", "server"]), (2, ["purchase", "u12"]))


@query(
    "ret_router",
    f"WITH {_HELD}, t AS (SELECT DISTINCT template, list_distinct(flatten(list_transform({_TOKENS.format('template')}, lambda w: {_variants_sql('w')}))) AS held FROM lines), fast AS (SELECT line_no FROM lines WHERE template IN (SELECT template FROM t WHERE {_has_sql(['timeout'])}) AND contains(text, 'server')) SELECT 1 AS query_id, 'FAST' AS mode, line_no FROM fast UNION ALL SELECT 2, 'FILTER', line_no FROM h WHERE {_has_sql(['purchase', 'u12'])}",
)
def _(spark, sf):
    """Each query first goes to the templates that have one of its words; where these give no line, it goes through the filters."""
    x = log_lines(spark, sf)
    packets, out = _index(spark, sf), None
    for i, words in _ROUTED:
        templates = x.select("template").distinct().where(pk.line_has(F.col("template"), words, every=False))
        text = F.lower("text")
        fast = x.join(templates, "template", "left_semi")
        for w in words:
            fast = fast.where(F.contains(text, F.lit(w)))
        mode = "FILTER" if fast.isEmpty() else "FAST"
        hits = fast if mode == "FAST" else pk.recalled(x, packets, None, words, "line_no", "text")
        hits = hits.select(F.lit(i).alias("query_id"), F.lit(mode).alias("mode"), "line_no")
        out = hits if out is None else out.unionByName(hits)
    return out


_BUCKET = "list_distinct([list_sum([CASE WHEN embedding[4 * c + j + 1] >= 0 THEN 1 << j ELSE 0 END FOR j IN range(4)])::bigint FOR c IN range(16)])"


@query("ret_sem_bloom", f"WITH b AS (SELECT vec_id, label, {_BUCKET} AS bs FROM embeddings), l AS (SELECT label, list_distinct(flatten(list(bs))) AS bs FROM b GROUP BY label) SELECT b.vec_id, l.label FROM b JOIN l ON list_has_all(l.bs, b.bs) WHERE b.vec_id % 50 = 0")
def _(spark, sf):
    """Labels whose vectors have all sign buckets of a query: filters first, then the buckets themselves."""
    part = lambda v, c: search.sign_bucket(F.transform(F.slice(v, 4 * c + 1, 4), lambda x: F.when(x >= 0, 1.0).otherwise(-1.0)), 4)
    v = table(spark, sf, "embeddings").select("vec_id", "label", F.array_distinct(F.array(*[part("embedding", c) for c in range(16)])).alias("buckets"))
    named = v.select("vec_id", "label", F.transform("buckets", lambda b: F.concat(F.lit("bucket:"), b.cast("string"))).alias("buckets"))
    words = named.select("label", F.explode("buckets").alias("word"))
    filters = bloom.filters(words, "label", "word", 2048)
    held = words.groupBy("label").agg(F.collect_set("word").alias("held"))
    asks = named.where("vec_id % 50 = 0").select("vec_id", "buckets", F.col("buckets")[0].alias("word"))
    some = asks.join(words.distinct(), "word").drop("word")  # labels that have the first bucket, so that not all meet all
    passing = some.join(filters, "label").where(F.forall("buckets", lambda b: bloom.has(F.col("filter"), b, 2048))).select("vec_id", "label", "buckets")
    return passing.join(held, "label").where(F.size(F.array_except("buckets", "held")) == 0).select("vec_id", "label")


# Packed forms


@query("cmp_pf1", f"WITH {LINES_SQL} SELECT line_no, text FROM lines WHERE starts_with(template, 'Error')")
def _(spark, sf):
    """Recall by template: packets that have it are unpacked, others are not."""
    packets = store.appended(spark, "packed", pk.packed(log_lines(spark, sf)))
    few = packets.where(F.exists("templates", lambda t: F.startswith(t, F.lit("Error"))))
    return pk.unpacked(few).where(F.startswith("text", F.lit("Error")))


@query("cmp_pfq1", f"WITH {_HELD} SELECT line_no, text FROM h WHERE {_has_sql(['views', 'u19'])}")
def _(spark, sf):
    """Packed packets with their filters beside them: recall by words."""
    lines = log_lines(spark, sf)
    packets = store.appended(spark, "packed", pk.packed(lines).join(pk.index(lines, "line_no", "text"), "packet"))
    few = packets.where(pk.filter_has(F.col("filter"), ["views", "u19"]))
    return pk.unpacked(few).where(pk.line_has(F.col("text"), ["views", "u19"]))


@query("cmp_sharded", f"WITH {LINES_SQL} SELECT line_no, text FROM lines")
def _(spark, sf):
    """All lines into containers and out again."""
    shards = store.appended(spark, "shards", pk.shards(pk.packed(log_lines(spark, sf))))
    return pk.from_shards(shards, shards.select(F.explode("ids").alias("packet"))).select("line_no", "text")


@query("cmp_lazy", f"WITH {LINES_SQL} SELECT line_no // 256 AS packet, line_no, text, (SELECT count(DISTINCT line_no // 256) FROM lines b WHERE (b.line_no // 256) % 5 = 2 AND b.line_no // 4096 = lines.line_no // 4096) AS n_read FROM lines WHERE (line_no // 256) % 5 = 2")
def _(spark, sf):
    """Every fifth packet out of containers: no other is read."""
    shards = store.appended(spark, "shards", pk.shards(pk.packed(log_lines(spark, sf))))
    wanted = shards.select(F.explode("ids").alias("packet")).where(F.col("packet") % 5 == 2)
    return pk.from_shards(shards, wanted)
