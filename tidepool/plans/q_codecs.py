"""Compression, de-duplication and integrity: what is packed is unpacked again, and held against what it was."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions import chunks, codecs
from tidepool.operators import events as ev
from tidepool.operators import integrity, lsh, ranking, store, text
from tidepool.plans.registry import query
from tidepool.plans.tables import LINES_SQL, dealt, log_lines, table

# Whole texts


def _binary(f):
    return F.pandas_udf(lambda s: s.map(lambda b: f(bytes(b))), T.BinaryType())


_smallest = _binary(codecs.smallest)


@F.pandas_udf(T.StructType([T.StructField("mark", T.StringType()), T.StructField("text", T.BinaryType())]))
def _decoded(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([codecs.decoded(bytes(b)) for b in data], columns=["mark", "text"])


@query("cmp_meta", "SELECT doc_id, md5(text) AS back, true AS not_larger FROM documents")
def _(spark, sf):
    """Each text in the smallest of six forms, and out of it again."""
    d = table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
    packed = d.select("doc_id", F.length("raw").alias("n"), _smallest("raw").alias("data"))
    return packed.select("doc_id", _decoded("data").alias("d"), (F.length("data") <= F.col("n") + 4).alias("not_larger")).select("doc_id", F.md5("d.text").alias("back"), "not_larger")


_MARKS = ("RAW0", "ZSTD", "ZLIB", "BZIP")


@query("cmp_decode_router", "SELECT doc_id, ['RAW0', 'ZSTD', 'ZLIB', 'BZIP'][(doc_id % 4 + 1)::int] AS mark, md5(text) AS back FROM documents")
def _(spark, sf):
    """Blobs of several forms; the mark at the beginning of each says how to read it."""

    @F.pandas_udf("binary")
    def packed(raw: pd.Series, mark: pd.Series) -> pd.Series:
        return pd.Series([codecs.forms(bytes(b))[m] for b, m in zip(raw, mark, strict=True)])

    mark = F.element_at(F.array(*[F.lit(m) for m in _MARKS]), (F.col("doc_id") % 4 + 1).cast("int"))
    blobs = table(spark, sf, "documents").select("doc_id", packed(F.col("text").cast("binary"), mark).alias("data"))
    return blobs.select("doc_id", _decoded("data").alias("d")).select("doc_id", "d.mark", F.md5("d.text").alias("back"))


_LINES = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
#: Texts of fewer bytes are always kept whole; above this share of one line they are not. Fixed values.
SMALL, REPEATED = 100, 0.8


@query(
    "cmp_tier",
    f"WITH l AS (SELECT doc_id, text, {_LINES} AS ls FROM documents), r AS (SELECT doc_id, text, CASE WHEN len(ls) <= 1 THEN 0.0 ELSE list_max(list_transform(list_distinct(ls), lambda x: len(list_filter(ls, lambda y: y = x))))::double / len(ls) END AS share, ls FROM l), t AS (SELECT *, CASE WHEN trim(text) = '' THEN 0 WHEN strlen(text) < {SMALL} THEN 3 WHEN share > {REPEATED} THEN 0 ELSE 3 END AS tier FROM r) SELECT doc_id, tier, CASE WHEN tier = 3 THEN md5(text) ELSE md5(array_to_string(list_filter(ls, lambda x, i: list_position(ls, x) = i), chr(10))) END AS back FROM t",
)
def _(spark, sf):
    """Texts by tier: 3 keeps all, 0 each different line once. What comes back of either."""
    share = text.repetitiveness(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", F.when(F.col("n_lines") > 1, F.col("share")).otherwise(0.0).alias("share"))
    d = table(spark, sf, "documents").join(share, "doc_id", "left")
    tier = F.when(F.trim("text") == "", 0).when(F.octet_length("text") < SMALL, 3).when(F.col("share") > REPEATED, 0).otherwise(3)
    kept = F.when(F.col("tier") == 3, F.col("text")).otherwise(F.array_join(F.array_distinct(text.lines(F.col("text"))), "\n"))
    packed = d.withColumn("tier", tier).select("doc_id", "tier", _smallest(kept.cast("binary")).alias("data"))
    return packed.select("doc_id", "tier", _decoded("data").alias("d")).select("doc_id", "tier", F.md5("d.text").alias("back"))


#: Confidence of each tier, and what a reader asks for. Fixed values.
CONFIDENCE = {0: 0.70, 3: 0.95}
WANTED = 0.80


@query("cmp_mem_tier", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 3 END AS tier, CASE WHEN doc_id % 2 = 0 THEN 0.70 ELSE 0.95 END::double AS confidence, CASE WHEN doc_id % 2 = 0 THEN md5(trim(string_split(text, chr(10))[1])) ELSE md5(text) END AS back FROM documents")
def _(spark, sf):
    """Two packets a text, a sketch and the whole, each with a checksum: the first is taken if its confidence is enough for the reader (every second is content with little), else the second."""
    d = table(spark, sf, "documents")
    sketch, whole = F.trim(F.split("text", "\n")[0]), F.col("text")
    sealed = lambda t, body: F.struct(F.lit(t).alias("tier"), F.lit(CONFIDENCE[t]).alias("confidence"), _smallest(body.cast("binary")).alias("data"), F.sha2(body, 256).alias("sum"))
    p = d.select("doc_id", sealed(0, sketch).alias("low"), sealed(3, whole).alias("high"), F.when(F.col("doc_id") % 2 == 0, 0.60).otherwise(WANTED).alias("wanted"))
    used = F.when(F.col("low.confidence") >= F.col("wanted"), F.col("low")).otherwise(F.col("high"))
    out = p.select("doc_id", used.alias("u")).select("doc_id", "u.tier", "u.confidence", "u.sum", _decoded("u.data").alias("d"))
    true = F.when(F.sha2("d.text", 256) == F.col("sum"), F.col("d.text")).otherwise(F.raise_error(F.lit("a packet does not have its checksum")).cast("binary"))
    return out.select("doc_id", "tier", "confidence", F.md5(true).alias("back"))


@query("cmp_delta", "SELECT conv_id, turn, md5(text) AS back FROM conversations")
def _(spark, sf):
    """Each turn packed with the turn before as its dictionary, and out again."""
    both = lambda f: F.pandas_udf(lambda a, b: pd.Series([f(bytes(x), bytes(y or b"")) for x, y in zip(a, b, strict=True)]), "binary")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").cast("binary").alias("new"), F.lag("text").over(w).cast("binary").alias("old"))
    packed = c.select("conv_id", "turn", "old", both(codecs.delta)("new", "old").alias("data"))
    return packed.select("conv_id", "turn", F.md5(both(codecs.undelta)("data", "old")).alias("back"))


@query("cmp_bench", "SELECT source, count(*) AS n, sum(strlen(text))::bigint AS raw, true AS smaller FROM documents GROUP BY source")
def _(spark, sf):
    """Bytes of each source in every form; the best is smaller than the raw one."""

    def sizes(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: {m: len(x) for m, x in codecs.forms(bytes(b)).items()})

    each = table(spark, sf, "documents").select("source", F.octet_length("text").alias("raw"), F.pandas_udf(sizes, "map<string,long>")(F.col("text").cast("binary")).alias("m"))
    per = each.groupBy("source").agg(F.count("*").alias("n"), F.sum("raw").alias("raw"), *[F.sum(F.coalesce(F.col("m")[k], F.col("m")["RAW0"])).alias(k) for k in (*_MARKS, "NUMS", "LINE")])
    best = F.least(*[F.struct(F.col(k).alias("size"), F.lit(k).alias("form")) for k in (*_MARKS, "NUMS", "LINE")])
    return per.select("source", "n", "raw", (best.size < F.col("raw")).alias("smaller"))


@query("cmp_huffman")
def _(spark, sf):
    """A code for the letters of all texts: length and count of each; the symbols are counted before they reach the driver."""
    return huffman_code(table(spark, sf, "documents"), "text")


#: Different symbols that a code may have.
SYMBOLS = 70_000


def huffman_code(df: DataFrame, text_col: str) -> DataFrame:
    counts = df.select(F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "")).alias("symbol")).where("symbol <> ''").groupBy("symbol").agg(F.count("*").alias("n")).cache()
    if counts.count() > SYMBOLS:
        raise ValueError(f"more than {SYMBOLS} different symbols")
    codes = codecs.canonical_codes(codecs.code_lengths({r.symbol: r.n for r in counts.collect()}))
    spark = df.sparkSession
    listed = spark.createDataFrame(sorted(codes.items()), "symbol string, code string") if codes else spark.createDataFrame([], "symbol string, code string")
    return counts.join(F.broadcast(listed), "symbol").select("symbol", "n", "code", F.length("code").cast("long").alias("bits"))  # at most SYMBOLS rows


# Lines and tokens by number


def numbered(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, id): different values numbered from 0 in the order of their first place. Narrow rows are sorted by range and counted; nothing is gathered in one task."""
    first = df.groupBy(value).agg(F.min(order).alias("first"))
    sorted_ = store.appended(df.sparkSession, "numbered", first.select(F.xxhash64(value).alias("h"), value, "first").repartitionByRange("first", value).sortWithinPartitions("first", value).withColumn("part", F.spark_partition_id()))
    before = sorted_.groupBy("part").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")  # a row a partition
    nth = F.row_number().over(Window.partitionBy("part").orderBy("first", value)) - 1
    return sorted_.withColumn("nth", nth).join(F.broadcast(before), "part").select(value, (F.col("before") + F.col("nth")).alias("id"))


@query("cmp_dict", f"WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, {_LINES} AS ls FROM documents)), f AS (SELECT line, min((doc_id, i)) AS first FROM l GROUP BY line) SELECT md5(line) AS line, row_number() OVER (ORDER BY first, line) - 1 AS id FROM f")
def _(spark, sf):
    """The table of different lines, numbered as they first come."""
    each = table(spark, sf, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("i", "line")).select("line", F.struct("doc_id", "i").alias("at"))
    return numbered(each, "line", "at").select(F.md5("line").alias("line"), "id")


@query("cmp_tokens", "SELECT doc_id, md5(text) AS back, len(string_split(text, ' ')) AS n FROM documents")
def _(spark, sf):
    """Texts as numbers of a token table, and out again."""
    each = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "token"))
    ids = numbered(each.select("token", "doc_id"), "token", "doc_id")
    coded = store.appended(spark, "coded", each.join(ids, "token").select("doc_id", "i", "id"))
    back = coded.join(ids, "id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "token"))).alias("t"))
    return back.select("doc_id", F.md5(F.array_join(F.transform("t", lambda x: x.token), " ")).alias("back"), F.size("t").cast("long").alias("n"))


# Channels


@query(
    "cmp_channels",
    f"WITH {LINES_SQL}, s AS (SELECT line_no // 1024 AS packet, template, unnest(range(len(slots))) AS slot, unnest(slots) AS v FROM lines) SELECT packet, template, slot, count(*) AS n, CASE WHEN bool_and(regexp_matches(v, '^(0|[1-9][0-9]{{0,17}})$')) THEN 'INT' WHEN count(DISTINCT v) <= 16 THEN 'DICT' ELSE 'RAW' END AS kind, true AS intact FROM s GROUP BY ALL",
)
def _(spark, sf):
    """Slots of every 1,024 lines as typed columns, and whether they come back."""

    def run(g: pa.Table) -> pa.Table:
        rows = sorted(zip(g.column("line_no").to_pylist(), g.column("v").to_pylist(), strict=True))
        values = [v for _, v in rows]
        back = codecs.read_channel(codecs.Reader(codecs.channel(values)))
        return pa.table({"packet": g.column("packet").slice(0, 1), "template": g.column("template").slice(0, 1), "slot": g.column("slot").slice(0, 1), "n": pa.array([len(values)], pa.int64()), "kind": pa.array([codecs.channel_kind(values)]), "intact": pa.array([back == values])})

    each = log_lines(spark, sf).select(F.floor(F.col("line_no") / 1024).alias("packet"), "line_no", "template", F.posexplode("slots").alias("slot", "v"))
    return each.groupBy("packet", "template", "slot").applyInArrow(run, "packet long, template string, slot int, n long, kind string, intact boolean")


# De-duplication


def _pieces(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(chunks.content_chunks(F.col("text").cast("binary"))).alias("nth", "chunk"))


@query("ded_cdc_c")
def _(spark, sf):
    """Ends of content-defined chunks of every text."""
    ends = F.pandas_udf(lambda s: s.map(lambda b: chunks.boundaries(bytes(b or b""))), "array<long>")
    return table(spark, sf, "documents").select("doc_id", F.posexplode(ends(F.col("text").cast("binary"))).alias("nth", "end"))


@query("ded_hamming")
def _(spark, sf):
    """Bits in which the fingerprint of a text differs from that of the text before."""
    prints = table(spark, sf, "documents").select("doc_id", chunks.simhash_bytes(F.col("text").cast("binary")).alias("h"))
    before = prints.select(F.col("doc_id").alias("id"), F.col("h").alias("before")).join(ranking.successors(prints, "doc_id"), "id").select(F.col("next").alias("doc_id"), "before")
    return prints.join(before, "doc_id").select("doc_id", F.bit_count(F.col("h").bitwiseXOR(F.col("before"))).cast("long").alias("distance"))


@query("ded_bands")
def _(spark, sf):
    """The eight bytes of every text's fingerprint."""
    prints = table(spark, sf, "documents").select("doc_id", chunks.simhash_bytes(F.col("text").cast("binary")).alias("h"))
    return lsh.bands(prints, "h").select("doc_id", "band", F.col("band_value").cast("long").alias("value"))


@query("ded_integrity", "SELECT doc_id, sha256(text) AS sha, true AS intact, true AS within FROM documents WHERE strlen(text) > 0")
def _(spark, sf):
    """Texts out of a store of chunks: each chunk is held against its hash and its growth when unpacked against a bound. A chunk that would grow more is stored as it is."""
    each = _pieces(spark, sf).withColumn("sha", F.sha2("chunk", 256))
    once = each.groupBy("sha").agg(F.first("chunk").alias("chunk")).select("sha", "chunk", _smallest("chunk").alias("data"))
    bounded = F.when(F.length("chunk") <= integrity.EXPANSION * F.length("data"), F.col("data")).otherwise(F.concat(F.lit(b"RAW0"), "chunk"))
    packed = store.appended(spark, "store", once.select("sha", bounded.alias("data")))
    opened = packed.select("sha", F.length("data").alias("size"), _decoded("data").text.alias("chunk"))
    checked = integrity.checked(opened, "sha", "size", "chunk")
    back = each.select("doc_id", "nth", "sha").join(checked, "sha").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("nth", F.hex("chunk").alias("x")))).alias("p"), F.every("intact").alias("intact"), F.every("within").alias("within"))
    return back.select("doc_id", F.sha2(F.unhex(F.array_join(F.transform("p", lambda x: x.x), "")), 256).alias("sha"), "intact", "within")


@query("ded_recursive", "SELECT 'labels' AS batch, count(*) AS n, count(*) AS back FROM labels UNION ALL SELECT 'benchmark', count(*), count(*) FROM benchmark UNION ALL SELECT 'events', count(*), count(*) FROM events")
def _(spark, sf):
    """Rows of the library's own tables as JSON, in batches of a bounded length, packed and out again: rows that come back as they were."""
    most = 4096

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), most):
                js = sorted(batch.column("j").slice(at, most).to_pylist())
                got = codecs.decoded(codecs.smallest("\n".join(js).encode()))[1].decode().split("\n")
                yield pa.RecordBatch.from_arrays([pa.array([len(js)], pa.int64()), pa.array([sum(x == y for x, y in zip(js, got, strict=False))], pa.int64())], ["n", "back"])

    out = None
    for name in ("labels", "benchmark", "events"):
        rows = dealt(table(spark, sf, name), rows=16 * most).select(F.to_json(F.struct("*")).alias("j"))
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
        one = rows.mapInArrow(run, "n long, back long").agg(total("n"), total("back")).select(F.lit(name).alias("batch"), "n", "back")
        out = one if out is None else out.unionByName(one)
    return out


@query("ded_session")
def _(spark, sf):
    """Conversations as sessions: chunks, those that no earlier session has, packed size of these, repeated patterns of roles, and an alert where the ratio is unusual against the sessions before it of the same hundred."""
    c = table(spark, sf, "conversations")
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x.role, F.lit(": "), x.text)), "\n").cast("binary").alias("data"))
    each = whole.select("conv_id", F.explode(chunks.content_chunks("data")).alias("chunk")).select("conv_id", F.sha2("chunk", 256).alias("sha"), F.length("chunk").alias("raw"), chunks.zstd_size("chunk").alias("packed"))
    first = each.groupBy("sha").agg(F.min("conv_id").alias("first"))
    sizes = each.join(first, "sha").groupBy("conv_id").agg(F.count("*").alias("n_chunks"), F.count_if(F.col("conv_id") == F.col("first")).alias("n_new"), F.sum("raw").alias("raw"), F.sum(F.when(F.col("conv_id") == F.col("first"), F.col("packed")).otherwise(8)).alias("packed"))
    motifs = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x.role).alias("r"))
    threes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("r") - 2)), lambda i: F.array_join(F.slice("r", i, F.lit(3)), ">"))
    repeated = motifs.select("conv_id", threes.alias("t")).select("conv_id", (F.size("t") - F.size(F.array_distinct("t"))).cast("long").alias("repeats"))
    ratio = sizes.join(repeated, "conv_id").withColumn("ratio", F.round(F.col("raw") / F.greatest(F.lit(1), F.col("packed")), 6)).withColumn("hundred", F.floor(F.col("conv_id") / 100))
    return ev.anomalies(ratio, ["hundred"], "ratio", F.asc("conv_id")).select("conv_id", "n_chunks", "n_new", "raw", "repeats", "ratio", "alert")


# Chains of hashes

_SEALED = "p AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 16 AS i, event_id, sha256(event_id || event_type || value::varchar) AS h FROM events), k AS (SELECT user_id, i, sha256(string_agg(h, '' ORDER BY event_id)) AS d FROM p GROUP BY ALL)"


@query("int_merkle", f"WITH RECURSIVE {_SEALED}, c AS (SELECT user_id, i, sha256(repeat('0', 64) || d) AS link FROM k WHERE i = 0 UNION ALL SELECT k.user_id, k.i, sha256(c.link || k.d) FROM c JOIN k ON k.user_id = c.user_id AND k.i = c.i + 1) SELECT user_id, max(i) + 1 AS n, arg_max(link, i) AS root FROM c GROUP BY user_id")
def _(spark, sf):
    """The root of each user's chain over packets of 16 events."""
    return integrity.roots(_packets(spark, sf), "user_id", "i", "digest").select("user_id", "n", "root")


def _packets(spark, sf, tampered: bool = False) -> DataFrame:
    value = F.when((F.col("event_id") % 61 == 3) & F.lit(tampered), F.col("value") + 1).otherwise(F.col("value"))
    e = table(spark, sf, "events").select("user_id", "event_id", F.sha2(F.concat(F.col("event_id").cast("string"), "event_type", value.cast("string")), 256).alias("h"))
    return integrity.packets(e, "user_id", "event_id", "h", 16)


@query("int_verify", "SELECT user_id, i, bool_and(event_id % 61 <> 3) AS intact FROM (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 16 AS i FROM events) GROUP BY ALL")
def _(spark, sf):
    """Packets against the chain that was made of them before some events were changed."""
    chain = store.appended(spark, "chain", integrity.links(_packets(spark, sf), "user_id", "i", "digest"))
    return integrity.verified(chain, _packets(spark, sf, tampered=True), "user_id", "i", "digest").select("user_id", "i", "intact")


@query("int_forensic", "SELECT user_id, string_agg(i::varchar, ',' ORDER BY i) AS corrupted FROM (SELECT DISTINCT user_id, i FROM (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 16 AS i FROM events) WHERE event_id % 61 = 3) GROUP BY user_id")
def _(spark, sf):
    """The places of corrupted packets of each chain."""
    chain = store.appended(spark, "chain", integrity.links(_packets(spark, sf), "user_id", "i", "digest"))
    bad = integrity.verified(chain, _packets(spark, sf, tampered=True), "user_id", "i", "digest").where("not intact")
    return bad.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("i")), ",").alias("corrupted"))


# Secrets


def _key(spark) -> Column:
    """The key of the session, else one that is made for it; it is never part of a query's result."""
    import secrets

    found = spark.conf.get("tidepool.key", "") or secrets.token_hex(16)
    spark.conf.set("tidepool.key", found)
    return F.lit(found)


def _sealed(spark, sf) -> DataFrame:
    """Fields of a row: those with personal data are encrypted, the others are as they were."""
    personal = F.exists(F.array(*[F.lit(p) for p in text.PII.values()]), lambda p: F.regexp_like("text", p))
    c = table(spark, sf, "conversations").withColumn("sealed", personal)
    hidden = F.when(F.col("sealed"), F.aes_encrypt("text", _key(spark), F.lit("GCM"))).otherwise(F.col("text").cast("binary"))
    return store.appended(spark, "sealed", c.select("conv_id", "turn", "role", "sealed", hidden.alias("field")))


_PERSONAL = "(" + " OR ".join(f"regexp_matches(text, '{p}')" for p in text.PII.values()) + ")"


@query("cmp_encrypt", f"SELECT conv_id, turn, {_PERSONAL} AS sealed, NOT {_PERSONAL} AS readable FROM conversations")
def _(spark, sf):
    s = _sealed(spark, sf).join(table(spark, sf, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"])
    return s.select("conv_id", "turn", "sealed", (F.col("field") == F.col("text").cast("binary")).alias("readable"))


@query("cmp_decrypt", "SELECT conv_id, turn, md5(text) AS back FROM conversations")
def _(spark, sf):
    opened = F.when(F.col("sealed"), F.try_aes_decrypt("field", _key(spark), F.lit("GCM"))).otherwise(F.col("field"))
    return _sealed(spark, sf).select("conv_id", "turn", F.md5(opened).alias("back"))


# Session codecs

#: Lines of a task that packs sessions, and sessions of a batch that it returns.
SESSION_LINES, PER_BATCH = 32_768, 4_096


def sessions_packed(lines: DataFrame, by: str, window: int = 32) -> DataFrame:
    """(by, mode, size, intact): each session's lines in windows, with the state kept from window to window or each for itself; the smaller counts, and is read again. Sessions are sorted and read one after the other, many in a batch, as most are of a few lines."""

    def packed(key: int, lines: list) -> tuple:
        parts = [lines[i : i + window] for i in range(0, len(lines), window)]
        writer = codecs.Stream()
        kept = [writer.write(p) for p in parts]
        forms = {"kept": kept, "alone": kept[:1] + [codecs.Stream().write(p) for p in parts[1:]]}  # nothing is kept before the first
        mode, written = min(forms.items(), key=lambda x: (sum(map(len, x[1])), x[0]))
        reader = codecs.Stream()
        back = [line for p in written for line in (reader if mode == "kept" else codecs.Stream()).read(p)]
        return key, mode, sum(map(len, written)), len(lines), back == lines

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in (by, "template", "slots")), strict=True))
        done = (packed(key, [(t, s) for _, t, s in g]) for key, g in itertools.groupby(rows, lambda row: row[0]))
        while some := list(itertools.islice(done, PER_BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], [by, "mode", "size", "n", "intact"])

    sorted_ = dealt(lines.select(by, "line_no", "template", "slots"), by, rows=SESSION_LINES).sortWithinPartitions(by, "line_no", "template", "slots")
    return sorted_.mapInArrow(run, f"{by} long, mode string, size long, n long, intact boolean")


@query("str_auto_session", f"WITH {LINES_SQL} SELECT user_id * 100000 + line_no // 4096 AS session, count(*) AS n, true AS intact FROM lines GROUP BY ALL")
def _(spark, sf):
    """Sessions of a user within 4,096 lines, each in the better of two codecs."""
    lines = log_lines(spark, sf).withColumn("session", F.col("user_id") * 100_000 + F.floor(F.col("line_no") / 4096))
    return sessions_packed(lines, "session").select("session", "n", "intact")
