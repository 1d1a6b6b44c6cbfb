"""Traces, filters of packets, references, compaction, template thresholds."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidepool.functions import bloom
from tidepool.operators import events as ev
from tidepool.operators import ranking, text
from tidepool.plans.registry import query
from tidepool.plans.tables import log_lines, table


@query("ret_trace", "SELECT count(*) AS n, max(n_chars) AS longest FROM documents")
def _(spark, sf):
    """Counters of a running plan, as its metrics give them."""
    seen = Observation("trace")
    table(spark, sf, "documents").observe(seen, F.count("*").alias("n"), F.max("n_chars").alias("longest")).write.format("noop").mode("overwrite").save()
    return spark.range(1).select(F.lit(seen.get["n"]).alias("n"), F.lit(seen.get["longest"]).alias("longest"))


def _words(spark, sf):
    return log_lines(spark, sf).select(F.floor(F.col("line_no") / 256).alias("packet"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]{3,}"), F.lit(0))).alias("word"))


@query("ret_cold_index")
def _(spark, sf):
    return bloom.filters(_words(spark, sf), "packet", "word").where(bloom.may_contain("filter", ["click", "u12"])).select("packet")


@query("ret_fpr")
def _(spark, sf):
    """Share of strange words that a packet's filter lets pass."""
    f = bloom.filters(_words(spark, sf), "packet", "word")
    probes = F.array(*[bloom.may_contain("filter", [f"strange{i}"]).cast("int") for i in range(40)])
    return f.select("packet", (F.aggregate(probes, F.lit(0), lambda s, x: s + x) / 40.0).alias("rate"))


@query("ded_compact_prompt")
def _(spark, sf):
    """Lines that documents share become references; the table of references is a join away."""
    each = table(spark, sf, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("nth", "line"))
    n = each.groupBy("line").agg(F.count("*").alias("n")).where("n >= 3").select("line", F.concat(F.lit("«REF:"), F.substring(F.sha2("line", 256), 1, 8), F.lit("»")).alias("ref"))
    short = each.join(n, "line", "left").withColumn("kept", F.when(F.length("ref") < F.length("line"), F.col("ref")).otherwise(F.col("line")))
    return short.groupBy("doc_id").agg(F.sum(F.length("line")).alias("before"), F.sum(F.length("kept")).alias("after"))


@query("ded_expand", r"SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS digest FROM documents WHERE trim(text) <> ''")
def _(spark, sf):
    each = table(spark, sf, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("nth", "line"))
    each = each.withColumn("ref", F.sha2("line", 256))
    lines = each.select("ref", "line").distinct()
    back = each.select("doc_id", "nth", "ref").join(lines, "ref")
    return back.groupBy("doc_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x.line), "\n")).alias("digest"))


@query("ctx_compact")
def _(spark, sf):
    """Whole sentences of each turn up to a limit of characters; the first is cut if it alone is longer."""
    each = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(text.sentences(F.col("text"))).alias("nth", "s"))
    kept = ranking.within_budget(each, ["conv_id", "turn"], F.length("s") + 1, 240, F.asc("nth"))
    return kept.groupBy("conv_id", "turn").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "s"))), lambda x: x.s), " "), 1, 240).alias("text"))


@query("ext_template_tune")
def _(spark, sf):
    """Templates and their slots as mining with each threshold finds them; the least sum wins."""
    x, out = log_lines(spark, sf), None
    for threshold in (0.4, 0.6, 0.8, 1.0):
        one = ev.mined(x, "line_no", "text", threshold).agg(F.count("*").alias("templates"), F.sum(F.regexp_count("template", F.lit(r"<\*>"))).alias("slots")).withColumn("threshold", F.lit(threshold))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("score", F.col("templates") + 0.1 * F.col("slots"))
