"""Transcripts, chat lines, span lines, JSON lines and template tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Shortest text of a turn, longest tool result, longest text of the fallback. Fixed values.
LEAST, TOOL_RESULT, FALLBACK = 20, 2000, 5000
ARGUMENT = 200


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, entry): lines that are JSON objects. Line numbers are the order within a file."""
    raw = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line_no"), F.trim("value").alias("line"))
    return raw.where(F.startswith("line", F.lit("{"))).withColumn("entry", F.try_parse_json("line")).where(F.col("entry").isNotNull())


def _text(content: Column) -> Column:
    """Text of a message's content: a string, or the text blocks of a list and its tool results of a bearable size."""
    plain = F.try_variant_get(content, "$", "string")
    blocks = F.try_variant_get(content, "$", "array<variant>")
    kind = lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string"), F.lit("text"))
    inner = lambda b: F.try_variant_get(b, "$.content", "string")
    said = lambda b: F.when(kind(b) == "text", F.coalesce(F.try_variant_get(b, "$.text", "string"), F.try_variant_get(b, "$", "string"))).when((kind(b) == "tool_result") & (F.length(inner(b)) <= TOOL_RESULT), inner(b))
    return F.trim(F.when(blocks.isNotNull(), F.array_join(F.array_compact(F.transform(blocks, said)), "\n")).otherwise(plain))


def _tool_calls(content: Column) -> Column:
    """A line for the tool and one for each argument, cut to ARGUMENT characters; arguments in the order of their names."""
    blocks = F.try_variant_get(content, "$", "array<variant>")
    calls = F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string").isin("tool_use", "toolCall"))
    given = lambda b: F.coalesce(F.try_variant_get(b, "$.input", "map<string,string>"), F.try_variant_get(F.try_parse_json(F.try_variant_get(b, "$.arguments", "string")), "$", "map<string,string>"), F.try_variant_get(b, "$.arguments", "map<string,string>"))
    pairs = lambda b: F.transform(F.array_sort(F.map_entries(given(b))), lambda e: F.concat(F.lit("\n  "), e.key, F.lit(": "), F.substring(e.value, 1, ARGUMENT)))
    one = lambda b: F.concat(F.lit("Tool: "), F.coalesce(F.try_variant_get(b, "$.name", "string"), F.lit("unknown")), F.coalesce(F.array_join(pairs(b), ""), F.lit("")))
    return F.coalesce(F.transform(calls, one), F.array().cast("array<string>"))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(file, session_id, index, role, content) of the turns of transcript files. The first JSON line of a file tells its kind: a session or a message with a role (nested messages), a user or assistant entry (entries by type), else any objects with a text."""
    e = json_lines(spark, path)
    get = lambda p, kind="string": F.try_variant_get("entry", p, kind)
    e = e.withColumn("type", get("$.type")).withColumn("said_by", get("$.message.role"))
    first = F.min_by(F.struct("type", "said_by"), "line_no").over(Window.partitionBy("file"))
    e = e.withColumn("first", first)
    nested = (F.col("first.type") == "session") | ((F.col("first.type") == "message") & F.col("first.said_by").isNotNull())
    kind = F.when(nested, "nested").when(F.col("first.type").isin("user", "assistant", "file-history-snapshot"), "entries").otherwise("generic")
    e = e.withColumn("kind", kind).withColumn("session_id", F.coalesce(F.max(F.when(F.col("type") == "session", F.coalesce(get("$.session_id"), get("$.id")))).over(Window.partitionBy("file")), F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1)))
    role = F.when((F.col("kind") == "nested") & (F.col("type") == "message"), F.col("said_by")).when((F.col("kind") == "entries") & F.col("type").isin("user", "assistant"), F.col("type")).when(F.col("kind") == "generic", "unknown")
    role = F.when(role == "toolResult", "tool_result").otherwise(role)
    content = get("$.message.content", "variant")
    deep = F.coalesce(get("$.content"), get("$.text"), get("$.summary"), get("$.message.content"), get("$.message"))
    e = e.withColumn("role", role).where(F.col("role").isin("user", "assistant", "tool_result", "unknown"))
    e = e.withColumn("text", F.when(F.col("kind") == "generic", F.substring(deep, 1, FALLBACK)).otherwise(_text(content)))
    turn = F.when((F.length("text") >= LEAST) & ((F.col("role") != "tool_result") | (F.length("text") <= TOOL_RESULT)), F.struct(F.lit(-1).alias("nth"), F.col("role").alias("role"), F.col("text").alias("content")))
    calls = F.transform(F.when(F.col("role") == "assistant", _tool_calls(content)).otherwise(F.array().cast("array<string>")), lambda c, i: F.struct(i.alias("nth"), F.lit("tool_call").alias("role"), c.alias("content")))
    rows = e.select("file", "session_id", "line_no", F.inline(F.array_compact(F.concat(F.array(turn), calls))))
    order = Window.partitionBy("file").orderBy("line_no", "nth")
    return rows.withColumn("index", F.row_number().over(order) - 1).select("file", "session_id", "index", "role", "content")


def corpus(memories: DataFrame) -> DataFrame:
    """(doc_id, text) of rows with doc_id and a list of memories, each once: the first of equal ones."""
    each = memories.select("doc_id", F.size("memories").alias("n"), F.posexplode("memories").alias("nth", "text"))
    each = each.withColumn("doc_id", F.when(F.col("n") > 1, F.concat_ws("#", "doc_id", "nth")).otherwise(F.col("doc_id")))
    return each.groupBy("doc_id", "text").agg(F.count("*").alias("n_seen"))


def span_line(name: Column, trace: Column, span: Column, status: Column, attributes: Column) -> Column:
    pairs = F.array_join(F.transform(F.map_entries(attributes), lambda e: F.concat(e.key, F.lit("="), e.value)), " ")
    return F.concat_ws(" ", F.lit("SPAN"), name, F.concat(F.lit("trace="), trace), F.concat(F.lit("span="), span), F.concat(F.lit("status="), status), pairs)


def parse_span(line: Column) -> Column:
    """struct(name, fields): the key=value parts of a span line as a map."""
    return F.struct(F.regexp_extract(line, r"^SPAN (\S+)", 1).alias("name"), F.str_to_map(F.regexp_replace(line, r"^SPAN \S+ ?", ""), F.lit(" "), F.lit("=")).alias("fields"))


def template_bank(spark: SparkSession, path: str) -> DataFrame:
    """EventId, EventTemplate and a pattern, most specific first: fewer wildcards, then the longer literal text."""
    t = spark.read.csv(path, header=True).select("EventId", "EventTemplate")
    parts = F.split("EventTemplate", r"<\*>")
    quoted = F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, r"([\\.\[\]{}()*+?^$|])", r"\\$1")), "(.*?)")
    out = t.withColumn("pattern", F.concat(F.lit("^"), quoted, F.lit("$"))).withColumn("wildcards", F.size(parts) - 1).withColumn("literal", F.length(F.array_join(parts, "")))
    return out.withColumn("specificity", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("wildcards", F.desc("literal"), "EventId")))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size) of files, by content."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def watched(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the lines of new files in a folder; its checkpoint remembers which were read."""
    return spark.readStream.text(folder).select(F.input_file_name().alias("file"), F.col("value").alias("line"))
