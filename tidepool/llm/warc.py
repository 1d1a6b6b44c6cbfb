"""A content-addressed WARC archive.

write() makes a record of every page: the first page of equal payloads of at least SMALLEST bytes
is a response, the others are revisits of it, and smaller payloads are all responses. Two tables
hold them: `content` has each payload once under its SHA-256, `headers` has the exact header bytes
of each record beside the digest of its payload. records() joins header and payload into the original record,
byte by byte. read() rebuilds every record that way and parses it: its fields, the block that its Content-Length
measures, and in that the payload, whose digest and size are computed anew; a revisit has no payload of its own and is held against
the digest and size of the one stored. export() writes the records as WARC files, one a partition; parse() reads such files.

Digests and sizes are computed where the payload is read; the search for first pages moves ids and
digests only, and its minima are aggregated before they are shuffled. A row is known by a hash of its
id and digest, so that both readings agree whatever the input is. Payloads move once to the rows that are stored, by row and
therefore evenly, and once more to be rebuilt. Aggregates are written before they are joined, so that adaptive execution can split a digest
that very many rows share. All tables are in the shared folder, so a lost executor
costs the rerun of a task. All work on records is done by Spark's own functions, a row at a time, so that very long payloads need
the memory of one row.

Null html counts as empty. Null urls are written as empty, line breaks in urls are escaped. Of
repeated ids with equal payloads each is a response where it is the smallest; payloads whose ids
are all null are responses. An empty table gives an empty archive; other columns are left out.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import fresh_path, materialise, pick

SMALLEST = 100
DATE = "1970-01-01T00:00:00Z"
CONTENT, HEADERS = "digest string, payload binary", "row long, digest string, header binary"
END = "\r\n\r\n"


@dataclass
class Archive:
    content: DataFrame
    headers: DataFrame


def _header(url: Column) -> Column:
    """The bytes before the payload: the WARC header and the HTTP header of a response or revisit."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    block = F.length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    name = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", name(F.col("page_id"))), line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "\r", "%0D"), "\n", "%0A")), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", name(F.col("refers_to"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", block.cast("string")), F.lit("\r\n"), http,
    ).cast("binary")


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> Archive:
    """Writes both tables below the folder (a new one in the shared folder, if none is given) and opens them."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    rows = pick(pages, page_id=(id_col, "long"), url=(url_col, "string"), html=(html_col, "string"))
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = rows.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("row", F.xxhash64("page_id", "digest"))
    marks = rows.select("row", "page_id", "url", F.length("payload").cast("long").alias("payload_bytes"), "digest")
    path = f"{folder}/marks"
    marks.write.parquet(path)
    marks = spark.read.schema(marks.schema).parquet(path)
    first = materialise(marks.groupBy("digest").agg(F.min("page_id").alias("first"), F.min("row").alias("stored")), "warc-first")
    large = F.col("payload_bytes") >= SMALLEST
    refers = F.when(large & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    records = marks.join(first, "digest").withColumn("refers_to", refers)
    records.select("row", "digest", _header(F.col("url")).alias("header")).write.option("compression", "zstd").parquet(f"{folder}/headers")
    kept = first.select(F.col("stored").alias("row"), "digest")
    stored = rows.select("row", "digest", "payload").join(kept, ["row", "digest"]).groupBy("row", "digest").agg(F.first("payload").alias("payload"))  # repeated rows have the same payload
    stored.select("digest", "payload").write.option("compression", "zstd").parquet(f"{folder}/content")
    return open_archive(spark, folder)


def open_archive(spark: SparkSession, folder: str) -> Archive:
    return Archive(spark.read.schema(CONTENT).parquet(f"{folder}/content"), spark.read.schema(HEADERS).parquet(f"{folder}/headers"))


def _block(payload: Column, revisit: Column) -> Column:
    return F.when(revisit, F.lit(b"")).otherwise(payload)


def records(archive: Archive) -> DataFrame:
    """record (the original bytes, without the empty lines that end it), and payload and stored_digest of what it holds or refers to. A stored payload that does not have its digest stops the read."""
    true = F.sha2("payload", 256)
    checked = F.when(true == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not have the digest "), F.col("digest"))))
    stored = archive.content.select("digest", checked.alias("payload"))
    revisit = F.col("header").cast("string").startswith("WARC/1.1\r\nWARC-Type: revisit\r\n")
    both = archive.headers.select("digest", "header", revisit.alias("revisit")).join(stored, "digest")
    return both.select(F.concat("header", _block(F.col("payload"), F.col("revisit"))).alias("record"), "payload", F.col("digest").alias("stored_digest"))


def _after_head(data: Column, size: Column) -> Column:
    """So many bytes after the first empty line."""
    return F.substring(data, F.octet_length(F.substring_index(data.cast("string"), END, 1)) + 5, size)


def _fields(record: Column) -> Column:
    """The header fields of a record as a map."""
    lines = F.filter(F.split(F.substring_index(record.cast("string"), END, 1), "\r\n"), lambda line: F.contains(line, F.lit(": ")))
    return F.map_from_entries(F.transform(lines, lambda line: F.struct(F.substring_index(line, ": ", 1), F.substring(line, F.locate(": ", line) + 2, F.length(line)))))


def read(archive: Archive) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type and refers_to of every record, from the record itself; a record whose payload is not what its header says stops the read."""
    rows = records(archive).select(F.length("payload").cast("long").alias("stored_bytes"), "stored_digest", "record", _fields(F.col("record")).alias("f"))
    rows = rows.withColumn("block", _after_head(F.col("record"), F.col("f")["Content-Length"].cast("int")))
    rows = rows.withColumn("payload", _after_head(F.col("block"), F.length("block")))
    page = lambda name: F.regexp_extract(F.col("f")[name], "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    kind, said = F.col("f")["WARC-Type"], F.regexp_extract(F.col("f")["WARC-Payload-Digest"], "^sha256:([0-9a-f]+)$", 1)
    own = F.when(kind == "revisit", F.col("stored_digest")).otherwise(F.sha2("payload", 256))
    size = F.when(kind == "revisit", F.col("stored_bytes")).otherwise(F.length("payload").cast("long"))
    true = F.when(own == said, own).otherwise(F.raise_error(F.concat(F.lit("record does not have the digest "), said)))
    return rows.select(page("WARC-Record-ID").alias("page_id"), F.col("f")["WARC-Target-URI"].alias("url"), size.alias("payload_bytes"), true.alias("payload_digest"), kind.alias("record_type"), page("WARC-Refers-To").alias("refers_to"))


def export(archive: Archive, folder: str, compression: str = "none") -> None:
    """The records as WARC files below the folder, one a partition ("gzip": each a gzip stream)."""
    records(archive).select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).option("compression", compression).text(folder)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a WARC file, plain or gzip by record."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        at = start + int(fields["Content-Length"])
        yield fields, data[start:at]
        at += 4


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, ''))::bigint AS n FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM p JOIN f USING (d)
"""
