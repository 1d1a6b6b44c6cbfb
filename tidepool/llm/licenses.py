"""License texts and phrases in documents by diagonal voting.

Every k-gram of words of a text is looked up among the k-grams of a template bank; a hit at word p
of the text and word q of a template votes for the diagonal p - q. Votes are counted by diagonal,
neighbouring diagonals of a template (words added or left out) are merged, and merged spans are
verified: a span that is longer than its template and BAND words (copies side by side) falls apart
into its diagonals, and of a span's votes only those count that are in the template's order. A span
counts if these hold the required share of the template's k-grams. Hits are confirmed word by word,
so a span with every k-gram on one diagonal is the template itself, word by word.

Short phrases have k = 2, must be whole and are never merged; longer templates have k = 4, need
SHARE of their k-grams and merge diagonals up to BAND apart. The bank is a parameter of bounded
size (BANK k-grams at most); it is a literal set in the filter and broadcast in the join.

Only JVM expressions run: one narrow pass with the positions exploded inside generated code; only
hits and one row a document are shuffled, once, by row.

Null text counts as empty and has no words; null ids are kept; repeated rows are each judged; an
empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.llm.common import pick

#: Phrases whose places are counted. Fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Longer templates: openings of widely used public licence notices, and licence lines.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by 4 0": "cc-by",
    "this work is licensed under a creative commons attribution": "cc-by",
    "mozilla public license version 2 0": "mpl",
    "all rights reserved no part of this publication may be reproduced": "reserved",
}
SHORT, LONG, SHARE, BAND = 2, 4, 0.8, 8
BANK = 100_000
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of ASCII letters, digits and all other characters beyond ASCII; only A-Z are lower-cased."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.array_remove(F.split(F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER)), SEPARATOR), "")


def _hash(k: int) -> Column:
    return F.xxhash64(*[F.get("words", F.col("at") + i) for i in range(k)])


def bank(spark: SparkSession, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """A row per k-gram of a template: template, label, base, k, n_grams, q (its place), h, gram."""
    rows = [(t, label, base, k) for base, k, source in ((True, SHORT, phrases), (False, LONG, templates)) for t, label in source.items()]
    literal = F.array(*[F.struct(F.lit(t).alias("template"), F.lit(label).alias("label"), F.lit(base).alias("base"), F.lit(k).alias("k")) for t, label, base, k in rows])
    all_words = spark.range(1).select(F.inline(literal)).withColumn("words", words(F.col("template")))
    each = all_words.select("*", F.posexplode("words").alias("at", "first")).where(F.col("at") <= F.size("words") - F.col("k"))
    h = F.when(F.col("k") == SHORT, _hash(SHORT)).otherwise(_hash(LONG))
    return each.select("template", "label", "base", "k", (F.size("words") - F.col("k") + 1).alias("n_grams"), F.col("at").alias("q"), h.alias("h"), F.slice("words", F.col("at") + 1, F.col("k")).alias("gram"))


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and spans: array of (start, end, template, label, base, coverage), in words, of every row."""
    spark = docs.sparkSession
    grams = bank(spark, PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    known = [(r.k, r.h) for r in grams.select("k", "h").distinct().collect()]  # the parameter's own k-grams
    if len(known) > BANK:
        raise ValueError(f"the template bank has more than {BANK} k-grams")
    hashes = {k: [h for x, h in known if x == k] or [0] for k in (SHORT, LONG)}
    rows = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string")).fillna("", ["text"])
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("words"))
    each = rows.select("doc_id", "row", "words", F.posexplode_outer("words").alias("at", "first"))
    hit = _hash(SHORT).isin(hashes[SHORT]) | _hash(LONG).isin(hashes[LONG])
    some = each.where(F.col("at").isNull() | (F.col("at") == 0) | hit)  # a document's first word always stays
    keys = F.array(*[F.struct(F.lit(k).alias("k"), _hash(k).alias("h")) for k in (SHORT, LONG)])
    some = some.select("doc_id", "row", F.size("words").alias("n_words"), "at", F.slice("words", F.coalesce("at", F.lit(0)) + 1, LONG).alias("here"), F.inline(keys))
    found = some.join(F.broadcast(grams), ["k", "h"], "left").withColumn("ok", F.slice("here", 1, F.size("gram")) == F.col("gram"))
    votes = found.select("doc_id", "row", "n_words", *[F.when(F.col("ok"), F.col(c)).alias(c) for c in ("template", "label", "base", "k", "n_grams", "q", "at")])
    votes = votes.repartition("row").withColumn("diagonal", F.col("at") - F.col("q"))
    along = Window.partitionBy("row", "template").orderBy("diagonal", "q")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > F.when(F.col("base"), 0).otherwise(BAND), F.lit(True))
    run = Window.partitionBy("row", "template", "group")
    grouped = votes.withColumn("apart", apart.cast("int")).withColumn("group", F.sum("apart").over(along))
    fits = F.max("at").over(run) - F.min("at").over(run) + F.col("k") <= F.col("n_grams") + F.col("k") - 1 + BAND
    grouped = grouped.withColumn("fits", fits).withColumn("part", F.when(~F.col("fits"), F.col("diagonal")))
    before = Window.partitionBy("row", "template", "group", "part").orderBy("at", "q").rowsBetween(Window.unboundedPreceding, -1)
    ordered = grouped.withColumn("counts", F.coalesce(F.col("q") > F.max("q").over(before), F.col("q").isNotNull()))
    counted = F.when(F.col("counts"), F.col("at"))
    spans = ordered.groupBy("doc_id", "row", "n_words", "template", "label", "base", "k", "n_grams", "group", "part").agg(F.count(counted).alias("votes"), F.min(counted).alias("start"), (F.max(counted) + F.first("k")).alias("end"))
    coverage = F.col("votes") / F.col("n_grams")
    full = coverage >= F.when(F.col("base"), 1.0).otherwise(SHARE)
    span = F.when(full, F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "template", "label", "base", coverage.alias("coverage")))
    return spans.groupBy("doc_id", "row").agg(F.max("n_words").cast("long").alias("n_words"), F.sort_array(F.collect_list(span)).alias("spans")).select("doc_id", "n_words", "spans")


def _oracle() -> str:
    listed = lambda x, k, base: [f"('{t}', '{label}', {base}, {k})" for t, label in x.items()]
    bank_rows = ", ".join(listed(PHRASES, SHORT, "true") + listed(TEMPLATES, LONG, "false"))
    return rf"""
WITH bank AS (SELECT *, string_split(template, ' ') AS tw FROM (VALUES {bank_rows}) AS v(template, label, base, k)),
grams AS (SELECT *, len(tw) - k + 1 AS n_grams, tw[q + 1:q + k] AS gram FROM (SELECT *, unnest(range(0, len(tw) - k + 1)) AS q FROM bank)),
docs AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (SELECT doc_id, r, w, unnest(range(0, len(w))) AS p FROM docs),
hits AS (SELECT r, p, template, label, base, g.k, n_grams, q, p - q AS diagonal FROM (SELECT r, p, w[p + 1:p + 2] AS g2, w[p + 1:p + 4] AS g4 FROM places) a
  JOIN grams g ON (g.k = 2 AND g.gram = a.g2) OR (g.k = 4 AND g.gram = a.g4)),
cut AS (SELECT *, CASE WHEN coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal, q) > CASE WHEN base THEN 0 ELSE {BAND} END, true) THEN 1 ELSE 0 END AS apart FROM hits),
grouped AS (SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal, q) AS grp FROM cut),
parted AS (SELECT *, CASE WHEN max(p) OVER w - min(p) OVER w + k > n_grams + k - 1 + {BAND} THEN diagonal END AS part FROM grouped WINDOW w AS (PARTITION BY r, template, grp)),
ordered AS (SELECT *, coalesce(q > max(q) OVER (PARTITION BY r, template, grp, part ORDER BY p, q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS counts FROM parted),
spans AS (SELECT r, label, base, min(p) FILTER (counts) AS s, count(*) FILTER (counts) / n_grams AS coverage FROM ordered GROUP BY r, template, label, base, k, n_grams, grp, part),
good AS (SELECT * FROM spans WHERE coverage >= CASE WHEN base THEN 1.0 ELSE {SHARE} END),
per AS (SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
  list_sort(list_distinct(list(label) FILTER (base))) AS bl, list_sort(list_distinct(list(label))) AS al, max(coverage) AS score FROM good GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(bl, ','), '') AS base_labels, coalesce(array_to_string(al, ','), '') AS labels, coalesce(score, 0.0)::double AS score
FROM docs LEFT JOIN per USING (r)
"""


ORACLE = _oracle()
