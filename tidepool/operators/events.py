"""Event sequences: anomalies, motifs, run lengths, co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators import setsim, store
from tidepool.operators.components import connected_components


def anomalies(df: DataFrame, by: list[str], value: str, *order: Column, window: int = 50, least: int = 5, low: float = -2.0, high: float = 3.0) -> DataFrame:
    """z of each value against up to `window` values before it (population deviation, at least `least` of them), with an alert and a severity."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-window, -1)
    out = df.withColumn("n_before", F.count(value).over(w)).withColumn("mean", F.avg(value).over(w)).withColumn("dev", F.stddev_pop(value).over(w))
    dev = F.when(F.col("dev") == 0, 0.001).otherwise(F.col("dev"))
    z = F.when(F.col("n_before") >= least, (F.col(value) - F.col("mean")) / dev)
    out = out.withColumn("z", z)
    alert = F.when(F.col("z") < low, "low").when(F.col("z") > high, "high")
    size = F.abs("z")
    severity = F.when(F.col("alert").isNull(), None).when(size > 5, "high").when(size > 3.5, "medium").otherwise("low")
    return out.withColumn("alert", alert).withColumn("severity", severity).drop("mean", "dev", "n_before")


def motifs(df: DataFrame, by: list[str], event: str, *order: Column, sizes: range = range(3, 11), least: int = 2) -> DataFrame:
    """Patterns of neighbouring events, overlaps counted: pattern, n_events, occurrences, weight (occurrences x length)."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df
    most = max(sizes)
    for i in range(1, most):
        out = out.withColumn(f"e{i}", F.lead(event, i).over(w))
    pattern = lambda n: F.when(F.col(f"e{n - 1}").isNotNull(), F.struct(F.lit(n).alias("n_events"), F.concat_ws(">", event, *[f"e{i}" for i in range(1, n)]).alias("pattern")))
    each = out.select(F.explode(F.array_compact(F.array(*[pattern(n) for n in sizes]))).alias("m")).select("m.*")
    found = each.groupBy("pattern", "n_events").agg(F.count("*").alias("occurrences")).where(F.col("occurrences") >= least)
    return found.withColumn("weight", F.col("occurrences") * F.col("n_events"))


def runs(df: DataFrame, by: list[str], value: str, *order: Column) -> DataFrame:
    """Run lengths: value, run (its number) and n of each stretch of equal values."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = df.withColumn("starts", (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    return new.withColumn("run", F.sum("starts").over(w)).groupBy(*by, "run", value).agg(F.count("*").alias("n"))


def deltas(df: DataFrame, by: list[str], value: str, *order: Column) -> DataFrame:
    """Difference to the value before; the first value as it is."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def drift(df: DataFrame, by: list[str], value: str, *order: Column, share: float = 0.1) -> DataFrame:
    """Mean, population deviation, and the change of the mean from the first half to the second."""
    w = Window.partitionBy(*by)
    half = df.withColumn("nth", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count("*").over(w)).withColumn("late", F.col("nth") * 2 > F.col("n"))
    mean = lambda late: F.avg(F.when(F.col("late") == late, F.col(value)))
    out = half.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("dev"), (mean(True) - mean(False)).alias("trend"))
    return out.withColumn("drifting", F.abs("trend") > share * F.abs("mean"))


def cooccurrence(df: DataFrame, batch: str, item: str) -> DataFrame:
    """Ordered pairs (a, b) of different items in a batch, with the number of batches."""
    one = df.select(batch, item).distinct()
    pairs = one.alias("a").join(one.alias("b"), (F.col(f"a.{batch}") == F.col(f"b.{batch}")) & (F.col(f"a.{item}") != F.col(f"b.{item}")))
    return pairs.groupBy(F.col(f"a.{item}").alias("a"), F.col(f"b.{item}").alias("b")).agg(F.count("*").alias("n"))


#: Share of equal tokens from which two lines are of one template, and what a wildcard is written as.
ALIKE, WILDCARD = 0.4, "<*>"


def mined(lines: DataFrame, id_col: str, text: str, threshold: float = ALIKE) -> DataFrame:
    """(cluster, n, head, template, n_lines): templates of lines. Lines of as many tokens belong together that have the share `threshold` of their tokens in common, place by place and with digits left out, and so do those that others connect; tokens that vary become wildcards.

    Lines that differ in digits only are one shape; shapes, of which there are far fewer, meet by a set-similarity join on
    (place, token): of n tokens each, c equal ones make a Jaccard similarity of c / (2n - c). No order of the lines plays a part. A
    cluster has the least id of its lines as its name. Null texts are left out.
    """
    rows = lines.where(F.col(text).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.split(text, " ").alias("w")).withColumn("shape", F.array_join(F.transform("w", lambda t: F.regexp_replace(t, "[0-9]+", "0")), " "))
    shapes = store.kept(rows.groupBy("shape").agg(F.min("id").alias("id"), F.count("*").alias("n_lines")), "shapes")
    tokens = F.split("shape", " ")
    placed = F.transform(tokens, lambda t, i: F.concat_ws(":", F.size(tokens).cast("string"), i.cast("string"), t))
    roots = connected_components(setsim.similar(shapes, "id", placed, threshold / (2 - threshold)).stars()).select(F.col("v").alias("id"), "root")
    known = shapes.join(roots, "id", "left").select("shape", F.coalesce("root", "id").alias("cluster"), "n_lines")
    places = rows.select("shape", F.posexplode("w").alias("i", "t")).groupBy("shape", "i").agg(F.min("t").alias("low"), F.max("t").alias("high"))  # before they meet their cluster
    each = places.join(known.select("shape", "cluster"), "shape").groupBy("cluster", "i").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    token = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(WILDCARD)
    whole = each.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", token.alias("t"), "low"))), lambda x: x.t).alias("w"), F.min_by("low", "i").alias("first"))
    sizes = known.groupBy("cluster").agg(F.sum("n_lines").alias("n_lines"))
    return whole.join(sizes, "cluster").select("cluster", F.size("w").cast("long").alias("n"), F.col("w")[0].alias("head"), F.array_join("w", " ").alias("template"), "n_lines")


def pattern_of(template: Column | str) -> Column:
    """A template as a regular expression: wildcards are groups, all else stands for itself."""
    plain = F.regexp_replace(template, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(plain, F.lit(r"<\*>"), F.lit(r"(\S+)")), F.lit("$"))


def parameters(text: Column | str, template: Column | str) -> Column:
    """What stands in the places of a template's wildcards; empty texts where the text is not of the template."""
    n = F.regexp_count(F.col(template) if isinstance(template, str) else template, F.lit(r"<\*>"))
    one = lambda t, p, i: F.call_function("regexp_extract", t, p, i)
    text = F.col(text) if isinstance(text, str) else text
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: one(text, pattern_of(template), i))).otherwise(F.array().cast("array<string>"))
