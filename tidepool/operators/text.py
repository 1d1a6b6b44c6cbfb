"""Text operators in JVM expressions: sentences, normal forms, personal data, templates, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of personal data. Fixed values.
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "card": r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}",
    "phone": r"\+?[0-9]{1,2}?[ .-]?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
    "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
}
#: Number words. Fixed values.
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty")
FOLD = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def let(f, *values: Column) -> Column:
    """f of the values, each evaluated once a row. A Column used in many places would be written out in all of them, and a long chain of such uses grows beyond what the optimiser and generated code can hold."""
    bound = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.get(F.transform(F.array(bound), lambda x: f(*[x[f"v{i}"] for i in range(len(values))])), F.lit(0))


def lines(text: Column) -> Column:
    """Stripped non-empty lines."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Lines, split after . ! ? before blanks."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])[ \t]+", "$1\n")
    return lines(marked)


def normalised(text: Column) -> Column:
    """Lower case without accents, punctuation and articles; number words as digits."""
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), *FOLD)
    words = F.split(F.trim(F.regexp_replace(folded, r"[^a-z0-9]+", " ")), " +")
    digits = F.create_map(*[F.lit(x) for i, w in enumerate(NUMBER_WORDS) for x in (w, str(i))])
    kept = F.filter(words, lambda w: ~w.isin("a", "an", "the", ""))
    return F.array_join(F.transform(kept, lambda w: F.when(w.isin(*NUMBER_WORDS), F.try_element_at(digits, w)).otherwise(w)), " ")


def metric_normal(text: Column) -> Column:
    """The normal form of answer metrics: that, and once, twice, thrice as digits."""
    words = F.split(normalised(text), " ")
    return F.array_join(F.transform(words, lambda w: F.when(w == "once", "1").when(w == "twice", "2").when(w == "thrice", "3").otherwise(w)), " ")


def token_f1(pred: Column, gold: Column) -> Column:
    """F1 of two word lists as multisets."""
    count = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    def score(p: Column, g: Column) -> Column:
        return 2.0 * F.aggregate(F.array_distinct(p), F.lit(0), lambda s, w: s + F.least(count(p, w), count(g, w))) / (F.size(p) + F.size(g))

    return let(score, pred, gold)


def pii(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, kind, n): matches of each kind."""
    counts = F.array(*[F.struct(F.lit(kind).alias("kind"), F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))).cast("long").alias("n")) for kind, p in PII.items()])
    return df.select(id_col, F.inline(counts)).where("n > 0")


def redacted(text: Column, replacement: str = "[{}]") -> Column:
    """Kinds in their order; a match of an earlier kind is not matched again."""
    for kind, p in PII.items():
        text = F.regexp_replace(text, p, replacement.format(kind.upper()))
    return text


def canonical(text: Column) -> Column:
    """Times, identifiers, hexadecimal and other numbers as placeholders, blanks squeezed."""
    steps = (
        (r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?", "<TS>"),
        (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<UUID>"),
        (r"0x[0-9a-fA-F]+", "<HEX>"),
        (r"[0-9]+", "<INT>"),
        (r"[ \t]+", " "),
    )
    for p, to in steps:
        text = F.regexp_replace(text, p, to)
    return F.trim(text)


def number_template(text: Column) -> tuple[Column, Column]:
    """The text with {} for each number, and the numbers."""
    return F.regexp_replace(text, "[0-9]+", "{}"), F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))


def token_estimate(text: Column) -> Column:
    """The larger of a quarter of the non-blank characters and the number of lexical tokens."""
    dense = F.length(F.regexp_replace(text, r"[ \n\t\r]", ""))
    return F.greatest(F.ceil(dense / 4.0), F.size(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0))).cast("long"))


def line_scores(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, line_no, score): mean number of the document's lines that a line's words occur in. Lines are dealt by document once, as words; all that follows stays where it is, and no text moves."""
    words = F.transform(lines(F.col(text)), lambda x: F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)))
    each = df.select(id_col, F.posexplode(words).alias("line_no", "words")).repartition(id_col)
    each = each.select(id_col, "line_no", F.explode_outer("words").alias("word")).groupBy(id_col, "word", "line_no").agg(F.count("word").alias("tf"))  # a line without words has one row, of no word
    known = each.withColumn("df", F.count("*").over(Window.partitionBy(id_col, "word")))
    return known.groupBy(id_col, "line_no").agg(F.coalesce(F.try_divide(F.sum(F.col("tf") * F.col("df")), F.sum("tf")), F.lit(0.0)).alias("score"))


def summary(df: DataFrame, id_col: str, text: str, ratio: float = 0.3, least: int = 1, most: int = 50) -> DataFrame:
    """The best lines of each document, up to a share of them, in their own order."""
    scored = line_scores(df, id_col, text)
    w = Window.partitionBy(id_col)
    n = F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(F.count("*").over(w) * ratio)))
    ranked = scored.withColumn("n", n).withColumn("nth", F.row_number().over(w.orderBy(F.desc(F.round("score", 9)), F.asc("line_no"))))
    return ranked.where("nth <= n").select(id_col, "line_no", F.round("score", 9).alias("score"))


def repetitiveness(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Share of the most frequent line of each document."""
    each = df.select(id_col, F.explode(lines(F.col(text))).alias("line")).groupBy(id_col, "line").agg(F.count("*").alias("n"))
    return each.groupBy(id_col).agg((F.max("n") / F.sum("n")).alias("share"), F.sum("n").alias("n_lines"))


def cql_like(field: Column, pattern: str) -> Column:
    """LIKE without regard to case; % and _ do not cross line ends."""
    import re

    body = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern)
    return field.rlike(f"(?i)^{body}$")
