"""Facts, entities, relations, dates and tables out of free text, as Column expressions and windows.

A text is cut into sentences; each pattern is searched once in a sentence. Facts carry the number of
their sentence and of their pattern, so that "the first of equal facts" and "the first ten of a text"
are windows over narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators import text

# What a sentence has to say, and what it then states.

MONTH = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
DATES = (rf"\b{MONTH}\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,\s*\d{{4}})?\b", r"\b\d{1,2}/\d{1,2}(?:/\d{2,4})?\b", r"\b\d{4}-\d{2}-\d{2}\b", r"\b(?:19|20)\d{2}\b")
#: Kind of a preference by what is named with it, in this order.
PREFERENCES = (
    ("coffee_order", ("espresso", "flat white", "cappuccino", "latte", "americano", "cold brew", "oat milk", "whole milk", "coffee")),
    ("notebook", ("field notes", "moleskine", "leuchtturm", "midori", "muji", "baron fig", "notebook", "journal")),
    ("bag", ("bag", "pack", "backpack", "briefcase", "evergoods", "peak design", "synik", "carry")),
    ("charger", ("charger", "power bank", "battery", "anker", "usb-c")),
    ("flight_seat", ("seat", "aisle", "window", "middle", "plane", "flight", "boarding")),
    ("movie_snack", ("movie", "theater", "theatre", "film", "concession", "kettle corn", "popcorn", "pretzel bites", "snack")),
)
_SPAN, _LAZY, _LIST = r"([^.,;\n]{3,80})", r"([^.,;\n]{3,80}?)", r"([^,;\n]{2,80})"
_NAME = r"([A-Z][\w\-]+(?:\s+[A-Z][\w\-]+){0,2})"
_PLACE = r"([A-Z][\w\-]+(?:\s+[A-Z][\w\-]+){0,3})"
_VALUE = r"([^.,;\n]{2,80})"
#: (pattern, stated): stated are (entity: a group or a name, relation or None for a preference to be told by its words, value's group, confidence).
STATEMENTS = (
    (rf"\bmy(?:\s+default)?\s+(?:espresso\s+)?(?:drink|coffee|order)\s+(?:now\s+)?(?:is|was)\s+{_SPAN}", (("User", "coffee_order", 1, 0.92),)),
    (rf"\bmy\s+espresso\s+default\s+(?:now\s+)?(?:is|was)\s+{_SPAN}", (("User", "coffee_order", 1, 0.92),)),
    (rf"\btravel days still mean\s+{_SPAN}", (("User", "coffee_order", 1, 0.84),)),
    (rf"\b{_SPAN}\s+is still the coffee order\b", (("User", "coffee_order", 1, 0.88),)),
    (rf"\bi was carrying\s+{_LAZY}(?:\s+most workdays|\s+daily|\s+every day)?(?:[.,;\n]|$)", (("User", "bag", 1, 0.9),)),
    (rf"\b{_LAZY}\s+is the bag i grab(?: on autopilot every morning)?\b", (("User", "bag", 1, 0.94),)),
    (rf"\b{_LAZY}\s+remains the default bag\b", (("User", "bag", 1, 0.9),)),
    (rf"\b{_LAZY}\s+is the current bag\b", (("User", "bag", 1, 0.9),)),
    (rf"\bmy notebook(?: at the start of the year)?\s+was\s+{_SPAN}", (("User", "notebook?", 1, 0.9),)),
    (r"\b(Field Notes(?:\s+[A-Za-z0-9&\-]+){0,2})\s+keep ending up in the airport kit\b", (("User", "notebook?", 1, 0.72),)),
    (rf"\bthe charger that keeps ending up in my airport pouch is the\s+{_VALUE}", (("User", "charger", 1, 0.92),)),
    (rf"\bi pack the\s+{_VALUE}\s+charger\b", (("User", "charger", 1, 0.9),)),
    (r"\bon planes i nearly always claim the\s+([^.,;\n]{2,40})", (("User", "flight_seat", 1, 0.9),)),
    (r"\bi keep reaching for the\s+([^.,;\n]{2,40})\s+seat\b", (("User", "flight_seat", 1, 0.84),)),
    (rf"\bbefore winter,\s*movie nights usually meant\s+{_VALUE}", (("User", "movie_snack", 1, 0.88),)),
    (rf"\bmovie nights still mean\s+{_VALUE}(?:,\s+and\s+i usually pick up\s+{_VALUE} too)?", (("User", "movie_snack", 1, 0.92), ("User", "movie_drink", 2, 0.86))),
    (rf"\bthe concession treat i almost always buy is\s+{_VALUE}", (("User", "movie_snack", 1, 0.92),)),
    (
        rf"\bCurrent travel profile:\s*{_LIST},\s*([^,;\n]{{2,40}}),\s*{_LIST},\s*{_LIST},\s*{_LIST},\s*{_LIST}\s+base\b",
        (("User", "coffee_order", 1, 0.94), ("User", "flight_seat", 2, 0.9), ("User", "bag", 3, 0.92), ("User", "charger", 4, 0.9), ("User", "notebook", 5, 0.9), ("User", "location", 6, 0.94)),
    ),
    (
        rf"\bMy boarding routine is simple:\s*(aisle|window|middle)\s+seat,\s*{_LIST},\s*{_LIST},\s*and\s+{_LIST}\s+notebook\b",
        (("User", "flight_seat", 1, 0.92), ("User", "bag", 2, 0.9), ("User", "charger", 3, 0.9), ("User", "notebook", 4, 0.9)),
    ),
    (rf"\b(Field Notes(?:\s+[A-Za-z0-9&\-]+){{0,2}})\s+and\s+(?:the\s+)?{_VALUE}\s+keep ending up in the airport kit\b", (("User", "notebook", 1, 0.88), ("User", "charger", 2, 0.88))),
    (
        rf"\bAirport kit stays consistent:\s*{_LIST},\s*{_LIST},\s*{_LIST},\s*([^,;\n]{{2,40}})\b",
        (("User", "bag", 1, 0.88), ("User", "charger", 2, 0.88), ("User", "notebook", 3, 0.88), ("User", "flight_seat", 4, 0.86)),
    ),
    (r"\b(?:i had switched|switching|switched)\s+from\s+([^.;\n]{2,80}?)\s+to\s+([^.;\n]{2,80}?)(?:[.;\n]|$)", (("User", None, 1, 0.88), ("User", None, 2, 0.9))),
    (r"([^.;\n]{2,80}?)\s+became\s+([^.;\n]{2,80}?)(?:;|[.]|$)", (("User", None, 1, 0.84), ("User", None, 2, 0.86))),
    (rf"\b((?:[A-Z][\w\-]+(?:\s+[A-Z][\w\-]+){{0,2}})|(?:I|We|User|The user))\s+moved from\s+([^.,;\n]{{2,80}}?)\s+to\s+([^.,;\n]{{2,80}}?)(?:[.,;\n]|$)", ((1, "moved_from", 2, 0.92), (1, "location", 3, 0.94))),
    (rf"\b(?:earlier(?:\s+in\s+the\s+year)?|before|previously|once)?\s*(?:i was|i'd been|we were|we'd been|the user was)\s+(?:still\s+)?based in\s+{_PLACE}\b", (("User", "location", 1, 0.84),)),
    (rf"\b{_PLACE}\s+is now\s+(?:their|my|our|the user's)\s+(?:current\s+)?city(?:\s+of\s+residence)?\b", (("User", "location", 1, 0.94),)),
    (rf"\b(?:since\s+[^,]+,\s*)?(?:my|our)\s+home base has been\s+{_PLACE}\b", (("User", "location", 1, 0.9),)),
    (rf"\b(?:i am|i'm|we are|we're|the user is)\s+(?:currently\s+)?based in\s+{_PLACE}\b", (("User", "location", 1, 0.88),)),
    (rf"\b(?:i live in|i'm in|we live in|we're in|the user lives in)\s+{_PLACE}\b", (("User", "location", 1, 0.86),)),
)
RELATIONS = (
    (rf"{_NAME}\s+moved from\s+([^.,;\n]{{2,80}}?)(?:\s+to\s+[^.,;\n]{{2,80}})?(?:[.,;\n]|$)", ((1, "moved_from", 2, 0.86),)),
    (rf"{_NAME}\s+moved to\s+{_VALUE}", ((1, "moved_to", 2, 0.86),)),
    (rf"{_NAME}\s+painted\s+{_VALUE}", ((1, "painted", 2, 0.84),)),
    (rf"{_NAME}\s+bought\s+{_VALUE}", ((1, "bought", 2, 0.82),)),
    (rf"{_NAME}\s+works at\s+{_VALUE}", ((1, "works_at", 2, 0.82),)),
    (rf"{_NAME}\s+has\s+(\d+\s+[A-Za-z][^.,;\n]{{0,40}})", ((1, "has", 2, 0.78),)),
)
#: Every pattern needs one of these words; other sentences are not searched.
CUE = r"(?i)\b(?:my|our|i|i'd|i'm|we|we'd|we're|user|their|travel|coffee|bag|kit|movie|concession|switch|switched|switching|became|moved|painted|bought|works|has)\b"
MOST_FACTS = 10
SELF = ("i", "me", "my", "myself", "we", "us", "our", "ourselves", "user", "the user", "their", "they")

STOP = ("the", "a", "an", "and", "or", "to", "for", "of", "in", "on", "at", "by", "with", "from", "into", "that", "this", "is", "are", "was", "were", "be", "it", "as", "we", "you", "they", "he", "she", "i")
#: (verb, relation, confidence) of a sentence's two sides.
VERBS = (("prefers|prefer", "prefers", 0.70), ("likes|like", "likes", 0.68), ("uses|use|used", "uses", 0.72), ("depends on|depends", "depends_on", 0.73), ("works on|working on|builds|built", "works_on", 0.69), ("is|are|was|were", "is", 0.58), ("owns|owned", "owns", 0.76))
ENTITIES, EDGES = 16, 8
#: Relations with one object at a time.
EXCLUSIVE = ("is", "prefers", "owns")
LEAST_CONFIDENCE = 0.2


def cleaned(value: Column) -> Column:
    """Blanks squeezed, marks at the ends and leading conjunctions and articles off."""
    out = F.regexp_replace(F.regexp_replace(value, r"\s+", " "), r"^[ ,;:.]+|[ ,;:.]+$", "")
    out = F.regexp_replace(out, r"(?i)^(?:and|but|or)\s+", "")
    return F.regexp_replace(out, r"(?i)^(?:the|a|an)\s+", "")


def cleaned_place(value: Column) -> Column:
    out = F.regexp_replace(cleaned(value), r"(?i)\s+(?:last|this|next)\s+(?:day|week|month|year|spring|summer|fall|autumn|winter)\b.*$", "")
    return F.regexp_replace(out, r"(?i)\s+(?:today|yesterday|recently|currently)\b.*$", "")


def date_hint(sentence: Column) -> Column:
    """The first date in a sentence, by kind of date; empty without one."""
    found = [F.regexp_extract(sentence, f"(?i){p}", 0) for p in DATES]
    return F.coalesce(*[F.when(x != "", x) for x in found], F.lit(""))


def preference(said: Column) -> Column:
    """The kind of a preference, null if its words tell none."""
    out = F.lit(None).cast("string")
    for relation, words in reversed(PREFERENCES):
        out = F.when(F.lower(said).rlike("|".join(words)), F.lit(relation)).otherwise(out)
    return out


def _stated(patterns: tuple) -> Column:
    """What each pattern states, as a literal list by the pattern's number."""
    one = lambda j, entity, relation, value, confidence: F.struct(
        F.lit(j).alias("j"), F.lit(entity if isinstance(entity, str) else None).cast("string").alias("name"), F.lit(entity if isinstance(entity, int) else 0).alias("who"),
        F.lit(relation).cast("string").alias("kind"), F.lit(value).alias("what"), F.lit(confidence).alias("confidence"),
    )
    return F.array(*[F.array(*[one(j, *x) for j, x in enumerate(stated)]) for _, stated in patterns])


def needed(pattern: str) -> str:
    """The longest word, in lower case, that every match of a pattern holds; empty without one. What is in groups, classes and optional parts does not count."""
    import re

    times = r"(?:\{[^}]*\}|[+*?])*"
    plain = re.sub(r"\\." + times, "#", re.sub(r"\[(?:\\.|[^\]])*\]" + times, "#", pattern))
    before = None
    while before != plain:  # from the innermost group on
        before, plain = plain, re.sub(r"\([^()]*\)" + times, "#", plain)
    plain = re.sub(r".(?:[*?]|\{[^}]*\})", "#", plain).lower()
    return "" if "|" in plain else max(re.findall("[a-z']+", plain), key=len, default="")


def facts(df: DataFrame, id_col: str, text_col: str, patterns: tuple = STATEMENTS + RELATIONS, most: int = MOST_FACTS) -> DataFrame:
    """(id, place, entity, relation, value, date, confidence): the first of equal facts, the first `most` of a text; place counts from 1."""
    # dealt by id once, before the search: a file may be read by few tasks, and the windows below need no exchange of their own
    each = df.select(id_col, F.col(text_col).alias("said")).repartition(id_col)
    each = each.select(id_col, F.posexplode(text.sentences(F.col("said"))).alias("nth", "sentence")).where(F.col("sentence").rlike(CUE))
    groups = lambda stated: range(1, 1 + max(max(v, e if isinstance(e, int) else 0) for e, _, v, _ in stated))
    got = lambda p, stated: F.array(*[F.regexp_extract("sentence", f"(?i){p}", g) for g in groups(stated)])
    # the groups of each pattern, null where a word that it needs is not there; inside a lambda, as code generated for all of them at once would be too long for a method
    matched = text.let(lambda low: F.array(*[F.when(F.contains(low, F.lit(needed(p))), got(p, stated)) for p, stated in patterns]), F.lower("sentence"))
    each = each.select(id_col, "nth", date_hint(F.col("sentence")).alias("date"), F.posexplode(matched).alias("k", "got")).where(F.get("got", F.lit(0)) != "")
    each = each.select(id_col, "nth", "date", "k", "got", F.inline(F.get(_stated(patterns), "k")))
    raw = F.get("got", F.col("what") - 1)
    became = [k for k, (p, _) in enumerate(patterns) if "became" in p]
    raw = F.when(F.col("k").isin(became or [-1]), F.regexp_replace(raw, r"^[A-Za-z][A-Za-z ]{0,40}:\s*", "")).otherwise(raw)
    kind = F.when(F.col("kind").isNull(), preference(F.concat_ws(" ", "got"))).when(F.col("kind") == "notebook?", F.when(preference(raw) == "notebook", "notebook")).otherwise(F.col("kind"))
    who = F.coalesce("name", F.regexp_replace(F.trim(F.get("got", F.col("who") - 1)), r"\s+", " "))
    each = each.select(id_col, "nth", "date", (10 * F.col("k") + F.col("j")).alias("k"), who.alias("who"), kind.alias("relation"), raw.alias("raw"), "confidence")
    each = each.select(id_col, "nth", "date", "k", "relation", "confidence", F.when(F.lower("who").isin(*SELF), "User").otherwise(F.col("who")).alias("entity"), F.when(F.col("relation") == "location", cleaned_place(F.col("raw"))).otherwise(cleaned(F.col("raw"))).alias("value"))
    each = each.where("entity <> '' and relation is not null and value <> ''")
    same = Window.partitionBy(id_col, F.lower("entity"), "relation", F.lower("value"), F.lower("date")).orderBy("nth", "k")
    first = each.withColumn("again", F.row_number().over(same)).where("again = 1")
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy(id_col).orderBy("nth", "k"))).where(F.col("place") <= most)
    return placed.select(id_col, "place", "entity", "relation", "value", "date", "confidence")


# Entities and relations


def masked(sentence: Column) -> Column:
    """Letters beyond ASCII as underscores, one for one, so that word boundaries mean the same everywhere."""
    return F.regexp_replace(sentence, r"[^\x00-\x7F\P{L}]", "_")


def entity_confidence(name: Column) -> Column:
    return F.when(name.rlike("^[A-Z0-9 ]+$"), 0.82).when(name.rlike("^[A-Z]"), 0.74).otherwise(0.42)


def entities(sentences: Column, most: int = ENTITIES) -> Column:
    """The first names of a text: capitalised spans and acronyms of a sentence, then its words of four letters or more. Sentences behind the last of them are not looked at."""
    named = lambda s: F.filter(F.regexp_extract_all(masked(s), F.lit(r"\b(?:[A-Z][a-z0-9]+(?:\s+[A-Z][a-z0-9]+){0,3}|[A-Z]{2,6}\d*)\b"), F.lit(0)), lambda x: ~F.lower(x).isin(*STOP))
    words = lambda s: F.filter(F.regexp_extract_all(F.lower(s), F.lit(r"[a-z0-9_\-]{4,}"), F.lit(0)), lambda x: ~x.isin(*STOP) & ~x.rlike("^[0-9]+$"))
    more = lambda found, s: F.when(F.size(found) >= most, found).otherwise(F.slice(F.array_union(found, F.concat(named(s), words(s))), 1, most))
    return F.aggregate(sentences, F.array().cast("array<string>"), more)


def anchor(side: Column, left: bool) -> Column:
    """The nearest name on one side of a verb: two capitalised words of the three nearest, else the nearest word; empty without one."""
    tokens = F.filter(F.regexp_extract_all(side, F.lit(r"[A-Za-z0-9_\-]{2,}"), F.lit(0)), lambda x: ~F.lower(x).isin(*STOP))
    near = text.let(lambda t: F.slice(t, F.greatest(F.lit(1), F.size(t) - 2), F.lit(3)), tokens) if left else F.slice(tokens, 1, 3)
    return text.let(lambda near: _anchor(near, left), near)


def _anchor(near: Column, left: bool) -> Column:
    at = lambda i: F.get(near, F.lit(i) if isinstance(i, int) else i)
    pair = (F.size(near) >= 2) & at(0).rlike("^[A-Z]") & at(1).rlike("^[A-Z]")
    return F.coalesce(F.when(pair, F.concat(at(0), F.lit(" "), at(1))).otherwise(at(F.size(near) - 1) if left else at(0)), F.lit(""))


def relations(df: DataFrame, id_col: str, text_col: str, most: int = EDGES) -> DataFrame:
    """(id, place, src, relation, dst, confidence): the first different relations of a text; a name that is among its entities adds to the confidence. Sides are cut only where a sentence has the verb."""
    rows = df.select(id_col, text.sentences(F.col(text_col)).alias("sentences")).select(id_col, "sentences", entities(F.col("sentences")).alias("known"))
    each = rows.select(id_col, "known", F.posexplode("sentences").alias("nth", "sentence")).withColumn("plain", masked(F.col("sentence")))
    each = each.where(F.col("plain").rlike(rf"(?i)\b(?:{'|'.join(v for v, _, _ in VERBS)})\b"))
    sides = []
    for k, (verb, relation, confidence) in enumerate(VERBS):

        def cut(before: Column, through: Column, sentence: Column, head=(k, relation, confidence)) -> Column:
            left, right = F.substring(sentence, F.lit(1), F.length(before)), F.substring(sentence, F.length(through) + 1, F.length(sentence))
            named = [F.lit(v).alias(n) for n, v in zip(("k", "relation", "base"), head, strict=True)]
            return F.when(through != "", F.struct(*named, anchor(left, True).alias("src"), anchor(right, False).alias("dst")))

        before, through = (F.regexp_extract("plain", rf"(?i)^(.*?)\b(?:{verb})\b", g) for g in (1, 0))
        sides.append(F.when(F.col("plain").rlike(rf"(?i)\b(?:{verb})\b"), text.let(cut, before, through, F.col("sentence"))))
    found = each.select(id_col, "known", "nth", F.inline(F.array(*sides))).where("k is not null and src <> '' and dst <> '' and lower(src) <> lower(dst)")
    bonus = lambda side: F.when(F.array_contains("known", F.col(side)), 0.08).otherwise(0.0)
    found = found.withColumn("confidence", F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.99), F.col("base") + bonus("src") + bonus("dst"))), 6))
    same = Window.partitionBy(id_col, "src", "relation", "dst").orderBy("nth", "k")
    first = found.withColumn("again", F.row_number().over(same)).where("again = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(id_col).orderBy("nth", "k"))).where(F.col("place") <= most).select(id_col, "place", "src", "relation", "dst", "confidence")


def calibrated(base: Column, kind: str, reasoning: Column, evidence: Column, session: Column, boost: float = 0.08) -> Column:
    """A confidence with what the row's origin adds to it; mentions count a little less than edges."""
    score = base + F.when(reasoning, boost).otherwise(0.0) + F.when(evidence, boost).otherwise(0.0) + F.when(session, 0.02).otherwise(0.0)
    return F.greatest(F.lit(LEAST_CONFIDENCE), F.least(F.lit(0.99), score * (0.95 if kind == "mention" else 1.0)))


def applied(edges: DataFrame, order: list[str], least: float = 0.55) -> DataFrame:
    """Edges as a graph takes them in: those below the confidence are denied, known ones change nothing, and of an exclusive relation a new object ends the last one. src, relation, dst, status (active or inactive) and valid_to (the first of `order` of the edge that ended it)."""
    names = edges.where(F.col("confidence") >= least).withColumn("src", F.lower("src")).withColumn("dst", F.lower("dst"))
    w = Window.partitionBy("src", "relation").orderBy(*order)
    exclusive = F.col("relation").isin(*EXCLUSIVE)
    again = Window.partitionBy("src", "relation", "dst").orderBy(*order)
    known = F.when(exclusive, F.col("dst").eqNullSafe(F.lag("dst").over(w))).otherwise(F.row_number().over(again) > 1)
    new = names.withColumn("known", known).where(~F.col("known")).withColumn("valid_to", F.when(exclusive, F.lead(order[0]).over(w)))
    return new.select("src", "relation", "dst", F.col(order[0]).alias("valid_from"), "valid_to", F.when(F.col("valid_to").isNull(), "active").otherwise("inactive").alias("status"), "confidence")


# Dates and tables

_SHORT = "('jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec')"
#: Kinds of dates: pattern, and the groups of year, month and day.
KINDS = ((rf"\b({MONTH})\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,\s*(\d{{4}}))?\b", 3, 1, 2), (r"\b(\d{1,2})/(\d{1,2})(?:/(\d{2,4}))?\b", 3, 1, 2), (r"\b(\d{4})-(\d{2})-(\d{2})\b", 1, 2, 3))


def mentions(df: DataFrame, id_col: str, text_col: str, default_year: int = 2000) -> DataFrame:
    """(id, raw, parsed): the dates that a text mentions. A date without a year has the year that the text names most often (the smallest of several), else the default."""
    parts = []
    for p, y, m, d in KINDS:
        every = lambda g, p=p: F.regexp_extract_all(F.col(text_col), F.lit(f"(?i){p}"), F.lit(g))
        parts.append(F.transform(F.arrays_zip(every(0).alias("raw"), every(y).alias("y"), every(m).alias("m"), every(d).alias("d")), lambda x: F.struct(x.raw.alias("raw"), x.y.alias("y"), x.m.alias("m"), x.d.alias("d"))))
    each = df.select(id_col, F.inline(F.concat(*parts)))
    short = F.array_position(F.array(*[F.lit(x) for x in _SHORT.strip("()").replace("'", "").split(",")]), F.lower(F.substring("m", 1, 3))).cast("int")
    year = F.col("y").try_cast("int")
    year = F.when(year < 70, year + 2000).when(year < 100, year + 1900).otherwise(year)
    each = each.withColumn("month", F.when(F.col("m").rlike("^[0-9]+$"), F.col("m").try_cast("int")).otherwise(short)).withColumn("year", year)
    counts = each.where("year is not null").groupBy(id_col, "year").agg(F.count("*").alias("n"))
    usual = counts.groupBy(id_col).agg(F.min_by("year", F.struct(-F.col("n"), "year")).alias("usual"))
    each = each.join(usual, id_col, "left").withColumn("year", F.coalesce("year", "usual", F.lit(default_year)))
    parsed = F.format_string("%04d-%02d-%02d", "year", "month", F.col("d").try_cast("int")).try_cast("date")
    return each.select(id_col, "raw", parsed.alias("parsed")).where("parsed is not null").distinct()


def day_gaps(found: DataFrame, id_col: str, ahead: int = 3) -> DataFrame:
    """(id, a, b, days): each date with the next ones of its text, later dates only."""
    dates = found.groupBy(id_col).agg(F.array_sort(F.collect_set("parsed")).alias("dates"))
    pairs = F.flatten(F.transform("dates", lambda a, i: F.transform(F.slice(F.col("dates"), i + 2, F.lit(ahead)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return dates.select(id_col, F.inline(pairs)).select(id_col, "a", "b", F.datediff("b", "a").cast("long").alias("days"))


SEPARATOR_ROW = r"^\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?$"


def table_cells(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, header, cell, label): the cells of the markdown tables of a text, with the first cell of their row as its label. A table begins with a separator row below its header and ends with the first line without a bar; rows of another width are left out."""
    cells = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[ \"'`.,;:]+|[ \"'`.,;:]+$", ""))
    each = df.select(id_col, F.posexplode(text.lines(F.col(text_col))).alias("line", "said"))
    w = Window.partitionBy(id_col).orderBy("line")
    bar, rule = F.contains("said", F.lit("|")), F.col("said").rlike(SEPARATOR_ROW)
    each = each.withColumn("part", F.sum(F.when(rule | ~bar, 1).otherwise(0)).over(w)).withColumn("head", F.when(rule & F.contains(F.lag("said").over(w), F.lit("|")), F.lag("said").over(w)))
    each = each.withColumn("head", F.max("head").over(Window.partitionBy(id_col, "part"))).where(bar & ~rule & F.col("head").isNotNull())
    rows = each.select(id_col, "line", cells(F.col("head")).alias("heads"), cells(F.col("said")).alias("values")).where("size(heads) >= 2 and size(heads) = size(values)")
    pairs = F.arrays_zip(F.col("heads").alias("header"), F.col("values").alias("cell"))
    return rows.select(id_col, "line", F.get("values", F.lit(0)).alias("label"), F.inline(pairs)).where("cell <> ''").select(id_col, "line", "header", "cell", "label")


# Typed tokens

PLACEHOLDER = "<@>"
#: Kinds of tokens, the first that fits counts. Fixed values.
TYPED = (("TS", r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?\b"), ("UUID", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"), ("HEX", r"\b[0-9a-fA-F]{16,}\b"), ("INT", r"\b\d{7,}\b"))
TYPED_PATTERN = "|".join(p for _, p in TYPED)


def typed(line: Column) -> tuple[Column, Column]:
    """The line with a placeholder for each typed token, and the tokens (kind, raw) in order. A hexadecimal token of digits alone is one too."""
    raw = F.regexp_extract_all(line, F.lit(TYPED_PATTERN), F.lit(0))
    kind = lambda x: F.when(F.contains(x, F.lit(":")), "TS").when(F.contains(x, F.lit("-")), "UUID").when(F.length(x) >= 16, "HEX").otherwise("INT")
    return F.regexp_replace(line, TYPED_PATTERN, PLACEHOLDER), F.transform(raw, lambda x: F.struct(kind(x).alias("kind"), x.alias("raw")))


def reinflated(canonical: Column, tokens: Column) -> Column:
    """The line again. Placeholders that were in the line itself are not told apart."""
    parts = F.split(canonical, PLACEHOLDER, -1)
    return F.array_join(F.transform(parts, lambda p, i: F.concat(F.coalesce(F.get(tokens, i - 1).raw, F.lit("")), p)), "")
