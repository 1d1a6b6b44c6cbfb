"""Answers out of remembered text: dates and numbers in normal form, reading, choice, differences, support.

Single answers are Column expressions. Reading ranks the sentences of each question's rows in one
window per question; nothing is collected, and a question's rows are narrow by then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.operators import extract, ranking, text
from tidepool.operators import questions as qs

# Fixed values.

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
AMOUNTS = {"a": 1, "an": 1, "couple": 2, "few": 3} | {w: i for i, w in enumerate(text.NUMBER_WORDS[:11]) if i}
STATUSES = "single|married|divorced|engaged|dating|separated|widowed"
NO_ANSWER = "not enough information"
STOP = (
    "a", "an", "the", "is", "are", "was", "were", "to", "of", "in", "on", "for", "and", "or", "with", "what", "when", "who", "where", "which",
    "did", "do", "does", "at", "by", "from", "as", "it", "be", "this", "that", "how", "many", "much", "my", "me", "i",
)
CURRENT = ("current", "currently", "now", "present", "latest")
FORMER = ("previous", "previously", "former", "formerly", "old", "past")
EARLY = ("first", "earliest", "earlier", "before")
LATE = ("last", "latest", "later", "after")
#: Confidence of each way in which spans bear an answer.
SUPPORT = {"present": 0.95, "date": 0.86, "delta": 0.82, "overlap": 0.78, "count": 0.72, "partial": 0.48, "affirmed": 0.45}
_M = extract.MONTH
#: Dates that an answer may hold, the first kind that is found counts.
DATE_SPANS = (rf"\b\d{{1,2}}(?:st|nd|rd|th)?\s+{_M}(?:\s*(?:19|20)\d{{2}})?\b", rf"\b{_M}\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,\s*(?:19|20)\d{{2}})?\b", rf"\b(?:early|mid|late)[-\s]+{_M}(?:,?\s*(?:19|20)\d{{2}})?\b", rf"\b{_M}\s+(?:19|20)\d{{2}}\b", r"\b(?:19|20)\d{2}-\d{2}-\d{2}\b", r"\b\d{1,2}/\d{1,2}(?:/\d{2,4})?\b")


def clean(value: Column) -> Column:
    """Blanks squeezed, marks and quotes at the ends off."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "), "^[ \"'`.,;:]+|[ \"'`.,;:]+$", "")


def _some(value: Column) -> Column:
    return F.when(value != "", value)


def written(day: Column) -> Column:
    """A date as `5 June 2024`."""
    return F.concat(F.dayofmonth(day), F.lit(" "), F.date_format(day, "MMMM"), F.lit(" "), F.year(day))


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.format_string("%04d-%02d-%02d", year, month, day).try_cast("date")


def _month(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(name, 1, 3))).cast("int")


def _year(value: Column, ref: Column) -> Column:
    year = _some(value).try_cast("int")
    return F.coalesce(F.when(year < 70, year + 2000).when(year < 100, year + 1900).otherwise(year), F.year(ref))


def canonical_date(span: Column, ref: Column) -> Column:
    """An explicit date as `5 June 2024`, a month as `June 2024`; without a year that of the reference date; anything else as it is."""
    return text.let(_canonical_date, clean(span), ref)


def _canonical_date(value: Column, ref: Column) -> Column:
    get = lambda p, g: F.regexp_extract(value, f"(?i)^{p}$", g)
    iso, slash = r"((?:19|20)\d{2})-(\d{1,2})-(\d{1,2})", r"(\d{1,2})/(\d{1,2})(?:/(\d{2,4}))?"
    first, second = rf"(\d{{1,2}})(?:st|nd|rd|th)?\s+({_M})(?:,?\s*((?:19|20)\d{{2}}))?", rf"({_M})\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s*((?:19|20)\d{{2}}))?"
    phase = rf"(early|mid|late)[-\s]+({_M})(?:,?\s*((?:19|20)\d{{2}}))?"
    number = lambda x: _some(x).try_cast("int")
    told = lambda p, day: F.when(get(p, 1) != "", day)
    part = F.when(F.lower(get(phase, 1)) == "early", 5).when(F.lower(get(phase, 1)) == "mid", 15).otherwise(25)
    day = F.coalesce(
        told(iso, _day(number(get(iso, 1)), number(get(iso, 2)), number(get(iso, 3)))),
        told(slash, _day(_year(get(slash, 3), ref), number(get(slash, 1)), number(get(slash, 2)))),
        told(first, _day(_year(get(first, 3), ref), _month(get(first, 2)), number(get(first, 1)))),
        told(second, _day(_year(get(second, 3), ref), _month(get(second, 1)), number(get(second, 2)))),
        told(phase, _day(_year(get(phase, 3), ref), _month(get(phase, 2)), part)),
    )
    whole = rf"({_M})\s+((?:19|20)\d{{2}})"
    month = F.concat(F.date_format(_day(F.lit(2000), _month(get(whole, 1)), F.lit(1)), "MMMM"), F.lit(" "), get(whole, 2))
    return F.coalesce(text.let(written, day), told(whole, month), value)


def relative_date(said: Column, ref: Column) -> Column:
    """A date told by its distance from the reference date, as `5 June 2024`; null without one."""
    return text.let(_relative_date, F.lower(F.coalesce(said, F.lit(""))), ref)


def _relative_date(low: Column, ref: Column) -> Column:
    has = lambda p: low.rlike(p)
    ago = rf"\b(\d+|{'|'.join(sorted(AMOUNTS, key=len, reverse=True))})\s+(day|week|month|year)s?\s+ago\b"
    amount, unit = F.regexp_extract(low, ago, 1), F.regexp_extract(low, ago, 2)
    n = F.coalesce(_some(amount).try_cast("int"), F.element_at(F.create_map(*[F.lit(x) for kv in AMOUNTS.items() for x in kv]), amount))
    back = F.when(unit == "day", F.date_sub(ref, n)).when(unit == "week", F.date_sub(ref, n * 7)).when(unit == "month", F.add_months(ref, -n)).when(unit == "year", F.add_months(ref, n * -12))
    name = F.regexp_extract(low, rf"\b(?:last|this past)\s+({'|'.join(WEEKDAYS)})\b", 1)
    apart = F.pmod(F.weekday(ref) - (F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), name).cast("int") - 1), F.lit(7))
    day = (
        F.when(has(r"\byesterday\b"), F.date_sub(ref, 1)).when(has(r"\btoday\b"), ref).when(has(r"\btomorrow\b"), F.date_add(ref, 1))
        .when(has(r"\blast week\b"), F.date_sub(ref, 7)).when(has(r"\bnext week\b"), F.date_add(ref, 7)).when(unit != "", back)
        .when(name != "", F.date_sub(ref, F.when(apart == 0, 7).otherwise(apart))).when(has(r"\brecently\b"), F.date_sub(ref, 3))
    )
    return text.let(written, day)


def year_of(said: Column, ref: Column) -> Column:
    named = F.regexp_extract(said, r"\b((?:19|20)\d{2})\b", 1)
    shift = F.when(F.lower(said).rlike(r"\blast year\b"), -1).when(F.lower(said).rlike(r"\bthis year\b"), 0).when(F.lower(said).rlike(r"\bnext year\b"), 1)
    return F.coalesce(_some(named), (F.year(ref) + shift).cast("string"), clean(said))


def date_span(said: Column) -> Column:
    """The first kind of explicit date in a text; null without one."""
    return F.coalesce(*[_some(F.regexp_extract(said, f"(?i){p}", 0)) for p in DATE_SPANS])


def date_of(said: Column, ref: Column) -> Column:
    pick = lambda said, ref, year, span: F.coalesce(relative_date(said, ref), F.when(span.isNotNull(), canonical_date(span, ref)), F.when(year.rlike(r"^(?:19|20)\d{2}$"), year), clean(said))
    return text.let(pick, said, ref, year_of(said, ref), date_span(said))


def day_of(said: Column, ref: Column) -> Column:
    """The day that a text tells; null for less than a day."""
    return F.try_to_timestamp(date_of(said, ref), F.lit("d MMMM yyyy")).cast("date")


def number_of(said: Column) -> Column:
    digits = F.regexp_extract(said, r"\b\d+(?:\.\d+)?\b", 0)
    words = [F.when(F.lower(said).rlike(rf"\b{w}\b"), F.lit(str(i))) for i, w in enumerate(text.NUMBER_WORDS)]
    # words are tried one by one where there is any
    return F.coalesce(_some(digits), F.when(F.lower(said).rlike(rf"\b(?:{'|'.join(text.NUMBER_WORDS)})\b"), F.coalesce(*words)), clean(said))


def yes_or_no(said: Column) -> Column:
    words = F.split(text.normalised(said), " ")
    has = lambda *w: F.arrays_overlap(words, F.array(*[F.lit(x) for x in w]))
    return F.when(has("yes", "true", "confirmed"), "yes").when(has("no", "false"), "no").otherwise(clean(said))


def listed(said: Column) -> Column:
    parts = F.filter(F.transform(F.split(said, r",|\band\b"), clean), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise(clean(said))


def normal(answer: Column, kind: Column, ref: Column) -> Column:
    """struct(answer, answer_type): an answer in the normal form of its type; abstentions have a type of their own."""
    return text.let(_normal, clean(answer), kind, ref)


def _normal(value: Column, kind: Column, ref: Column) -> Column:
    status = F.regexp_extract(value, rf"(?i)\b({STATUSES})\b", 1)
    out = (
        F.when(kind == "year", year_of(value, ref)).when(kind == "date", date_of(value, ref)).when(kind.isin("count", "number"), number_of(value)).when(kind == "yes_no", yes_or_no(value))
        .when((kind == "relationship_status") & (status != ""), F.initcap(status)).when(kind == "list", listed(value)).otherwise(value)
    )
    return text.let(lambda none, out, kind: F.struct(F.when(none, NO_ANSWER).otherwise(out).alias("answer"), F.when(none, "not_enough_information").otherwise(kind).alias("answer_type")), qs.abstains(value), out, kind)


def support(answer: Column, spans: Column, kind: Column, ref: Column, computed: Column | None = None) -> Column:
    """struct(status, confidence): whether an array of spans bears an answer of a type. `computed` marks answers that are differences of dates."""
    joined = F.array_join(spans, " ")
    none = (F.coalesce(answer, F.lit("")) == "") | (text.normalised(answer) == NO_ANSWER)
    return text.let(_support, none, text.normalised(normal(answer, kind, ref).answer), text.normalised(joined), joined, ref, spans, kind, F.lit(False) if computed is None else computed)


def _support(none: Column, a: Column, s: Column, joined: Column, ref: Column, spans: Column, kind: Column, computed: Column) -> Column:
    words = F.array_distinct(F.split(a, " "))
    share = F.size(F.array_intersect(words, F.split(s, " "))) / F.size(words)
    n = F.when(a.rlike("^[0-9]"), a.try_cast("double").try_cast("int"))
    from_span = text.normalised(F.when(kind == "year", year_of(joined, ref)).when(kind == "date", date_of(joined, ref)))
    out = lambda status, how: F.struct(F.lit(status).alias("status"), F.lit(SUPPORT.get(how, how)).cast("double").alias("confidence"))
    return (
        F.when(none, out("abstained", 1.0))
        .when((F.size(spans) < 1) | (a == "") | (s == ""), out("unsupported", 0.0))
        .when(F.contains(s, a), out("supported", "present"))
        .when(from_span == a, out("supported", "date"))
        .when(kind.isin("count", "number") & computed, out("supported", "delta"))
        .when(kind.isin("count", "number") & (n > 0) & (F.size(F.filter(spans, lambda x: F.trim(x) != "")) >= n), out("supported", "count"))
        .when(share >= 0.75, out("supported", "overlap"))
        .when(share >= 0.45, out("partial", "partial"))
        .when((kind == "yes_no") & (a == "yes") & s.rlike(r"\b(?:is|are|was|were|does|did|has|have)\b"), out("partial", "affirmed"))
        .otherwise(out("unsupported", 0.0))
    )


def tokens(said: Column) -> Column:
    """Different words without stop words, plurals also without their s."""
    return _tokens(text.normalised(said))


def _tokens(normal_form: Column) -> Column:
    words = F.filter(F.split(normal_form, " "), lambda w: (F.length(w) > 1) & ~w.isin(*STOP))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.when(F.endswith(w, F.lit("s")) & (F.length(w) > 3), F.array(w, F.regexp_replace(w, "s$", ""))).otherwise(F.array(w)))))


def temporal_score(question: Column, said: Column) -> Column:
    """What a sentence gains or loses by speaking of now or of the past, as the question asks."""
    return text.let(lambda q, s: text.let(_temporal_score, _times(q), _times(s)), text.normalised(question), text.normalised(said))


def _times(normal_form: Column) -> Column:
    """struct(now, past): what a normal form speaks of."""
    any_of = lambda of: F.arrays_overlap(F.split(normal_form, " "), F.array(*[F.lit(w) for w in of]))
    return F.struct(any_of(CURRENT).alias("now"), (F.contains(normal_form, F.lit("used to")) | any_of(FORMER)).alias("past"))


def _temporal_score(asked: Column, told: Column) -> Column:
    num = lambda cond, x: F.when(cond, x).otherwise(0.0)
    return num(asked.now & told.past, -0.65) + num(asked.now & told.now, 0.45) + num(asked.past & told.past, 0.45) + num(asked.past & told.now & ~told.past, -0.25)


def answer_in(sentence: Column, kind: Column) -> Column:
    """What a sentence answers to a question of a type; null if nothing."""
    get = lambda p, g=1: _some(F.regexp_extract(sentence, p, g))
    liking = (
        r"(?i)\b(?:prefers?|likes?|favo(?:u)?rite\s+(?:\w+\s+)?(?:is|was)|order\s+(?:is|was)|uses?|carries?)\s+([^.;!?]+)",
        r"(?i)\b(?:is|was)\s+(?:currently\s+)?using\s+([^.;!?]+)",
        r"(?i)\b(?:coffee|drink|bag|notebook)\s+(?:now\s+)?(?:order\s+)?(?:is|was)\s+([^.;!?]+)",
    )
    preference = F.coalesce(*[get(p) for p in liking])
    number = text.let(lambda n: F.when(n.rlike(r"^\d+(?:\.\d+)?$"), n), number_of(sentence))
    dated = F.coalesce(get(r"(?i)\b(?:last|this|next) year\b", 0), get(r"(?i)\b(?:yesterday|today|tomorrow|last week|next week|\w+ (?:day|week|month|year)s? ago)\b", 0), date_span(sentence), get(r"\b(?:19|20)\d{2}\b", 0))
    return (
        F.when(kind == "date", dated).when(kind == "year", get(r"\b(?:19|20)\d{2}\b", 0)).when(kind.isin("count", "number"), number)
        .when(kind == "relationship_status", get(rf"(?i)\b({STATUSES})\b")).when(kind == "location", _some(clean(get(r"\b(?:live|lives|living|based|moved)\s+(?:in|to|near|at)\s+([A-Z][A-Za-z0-9_ .'-]+)"))))
        .when(kind == "person", get(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b")).when(kind == "preference", _some(clean(F.regexp_replace(preference, r"(?i)\b(?:now|currently|these days)\b", ""))))
        .when(kind == "yes_no", F.lit("yes")).otherwise(_some(clean(get(r"(?i)\b(?:is|was|were|did|does|do)\s+([^.;!?]+)"))))
    )


def asking(rows: DataFrame, question: str) -> DataFrame:
    """rows with asked: the words, times and type of a question. Of a table of questions this is made once a question, before it meets the rows."""
    return rows.withColumn("asked", text.let(lambda n: F.struct(_tokens(n).alias("words"), _times(n).alias("times"), qs.typed(n).alias("kind")), text.normalised(F.col(question))))


def telling(rows: DataFrame, row_text: str) -> DataFrame:
    """Sentences of rows with nth, sentence and told, its words and times; a row without any has one null sentence. Made once a sentence, before it meets the questions."""
    each = rows.select("*", F.posexplode_outer(text.sentences(F.col(row_text))).alias("nth", "sentence"))
    return each.withColumn("told", text.let(lambda n: F.struct(_tokens(n).alias("words"), _times(n).alias("times")), text.normalised(F.col("sentence"))))


def ranked_sentences(rows: DataFrame, question: str, row_text: str, place: str) -> DataFrame:
    """rows with sentence, nth and score: the share of the question's words, less the lower a row is placed, and what time is spoken of. What `asking` and `telling` have made before is not made again."""
    each = rows if "told" in rows.columns else telling(rows, row_text)
    each = each if "asked" in rows.columns else asking(each, question)
    share = F.size(F.array_intersect("asked.words", "told.words")) / F.greatest(F.lit(1), F.size("asked.words"))
    return each.withColumn("score", F.round(share + F.greatest(F.lit(0.0), 1.0 - 0.02 * F.col(place)) + _temporal_score(F.col("asked.times"), F.col("told.times")), 6))


def read(rows: DataFrame, by: list[str], question: str, row_text: str, place: str, ref: Column, most: int = 24) -> DataFrame:
    """by, answer, answer_type, status, confidence, span and place of the row cited: the best ranked sentence that answers each question, in normal form, if it bears the answer; else an abstention."""
    ranked = ranking.top_k(ranked_sentences(rows, question, row_text, place), by, most, F.desc("score"), F.asc(place), F.asc("nth"))
    said = ranked.select(*by, F.col("asked.kind").alias("kind"), "rank", F.col(place).alias("place"), "sentence", ref.alias("ref"))
    said = said.withColumn("raw", text.let(answer_in, F.col("sentence"), F.col("kind")))
    # a question without any sentence, or any that answers, still has its row
    answering = F.when(F.col("raw").isNotNull(), F.col("rank"))
    every = said.groupBy(*by).agg(F.min_by(F.struct("kind", "place", "sentence", "raw", "ref"), answering).alias("b")).select(*by, "b.*")
    found = normal(F.col("raw"), F.col("kind"), F.col("ref"))
    checked = lambda found, sentence, kind, ref: F.struct(found.alias("found"), support(found.answer, F.array(sentence), kind, ref).alias("checked"))
    every = every.withColumn("r", F.when(F.col("raw").isNotNull(), text.let(checked, found, F.col("sentence"), F.col("kind"), F.col("ref")))).select("*", "r.found", "r.checked")
    ok = F.coalesce(~F.col("checked.status").isin("unsupported", "abstained"), F.lit(False))
    confidence = F.when(F.col("checked.status") == "partial", F.least("checked.confidence", F.lit(0.5))).otherwise(F.col("checked.confidence"))
    return every.select(
        *by, F.when(ok, F.col("found.answer")).otherwise(NO_ANSWER).alias("answer"), F.when(ok, F.col("found.answer_type")).otherwise("not_enough_information").alias("answer_type"),
        F.coalesce(F.col("checked.status"), F.lit("abstained")).alias("status"), F.when(ok, confidence).otherwise(0.0).alias("confidence"), F.when(ok, F.col("sentence")).alias("span"), F.col("place").alias("cited"),
    )


def options(question: Column) -> Column:
    """The two things a question lets choose from; an empty array without them."""
    p = r"(?i)(?:,|:|first|last|earlier|later)\s+(?:the\s+)?([^,?]+?)\s+or\s+(?:the\s+)?([^,?]+?)\s*\?*\s*$"
    a, b = (clean(F.regexp_extract(question, p, g)) for g in (1, 2))
    return F.when((a != "") & (b != ""), F.array(a, b)).otherwise(F.array().cast("array<string>"))


def choose(rows: DataFrame, by: list[str], question: str, row_text: str, ref: Column) -> DataFrame:
    """by and answer: the option whose sentences have the earliest (or, as asked, the latest) date. Of equal dates the sentence that names its option best counts, then the option named first."""
    words = F.split(text.normalised(F.col(question)), " ")
    late = F.arrays_overlap(words, F.array(*[F.lit(w) for w in LATE]))
    each = rows.select(*by, late.alias("late"), F.explode(text.sentences(F.col(row_text))).alias("sentence"), options(F.col(question)).alias("options"), ref.alias("ref"))
    each = each.select(*by, "late", "sentence", "ref", F.posexplode("options").alias("nth", "option"))
    fits = lambda wanted, said: F.size(F.array_intersect(wanted, said)) / F.greatest(F.lit(1), F.size(wanted))
    each = each.withColumn("fits", text.let(fits, tokens(F.col("option")), tokens(F.col("sentence"))))
    each = each.where("fits >= 0.34").withColumn("day", day_of(F.col("sentence"), F.col("ref"))).where("day is not null")
    order = F.when(F.col("late"), -F.unix_date("day")).otherwise(F.unix_date("day"))
    return each.groupBy(*by).agg(F.min_by("option", F.struct(order.alias("o"), (-F.col("fits")).alias("f"), F.col("nth"))).alias("answer"))


def delta_days(rows: DataFrame, by: list[str], question: str, row_text: str, ref: Column) -> DataFrame:
    """by and days: between the two different dates whose sentences share most words with the question; of equal shares the earlier date."""
    asked = tokens(F.col(question))
    each = rows.select(*by, asked.alias("asked"), F.explode(text.sentences(F.col(row_text))).alias("sentence"), ref.alias("ref"))
    share = F.size(F.array_intersect("asked", tokens(F.col("sentence")))) / F.greatest(F.lit(1), F.size("asked"))
    dated = each.select(*by, F.round(share, 6).alias("share"), day_of(F.col("sentence"), F.col("ref")).alias("day")).where("day is not null").groupBy(*by, "day").agg(F.max("share").alias("share"))
    two = ranking.top_k(dated, by, 2, F.desc("share"), F.asc("day")).groupBy(*by).agg(F.min("day").alias("a"), F.max("day").alias("b"), F.count("*").alias("n")).where("n = 2")
    return two.select(*by, F.datediff("b", "a").cast("long").alias("days"))


def months_in(said: Column) -> Column:
    """A duration of years and months in months; null without one."""
    p = r"(?i)\b(\d+)\s+years?(?:\s+and\s+(\d+)\s+months?)?\b"
    return F.regexp_extract(said, p, 1).try_cast("long") * 12 + F.coalesce(F.regexp_extract(said, p, 2).try_cast("long"), F.lit(0))


def duration(months: Column) -> Column:
    return text.let(_duration, F.floor(months / 12), months % 12)


def _duration(years: Column, rest: Column) -> Column:
    return F.when((years > 0) & (rest > 0), F.concat(years, F.lit(" years and "), rest, F.lit(" months"))).when(years > 0, F.concat(years, F.lit(" years"))).otherwise(F.concat(rest, F.lit(" months")))


def duration_before(rows: DataFrame, by: list[str], row_text: str) -> DataFrame:
    """by and answer: the time in a field less the time in the current job, where both are told."""
    each = rows.select(*by, F.posexplode(text.sentences(F.col(row_text))).alias("nth", "sentence")).withColumn("months", months_in(F.col("sentence"))).where("months is not null")
    n = text.normalised(F.col("sentence"))
    career, job = n.rlike("professionally|career|working professional|in field"), n.rlike("current job| at ")
    both = each.groupBy(*by).agg(F.min_by("months", F.when(career, F.col("nth"))).alias("total"), F.min_by("months", F.when(job, F.col("nth"))).alias("now"))
    return both.where("total > now").select(*by, duration(F.col("total") - F.col("now")).alias("answer"))


def projects(rows: DataFrame, by: list[str], row_text: str) -> DataFrame:
    """by and answer: how many different projects are named."""
    each = rows.select(*by, F.explode(text.sentences(F.col(row_text))).alias("s")).where(F.col("s").rlike(r"(?i)\b(?:project|led|leading)\b"))
    name = F.coalesce(_some(F.regexp_extract("s", r"(?i)\bproject\s+([A-Za-z][A-Za-z0-9_-]{2,})\b", 1)), _some(F.regexp_extract("s", r"\b([A-Z][A-Za-z0-9_-]{2,})\b", 1)), text.normalised(F.col("s")))
    return each.groupBy(*by).agg(F.count_distinct(F.lower(name)).alias("answer"))


def benchmark_answer(question: Column, sentence: Column, kind: Column) -> Column:
    """The narrow reader of benchmarks: NUMBER with its unit, DATE, or CHOICE by the order of two options in a sentence."""
    q = F.lower(question)
    unit = F.regexp_extract(q, r"(day|week|month|year|time|episode|hour|minute)s?", 1)
    number = F.coalesce(_some(F.regexp_extract(sentence, r"(?i)\b(\d+ (?:day|week|month|year|time|episode|hour|minute)s?)\b", 1)), F.when(unit == "", _some(F.regexp_extract(sentence, r"\b\d+\b", 0))))
    number = F.when(q.rlike("how many|how long") & ((unit == "") | F.contains(F.lower(number), unit)), number)
    date = F.when(q.rlike("^when |what date|what year"), F.coalesce(date_span(sentence), _some(F.regexp_extract(sentence, r"\b\d{4}\b", 0))))
    pair, s = options(question), F.concat(F.lit(" "), text.normalised(sentence), F.lit(" "))
    a, b = (F.position(F.concat(F.lit(" "), text.normalised(F.get(pair, F.lit(i))), F.lit(" ")), s) for i in (0, 1))
    a_first = F.when(F.contains(s, F.lit(" before ")), a < b).when(F.contains(s, F.lit(" after ")), a > b)
    late = q.rlike(r"\b(?:last|later|latest)\b")
    choice = F.when((F.size(pair) == 2) & (a > 0) & (b > 0), F.when(a_first == ~late, F.get(pair, F.lit(0))).otherwise(F.when(a_first.isNotNull(), F.get(pair, F.lit(1)))))
    return F.when(kind == "NUMBER", number).when(kind == "DATE", clean(date)).when(kind.isin("CHOICE", "SHORT_PHRASE"), choice)
