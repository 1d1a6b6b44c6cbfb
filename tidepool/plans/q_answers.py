"""Question answering: normal forms, dates, reading, choice, support, metrics; profiles and variants of questions.

Sentences are written from the tables' values, and the SQL works from the values, not from the
sentences: what is read out of a text is held against what was put into it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.operators import answers, ranking, search, text
from tidepool.operators import questions as qs
from tidepool.plans.q_extract import sentences_sql
from tidepool.plans.q_questions import _Q, _questions
from tidepool.plans.q_search import _bm25_sql, documents_index
from tidepool.plans.registry import query
from tidepool.plans.tables import MONTHS, NOTES_SQL, dealt, normalised_sql, notes, queries_frame, table

_NUMBERS = "[" + ", ".join(f"'{w}'" for w in text.NUMBER_WORDS) + "]"


@query("qa_norm_match", f"SELECT doc_id, md5({normalised_sql('text')}) AS norm FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.normalised(F.col("text"))).alias("norm"))


@query("qa_norm_text", f"SELECT conv_id, turn, md5(array_to_string(list_transform(string_split({normalised_sql('text')}, ' '), lambda w: CASE w WHEN 'once' THEN '1' WHEN 'twice' THEN '2' WHEN 'thrice' THEN '3' ELSE w END), ' ')) AS norm FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(text.metric_normal(F.col("text"))).alias("norm"))


@query("qa_em", f"""WITH p AS (SELECT doc_id, {normalised_sql('text')} AS g, {normalised_sql(sentences_sql('text') + '[1]')} AS p FROM documents)
SELECT doc_id, CASE WHEN p <> '' AND g <> '' AND (p = g OR (contains(g, p) AND len(string_split(g, ' ')) <= greatest(3, floor(len(string_split(p, ' ')) * 2.5)))) THEN 1.0 ELSE 0.0 END::double AS em FROM p""")
def _(spark, sf):
    """The first sentence as an answer where the whole text is right."""
    return table(spark, sf, "documents").select("doc_id", qs.exact_match(F.coalesce(F.get(text.sentences(F.col("text")), F.lit(0)), F.lit("")), F.col("text")).alias("em"))


# Claims: what a sentence says, of what type it is, and on which day it was said

_D, _N = "ts::date", "(user_id % 9 + 2)"
_WRITTEN = "strftime({}, '%-d %B %Y')"
_APART = f"((isodow({_D}) - 2 + 7) % 7)"
_LONG = "strftime(ts, '%B %-d, %Y')"
_CLAIMS = (
    ("date", "'It was yesterday, I think'", _WRITTEN.format(f"{_D} - 1")),
    ("date", f"'about ' || {_N} || ' weeks ago, roughly'", _WRITTEN.format(f"{_D} - (7 * {_N})::int")),
    ("date", f"{_N} || ' months ago'", _WRITTEN.format(f"({_D} - to_months({_N}::int))::date")),
    ("date", "'on this past Tuesday'", _WRITTEN.format(f"{_D} - (CASE WHEN {_APART} = 0 THEN 7 ELSE {_APART} END)::int")),
    ("date", f"'They met on ' || {_LONG} || '.'", _WRITTEN.format(_D)),
    ("date", "'on ' || strftime(ts, '%-d %b')", _WRITTEN.format(_D)),
    ("date", "'early ' || strftime(ts, '%B %Y')", "'5 ' || strftime(ts, '%B %Y')"),
    ("date", "strftime(ts, '%B %Y')", "strftime(ts, '%B %Y')"),
    ("date", "strftime(ts, '%-m/%-d/%y')", _WRITTEN.format(_D)),
    ("year", "'that was last year'", f"(year({_D}) - 1)::varchar"),
    ("year", f"'in ' || (2010 + {_N}) || ' or so'", f"(2010 + {_N})::varchar"),
    ("count", f"'She has ' || {_NUMBERS}[{_N} + 1] || ' boats'", f"{_N}::varchar"),
    ("yes_no", "'Yes, that is confirmed'", "'yes'"),
    ("relationship_status", "'He got DIVORCED in spring'", "'Divorced'"),
    ("list", f"'tea, coffee and  milk ' || {_N}", f"'tea, coffee, milk ' || {_N}"),
    ("free_text", "'unknown to me'", f"'{answers.NO_ANSWER}'"),
    ("free_text", f"'\"the red  door ' || {_N} || '\".'", f"'the red door ' || {_N}"),
)
_K = f"(event_id % {len(_CLAIMS)})"


def _case(i: int) -> str:
    return "CASE " + " ".join(f"WHEN {_K} = {k} THEN {c[i] if i else chr(39) + c[0] + chr(39)}" for k, c in enumerate(_CLAIMS)) + " END"


CLAIMS_SQL = f"claims AS (SELECT event_id, {_K} AS k, {_case(0)} AS kind, {_case(1)} AS said, {_case(2)} AS truth, {_D} AS ref FROM events)"


def _claims(spark, sf):
    n, day = (F.col("user_id") % 9 + 2).cast("string"), lambda f: F.date_format("ts", f)
    word = F.element_at(F.array(*[F.lit(w) for w in text.NUMBER_WORDS]), (F.col("user_id") % 9 + 3).cast("int"))
    cat = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    said = [
        F.lit("It was yesterday, I think"), cat("about ", n, " weeks ago, roughly"), cat(n, " months ago"), F.lit("on this past Tuesday"), cat("They met on ", day("MMMM d, yyyy"), "."), cat("on ", day("d MMM")), cat("early ", day("MMMM yyyy")), day("MMMM yyyy"), day("M/d/yy"),
        F.lit("that was last year"), cat("in ", (F.col("user_id") % 9 + 2012).cast("string"), " or so"), cat("She has ", word, " boats"), F.lit("Yes, that is confirmed"), F.lit("He got DIVORCED in spring"), cat("tea, coffee and  milk ", n), F.lit("unknown to me"), cat('"the red  door ', n, '".'),
    ]
    k = (F.col("event_id") % len(_CLAIMS)).cast("int")
    return table(spark, sf, "events").select("event_id", k.alias("k"), F.element_at(F.array(*[F.lit(c[0]) for c in _CLAIMS]), k + 1).alias("kind"), F.element_at(F.array(*said), k + 1).alias("said"), F.to_date("ts").alias("ref"))


@query("qa_norm_answer", f"WITH {CLAIMS_SQL} SELECT event_id, truth AS answer, CASE WHEN k = 15 THEN 'not_enough_information' ELSE kind END AS answer_type FROM claims")
def _(spark, sf):
    return _claims(spark, sf).select("event_id", answers.normal(F.col("said"), F.col("kind"), F.col("ref")).alias("a")).select("event_id", "a.*")


@query("qa_rel_date", f"WITH {CLAIMS_SQL} SELECT event_id, truth AS resolved FROM claims WHERE k < 4")
def _(spark, sf):
    return _claims(spark, sf).select("event_id", answers.relative_date(F.col("said"), F.col("ref")).alias("resolved")).where("resolved is not null")


@query("qa_canon_date", f"WITH {CLAIMS_SQL} SELECT event_id, truth AS canonical FROM claims WHERE k BETWEEN 4 AND 8")
def _(spark, sf):
    span = answers.date_span(F.col("said"))
    return _claims(spark, sf).where(span.isNotNull()).select("event_id", answers.canonical_date(span, F.col("ref")).alias("canonical"))


@query(
    "qa_verify",
    f"""WITH {CLAIMS_SQL}, c AS (SELECT *, CASE WHEN event_id % 3 = 0 AND kind IN ('date', 'year') THEN '31 December 1999' WHEN event_id % 3 = 0 AND k <> 15 THEN 'blue whale' ELSE truth END AS answer FROM claims)
SELECT event_id, CASE WHEN k = 15 THEN 'abstained' WHEN event_id % 3 = 0 THEN 'unsupported' ELSE 'supported' END AS status,
  CASE WHEN k = 15 THEN 1.0 WHEN event_id % 3 = 0 THEN 0.0 WHEN contains({normalised_sql('said')}, {normalised_sql('answer')}) THEN 0.95 WHEN kind IN ('date', 'year') THEN 0.86 ELSE 0.78 END::double AS confidence FROM c""",
)
def _(spark, sf):
    """A third of the answers are wrong."""
    c = _claims(spark, sf)
    right = answers.normal(F.col("said"), F.col("kind"), F.col("ref")).answer
    wrong = F.when(F.col("kind").isin("date", "year"), "31 December 1999").when(F.col("k") != 15, "blue whale")
    given = F.coalesce(F.when(F.col("event_id") % 3 == 0, wrong), right)
    checked = text.let(lambda answer, said, kind, ref: answers.support(answer, F.array(said), kind, ref), given, F.col("said"), F.col("kind"), F.col("ref"))
    return c.select("event_id", checked.alias("s")).select("event_id", "s.*")


# Rows of one question each

_FIRST = "Which did the user do first, the click or the purchase?"
_BETWEEN = "How many days passed between the first signup and the first purchase?"


@query("qa_option_choice", "SELECT user_id, CASE WHEN p IS NULL OR c <= p THEN 'click' ELSE 'purchase' END AS answer FROM (SELECT user_id, min(ts::date) FILTER (event_type = 'click') AS c, min(ts::date) FILTER (event_type = 'purchase') AS p FROM events GROUP BY user_id) WHERE c IS NOT NULL OR p IS NOT NULL")
def _(spark, sf):
    said = F.concat(F.lit("The "), "event_type", F.lit(" was on "), F.date_format("ts", "MMMM d, yyyy"), F.lit("."))
    rows = table(spark, sf, "events").select("user_id", said.alias("said"), F.lit(_FIRST).alias("question"), F.to_date("ts").alias("ref"))
    return answers.choose(rows.distinct(), ["user_id"], "question", "said", F.col("ref"))


@query("qa_delta", """WITH f AS (SELECT user_id, event_type, min(ts::date) AS day FROM events GROUP BY ALL), d AS (SELECT user_id, day, max((event_type IN ('signup', 'purchase'))::int) AS hit FROM f GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hit DESC, day) AS nth FROM d) SELECT user_id, date_diff('day', min(day), max(day)) AS days FROM r WHERE nth <= 2 GROUP BY user_id HAVING count(*) = 2""")
def _(spark, sf):
    first = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min(F.to_date("ts")).alias("day"))
    said = F.concat(F.lit("The first "), "event_type", F.lit(" was on "), F.date_format("day", "MMMM d, yyyy"), F.lit("."))
    rows = first.select("user_id", said.alias("said"), F.lit(_BETWEEN).alias("question"), F.col("day").alias("ref"))
    return answers.delta_days(rows, ["user_id"], "question", "said", F.col("ref"))


@query("qa_duration_diff", """WITH m AS (SELECT c_custkey, (c_custkey % 20 + 3) * 12 + c_custkey % 12 - (c_custkey % 9 + 1) * 12 AS left_ FROM customer)
SELECT c_custkey, CASE WHEN left_ // 12 > 0 AND left_ % 12 > 0 THEN left_ // 12 || ' years and ' || left_ % 12 || ' months' WHEN left_ // 12 > 0 THEN left_ // 12 || ' years' ELSE left_ % 12 || ' months' END AS answer FROM m WHERE left_ > 0""")
def _(spark, sf):
    i = F.col("c_custkey")
    said = F.concat(F.lit("I have worked professionally for "), i % 20 + 3, F.lit(" years and "), i % 12, F.lit(" months. I am at ACME for "), i % 9 + 1, F.lit(" years now."))
    return answers.duration_before(table(spark, sf, "customer").select("c_custkey", said.alias("said")), ["c_custkey"], "said")


@query("qa_count", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS answer FROM orders GROUP BY o_custkey")
def _(spark, sf):
    said = F.concat(F.lit("The crew leads project "), F.regexp_replace("o_orderpriority", "[^A-Za-z]", ""), F.lit(" since "), F.date_format("o_orderdate", "MMMM d"), F.lit("."))
    return answers.projects(table(spark, sf, "orders").select("o_custkey", said.alias("said")), ["o_custkey"], "said")


_BENCH = (("NUMBER", "How many days did it take?"), ("DATE", "When was the click?"), ("CHOICE", "Which came first, the click or the view?"), ("CHOICE", "Which came first, the click or the view?"), ("NUMBER", "How many boats?"))


@query("qa_reader_bench", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN (user_id + 2) || ' days' WHEN 1 THEN strftime(ts, '%B %-d, %Y') WHEN 2 THEN 'view' WHEN 3 THEN 'click' ELSE user_id::varchar END AS answer FROM events")
def _(spark, sf):
    k = (F.col("event_id") % 5).cast("int")
    pick = lambda i: F.element_at(F.array(*[F.lit(b[i]) for b in _BENCH]), k + 1)
    said = F.array(F.concat(F.lit("It took "), F.col("user_id") + 2, F.lit(" days in all")), F.concat(F.lit("The click was on "), F.date_format("ts", "MMMM d, yyyy"), F.lit(".")), F.lit("The view came before the click."), F.lit("The view came after the click."), F.concat(F.lit("She has "), "user_id", F.lit(" boats")))
    return table(spark, sf, "events").select("event_id", answers.benchmark_answer(pick(1), F.element_at(said, k + 1), pick(0)).alias("answer"))


#: Questions that are asked of every note, with the sentence that answers each.
ASKED = ("What drink do I have now?", "Where are we based?", "How many boats does the clerk have?", "When did Alice paint the sunset?")


def _asked(spark, sf):
    """Sentences of every note beside every question; of sentences and of questions, which are a parameter, words are made once."""
    each = F.array(*[F.struct(F.lit(i).alias("question_id"), F.lit(q).alias("question")) for i, q in enumerate(ASKED)])
    asks = answers.asking(spark.range(1).select(F.inline(each)), "question")
    return answers.telling(notes(spark, sf).select("note_id", "text", F.lit(0).alias("place")), "text").crossJoin(F.broadcast(asks))


def reading(spark, sf):
    ref = F.to_date(F.lit("2024-02-01"))
    return answers.read(_asked(spark, sf), ["note_id", "question_id"], "question", "text", "place", ref)


@query("qa_read")
def _(spark, sf):
    """Answers with their span, or an abstention, to four questions asked of every note."""
    return reading(spark, sf).drop("cited")


@query("qa_extractive", f"""WITH {NOTES_SQL}, s AS (SELECT note_id, unnest(range(len(s))) AS nth, unnest(s) AS sentence FROM (SELECT note_id, {sentences_sql('text')} AS s FROM notes)),
w AS (SELECT *, list_distinct(string_split({normalised_sql('sentence')}, ' ')) AS t FROM s), o AS (SELECT *, len(list_intersect(t, ['alice', 'paint', 'sunset'])) AS shared FROM w)
SELECT note_id, first(sentence ORDER BY shared DESC, nth) AS span FROM o GROUP BY note_id""")
def _(spark, sf):
    """The sentence of each note that shares most words with a question."""
    rows = notes(spark, sf).select("note_id", "text", F.lit(0).alias("place"), F.lit("When did Alice paint the sunset?").alias("question"))
    best = ranking.top_k(answers.ranked_sentences(rows, "question", "text", "place").where("sentence is not null"), ["note_id"], 1, F.desc("score"), F.asc("nth"))
    return best.select("note_id", F.col("sentence").alias("span"))


def _judged(spark, sf):
    """Readings beside what the notes' values say. Both are dealt by customer, so they meet within the tasks in which notes are read, whatever the size of the table."""
    c = dealt(table(spark, sf, "customer"), "c_custkey").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    i = F.col("c_custkey")
    told = lambda k: (i * 7 + k * (k + 1)) % 3 == 0
    gold = [F.when(told(1), F.concat(F.lower("c_mktsegment"), F.lit(" latte with oat milk, mostly"))), F.when(told(4), F.col("n_name")), F.when(told(2), (i % 27 + 2).cast("string")), F.when(told(5), F.concat(i % 27 + 2, F.lit(" "), F.element_at(F.array(*[F.lit(m) for m in MONTHS]), (i % 12 + 1).cast("int")), F.lit(" "), 2000 + i % 24))]
    truth = c.select(i.alias("note_id"), F.array(*[F.coalesce(g, F.lit(answers.NO_ANSWER)) for g in gold]).alias("golds"))
    return reading(spark, sf).join(truth, "note_id").withColumn("gold", F.get("golds", F.col("question_id"))).drop("golds")


@query("agg_qa_metrics")
def _(spark, sf):
    """Exact match, shared words and abstentions by question."""
    words = lambda c: F.split(text.metric_normal(F.col(c)), " ")
    f1 = text.token_f1(words("answer"), words("gold"))
    return _judged(spark, sf).groupBy("question_id").agg(F.count("*").alias("n"), F.round(F.avg(qs.exact_match(F.col("answer"), F.col("gold"))), 9).alias("em"), F.round(F.avg(f1), 9).alias("f1"), F.round(F.avg((F.col("answer") == answers.NO_ANSWER).cast("double")), 9).alias("abstained"))


@query("agg_failure_counts")
def _(spark, sf):
    """Kinds of failure by question: what is expected is the note where it has the answer; candidates and the row cited are what the reader had."""
    j = _judged(spark, sf)
    expected = F.when(F.col("gold") != answers.NO_ANSWER, F.array("note_id")).otherwise(F.array().cast("array<bigint>"))
    final = F.when(F.col("cited").isNotNull(), F.array("note_id")).otherwise(F.array().cast("array<bigint>"))
    kind = qs.failure_kind(F.col("answer"), F.col("gold"), expected, F.array("note_id"), final, F.col("status"))
    return j.groupBy("question_id", kind.alias("kind")).agg(F.count("*").alias("n"))


@query("set_evidence_overlap", f"WITH {_bm25_sql('documents', 'text', 'doc_id', 10)}, good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) SELECT query_id, bool_or(g.doc_id IS NOT NULL) AS retrieved, bool_or(g.doc_id IS NOT NULL AND rank <= 3) AS kept FROM bm25 LEFT JOIN good g ON g.doc_id = id GROUP BY query_id")
def _(spark, sf):
    """Whether good documents are among the candidates of a query, and among its first three."""
    hits = documents_index(spark, sf).search(queries_frame(spark), "doc_id", k=10)
    expected = table(spark, sf, "labels").where("quality = 1").select("doc_id").distinct().withColumn("good", F.lit(True))
    sets = hits.join(expected, "doc_id", "left").groupBy("query_id").agg(F.collect_set("doc_id").alias("candidates"), F.collect_set(F.when(F.col("rank") <= 3, F.col("doc_id"))).alias("final"), F.collect_set(F.when(F.col("good"), F.col("doc_id"))).alias("expected"))
    return sets.select("query_id", F.arrays_overlap("expected", "candidates").alias("retrieved"), F.arrays_overlap("expected", "final").alias("kept"))


# Profiles and variants


def _has(words, of: str = "t") -> str:
    return f"len(list_intersect({of}, ['{chr(39).join(words).replace(chr(39), chr(39) + ', ' + chr(39))}'])) > 0"


def _any(phrases, of: str = "l") -> str:
    return "(" + " OR ".join(f"contains({of}, '{p}')" for p in phrases) + ")"


_ASKED = f"{_Q}, a AS (SELECT question_id, question, lower(trim(question)) AS l, t FROM n)"
_SELF = rf"({_has(qs.FIRST_PERSON)} OR regexp_matches(l, '\b(?:am|was|were)\s+i\b'))"
_LITERAL = rf"(({_any(qs.RECALL_PHRASES)} OR regexp_matches(l, '\b(?:what was|what were|what did|which one|the one)\b')) AND ({_has(('you', 'chat', 'conversation', 'discussed', 'talked'))} OR {_any(qs.SAID_PHRASES)} OR regexp_matches(l, '\b[0-9]+(?:st|nd|rd|th)\b') OR {_has(qs.LISTED)}))"


@query("ret_profile", f"WITH {_ASKED} SELECT question_id, {_SELF} AS first_person, {_SELF} AND ({_has(qs.STATE_NOW)} OR {_any(qs.STATE_NOW_PHRASES)}) AS current, {_SELF} AND ({_has(qs.STATE_PAST)} OR {_any(qs.STATE_PAST_PHRASES)}) AS history, len(t) >= 5 AND {_any((' and ', ',', ' plus '))} AS facets FROM a")
def _(spark, sf):
    return _questions(spark, sf).select("question_id", qs.profile(F.col("question")).alias("p")).select("question_id", "p.first_person", "p.current", "p.history", "p.facets")


@query("ret_literal", f"WITH {_ASKED} SELECT question_id, {_LITERAL} AS literal, {_LITERAL} AND ({_has(qs.SAID_WORDS)} OR {_any(qs.SAID_PHRASES)}) AS assistant FROM a")
def _(spark, sf):
    return _questions(spark, sf).select("question_id", qs.profile(F.col("question")).alias("p")).select("question_id", "p.literal", "p.assistant")


_HINTED = [f"CASE WHEN {_has(words)} OR {_any(phrases)} THEN '{relation}' END" for relation, words, phrases in qs.HINTS]
_DRINK = f"CASE WHEN ({_has(qs.HINTS[-1][1])} OR {_any(qs.HINTS[-1][2])}) AND ({_has(qs.DRINKS)} OR contains(l, 'sparkling water')) THEN 'movie_drink' END"


@query("ret_relation_hints", f"WITH {_ASKED} SELECT question_id, array_to_string(list_filter([{', '.join(_HINTED)}, {_DRINK}], lambda x: x IS NOT NULL), ',') AS hints FROM a")
def _(spark, sf):
    return _questions(spark, sf).select("question_id", F.array_join(qs.relation_hints(F.col("question")), ",").alias("hints"))


def _expand_sql() -> str:
    lists = [f"CASE WHEN contains(l, '{p}') THEN {list(words)} ELSE [] END" for p, words in qs.EXPAND_PHRASES] + [f"CASE WHEN list_contains(w, '{x}') THEN {list(words)} ELSE [] END" for x, words in qs.EXPAND_WORDS]
    return f"WITH {_ASKED}, x AS (SELECT *, flatten([{', '.join(lists)}]) AS m FROM (SELECT *, regexp_extract_all(l, '[a-z0-9_]+') AS w FROM a)), y AS (SELECT question_id, question, list_filter(m, lambda x, i: list_position(m, x) = i AND NOT list_contains(w, x))[1:{qs.MOST_EXTRA}] AS e FROM x) SELECT question_id, trim(question) || CASE WHEN len(e) > 0 THEN ' ' || array_to_string(e, ' ') ELSE '' END AS expanded FROM y"


@query("ret_expand_query", _expand_sql())
def _(spark, sf):
    return _questions(spark, sf).select("question_id", qs.expanded(F.col("question")).alias("expanded"))


@query("ret_variants")
def _(spark, sf):
    return _questions(spark, sf).select("question_id", F.posexplode(qs.keyword_variants(F.col("question"))).alias("variant", "v")).select("question_id", "variant", "v.query", "v.weight")


@query("qa_variants")
def _(spark, sf):
    return _questions(spark, sf).select("question_id", F.posexplode(qs.recall_variants(F.col("question"))).alias("variant", "v")).select("question_id", "variant", "v.query", "v.weight")
