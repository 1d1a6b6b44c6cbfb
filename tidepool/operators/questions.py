"""Question analysis as Column expressions: intent, answer type, route, profile, weights, verification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepool.operators.text import let, normalised

#: Terms of question analysis. Fixed values.
TEMPORAL = ("when", "before", "after", "timeline", "history", "previous", "earlier", "later", "recent", "latest", "last", "current", "currently", "now", "today")
ENTITY = ("who", "id", "symbol", "ticker", "account", "email", "name", "exact", "lookup", "find")
TABLE = ("table", "column", "row", "schedule", "shift", "spreadsheet", "csv", "markdown")
LIST = ("list", "all", "which", "items", "options", "tasks", "projects")
TIME = ("when", "date", "year", "before", "after", "between", "earlier", "later", "last", "first", "how many days", "how long")
SPAN = ("between", "how many days", "how long")
NOW = ("current", "currently", "now", "latest", "present")
PAST = ("used to", "previous", "previously", "former", "formerly", "old", "past")
SESSION = r"\b(session|conversation|chat|round|turn|said earlier|mentioned before)\b"
RELATIONSHIP = ("relationship status", "single", "married", "dating")
PREFERENCE = ("prefer", "favorite", "favourite", "like", "order", "drink", "bag", "notebook")
YES_NO = ("is", "are", "was", "were", "do", "does", "did", "can", "could", "should", "has", "have")
NULL_ANSWERS = ("unknown", "not mentioned", "not specified", "not enough information", "insufficient information", "no answer", "none")


def any_of(text: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms])


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_\-]+"), F.lit(0))


def _has(tokens: Column, terms: tuple[str, ...]) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in terms]))


def intent(question: Column) -> Column:
    """entity_lookup, temporal or conceptual. Quotes come first; capitals are looked for in the question as it was typed."""
    q = F.lower(F.trim(question))
    t = _tokens(q)
    return (
        F.when(F.contains(q, F.lit('"')) | F.contains(q, F.lit("'")), "entity_lookup")
        .when(_has(t, TEMPORAL), "temporal")
        .when(_has(t, ENTITY), "entity_lookup")
        .when(q.rlike("[a-z]+[-_][a-z0-9]+"), "entity_lookup")
        .when(question.rlike(r"(^|[^A-Za-z0-9_])[A-Z]{2,}([^A-Za-z0-9_]|$)"), "entity_lookup")
        .otherwise("conceptual")
    )


def answer_type(question: Column) -> Column:
    return let(typed, normalised(question))


def typed(q: Column) -> Column:
    """Of a question in normal form."""
    return (
        F.when(q == "", "free_text")
        .when(F.startswith(q, F.lit("how many")) | F.contains(F.concat(F.lit(" "), q, F.lit(" ")), F.lit(" number of ")), "count")
        .when(F.startswith(q, F.lit("what year")) | F.contains(q, F.lit("which year")), "year")
        .when(F.startswith(q, F.lit("when")) | F.contains(q, F.lit("what date")), "date")
        .when(F.startswith(q, F.lit("who")), "person")
        .when(F.startswith(q, F.lit("where")), "location")
        .when(any_of(q, RELATIONSHIP), "relationship_status")
        .when(any_of(q, PREFERENCE), "preference")
        .when(F.split(q, " ")[0].isin(*YES_NO), "yes_no")
        .otherwise("free_text")
    )


def plan(question: Column) -> Column:
    """struct(route, answer_type, intents, confidence)."""
    return let(_plan, normalised(question))


def _plan(q: Column) -> Column:
    table, listed = any_of(q, TABLE), any_of(F.concat(F.lit(" "), q, F.lit(" ")), tuple(f" {t} " for t in LIST))
    time, span, now, past, session = any_of(q, TIME), any_of(q, SPAN), any_of(q, NOW), any_of(q, PAST), q.rlike(SESSION)
    first = F.when(table, "table_lookup").when(listed, "list_lookup").otherwise("direct_recall")
    timed = F.when(time & ((first == "direct_recall") | span), "temporal_math").otherwise(first)
    current = F.when(now & (timed == "direct_recall"), "current_state").otherwise(timed)
    former = F.when(past & current.isin("direct_recall", "current_state"), "historical_state").otherwise(current)
    route = F.when(session & (former == "direct_recall"), "multi_session").otherwise(former)
    score = {"table_lookup": 0.78, "list_lookup": 0.62}
    confidence = F.greatest(
        F.when(table, score["table_lookup"]).when(listed, score["list_lookup"]).otherwise(0.35),
        F.when(timed != first, 0.70).otherwise(0.0), F.when((current != timed) | (former != current), 0.72).otherwise(0.0), F.when(route != former, 0.66).otherwise(0.0),
    )
    intents = F.array_compact(F.array(F.when(table, "structured_table"), F.when(listed & ~table, "enumeration"), F.when(time, "temporal"), F.when(now, "current_state"), F.when(past, "historical_state"), F.when(session, "cross_session")))
    return F.struct(route.alias("route"), typed(q).alias("answer_type"), intents.alias("intents"), confidence.alias("confidence"))


def weights(intent_: Column, keyword: float = 0.3, vector: float = 0.7) -> tuple[Column, Column]:
    """Keyword and vector weights of an intent, summing to one."""
    kw = F.lit(keyword) * F.when(intent_ == "entity_lookup", 2.0).when(intent_ == "temporal", 1.3).otherwise(0.6)
    vec = F.lit(vector) * F.when(intent_ == "entity_lookup", 0.5).when(intent_ == "temporal", 0.9).otherwise(1.5)
    return kw / (kw + vec), vec / (kw + vec)


def abstains(answer: Column) -> Column:
    return let(lambda n: (n == "") | any_of(n, NULL_ANSWERS), normalised(answer))


def exact_match(pred: Column, gold: Column) -> Column:
    """1.0 for equal normal forms, or for one inside the other while the longer has at most max(3, 2.5 x) its words."""
    n = lambda c: F.size(F.split(c, " "))
    limit = lambda c: F.greatest(F.lit(3).cast("long"), F.floor(n(c) * 2.5))
    hit = lambda p, g: (p == g) | (F.contains(g, p) & (n(g) <= limit(p))) | (F.contains(p, g) & (n(p) <= limit(g)))
    return let(lambda p, g: F.when((p != "") & (g != "") & hit(p, g), 1.0).otherwise(0.0), normalised(pred), normalised(gold))


def failure_kind(pred: Column, gold: Column, expected: Column, candidates: Column, final: Column, status: Column) -> Column:
    """The taxonomy of failed answers; id lists are arrays."""
    return let(_failure_kind, exact_match(pred, gold), abstains(gold), abstains(pred), F.length(gold) > 0, expected, candidates, final, status)


def _failure_kind(em: Column, gold_none: Column, pred_none: Column, has_gold: Column, expected: Column, candidates: Column, final: Column, status: Column) -> Column:
    return (
        F.when(has_gold & (em >= 1.0), F.when(status.isin("unsupported", "partial"), "evidence_present_answer_unverified").otherwise("success"))
        .when(has_gold & gold_none & ~pred_none, "abstain_false_negative")
        .when((F.size(expected) > 0) & ~F.arrays_overlap(expected, candidates), "retrieval_miss")
        .when((F.size(expected) > 0) & ~F.arrays_overlap(expected, final), "rerank_miss")
        .when(pred_none & ~(has_gold & gold_none), "abstain_false_positive")
        .when(status == "unsupported", "unsupported_answer")
        .when((F.size(expected) > 0) & status.isin("partial", "unchecked"), "evidence_present_answer_unverified")
        .when(F.size(expected) > 0, "evidence_present_answer_wrong")
        .otherwise("unknown")
    )


def write_action(similarity: Column, noop: float = 0.92, update: float = 0.80) -> Column:
    return F.when(similarity >= noop, "NOOP").when(similarity >= update, "UPDATE").otherwise("ADD")


def softmax(scores: dict[str, Column]) -> Column:
    """struct(action, confidence) of the largest of the linear scores."""
    exps = {name: F.exp(c) for name, c in scores.items()}
    total = reduce(lambda a, b: a + b, exps.values())
    best = F.greatest(*[F.struct((e / total).alias("confidence"), F.lit(name).alias("action")) for name, e in exps.items()])
    return F.struct(best.action.alias("action"), best.confidence.alias("confidence"))


# Profiles and variants of a question. Fixed values.

FIRST_PERSON = ("i", "me", "my", "mine", "myself")
STATE_NOW = ("current", "currently", "today", "now", "present", "latest")
STATE_NOW_PHRASES = ("these days", "right now", "at the moment", "home base")
STATE_PAST = ("before", "previous", "previously", "earlier", "formerly", "history", "historical", "changed", "change", "changes", "leave", "left", "old", "older", "replaced", "replace", "from")
STATE_PAST_PHRASES = ("used to", "left behind", "moved from", "move on from", "moved on from", "move from", "old city", "old bag", "older city", "from winter to spring", "from spring to", "what changed", "what did i move")
RECALL_PHRASES = ("remind me", "previous chat", "previous conversation", "our previous conversation", "our previous chat", "last time", "earlier", "we discussed", "we talked about", "going back to our previous conversation", "going back to our previous chat")
SAID_PHRASES = ("you recommended", "you provided", "you suggested", "you mentioned", "you told me", "you said")
SAID_WORDS = ("you", "recommended", "provided", "suggested", "said", "told")
LISTED = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "list")
#: Relation, words and phrases that hint at it.
HINTS = (
    ("location", ("where", "based", "base", "live", "living", "city", "location", "home"), ("home base", "based these days", "based now", "where am i")),
    ("coffee_order", ("coffee", "espresso", "latte", "cappuccino", "americano", "flat", "white", "milk"), ("coffee order", "espresso order", "espresso drink", "drink order")),
    ("bag", ("bag", "bags", "pack", "backpack", "backpacks", "carry"), ("everyday carry", "workday bag")),
    ("notebook", ("notebook", "journal", "field", "notes", "moleskine"), ("field notes", "paper notebook")),
    ("charger", ("charger", "charging", "battery", "power"), ("power bank",)),
    ("flight_seat", ("seat", "aisle", "window", "middle", "plane", "planes", "flight", "boarding"), ("aisle seat", "window seat")),
    ("movie_snack", ("movie", "movies", "theater", "theatre", "film", "films", "concession", "snack", "popcorn", "kettle", "corn"), ("movie night", "theater snack", "theatre snack")),
)
DRINKS = ("drink", "drinks", "water", "sparkling")
#: Words that a question gets besides its own, by phrase and by word.
EXPAND_PHRASES = (("how many", ("number", "count", "total")), ("how much", ("amount", "total", "quantity")), ("what year", ("year", "date", "time")), ("what date", ("date", "year", "time")))
EXPAND_WORDS = (("who", ("person", "name")), ("when", ("date", "year", "time")), ("where", ("location", "place")), ("owner", ("owns", "owned", "ownership")), ("wrote", ("author", "written", "writer")), ("founded", ("founder", "established")), ("capital", ("capital_city", "city")))
MOST_EXTRA = 4
CORE_STOP = ("about", "after", "before", "current", "currently", "does", "have", "many", "that", "their", "there", "what", "when", "where", "which", "with", "would")
TABLE_STOP, LIST_STOP, TIME_STOP = ("which", "what", "where", "when", "table", "column", "row"), ("all", "which", "list", "items"), ("when", "date", "year", "before", "after")
QUERY_STOP = (
    "a", "an", "the", "is", "are", "was", "were", "of", "in", "on", "for", "and", "or", "with", "what", "when", "who", "where", "which", "did", "do",
    "does", "at", "by", "as", "it", "be", "this", "that", "how", "many", "much", "kind", "type", "into", "about",
)


def profile(question: Column) -> Column:
    """struct(first_person, current, history, facets, literal, assistant)."""
    return let(lambda q: let(_profile, q, _tokens(q)), F.lower(F.trim(question)))


def _profile(q: Column, t: Column) -> Column:
    first = _has(t, FIRST_PERSON) | q.rlike(r"\b(?:am|was|were)\s+i\b")
    recall = any_of(q, RECALL_PHRASES) | q.rlike(r"\b(?:what was|what were|what did|which one|the one)\b")
    spoken = _has(t, ("you", "chat", "conversation", "discussed", "talked")) | any_of(q, SAID_PHRASES)
    literal = recall & (spoken | q.rlike(r"\b[0-9]+(?:st|nd|rd|th)\b") | _has(t, LISTED))
    return F.struct(
        first.alias("first_person"), (first & (_has(t, STATE_NOW) | any_of(q, STATE_NOW_PHRASES))).alias("current"), (first & (_has(t, STATE_PAST) | any_of(q, STATE_PAST_PHRASES))).alias("history"),
        ((F.size(t) >= 5) & any_of(q, (" and ", ",", " plus "))).alias("facets"), literal.alias("literal"), (literal & (_has(t, SAID_WORDS) | any_of(q, SAID_PHRASES))).alias("assistant"),
    )


def relation_hints(question: Column) -> Column:
    """Relations that a question asks after, in their order."""
    q = F.lower(F.trim(question))
    t = _tokens(q)
    hinted = [(relation, _has(t, words) | any_of(q, phrases)) for relation, words, phrases in HINTS]
    snack = hinted[-1][1]
    drink = snack & (_has(t, DRINKS) | F.contains(q, F.lit("sparkling water")))
    return F.array_compact(F.array(*[F.when(cond, relation) for relation, cond in hinted], F.when(drink, "movie_drink")))


def expanded(question: Column) -> Column:
    """The question with up to four more words; those of phrases come first, then those of its words in the table's order."""
    q = F.lower(F.trim(question))
    t = F.regexp_extract_all(q, F.lit("[a-z0-9_]+"), F.lit(0))
    some = lambda cond, words: F.when(cond, F.array(*[F.lit(w) for w in words])).otherwise(F.array().cast("array<string>"))
    more = F.flatten(F.array(*[some(F.contains(q, F.lit(p)), words) for p, words in EXPAND_PHRASES], *[some(F.array_contains(t, w), words) for w, words in EXPAND_WORDS]))
    extra = F.slice(F.array_except(more, t), 1, MOST_EXTRA)  # array_except keeps the first of equal words
    return F.when(F.size(extra) > 0, F.concat(F.trim(question), F.lit(" "), F.array_join(extra, " "))).otherwise(F.trim(question))


def _first_of_equal(variants: Column) -> Column:
    """Variants without empty and repeated queries (case does not matter), in order."""
    clean = F.transform(variants, lambda v: F.struct(F.trim(F.regexp_replace(v.query, r"\s+", " ")).alias("query"), v.weight.alias("weight")))
    first = lambda rows, keys: F.filter(rows, lambda v, i: (v.query != "") & (F.array_position(keys, F.lower(v.query)) == i + 1))
    return let(lambda rows: let(first, rows, F.transform(rows, lambda v: F.lower(v.query))), clean)


def keyword_variants(question: Column) -> Column:
    """array of struct(query, weight): what a keyword search asks for a question, by its route."""
    t = F.filter(_tokens(F.trim(question)), lambda x: F.length(x) > 2)
    return let(_keyword_variants, question, plan(question).route, profile(question), expanded(question), t, relation_hints(question))


def _keyword_variants(question: Column, route: Column, p: Column, wide: Column, t: Column, hints: Column) -> Column:
    but = lambda words: F.array_except(t, F.array(*[F.lit(w) for w in words]))
    core = F.slice(F.when(route == "table_lookup", but(CORE_STOP + ("table", "column", "row"))).when(route == "list_lookup", but(CORE_STOP + ("list", "items", "options"))).otherwise(but(CORE_STOP)), 1, 12)
    joined = lambda *parts: F.array_join(F.concat(*parts), " ")
    focused = F.when(route == "table_lookup", F.array_join(F.slice(but(TABLE_STOP), 1, 8), " ")).when(route == "list_lookup", F.array_join(F.slice(but(LIST_STOP), 1, 10), " ")).when(route == "temporal_math", F.array_join(F.slice(but(TIME_STOP), 1, 10), " ")).when(route.isin("current_state", "historical_state") & (F.size(hints) > 0), joined(hints, F.slice(t, 1, 6))).otherwise("")
    focus_weight = F.when(route.isin("table_lookup", "current_state", "historical_state"), 0.9).when(route == "list_lookup", 0.86).otherwise(0.84)
    quoted = F.regexp_extract_all(question, F.lit("['\"]([^'\"]{2,80})['\"]"), F.lit(1))
    names = F.slice(F.regexp_extract_all(question, F.lit(r"\b[A-Z][a-z0-9]+(?:\s+[A-Z][a-z0-9]+){0,2}\b"), F.lit(0)), 1, 4)
    v = lambda q, w: F.struct(q.alias("query"), (w if isinstance(w, Column) else F.lit(w)).alias("weight"))
    both = [v(wide, 1.0), v(question, 0.92)]
    literal = F.array(*both, v(F.when(p.assistant, F.concat(question, F.lit(" assistant recommended suggested"))).otherwise(""), 0.86))
    planned = F.array(*both, v(F.array_join(core, " "), 0.88), v(F.when(F.size(hints) > 0, joined(hints, F.slice(t, 1, 8))).otherwise(""), 0.82), v(focused, focus_weight), *[v(F.coalesce(F.get(quoted, F.lit(i)), F.lit("")), 0.8) for i in range(3)], v(F.array_join(names, " "), 0.78))
    return _first_of_equal(F.when(p.literal, literal).when(route == "direct_recall", F.array(v(wide, 1.0))).otherwise(planned))


def recall_variants(question: Column) -> Column:
    """array of struct(query, weight): the forms in which a recall is tried."""
    stripped = F.when(F.lower(F.split(question, " ")[0]).isin("what", "when", "where", "who", "which", "how") & (F.size(F.split(question, " ")) > 2), F.regexp_replace(question, r"^\S+\s+", "")).otherwise("")
    words = F.filter(F.regexp_extract_all(question, F.lit("[a-z0-9_]+"), F.lit(0)), lambda w: (F.length(w) > 1) & ~w.isin(*QUERY_STOP))
    keywords = F.array_join(F.slice(words, 1, 10), " ")
    names = F.array_join(F.slice(F.array_distinct(F.filter(F.regexp_extract_all(question, F.lit(r"\b[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})?\b"), F.lit(0)), lambda x: ~F.split(x, " ")[0].isin("What", "When", "Where", "Who", "Which", "How", "Why", "Did", "Does", "Are", "Was", "Were"))), 1, 4), " ")
    v = lambda q, w: F.struct(q.alias("query"), F.lit(w).alias("weight"))
    both = F.when((names != "") & (keywords != ""), F.concat(names, F.lit(" "), keywords)).otherwise("")
    return _first_of_equal(F.array(v(question, 1.0), v(stripped, 0.65), v(keywords, 0.60), v(names, 0.62), v(both, 0.66)))
