"""Answers on sentences that are known, and the reader against a plain version of it."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from tidepool.operators import answers, text
from tidepool.operators import questions as qs
from tidepool.plans import registry
from tidepool.plans.q_answers import ASKED, _judged
from tidepool.plans.q_questions import _questions
from tidepool.plans.tables import notes

SF = "/root/testdata/sf0.001"
DAY = datetime.date(2024, 3, 31)  # a Sunday


@pytest.mark.parametrize(
    ("kind", "said", "answer"),
    [
        ("date", "a couple of things, two weeks ago", "17 March 2024"),
        ("date", "roughly 1 month ago", "29 February 2024"),
        ("date", "last Sunday", "24 March 2024"),
        ("date", "recently", "28 March 2024"),
        ("date", "mid-April 2023", "15 April 2023"),
        ("date", "on 3rd sept 2021", "3 September 2021"),
        ("date", "2/30", "2/30"),
        ("date", "1/2/69", "2 January 2069"),
        ("date", "1/2/70", "2 January 1970"),
        ("date", "in 1999", "1999"),
        ("date", "no idea at all", "no idea at all"),
        ("year", "next year", "2025"),
        ("count", "about twelve of them", "12"),
        ("number", "3.5 kg", "3.5"),
        ("yes_no", "That is FALSE.", "no"),
        ("list", "a and b,, c", "a, b, c"),
        ("free_text", "Not mentioned.", answers.NO_ANSWER),
        ("free_text", None, answers.NO_ANSWER),
    ],
)
def test_normal_forms(spark, kind, said, answer):
    df = spark.createDataFrame([(said, kind, DAY)], "said string, kind string, ref date")
    assert df.select(answers.normal(F.col("said"), F.col("kind"), F.col("ref")).answer.alias("a")).first().a == answer


@pytest.mark.parametrize(
    ("answer", "spans", "kind", "computed", "status", "confidence"),
    [
        ("", ["x"], "free_text", False, "abstained", 1.0),
        ("Oslo", [], "location", False, "unsupported", 0.0),
        ("30 March 2024", ["It was yesterday."], "date", False, "supported", 0.86),
        ("9", ["from June to July"], "count", True, "supported", 0.82),
        ("2", ["red car", "blue car"], "count", False, "supported", 0.72),
        ("red old car", ["the car is red"], "free_text", False, "partial", 0.48),
        ("yes", ["she is there"], "yes_no", False, "partial", 0.45),
        ("Rome", ["she is there"], "location", False, "unsupported", 0.0),
    ],
)
def test_support(spark, answer, spans, kind, computed, status, confidence):
    df = spark.createDataFrame([(answer, spans, kind, computed, DAY)], "answer string, spans array<string>, kind string, computed boolean, ref date")
    got = df.select(answers.support(F.col("answer"), F.col("spans"), F.col("kind"), F.col("ref"), F.col("computed")).alias("s")).first().s
    assert (got.status, got.confidence) == (status, confidence)


def test_choice_and_differences(spark):
    rows = [("Which device arrived last, the Dell laptop or the Samsung phone?", "The laptop arrived on March 3, 2024. The phone arrived last Tuesday."), ("Which came first, tea or milk?", "Nothing was dated.")]
    df = spark.createDataFrame([(i, q, s, DAY) for i, (q, s) in enumerate(rows)], "id long, question string, said string, ref date")
    assert [tuple(r) for r in answers.choose(df, ["id"], "question", "said", F.col("ref")).collect()] == [(0, "Samsung phone")]
    df = spark.createDataFrame([(1, "How many days between the move and the party?", "The move was on June 1. The party was on June 9. Rent is due on July 1.", DAY)], "id long, question string, said string, ref date")
    assert [tuple(r) for r in answers.delta_days(df, ["id"], "question", "said", F.col("ref")).collect()] == [(1, 8)]
    df = spark.createDataFrame([(1, "I have worked professionally for 9 years and 3 months. I have been in my current job for 4 years and 5 months."), (2, "I am at ACME for 9 years.")], "id long, said string")
    assert [tuple(r) for r in answers.duration_before(df, ["id"], "said").collect()] == [(1, "4 years and 10 months")]
    df = spark.createDataFrame([(1, "She led project Alpha. He leads Project ALPHA too. They are leading Beta9."), (2, "Nothing.")], "id long, said string")
    assert [tuple(r) for r in answers.projects(df, ["id"], "said").collect()] == [(1, 2)]


def test_metrics(spark):
    df = spark.createDataFrame([("2", "twice"), ("The Quick, Brown Fox!", "quick brown fox"), ("a b b", "b b c")], "p string, g string")
    words = lambda c: F.split(text.metric_normal(F.col(c)), " ")
    got = [tuple(r) for r in df.select(text.metric_normal(F.col("g")), F.round(text.token_f1(words("p"), words("g")), 6), qs.exact_match(F.col("p"), F.col("g"))).collect()]
    assert got == [("2", 1.0, 0.0), ("quick brown fox", 1.0, 1.0), ("b b c", 0.8, 1.0)]


def test_variants_drop_equal_queries(spark):
    for name in ("ret_variants", "qa_variants"):
        seen: dict = {}
        for r in registry.queries()[name](spark, SF).orderBy("question_id", "variant").collect():
            seen.setdefault(r.question_id, []).append((r.query, r.weight))
        for question, rows in seen.items():
            assert rows[0][1] == 1.0 and len({q.lower() for q, _ in rows}) == len(rows), question
            assert all(q and q == q.strip() for q, _ in rows)
    profile = lambda q: spark.createDataFrame([(q,)], "q string").select(qs.profile(F.col("q")).alias("p")).first().p
    assert profile("Remind me what was the 3rd book you recommended?").literal and profile("Remind me what was the 3rd book you recommended?").assistant
    assert profile("Where am I based these days?").current and not profile("Where is she based these days?").current
    hints = spark.createDataFrame([("which snack and sparkling water at movie night",)], "q string").select(qs.relation_hints(F.col("q")).alias("h")).first().h
    assert hints == ["movie_snack", "movie_drink"]
    wide = spark.createDataFrame([("How many books, when?",), ("plain words",)], "q string").select(qs.expanded(F.col("q")).alias("e")).collect()
    assert [r.e for r in wide] == ["How many books, when? number count total date", "plain words"]


# The reader in plain Python

KINDS = ("preference", "location", "count", "date")
MONTHS = "January February March April May June July August September October November December".split()


def norm(x):
    number = {w: str(i) for i, w in enumerate(text.NUMBER_WORDS)}
    return " ".join(number.get(w, w) for w in re.sub("[^a-z0-9]+", " ", x.lower()).split() if w not in ("a", "an", "the"))


def words(x):
    kept = [w for w in norm(x).split() if len(w) > 1 and w not in answers.STOP]
    return set(kept) | {w[:-1] for w in kept if w.endswith("s") and len(w) > 3}


def plain_read(question, kind, said):
    sentences = [s.strip() for line in said.split("\n") for s in re.split(r"(?<=[.!?])[ \t]+", line) if s.strip()]
    now = bool(set(norm(question).split()) & set(answers.CURRENT))
    ranked = []
    for i, s in enumerate(sentences):
        was = "used to" in norm(s) or bool(set(norm(s).split()) & set(answers.FORMER))
        is_ = bool(set(norm(s).split()) & set(answers.CURRENT))
        ranked.append((-(len(words(question) & words(s)) / len(words(question)) + now * (0.45 * is_ - 0.65 * was)), i, s))
    for _, _, s in sorted((round(a, 6), i, s) for a, i, s in ranked):
        if kind == "preference":
            m = re.search(r"(?i)\b(?:prefers?|likes?|favo(?:u)?rite\s+(?:\w+\s+)?(?:is|was)|order\s+(?:is|was)|uses?|carries?)\s+([^.;!?]+)", s) or re.search(r"(?i)\b(?:coffee|drink|bag|notebook)\s+(?:now\s+)?(?:order\s+)?(?:is|was)\s+([^.;!?]+)", s)
            raw = m and re.sub(r"(?i)\b(?:now|currently|these days)\b", "", m[1])
        elif kind == "location":
            m = re.search(r"\b(?:live|lives|living|based|moved)\s+(?:in|to|near|at)\s+([A-Z][A-Za-z0-9_ .'-]+)", s)
            raw = m and m[1]
        elif kind == "count":
            m = re.search(r"\b\d+(?:\.\d+)?\b", s)
            raw = m[0] if m else next((str(i) for i, w in enumerate(text.NUMBER_WORDS) if re.search(rf"\b{w}\b", s.lower())), None)
        else:
            m = re.search(rf"\b({'|'.join(MONTHS)}) (\d+), (\d+)", s)
            if m:
                raw = f"{int(m[2])} {m[1]} {m[3]}"
            else:
                m = re.search(r"\b(3)/(\d+)\b", s)
                raw = (f"{int(m[2])} March 2024" if int(m[2]) <= 31 else m[0]) if m else None
                iso = re.search(r"\b(\d{4})-06-(\d\d)\b", s)
                if iso:
                    raw = f"{int(iso[2])} June {iso[1]}"
        if raw:
            return re.sub(r"\s+", " ", raw).strip(" \"'`.,;:")
    return answers.NO_ANSWER


def test_reading_against_a_plain_reader(spark):
    want = {(r.note_id, i): plain_read(q, KINDS[i], r.text) for r in notes(spark, SF).collect() for i, q in enumerate(ASKED)}
    got = {(r.note_id, r.question_id): r for r in registry.queries()["qa_read"](spark, SF).collect()}
    assert set(got) == set(want)
    wrong = {k: (got[k].answer, want[k]) for k in want if got[k].answer != want[k]}
    assert len(wrong) == 0, dict(list(wrong.items())[:5])
    assert {got[k].status for k in want if want[k] == answers.NO_ANSWER} <= {"abstained", "unsupported"}


def test_metrics_of_the_reader(spark):
    m = {r.question_id: r for r in registry.queries()["agg_qa_metrics"](spark, "/root/testdata/sf0.01").collect()}
    assert sum(r.n for r in m.values()) == 6000 and all(0 <= r.em <= 1 and 0 <= r.f1 <= 1 for r in m.values())
    failures = registry.queries()["agg_failure_counts"](spark, "/root/testdata/sf0.01").collect()
    assert sum(r.n for r in failures) == 6000
    for i, r in m.items():  # answers that are right are successes, unless they were read out of too little
        right = sum(x.n for x in failures if x.question_id == i and x.kind == "success")
        assert right <= round(r.em * r.n) <= right + sum(x.n for x in failures if x.question_id == i and x.kind == "evidence_present_answer_unverified")


def test_words_of_a_sentence_are_made_once_for_all_questions(spark):
    for name in ("qa_read", "agg_qa_metrics", "agg_failure_counts"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < plan.index("Join Cross") < plan.index("Generate posexplode(filter"), plan
        assert plan.count("Join Cross") == 1


@pytest.mark.parametrize("name", ["agg_qa_metrics", "agg_failure_counts"])
def test_readings_are_judged_where_they_are_read(spark, name):
    """Readings and truths do not travel: what is joined in a task is what was dealt to it, and only counts are shuffled."""
    plan = registry.queries()[name](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\((.*), (\d+)\), (\w+)", plan)
    assert {(re.sub(r"#\d+L?", "", k), how) for k, n, how in keys if "question_id" not in k} == {("c_custkey", "REPARTITION_BY_NUM")}, plan
    assert not [k for k, _, _ in keys if "note_id" in k], plan
    assert {n for k, n, how in keys if how == "REPARTITION_BY_NUM"} == {"4"}  # 15,000 customers


def test_truths_of_all_notes_and_questions(spark):
    nations = {r.n_nationkey: r.n_name for r in spark.read.parquet(f"{SF}/nation.parquet").collect()}
    want = {}
    for r in spark.read.parquet(f"{SF}/customer.parquet").collect():
        i, told = r.c_custkey, lambda k, i=r.c_custkey: (i * 7 + k * (k + 1)) % 3 == 0
        said = (f"{r.c_mktsegment.lower()} latte with oat milk, mostly", nations[r.c_nationkey], str(i % 27 + 2), f"{i % 27 + 2} {MONTHS[i % 12]} {2000 + i % 24}")
        want |= {(i, q): said[q] if told(k) else answers.NO_ANSWER for q, k in enumerate((1, 4, 2, 5))}
    rows = _judged(spark, SF).collect()
    assert len(rows) == len(want) and {(r.note_id, r.question_id): r.gold for r in rows} == want


def test_answers_that_are_no_whole_numbers(spark):
    df = spark.createDataFrame([("infinity", "so many"), ("9999999999", "so many"), ("", "so many")], "a string, s string")
    got = [r.c.status for r in df.select(answers.support(F.col("a"), F.array("s"), F.lit("count"), F.to_date(F.lit("2024-02-01"))).alias("c")).collect()]
    assert got == ["unsupported", "unsupported", "abstained"]


def test_questions_are_dealt_however_few_row_groups_their_files_have(spark):
    """15,000 customers are one row group of sf0.1."""
    asked = _questions(spark, "/root/testdata/sf0.1").select(F.split("question_id", " ")[0].alias("of"), F.spark_partition_id().alias("task"))
    tasks = {r["of"]: (r.tasks, r.most) for r in asked.groupBy("of", "task").count().groupBy("of").agg(F.count("*").alias("tasks"), F.max("count").alias("most")).collect()}
    assert tasks["customer"][0] == 4 and tasks["customer"][1] < 5000


def test_rows_without_sentences_have_an_answer_and_no_span(spark):
    rows = spark.createDataFrame([(1, "Where are you based?", " \n", 0), (2, "Where are you based?", None, 0), (3, "", "We are based in Rome.", 0)], "id long, q string, said string, place int")
    got = {r.id: r for r in answers.read(rows, ["id"], "q", "said", "place", F.to_date(F.lit("2024-02-01"))).collect()}
    assert set(got) == {1, 2, 3} and all(got[i].answer == answers.NO_ANSWER and got[i].span is None for i in (1, 2))
