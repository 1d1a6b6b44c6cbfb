"""Question benchmarks of three layouts as a corpus, an evaluation and a question-answer table.

Each layout gives three tables: corpus (doc_id, source_id, text), evals (query, expected_doc_ids) and
answers (query, expected_doc_ids, expected_answers). `row` is the place of a question in its file; it
makes the token that ties a query to its own documents. Questions without an expected document have
documents only; answers that say nothing are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the layouts and formats of their tokens. Fixed values.
LONG, CHOICE, OPEN = ("long", "__LME_CASE_%04d__"), ("choice", "__LOCOMO_CASE_%04d__"), ("open", "__DMR_CASE_%05d__")
NO_GOLD = "not answerable"


@dataclass
class Tables:
    corpus: DataFrame
    evals: DataFrame
    answers: DataFrame

    def union(self) -> DataFrame:
        """All three under one another: part, id, ids and text."""
        flat = lambda ids: F.array_join(ids, ",")
        c = self.corpus.select(F.lit("corpus").alias("part"), F.col("source_id").alias("id"), F.col("doc_id").alias("ids"), "text")
        e = self.evals.select(F.lit("eval"), F.col("query"), flat("expected_doc_ids"), F.lit(""))
        return c.union(e).union(self.answers.select(F.lit("qa"), F.col("query"), flat("expected_doc_ids"), flat("expected_answers")))


def _token(layout: tuple[str, str]) -> Column:
    return F.format_string(layout[1], F.col("row").cast("long"))


def _tables(corpus: DataFrame, questions: DataFrame, layout: tuple[str, str]) -> Tables:
    """questions: row, question, expected_doc_ids, gold (an array of answers)."""
    asked = questions.where(F.size("expected_doc_ids") > 0).select(F.concat(_token(layout), F.lit(" "), F.trim("question")).alias("query"), "expected_doc_ids", F.filter(F.transform("gold", lambda x: F.trim(x)), lambda x: x != "").alias("expected_answers"))
    return Tables(corpus, asked.select("query", "expected_doc_ids"), asked.where(F.size("expected_answers") > 0))


def long_sessions(rows: DataFrame) -> Tables:
    """rows: row, question_id, question, answer, answer_session_ids, haystack_session_ids, haystack_sessions (arrays of turns with role and content). One document a session, one corpus row a turn."""
    each = rows.select("row", "question_id", F.inline(F.arrays_zip(F.col("haystack_session_ids").alias("sid"), F.col("haystack_sessions").alias("turns"))))
    each = each.select("row", "question_id", "sid", F.posexplode("turns").alias("nth", "turn")).withColumn("content", F.trim("turn.content")).where("content <> ''")
    nth = F.lpad(F.col("nth").cast("string"), 4, "0")
    text = F.concat_ws("\n", _token(LONG), F.concat(F.lit("Question id: "), "question_id"), F.concat(F.lit("Session id: "), "sid"), F.concat(F.lit("Turn index: "), "nth"), F.concat(F.coalesce(F.col("turn.role"), F.lit("speaker")), F.lit(": "), "content"))
    corpus = each.select(F.concat_ws("_", F.lit("lme"), "question_id", "sid").alias("doc_id"), F.concat_ws(":", F.lit("lme"), "question_id", "sid", F.lit("turn"), nth).alias("source_id"), text.alias("text"))
    known = F.filter("answer_session_ids", lambda s: F.array_contains("haystack_session_ids", s))
    expected = F.transform(known, lambda s: F.concat_ws("_", F.lit("lme"), "question_id", s))
    return _tables(corpus, rows.select("row", "question", expected.alias("expected_doc_ids"), F.array("answer").alias("gold")), LONG)


def choices(rows: DataFrame) -> Tables:
    """rows: row, question_id, question, answer, haystack_session_ids, haystack_session_summaries, haystack_sessions. One document a session, its summary or else its turns; those that hold the answer are expected."""
    zipped = F.arrays_zip(F.col("haystack_session_ids").alias("sid"), F.col("haystack_session_summaries").alias("summary"), F.col("haystack_sessions").alias("turns"))
    said = F.array_join(F.transform(F.filter("turns", lambda t: F.trim(t.content) != ""), lambda t: F.concat(F.coalesce(t.role, F.lit("speaker")), F.lit(": "), F.trim(t.content))), "\n")
    each = rows.select("row", "question_id", "question", "answer", F.posexplode(zipped).alias("nth", "z")).select("row", "question_id", "question", "answer", "nth", "z.*")
    each = each.withColumn("said", said).withColumn("summary", F.coalesce("summary", F.lit(""))).withColumn("body", F.when(F.trim("summary") != "", F.trim("summary")).otherwise(F.trim("said"))).where("body <> ''")
    doc_id = F.concat_ws("_", F.lit("locomo"), "question_id", "sid")
    corpus = each.select(doc_id.alias("doc_id"), F.concat_ws(":", F.lit("locomo"), "question_id", "sid").alias("source_id"), F.concat(_token(CHOICE), F.lit("\n"), "body").alias("text"))
    gold = F.lower(F.trim("answer"))
    holds = (gold != "") & (gold != NO_GOLD) & F.contains(F.lower(F.concat_ws("\n", "summary", "said")), gold)
    found = F.transform(F.array_sort(F.collect_list(F.when(holds, F.struct("nth", doc_id.alias("doc_id"))))), lambda x: x.doc_id)
    return _tables(corpus, each.groupBy("row", "question", "answer").agg(found.alias("expected_doc_ids")).select("row", "question", "expected_doc_ids", F.array("answer").alias("gold")), CHOICE)


def open_domain(rows: DataFrame) -> Tables:
    """rows: row, question, answers, ctxs (arrays of id, title, text, hasanswer, isgold). One document a context; those marked are expected."""
    doc_id = F.format_string("dmr_%05d_%02d", F.col("row").cast("long"), F.col("nth").cast("long"))
    each = rows.select("row", "question", "answers", F.posexplode("ctxs").alias("nth", "c"))
    corpus = each.select(doc_id.alias("doc_id"), F.format_string("dmr:%05d:%02d", F.col("row").cast("long"), F.col("nth").cast("long")).alias("source_id"), F.concat_ws("\n", _token(OPEN), F.trim(F.coalesce("c.title", F.lit(""))), F.trim(F.coalesce("c.text", F.lit("")))).alias("text"))
    marked = F.coalesce(F.col("c.hasanswer"), F.lit(False)) | F.coalesce(F.col("c.isgold"), F.lit(False))
    found = F.transform(F.array_sort(F.collect_list(F.when(marked, F.struct("nth", doc_id.alias("doc_id"))))), lambda x: x.doc_id)
    return _tables(corpus, each.groupBy("row", "question").agg(found.alias("expected_doc_ids"), F.first("answers").alias("gold")), OPEN)
