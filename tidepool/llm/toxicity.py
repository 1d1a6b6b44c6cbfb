"""Toxic passages as maximum-scoring segments over token log-odds.

Fit, on a bounded sample of labelled documents (at most SAMPLE of each class):
- Features of a token are itself and its prefixes of 4 to 6 characters, so that inflected and
  compounded words count. A feature is counted by documents. A document counts if it is the first
  to have the token between these two neighbours, so that copies and repeated passages count once;
  contexts that both classes hold say nothing and are left out.
- Log-odds of a feature between the classes under an informative Dirichlet prior, in proportion to
  its frequency in both classes together. Features with a z-score of Z or more are evidence.
- A token scores the largest log-odds among its features that are evidence; one without evidence
  scores a small negative drift, the log-ratio of being without in toxic and in clean text.
- lambda of the extreme-value law solves sum p exp(lambda s) = 1 over the clean token distribution.
- A one-dimensional logistic curve turns a document's evidence into a probability, weighted back to
  the share of toxic documents among all labelled rows.

Apply, in one narrow pass: the linear-time scan for all maximal scoring segments of a whole text;
a segment of score S in a text of m tokens has the p-value 1 - exp(-K m exp(-lambda S)), and the
document's evidence adds up -ln p over its significant segments.

Null text counts as empty: no segment, the base score. Null ids are kept, with repeated rows each
its own result; an empty table gives an empty result. Labels without document, null labels and
labels of null ids teach nothing; of repeated labels of a document the larger counts. Without
labels of both classes there is no evidence token and every score is the base rate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm.common import materialise, pick

#: Labelled documents of each class that the fit reads.
SAMPLE = 4000
#: Share of all counts that the prior weighs; z-score of evidence; p-value of a significant segment.
PRIOR, Z, P = 0.1, 3.0, 0.01
PREFIXES = (4, 5, 6)
#: Words whose score a worker keeps.
CACHE = 300_000
WORD = re.compile(r"[^\W_]+")
SCHEMA = "doc_id long, n_words long, evidence double, passages array<struct<start:long,end:long,score:double,p:double>>"


def maximal_segments(at: np.ndarray, score: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score) of a sequence that scores score[i] at at[i] and -drift elsewhere; linear time in the number of positive scores."""
    left: list[float] = []  # cumulative score before a candidate
    right: list[float] = []  # and after it
    span: list[tuple[int, int]] = []
    back: list[int] = []  # nearest earlier candidate with a smaller left sum
    total, last = 0.0, 0
    for i, s in zip(at.tolist(), score.tolist(), strict=True):
        before = total - drift * (i - last)
        total, last = before + s, i + 1
        l, r, start = before, total, i
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= l:
                j = back[j]
            if j < 0 or right[j] >= r:
                left.append(l)
                right.append(r)
                span.append((start, i + 1))
                back.append(j)
                break
            l, start = left[j], span[j][0]
            del left[j:], right[j:], span[j:], back[j:]
    return [(a, b, r - l) for (a, b), l, r in zip(span, left, right, strict=True)]


class Model:
    """Plain values only: it travels to the executors."""

    def __init__(self, weight: dict[str, float], drift: float, lam: float, k: float, base: float, curve: tuple[float, float]) -> None:
        self.weight, self.drift, self.lam, self.k, self.base, self.curve = weight, drift, lam, k, base, curve
        self.known: dict[str, float] = {}

    def of(self, word: str) -> float:
        """The token's score; 0 without evidence."""
        if len(self.known) >= CACHE:
            self.known.clear()
        get = self.weight.get
        self.known[word] = best = max([get(word, 0.0), *(get(word[:n] + "*", 0.0) for n in PREFIXES if len(word) > n)])
        return best

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float, float]]]:
        words = WORD.findall(text.lower())
        get, of = self.known.get, self.of
        scores = [of(w) if (s := get(w)) is None else s for w in words]
        at = np.flatnonzero(scores)
        if not len(at):
            return len(words), []
        found = maximal_segments(at, np.array(scores)[at], self.drift)
        p = [-np.expm1(-self.k * len(words) * np.exp(-self.lam * s)) for _, _, s in found]
        return len(words), [(a, b, s, float(max(x, 1e-300))) for (a, b, s), x in zip(found, p, strict=True) if x <= P]


def _sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(toxic, text, doc_id) of at most `sample` documents a class; the labels of the sample are few, so they are broadcast."""
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = labels.where("toxic = 1").orderBy(*order).limit(sample).union(labels.where("toxic = 0").orderBy(*order).limit(sample))
    return docs.join(F.broadcast(chosen), "doc_id").select("toxic", "text", "doc_id")


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    h = xxhash.xxh64_intdigest
    for batch in batches:
        for toxic, text, doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = ["", *WORD.findall(text.lower()), ""]
            seen = list({(w, h(f"{a} {b}") & (1 << 63) - 1) for a, w, b in zip(words, words[1:], words[2:])})  # noqa: B905
            n = len(seen)
            columns = [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int64()), pa.array([1 << toxic] * n, pa.int32()), pa.array([doc] * n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["word", "context", "classes", "doc"])


def _lambda(score: np.ndarray, p: np.ndarray, drift: float) -> float:
    """Positive root of sum p exp(lambda s) = 1; p of the evidence tokens, the rest has -drift."""
    low, high = 1e-6, 50.0
    f = lambda x: float((p * np.exp(np.minimum(700, x * score))).sum() + (1 - p.sum()) * np.exp(-x * drift)) - 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if f(mid) > 0 else (mid, high)
    return (low + high) / 2


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve, by Newton's method with a slight ridge."""
    a = np.column_stack([np.ones_like(x), x])
    beta = np.zeros(2)
    for _ in range(50):
        mu = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        g = a.T @ (weight * (y - mu)) - 1e-3 * beta
        step = np.linalg.solve((a * (weight * mu * (1 - mu))[:, None]).T @ a + 1e-3 * np.eye(2), g)
        beta += np.clip(step, -2, 2)
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic (0 or 1), only the rows that may be learned from."""
    labels = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_all = sum(known.values())
    base = known.get(1, 0) / n_all if n_all else 0.0
    if len(known) < 2:
        return Model({}, 0.01, 1.0, 1.0, base, (float(np.log((base + 1e-3) / (1 - base + 1e-3))), 0.0))
    rows = materialise(_sampled(docs, labels, sample), "toxicity-sample")
    seen = rows.mapInArrow(_contexts, "word string, context long, classes int, doc long")
    once = seen.groupBy("word", "context").agg(F.bit_or("classes").alias("classes"), F.min("doc").alias("doc")).where("classes in (1, 2)")
    prefixes = [F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in PREFIXES]
    features = once.select("word", "doc", "classes").distinct().select("doc", "classes", F.explode(F.array_compact(F.array("word", *prefixes))).alias("word")).distinct()
    words = materialise(features.groupBy("word").agg(F.count_if(F.col("classes") == 2).alias("t"), F.count_if(F.col("classes") == 1).alias("c")), "toxicity-words")
    n = words.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    n_t, n_c = float(n.t or 0), float(n.c or 0)
    prior = PRIOR * (n_t + n_c)
    if not n_t or not n_c:
        return Model({}, 0.01, 1.0, 1.0, base, (float(np.log((base + 1e-3) / (1 - base + 1e-3))), 0.0))
    a = (F.col("t") + F.col("c")) * PRIOR
    odds = lambda y, total: F.log((y + a) / (total + prior - y - a))
    delta = odds(F.col("t"), n_t) - odds(F.col("c"), n_c)
    z = delta / F.sqrt(1 / (F.col("t") + a) + 1 / (F.col("c") + a))
    picked = words.select("word", delta.alias("delta"), z.alias("z"), ((F.col("c") + a) / (n_c + prior)).alias("p_clean"), ((F.col("t") + a) / (n_t + prior)).alias("p_toxic"))
    found = picked.where(F.col("z") >= Z).collect()  # words of a bounded sample
    p_clean, p_toxic = min(0.5, sum(r.p_clean for r in found)), min(0.9, sum(r.p_toxic for r in found))
    drift = float(np.log((1 - p_clean) / (1 - p_toxic))) if found else 0.01
    drift = max(drift, 1e-4)
    score = np.array([r.delta for r in found])
    lam = _lambda(score, np.array([r.p_clean for r in found]), drift) if found else 1.0
    model = Model({r.word: float(r.delta) for r in found}, drift, lam, max(p_clean, 1e-9), base, (0.0, 0.0))
    seen = rows.select(F.col("toxic").alias("doc_id"), "text").mapInArrow(_evidence(model), SCHEMA).select("doc_id", "evidence").toPandas()  # the sample again
    y = seen.doc_id.to_numpy(float)
    share = np.where(y == 1, base / max(1, (y == 1).sum()), (1 - base) / max(1, (y == 0).sum())) * len(y)
    model.curve = _curve(np.log1p(seen.evidence.to_numpy(float)), y, share)
    return model


def _evidence(model: Model, names: tuple[str, ...] = ("doc_id", "n_words", "evidence", "passages")):
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found = [], []
            for text in batch.column(1):
                words, segments = model.passages(text.as_py())
                n.append(words)
                found.append([{"start": a, "end": b, "score": s, "p": p} for a, b, s, p in segments])
            evidence = [float(sum(-np.log(x["p"]) for x in f)) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(evidence, pa.float64()), pa.array(found, pa.list_(passage)), *batch.columns[2:]], list(names))

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """doc_id, n_words, evidence, passages (token positions, score, p-value) and score of every row; `carry` is a column that goes along."""
    rows = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string"), **({carry: (carry, docs.schema[carry].dataType)} if carry else {})).fillna("", ["text"])
    a, b = model.curve
    schema = T._parse_datatype_string(SCHEMA)
    if carry:
        schema = schema.add(carry, docs.schema[carry].dataType)
    return rows.mapInArrow(_evidence(model, tuple(schema.names)), schema).withColumn("score", 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.log1p("evidence")))))
