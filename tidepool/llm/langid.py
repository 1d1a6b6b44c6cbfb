"""Language of words and documents by a linear-chain conditional random field.

A word's features are its affixes, its character n-grams and, as the lexicon, the word itself; all
are hashed into a table of fixed size with one weight a language. Transitions between the languages
of neighbouring words are learned with them, by gradient ascent on the conditional likelihood of
bounded training sequences. Those are the different lines of sampled documents of a known language
(lines found under several languages are left out), and chains of lines of two languages, so that
switches are seen.

Fit on at most DOCS documents a language, chosen by the hash of their id among those of at most
CHARS characters. Apply in one narrow pass over whole texts: forward-backward gives each word its
posterior over the languages, a document gets the language with the largest mean posterior, and that
mean is the score. A text is one chain, however long: stretches of CHAIN words go side by side, and
the messages carried from one to the next follow from their transfer matrices, so that the result is
that of the whole chain.

Words are runs of letters (by Unicode category). Null text and texts without letters: `und` with score 0. Null ids are kept, repeated rows each get
their result, an empty table gives an empty result. Without any training document every text with
letters is `und` as well.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm.common import pick

DOCS, CHARS = 300, 20_000
#: Training chains of a language.
LINES = 2000
CHAIN, SLOTS = 256, 1 << 18
#: Words of a worker's memory, and words that are decoded together.
CACHE, TOGETHER = 200_000, 200_000
#: What Python takes for word characters beyond letters: numerals that are no digits.
_NUMERALS = "".join(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No"))
_NUMERAL = re.compile(f"[{_NUMERALS}]")
_MAYBE_NUMERAL = re.compile(f"[{''.join(c for c in _NUMERALS if ord(c) < 1 << 16)}\U00010000-\U0010ffff]")
_WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    """Runs of letters."""
    return _WORD.findall(text if text.isascii() or not _MAYBE_NUMERAL.search(text) else _NUMERAL.sub(" ", text))


def features(word: str) -> list[int]:
    """Slots of prefixes, suffixes, n-grams and the word itself."""
    framed = f"^{word}$"
    found = {f"w{word}"}
    for n in (1, 2, 3):
        found.add(f"p{word[:n]}")
        found.add(f"s{word[-n:]}")
    for n in (2, 3):
        found.update(f"g{framed[i : i + n]}" for i in range(len(framed) - n + 1))
    return [zlib.crc32(f.encode()) % SLOTS for f in found]


class Words:
    """Feature slots of many words in rows of one flat array."""

    def __init__(self, words: list[str]) -> None:
        lists = [features(w) for w in words]
        self.size = np.array([len(x) for x in lists], np.int32)
        self.slots = np.fromiter((i for x in lists for i in x), np.int32, int(self.size.sum()))
        self.start = np.cumsum(self.size) - self.size

    def scores(self, weight: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weight[self.slots], self.start) if len(self.size) else np.zeros((0, weight.shape[1]))


class Chains:
    """Sequences of row numbers, longest first and by time step, so that a step is one slice."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.active = np.searchsorted(-self.lengths, -np.arange(1, (self.lengths[0] if len(lengths) else 0) + 1), side="right")
        self.step = np.concatenate([[0], np.cumsum(self.active)])
        begin = np.cumsum(lengths) - lengths
        self.flat = np.concatenate([begin[self.order[:n]] + t for t, n in enumerate(self.active)]) if len(self.active) else np.zeros(0, np.int64)

    def _factors(self, score: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = score[self.flat]
        return np.exp(x - x.max(axis=1, keepdims=True)), np.exp(transition)

    def posteriors(self, score: np.ndarray, transition: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors of each position (in the input's order) and expected transition counts. `before` and `after` are the messages that reach the sequences' first and last positions, where they are parts of longer chains."""
        e, a = self._factors(score, transition)
        alpha, beta = np.empty_like(e), np.ones_like(e)
        s, n = self.step, self.active
        if before is not None and len(n):
            e[: n[0]] *= before[self.order[: n[0]]]
        if after is not None and len(n):
            beta[s[self.lengths[: n[0]] - 1] + np.arange(n[0])] = after[self.order[: n[0]]]
        for t in range(len(n)):
            now = e[s[t] : s[t + 1]] if t == 0 else e[s[t] : s[t + 1]] * (alpha[s[t - 1] : s[t - 1] + n[t]] @ a)
            alpha[s[t] : s[t + 1]] = now / now.sum(axis=1, keepdims=True)
        pairs = np.zeros_like(a)
        for t in range(len(n) - 2, -1, -1):
            later = e[s[t + 1] : s[t + 2]] * beta[s[t + 1] : s[t + 2]]
            back = later @ a.T
            beta[s[t] : s[t] + n[t + 1]] = back / back.sum(axis=1, keepdims=True)
            here = alpha[s[t] : s[t] + n[t + 1]]
            total = ((here @ a) * later).sum(axis=1, keepdims=True)
            pairs += a * ((here / total).T @ later)
        p = alpha * beta
        p /= p.sum(axis=1, keepdims=True)
        out = np.empty_like(p)
        out[self.flat] = p
        return out, pairs

    def transfer(self, score: np.ndarray, transition: np.ndarray) -> np.ndarray:
        """For each sequence (in the input's order) the matrix that takes the message which reaches its first position to the one that leaves its last, up to a factor."""
        e, a = self._factors(score, transition)
        k, s, n = len(a), self.step, self.active
        moved = np.broadcast_to(np.eye(k, dtype=e.dtype), (len(self.lengths), k, k)).copy()
        for t in range(len(n)):
            here = moved[: n[t]] if t == 0 else (moved[: n[t]].reshape(-1, k) @ a).reshape(-1, k, k)
            here = here * e[s[t] : s[t + 1], None, :]
            moved[: n[t]] = here / here.sum(axis=(1, 2), keepdims=True)
        out = np.empty_like(moved)
        out[self.order] = moved
        return out


def whole_chains(lengths: np.ndarray, score: np.ndarray, transition: np.ndarray, part: int = CHAIN) -> np.ndarray:
    """Posteriors over chains of any length, in parts that are worked on side by side."""
    parts = np.maximum(1, -(-lengths // part))
    owner = np.repeat(np.arange(len(lengths)), parts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    size = np.minimum(part, lengths[owner] - place * part)
    many = np.flatnonzero(parts[owner] > 1)
    if not len(many):
        return Chains(size).posteriors(score, transition)[0]
    a, k, begin = np.exp(transition), len(transition), np.cumsum(size) - size
    rows = np.repeat(begin[many] - (np.cumsum(size[many]) - size[many]), size[many]) + np.arange(size[many].sum())
    moved = np.empty((len(owner), k, k), a.dtype)
    moved[many] = Chains(size[many]).transfer(score[rows], transition)
    before, after = np.ones((len(owner), k), a.dtype), np.ones((len(owner), k), a.dtype)
    first, n = (np.cumsum(parts) - parts), parts
    for i in range(1, int(n.max())):
        at = first[n > i] + i
        message = (before[at - 1, None, :] @ moved[at - 1])[:, 0] @ a
        before[at] = message / message.sum(axis=1, keepdims=True)
    for i in range(int(n.max()) - 1, 0, -1):
        at = first[n > i] + i
        message = (moved[at] @ after[at, :, None])[:, :, 0] @ a.T
        after[at - 1] = message / message.sum(axis=1, keepdims=True)
    return Chains(size).posteriors(score, transition, before, after)[0]


class Model:
    """Plain arrays: it travels to the executors."""

    def __init__(self, langs: list[str], weight: np.ndarray, transition: np.ndarray) -> None:
        self.langs, self.weight, self.transition = langs, weight.astype(np.float32), transition.astype(np.float32)


def train(texts: list[str], langs: list[str], steps: int = 60, rate: float = 0.5, ridge: float = 1e-6, seed: int = 0) -> Model:
    """Gradient ascent (Adagrad) over lines of texts and over chains of lines of two languages."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((SLOTS, 1)), np.zeros((1, 1)))
    rng, at = np.random.default_rng(seed), {x: i for i, x in enumerate(names)}
    spoken: dict[tuple[str, ...], int] = {}  # each line once; those of several languages are passages that go round and teach nothing
    for text, lang in zip(texts, langs, strict=True):
        for line in text.lower().split("\n"):
            words = words_of(line)
            for i in range(0, len(words), 64):
                key = tuple(words[i : i + 64])
                spoken[key] = at[lang] if spoken.get(key, at[lang]) == at[lang] else -1
    lines = [(words, lang) for words, lang in spoken.items() if lang >= 0]
    picked = [lines[i] for i in rng.permutation(len(lines))[: LINES * len(names)]]
    mixed = [((a[: len(a) // 2 + 1], i), (b[len(b) // 2 :], j)) for (a, i), (b, j) in zip(picked, picked[1:], strict=False) if i != j]
    chains = [[x] for x in picked] + [list(x) for x in mixed[: len(picked) // 4]]
    index: dict[str, int] = {}
    rows = np.array([index.setdefault(w, len(index)) for c in chains for words, _ in c for w in words], np.int64)
    gold = np.array([lang for c in chains for words, lang in c for _ in words], np.int64)
    lengths = np.array([sum(len(words) for words, _ in c) for c in chains], np.int64)
    if not len(rows):
        return Model(names, np.zeros((SLOTS, len(names))), np.zeros((len(names),) * 2))
    table, layout, n = Words(list(index)), Chains(lengths), len(names)
    first = np.zeros(len(rows), bool)
    first[np.cumsum(lengths) - lengths] = True
    seen = np.zeros((n, n))
    np.add.at(seen, (gold[:-1][~first[1:]], gold[1:][~first[1:]]), 1)
    hot = np.eye(n)[gold]
    owner = np.repeat(np.arange(len(table.size), dtype=np.int32), table.size)
    weight, transition = np.zeros((SLOTS, n)), np.zeros((n, n))
    sum_w, sum_t = np.full((SLOTS, n), 1e-2), np.full((n, n), 1e-2)
    for _ in range(steps):
        p, pairs = layout.posteriors(table.scores(weight)[rows], transition)
        g = np.column_stack([np.bincount(table.slots, np.bincount(rows, hot[:, k] - p[:, k], len(table.size))[owner], SLOTS) for k in range(n)]) - ridge * len(rows) * weight
        sum_w += g * g
        weight += rate * g / np.sqrt(sum_w)
        g = seen - pairs - ridge * len(rows) * transition
        sum_t += g * g
        transition += rate * g / np.sqrt(sum_t)
    return Model(names, weight, transition)


def fit(docs: DataFrame, per_language: int = DOCS) -> Model:
    """docs: doc_id, text, lang, only the rows that may be learned from."""
    rows = docs.where(F.col("lang").isNotNull() & (F.col("lang") != "") & (F.length("text") <= CHARS))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not sizes:
        return train([], [])
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, 1.2 * per_language / n)))])
    spread = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 30)) / float(1 << 30)
    few = rows.where(spread < share[F.col("lang")]).select("doc_id", "lang", "text").toPandas()  # at most about 1.2 x per_language x CHARS a language
    few = few.sort_values("doc_id", kind="stable").groupby("lang").head(per_language)
    return train(few.text.tolist(), few.lang.tolist())


class Decoder:
    """A worker's scores of known words, over the model's weights."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.transition)), np.float32)

    def decode(self, texts: list[list[str]]) -> np.ndarray:
        """Posteriors of all words of all texts, in order."""
        get = self.index.get
        words = [w for t in texts for w in t]
        new = list(dict.fromkeys(w for w in words if w not in self.index))
        if new:
            if len(self.index) + len(new) > CACHE and self.index:
                self.clear()
                return self.decode(texts)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, Words(new).scores(self.model.weight)])
        get = self.index.__getitem__
        rows = np.fromiter(map(get, words), np.int64, len(words))
        return whole_chains(np.array([len(t) for t in texts]), self.scores[rows], self.model.transition) if len(words) else np.zeros((0, len(self.model.transition)), np.float32)


def _runs(best: np.ndarray, langs: list[str]) -> list[dict]:
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(best)) + 1, [len(best)]])
    return [{"start": int(a), "end": int(b), "lang": langs[best[a]]} for a, b in zip(cuts, cuts[1:], strict=False)] if len(best) else []


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_runs: bool = True, carry: str | None = None) -> DataFrame:
    """doc_id, n_words, lang, score and runs: the labelled stretches of words of every row; `carry` is a column that goes along."""
    kept = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    run_type = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept.value
        decoder = Decoder(model)

        def out(ids: list, texts: list[list[str]], along: list[pa.Array]) -> pa.RecordBatch:
            sizes = np.array([len(t) for t in texts], np.int64)
            lang, score, runs = [UNKNOWN] * len(ids), [0.0] * len(ids), [[] for _ in ids]
            if model.langs and sizes.sum():
                p = decoder.decode(texts)
                best = p.argmax(axis=1)
                begin = np.cumsum(sizes) - sizes
                some = np.flatnonzero(sizes)
                mean = np.add.reduceat(p.astype(np.float64), begin[some]) / sizes[some, None]
                for i, m in zip(some.tolist(), mean, strict=True):
                    lang[i], score[i] = model.langs[m.argmax()], float(min(1.0, m.max()))
                    if with_runs:
                        runs[i] = _runs(best[begin[i] : begin[i] + sizes[i]], model.langs)
            columns = [pa.array(ids, pa.int64()), pa.array(sizes), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(runs, pa.list_(run_type))]
            return pa.RecordBatch.from_arrays(columns + along, names)

        for batch in batches:
            ids, texts, held, begun = [], [], 0, 0
            along = lambda end: [c.slice(begun, end - begun) for c in batch.columns[2:]]  # noqa: B023, E731
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(doc_id.as_py())
                texts.append(words_of(text.as_py().lower()))
                held += len(texts[-1])
                if held >= TOGETHER:
                    yield out(ids, texts, along(begun + len(ids)))
                    ids, texts, held, begun = [], [], 0, begun + len(ids)
            if ids:
                yield out(ids, texts, along(batch.num_rows))

    rows = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string"), **({carry: (carry, docs.schema[carry].dataType)} if carry else {})).fillna("", ["text"])
    schema = T._parse_datatype_string("doc_id long, n_words long, lang string, score double, runs array<struct<start:long,end:long,lang:string>>")
    if carry:
        schema = schema.add(carry, docs.schema[carry].dataType)
    names = schema.names
    return rows.mapInArrow(run, schema)
