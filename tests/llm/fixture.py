"""Small tables with odd rows, written as Parquet, and plain versions of what the trained models do."""

import re
import zlib

import numpy as np
import pytest

from tidepool.llm import langid, toxicity

ROOTS = {"aa": ["blom", "kran", "stiv", "mur"], "bb": ["ouché", "élan", "aire", "zeph"]}
VILE = ["vilething", "grimwort"]
ITEM = " ".join(f"question{i} word{i * 7 % 13}" for i in range(12))
TEXT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, row string, words long, h long"


def documents():
    rng = np.random.default_rng(8)
    rows = []
    for i in range(240):
        lang = ("aa", "bb")[i % 2]
        words = ["".join(rng.choice(ROOTS[lang], 2)) + str(rng.choice(ROOTS[lang])) for _ in range(60)]
        if i % 8 in (0, 3):
            for place in rng.integers(0, 60, 5):
                words[place] = VILE[place % 2]
        if i % 10 == 1:
            words[20:20] = ITEM.split()
        rows.append((i, ". ".join(" ".join(words[a : a + 10]) for a in range(0, len(words), 10)), lang))
    rows += [(300 + i, rows[1][1], "bb") for i in range(5)]  # copies
    rows += [(400, rows[2][1] + " more", None), (401, None, "aa"), (402, "", "bb"), (403, " \n\t", None), (404, "½ ² 12 !!", "aa"), (405, "blomkran " * 20_000, "aa"), (406, "Ɓa ƁA İx 汉字 <|endoftext|> 🙂 \x00 MIT License", "bb")]
    rows += [rows[7], rows[7], (None, rows[9][1], "bb"), (407, "Released under the MIT license. Mit  license", None)]
    return [(i, t, lang, "s", 0, 0.5, 1, "x", 2, 3) for i, t, lang in rows]


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(9)
    docs = documents()
    vectors = [(i, rng.normal(size=8).tolist(), 0, 0) for i in range(300)] + [(300, None, 0, 0), (320, [0.0] * 8, 0, 0), (340, [float("nan")] * 8, 0, 0), (360, rng.normal(size=8).tolist(), 0, 0), (360, [1.0] * 8, 0, 0)]
    vectors = [(*v, i % 4 if i % 31 else None) for i, v in enumerate(vectors)]
    turns = [(i, t, ("user", "assistant", "system", None)[(i + t) % 4 if i % 3 else t % 2], ("Fine.", "and then", "", None, "Fine.", "Well!\n")[(i * t) % 6]) for i in range(40) for t in range(i % 7)] + [(None, None, None, None), (50, 1, "user", "Hi. " * 50_000), (50, 1, "user", "Hi. " * 50_000)]
    pages = [(i, f"http://{h}/{p}", f"<p>{i % 7}</p>" * (5 + 20 * (i % 3)), "x", "y") for i, (h, p) in enumerate([("Example.com", "en/1"), ("www.example.com", "en/"), ("x.net", "es/"), ("y.org", "")] * 10)] + [(100, None, None, "x", "y"), (101, "http://" + "a." * 9000 + "net/fr/", "x" * 300_000, "x", "y"), (102, "u", "x" * 300_000, "x", "y")]
    for name, rows, schema in (
        ("documents", docs, TEXT_SCHEMA),
        ("labels", [(i, i % 2, int(i % 8 in (0, 3))) for i in range(240)] + [(8, 0, 0), (5, 1, None), (None, 0, 1), (9999, 0, 0)], "doc_id long, quality int, toxic int"),
        ("benchmark", [(1, ITEM), (2, "never seen anywhere at all here"), (3, "汉字"), (1, ITEM), (4, None), (None, "12 !")], "item_id long, text string"),
        ("embeddings", vectors, "vec_id long, embedding array<float>, rank int, score int, label int"),
        ("conversations", turns, "conv_id long, turn long, role string, text string"),
        ("pages", pages, "page_id long, url string, html string, host string, digest string"),
    ):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="session")
def empty_tables(spark, tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "embeddings", "pages", "conversations"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder


def held_out(doc_id, n, at):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n == at


def plain_language(model: langid.Model, text):
    """Language and score by forward-backward over the whole text, a word at a time."""
    words = ["".join(c for c in w) for w in re.findall(r"[^\W\d_]+", re.sub("[½²]", " ", (text or "").lower()))]
    if not words:
        return "und", 0.0
    e = np.exp(np.array([model.weight[langid.features(w)].astype(float).sum(axis=0) for w in words]))
    a, alpha, beta = np.exp(model.transition.astype(float)), np.empty_like(e), np.ones_like(e)
    for t in range(len(e)):
        alpha[t] = e[t] * (alpha[t - 1] @ a if t else 1)
        alpha[t] /= alpha[t].sum()
    for t in range(len(e) - 2, -1, -1):
        beta[t] = a @ (e[t + 1] * beta[t + 1])
        beta[t] /= beta[t].sum()
    p = alpha * beta
    mean = (p / p.sum(axis=1, keepdims=True)).mean(axis=0)
    return model.langs[mean.argmax()], mean.max()


def plain_toxicity(model: toxicity.Model, text):
    """Score by the definition of maximal segments: the best one, then those left and right of it."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    score = [model.of(w) or -model.drift for w in words]
    total = np.concatenate([[0.0], np.cumsum(score)])

    def best(lo, hi):
        found, low = (0.0, lo, lo), lo
        for b in range(lo + 1, hi + 1):
            low = min(low, b - 1, key=lambda x: (total[x], -x))
            found = max(found, (total[b] - total[low], low, b), key=lambda x: (x[0], x[1] - x[2]))
        return found

    def split(lo, hi):
        value, a, b = best(lo, hi)
        return split(lo, a) + [value] + split(b, hi) if value > 1e-9 else []

    p = [-np.expm1(-model.k * len(words) * np.exp(-model.lam * s)) for s in (split(0, len(score)) if any(s > 0 for s in score) else [])]
    evidence = sum(-np.log(max(x, 1e-300)) for x in p if x <= toxicity.P)
    return 1 / (1 + np.exp(-(model.curve[0] + model.curve[1] * np.log1p(evidence))))
