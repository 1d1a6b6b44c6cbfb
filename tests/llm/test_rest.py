"""WARC, URL rules, toxicity, language and the pipeline."""

import hashlib
import os
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidepool.llm import langid, toxicity, url_filter, warc
from tidepool.llm.queries import URL_RULES

PAGES = [(1, "http://a.com/x", "p" * 150), (2, "http://a.com/y", "p" * 150), (3, None, "small"), (4, "http://b.org/\r\nX: 1", "small"), (5, "u", None), (6, "u", "é" * 60), (0, "u", "é" * 60), (None, "u", "p" * 150), (2, "again", "p" * 150)]


def test_warc_round_trip(spark):
    df = spark.createDataFrame([(*p, "digest", 1) for p in PAGES], "page_id long, url string, html string, digest string, row int")
    archive = warc.write(df)
    assert archive.content.count() == archive.content.select("digest").distinct().count() == 4
    first: dict = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in PAGES:
        data = (h or "").encode()
        revisit = len(data) >= 100 and i != first[h or ""]
        want.append((i if i is not None else -1, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[h or ""] if revisit else -1))
    got = [(-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in warc.read(archive).collect()]
    assert sorted(got) == sorted(want)
    for r in warc.records(archive).collect():
        (fields, block), = warc.parse(bytes(r.record))
        assert fields["WARC-Type"] in ("response", "revisit")
        body = block.split(b"\r\n\r\n", 1)[1]
        assert body == (bytes(r.payload) if fields["WARC-Type"] == "response" else b"")
        assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(bytes(r.payload)).hexdigest()
    assert warc.read(warc.write(df.limit(0))).collect() == []


def test_warc_files_hold_the_records(spark, tmp_path):
    """Files that any reader can open: every record, byte by byte, also of payloads that look like the end of one."""
    rows = [*PAGES, (20, "u", "a\r\n\r\nWARC/1.1\r\n\r\nb" * 9), (21, "v", "\r\n\r\n")]
    archive = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    want = sorted(bytes(r.record) for r in warc.records(archive).collect())
    for compression in ("none", "gzip"):
        folder = f"{tmp_path}/{compression}"
        warc.export(archive, f"file://{folder}", compression)
        blocks = [(f, b) for name in sorted(os.listdir(folder)) if name.startswith("part") for f, b in warc.parse(open(f"{folder}/{name}", "rb").read())]
        assert sorted(r.split(b"\r\n\r\n", 1)[1] for r in want) == sorted(b for _, b in blocks)
        assert sorted(f["WARC-Type"] for f, _ in blocks) == sorted(re.search(rb"WARC-Type: (\w+)", r)[1].decode() for r in want)


def test_warc_reads_records_not_tables(spark):
    """A header whose payload is not as it says stops the read; a very long payload comes back whole."""
    long = "é" * 25_000_000
    archive = warc.write(spark.createDataFrame([(1, "u", long), (2, "v", long), (3, "w", "x" * 200)], "page_id long, url string, html string"))
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(archive).collect())
    assert got == [(1, 50_000_000, "response", None), (2, 50_000_000, "revisit", 1), (3, 200, "response", None)]
    short = F.regexp_replace(F.col("header").cast("string"), "Content-Length: [0-9]+\r\n\r\nHTTP", "Content-Length: 150\r\n\r\nHTTP").cast("binary")
    with pytest.raises(Exception, match="does not have the digest"):
        warc.read(warc.Archive(archive.content, archive.headers.withColumn("header", short))).collect()


def test_warc_refuses_a_wrong_payload(spark):
    archive = warc.write(spark.createDataFrame([(1, "u", "x" * 200)], "page_id long, url string, html string"))
    archive.content = archive.content.withColumn("payload", F.lit(b"other"))
    with pytest.raises(Exception, match="does not have the digest"):
        warc.read(archive).collect()


URLS = ["http://A.example.com/en/1", "https://www.example.com/en/x?q", "http://example.com/de/", "http://example.com", "http://x.net/es/a", "http://net/fr/", "http://xnet/es/", "http://foo.org/en/", None, "no scheme", "http://example.com?en/", "ftp://Example.COM#/en/", "http://com/", "://com/", "http://www.example.com/en", "http://a.b.c.net/fr/#x", "http://example.com:80/en/", "", "http://" + "a." * 60_000 + "net/es/" + "x" * 50_000, "http://" + "b" * 100_000 + ".com/", "http://..com/", "http://com./", "http://.net/es/"]


def test_url_rules(spark):
    def slow(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            n = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
            host, path = rest[:n].lower(), rest[n:]
            path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
        fits = [(len(r), r, v) for v, r in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS)] + [(0, URLS[0], "h", "v"), (None, URLS[1], "h", "v")], "page_id long, url string, host string, verdict string")
    got = url_filter.judge(df, URL_RULES).collect()
    assert sorted((-1 if r.page_id is None else r.page_id, r.host, r.path, str(r.rule), r.verdict) for r in got) == sorted((i, *map(str, slow(u))) for i, u in [*enumerate(URLS), (0, URLS[0]), (-1, URLS[1])])
    assert url_filter.judge(df.limit(0), URL_RULES).collect() == []
    assert max(len(list(url_filter.keys(h, "/en/" * 9, [(1, 1), (2, 4), (3, 4)]))) for h in ("a", "a.b", "a." * 60_000)) == 3
    assert {r.verdict for r in url_filter.judge(df, []).collect()} == {"allow"}


@given(st.sets(st.text(max_size=6), min_size=1, max_size=60), st.sets(st.text(max_size=6), max_size=400), st.floats(0.05, 0.6))
@settings(max_examples=60, deadline=None)
def test_cascade_is_exact(listed, universe, rate):
    first = url_filter.Bloom(listed, rate, 0)
    wrong = {k for k in universe - listed if k in first}
    cascade = url_filter.Cascade(listed, first, wrong)
    assert all((k in cascade) == (k in listed) for k in universe | listed)


@given(st.lists(st.integers(-3, 4), max_size=40))
@settings(max_examples=300, deadline=None)
def test_maximal_segments(scores):
    """Against the definition: the best segment, then the same left and right of it."""

    def slow(lo, hi):
        best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        a = -best[2]
        b = a - best[1]
        return slow(lo, a) + [(a, b, best[0])] + slow(b, hi)

    scores = [s if s > 0 else -1 for s in scores]
    at = np.array([i for i, s in enumerate(scores) if s > 0], int)
    got = toxicity.maximal_segments(at, np.array([scores[i] for i in at], float), 1.0)
    assert sum(s for *_, s in got) == sum(s for *_, s in slow(0, len(scores)))
    assert all(sum(scores[a:b]) == s for a, b, s in got)


@pytest.fixture(scope="module")
def toxic_docs(spark):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(400):
        words = [f"w{x}" for x in rng.integers(0, 300, 60)]
        if i % 4 == 0:
            for x in rng.integers(0, 60, 5):
                words[x] = ("vilething", "grimwort")[x % 2]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark, toxic_docs, odd_docs, no_docs):
    docs, labels = toxic_docs
    model = toxicity.fit(docs, labels.where("doc_id % 3 <> 1"))
    assert {"vilething", "grimwort"} <= set(model.weight)
    for r in toxicity.score(docs, model).where("doc_id % 3 = 1").collect():
        assert (r.score >= 0.7) == (r.doc_id % 4 == 0)
    odd = toxicity.score(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score < 0.5 for r in odd)
    assert toxicity.score(no_docs, model).collect() == []
    nothing = toxicity.fit(docs, labels.limit(0))
    assert {r.score < 0.1 for r in toxicity.score(docs, nothing).collect()} == {True}


def test_forward_backward_against_all_paths():
    import itertools

    rng = np.random.default_rng(0)
    score, a = rng.normal(size=(9, 3)), rng.normal(size=(3, 3))
    p, pairs = langid.Chains(np.array([4, 1, 4])).posteriors(score, a)
    want, want_pairs = np.zeros((9, 3)), np.zeros((3, 3))
    for lo, n in ((0, 4), (4, 1), (5, 4)):
        paths = list(itertools.product(range(3), repeat=n))
        weight = np.array([np.exp(sum(score[lo + t, s] for t, s in enumerate(x)) + sum(a[s, u] for s, u in zip(x, x[1:], strict=False))) for x in paths])
        weight /= weight.sum()
        for x, w in zip(paths, weight, strict=True):
            for t, s in enumerate(x):
                want[lo + t, s] += w
            for s, u in zip(x, x[1:], strict=False):
                want_pairs[s, u] += w
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs)


@pytest.mark.parametrize("part", [1, 2, 5, 64])
def test_chains_in_parts_equal_whole_chains(part):
    rng = np.random.default_rng(1)
    lengths = np.array([37, 1, 0, 64, 5, 128, 10])
    score, a = 3 * rng.normal(size=(lengths.sum(), 4)), 2 * rng.normal(size=(4, 4))
    whole = langid.Chains(lengths).posteriors(score, a)[0]
    assert np.allclose(langid.whole_chains(lengths, score, a, part), whole, atol=1e-9)
    single = langid.whole_chains(lengths, score.astype(np.float32), a.astype(np.float32), part)
    assert single.dtype == np.float32 and np.allclose(single, whole, atol=1e-4)


def test_words_are_letters():
    assert langid.words_of("½ ² Ⅷ 12 _ a1b été 汉字 一") == ["a", "b", "été", "汉字", "一"]


def test_language(spark, odd_docs, no_docs):
    rng = np.random.default_rng(0)
    roots = {"aa": ["blom", "kran", "stiv"], "bb": ["ouché", "élan", "aire"]}
    make = lambda lang: " ".join("".join(rng.choice(roots[lang], 2)) for _ in range(40)) + "."
    rows = [(i, make(lang), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(got[i].lang == lang for i, _, lang in rows)
    mixed = spark.createDataFrame([(1, "blomkran stivblom kranstiv blomblom ouchéélan airearie élanélan ouchéaire"), (2, "123 !! ½ ² Ⅷ"), (3, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in langid.predict(mixed, model).collect()}
    assert [r.lang for r in found[1].runs] == ["aa", "bb"] and found[1].runs[0].end == 4
    assert (found[2].lang, found[2].score, found[3].lang) == ("und", 0.0, "und")
    odd = langid.predict(odd_docs, model).collect()
    assert len(odd) == odd_docs.count()
    assert langid.predict(no_docs, model).collect() == []
    assert {r.lang for r in langid.predict(docs, langid.train([], [])).collect()} == {"und"}
