import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.functions import scalars as sc


def test_token_forms(spark):
    df = spark.createDataFrame([("The_Quick brown-fox /a/b.c:1 x ab",), (None,)], "t string")
    got = df.select(*[sc.tokens(F.col("t"), f).alias(f) for f in sc.FORMS]).collect()
    assert got[0].query == ["the_quick", "brown-fox", "a", "b", "c", "1", "x", "ab"] and got[0].signature == ["the_quick", "brown-fox"]
    assert got[0].word == ["the_quick", "brown", "fox", "a", "b", "c", "1", "x", "ab"] and got[0].path == ["The_Quick", "brown-fox", "/a/b.c:1", "ab"] and got[0].keyword == ["The_Quick", "brown", "fox"]
    assert all(x == [] for x in got[1])


def test_names(spark):
    df = spark.createDataFrame([(" Lives  In! ", "x " * 200, "Straße & Co. — Ⅷ_é  ")], "r string, l string, s string")
    got = df.select(sc.relation(F.col("r")).alias("r"), sc.relation_label(F.lit("works_at  now")).alias("n"), sc.truncated(F.col("l")).alias("l"), sc.slugs(F.col("s")).alias("s")).first()
    assert (got.r, got.n, len(got.l), got.l[-1], got.s) == ("lives_in", "works at now", 220, "…", "straße-co-viii-é")
    assert sc.slug(None) == sc.slug("!!") == "untitled" and len(sc.slug("é" * 200).encode()) <= 120


def test_hashes(spark):
    assert sc.fnv32("") == 0x811C9DC5 and sc.fnv32("a") == 0xE40C292C and sc.fnv32("foobar") == 0xBF9CF968
    row = spark.createDataFrame([("abc",)], "t string").select(sc.fnv32s(F.col("t")).alias("f"), sc.blake64s(F.col("t")).alias("b")).first()
    assert row.f == sc.fnv32("abc") and row.b == int.from_bytes(hashlib.blake2b(b"abc", digest_size=8).digest(), "little", signed=True)


def test_hash_embeddings(spark):
    df = spark.createDataFrame([("green tea",), ("Green, tea!",), ("",), (None,)], "t string")
    a, b, empty, none = (np.array(r.v) for r in df.select(sc.embedded(F.col("t")).alias("v")).collect())
    assert np.allclose(a, b) and np.linalg.norm(a) == pytest.approx(1) and np.count_nonzero(a) <= 3 and not empty.any() and not none.any() and len(a) == 384

    class Wrong:
        dims = 4

        def embed(self, texts):
            return np.zeros((len(texts), 3))

    with pytest.raises(Exception, match="the embedder gave"):
        df.select(sc.embedded(F.col("t"), Wrong())).collect()


def test_flags(spark):
    spark.conf.set("tidepool.hooks", "on")
    spark.conf.set("tidepool.graph", "false")
    try:
        assert sc.Flags.of(spark) == sc.Flags(graph=False, hooks=True)
    finally:
        spark.conf.unset("tidepool.hooks")
        spark.conf.unset("tidepool.graph")
