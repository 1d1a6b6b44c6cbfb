import pytest

LONG = "word " * 30_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, a very long one, repeated rows, and extra columns named like the operators' own."""
    rows = [
        (1, None), (2, ""), (3, "  \n\t "), (4, LONG), (5, "The quick brown fox jumps over the lazy dog near the river bank today"),
        (5, "The quick brown fox jumps over the lazy dog near the river bank today"), (6, "ÉTÉ élan naïve <|endoftext|> 汉字 🙂 ﬁ Σας \x01\x1c x"), (None, "no id at all here my friend"), (7, "a"),
    ]
    df = spark.createDataFrame([(i, t, "en", "s", 0, 1.0, "x", 9) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, row string, fp long")
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
