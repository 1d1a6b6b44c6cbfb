"""Scalar functions: token forms, labels and slugs, hashes, vectors; and the protocols that they can be replaced through."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Forms of tokens by their use; those of the last two keep their case. Fixed values.
FORMS = {"query": r"[a-z0-9_\-]+", "word": r"[a-z0-9_]+", "signature": r"[a-z0-9_\-]{3,}", "path": r"[A-Za-z0-9_./:-]{2,}", "keyword": r"[A-Za-z0-9_]{3,}"}
CASED = ("path", "keyword")
SLUG_BYTES, LABEL = 120, 220
DIMENSIONS, LEAST_DIMENSIONS = 384, 32
FNV32_OFFSET, FNV32_PRIME = 2166136261, 16777619


def tokens(text: Column, form: str = "word") -> Column:
    said = F.coalesce(text, F.lit(""))
    return F.regexp_extract_all(said if form in CASED else F.lower(said), F.lit(FORMS[form]), F.lit(0))


# Names


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def relation(value: Column) -> Column:
    """A relation as a key: lower case, blanks as underscores, other marks off."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9_ ]+", ""), r"\s+", "_")


def relation_label(value: Column) -> Column:
    return squeezed(F.regexp_replace(value, "_", " "))


def truncated(text: Column, limit: int = LABEL) -> Column:
    whole = squeezed(text)
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(F.substring(whole, 1, max(0, limit - 1)), F.lit("…")))


def slug(text: str | None) -> str:
    """Letters, digits and their marks in lower case, all else as single dashes; at most SLUG_BYTES bytes."""
    out: list[str] = []
    for c in unicodedata.normalize("NFKC", (text or "").strip().lower()):
        kind = unicodedata.category(c)[0]
        if kind in "LN" or (kind == "M" and out and out[-1] != "-"):
            out.append(c)
        elif kind != "M" and out and out[-1] != "-":
            out.append("-")
    cut = "".join(out).strip("-").encode()[:SLUG_BYTES].decode(errors="ignore").strip("-")
    return cut or "untitled"


# Hashes


def fnv32(text: str, seed: int = 0) -> int:
    h = FNV32_OFFSET ^ seed
    for c in text:
        h = ((h ^ ord(c)) * FNV32_PRIME) & 0xFFFFFFFF
    return h


def blake64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=8).digest(), "little")


def hash_embedding(text: str | None, dims: int = DIMENSIONS) -> np.ndarray:
    """A unit vector of a text's words and pairs of words, each at a place and with a sign that its hash tells; zero without words."""
    import re

    dims = max(LEAST_DIMENSIONS, dims)
    words = re.findall(FORMS["word"], (text or "").lower())
    out = np.zeros(dims, np.float32)
    for feature in (*words, *(f"{a}_{b}" for a, b in zip(words, words[1:], strict=False))):
        h = blake64(feature)
        out[(h & 0xFFFFFFFF) % dims] += -1.0 if h >> 32 & 1 else 1.0
    size = float(np.linalg.norm(out))
    return out / size if size else out


def _mapped(f: Callable, kind: T.DataType, column: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(f), kind)(column)


def slugs(text: Column) -> Column:
    return _mapped(slug, T.StringType(), text)


def fnv32s(text: Column) -> Column:
    return _mapped(lambda t: fnv32(t or ""), T.LongType(), text)


def blake64s(text: Column) -> Column:
    """As signed longs."""
    return _mapped(lambda t: int(np.uint64(blake64(t or "")).astype(np.int64)), T.LongType(), text)


# Protocols


class Embedder(Protocol):
    """Vectors of a batch of texts, one row each, of a fixed width."""

    dims: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


class HashEmbedder:
    """The embedder that needs no model."""

    def __init__(self, dims: int = DIMENSIONS) -> None:
        self.dims = max(LEAST_DIMENSIONS, dims)

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.stack([hash_embedding(t, self.dims) for t in texts]) if texts else np.zeros((0, self.dims), np.float32)


def embedded(text: Column, embedder: Embedder | None = None) -> Column:
    """Vectors of texts by an embedder, batch by batch."""
    model = embedder or HashEmbedder()

    def run(s: pd.Series) -> pd.Series:
        out = np.asarray(model.embed(s.fillna("").tolist()), np.float32)
        if out.shape != (len(s), model.dims):
            raise ValueError(f"the embedder gave {out.shape} for {len(s)} texts of {model.dims} dimensions")
        return pd.Series(list(out))

    return F.pandas_udf(run, T.ArrayType(T.FloatType()))(text)


def token_counts(text: Column, tokenizer: Tokenizer) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: len(tokenizer.encode(t or ""))), T.LongType())(text)


# Flags


@dataclass(frozen=True)
class Flags:
    """What a session switches on or off, by conf keys `tidepool.<name>`."""

    graph: bool = True
    facts: bool = True
    hooks: bool = False
    predictive: bool = False
    semantic_filters: bool = True

    @classmethod
    def of(cls, spark: SparkSession) -> Flags:
        read = lambda f: spark.conf.get(f"tidepool.{f.name}", str(f.default)).strip().lower() in ("1", "true", "yes", "on")
        return cls(**{f.name: read(f) for f in fields(cls)})
