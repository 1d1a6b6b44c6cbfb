"""Packing and token counts against the vocabulary's own library."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidepool.llm import packing, token_counts, vocab

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def plain(path, text):
    return vocab.library(path).encode(text, add_special_tokens=False).ids


@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x250), st.sampled_from("é'´’ \n\t\x85\xa0\x1c\x01Σ汉‐€ 's'LL"), st.characters(codec="utf-8")), max_size=60))
@settings(max_examples=400, deadline=None)
def test_ids_and_counts_equal_the_library(text):
    assert vocab.word_bpe(WORD).ids(text) == plain(WORD, text)
    assert vocab.byte_bpe(BYTE).count(text) == len(plain(BYTE, text))


def test_every_safe_character():
    for a in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]:
        for text in (chr(a), f"a{chr(a)}b", f"1 {chr(a)}{chr(a)} 2", f"'{chr(a)}s", f"x{chr(a)} "):
            assert vocab.word_bpe(WORD).ids(text) == plain(WORD, text), hex(a)
            assert vocab.byte_bpe(BYTE).count(text) == len(plain(BYTE, text)), hex(a)


@given(st.lists(st.sampled_from(["plain", " ", "  ", "\n", "汉字", "\u3000", "e\u0301", "\u0301", "Ɓa", "Σας", "'s", "12", "½", ".", "\x1c", "\x85", "🙂"]), max_size=30).map("".join))
@settings(max_examples=600, deadline=None)
def test_stretches_lose_nothing(text):
    for unsafe in (vocab._UNSAFE, vocab._UNSAFE_TO_LOWER):
        assert "".join(part for _, part in vocab.stretches(text, unsafe)) == text
        assert all(safe == (unsafe.search(part) is None) for safe, part in vocab.stretches(text, unsafe))
    assert vocab.word_bpe(WORD).ids(text) == plain(WORD, text)
    assert vocab.byte_bpe(BYTE).count(text) == len(plain(BYTE, text))


def test_a_foreign_word_does_not_send_the_text_to_the_library(monkeypatch):
    sent = []
    whole = vocab.library(BYTE)

    class Spy:
        def encode(self, text, **more):
            sent.append(text)
            return whole.encode(text, **more)

    text = "the one and the other " * 400 + "汉字 and the last"
    want = len(plain(BYTE, text))
    monkeypatch.setattr(vocab, "library", lambda path: Spy())
    assert vocab.byte_bpe(BYTE).count(text) == want
    assert sent == [" 汉字 and"]


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "a<|endoftext|> b", "<|startoftext|>x", "don't we'll 'S", "   many   spaces  \n\n", "x" * 500])
def test_special_strings(text):
    assert vocab.word_bpe(WORD).ids(text) == plain(WORD, text)
    assert vocab.byte_bpe(BYTE).count(text) == len(plain(BYTE, text))


def test_whole_tokens_are_proven():
    whole = vocab.whole_tokens(BYTE)
    assert len(whole) > 40_000
    assert all(len(plain(BYTE, w)) == 1 for w in sorted(whole)[:2000])


def test_counts_of_odd_rows(odd_docs, no_docs):
    got = token_counts.token_counts(odd_docs, BYTE).collect()
    want = sorted(((r.doc_id or -1), len((r.text or "").encode()), len(plain(BYTE, r.text or ""))) for r in odd_docs.collect())
    assert sorted(((r.doc_id or -1), r.n_bytes, r.n_tokens) for r in got) == want
    assert token_counts.token_counts(no_docs, BYTE).collect() == []


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=200, deadline=None)
def test_best_fit_decreasing(lengths):
    where, offset, n = packing.best_fit_decreasing(lengths, 64)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    left: list[int] = []
    for i in order:  # the plain form: the tightest open window, else a new one
        fits = [w for w, r in enumerate(left) if r >= lengths[i]]
        least = min((left[w] for w in fits), default=64)
        assert (64 - offset[i]) == least
        if where[i] == len(left):
            left.append(64)
        assert left[where[i]] == 64 - offset[i]
        left[where[i]] -= lengths[i]
    assert n == len(left)


@pytest.mark.parametrize("window", [32, 2048])
def test_pack_round_trip(odd_docs, no_docs, window):
    rows = packing.pack(odd_docs, WORD, window=window).collect()
    want = sorted(((r.doc_id or -1), plain(WORD, r.text or "") + [1]) for r in odd_docs.collect())
    got: dict = {}
    for r in sorted(rows, key=lambda r: r.start):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length
        got.setdefault((r.doc_id or -1, r.doc_tokens), {}).setdefault(r.start, []).append(ids)
    for doc, ids in want:
        for start in [s for s in got[(doc, len(ids))]]:
            assert all(p == ids[start : start + len(p)] for p in got[(doc, len(ids))][start])
    assert sum(r.length for r in rows) == sum(len(ids) for _, ids in want)
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    assert packing.pack(no_docs, WORD).collect() == []
