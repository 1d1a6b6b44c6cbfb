"""Exact and fast use of public BPE vocabularies inside Python workers.

Stretches of text whose characters all lie in a fixed Latin range are split by an explicit
character-class pattern and merged by rank; words with any other character go, with what touches
them up to the nearest blank, to the vocabulary's own library. The two give the same ids
(tests/llm/test_tokens.py holds them against each other).
"""

from __future__ import annotations

import functools
import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterator

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters for which the pattern below and the library agree: Latin blocks and common punctuation, without the controls that Python alone calls blank and without the marker \x01.
SAFE = "\x00\x02-\x1b\x20-ɏ‐-‧‰-⁞€"
_UNSAFE = re.compile(f"[^{SAFE}]")
_LATIN = [chr(c) for c in range(0x250)]
#: Letters that lower-casing takes out of the range: safe as they are, but not for a vocabulary that lower-cases.
_LEAVING = "".join(c for c in _LATIN if any(ord(x) >= 0x250 for x in c.lower()))
_UNSAFE_TO_LOWER = re.compile(f"[^{SAFE}]|[{_LEAVING}]")
LETTERS = re.escape("".join(c for c in _LATIN if unicodedata.category(c)[0] == "L"))
NUMBERS = re.escape("".join(c for c in _LATIN if unicodedata.category(c)[0] == "N"))
BLANKS = "\\t-\\r \\x85\\xa0"
#: Entries that a worker keeps of words outside the vocabulary.
CACHE = 400_000


def is_safe(text: str) -> bool:
    return _UNSAFE.search(text) is None


def stretches(text: str, unsafe: re.Pattern[str] = _UNSAFE) -> Iterator[tuple[bool, str]]:
    """The text in parts (safe or not), cut only before a space that follows a safe character that is no blank: no pre-token and no lookahead crosses such a place."""
    done, found = 0, unsafe.search(text)
    while found:
        start, end = found.start(), found.end()
        while (start := text.rfind(" ", done, start)) > done and (text[start - 1].isspace() or unsafe.match(text, start - 1)):
            pass
        start = max(start, done)
        while (end := text.find(" ", end)) >= 0 and (text[end - 1].isspace() or unsafe.match(text, end - 1)):
            end += 1
        end = len(text) if end < 0 else end
        if start > done:
            yield True, text[done:start]
        yield False, text[start:end]
        done, found = end, unsafe.search(text, end)
    if done < len(text):
        yield True, text[done:]


def byte_of_char() -> dict[str, int]:
    """The bytes behind the printable characters of byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _special(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f)["added_tokens"])


class WordBpe:
    """Lower-case BPE with word ends. The end of a word is the byte 1, which no safe text holds; its pairs have the lowest ranks, so that they merge first, as the vocabulary has it."""

    PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{BLANKS}{LETTERS}{NUMBERS}]+")

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path, self.special = path, _special(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte, ranks = byte_of_char(), {}
        for token, i in vocab.items():
            if token in self.special:
                continue
            ends = token.endswith("</w>") and token != "</w>"
            ranks[bytes(byte[c] for c in (token[:-4] if ends else token)) + b"\x01" * ends] = i
        self.core = tiktoken.Encoding("word", pat_str="[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return library(self.path).encode(text, add_special_tokens=False).ids
        out: list[int] = []
        for safe, part in stretches(text, _UNSAFE_TO_LOWER):
            out += self._safe_ids(part) if safe else library(self.path).encode(part, add_special_tokens=False).ids
        return out

    def _safe_ids(self, text: str) -> list[int]:
        words = self.PATTERN.findall(text.lower())
        return self.core.encode_ordinary("\x01".join(words) + "\x01") if words else []


class ByteBpe:
    """Token counts of a byte-level BPE. `whole` holds the vocabulary strings that encode alone as one token; a pre-token among them counts as one without any merge."""

    PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{BLANKS}{LETTERS}{NUMBERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")

    def __init__(self, path: str, whole: frozenset[str] | None = None) -> None:
        self.path, self.special = path, _special(path)
        self.whole = whole_tokens(path) if whole is None else whole
        self.known: dict[str, int] = dict.fromkeys(self.whole, 1)
        self.limit = len(self.known) + CACHE

    def merged(self, word: str) -> int:
        """Tokens of a pre-token that is no whole token."""
        n = len(library(self.path).encode(word, add_special_tokens=False).ids)
        if len(word) <= 64:
            if len(self.known) >= self.limit:
                self.known = dict.fromkeys(self.whole, 1)
            self.known[word] = n
        return n

    def count(self, text: str) -> int:
        if any(s in text for s in self.special):
            return len(library(self.path).encode(text, add_special_tokens=False).ids)
        return sum(self._safe_count(part) if safe else len(library(self.path).encode(part, add_special_tokens=False).ids) for safe, part in stretches(text))

    def _safe_count(self, text: str) -> int:
        words = self.PATTERN.findall(text)
        get = self.known.get
        counts = [get(w) for w in words]
        missing = [i for i, n in enumerate(counts) if n is None]
        for i in missing:
            counts[i] = self.known.get(words[i]) or self.merged(words[i])
        return sum(counts)


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and that the library encodes as exactly their own id; found by encoding every one of them."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte, special, strings = byte_of_char(), {t["content"] for t in spec["added_tokens"]}, {}
    for token, i in spec["model"]["vocab"].items():
        if token not in special:
            try:
                strings[bytes(byte[c] for c in token).decode()] = i
            except UnicodeDecodeError:
                continue
    texts = [s for s in strings if is_safe(s) and ByteBpe.PATTERN.fullmatch(s)]
    encoded = library(path).encode_batch(texts, add_special_tokens=False)
    return frozenset(sys.intern(s) for s, e in zip(texts, encoded, strict=True) if e.ids == [strings[s]])


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
