"""Byte forms of lines, slots and symbols, and their inverses. Plain functions over bounded lists; Spark runs them packet by packet."""

from __future__ import annotations

import bz2
import heapq
import itertools
import threading
import zlib
from collections.abc import Iterable, Iterator

import numpy as np

#: Distinct values up to which a channel is kept as a dictionary. Fixed value.
DICTIONARY = 16
WILDCARD = "<*>"
LEVEL = 10


#: The compressor and decompressor of each thread; making one takes longer than packing a few lines.
_made = threading.local()


def _zstd(data: bytes) -> bytes:
    if not hasattr(_made, "compressor"):
        import zstandard

        _made.compressor = zstandard.ZstdCompressor(LEVEL)
    return _made.compressor.compress(data)


def _unzstd(data: bytes) -> bytes:
    if not hasattr(_made, "decompressor"):
        import zstandard

        _made.decompressor = zstandard.ZstdDecompressor()
    return _made.decompressor.decompress(data)


# Numbers


def varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 127
        out.append(low | (128 if n else 0))
        if not n:
            return bytes(out)


def zigzag(n: int) -> int:
    return 2 * n if n >= 0 else -2 * n - 1


def unzigzag(n: int) -> int:
    return n >> 1 if n % 2 == 0 else -(n + 1 >> 1)


class Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def varint(self) -> int:
        n = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def text(self) -> str:
        return self.take(self.varint()).decode()


def text(s: str) -> bytes:
    data = s.encode()
    return varint(len(data)) + data


def bitpacked(values: list[int], bits: int) -> bytes:
    """Numbers of so many bits each, lowest bit first."""
    if not values:
        return b""
    table = (np.array(values, np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(table.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unbitpacked(data: bytes, bits: int, n: int) -> list[int]:
    if not n:
        return []
    table = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits).astype(np.uint64)
    return (table << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).tolist()


# Channels: the values of one slot of one template


def channel_kind(values: list[str]) -> str:
    """INT for plain decimal numbers, DICT for few different values, else RAW."""
    if all(v.isascii() and v.isdigit() and (v == "0" or v[0] != "0") and len(v) < 19 for v in values):
        return "INT"
    return "DICT" if len(set(values)) <= DICTIONARY else "RAW"


def channel(values: list[str]) -> bytes:
    kind = channel_kind(values)
    out = bytearray(kind[:1].encode() + varint(len(values)))
    if kind == "INT":
        numbers = list(map(int, values))
        out += b"".join(varint(zigzag(b - a)) for a, b in zip([0, *numbers], numbers))  # noqa: B905
    elif kind == "DICT":
        words = sorted(set(values))
        bits = max(1, (len(words) - 1).bit_length())
        out += varint(len(words)) + b"".join(map(text, words)) + bitpacked([words.index(v) for v in values], bits)
    else:
        out += b"".join(map(text, values))
    return bytes(out)


def read_channel(r: Reader) -> list[str]:
    kind, n = r.take(1), r.varint()
    if kind == b"I":
        return [str(x) for x in itertools.accumulate(unzigzag(r.varint()) for _ in range(n))]
    if kind == b"D":
        words = [r.text() for _ in range(r.varint())]
        bits = max(1, (len(words) - 1).bit_length())
        return [words[i] for i in unbitpacked(r.take((n * bits + 7) // 8), bits, n)]
    return [r.text() for _ in range(n)]


# Packets of lines: (line number, template, slots)


def rendered(template: str, slots: list[str]) -> str:
    parts = template.split(WILDCARD)
    return parts[0] + "".join(s + p for s, p in zip(slots, parts[1:], strict=True))


def moved_to_front(ids: Iterable[int], recent: list[int]) -> Iterator[int]:
    """Places of ids in a list of the most recent ones, which is changed; an id that is new comes at the end."""
    for i in ids:
        if i not in recent:
            recent.append(i)
        place = recent.index(i)
        yield place
        recent.insert(0, recent.pop(place))


def packet(lines: list[tuple[int, str, list[str]]]) -> bytes:
    """Lines by columns: numbers, templates by recency, and a channel for each slot of each template."""
    templates = sorted({t for _, t, _ in lines})
    out = bytearray(varint(len(templates)) + b"".join(map(text, templates)) + channel([str(n) for n, _, _ in lines]))
    out += b"".join(map(varint, moved_to_front([templates.index(t) for _, t, _ in lines], list(range(len(templates))))))
    for t in templates:
        rows = [s for _, x, s in lines if x == t]
        for values in zip(*rows, strict=True):
            out += channel(list(values))
    return _zstd(bytes(out))


def read_packet(data: bytes) -> list[tuple[int, str, list[str]]]:
    r = Reader(_unzstd(data))
    templates = [r.text() for _ in range(r.varint())]
    numbers = read_channel(r)
    recent, order = list(range(len(templates))), []
    for _ in numbers:
        order.append(recent.pop(r.varint()))
        recent.insert(0, order[-1])
    columns = [[read_channel(r) for _ in range(t.count(WILDCARD))] for t in templates]
    rows = [iter(zip(*c, strict=True)) if c else itertools.repeat(()) for c in columns]
    return [(int(n), templates[i], list(next(rows[i]))) for n, i in zip(numbers, order, strict=True)]


# Containers: packets behind an index, read one by one


def container(packets: list[bytes]) -> bytes:
    return varint(len(packets)) + b"".join(varint(len(p)) for p in packets) + b"".join(packets)


class Lazy:
    """Packets of a container; only those that are asked for are read, each once."""

    def __init__(self, data: bytes) -> None:
        r = Reader(data)
        sizes = [r.varint() for _ in range(r.varint())]
        self.data, self.ends = data, list(itertools.accumulate(sizes, initial=r.at))
        self.read: dict[int, list[tuple[int, str, list[str]]]] = {}

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, i: int) -> list[tuple[int, str, list[str]]]:
        if i not in self.read:
            self.read[i] = read_packet(self.data[self.ends[i] : self.ends[i + 1]])
        return self.read[i]


# Streams: windows of lines whose templates and last numbers are remembered


class Stream:
    """Both ends of a stream hold the same state: templates in the order of their first use, the most recent of them, and each template's last slots."""

    def __init__(self) -> None:
        self.templates: list[str] = []
        self.recent: list[int] = []
        self.last: dict[int, list[str]] = {}

    def state(self) -> tuple[list[str], list[int], list[list[str]]]:
        return self.templates, self.recent, [self.last.get(i, []) for i in range(len(self.templates))]

    @classmethod
    def of(cls, templates: list[str], recent: list[int], last: list[list[str]]) -> Stream:
        s = cls()
        s.templates, s.recent, s.last = list(templates), list(recent), {i: list(v) for i, v in enumerate(last)}
        return s

    def write(self, lines: list[tuple[str, list[str]]]) -> bytes:
        """One window: its new templates, places of templates by recency, and slots, numbers as differences from the template's last ones."""
        new = [t for t in dict.fromkeys(t for t, _ in lines) if t not in self.templates]
        self.templates += new
        at = {t: i for i, t in enumerate(self.templates)}
        self.recent += [at[t] for t in new]
        places = list(moved_to_front([at[t] for t, _ in lines], self.recent))
        out = bytearray(varint(len(new)) + b"".join(map(text, new)) + varint(len(lines)) + b"".join(map(varint, places)))
        for t, slots in lines:
            before = self.last.get(at[t]) or [""] * len(slots)
            for a, b in zip(before, slots, strict=True):
                number = channel_kind([b]) == "INT"
                out += varint(1 + zigzag(int(b) - (int(a) if a and channel_kind([a]) == "INT" else 0))) if number else varint(0) + text(b)
            self.last[at[t]] = list(slots)
        return _zstd(bytes(out))

    def read(self, data: bytes) -> list[tuple[str, list[str]]]:
        r = Reader(_unzstd(data))
        new = [r.text() for _ in range(r.varint())]
        self.recent += range(len(self.templates), len(self.templates) + len(new))
        self.templates += new
        order = []
        for _ in range(r.varint()):
            order.append(self.recent.pop(r.varint()))
            self.recent.insert(0, order[-1])
        out = []
        for i in order:
            n = self.templates[i].count(WILDCARD)
            slots = []
            for a in self.last.get(i) or [""] * n:
                code = r.varint()
                slots.append(str(unzigzag(code - 1) + (int(a) if a and channel_kind([a]) == "INT" else 0)) if code else r.text())
            self.last[i] = slots
            out.append((self.templates[i], slots))
        return out


# Huffman codes


def code_lengths(counts: dict[str, int]) -> dict[str, int]:
    """Length of each symbol's code; a single symbol has one bit."""
    if len(counts) < 2:
        return dict.fromkeys(counts, 1)
    heap = [(n, i, (s,)) for i, (s, n) in enumerate(sorted(counts.items()))]
    heapq.heapify(heap)
    length = dict.fromkeys(counts, 0)
    for i in itertools.count(len(heap)):
        (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            length[s] += 1
        if not heap:
            return length
        heapq.heappush(heap, (n + m, i, a + b))
    raise AssertionError


def canonical_codes(lengths: dict[str, int]) -> dict[str, str]:
    """Codes by length, then by symbol, as strings of bits."""
    out, code, last = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        out[symbol], last = format(code, f"0{n}b"), n
        code += 1
    return out


def huffman(symbols: Iterable[str], codes: dict[str, str]) -> bytes:
    bits = "".join(codes[s] for s in symbols)
    return varint(len(bits)) + np.packbits(np.frombuffer(bits.encode(), np.uint8) - 48, bitorder="big").tobytes()


def unhuffman(data: bytes, codes: dict[str, str]) -> list[str]:
    r = Reader(data)
    n = r.varint()
    bits = "".join(map(str, np.unpackbits(np.frombuffer(data[r.at :], np.uint8), count=n, bitorder="big").tolist())) if n else ""
    symbol = {c: s for s, c in codes.items()}
    out, code = [], ""
    for b in bits:
        code += b
        if code in symbol:
            out.append(symbol[code])
            code = ""
    return out


# Whole texts: several forms, each behind a mark of its own


def forms(data: bytes) -> dict[str, bytes]:
    """The text in every form, mark included. `nums` keeps the numbers apart from the rest. Bytes that are no text, like a chunk that begins within a letter, have the same forms."""
    import re

    part = lambda b: varint(len(b)) + b
    numbers = re.findall(b"[0-9]+", data)
    bare = re.sub(b"[0-9]+", b"\x00", data)
    out = {"RAW0": data, "ZSTD": _zstd(data), "ZLIB": zlib.compress(data, 9), "BZIP": bz2.compress(data)}
    if b"\x00" not in data:
        out["NUMS"] = _zstd(varint(len(numbers)) + b"".join(map(part, numbers)) + part(bare))
    lines = data.split(b"\n")
    place: dict[bytes, int] = {}
    at = [place.setdefault(x, len(place)) for x in lines]
    if len(place) < len(lines):
        out["LINE"] = _zstd(varint(len(place)) + b"".join(map(part, place)) + varint(len(lines)) + b"".join(map(varint, at)))
    return {mark: mark.encode() + body for mark, body in out.items()}


def smallest(data: bytes) -> bytes:
    return min(forms(data).values(), key=lambda x: (len(x), x[:4]))


def decoded(data: bytes) -> tuple[str, bytes]:
    """The mark of a form, and the text."""
    mark, body = bytes(data[:4]).decode(), bytes(data[4:])
    if mark == "RAW0":
        return mark, body
    if mark == "ZSTD":
        return mark, _unzstd(body)
    if mark == "ZLIB":
        return mark, zlib.decompress(body)
    if mark == "BZIP":
        return mark, bz2.decompress(body)
    if mark not in ("NUMS", "LINE"):
        raise ValueError(f"no form is marked {mark!r}")
    r = Reader(_unzstd(body))
    table = [r.take(r.varint()) for _ in range(r.varint())]
    if mark == "LINE":
        return mark, b"\n".join(table[r.varint()] for _ in range(r.varint()))
    parts = r.take(r.varint()).split(b"\x00")
    return mark, parts[0] + b"".join(n + p for n, p in zip(table, parts[1:], strict=True))


def delta(new: bytes, old: bytes) -> bytes:
    """`new` packed with `old` as its dictionary."""
    import zstandard

    d = zstandard.ZstdCompressionDict(old or b"x", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(3, dict_data=d).compress(new)


def undelta(data: bytes, old: bytes) -> bytes:
    import zstandard

    d = zstandard.ZstdCompressionDict(old or b"x", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdDecompressor(dict_data=d).decompress(data)
