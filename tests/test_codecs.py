"""Byte forms and their inverses."""

import heapq

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidepool.functions import chunks, codecs
from tidepool.plans import q_codecs

SLOT = st.one_of(st.integers(0, 10**20).map(str), st.sampled_from(["", "0", "007", "a", "é汉", "u12", "1.50", "-3"]), st.text(max_size=8))
TEMPLATES = ["User <*> did <*>", "plain", "<*>", "x<*><*>y", "end <*>"]


@st.composite
def lines(draw):
    out = []
    for n in sorted(draw(st.sets(st.integers(0, 5000), max_size=40))):
        t = draw(st.sampled_from(TEMPLATES))
        out.append((n, t, draw(st.lists(SLOT, min_size=t.count("<*>"), max_size=t.count("<*>")))))
    return out


@given(st.integers(-(10**18), 10**18))
def test_numbers(n):
    assert codecs.unzigzag(codecs.zigzag(n)) == n
    assert codecs.Reader(codecs.varint(codecs.zigzag(n))).varint() == codecs.zigzag(n)


@given(st.integers(1, 40).flatmap(lambda b: st.tuples(st.just(b), st.lists(st.integers(0, 2**b - 1), max_size=50))))
def test_bitpacked(case):
    bits, values = case
    assert codecs.unbitpacked(codecs.bitpacked(values, bits), bits, len(values)) == values


@given(st.lists(SLOT, max_size=60))
def test_channels(values):
    assert codecs.read_channel(codecs.Reader(codecs.channel(values))) == values


def test_channel_kinds():
    assert codecs.channel_kind(["1", "0", "20"]) == "INT" and codecs.channel_kind(["01"]) == "DICT"
    assert codecs.channel_kind([f"w{i}" for i in range(17)]) == "RAW" and len(codecs.channel([str(i) for i in range(1000)])) < 1100


@given(lines())
@settings(deadline=None)
def test_packets(rows):
    assert codecs.read_packet(codecs.packet(rows)) == rows
    parts = [rows[i : i + 7] for i in range(0, len(rows), 7)]
    lazy = codecs.Lazy(codecs.container([codecs.packet(p) for p in parts]))
    assert len(lazy) == len(parts)
    for i in range(len(parts))[::2]:
        assert lazy[i] == parts[i]
    assert set(lazy.read) == set(range(len(parts))[::2])


@given(st.lists(lines(), max_size=5))
@settings(deadline=None)
def test_streams_keep_their_state(windows):
    writer, reader = codecs.Stream(), codecs.Stream()
    for w in windows:
        rows = [(t, s) for _, t, s in w]
        data = codecs.Stream.of(*writer.state())  # as a state store would give it back
        packed = data.write(rows)
        writer = data
        assert reader.read(packed) == rows
        assert reader.state() == writer.state()


@given(st.dictionaries(st.characters(), st.integers(1, 1000), min_size=1, max_size=40))
@settings(deadline=None)
def test_huffman(counts):
    lengths = codecs.code_lengths(counts)
    heap, best = list(counts.values()), 0  # the least total is the sum of all merges
    heapq.heapify(heap)
    while len(heap) > 1:
        two = heapq.heappop(heap) + heapq.heappop(heap)
        best += two
        heapq.heappush(heap, two)
    if len(counts) > 1:
        assert sum(counts[s] * n for s, n in lengths.items()) == best
        assert sum(2.0**-n for n in lengths.values()) == pytest.approx(1)
    symbols = [s for s, n in counts.items() for _ in range(min(n, 3))]
    codes = codecs.canonical_codes(lengths)
    assert codecs.unhuffman(codecs.huffman(symbols, codes), codes) == symbols
    assert not any(a != b and codes[b].startswith(codes[a]) for a in codes for b in codes)


@given(st.text(max_size=300), st.text(max_size=100))
@settings(deadline=None)
def test_forms_and_deltas(new, old):
    data = (new + "\n" + new + " 12 0345").encode("utf-8", "replace")
    for mark, body in codecs.forms(data).items():
        assert codecs.decoded(body) == (mark, data)
    assert codecs.undelta(codecs.delta(data, old.encode("utf-8", "replace")), old.encode("utf-8", "replace")) == data
    with pytest.raises(ValueError, match="no form"):
        codecs.decoded(b"????")


@given(st.binary(max_size=300))
@settings(deadline=None)
def test_forms_of_bytes_that_are_no_text(data):
    """Chunks of a text may begin or end within a letter."""
    for some in (data, "é".encode()[1:] + data + b"\n1\n1\n" + "汉".encode()[:2]):
        for mark, body in codecs.forms(some).items():
            assert codecs.decoded(body) == (mark, some)
    codecs.decoded(codecs.smallest(data))


def test_boundaries_equal_the_loop():
    import numpy as np

    rng = np.random.default_rng(0)
    for data in (b"", b"x" * 1023, b"x" * 40_000, rng.integers(0, 256, 100_000).astype(np.uint8).tobytes(), b"abc \n" * 9000):
        ends, fp, start = [], 0, 0
        for i, b in enumerate(data, 1):
            fp = (fp << 1 ^ b) & (1 << 64) - 1
            if i - start >= chunks.LEAST and (i - start >= chunks.LARGEST or fp & chunks.MASK == 0):
                ends.append(i)
                start, fp = i, 0
        if start < len(data):
            ends.append(len(data))
        assert chunks.boundaries(data) == ends


def test_sessions_are_read_one_after_the_other_over_batches(spark):
    """Many sessions share a batch, one lies in many; none has a Python group of its own."""
    rows = [(s, i, "did <*> at <*>", [f"v{i % 3}", str(i * s)]) for s in range(60) for i in range(1 + 5 * (s % 17))]
    lines = spark.createDataFrame(rows, "session long, line_no long, template string, slots array<string>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = q_codecs.sessions_packed(lines, "session", window=8)
        got = {r.session: (r.n, r.intact) for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {s: (1 + 5 * (s % 17), True) for s in range(60)}
    assert "FlatMapGroupsInArrow" not in df._jdf.queryExecution().optimizedPlan().toString()
