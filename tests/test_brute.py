"""Queries without SQL against plain versions, on the smallest tables."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from tidepool.functions import chunks
from tidepool.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet").collect()


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: registry.queries()[name](spark, SF).collect()


def cut(data):
    ends, fp, start = [], 0, 0
    for i, b in enumerate(data, 1):
        fp = (fp << 1 ^ b) & (1 << 64) - 1
        if i - start >= chunks.LEAST and (i - start >= chunks.LARGEST or fp & chunks.MASK == 0):
            ends.append(i)
            start, fp = i, 0
    if start < len(data):
        ends.append(len(data))
    return [data[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905


@pytest.fixture(scope="module")
def pieces(rows):
    return {r.doc_id: cut(r.text.encode()) for r in rows("documents")}


def test_content_chunks(run, pieces):
    assert {(r.doc_id, r.nth): (r.size, r.sha) for r in run("ded_cdc")} == {(i, n): (len(c), hashlib.sha256(c).hexdigest()) for i, cs in pieces.items() for n, c in enumerate(cs)}
    ends = defaultdict(dict)
    for r in run("ded_cdc_c"):
        ends[r.doc_id][r.nth] = r.end
    assert dict(ends) == {i: {n: sum(map(len, cs[: n + 1])) for n in range(len(cs))} for i, cs in pieces.items() if cs}


def test_references_to_the_first(run, pieces):
    seen, want = set(), {}
    for i in sorted(pieces):
        for n, c in enumerate(pieces[i]):
            want[i, n] = "REF" if c in seen else "FULL"
            seen.add(c)
    got = {(r.doc_id, r.nth): (r.kind, r.size) for r in run("ded_encode")}
    assert {k: kind for k, (kind, _) in got.items()} == want and all(size == 32 for kind, size in got.values() if kind == "REF")


def simhash(data):
    if len(data) < 4:
        return 0
    ones, n = [0] * 64, len(data) - 3
    for i in range(n):
        h = chunks.FNV_OFFSET
        for b in data[i : i + 4]:
            h = (h ^ b) * chunks.FNV_PRIME & (1 << 64) - 1
        for bit in range(64):
            ones[bit] += h >> bit & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > n)


def test_fingerprints(run, rows):
    prints = {r.doc_id: r.h % (1 << 64) for r in run("ded_simhash")}
    few = sorted(rows("documents"), key=lambda r: len(r.text))[:60]
    assert all(prints[r.doc_id] == simhash(r.text.encode()) for r in few)
    assert {r.doc_id: r.distance for r in run("ded_hamming")} == {i: (prints[i] ^ prints[i - 1]).bit_count() for i in prints if i - 1 in prints}
    assert {(r.doc_id, r.band): r.value for r in run("ded_bands")} == {(i, b): h >> 8 * b & 255 for i, h in prints.items() for b in range(8)}
    first: dict = {}
    for i in sorted(prints):
        first.setdefault(prints[i], i)
    one = {i: h for h, i in first.items()}
    near = {(a, b): d for a in one for b in one if a < b and (d := (one[a] ^ one[b]).bit_count()) <= 8 and any((one[a] ^ one[b]) >> 8 * k & 255 == 0 for k in range(8))}
    assert {(r.a, r.b): r.distance for r in run("jn_lsh_bands")} == near
    best: dict = {}
    for (a, b), d in near.items():
        for x, y in ((a, b), (b, a)):
            best[x] = min(best.get(x, (99, 0)), (d, y))
    assert {r.a: (r.distance, r.b) for r in run("jn_bands_sql")} == best


def lines(text):
    return [x for x in (s.strip(" ") for s in (text or "").split("\n")) if x]


def test_prompts_with_references(run, rows):
    docs = {r.doc_id: lines(r.text) for r in rows("documents")}
    n = Counter(x for ls in docs.values() for x in ls)
    want = {i: (sum(map(len, ls)), sum(min(len(x), 14) if n[x] >= 3 and len(x) > 14 else len(x) for x in ls)) for i, ls in docs.items() if ls}
    assert {r.doc_id: (r.before, r.after) for r in run("ded_compact_prompt")} == want


def by_user(rows):
    out = defaultdict(list)
    for r in sorted(rows("events"), key=lambda r: (r.ts, r.event_id)):
        out[r.user_id].append(r)
    return out


def test_sequences(run, rows):
    users = by_user(rows)
    codes, tokens = {}, {}
    for u, events in users.items():
        recent = sorted({e.event_type for e in events})
        for n, e in enumerate(events):
            codes[u, n] = recent.index(e.event_type)
            recent.insert(0, recent.pop(codes[u, n]))
        seq, at, count = [e.event_type for e in events], 0, 0
        while at < len(seq):
            fits = [len(p) for p in (("click", "view", "purchase"), ("view", "view", "view"), ("error", "error"), ("signup", "click")) if tuple(seq[at : at + len(p)]) == p]
            at, count = at + max(fits, default=1), count + 1
        tokens[u] = (len(seq), count)
    assert {(r.user_id, r.place): r.code for r in run("cmp_mtf")} == codes
    assert {r.user_id: (r.n_events, r.n_tokens) for r in run("str_motif_encode")} == tokens


def sentences(text):
    return [s for s in (x.strip(" ") for x in re.sub(r"([.!?])[ \t]+", r"\1\n", text or "").split("\n")) if s]


def test_compacted_turns(run, rows):
    want = {}
    for r in rows("conversations"):
        kept, used = [], 0
        for i, s in enumerate(sentences(r.text)):
            used += len(s) + 1
            if used > 240 and i:
                break
            kept.append(s)
        if kept:
            want[r.conv_id, r.turn] = " ".join(kept)[:240]
    assert {(r.conv_id, r.turn): r.text for r in run("ctx_compact")} == want


def test_chunks_of_texts(run, rows):
    docs = {r.doc_id: r.text for r in rows("documents")}
    for name, most in (("ext_chunk_text", 2000), ("ext_chunk_embed", None)):
        got = defaultdict(dict)
        for r in run(name):
            got[r.doc_id][r.nth] = r.chunk
        for i, cs in got.items():
            at = 0
            for n in range(len(cs)):
                gap = len(docs[i][at:]) - len(docs[i][at:].lstrip())
                here = docs[i].rfind(cs[n], 0, at + gap + len(cs[n]))  # in order, nothing left out but blanks
                assert here >= 0
                at = max(at, here + len(cs[n]))
                assert most is None or len(cs[n]) <= most
                assert most or chunks.estimated_tokens(cs[n]) <= 384 or len(cs[n]) <= 256
            assert docs[i][at:].strip() == ""


def test_filters_never_lose(run, rows, spark):
    from tidepool.plans.tables import log_lines

    packets = defaultdict(set)
    for r in log_lines(spark, SF).select("line_no", "text").collect():
        packets[r.line_no // 256] |= set(re.findall("[a-z0-9_]{3,}", r.text.lower()))
    got = {r.packet for r in run("ret_cold_index")}
    assert {p for p, w in packets.items() if {"click", "u12"} <= w} <= got <= set(packets)
    rates = run("ret_fpr")
    assert len(rates) == len(packets) and all(0 <= r.rate < 0.2 for r in rates)
    blocks = run("ret_block_bloom")
    assert {r.block for r in blocks} == {p // 4 for p in packets} and all(0 < r.n_bits < 8192 and r.rate < 0.5 for r in blocks)


def test_filters_are_unions(spark):
    from tidepool.functions import bloom
    from tidepool.operators import packets as pk

    df = spark.createDataFrame([(i, f"word{i} errors common running") for i in range(40)], "n long, text string")
    small, large = pk.index(df, "n", "text", size=5), pk.index(df, "n", "text", size=20)
    assert {r.block: r.filter for r in pk.blocks(small, 4).collect()} == {r.packet: r.filter for r in large.collect()}
    hit = small.where(pk.filter_has(small["filter"], ["word17", "error"])).select("packet").collect()
    assert 3 in [r.packet for r in hit] and len(hit) < 8
    assert small.where(bloom.may_contain("filter", ["word3", "common"])).select("packet").first().packet == 0


def test_lists_without_repeats(run, rows, spark):
    got = defaultdict(dict)
    for r in run("set_dedup_results"):
        got[r.query_id][r.rank] = r.doc_id
    texts = {r.doc_id: set(re.findall("[a-z0-9_]+", r.text.lower())) for r in rows("documents")}
    for kept in got.values():
        ids = [kept[k] for k in sorted(kept)]
        assert kept[1] == ids[0]  # the best always stays
        assert all(len(texts[a] & texts[b]) < 0.8 * len(texts[a] | texts[b]) for i, a in enumerate(ids) for b in ids[:i])


def test_template_banks(run):
    bank = sorted(run("src_template_csv"), key=lambda r: r.specificity)
    assert [r.wildcards for r in bank] == sorted(r.wildcards for r in bank) == [2, 4]
    assert re.match(bank[0].pattern, "Error: timeout for server-1 after 2.5 ms") and not re.match(bank[1].pattern, "Error: timeout for x after y ms")
    tuned = {r.threshold: (r.templates, r.slots, r.score) for r in run("ext_template_tune")}
    assert set(tuned) == {0.4, 0.6, 0.8, 1.0} and all(s == pytest.approx(t + 0.1 * n) for t, n, s in tuned.values())
    assert [tuned[t][1] for t in sorted(tuned)] == sorted(tuned[t][1] for t in tuned)  # a stricter share makes more slots


def test_codes_of_letters(run, rows):
    n = Counter(c for r in rows("documents") for c in r.text)
    got = {r.symbol: r for r in run("cmp_huffman")}
    assert {s: r.n for s, r in got.items()} == dict(n) and sum(2.0**-r.bits for r in got.values()) == pytest.approx(1)


def test_sessions(run, rows):
    whole = defaultdict(list)
    for r in sorted(rows("conversations"), key=lambda r: (r.conv_id, r.turn)):
        whole[r.conv_id].append((r.role, r.text))
    seen: dict = {}
    cuts = {i: cut("\n".join(f"{a}: {t}" for a, t in turns).encode()) for i, turns in whole.items()}
    for i in sorted(cuts):
        for c in cuts[i]:
            seen.setdefault(c, i)
    got = {r.conv_id: r for r in run("ded_session")}
    for i, turns in whole.items():
        roles = [a for a, _ in turns]
        threes = [tuple(roles[k : k + 3]) for k in range(max(1, len(roles) - 2))]
        assert (got[i].n_chunks, got[i].n_new, got[i].raw, got[i].repeats) == (len(cuts[i]), sum(seen[c] == i for c in cuts[i]), sum(map(len, cuts[i])), len(threes) - len(set(threes)))


def test_readers_and_scorers(run, rows, spark):
    items = {r.item_id: set(re.findall("[a-z0-9_]+", r.text.lower())) for r in rows("benchmark")}
    for r in run("rlm_read"):
        assert r.shared == len(items[r.doc_id % len(items)] & set(re.findall("[a-z0-9_]+", r.claim.lower()))) > 0 and r.place <= 5
    for name in ("ml_reranker", "ml_policy_rl"):
        held = [r for r in registry.queries()[name](spark, "/root/testdata/sf0.01").collect() if r.held_out]
        usual = Counter(r.label for r in held).most_common(1)[0][1] / len(held)
        right = sum(r.label == r.prediction for r in held) / len(held)
        assert right >= usual - 0.05, (name, right, usual)
