"""Substring and suffix-array dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmere.llm import exchange, substrings, suffixes

WORDS = ["a", "b", "c", "d e", "é", "f\x1cg"]


def corpus(seed):
    r = random.Random(seed)
    docs = [(k, " ".join(r.choice(WORDS) for _ in range(r.randint(0, 40)))) for k in range(50)]
    return [*docs, (None, "a b c a b c a b c"), (None, None), (5, ""), (7, "x y z w q r s"), (7, "x y z w q r s"), (8, "p x y z w q"), (9, " \n "), (10, "z " * 60)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, chunk int")


def brute_words(docs, width):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in docs]
    seen = Counter(tuple(w[k : k + width]) for w in words for k in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = {p for k in range(len(w) - width + 1) if seen[tuple(w[k : k + width])] > 1 for p in range(k, k + width)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def brute_bytes(docs, width):
    low: dict[bytes, int] = {}
    for i, t in docs:
        b, v = (t or "").encode(), -1 if i is None else i
        for k in range(len(b) - width + 1):
            low[b[k : k + width]] = min(low.get(b[k : k + width], 1 << 60), v)
    out = []
    for i, t in docs:
        b, v = (t or "").encode(), -1 if i is None else i
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if low[b[k : k + width]] < v:
                gone[k : k + width] = b"\1" * width
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "block"), [(5, 3), (9, 4), (1, 1)])
def test_word_windows(spark, window, block):
    docs = corpus(window)
    got = substrings.remove_repeats(frame(spark, docs), window, block).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == brute_words(docs, window)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_long_repeats_at_the_production_window(spark):
    r = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(60))
    noise = lambda n: " ".join(str(r.random()) for _ in range(n))
    docs = [(k, f"{noise(20)} {passage if k % 2 else noise(60)} {noise(30)}") for k in range(12)]
    got = substrings.remove_repeats(frame(spark, docs)).collect()
    assert sorted((tuple(x)[:4] for x in got), key=repr) == brute_words(docs, 35)
    assert {x.n_removed for x in got if x.doc_id % 2} == {60}
    assert {x.n_removed for x in got if not x.doc_id % 2} == {0}


def test_empty_tables(spark):
    assert substrings.remove_repeats(frame(spark, [])).count() == 0
    assert suffixes.remove_repeats(frame(spark, [])).count() == 0


def test_a_window_must_hold_a_block():
    with pytest.raises(ValueError):
        substrings.Plan(10, 6, 40, 4)
    with pytest.raises(ValueError):
        suffixes.Plan(100, 20, 24, 40, 4, 10)


@pytest.mark.parametrize(("window", "gram", "common"), [(9, 4, 1 << 20), (9, 4, 2), (12, 6, 5), (33, 2, 9)])
def test_byte_windows(spark, window, gram, common):
    docs = corpus(window)
    got = suffixes.remove_repeats(frame(spark, docs), window, gram, 8, common).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute_bytes(docs, window)


@pytest.mark.parametrize("fan", [3, 6])
def test_packets_by_hops(spark, fan):
    """With few packets a group, messages take several hops and the rows stay the same."""
    docs = corpus(fan)
    got = substrings.remove_repeats(frame(spark, docs), 5, 3, 4, fan).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == brute_words(docs, 5)
    got = suffixes.remove_repeats(frame(spark, docs), 9, 4, 8, 5, fan).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute_bytes(docs, 9)


def test_packets_are_bounded_for_each_sender_and_hop():
    net = exchange.Network(500, 700, 8)
    assert net.levels == 4
    sent = [(to, by, 0, f"{by}>{to}".encode()) for by in range(0, 500, 3) for to in range(0, 700, 5)]
    rows: dict = {}
    for by in range(0, 500, 3):
        own = net.packets([m for m in sent if m[1] == by])
        assert own.num_rows <= 8
        for goal, origin, blob in zip(*(own.column(c).to_pylist() for c in ("goal", "origin", "blob")), strict=True):
            rows.setdefault((goal, origin), []).append(blob)
    for level in range(1, net.levels):
        after: dict = {}
        for blobs in rows.values():
            own = net.packets(exchange.opened(blobs), level)
            assert own.num_rows <= 8
            for goal, origin, blob in zip(*(own.column(c).to_pylist() for c in ("goal", "origin", "blob")), strict=True):
                after.setdefault((goal, origin), []).append(blob)
        rows = after
    got = {}
    for (goal, _), blobs in rows.items():
        for m in exchange.opened(blobs):
            assert m[0] == goal
            got[m[:2]] = m[3]
    assert got == {m[:2]: m[3] for m in sent}


@pytest.mark.parametrize(("senders", "receivers"), [(1000, 750), (750, 1000), (1000, 250), (40_000, 30_000)])
def test_a_hop_holds_no_more_than_few_senders(senders, receivers):
    """However many senders there are, a hop gets about as much as one of them sends (here: a byte for each receiver)."""
    net = exchange.Network(senders, receivers, 512)
    held: dict = {}
    for by in range(2 * net.fan):
        own = net.packets([(to, by, 0, b"x") for to in range(receivers)])
        for goal, origin, blob in zip(*(own.column(c).to_pylist() for c in ("goal", "origin", "blob")), strict=True):
            held[goal, origin] = held.get((goal, origin), 0) + int.from_bytes(blob[:4], "little")
    assert net.levels == 2 and max(held.values()) <= 1.1 * max(senders, receivers)


@pytest.mark.parametrize("part", [substrings, suffixes])
def test_no_hop_up_to_30_gb(part):
    """A hop writes all that is exchanged once more; up to here the disk limit leaves no room for that."""
    mb = getattr(part, "CHUNK_MB", exchange.CHUNK_MB)
    assert exchange.Network(int(30e3 / mb) + 1, int(30e3 / part.BUCKET_MB) + 1).levels == 1


def test_an_anchor_of_some_hundred_chunks_stays_whole():
    """Its segments go to one bucket; start by start they would take many times the room."""
    plan = suffixes.Plan(50, 20, 24, 40, 4, suffixes.COMMON, 600)
    one = exchange.packed(exchange.np.array([5], exchange.np.uint64), exchange.np.zeros(1, exchange.np.uint8))
    told = plan.shared(exchange.pa.table({"blob": [exchange.sealed([(0, k, 0, one) for k in range(600)])]}))
    flags = [exchange.unpacked(m[3])[1].tolist() for m in exchange.opened(told.column("blob").to_pylist())]
    assert flags == [[0]] * 600


def test_many_equal_rows_are_spread(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = [(1, text)] * 400 + [(2, "x " + text), (3, "a b")]
    rows, n = exchange.chunked(frame(spark, docs))
    assert rows.filter("doc_id = 1").select("chunk").distinct().count() > n // 2
    got = substrings.remove_repeats(frame(spark, docs), common=50).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == brute_words(docs, 35)
    got = suffixes.remove_repeats(frame(spark, docs)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute_bytes(docs, 50)


def test_sections_meet(spark, monkeypatch):
    """Texts longer than a section, in words and in bytes; a window may lie over the seam."""
    r = random.Random(4)
    long = [" ".join(r.choice(WORDS) for _ in range(700)) for _ in range(3)]
    docs = [(k, t) for k, t in enumerate(long)] + [(9, "p " + long[0][300:900] + " q"), (10, None)]
    rows = exchange.texts(frame(spark, docs).toArrow())[1]
    for part, plan in ((substrings, substrings.Plan(5, 3, 40, 4)), (suffixes, suffixes.Plan(9, 4, 8, 40, 4, 100))):
        told = []
        for size in (1 << 20, 64):
            monkeypatch.setattr(part, "SECTION", size)
            if part is substrings:
                hashes, starts = substrings.word_hashes(rows)
                h, ok = plan.probes(hashes, starts)
                hit = ok & (h % np.uint64(3) == 0)
                told.append({int(a) + k: int(p) for a, n, p in zip(*plan.tied(h, hit, starts, len(hashes)), strict=True) for k in range(n)})
            else:
                seg = suffixes.Segments(suffixes.Sections(rows), 9, 4)
                told.append({int(a) + k: int(h) for a, n, h in zip(seg.first, seg.count, seg.hash, strict=True) for k in range(n)})
        assert told[0] == told[1]


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=30, max_size=300), st.sampled_from([8, 16, 24]))
def test_multikey_quicksort(data, depth):
    text = bytes(97 + b % 3 for b in data)
    at = np.arange(len(text) - depth + 1)
    order, first = suffixes.multikey(np.frombuffer(text + b"\0" * 8, np.uint8), at, depth)
    keys = [text[k : k + depth] for k in order]
    assert keys == sorted(keys)
    assert first.tolist() == [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]


def test_the_smallest_document_stays_whole(spark):
    passage = "".join(chr(97 + k * 7 % 26) for k in range(80))
    docs = [(k, f"{k}{passage}{k}") for k in (3, 1, 2)]
    got = {r.doc_id: r.n_removed for r in suffixes.remove_repeats(frame(spark, docs)).collect()}
    assert got == {1: 0, 2: 80, 3: 80}


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=60, max_size=400), st.sampled_from([8, 16, 24]))
def test_deep_shallow_sort(data, shallow):
    text = bytes(97 + b % 2 for b in data)
    at = np.arange(len(text) - 50 + 1)
    order, label = suffixes.deep_shallow(text, at, 50, shallow)
    sorted_ = [text[k : k + 50] for k in order]
    assert sorted_ == sorted(text[k : k + 50] for k in at)
    assert all((a == b) == (x == y) for a, b, x, y in zip(sorted_, sorted_[1:], label, label[1:], strict=False))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, (1 << 62) - 1), min_size=1, max_size=300))
def test_packed_sets(values):
    v = np.array(sorted(values), np.uint64)
    flags = (v % 4).astype(np.uint8)
    for own in (v, np.unique(v >> np.uint64(34))):
        f = flags[: len(own)]
        back, g = exchange.unpacked(exchange.packed(own, f))
        assert (back == own).all() and (g == f).all()


@given(st.lists(st.integers(0, 1 << 63), min_size=1, max_size=80), st.integers(1, 40))
def test_rolling_hashes(values, width):
    v = np.array(values, np.uint64)
    if len(v) < width:
        return
    base = 0x9E3779B97F4A7C15
    want = [sum(int(x) * pow(base, width - 1 - k, 1 << 64) for k, x in enumerate(values[p : p + width])) % (1 << 64) for p in range(len(v) - width + 1)]
    assert exchange.rolled(v, width, base).tolist() == want
