"""Suffix-array dedup by deep-shallow sorting.

Every start of a `window`-byte string is tied to its anchor: the leftmost smallest hash among the `gram`-byte grams in
the string. Equal strings have equal anchors, wherever they stand; consecutive starts with one anchor make a segment of up to
window - gram + 1 starts. Chunks first exchange the anchors' hashes (see exchange.py); only segments whose anchor stands in two documents or more go on,
each distinct content once per chunk with the smallest doc_id that has it there. In its bucket the suffixes of the distinct segments
are sorted: dealt by their first 8 bytes, multikey quicksort (ternary partitions, all groups side by side) on 8-byte characters to a shallow depth, then a blind trie for every group that is still
together orders its suffixes to the full window and tells equal ones. The smallest doc_id of equal suffixes decides for each chunk which
of a segment's starts also start in a smaller document. An anchor that stands very often (a common line or pair of words) has its starts sent
one by one, dealt by their content instead of by the anchor, so that no bucket grows with it.

Defined results: null or empty text: 0 bytes, nothing removed. Shorter than a window: nothing removed. Null doc_id: smaller than any.
Equal doc_ids: not smaller than each other. Repeated rows: a row each, spread over the chunks. Empty table: no rows. Very long texts are worked through by sections. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillmere.llm import exchange as x
from quillmere.llm.batches import documents, schema_of
from quillmere.sources.scratch import parts_for

WINDOW = 50
GRAM = 20
SHALLOW = 24
SECTION = 1 << 19
#: A chunk's segments and contents take several times its size in a worker.
CHUNK_MB = 3
#: Input megabytes for each bucket, from MIN_BUCKETS buckets on.
BUCKET_MB, MIN_BUCKETS = 6, 128
PLACE_BITS = 20
#: An anchor counts as common from so many occurrences on (by lower bounds of the chunks' counts): its starts take some 30 times the room of its
#: segments, and so many segments are still little for a bucket.
COMMON = 1 << 14
NO_ID = -(1 << 63)
BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20_24)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


class Sections:
    """A chunk's texts as bytes in a row, worked through by sections that overlap by window - 1 bytes."""

    def __init__(self, raw: list[bytes]):
        self.starts = np.append(0, np.cumsum([len(t) for t in raw])).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)


class Segments:
    """Runs of starts with one anchor, of a whole chunk: first start, number of starts, anchor hash, document."""

    def __init__(self, s: Sections, window: int, gram: int):
        firsts, counts, hashes = [], [], []
        n = len(s.bytes)
        room = np.repeat(s.starts[1:], np.diff(s.starts)) - np.arange(n) >= window if n < 1 << 16 else None
        for a in range(0, max(n - window + 1, 0), SECTION):
            b = min(n, a + SECTION + window - 1)
            h = x.mix(x.rolled(BYTE[s.bytes[a:b]], gram, BASE))
            low = (h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
            width, size = window - gram + 1, 1
            while size * 2 <= width:
                low = np.minimum(low[:-size], low[size:])
                size *= 2
            if width > size:
                low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
            ok = self._room(s, a, len(low), window) if room is None else room[a : a + len(low)]
            place = (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
            place[~ok] = -1
            edge = np.flatnonzero(np.diff(place, prepend=-2))
            keep = place[edge] >= 0
            ends = np.append(edge[1:], len(place))
            firsts.append(edge[keep] + a)
            counts.append((ends - edge)[keep])
            hashes.append(h[place[edge[keep]]])
        join = lambda v, t: np.concatenate(v).astype(t) if v else np.zeros(0, t)
        # smallest hashes crowd at the low end: mixed once more, they spread evenly over the buckets
        self.first, self.count, self.hash = join(firsts, np.int64), join(counts, np.int64), x.mix(join(hashes, np.uint64) ^ np.uint64(BASE))
        self.doc = np.searchsorted(s.starts, self.first, "right") - 1

    @staticmethod
    def _room(s: Sections, a: int, n: int, window: int) -> np.ndarray:
        """Which starts a .. a + n - 1 have `window` bytes of their own document."""
        ok = np.ones(n, bool)
        p = np.searchsorted(s.starts, a, "right")
        q = np.searchsorted(s.starts, a + n + window, "right")
        for e in s.starts[p:q]:
            ok[max(0, e - a - window + 1) : max(0, e - a)] = False
        return ok


# --- sorting ------------------------------------------------------------------------------------------------------


class BlindTrie:
    """Patricia trie of fixed-length strings that keeps branching bytes and depths only; leaves hold classes of equal strings."""

    def __init__(self, first: bytes, member: int):
        self.root: list = [first, [member]]

    def add(self, s: bytes, member: int) -> None:
        node = self.root
        while len(node) == 3:  # blind: only branching bytes are looked at
            node = node[1].get(s[node[0]]) or node[2]
        leaf = node[0]
        if leaf == s:
            node[1].append(member)
            return
        n = len(s)
        depth = n - ((int.from_bytes(leaf, "big") ^ int.from_bytes(s, "big")).bit_length() + 7) // 8
        above, node = None, self.root
        while len(node) == 3 and node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        new = [s, [member]]
        if len(node) == 3 and node[0] == depth:
            node[1][s[depth]] = new
            return
        branch = [depth, {leaf[depth]: node, s[depth]: new}, node]
        if above is None:
            self.root = branch
        else:
            key = s[above[0]]
            above[1][key] = branch
            if above[2] is node:
                above[2] = branch

    def classes(self) -> Iterator[list[int]]:
        """Members of equal strings, in the strings' order."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if len(node) == 3:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                yield node[1]


def multikey(text: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at `at` by their first `depth` bytes, and where groups of equal ones begin in it.

    Suffixes are dealt to groups by their first character; then multikey quicksort, on characters of 8 bytes. All groups are partitioned
    side by side: each by its middle member's character into smaller, equal and larger, in place; equal ones go on to the next character,
    and a group of one, or one that is equal to `depth`, is done."""
    char = np.ndarray(max(len(text) - 7, 0), ">u8", text, strides=(1,)) if len(text) > 7 else np.zeros(0, ">u8")
    order = np.argsort(char[at], kind="stable")
    key = char[at[order]]
    edge = np.append(True, key[1:] != key[:-1])
    place = np.flatnonzero(~(edge & np.append(edge[1:], True)))  # places in the order that belong to groups of two or more
    deep = np.full(len(place), 8, np.int16)
    while True:
        on = deep < depth
        place, deep = place[on], deep[on]
        if not len(place):
            return order, np.flatnonzero(edge)
        own = order[place]
        first = np.flatnonzero(edge[place])
        size = np.diff(np.append(first, len(place)))
        key = char[at[own] + deep].astype(np.uint64)
        pivot = np.repeat(key[first + size // 2], size)
        side = (key >= pivot).astype(np.int8) + (key > pivot)
        # a stable counting sort of all groups by side: how many of each side stand before, in the group
        totals = np.stack([np.add.reduceat(side == k, first, dtype=np.int64) for k in range(3)], 1)
        begin = np.cumsum(totals, 1) - totals
        group = np.repeat(np.arange(len(first)), size)
        to = np.empty(len(place), np.int64)
        for k in range(3):
            mine = np.flatnonzero(side == k)
            g = group[mine]
            before = np.cumsum(totals[:, k]) - totals[:, k]
            to[mine] = first[g] + begin[g, k] + np.arange(len(mine)) - before[g]
        moved, sides = np.empty_like(own), np.empty_like(side)
        moved[to], sides[to] = own, side
        order[place] = moved
        deep = deep + np.where(sides == 1, 8, 0).astype(np.int16)
        new = np.append(True, (group[1:] != group[:-1]) | (sides[1:] != sides[:-1]))
        edge[place] = new
        left = ~(new & np.append(new[1:], True))
        place, deep = place[left], deep[left]


def deep_shallow(text: bytes, at: np.ndarray, window: int, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of `at` to `window` bytes, and the class of equal suffixes that each place of it has."""
    data = np.frombuffer(text + b"\0" * 8, np.uint8)
    shallow = min(shallow, window // 8 * 8)
    order, first = multikey(data, at, shallow)
    ends = np.append(first[1:], len(order))
    new = np.zeros(len(order), bool)
    new[first] = True
    for p, q in zip(first[ends - first > 1].tolist(), ends[ends - first > 1].tolist(), strict=True):
        members = order[p:q].tolist()
        if q - p == 2:
            a, b = members
            i, j = int(at[a]), int(at[b])
            s, t = text[i : i + window], text[j : j + window]
            if s != t:
                new[p + 1] = True
                if t < s:
                    order[p], order[p + 1] = b, a
            continue
        trie = None
        for m in members:
            i = int(at[m])
            s = text[i : i + window]
            if trie is None:
                trie = BlindTrie(s, m)
            else:
                trie.add(s, m)
        k = p
        for own in trie.classes():
            new[k] = True
            order[k : k + len(own)] = own
            k += len(own)
    return order, np.cumsum(new) - 1


# --- steps --------------------------------------------------------------------------------------------------------


class Plan:
    """The steps' functions; all lengths, the number of buckets and the network are fixed for a run."""

    def __init__(self, window: int, gram: int, shallow: int, bits: int, buckets: int, common: int, chunks: int = 1, fan: int = x.FAN):
        if not 0 < gram <= window or window - gram + 1 > 32:
            raise ValueError("a segment must have 1 to 32 starts")
        self.net = x.Network(chunks, buckets, fan)
        self.window, self.gram, self.shallow, self.bits, self.buckets, self.common = window, gram, shallow, bits, buckets, common

    def short(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.bits)

    def ask(self, table: pa.Table) -> pa.Table:
        """Step 1: the distinct anchors of a chunk; flags 0 and 1: in one document here, in more; 2 and 3: 32 and 256 times here or more (in
        however many documents: step 4 looks at them, and none is lost)."""
        chunk = table.column("chunk")[0].as_py()
        seg = Segments(Sections(x.texts(table)[1]), self.window, self.gram)
        h = self.short(seg.hash)
        if not len(h):
            return self.net.packets([])
        order = np.lexsort((seg.doc, h))
        h, doc = h[order], seg.doc[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        fresh = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
        n = np.add.reduceat(fresh.astype(np.int64), first)
        times = np.diff(np.append(first, len(h)))
        v, flags = h[first], np.where(times < 32, n > 1, np.searchsorted([256], times, "right") + 2).astype(np.uint8)
        names, cuts = x.bucket_cuts(v, self.bits, self.buckets)
        return self.net.packets([(int(k), chunk, 0, x.packed(v[a:b], flags[a:b])) for k, a, b in zip(names, cuts[:-1], cuts[1:], strict=True)])

    def shared(self, table: pa.Table) -> pa.Table:
        """Step 2, in a bucket: for each chunk, its anchors that stand in another document too; flag 1: common."""
        asked = x.opened(table.column("blob").to_pylist())
        sets = [x.unpacked(m[3]) for m in asked]
        v = np.concatenate([s[0] for s in sets])
        order = np.argsort(v, kind="stable")
        v = v[order]
        n = np.array([1, 2, 32, 256])[np.concatenate([s[1] for s in sets])[order]]
        first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        size = np.diff(np.append(first, len(v)))
        total = np.add.reduceat(n, first)
        good, common = np.zeros(len(v), bool), np.zeros(len(v), np.uint8)
        good[order] = np.repeat(total > 1, size)
        common[order] = np.repeat(total >= self.common, size)
        out, at = [], 0
        for (to, chunk, _, _), (own, _) in zip(asked, sets, strict=True):
            mine = good[at : at + len(own)]
            if mine.any():
                out.append((chunk, to, 0, x.packed(own[mine], common[at : at + len(own)][mine])))
            at += len(own)
        return self.net.packets(out)

    def parts(self, s: Sections, seg: Segments, ids: list, hit: np.ndarray, common: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
        """What a chunk sends: per bucket the distinct contents with their smallest doc_id, in an order that the rows alone fix. Then for each piece (a segment
        with a shared anchor; of a common one, a start) its first start, number of starts and document."""
        own = np.flatnonzero(hit)
        many = np.where(common[own], seg.count[own], 1)
        piece = np.repeat(own, many)
        step = np.arange(len(piece)) - np.repeat(np.cumsum(many) - many, many)
        first = seg.first[piece] + step
        single = common[piece]
        count = np.where(single, 1, seg.count[piece])
        doc = seg.doc[piece]
        named = self.short(seg.hash[piece])
        data = s.bytes.tobytes()
        w = self.window - 1
        sent: dict[int, dict[bytes, list]] = {}
        value = [NO_ID if i is None else i for i in ids]
        bucket = (((named >> np.uint64(self.bits - 32)) * np.uint64(self.buckets)) >> np.uint64(32)).astype(np.int64).tolist()
        digest = hashlib.blake2b
        for k, (a, n, d, b, one) in enumerate(zip(first.tolist(), count.tolist(), doc.tolist(), bucket, single.tolist(), strict=True)):
            t = data[a : a + n + w]
            if one:
                b = int.from_bytes(digest(t, digest_size=4).digest(), "little") % self.buckets
            held = sent.setdefault(b, {})
            got = held.get(t)
            if got is None:
                held[t] = [value[d], [k]]
            else:
                got[1].append(k)
                if value[d] < got[0]:
                    got[0] = value[d]
        return sent, first, count, doc

    def segments_ask(self, docs: pa.Table, hits: pa.Table) -> pa.Table:
        """Step 3: the contents around a chunk's shared anchors; and, for its own later use, which anchors are shared and common."""
        chunk = docs.column("chunk")[0].as_py()
        if not hits.num_rows:
            return self.net.packets([])
        ids, raw = x.texts(docs)
        s = Sections(raw)
        seg = Segments(s, self.window, self.gram)
        got = [x.unpacked(m[3]) for m in x.opened(hits.column("blob").to_pylist())]
        wanted, flags = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        order = np.argsort(wanted)
        wanted, flags = wanted[order], flags[order]
        h = self.short(seg.hash)
        place = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
        hit = wanted[place] == h
        common = hit & (flags[place] > 0)
        sent = self.parts(s, seg, ids, hit, common)[0]
        out = [(chunk % self.buckets, chunk, 1, x.joined(x.bits_of(hit), x.bits_of(common)))]
        for b, held in sorted(sent.items()):
            lens = bytes(len(t) - self.window + 1 for t in held)
            out.append((b, chunk, 0, x.joined(b"".join(held), lens, np.array([v[0] for v in held.values()], "<i8").tobytes())))
        return self.net.packets(out)

    def decide(self, table: pa.Table) -> pa.Table:
        """Step 4, in a bucket: sort the suffixes of all distinct contents; for each chunk's contents, a bit per start that stands in a smaller document."""
        out, asked = [], []
        known: dict[bytes, int] = {}
        w = self.window - 1
        for to, chunk, kind, told in x.opened(table.column("blob").to_pylist()):
            if kind:
                out.append((chunk, to, 1, told))
                continue
            blob, lens, low = x.parted(told)
            names, at = [], 0
            for n in lens:
                t = blob[at : at + n + w]
                at += n + w
                names.append(known.setdefault(t, len(known)))
            asked.append((chunk, to, np.array(names), np.frombuffer(lens, np.uint8).astype(np.int64), np.frombuffer(low, "<i8")))
        if asked:
            text = b"".join(known)
            size = np.array([len(t) for t in known])
            begin = np.cumsum(size) - size
            starts = size - w
            base = np.cumsum(starts) - starts
            at = np.repeat(begin - base, starts) + np.arange(int(starts.sum()))
            order, label = deep_shallow(text, at, self.window, self.shallow)
            lowest = np.full(len(known), np.iinfo(np.int64).max)
            for _, _, names, _, low in asked:
                np.minimum.at(lowest, names, low)
            least = np.full(int(label[-1]) + 1, np.iinfo(np.int64).max)
            of = np.repeat(lowest, starts)
            np.minimum.at(least, label, of[order])
            smallest = np.empty(len(order), np.int64)
            smallest[order] = least[label]
            for chunk, to, names, n, low in asked:
                ahead = np.cumsum(n) - n
                step = np.arange(int(n.sum())) - np.repeat(ahead, n)
                smaller = smallest[np.repeat(base[names], n) + step] < np.repeat(low, n)
                mask = np.bitwise_or.reduceat(smaller.astype(np.uint32) << step.astype(np.uint32), ahead)
                out.append((chunk, to, 0, mask.astype("<u4").tobytes()))
        return self.net.packets(out)

    def cut(self, docs: pa.Table, told: pa.Table) -> pa.Table:
        """Step 5: remove the bytes that repeated strings cover."""
        ids, raw = x.texts(docs)
        covered = s = None
        if told.num_rows:
            s = Sections(raw)
            seg = Segments(s, self.window, self.gram)
            got = {(kind, by): blob for _, by, kind, blob in x.opened(told.column("blob").to_pylist())}
            hit, common = (x.flags_of(b, len(seg.hash)) for b in x.parted(next(v for (k, _), v in got.items() if k)))
            sent, first, count, doc = self.parts(s, seg, ids, hit, common)
            mask = np.zeros(len(first), np.uint32)
            full = ((np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
            value = [NO_ID if i is None else i for i in ids]
            for b, held in sent.items():
                told_masks = np.frombuffer(got[0, b], "<u4").tolist()
                for m, (low, places) in zip(told_masks, held.values(), strict=True):
                    if m or len(places) > 1:
                        for k in places:
                            mask[k] = full[k] if value[doc[k]] > low else m
            edge = np.zeros(len(s.bytes) + self.window + 1, np.int32)
            for bit in range(self.window - self.gram + 1):
                at = first[(mask >> np.uint32(bit)) & np.uint32(1) > 0] + bit
                edge[at] += 1
                edge[at + self.window] -= 1
            covered = np.cumsum(edge)[: len(s.bytes)] > 0
        out = []
        for k, (i, text) in enumerate(zip(ids, raw, strict=True)):
            gone = spans = 0
            kept = text
            if covered is not None:
                own = covered[s.starts[k] : s.starts[k + 1]]
                gone = int(own.sum())
                if gone:
                    spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum())
                    kept = s.bytes[s.starts[k] : s.starts[k + 1]][~own].tobytes()
            out.append((i, len(text), gone, spans, hashlib.sha256(kept).hexdigest(), kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shallow: int = SHALLOW, common: int = COMMON, fan: int = x.FAN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay) of every document."""
    dealt, n = x.chunked(docs, CHUNK_MB)
    plan = Plan(window, gram, shallow, x.hash_bits(docs), parts_for(docs, BUCKET_MB, MIN_BUCKETS), common, n, fan)
    one = lambda step: lambda t: x.give_back(step)(t)
    two = lambda step: lambda a, b: x.give_back(step)(a, b)
    packet, at = schema_of(x.PACKET), dealt.groupBy("chunk")
    asked = at.applyInArrow(one(plan.ask), packet)
    found = plan.net.delivered(asked).applyInArrow(one(plan.shared), packet)
    around = at.cogroup(plan.net.delivered(found)).applyInArrow(two(plan.segments_ask), packet)
    told = plan.net.delivered(around).applyInArrow(one(plan.decide), packet)
    return at.cogroup(plan.net.delivered(told)).applyInArrow(two(plan.cut), schema_of(OUT))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept")
