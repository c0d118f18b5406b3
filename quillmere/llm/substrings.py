"""Substring dedup by fixed-block anchors.

Words are hashed; non-overlapping blocks of `block` words, at every multiple of `block` in a document, are the index. Any
window of `window` >= 2 * block - 1 words holds a whole block wherever it stands, so a window that starts twice holds a place where its
own rolling hash meets an indexed block that is also elsewhere: an anchor. Every rolling hash of every document is a probe
(chunks exchange sorted sets, see exchange.py), and only anchors come back. Whether a place is an anchor depends on its words alone, so equal
windows hold equal anchors, and each window is tied to the smallest hash among its own. The words around an anchor that its windows reach go to the anchor's
bucket, each distinct stretch once per chunk. There hits are extended: a stretch that stands twice is a repeat as a whole; of stretches that differ, the
windows from the leftmost to the rightmost around the anchor are compared, word for word, and those that another stretch shares are told
to the chunks. Runs of such windows are the maximal exact repeats, whatever their number of copies, without pairs. The windows of an anchor that stands very
often go one by one, dealt by their words instead of by the anchor, so that no bucket grows with it.

Defined results: null, empty or blank text: no words, nothing removed. Fewer words than a window: nothing removed. Null
doc_id: a document like any other. Repeated rows: documents of their own, which repeat one another, spread over the chunks. Empty table: no rows.
Ties: none, all copies go. Very long texts: hashed and tied by sections; a chunk is never smaller than its longest text. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillmere.llm import exchange as x
from quillmere.llm.batches import documents, schema_of
from quillmere.sources.scratch import parts_for

WINDOW = 35
BLOCK = 18
BASE = 0x9E3779B97F4A7C15
SECTION = 1 << 20
CACHE_WORDS = 400_000
#: Input megabytes for each bucket, from MIN_BUCKETS buckets on.
BUCKET_MB, MIN_BUCKETS = 8, 64
#: Places of windows are told apart by this many bits within a section.
PLACE_BITS = 21
#: An anchor counts as common from so many occurrences on (by lower bounds of the chunks' counts).
COMMON = 512
OUT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def words_of(text: bytes) -> list[bytes]:
    return text.split()  # bytes.split cuts at [\x20\x09-\x0D]+


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in a row, and where each text begins (one more for the end)."""
    parts, starts, n = [], [0], 0
    for text in raw:
        at = 0
        while at < len(text):  # long texts by sections that end at white space
            end = at + SECTION
            while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
                end += 1
            words = text[at:end].split()
            parts.append(np.fromiter(map(_words.__getitem__, words), np.uint64, len(words)))
            n += len(words)
            at = end
        starts.append(n)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(starts)


def whole(starts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of the n - width + 1 places have `width` values of one text."""
    ok = np.ones(max(n - width + 1, 0), bool)
    for e in starts[1:-1]:
        ok[max(0, e - width + 1) : e] = False
    return ok


class Plan:
    """The steps' functions; window, block, bits, the number of buckets and the network are fixed for a run."""

    def __init__(self, window: int, block: int, bits: int, chunks: int, buckets: int = MIN_BUCKETS, common: int = COMMON, fan: int = x.FAN):
        if window < 2 * block - 1:
            raise ValueError("a window must hold a whole block wherever it starts")
        if window - block + 1 > 32:
            raise ValueError("an anchor must have 1 to 32 windows")
        self.window, self.block, self.bits, self.buckets, self.common = window, block, bits, buckets, common
        self.net = x.Network(chunks, buckets, fan)

    # a chunk's words

    def probes(self, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rolling hashes of `block` words and which of their places count."""
        if len(hashes) < self.block:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        return x.mix(x.rolled(hashes, self.block, BASE)) >> np.uint64(64 - self.bits), whole(starts, len(hashes), self.block)

    def ask(self, table: pa.Table) -> pa.Table:
        """Step 1: all probes of a chunk; flags 0 to 3: once here, 2, 32, 256 times or more; and a bit for each that is an indexed block here."""
        chunk = table.column("chunk")[0].as_py()
        hashes, starts = word_hashes(x.texts(table)[1])
        h, ok = self.probes(hashes, starts)
        indexed = np.zeros(len(h), bool)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            indexed[a : max(a, b - self.block + 1) : self.block] = True
        h, indexed = h[ok], indexed[ok]
        if not len(h):
            return self.net.packets([])
        s = np.sort((h << np.uint64(1)) | indexed)
        v = s >> np.uint64(1)
        first = np.flatnonzero(np.diff(v, prepend=v[0] ^ np.uint64(1)))
        own = np.maximum.reduceat(s & np.uint64(1), first)
        times = np.searchsorted([2, 32, 256], np.diff(np.append(first, len(v))), "right")
        v, times = v[first], times.astype(np.uint8)
        names, cuts = x.bucket_cuts(v, self.bits, self.buckets)
        return self.net.packets([(int(k), chunk, 0, x.joined(x.packed(v[a:b], times[a:b]), x.bits_of(own[a:b]))) for k, a, b in zip(names, cuts[:-1], cuts[1:], strict=True)])

    def anchors(self, table: pa.Table) -> pa.Table:
        """Step 2, in a bucket: for each chunk, its probes that meet an indexed block and stand elsewhere too; flag 1: common."""
        asked = x.opened(table.column("blob").to_pylist())
        parts = [x.parted(m[3]) for m in asked]
        sets = [x.unpacked(p[0]) for p in parts]
        v = np.concatenate([s[0] for s in sets])
        order = np.argsort(v, kind="stable")
        v = v[order]
        times = np.concatenate([s[1] for s in sets])[order]
        indexed = np.concatenate([x.flags_of(p[1], len(s[0])) for p, s in zip(parts, sets, strict=True)])[order]
        first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        n = np.diff(np.append(first, len(v)))
        total = np.add.reduceat(np.array([1, 2, 32, 256])[times], first)
        good = (total > 1) & np.logical_or.reduceat(indexed, first)
        back, common = np.zeros(len(v), bool), np.zeros(len(v), np.uint8)
        back[order] = np.repeat(good, n)
        common[order] = np.repeat(total >= self.common, n)
        out, at = [], 0
        for (to, chunk, _, _), (own, _) in zip(asked, sets, strict=True):
            mine = back[at : at + len(own)]
            if mine.any():
                out.append((chunk, to, 0, x.packed(own[mine], common[at : at + len(own)][mine])))
            at += len(own)
        return self.net.packets(out)

    def tied(self, h: np.ndarray, hit: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows with one anchor: their first window, how many windows, and the anchor's place. Windows without an anchor are left out."""
        width = self.window - self.block + 1
        ok = whole(starts, n, self.window)
        firsts, counts, places = [], [], []
        mask = np.uint64((1 << PLACE_BITS) - 1)
        for a in range(0, len(ok), SECTION):
            b = min(len(h), a + SECTION + width - 1)
            low = np.where(hit[a:b], (h[a:b] & ~mask) | np.arange(b - a, dtype=np.uint64), x.WIDE)
            size = 1
            while size * 2 <= width:
                low = np.minimum(low[:-size], low[size:])
                size *= 2
            if width > size:
                low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
            place = np.where((low != x.WIDE) & ok[a : a + len(low)], (low & mask).astype(np.int64), -1)
            edge = np.flatnonzero(np.diff(place, prepend=-2))
            keep = place[edge] >= 0
            firsts.append(edge[keep] + a)
            counts.append((np.append(edge[1:], len(place)) - edge)[keep])
            places.append(place[edge[keep]] + a)
        join = lambda v: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64)
        return join(firsts), join(counts), join(places)

    def stretches(self, raw: list[bytes], hashes: np.ndarray, starts: np.ndarray, hit: np.ndarray, common: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
        """What a chunk sends: per bucket the distinct stretches of words (of a common anchor, single windows) with their anchor's hash and
        places, in an order that the rows alone fix. Then the first window and the number of windows of each place."""
        h = self.probes(hashes, starts)[0]
        first, count, place = self.tied(x.mix(h), hit, starts, len(hashes))
        own = np.repeat(np.arange(len(first)), np.where(common[place], count, 1))
        single = common[place][own]
        step = np.arange(len(own)) - np.searchsorted(own, own)
        first, count, anchor = first[own] + step, np.where(single, 1, count[own]), h[place[own]]
        doc = np.searchsorted(starts, first, "right") - 1
        mixed = x.mix(anchor)  # by their own order the smallest hashes would crowd in the first buckets
        bucket = (((mixed >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)).tolist()
        name = (mixed & np.uint64(0xFFFFFFFF)).tolist()
        sent: dict[int, dict[bytes, tuple[int, list[int]]]] = {}
        more, at, words = self.window - 1, -1, []
        for k, (a, n, d, b, one) in enumerate(zip(first.tolist(), count.tolist(), doc.tolist(), bucket, single.tolist(), strict=True)):
            if d != at:
                at, words, begin = d, words_of(raw[d]), int(starts[d])
            t = b" ".join(words[a - begin : a - begin + n + more])
            if one:
                b = int.from_bytes(hashlib.blake2b(t, digest_size=4).digest(), "little") % self.buckets
            held = sent.setdefault(b, {})
            if t in held:
                held[t][1].append(k)
            else:
                held[t] = (name[k], [k])
        return sent, first, count

    def stretches_ask(self, docs: pa.Table, hits: pa.Table) -> pa.Table:
        """Step 3: the words around a chunk's anchors; and, for its own later use, which of its places are anchors and common."""
        if not hits.num_rows:
            return self.net.packets([])
        chunk = docs.column("chunk")[0].as_py()
        raw = x.texts(docs)[1]
        hashes, starts = word_hashes(raw)
        h, ok = self.probes(hashes, starts)
        got = [x.unpacked(m[3]) for m in x.opened(hits.column("blob").to_pylist())]
        wanted, flags = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        order = np.argsort(wanted)
        wanted, flags = wanted[order], flags[order]
        place = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
        hit = (wanted[place] == h) & ok
        common = hit & (flags[place] > 0)
        sent = self.stretches(raw, hashes, starts, hit, common)[0]
        out = [(chunk % self.buckets, chunk, 1, x.joined(x.bits_of(hit), x.bits_of(common)))]
        for b, held in sorted(sent.items()):
            names = np.array([v[0] for v in held.values()], "<u4").tobytes()
            out.append((b, chunk, 0, x.joined(names, x.bits_of(np.array([len(v[1]) > 1 for v in held.values()])), b"\n".join(held))))
        return self.net.packets(out)

    def extend(self, table: pa.Table) -> pa.Table:
        """Step 4, in a bucket: extend the hits; for each chunk's stretches, a bit per window that stands twice or more anywhere."""
        out, asked = [], []
        known: dict[bytes, list[int]] = {}  # stretch -> number, how often at least, name of its anchor
        for to, chunk, kind, blob in x.opened(table.column("blob").to_pylist()):
            if kind:
                out.append((chunk, to, 1, blob))
                continue
            names, many, text = x.parted(blob)
            own = text.split(b"\n")
            numbers = []
            for t, name, twice in zip(own, np.frombuffer(names, "<u4").tolist(), x.flags_of(many, len(own)).tolist(), strict=True):
                held = known.setdefault(t, [len(known), 0, name])
                held[1] += 1 + twice
                numbers.append(held[0])
            asked.append((chunk, to, numbers))
        masks = np.zeros(len(known), np.uint32)
        around: dict[int, list[bytes]] = {}
        for t, (_, _, name) in known.items():
            around.setdefault(name, []).append(t)
        for own in around.values():
            self._compare(own, known, masks)
        return self.net.packets(out + [(chunk, to, 0, masks[np.array(numbers)].astype("<u4").tobytes()) for chunk, to, numbers in asked])

    def _compare(self, own: list[bytes], known: dict[bytes, list[int]], masks: np.ndarray) -> None:
        """Mark the repeated windows of the stretches around one anchor."""
        seen: dict[bytes, list] = {}
        for t in own:
            number, times, _ = known[t]
            n = t.count(b" ") - self.window + 2
            if times > 1:
                masks[number] = (1 << n) - 1
            if len(own) == 1:
                return
            cuts = [0, *accumulate(len(w) + 1 for w in t.split(b" "))]
            for k in range(n):
                w = t[cuts[k] : cuts[k + self.window] - 1]
                if (before := seen.get(w)) is None:
                    seen[w] = [(number, k)]
                else:
                    if before[-1] is not None:  # the first two places are marked together, further ones as they come
                        masks[before[0][0]] |= np.uint32(1 << before[0][1])
                        seen[w] = [None]
                    masks[number] |= np.uint32(1 << k)

    def cut(self, docs: pa.Table, told: pa.Table) -> pa.Table:
        """Step 5: remove what repeated windows cover."""
        ids, raw = x.texts(docs)
        covered = starts = None
        if told.num_rows:
            hashes, starts = word_hashes(raw)
            got = {(kind, by): blob for _, by, kind, blob in x.opened(told.column("blob").to_pylist())}
            n = max(len(hashes) - self.block + 1, 0)
            hit, common = (x.flags_of(b, n) for b in x.parted(next(v for (k, _), v in got.items() if k)))
            sent, first, count = self.stretches(raw, hashes, starts, hit, common)
            mask = np.zeros(len(first), np.uint32)
            for b, held in sent.items():
                for m, (_, places) in zip(np.frombuffer(got[0, b], "<u4").tolist(), held.values(), strict=True):
                    if m:
                        mask[places] = m
            edge = np.zeros(len(hashes) + 1, np.int64)
            for bit in range(self.window - self.block + 1):
                at = first[(mask >> np.uint32(bit)) & np.uint32(1) > 0] + bit
                edge[at] += 1  # with one bit no window is met twice
                edge[at + self.window] -= 1
            covered = np.cumsum(edge[:-1]) > 0
        out = []
        for k, (i, text) in enumerate(zip(ids, raw, strict=True)):
            words = words_of(text)
            gone = 0
            kept = words
            if covered is not None:
                own = covered[starts[k] : starts[k + 1]]
                gone = int(own.sum())
                if gone:
                    kept = compress(words, (~own).tolist())
            text = b" ".join(kept)
            out.append((i, len(words), gone, hashlib.sha256(text).hexdigest(), text))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.table([pa.array(c, t) if t != pa.string() or k == 3 else pa.array(c, pa.binary()).cast(pa.string()) for k, (c, t) in enumerate(zip(zip(*out, strict=True), kinds, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, common: int = COMMON, fan: int = x.FAN) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the text that stays) of every document."""
    dealt, n = x.chunked(docs)
    plan = Plan(window, block, x.hash_bits(docs), n, parts_for(docs, BUCKET_MB, MIN_BUCKETS), common, fan)
    one = lambda step: lambda t: x.give_back(step)(t)
    two = lambda step: lambda a, b: x.give_back(step)(a, b)
    packet, at = schema_of(x.PACKET), dealt.groupBy("chunk")
    asked = at.applyInArrow(one(plan.ask), packet)
    found = plan.net.delivered(asked).applyInArrow(one(plan.anchors), packet)
    around = at.cogroup(plan.net.delivered(found)).applyInArrow(two(plan.stretches_ask), packet)
    told = plan.net.delivered(around).applyInArrow(one(plan.extend), packet)
    return at.cogroup(plan.net.delivered(told)).applyInArrow(two(plan.cut), schema_of(OUT))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept")
