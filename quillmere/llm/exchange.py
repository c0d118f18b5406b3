"""Chunks of documents that exchange messages through buckets.

Documents are dealt to chunks by a hash of the row and of its place in the input; all of a chunk's work happens in one task that holds the chunk
(about `CHUNK_MB` of input files). What a chunk has to compare with the rest of the corpus goes to buckets of the hash space, one message a bucket; a
bucket answers each chunk that asked. A hash goes out once per chunk however often it stands there, so neither copies nor common
passages make a task or a group large. The documents are shuffled once: every step reads the same exchange.

Messages travel in packets. A group sends at most `FAN` packets, whatever the number of receivers: while there are more groups than that, a packet
goes to a hop, which takes the packets of some senders for one stretch of the receivers and sends them on to as many smaller stretches. With n
groups and k steps a hop takes n^(1/k) senders and each sender has n^(1/k) stretches, so that a hop holds about what one sender sends, never more
than max(senders, receivers) / receivers times that. There are at most FAN rows for each chunk and hop, and one hop more for every factor of FAN.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.batches import id_text, release, schema_of
from quillmere.sources.scratch import input_bytes, materialise, parts_for

CHUNK_MB = 6
#: A hop writes what is exchanged once more, so none is taken before the rows, chunks times buckets, are many: with chunks of 3 MB from 49 GB on.
FAN = 1 << 14
WIDE = np.uint64(0xFFFFFFFFFFFFFFFF)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * M1
    h = (h ^ (h >> np.uint64(27))) * M2
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> list[np.uint64]:
    return [np.uint64(pow(base, k, 1 << 64)) for k in range(n + 1)]


def rolled(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hashes of all `width` consecutive values, by doubling."""
    p = powers(base, width)
    have, size, out, done = values, 1, None, 0
    need = width
    while need:
        if need & 1:
            n = len(values) - width + 1
            part = have[done : done + n]
            out = part.copy() if out is None else out * p[size] + part
            done += size
        need >>= 1
        if need:
            have = have[:-size] * p[size] + have[size:] if len(have) > size else have[:0]
            size *= 2
    return out


def chunked(docs: DataFrame, mb: float = CHUNK_MB) -> tuple[DataFrame, int]:
    """Rows with their chunk (of about mb MB of input files), all of a chunk in one partition; and the number of chunks. A row's place in its input
    partition takes part in the deal, so that equal rows are spread; it must be the same when a lost task runs again, so what is computed
    by a shuffle is written first."""
    rows = id_text(docs)
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        rows = materialise(rows, "dealt")
    n = parts_for(docs, mb, 33)
    chunk = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(n)).cast("int")
    return rows.withColumn("chunk", chunk).repartition(n, "chunk"), n


def hash_bits(docs: DataFrame) -> int:
    """Enough bits that few of the corpus's hashes meet by chance; later steps compare exactly."""
    size = input_bytes(docs)
    return min(62, max(40, math.ceil(math.log2(max(size, 2))) + 8)) if size < 1 << 55 else 62


def give_back(step):
    """A group's step, after which the worker's freed memory goes back to the system."""

    def run(*tables: pa.Table) -> pa.Table:
        out = step(*tables)
        release()
        return out

    return run


def texts(table: pa.Table) -> tuple[list, list[bytes]]:
    """doc_ids and UTF-8 texts of a chunk, in an order that its rows alone fix."""
    ids = table.column("doc_id").to_pylist()
    raw = [b"" if t is None else t for t in table.column("text").cast(pa.binary()).to_pylist()]
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, raw[k]))
    return [ids[k] for k in order], [raw[k] for k in order]


# --- packed sorted sets -------------------------------------------------------------------------------------------


def bucket_cuts(hashes: np.ndarray, bits: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that sorted hashes (of `bits` bits) fall in, and where each begins (one more for the end)."""
    own = ((hashes >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(own.astype(np.int64), prepend=-1))
    return own[first].astype(np.int64), np.append(first, len(hashes))


def packed(hashes: np.ndarray, flags: np.ndarray) -> bytes:
    """Sorted distinct hashes of at most 62 bits with two-bit flags: gaps in 32 bits each where all fit, else whole."""
    gaps = np.diff(hashes, prepend=np.uint64(0))
    if len(gaps) > 1 and int(gaps[1:].max()) < 1 << 30:
        return b"\1" + int(hashes[0]).to_bytes(8, "little") + ((np.append(np.uint64(0), gaps[1:]) << np.uint64(2)) | flags.astype(np.uint64)).astype("<u4").tobytes()
    return b"\0" + ((hashes << np.uint64(2)) | flags.astype(np.uint64)).astype("<u8").tobytes()


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    if blob[:1] == b"\0":
        v = np.frombuffer(blob, "<u8", offset=1)
        return v >> np.uint64(2), (v & np.uint64(3)).astype(np.uint8)
    v = np.frombuffer(blob, "<u4", offset=9)
    return np.cumsum((v >> np.uint32(2)).astype(np.uint64)) + np.uint64(int.from_bytes(blob[1:9], "little")), (v & np.uint32(3)).astype(np.uint8)


def bits_of(flags: np.ndarray) -> bytes:
    return np.packbits(flags.astype(bool)).tobytes()


def flags_of(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def joined(*parts: bytes) -> bytes:
    """Several byte strings as one, each after its length."""
    return b"".join(b for p in parts for b in (len(p).to_bytes(4, "little"), p))


def parted(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 4], "little")
        out.append(blob[at + 4 : at + 4 + n])
        at += 4 + n
    return out


# --- messages -----------------------------------------------------------------------------------------------------

#: (receiver, sender, kind, content)
Message = tuple[int, int, int, bytes]
PACKET = "goal int, origin int, blob binary"


def sealed(messages: list[Message]) -> bytes:
    head = np.array([(to, by, kind, len(b)) for to, by, kind, b in messages], "<i4")
    return len(messages).to_bytes(4, "little") + head.tobytes() + b"".join(m[3] for m in messages)


def opened(blobs: list[bytes]) -> list[Message]:
    """The messages of some packets, in an order that they alone fix."""
    out: list[Message] = []
    for blob in blobs:
        n = int.from_bytes(blob[:4], "little")
        head = np.frombuffer(blob, "<i4", 4 * n, 4).reshape(n, 4)
        at = 4 + 16 * n
        for to, by, kind, size in head.tolist():
            out.append((to, by, kind, blob[at : at + size]))
            at += size
    out.sort(key=lambda m: m[:3])
    return out


class Network:
    """Packets between `senders` and `receivers` groups, numbered from 0."""

    def __init__(self, senders: int, receivers: int, fan: int = FAN):
        self.levels, self.fan, most = 1, 1, max(senders, receivers)
        while fan**self.levels < most:
            self.levels += 1
        while self.fan**self.levels < most:  # no wider than it must be: a hop joins `fan` senders for one of `fan` stretches
            self.fan += 1

    def packets(self, messages: list[Message], level: int = 0) -> pa.Table:
        """The rows that a group sends: at most `fan`."""
        stretch, block = self.fan ** (self.levels - 1 - level), self.fan ** (level + 1)
        held: dict[int, list[Message]] = {}
        for m in messages:
            held.setdefault(m[0] // stretch, []).append(m)
        origin = messages[0][1] // block if messages else 0
        return pa.table({"goal": pa.array(list(held), pa.int32()), "origin": pa.array([origin] * len(held), pa.int32()), "blob": pa.array(map(sealed, held.values()), pa.binary())})

    def delivered(self, sent: DataFrame):
        """sent, grouped by receiver, after the hops that it takes."""
        for level in range(1, self.levels):
            sent = sent.groupBy("goal", "origin").applyInArrow(self._hop(level), schema_of(PACKET))
        return sent.groupBy("goal")

    def _hop(self, level: int):
        return lambda t: give_back(lambda own: self.packets(opened(own.column("blob").to_pylist()), level))(t)
