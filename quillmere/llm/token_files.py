"""Token-id files: canonical length-limited Huffman code of ids in independent blocks.

A token file is a folder: `header` (one row: end id, code-length limit, a byte of code length per id; ids
that never occur have length 0) and `blocks` (Parquet). A block holds whole documents: their ids, each with
the end id, as one bit stream (most significant bit first), the bit offset of every `EVERY`th id, and each
document's id count. Blocks decode on their own; within one, the stretches between checkpoints decode side
by side. Blocks are numbered by (part, block) in ascending doc_id order, and carry their first id's place
within the part, so a document's global start needs only the parts' totals (a row per part).

Defined results: null text: empty (the end id alone). Null doc_id: first. Equal doc_ids: each row
kept, ordered by their ids. Empty table: an empty file. Very long documents: a block of their own.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.batches import documents, id_text, release, rows_out, schema_of
from quillmere.sources.scratch import discard, materialise, parts_for, scratch_path

LIMIT = 16
EVERY = 256
BLOCK_IDS = 1 << 18
#: Parts, and pre-tokens, that a worker holds at most (about 200 MB together).
CACHE_WORDS, CACHE_PIECES = 700_000, 400_000
_tokenizers: dict[str, object] = {}
_caches: dict[str, Cache] = {}


# --- ids of texts -------------------------------------------------------------------------------------------------


def tokenizer(path: str):
    if path not in _tokenizers:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


#: Printable ASCII and the letters of Latin-1 (and line ends between parts): of these the normaliser only lower-cases, one character to one.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ\n]*")
#: The tokenizer's pre-token pattern over such characters, once in lower case.
PIECES = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\n]+")
#: Byte-level characters: printable bytes stand for themselves, the others follow from 256 on, in order.
_own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: chr(b) for b in _own} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_own))}
AS_BYTES = {c: "".join(BYTE_CHARS[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}



class Cache:
    """Part of a text -> its ids as little-endian integers of 16 or 32 bits. New plain parts are cut into pre-tokens here, a
    document's at a time, and only the merges are left to the library, behind a cache of their own; other parts go through the whole tokenizer."""

    def __init__(self, tok, narrow: bool):
        self.words: dict[str, bytes] = {}
        self.tok, self.model, self.number = tok, tok.model, struct.Struct("<H" if narrow else "<I").pack
        self.end = b"\xff\xff" if narrow else b"\xff\xff\xff\xff"  # no id has a high byte of 255, so it cannot be met across two ids
        self.pieces = {"\n": self.end}

    def learn(self, new: set[str]) -> None:
        lines = "\n".join(new)
        if not PLAIN.fullmatch(lines) or "<|" in lines:
            for p in [p for p in new if not PLAIN.fullmatch(p) or "\n" in p or "<|" in p]:
                self.words[p] = b"".join(map(self.number, self.tok.encode(p, add_special_tokens=False).ids))
                new.discard(p)
            if not new:
                return
            lines = "\n".join(new)
        found = PIECES.findall(lines.lower())
        number, model = self.number, self.model
        for p in set(found).difference(self.pieces):
            self.pieces[p] = b"".join([number(t.id) for t in model.tokenize(p if p.isascii() else p.translate(AS_BYTES))])
        self.words.update(zip(new, b"".join(map(self.pieces.__getitem__, found)).split(self.end), strict=True))

    def trim(self) -> None:
        """Over its bound, a cache keeps the quarter that it met first: the frequent parts are among them."""
        for held, most in ((self.words, CACHE_WORDS), (self.pieces, CACHE_PIECES)):
            if len(held) > most:
                first = list(islice(held.items(), most // 4))
                held.clear()
                held.update(first)


def ids_of(texts: pa.Array, cache: Cache) -> list[bytes]:
    """The ids of each text. The tokenizer drops white space and joins nothing across it, so the parts between " " and "\\n" are encoded apart: Arrow
    cuts the texts and numbers their distinct parts, and the ids of those are dealt back to all places."""
    lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
    parts = lists.flatten().dictionary_encode()
    distinct = parts.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist()
    cache.trim()
    known = list(map(cache.words.get, distinct))
    if new := [k for k, ids in enumerate(known) if ids is None]:
        cache.learn({distinct[k] for k in new})
        for k in new:
            known[k] = cache.words[distinct[k]]
    placed = pa.array(known, pa.binary()).take(parts.indices)
    _, offsets, data = placed.buffers()
    at = np.frombuffer(offsets, np.int32)[placed.offset :][np.asarray(lists.offsets) - lists.offsets[0].as_py()].tolist()
    whole = memoryview(data) if data is not None else memoryview(b"")
    return [bytes(whole[p:q]) for p, q in zip(at[:-1], at[1:], strict=True)]


def gathered(batches: Iterator[pa.RecordBatch], most_bytes: int = 12_000_000) -> Iterator[pa.RecordBatch]:
    """Batches joined up to about most_bytes: the more texts are numbered together, the fewer distinct parts they have."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most_bytes:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, narrow: bool) -> DataFrame:
    """doc_id, ids (little-endian; 16 bits each if narrow, else 32), with the end id."""
    end = struct.pack("<H" if narrow else "<I", end_id)
    key = f"{tokenizer_path} {narrow}"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _caches.get(key)
        if cache is None:
            cache = _caches[key] = Cache(tokenizer(tokenizer_path), narrow)
        for own in gathered(batches):
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array([i + end for i in ids_of(own.column(1), cache)], pa.binary())], names=["doc_id", "ids"])
        release()

    return id_text(docs).mapInArrow(encode, "doc_id bigint, ids binary")


# --- the code -----------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of over {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    made: list[np.ndarray] = []  # for each level, which of the sorted items are packages
    level = weight
    for _ in range(limit - 1):
        packs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, packs])
        rank = np.argsort(both, kind="stable")
        made.append(rank >= len(weight))
        level = both[rank]
    take = 2 * len(weight) - 2
    lengths = np.zeros(len(weight), np.int64)
    for pack in reversed(made):
        packs = int(pack[:take].sum())
        lengths[: take - packs] += 1
        take = 2 * packs
    lengths[:take] += 1
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: by length, then id."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    for n in range(1, int(lengths.max(initial=0)) + 1):
        own = order[lengths[order] == n]
        code <<= n - last
        codes[own] = code + np.arange(len(own), dtype=np.uint64)
        code, last = code + len(own), n
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream of ids, and the bit offset of every EVERYth of them."""
    n = lengths[ids].astype(np.int64)
    end = np.cumsum(n)
    at = end - n
    word, off = at >> 6, at & 63
    room = 64 - off - n  # bits left in the word after the code; negative: it runs over
    value = codes[ids]
    high = np.where(room >= 0, value << np.maximum(room, 0).astype(np.uint64), value >> np.maximum(-room, 0).astype(np.uint64))
    words = np.zeros((int(end[-1]) + 63) // 64 + 1, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] = np.bitwise_or.reduceat(high, first)
    over = np.flatnonzero(room < 0)
    words[word[over] + 1] |= value[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: (int(end[-1]) + 7) // 8], at[::EVERY]


class Decoder:
    """Table-driven: a window of `limit` bits gives the id and its length."""

    def __init__(self, lengths: np.ndarray, limit: int):
        self.limit = limit
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        spans = (1 << (limit - lengths[order].astype(np.int64))).astype(np.int64)
        self.ids = np.zeros(1 << limit, np.uint32)
        self.bits = np.zeros(1 << limit, np.int64)
        n = int(spans.sum())
        self.ids[:n] = np.repeat(order, spans)
        self.bits[:n] = np.repeat(lengths[order], spans)

    def ids_in(self, stream: bytes, n_ids: int, marks: np.ndarray) -> np.ndarray:
        """All ids of a block; the stretches between checkpoints advance together."""
        data = np.frombuffer(stream + b"\0" * 8, np.uint8)
        words = (data[:-3].astype(np.uint32) << 24) | (data[1:-2].astype(np.uint32) << 16) | (data[2:-1].astype(np.uint32) << 8) | data[3:]
        out = np.zeros((EVERY, len(marks)), np.uint32)
        at, cut, most = marks.astype(np.int64), 32 - self.limit, len(words) - 1
        mask = np.uint32((1 << self.limit) - 1)
        last = n_ids - EVERY * (len(marks) - 1)
        for k in range(EVERY if len(marks) > 1 else last):
            seen = (words[np.minimum(at >> 3, most)] >> (cut - (at & 7)).astype(np.uint32)) & mask
            out[k] = self.ids[seen]
            at = at + self.bits[seen]
        return out.T.reshape(-1)[:n_ids]


# --- files --------------------------------------------------------------------------------------------------------

HEADER = "end_id bigint, code_limit int, ids_bytes int, code_lengths binary"
BLOCKS = "part int, block int, part_start bigint, n_ids bigint, doc_ids array<bigint>, doc_n array<bigint>, marks binary, stream binary"


def id_counts(ids: DataFrame, vocab: int, narrow: bool) -> np.ndarray:
    """Global counts of all ids: a row per id and task, summed; the driver gets at most `vocab` rows."""
    kind, out = ("<u2" if narrow else "<u4"), schema_of("id bigint, n bigint")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def count(batches):
        total = np.zeros(vocab, np.int64)
        for b in batches:
            column = b.column(0)
            _, offsets, data = column.buffers()
            at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
            if len(at) > 1:
                total += np.bincount(np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind), minlength=vocab)
        yield from rows_out(((int(i), int(total[i])) for i in np.flatnonzero(total)), arrow)

    counts = np.zeros(vocab, np.int64)
    for r in ids.select("ids").mapInArrow(count, out).groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    return counts


def write_token_file(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, block_ids: int = BLOCK_IDS) -> None:
    """Encode every document and write the token file to path, in ascending doc_id order."""
    spark = docs.sparkSession
    vocab = max(tokenizer(tokenizer_path).get_vocab_size(with_added_tokens=True), end_id + 1)
    narrow = vocab <= 0xFF00
    kind = "<u2" if narrow else "<u4"
    ids = materialise(encoded(docs, tokenizer_path, end_id, narrow), "token-ids")
    lengths = code_lengths(id_counts(ids, vocab, narrow))
    spark.createDataFrame([(end_id, LIMIT, 2 if narrow else 4, lengths.tobytes())], HEADER).coalesce(1).write.parquet(f"{path}/header")
    code = spark.sparkContext.broadcast((lengths, canonical(lengths)))
    n = parts_for(ids, 12)
    tie = F.xxhash64("ids")
    ordered = ids.withColumn("tie", tie).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids")
    from pyspark.sql.pandas.types import to_arrow_schema

    out = schema_of(BLOCKS)
    arrow = to_arrow_schema(out)

    def blocks(rows):
        lengths, codes = code.value
        part, block, before = 0, 0, 0
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, sizes, names, size = [], [], [], 0

        def flush():
            all_ids = np.concatenate(held)
            stream, marks = pack(all_ids, lengths, codes)
            return part, block, before, size, names, sizes, marks.astype("<i8").tobytes(), stream

        for b in rows:
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(v.as_buffer(), kind)
                if held and size + len(x) > block_ids:
                    yield flush()
                    before, block = before + size, block + 1
                    held, sizes, names, size = [], [], [], 0
                held.append(x)
                sizes.append(len(x))
                names.append(i)
                size += len(x)
        if held:
            yield flush()

    ordered.select("doc_id", "ids").mapInArrow(lambda batches: rows_out(blocks(batches), arrow), out).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    discard(ids)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (little-endian unsigned 32-bit) of every document in a token file."""
    head = spark.read.schema(HEADER).parquet(f"{path}/header").collect()[0]
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = {r.part: r.n for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # a row per part
    base, before = {}, 0
    for p in sorted(totals):
        base[p], before = before, before + totals[p]
    held = spark.sparkContext.broadcast((bytes(head.code_lengths), base))
    limit = head.code_limit
    out = schema_of("doc_id bigint, start bigint, ids binary")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def decode(batches):
        lengths, base = held.value
        decoder = Decoder(np.frombuffer(lengths, np.uint8), limit)

        def rows():
            for b in batches:
                for r in b.to_pylist():
                    ids = decoder.ids_in(r["stream"], r["n_ids"], np.frombuffer(r["marks"], "<i8")).astype("<u4")
                    at, start = 0, base[r["part"]] + r["part_start"]
                    for i, n in zip(r["doc_ids"], r["doc_n"], strict=True):
                        yield i, start + at, ids[at : at + n].tobytes()
                        at += n

        yield from rows_out(rows(), arrow)

    return blocks.mapInArrow(decode, out)


def digest(ids: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read_token_file gives."""
    return ids.select("doc_id", "start", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "token-file")
    write_token_file(id_text(documents(spark, sf_dir)), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return digest(read_token_file(spark, path))
