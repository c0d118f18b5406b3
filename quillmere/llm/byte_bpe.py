"""Byte-level BPE: overlapping chunk encoding, and decoding.

Texts are cut into overlapping chunks of `chunk` characters, which are pre-tokenised in parallel, each as a row of its own. A chunk's first
pre-token boundaries can be wrong, for it does not see what stands before; from the first boundary on that both it and the chunk
before it have, twice in a row within their overlap, they are the same, and there the two are stitched. If an overlap shows no such
place (one pre-token can be longer than any overlap), the stitch reads on from the last sure boundary, up to the next place where the
chunks agree, over as much text as that takes. The pieces are then encoded, each pre-token apart, through a bounded cache. A text of one chunk has nothing to stitch and is
encoded where it is read; chunks of others meet by the row's number. Decoding concatenates the raw bytes of the ids.

Defined results: null or empty text: no ids; hashes of the empty string. Null doc_id: kept. Repeated rows: a row each.
Empty table: no rows. Very long texts: cut before they are dealt out, so that no row holds a text more than once; one task stitches
a text. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quillmere.llm.batches import documents, id_text, map_docs, rows_out, schema_of

CHUNK = 1 << 13
OVERLAP = 1 << 9
#: Pre-tokens, and parts of texts, that a worker holds at most (about 60 MB together).
CACHE_WORDS = 150_000
_encoders: dict[str, Encoder] = {}


class Encoder:
    """tiktoken's encoder of single pre-tokens behind a bounded cache, and the table of each id's bytes."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.pattern = regex.compile(pattern)
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.raw = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.raw[i] = b
        self.words: dict[str, bytes] = {}
        self.units = Units(self)

    def spans(self, text: str, at: int = 0) -> Iterator[int]:
        """Where the pre-tokens of text from `at` on end."""
        return (m.end() for m in self.pattern.finditer(text, at))

    def word(self, w: str) -> bytes:
        ids = self.words.get(w)
        if ids is None:
            ids = self.words[w] = array("I", self.bpe._encode_single_piece(w) if len(w) < 100 else self.bpe.encode_ordinary(w)).tobytes()
        return ids

    def pieces(self, words: list[str]) -> bytes:
        out = b"".join(map(self.word, words))
        self.trim()
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text. No pre-token holds white space after another character, so one ends before each white space that
        follows one; between single spaces and line ends the parts are looked up whole."""
        if RUNS.search(text):
            return self.pieces(self.pattern.findall(text))
        parts = text.replace("\n", " \n").split(" ")
        out = b"".join(map(self.word, self.pattern.findall(parts[0]))) + b"".join(map(self.units.__getitem__, parts[1:]))
        self.trim()
        return out

    def trim(self) -> None:
        """Over its bound, a cache keeps the quarter that it met first: the frequent words are among them."""
        for held in (self.words, self.units):
            if len(held) > CACHE_WORDS:
                first = list(islice(held.items(), CACHE_WORDS // 4))
                held.clear()
                held.update(first)

    def decode(self, ids: array) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))


#: White space after which a space or line end follows: the run must be pre-tokenised as one.
RUNS = re.compile(r"\s[ \n]")


class Units(dict):
    """A part of a text that a space stood before (or that begins with a line end) -> its ids."""

    def __init__(self, enc: Encoder):
        super().__init__()
        self.enc = enc

    def __missing__(self, part: str) -> bytes:
        enc = self.enc
        ids = self[part] = b"".join(map(enc.word, enc.pattern.findall(part if part[:1] == "\n" else " " + part)))
        return ids


def encoder(ranks_path: str, pattern: str) -> Encoder:
    key = f"{ranks_path}\n{pattern}"
    if key not in _encoders:
        _encoders[key] = Encoder(ranks_path, pattern)
    return _encoders[key]


def stitched(enc: Encoder, text: str, chunks: list[tuple[int, list[int]]]) -> list[int]:
    """Ends of the pre-tokens of the whole text, from (start, ends) of its overlapping chunks in order. Ends near a chunk's own
    end are not trusted, for the chunk doesn't see what follows: the last two are left to the next chunk."""
    ends = chunks[0][1][:-2] if len(chunks) > 1 else chunks[0][1]
    for k, (_, own) in enumerate(chunks[1:], 1):
        trusted = own if k == len(chunks) - 1 else own[:-2]
        place = {e: n for n, e in enumerate(trusted)}
        sure = len(ends)
        # the first place where two boundaries in a row are the same in both
        meet = next((n for n in range(1, sure) if ends[n] in place and place[ends[n]] >= 1 and trusted[place[ends[n]] - 1] == ends[n - 1]), None)
        if meet is None:  # read on from the last sure boundary until the chunk's boundaries are met twice in a row
            before = None
            for e in enc.spans(text, ends[-1] if ends else 0):
                ends.append(e)
                if e in place and before is not None and place[e] and trusted[place[e] - 1] == before:
                    ends += trusted[place[e] + 1 :]
                    break
                before = e
            continue
        ends = ends[: meet + 1] + trusted[place[ends[meet]] + 1 :]
    return ends


def chunk_bounds(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    return [(a, min(n, a + chunk + overlap)) for a in range(0, max(n - overlap, 1), chunk)]


#: ids: little-endian unsigned 32-bit integers.
ROWS = "doc_id bigint, ids binary"


def long_documents(long: DataFrame, ranks_path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """ids of documents of over `chunk` characters. key: the row's number, which with the doc_id tells equal rows apart."""
    starts = F.sequence(F.lit(0), F.greatest(F.char_length("text") - overlap - 1, F.lit(0)), F.lit(chunk))
    pieces = F.transform(starts, lambda a: F.struct(a.alias("at"), F.substring("text", a + 1, F.lit(chunk + overlap)).alias("piece")))
    cut = long.select(F.monotonically_increasing_id().alias("key"), "doc_id", pieces.alias("pieces"))
    rows = cut.select("key", "doc_id", F.inline("pieces")).repartition("key", "at")

    kind = "<u2" if chunk + overlap < 1 << 16 else "<u4"  # of a pre-token's characters

    def ends(frames):
        enc = encoder(ranks_path, pattern)
        for f in frames:
            f["sizes"] = [np.diff(np.fromiter(enc.spans(p), np.int64), prepend=0).astype(kind).tobytes() for p in f["piece"]]
            yield f

    marked = rows.mapInPandas(ends, "key bigint, doc_id bigint, at int, piece string, sizes binary")

    def join(f: pd.DataFrame) -> pd.DataFrame:
        enc = encoder(ranks_path, pattern)
        f = f.sort_values("at")
        text = "".join(p[:chunk] for p in f["piece"][:-1]) + f["piece"].iloc[-1]
        cuts = stitched(enc, text, [(a, (a + np.cumsum(np.frombuffer(s, kind), dtype=np.int64)).tolist()) for a, s in zip(f["at"], f["sizes"], strict=True)])
        return pd.DataFrame({"doc_id": f["doc_id"].iloc[:1].astype("Int64"), "ids": [enc.pieces([text[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)])]})

    return marked.groupBy("key", "doc_id").applyInPandas(join, ROWS)


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ids of every document."""
    rows = id_text(docs)

    def short(it: Iterator[tuple]) -> Iterator[tuple]:
        enc = encoder(ranks_path, pattern)
        for i, text in it:
            yield i, enc.encode(text)

    is_long = F.coalesce(F.char_length("text") > chunk, F.lit(False))
    return map_docs(rows.filter(~is_long), short, ROWS, binary=False).unionByName(long_documents(rows.filter(is_long), ranks_path, pattern, chunk, overlap))


def decode_digest(ids: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Decode ids; per document its count and the hashes of ids and of decoded bytes (and the ids)."""
    out = schema_of("doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)
    arrow = to_arrow_schema(out)

    def run(batches):
        enc = encoder(ranks_path, pattern)

        def rows():
            for b in batches:
                for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    raw = v.as_py() or b""
                    ids = array("I", raw)
                    told = i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(enc.decode(ids)).hexdigest()
                    yield (*told, raw) if keep_ids else told

        yield from rows_out(rows(), arrow)

    return ids.mapInArrow(run, out)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    path = p.path("byte_bpe_multi_50k.tiktoken")
    return decode_digest(encode(id_text(documents(spark, sf_dir)), path, p.PATTERN), path, p.PATTERN)
