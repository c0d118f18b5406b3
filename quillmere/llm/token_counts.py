"""Token counts by a map-side two-tier lookup (SentencePiece model).

A text is cut where no piece of the model can cross: at every "\\n" (no piece holds one) and before
every space. The token count of a text is the sum over its pre-tokens. Tier one is a broadcast table of
frequent pre-token lengths, bounded by `table_words`; tier two is a cache in each worker, bounded by
`CACHE_WORDS`, filled by the library in batches. Texts never leave the map side.

The table comes from all documents: each task counts its pre-tokens in a bounded summary of its `summary_words` most frequent, one row
of bytes. Summaries, not pre-tokens, are exchanged: groups of `MERGED` tasks merge theirs, and groups of MERGED groups; the driver merges
what is left, a summary for MERGED * MERGED tasks, and the most frequent words make the table. It only decides where a length is looked up, never what it is.

Defined results: null or empty text: 0 bytes, 0 tokens. Null doc_id: kept, as null. Repeated rows:
one result row each. Empty table: no rows. Very long texts: read whole, one at a time. Other columns are ignored.

The cuts hold for models whose pieces have no "\\n" and no space but at their start. This is tested when a model is loaded; texts are given whole to the
library where it does not hold.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.batches import documents, id_text, map_docs

CACHE_WORDS = 400_000
SUMMARY_HELD = 300_000
MERGED = 256
SPACE = "▁"
BARE = "\n"  # marks a pre-token that has no space before it

_models: dict[str, object] = {}
_tables: dict[tuple, dict[str, int]] = {}


def model(path: str):
    if path not in _models:
        import sentencepiece

        _models[path] = m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (m.id_to_piece(k) for k in range(m.get_piece_size()))
        m.cuttable = not any("\n" in p or SPACE in p.lstrip(SPACE) for p in pieces)
    return _models[path]


def pretokens(line: str, first: bool) -> list[str]:
    """The pre-tokens of a line without "\\n". A plain word stands for space + word; BARE + word for a word without a
    space before it; a run of spaces, and a word after it, stands as itself. The model puts a space before the text (first)."""
    if SPACE in line:
        line = line.replace(SPACE, " ")
    words = line.split(" ")
    if "" not in words:
        if not first:
            words[0] = BARE + words[0]
        return words
    out, spaces = [], 1 if first else 0
    for k, w in enumerate(words):
        if k:
            spaces += 1
        if w:
            out.append(w if spaces == 1 else BARE + w if not spaces else " " * spaces + w)
            spaces = 0
    if spaces:
        out.append(" " * spaces)
    return out


def lengths(m, words: list[str]) -> list[int]:
    """Token counts of pre-tokens by the library. Each is put after "\\n", which stops the model's own leading space from joining it."""
    asked = ["\n" + (w[1:] if w[0] == BARE else w if w[0] == " " else " " + w) for w in words]
    return [len(x) - 2 for x in m.encode(asked, num_threads=1)]  # the model's own space and the "\n" are a token each


class Counts(dict):
    """Pre-token -> token count: the worker's cache, over the broadcast table."""

    def __init__(self, m, table: dict[str, int]):
        super().__init__(table)
        self.m, self.table = m, table

    def learn(self, words: Iterable[str]) -> None:
        if new := [w for w in set(words) if w not in self]:
            self.update(zip(new, lengths(self.m, new), strict=True))

    def trim(self) -> None:
        if len(self) > len(self.table) + CACHE_WORDS:
            self.clear()
            self.update(self.table)


def count_text(text: str, counts: Counts) -> int:
    if not text:
        return 0
    if not counts.m.cuttable:
        return len(counts.m.encode(text))
    lines = text.split("\n")
    words = pretokens(lines[0], True) if lines[0] else [" "]
    for line in lines[1:]:
        if line:
            words += pretokens(line, False)
    try:
        n = sum(map(counts.__getitem__, words))
    except KeyError:
        counts.learn(words)
        n = sum(map(counts.__getitem__, words))
        counts.trim()
    return n + len(lines) - 1


def shortened(seen: Counter, most: int) -> bytes:
    """The `most` most frequent words (ties: the smaller word) and their counts."""
    top = sorted(seen.items(), key=lambda p: (-p[1], p[0]))[:most]
    return json.dumps(top).encode()


def frequent(docs: DataFrame, summary_words: int, table_words: int) -> list[str]:
    """The table_words most frequent pre-tokens by the tasks' summaries."""

    def summary(rows: Iterator[tuple]) -> Iterator[tuple]:
        from pyspark import TaskContext

        seen: Counter = Counter()
        for _, text in rows:
            for k, line in enumerate(text.split("\n")):
                if line:
                    seen.update(pretokens(line, not k))
            if len(seen) > SUMMARY_HELD:
                seen = Counter(dict(seen.most_common(SUMMARY_HELD // 2)))
        yield TaskContext.get().partitionId(), shortened(Counter({w: n for w, n in seen.items() if n > 1 and len(w) <= 64}), summary_words)

    def merge(table: pa.Table) -> pa.Table:
        seen: Counter = Counter()
        for blob in table.column("words").to_pylist():
            seen.update(dict(json.loads(blob)))
        return pa.table({"part": [table.column("part")[0].as_py()], "words": [shortened(seen, table_words)]}, schema=pa.schema([("part", pa.int64()), ("words", pa.binary())]))

    one = "part bigint, words binary"
    summaries = map_docs(docs, summary, one, binary=False)
    for _ in range(2):
        summaries = summaries.withColumn("part", F.floor(F.col("part") / MERGED)).groupBy("part").applyInArrow(lambda t: merge(t), one)
    seen: Counter = Counter()
    for r in summaries.toLocalIterator():
        seen.update(dict(json.loads(bytes(r.words))))
    return [w for w, _ in json.loads(shortened(seen, table_words))]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, table_words: int = 32_768, summary_words: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    sc = docs.sparkSession.sparkContext
    words = frequent(docs, summary_words, table_words)
    table = sc.broadcast((words, bytes(min(n, 255) for n in (lengths(model(model_path), words) if words else []))))
    key = (model_path, uuid.uuid4().hex)  # a broadcast has no public id

    def count(rows: Iterator[tuple]) -> Iterator[tuple]:
        if key not in _tables:
            _tables.clear()
            _tables[key] = {w: n for w, n in zip(*table.value, strict=True) if n < 255}
        counts = Counts(model(model_path), _tables[key])
        for i, text in rows:
            size = len(text.encode())
            n = count_text(text, counts)
            yield i, size, n, n > limit

    return map_docs(docs, count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", binary=False)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(id_text(documents(spark, sf_dir)), public_tokenizers.path("piece_bpe_32k.model"))
