"""Benchmark decontamination by a prefix-filtered set join.

An item's shingles are its windows of `width` consecutive words (a shorter item is one window). Every occurrence of every window is
asked for, so all of an item's shingles are necessary; of a shingle, all words must be met, so its necessary prefix is one word: its
rarest by counts over all documents (ties: the word itself). A document word that is some window's prefix word, at the positions that
length and place allow, is verified against the exact window. For each item met, containment is verified over item-sized windows: the
largest share of its distinct windows that start within as many document words as the item has.

The benchmark is read in slices of at most about `slice_words` words each, by a hash of the item. One slice at a time is on the driver and broadcast; of
several, each one's hits are written before the next is read, and merged per document. One slice is usual and needs no shuffle.

Defined results: null text: no words. Item without words: never met. Repeated items: one id; texts of one id are items of their
own for containment. Null item_id: left out. Null doc_id and repeated rows: kept, a row each. Empty tables: no rows, or no hits.
Very long texts: read whole, one at a time. Other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.batches import documents, id_text, map_docs
from quillmere.llm.rewrite import rewrite_texts, whole_number
from quillmere.sources.scratch import materialise
from quillmere.sources.ship import ship

WIDTH = 8
SLICE_WORDS = 2_000_000
#: Lower-cases A-Z; bytes under 0x80 that are neither digits nor letters become spaces.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def item_windows(words: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    return [tuple(words[k : k + width]) for k in range(max(len(words) - width, 0) + 1)] if words else []


def word_counts(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many documents each word of the vocabulary stands; the driver gets at most a row per word."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(rows: Iterator[tuple]) -> Iterator[tuple]:
        seen: Counter = Counter()
        for _, text in rows:
            seen.update(held.value.intersection(words_of(text)))
        yield from seen.items()

    return {bytes(r.word): r.n for r in map_docs(docs, count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()}


def best_share(starts: list[tuple[int, int]], span: int, total: int) -> float:
    """starts: (place in the document, number of the window in the item), by place."""
    held: Counter = Counter()
    best = low = 0
    for place, k in starts:
        held[k] += 1
        while starts[low][0] <= place - span:
            old = starts[low][1]
            held[old] -= 1
            if not held[old]:
                del held[old]
            low += 1
        best = max(best, len(held))
    return best / total


class Join:
    """Windows by content, and their prefix words with the places they have in windows."""

    def __init__(self, items: list[tuple[str, bytes]], counts: dict[bytes, int], width: int):
        self.windows: dict[tuple, dict[int, int]] = defaultdict(dict)  # window -> number of an item's text -> number of the window in it
        self.names: list[str] = []
        self.total: list[int] = []
        self.span: list[int] = []
        for number, (name, text) in enumerate(items):
            words = words_of(text)
            own = list(dict.fromkeys(item_windows(words, width)))
            for k, w in enumerate(own):
                self.windows[w][number] = k
            self.names.append(name)
            self.total.append(len(own))
            self.span.append(max(len(words) - width + 1, 1))
        places: dict[bytes, set] = defaultdict(set)
        for w in self.windows:
            k = min(range(len(w)), key=lambda j: (counts.get(w[j], 0), w[j], j))
            places[w[k]].add((k, len(w)))
        self.places = {w: sorted(p) for w, p in places.items()}

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], dict[str, float]]:
        """(start, length) of every occurrence of a window, and the share of each item met."""
        n, places, windows = len(words), self.places, self.windows
        found: dict[tuple[int, int], tuple] = {}
        for i, w in enumerate(words):
            if w in places:
                for k, size in places[w]:
                    a = i - k
                    if a >= 0 and a + size <= n and (a, size) not in found and (key := tuple(words[a : a + size])) in windows:
                        found[a, size] = key
        met: dict[int, list] = defaultdict(list)
        for (a, _), key in sorted(found.items()):
            for number, k in windows[key].items():
                met[number].append((a, k))
        shares: dict[str, float] = {}
        for number, starts in met.items():
            name = self.names[number]
            shares[name] = max(shares.get(name, 0.0), best_share(starts, self.span[number], self.total[number]))
        return sorted(found), shares


_joins: dict[int, Join] = {}


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Disjoint [start, end) runs of (start, length) spans in order."""
    out: list[list[int]] = []
    for a, n in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return out


HITS = "doc_id bigint, n_words bigint, runs array<array<int>>, items array<string>, containment double"


def slices_of(benchmark: DataFrame, slice_words: int) -> tuple[int, Iterator[list[tuple[str, bytes]]]]:
    """How many slices of about slice_words words the items make, and the slices, each read when it is asked for."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).dropna()
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(size) // (slice_words * 6)))
    parts = (items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == s) for s in range(n))
    return n, ([(r.item_id, bytes(r.text)) for r in part.orderBy("item_id", "text").collect()] for part in parts)


def merge(found: DataFrame) -> DataFrame:
    """One row for each document of the hits of several slices: runs joined where they touch or overlap."""
    one = found.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.max("containment").alias("containment"))
    last = "element_at(s, -1)"
    runs = F.expr(f"aggregate(runs, cast(array() as array<array<int>>), (s, r) -> case when size(s) > 0 and r[0] <= {last}[1] then concat(slice(s, 1, size(s) - 1), array(array({last}[0], greatest({last}[1], r[1])))) else concat(s, array(r)) end)")
    return one.withColumn("runs", runs)


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, slice_words: int = SLICE_WORDS) -> DataFrame:
    """doc_id, n_words, runs ([start, end) in words, merged), items met, and the largest containment of any."""
    n, slices = slices_of(benchmark, slice_words)
    if n == 1:
        return _hits(id_text(docs), next(slices), width)
    rows = materialise(id_text(docs).withColumn("row", F.monotonically_increasing_id()), "decontaminate")
    numbered = rows.select(F.col("row").alias("doc_id"), "text")
    found = reduce(DataFrame.unionByName, [materialise(_hits(numbered, part, width).filter("size(runs) > 0"), "hits") for part in slices])
    sizes = map_docs(numbered, lambda it: ((i, len(words_of(t))) for i, t in it), "doc_id bigint, n_words bigint")
    every = rows.select("row", F.col("doc_id").alias("own")).join(sizes.withColumnRenamed("doc_id", "row"), "row").join(merge(found).drop("n_words").withColumnRenamed("doc_id", "row"), "row", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return every.select(F.col("own").alias("doc_id"), "n_words", none("runs", "array<array<int>>"), none("items", "array<string>"), F.coalesce("containment", F.lit(0.0)).alias("containment"))


def _hits(rows: DataFrame, part: list[tuple[str, bytes]], width: int) -> DataFrame:
    """hits() of one slice."""
    counts = word_counts(rows, {w for _, t in part for w in words_of(t)})
    held, key = rows.sparkSession.sparkContext.broadcast((part, counts, width)), uuid.uuid4().hex

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        if key not in _joins:
            _joins.clear()  # a worker meets one slice at a time
            _joins[key] = Join(*held.value)
        join = _joins[key]
        for i, text in it:
            words = words_of(text)
            spans, shares = join.hits(words)
            yield i, len(words), merged(spans), sorted(shares), max(shares.values(), default=0.0)

    return map_docs(rows, run, HITS)


SPAN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def without(text: bytes, runs: list[list[int]]) -> bytes:
    """The text without the words of runs ([start, end) in words) and what stands between them."""
    words = [m.span() for m in SPAN.finditer(text)]
    out, at = [], 0
    for a, b in runs:
        out.append(text[at : words[a][0]])
        at = words[b - 1][1]
    return b"".join([*out, text[at:]])


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: float = 0.8, slice_words: int = SLICE_WORDS) -> DataFrame:
    """docs without the documents that meet two items or hold `share` or more of one; other hits are cut out of their texts.
    With a benchmark of several slices the rows are written with a number, by which their merged hits come back to them."""
    n, slices = slices_of(benchmark, slice_words)
    if n > 1:
        rows = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
        numbered = rows.select(F.col("_row").alias("doc_id"), F.col("text").cast("string").alias("text"))
        found = merge(reduce(DataFrame.unionByName, [materialise(_hits(numbered, part, width).filter("size(runs) > 0"), "hits") for part in slices])).withColumnRenamed("doc_id", "_row")
        gone = (F.size("items") >= 2) | (F.col("containment") >= share)
        kept = rows.join(found.select("_row", F.col("runs").alias("_runs"), gone.alias("_gone")), "_row", "left").filter(~F.coalesce("_gone", F.lit(False)))
        return cut_runs(kept.drop("_gone", "_row")).select(*docs.columns)
    part = next(slices)
    held = docs.sparkSession.sparkContext.broadcast((part, word_counts(docs, {w for _, t in part for w in words_of(t)}), width))

    def decide():
        join = Join(*held.value)

        def judge(text):
            if not text:
                return True, text
            raw = text.encode()
            spans, shares = join.hits(words_of(raw))
            if not spans:
                return True, text
            if len(shares) >= 2 or max(shares.values()) >= share:
                return False, text
            return True, without(raw, merged(spans)).decode()

        return judge

    return rewrite_texts(docs, decide)


def cut_runs(docs: DataFrame) -> DataFrame:
    """docs with the words of the column _runs (null: none) cut out of their texts, and n_chars, where there is one, set to the new length."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([without(t.encode(), [list(map(int, r)) for r in own]).decode() for t, own in zip(texts, runs, strict=True)], dtype=object)

    ship(docs.sparkSession)
    hit = F.col("_runs").isNotNull()
    met = docs.filter(hit).withColumn("text", cut("text", "_runs"))
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    if "n_chars" in kinds and whole_number(kinds["n_chars"]):
        met = met.withColumn("n_chars", F.char_length("text").cast(kinds["n_chars"]))
    return docs.filter(~hit).unionByName(met).drop("_runs")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(id_text(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        F.expr("cast(aggregate(runs, 0, (s, r) -> s + r[1] - r[0]) as bigint)").alias("n_hit"),
        F.expr("cast(size(items) as bigint)").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
        "containment",
    )
