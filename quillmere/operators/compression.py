"""Postings as gaps and variable-length bytes, skip lists, block maxima and what they save."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.functions.analyzers import plain
from quillmere.operators.index import by_document, dealt, parts
from quillmere.sources.ship import ship

SKIP, BLOCK = 32, 128
#: Document numbers in a bucket of a long list.
SPAN = 1 << 16


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, n): place in the order of ids, from 0. Ranges are counted first, so no task sees all ids."""
    ids = docs.select("doc_id").distinct().repartitionByRange("doc_id").withColumn("part", F.spark_partition_id())
    from quillmere.sources.scratch import materialise

    ids = materialise(ids, "numbered")
    own = ids.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("doc_id")) - 1)
    counts = ids.groupBy("part").count()
    before = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))  # a row per partition
    return own.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("k")).cast("bigint").alias("n"))


def integer_postings(tf: DataFrame, docs: DataFrame) -> DataFrame:
    """(term, n)."""
    return tf.join(numbered(docs), "doc_id").select("term", "n")


def numbered_postings(docs: DataFrame, analyzer=plain) -> DataFrame:
    """(term, n) of all terms: integer_postings(), but documents and not their terms meet the numbers."""
    rows = by_document(docs).join(numbered(docs).hint("merge"), "doc_id").select("doc_id", "n", F.explode(analyzer("text")).alias("term"))
    return rows.distinct().select("term", "n")


def ranked(postings: DataFrame, by: str = "term", n: str = "n", span: int = SPAN) -> DataFrame:
    """postings with `k`, their place in their term's list from 0, and `before`, the posting before (null for the first).
    A term's list is cut into buckets of `span` document numbers: windows run within a bucket, and only a row for each bucket, with its size and largest
    number, meets the other buckets of its term. So no task holds a common term's whole list."""
    own = dealt(postings.withColumn("bucket", F.floor(F.col(n) / span)), parts(postings), by, "bucket")
    size = own.groupBy(by, "bucket").agg(F.count("*").alias("_size"), F.max(n).alias("_last"))
    inner = Window.partitionBy(by, "bucket").orderBy(n)
    own = own.withColumns({"_k": F.row_number().over(inner) - 1, "_lag": F.lag(n).over(inner)})
    outer = Window.partitionBy(by).orderBy("bucket")
    ahead = size.select(by, "bucket", (F.sum("_size").over(outer) - F.col("_size")).alias("_ahead"), F.lag("_last").over(outer).alias("_end")).filter("_end IS NOT NULL")  # of lists in several buckets
    return own.join(ahead, [by, "bucket"], "left").withColumns({"k": (F.coalesce("_ahead", F.lit(0)) + F.col("_k")).cast("bigint"), "before": F.coalesce("_lag", "_end")}).drop("bucket", "_k", "_lag", "_ahead", "_end")


def gaps(postings: DataFrame, by: str = "term", n: str = "n", span: int = SPAN) -> DataFrame:
    """Each posting with its gap to the one before (the first: itself)."""
    return ranked(postings, by, n, span).withColumn("gap", F.col(n) - F.coalesce("before", F.lit(0))).drop("k", "before")


def undo_gaps(rows: DataFrame, by: str = "term", order: str = "k", gap: str = "gap", span: int = SPAN) -> DataFrame:
    """The running sum of gaps in their order (places from 0 or 1): within buckets of `span` places, on top of the sums of the buckets before."""
    own = rows.withColumn("_bucket", F.floor(F.col(order) / span))
    total = own.groupBy(by, "_bucket").agg(F.sum(gap).alias("_sum"))
    ahead = total.select(by, "_bucket", (F.sum("_sum").over(Window.partitionBy(by).orderBy("_bucket")) - F.col("_sum")).alias("_ahead"))
    return own.withColumn("_own", F.sum(gap).over(Window.partitionBy(by, "_bucket").orderBy(order))).join(ahead, [by, "_bucket"]).withColumn("n", F.col("_ahead") + F.col("_own")).drop("_bucket", "_own", "_ahead")


def delta(values: Column) -> Column:
    """Gaps of a sorted array."""
    before = F.concat(F.array(F.lit(0).cast("bigint")), F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))))
    return F.when(F.size(values) == 0, values).otherwise(F.zip_with(values, before, lambda a, b: a - b))


def undelta(deltas: Column) -> Column:
    """The sorted array that has these gaps."""
    return F.transform(deltas, lambda x, k: F.aggregate(F.slice(deltas, 1, k + 1), F.lit(0).cast("bigint"), lambda s, v: s + v))


def varint_size(v: Column) -> Column:
    """Bytes of a non-negative number in base 128."""
    return F.greatest(F.ceil(F.length(F.bin(v)) / 7), F.lit(1)).cast("bigint")


def varint_bytes(values: np.ndarray) -> bytes:
    """Base-128 bytes, low seven bits first, high bit set but on the last of a number."""
    if (np.asarray(values) < 0).any():
        raise ValueError("a varint is not negative")
    v = np.asarray(values).astype(np.uint64)
    n = np.maximum(1, np.ceil(np.log2(v.astype(np.float64) + 1) / 7).astype(int)) if len(v) else np.zeros(0, int)
    n += (v >> np.minimum(7 * n, 63).astype(np.uint64) > 0) & (7 * n < 64)
    at = np.repeat(np.cumsum(n) - n, n)
    k = np.arange(int(n.sum())) - at
    each = (np.repeat(v, n) >> (7 * k).astype(np.uint64)) & np.uint64(127)
    return (each.astype(np.uint8) | np.where(k < np.repeat(n, n) - 1, 128, 0).astype(np.uint8)).tobytes()


def varint_values(data: bytes) -> list[int]:
    """The numbers: a byte without its high bit ends one, and each byte counts for seven bits by its place in its number."""
    v = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(v < 128)
    if len(v) and (not len(ends) or ends[-1] != len(v) - 1):
        raise ValueError("the last number has no end")
    if not len(v):
        return []
    first = np.append(0, ends[:-1] + 1)
    place = np.arange(len(v)) - np.repeat(first, ends - first + 1)
    return np.add.reduceat((v & 127).astype(np.uint64) << (7 * place).astype(np.uint64), first).tolist()


def lists(postings: DataFrame) -> DataFrame:
    """(term, docs): array postings, sorted."""
    return dealt(postings, parts(postings), "term").groupBy("term").agg(F.array_sort(F.collect_list("n")).alias("docs"))


def compress(postings: DataFrame) -> DataFrame:
    """postings with `packed`: gaps as variable-length bytes, from array postings (term, docs)."""

    @F.pandas_udf("binary")
    def packed(lists: pd.Series) -> pd.Series:
        return lists.map(lambda v: varint_bytes(np.diff(np.asarray(v, np.int64), prepend=0)))

    ship(postings.sparkSession)
    return postings.withColumn("packed", packed("docs"))


def decompress(packed: DataFrame, to: str = "docs") -> DataFrame:
    """packed with the lists that its bytes stand for in column `to`."""

    @F.pandas_udf("array<bigint>")
    def docs(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: np.cumsum(varint_values(b)).astype(np.int64))

    ship(packed.sparkSession)
    return packed.withColumn(to, docs("packed"))


def compression_totals(postings: DataFrame) -> DataFrame:
    """One row: raw bytes (4 each), packed bytes, ratio."""
    size = gaps(postings).agg((F.count("*") * 4).alias("raw_bytes"), F.coalesce(F.sum(varint_size(F.col("gap"))), F.lit(0)).alias("packed_bytes"))
    return size.select("raw_bytes", "packed_bytes", F.round(F.coalesce(F.try_divide("raw_bytes", "packed_bytes"), F.lit(0.0)), 6).alias("ratio"))


def skip_list(postings: DataFrame, interval: int = SKIP) -> DataFrame:
    """(term, start, max_n): each block's first place and its largest document, never its first."""
    own = ranked(postings).withColumn("start", (F.floor(F.col("k") / interval) * interval).cast("bigint"))
    return own.groupBy("term", "start").agg(F.max("n").alias("max_n"))


def blocks(scored: DataFrame, size: int = BLOCK) -> DataFrame:
    """(term, start, end, max_n, max_score) of scored postings (term, n, score)."""
    own = ranked(scored).withColumn("start", (F.floor(F.col("k") / size) * size).cast("bigint"))
    return own.groupBy("term", "start").agg((F.first("start") + F.count("*")).alias("end"), F.max("n").alias("max_n"), F.max("score").alias("max_score"))


def shorter_and_longer(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(n, k, len) of the shorter of two lists (of equal ones the left), and (n, k) of the longer; k: place from 0, len: the longer's length."""
    sides = ranked(left.select(F.lit("a").alias("side"), "n").unionByName(right.select(F.lit("b").alias("side"), "n")), "side")
    sizes = F.broadcast(sides.groupBy().agg(F.count(F.when(F.col("side") == "a", 1)).alias("a"), F.count(F.when(F.col("side") == "b", 1)).alias("b")))
    both = sides.crossJoin(sizes).withColumn("big", F.col("side") == F.when(F.col("a") <= F.col("b"), "b").otherwise("a"))
    return both.filter(~F.col("big")).select("n", "k", F.greatest("a", "b").alias("len")), both.filter("big").select("n", "k")


def comparisons_plain(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: hits, and postings looked at by testing each of the shorter list against the longer from its start."""
    small, big = shorter_and_longer(left, right)
    looked = small.select("n", "len").join(big.select("n", (F.col("k") + 1).alias("place")), "n", "left")
    return looked.agg(F.count("place").alias("hits"), F.coalesce(F.sum(F.coalesce("place", "len")), F.lit(0)).alias("examined"))


def located(small: DataFrame, big: DataFrame, span: int = SPAN) -> DataFrame:
    """(n, at, hit): for each of the shorter list, in how many of the longer a smaller number stands (its lower bound), and whether it is there.
    Both lists meet in buckets of numbers; a bucket's bound starts from the sizes of the buckets before."""
    bucket = F.floor(F.col("n") / span)
    every = big.select("n", F.lit(1).alias("there"), F.lit(0).alias("asked")).unionByName(small.select("n", F.lit(0).alias("there"), F.lit(1).alias("asked")))
    met = every.groupBy("n").agg(F.max("there").alias("there"), F.max("asked").alias("asked")).withColumn("bucket", bucket)
    inner = Window.partitionBy("bucket").orderBy("n")
    size = big.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("size"))
    ahead = met.select("bucket").distinct().join(size, "bucket", "left").select("bucket", (F.coalesce(F.sum("size").over(Window.orderBy("bucket")), F.lit(0)) - F.coalesce("size", F.lit(0))).alias("ahead"))  # a row per bucket
    own = met.withColumn("own", F.sum("there").over(inner) - F.col("there")).join(ahead, "bucket")
    return own.filter("asked = 1").select("n", (F.col("ahead") + F.col("own")).alias("at"), (F.col("there") == 1).alias("hit"))


def intersect_skips(left: DataFrame, right: DataFrame, interval: int = SKIP) -> DataFrame:
    """(n, jumps, steps, hit): an intersection with skip pointers, a row for each of the shorter list that the longer's end doesn't cut off.
    The longer list is in blocks of `interval` postings. A block is jumped where its largest number is too small, a posting is stepped over where it is smaller, and
    a hit takes one comparison more. The place where a number belongs says all of it: the blocks between that of the number before and its own are
    jumped; within its own block it steps from the block's start, or again from there if the number before was in it too. A number beyond the end jumps
    what is left, and nothing after it is looked up."""
    small, big = shorter_and_longer(left, right)
    size = F.broadcast(big.agg(F.count("*").alias("m")))
    placed = small.select("n", "k").join(located(small, big), "n").crossJoin(size).withColumn("over", F.col("at") >= F.col("m"))
    n_blocks = F.ceil(F.col("m") / interval)
    block = F.when(F.col("over"), n_blocks).otherwise(F.floor(F.col("at") / interval))
    own = placed.withColumns({"block": block, "steps": F.when(F.col("over"), 0).otherwise(F.col("at") % interval)})
    prior = own.select((F.col("k") + 1).alias("k"), F.col("block").alias("from_block"), F.col("over").alias("ended"))
    known = own.join(prior, "k", "left").filter(~F.coalesce("ended", F.lit(False)))
    return known.select("n", (F.col("block") - F.coalesce("from_block", F.lit(0))).alias("jumps"), "steps", "hit")


def skipping(small: list[int], big: list[int], interval: int = SKIP) -> int:
    """What comparisons_skips() counts, of two sorted lists in memory."""
    small, big = sorted((np.asarray(v, np.int64) for v in (small, big)), key=len)
    if not len(small):
        return 0
    at = np.searchsorted(big, small)
    ended = at >= len(big)
    block = np.where(ended, -(-len(big) // interval), at // interval)
    looked = np.diff(block, prepend=0) + np.where(ended, 0, at % interval) + np.isin(small, big)
    return int(looked[: len(small) - max(int(ended.sum()) - 1, 0)].sum())


def comparisons_skips(left: DataFrame, right: DataFrame, interval: int = SKIP) -> DataFrame:
    """One row: hits, and postings that the intersection with skip pointers looks at."""
    found = intersect_skips(left, right, interval)
    looked = F.col("jumps") + F.col("steps") + F.col("hit").cast("bigint")
    return found.agg(F.count(F.when(F.col("hit"), 1)).alias("hits"), F.coalesce(F.sum(looked), F.lit(0)).cast("bigint").alias("examined"))


def plain_against_skips(postings: DataFrame, terms: list[str], interval: int = SKIP) -> DataFrame:
    """(term, other, hits, plain, skips) of the first two of the terms that have postings; an error where there are fewer."""
    known = {r.term for r in postings.filter(F.col("term").isin(terms)).select("term").distinct().collect()}  # a few terms
    own = [t for t in dict.fromkeys(terms) if t in known][:2]
    if len(own) < 2:
        raise ValueError("two known terms are needed")
    a, b = (postings.filter(F.col("term") == t).select("n") for t in own)
    skips = comparisons_skips(a, b, interval).select(F.col("examined").alias("skips"))
    return comparisons_plain(a, b).crossJoin(skips).select(F.lit(own[0]).alias("term"), F.lit(own[1]).alias("other"), "hits", F.col("examined").alias("plain"), "skips")


def wand_demo(scored: DataFrame, terms: list[str], threshold: float, k: int = 10, size: int = BLOCK) -> DataFrame:
    """(doc, score): documents in all lists, each with the sum of its blocks' maxima, up to the first document in front at which a list has
    ended or every block in front has its maximum under the threshold; best k, ties by document number. An upper-bound demonstration, not rank-safe."""
    own = ranked(scored.filter(F.col("term").isin(terms))).withColumn("start", F.floor(F.col("k") / size))
    top = own.withColumn("top", F.max("score").over(Window.partitionBy("term", "start")))
    wide = top.groupBy("n").agg(*[F.max(F.when(F.col("term") == t, F.col("top"))).alias(f"t{k}") for k, t in enumerate(terms)])
    ahead = Window.partitionBy(F.lit(0)).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)  # the query's own documents, in order: lockstep
    front = wide.withColumns({f"f{j}": F.last(f"t{j}", ignorenulls=True).over(ahead) for j in range(len(terms))})
    stop = F.greatest(*[F.coalesce(f"f{j}", F.lit(float("-inf"))) for j in range(len(terms))], F.lit(float("-inf"))) < threshold
    for j in range(len(terms)):
        stop = stop | F.col(f"f{j}").isNull()
    until = F.broadcast(front.agg(F.min(F.when(stop, F.col("n"))).alias("until")))
    every = front.crossJoin(until).filter(F.col("until").isNull() | (F.col("n") < F.col("until")))
    for j in range(len(terms)):
        every = every.filter(F.col(f"t{j}").isNotNull())
    total = sum((F.col(f"t{j}") for j in range(len(terms))), F.lit(0.0))
    return every.select(F.col("n").cast("string").alias("doc"), F.round(total, 6).alias("score"), "n").orderBy(F.desc("score"), "n").limit(k).select("doc", "score")


def top_k_block_max(scored: DataFrame, k: int, size: int = BLOCK) -> DataFrame:
    """(n, score): the exact top k of summed scores. The bound of a document is the sum, over terms, of the largest score of the term's block that it falls in; the scores of the
    4 * k documents with the largest bounds are summed first, and of the rest only of those whose bound reaches the k-th best of them."""
    own = ranked(scored).withColumn("block", F.floor(F.col("k") / size))
    tops = own.groupBy("term", "block").agg(F.max("score").alias("top"))
    bounds = own.select("term", "block", "n").join(tops, ["term", "block"]).groupBy("n").agg(F.sum("top").alias("bound"))
    seeds = F.broadcast(bounds.orderBy(F.desc("bound"), "n").limit(4 * k))
    known = scored.join(seeds, "n").groupBy("n").agg(F.sum("score").alias("total"))
    theta = F.broadcast(known.orderBy(F.desc("total"), "n").limit(k).agg(F.min("total").alias("theta"), F.count("*").alias("have")))
    left = bounds.crossJoin(theta).filter((F.col("have") < k) | (F.col("bound") >= F.col("theta") - 1e-9)).select("n")
    return scored.join(left, "n", "left_semi").groupBy("n").agg(F.round(F.sum("score"), 6).alias("score")).orderBy(F.desc("score"), "n").limit(k)
