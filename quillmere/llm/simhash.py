"""SimHash near-dedup by covering locality-sensitive hashing.

Bit i of a fingerprint has the vector m(i) = 1 + i mod (2**(r+1) - 1) in F_2^(r+1); the mask of table v holds the bits with
<m(i), v> = 1. Any r bits leave a v that is orthogonal to all their vectors, so two fingerprints with r or fewer
differing bits agree under that table's mask: every link is found (r = 2: 7 tables of about 36 bits).

Distinct fingerprints stand for their documents, so exact copies cost nothing. A bucket of up to `BUCKET` distinct fingerprints
is compared within and gives a star per group of linked fingerprints. The fingerprints of larger buckets are
linked exactly another way, without pairs: two fingerprints differ in two or fewer bits if and only if some value is within one
bit of both, so each is sent to the 65 values within one bit of it; at most 65 can meet at a value. (This way is for r = 2; for
other radii larger buckets are split by blocks whose pairs are compared.) Components come from alternating large-star
and small-star steps, each cut by a written table; the number of edges never grows.

Defined results: null or wordless text: fingerprint zero, linked like any other. Null doc_id: takes part; not a component's
name unless all its ids are null. Repeated rows: a row each. Empty table: no rows. Very long texts: read whole, one at
a time. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.batches import documents, id_text, pairs
from quillmere.sources.scratch import discard, materialise
from quillmere.sources.ship import ship

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BUCKET = 2048
HOT = 1000
SHINGLE = 3
SEED = 42


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """The 64-bit majority of the XXH64 of all k-word shingles."""
    import xxhash

    words = text.translate(LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*(words[j:] for j in range(k)), strict=False)) if len(words) >= k else [b" ".join(words)]
    n = max(len(words) - k + 1, 1)
    return majority(np.fromiter((digest(s, SEED) for s in shingles), np.uint64, n))


def majority(h: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes, as a signed value; zero without hashes."""
    sums = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        sums += np.unpackbits(h[a : a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * sums > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE, extra: Column | None = None) -> DataFrame:
    """doc_id, fp, extra (a long of the caller's; else null)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.lit(None) if extra is None else extra).cast("long").alias("extra"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, k) for _, t in pairs(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), b.column(2)], names=["doc_id", "fp", "extra"])

    return rows.mapInArrow(run, "doc_id bigint, fp bigint, extra bigint")


def masks(radius: int) -> list[int]:
    """A mask of 64 bits for each nonzero v, as signed longs."""
    n = 2 ** (radius + 1) - 1
    out = [sum(1 << i for i in range(64) if ((1 + i % n) & v).bit_count() % 2) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def linked_stars(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fp, smallest fp of its group) for the groups that links make among fps, singles left out."""
    x = np.sort(fps.view(np.uint64))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    label = np.arange(len(x))
    while True:
        low = np.where(near, label[None, :], len(x)).min(1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    own = np.flatnonzero(label != np.arange(len(x)))
    return x[own].view(np.int64), x[label[own]].view(np.int64)


def links(nodes: DataFrame, radius: int, bucket: int) -> DataFrame:
    """(a, b): edges that join exactly the fingerprints which links join. nodes: distinct fp."""
    keyed = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks(radius))])).alias("k")).select("fp", "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = keyed.join(sizes, ["t", "key"])
    small = met.filter(F.col("n") <= bucket)
    large = met.filter(F.col("n") > bucket)

    def stars(group: pa.Table) -> pa.Table:
        a, b = linked_stars(group.column("fp").to_numpy().astype(np.int64), radius)
        return pa.table({"a": a, "b": b})

    found = small.select("t", "key", "fp").groupBy("t", "key").applyInArrow(stars, "a bigint, b bigint")
    if radius == 2:
        flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b)) for b in range(64)])
        met_at = large.select("fp").distinct().select("fp", F.explode(flips).alias("z"))
        low = met_at.groupBy("z").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
        rest = met_at.join(low, "z").filter("fp <> b").select(F.col("fp").alias("a"), "b")
    else:
        block = F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") * 2 / F.lit(bucket)))
        blocks = large.withColumn("block", block).withColumn("of", F.ceil(F.col("n") * 2 / F.lit(bucket)))
        pairs = blocks.select("t", "key", "fp", F.explode(F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("x"), F.greatest(o, F.col("block")).alias("y")))).alias("p"))
        rest = pairs.select("t", "key", "p.x", "p.y", "fp").groupBy("t", "key", "x", "y").applyInArrow(lambda g: stars(g), "a bigint, b bigint")
    return found.unionByName(rest).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node of edges (a, b). Large-star, small-star until nothing changes."""
    mark = lambda e: tuple(e.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(a, b)), 0)")).first())
    edges = materialise(edges, "edges")
    last = mark(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(low, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        old, edges = edges, materialise(small, "edges")
        discard(old)
        now = mark(edges)
        if now == last or not now[0]:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_groups(docs: DataFrame, radius: int = 2, k: int = SHINGLE, bucket: int = BUCKET, extra: Column | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, fp, component_id, extra of every document."""
    marked = materialise(fingerprints(docs, k, extra), "fingerprints")
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes.select("fp"), radius, bucket))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of = materialise(named.join(names, "root").select("fp", "n", "component_id"), "of")
    discard(nodes)
    # Fingerprints of over 1 in `hot` rows, fewer than `hot` of them, are broadcast: their rows don't meet in one task.
    least = of.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / hot
    many = F.broadcast(of.filter(F.col("n") > least).select("fp", "component_id"))
    rest = marked.join(many, "fp", "left_anti").join(of.filter(F.col("n") <= least), "fp")
    return marked.join(many, "fp").unionByName(rest.drop("n")).select("doc_id", "fp", "component_id", "extra")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(id_text(documents(spark, sf_dir))).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
