"""Near copies by SimHash and covering masks, checked exactly: five-word Jaccard similarity of 0.8 or more.

A text's set holds the 32-bit hashes of its runs of five words (ASCII lower case, cut at white space; a shorter text is one run). Texts with
equal sets are one class. A class's SimHash fingerprint is the majority of its set's hashes; under the covering masks of `simhash.masks` (radius 2: seven
tables) any two classes whose fingerprints differ in two or fewer bits meet in a bucket. Fingerprints at a similarity of 0.8 differ in some 10
bits of 64, which no practical cover reaches, so further buckets are added for the pairs beyond the radius: MinHash signatures in 25 bands of 5
rows (a pair at similarity 0.8 shares no band once in 20,000 times, more similar ones less often). Every pair that meets in a bucket of either kind
and can join two groups is compared by its whole sets. Groups are the components of these links: stars of the links that one task
holds, then large-star, small-star.

A bucket of over three members has a centre: of its classes the one whose own buckets are the fullest. All members are compared with the centre
(in smaller buckets all with all). Components of these links are groups; then members outside the centre's group are compared with the
centre's other members of other groups, but only where they can be similar: by their differences from the centre. Those of two similar texts
share much, so a prefix-filtered join of the differences, with length and positional filters, finds every such pair (`parts`) without making
all pairs. What comes out is what comparing all pairs of all buckets would give, for pairs within a group cannot change the components.

Defined results: null or wordless text: the empty set, a class of its own. Null doc_id and repeated rows: a row each. Empty table: no rows.
Very long texts: read whole, one at a time; a set takes 4 bytes for each different run of words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quillmere.llm.batches import pairs, release, schema_of
from quillmere.llm.exchange import mix, powers, rolled
from quillmere.llm.simhash import LOWER, SEED, components, majority, masks
from quillmere.sources.scratch import discard, materialise
from quillmere.sources.ship import ship

SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 25, 5
#: Differing bits of fingerprints up to which the covering masks find every pair, and the masks.
RADIUS = 2
COVER = np.array(masks(RADIUS), np.int64)
#: Links that one task turns into stars.
TOGETHER = 1 << 20
BASE = 0x9E3779B97F4A7C15
SALTS, FACTORS = (mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(BASE))[k::2] for k in range(2))
FACTORS = FACTORS | np.uint64(1)


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 32-bit hashes."""
    import xxhash

    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint32)
    digest = xxhash.xxh64_intdigest
    own = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    return np.unique((mix(rolled(own, min(size, len(words)), BASE)) >> np.uint64(32)).astype(np.uint32))


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band of the MinHash signature of a set that is not empty."""
    low = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(own), 4096):
        h = own[None, a : a + 4096].astype(np.uint64)
        low = np.minimum(low, ((h ^ SALTS[:, None]) * FACTORS[:, None]).min(1))
    band = (mix(low).reshape(BANDS, ROWS) * np.array(powers(BASE, ROWS)[1:])).sum(1, dtype=np.uint64)
    return mix(band).view(np.int64)


def cover_keys(own: np.ndarray) -> np.ndarray:
    """A key for each covering mask: the bits of the set's SimHash fingerprint that it holds."""
    return COVER & np.int64(majority(mix(own.astype(np.uint64) * np.uint64(BASE))))


def bucket_keys(own: np.ndarray) -> np.ndarray:
    """The keys of a set's buckets: those of the covering masks, then those of the MinHash bands; none of an empty set."""
    return np.concatenate([cover_keys(own), band_keys(own)]) if len(own) else np.zeros(0, np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of sorted distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def marked(docs: DataFrame, extra: Column) -> DataFrame:
    """doc_id, extra, class, keys (none of an empty set) and the set of every document."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), extra.cast("long").alias("extra"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            sets = [shingle_set(t) for _, t in pairs(b)]
            names = [xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets]
            keys = [bucket_keys(s) for s in sets]
            columns = [b.column(0), b.column(2), pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "extra", "class", "keys", "own"])
        release()

    return rows.mapInArrow(run, "doc_id bigint, extra bigint, class bigint, keys array<bigint>, own binary")


def verified(proposed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar. sets: class, own."""
    left = sets.select(F.col("class").alias("a"), F.col("own").alias("x"))
    right = sets.select(F.col("class").alias("b"), F.col("own").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lambda v: np.frombuffer(v.as_buffer(), np.uint32)
        for t in batches:
            x, y = t.column("x"), t.column("y")
            near = pa.array([jaccard(whole(p), whole(q)) >= similarity for p, q in zip(x, y, strict=True)], pa.bool_())
            yield t.select(["a", "b"]).filter(near)
        release()

    return proposed.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def parts(near: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Rows of the prefixes of differences. near: class, centre, root, outside (the class is in another group than its centre, so below the
    similarity to it). Two sets a, b at the similarity differ in at most cut * (|a| + |b|) values, in 1 / similarity - 1 of a's size
    too, and their differences from one centre differ in the same values. As an outside one differs from the centre in more than
    cut * (|a| + |centre|), the overlap of differences has a lower bound that depends on one side alone: all after the prefix are left out.
    The order: values that the centre lacks, then its own, both ascending."""
    cut, most = (1 - similarity) / (1 + similarity), 1 / similarity - 1
    tiny = 1e-9
    schema = "centre bigint, class bigint, root bigint, outside boolean, size int, differ int, rest int, value bigint"
    arrow = to_arrow_schema(schema_of(schema))
    whole = near.join(sets, "class").join(sets.select(F.col("class").alias("centre"), F.col("own").alias("middle")), "centre")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda v: np.frombuffer(v.as_buffer(), np.uint32)
        for t in batches:
            values, rest, heads = [], [], []
            for own, middle, outside in zip(t.column("own"), t.column("middle"), t.column("outside").to_pylist(), strict=True):
                own, middle = of(own), of(middle)
                differ = np.concatenate([np.setdiff1d(own, middle, True), np.setdiff1d(middle, own, True)])
                n = len(differ)
                if outside:
                    least = math.ceil((n - cut * (len(own) + len(middle))) / 2 - tiny)
                else:
                    least = math.floor((n - cut * (len(own) - len(middle))) / 2 - tiny) + 1
                least = max(1, least, n - math.floor(most * len(own) + tiny))
                prefix = max(n - least + 1, 0)
                values.append(differ[:prefix])
                rest.append(np.arange(n, n - prefix, -1))
                heads.append((prefix, len(own), n))
            reps, sizes, differs = np.array(heads, np.int64).reshape(-1, 3).T
            at = pa.array(np.repeat(np.arange(len(reps)), reps))
            columns = [t.column(c).take(at) for c in ("centre", "class", "root", "outside")]
            columns += [np.repeat(sizes, reps), np.repeat(differs, reps), np.concatenate([np.zeros(0, np.int64), *rest]), np.concatenate([np.zeros(0, np.uint32), *values])]
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
        release()

    return whole.select("centre", "class", "root", "outside", "own", "middle").mapInArrow(run, schema)


def across(parts: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of different groups that the prefixes, sizes and places of their common values leave possible."""
    cut, tiny = (1 - similarity) / (1 + similarity), 1e-9
    kinds = ("class", "root", "outside", "size", "differ", "rest")
    x, y = (parts.select("centre", "value", *(F.col(c).alias(c + side) for c in kinds)) for side in "xy")
    other = F.col("rootx") != F.col("rooty")
    places = F.least("restx", "resty") + tiny >= (F.col("differx") + F.col("differy") - cut * (F.col("sizex") + F.col("sizey"))) / 2
    sizes = F.least("sizex", "sizey") + tiny >= similarity * F.greatest("sizex", "sizey")
    once = ~F.col("outsidey") | (F.col("classx") < F.col("classy"))
    pair = x.filter("outsidex").join(y, ["centre", "value"]).filter(other & once & sizes & places)
    return pair.select(F.least("classx", "classy").alias("a"), F.greatest("classx", "classy").alias("b")).distinct()


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of all nodes of the links (a, b) but the smallest ones themselves."""
    nodes, own = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = own[: len(a)], own[len(a) :]
    label = np.arange(len(nodes))
    while True:
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (after := label[label]).tobytes() != label.tobytes():
            label = after
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]


def contracted(links: DataFrame, together: int = TOGETHER) -> DataFrame:
    """Links (a, b) with the same components: stars of about `together` links at a time, so that few rounds are left for large-star, small-star."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if ends:
            a, b = stars(*(np.concatenate(c) for c in zip(*ends, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        release()

    return links.coalesce(links.count() // together + 1).mapInArrow(run, "a bigint, b bigint")


def groups(docs: DataFrame, extra: Column, similarity: float = SIMILAR) -> DataFrame:
    """doc_id, extra (a long of the caller's), group of every document; group is a class of the group."""
    rows = materialise(marked(docs, extra), "marked")
    keyed = rows.select("class", "keys").dropDuplicates(["class"]).select("class", F.posexplode("keys").alias("band", "key"))
    ends = keyed.groupBy("band", "key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("n")).filter("n > 1")
    met = materialise(keyed.join(ends, ["band", "key"]), "met")
    one = rows.select("class", "own").dropDuplicates(["class"])  # before the join, so that copies don't meet in one task
    sets = materialise(one.join(met.select("class").distinct(), "class", "left_semi"), "sets")
    crowd = met.filter("n > 3").select("band", "key", "class", "n")
    full = crowd.groupBy("class").agg(F.sum("n").alias("full"))
    centres = crowd.join(full, "class").groupBy("band", "key").agg(F.max_by("class", F.struct("full", "class")).alias("centre"))
    near = materialise(crowd.join(centres, ["band", "key"]).filter("class <> centre").select("class", "centre").distinct(), "near")
    small = met.filter("n <= 3").select(F.explode(F.array(F.struct(F.col("class").alias("a"), F.col("low").alias("b")), F.struct(F.col("high").alias("a"), F.col("class").alias("b")))).alias("p"))
    stars = small.select("p.*").filter("a <> b").unionByName(near.select(F.col("class").alias("a"), F.col("centre").alias("b"))).distinct()
    links = materialise(verified(stars, sets, similarity), "links")
    roots = components(contracted(links))
    top = roots.select(F.col("node").alias("centre"), F.col("root").alias("top"))
    own = near.join(roots.withColumnRenamed("node", "class"), "class", "left").join(top, "centre", "left")
    own = materialise(own.select("centre", "class", F.coalesce("root", "class").alias("root"), (F.coalesce("root", "class") != F.coalesce("top", "centre")).alias("outside")), "own")
    mixed = own.join(own.filter("outside").select("centre").distinct(), "centre", "left_semi")
    prefixes = materialise(parts(mixed, sets, similarity), "prefixes")
    rest = materialise(verified(across(prefixes, similarity), sets, similarity), "links")
    if not rest.isEmpty():
        roots = components(contracted(links.unionByName(rest)))
    for table in (met, sets, near, own, prefixes):
        discard(table)
    return rows.join(roots, F.col("class") == F.col("node"), "left").select("doc_id", "extra", F.coalesce("root", "class").alias("group"))
