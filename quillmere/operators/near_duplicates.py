"""Near duplicates by word shingles: Jaccard similarity, MinHash bands, similarity graph and its components.

Texts that are equal in their shingles are one class, so copies cost nothing; classes meet in MinHash bands, and only pairs that share one are compared, exactly."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from quillmere.functions.analyzers import plain
from quillmere.operators.index import dealt, parts
from quillmere.sources.scratch import discard, materialise
from quillmere.sources.ship import ship

SHINGLE, SIMILAR = 5, 0.8


#: Tokens or shingles of a stretch of rows that a worker takes at once.
STRETCH = 1 << 19


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit numbers, spread (the last step of MurmurHash3)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def folded(columns) -> np.ndarray:
    """One number for each row of columns of 64-bit numbers, in their order."""
    return mixed(reduce(lambda h, c: h * np.uint64(0x9E3779B97F4A7C15) + c, columns))


def stretches(frames, column: str):
    """Arrow batches cut so that the lists of a column together hold about STRETCH values at most, and the lists as (flat, offsets)."""
    for f in frames:
        at, ends = 0, f.column(column).offsets.to_numpy().astype(np.int64)
        while at < f.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + STRETCH, "right")) - 1)
            part = f.slice(at, to - at)
            own = part.column(column)
            yield part, own.flatten().to_numpy(zero_copy_only=False).view(np.uint64), own.offsets.to_numpy().astype(np.int64) - int(ends[at])
            at = to


def shingled(flat: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash), sorted and distinct, of the runs of `size` tokens of each row of token hashes; a shorter row is one run, an empty one none."""
    n = np.diff(offsets)
    rows, values = [], []
    for k in range(1, size + 1):  # rows of k tokens, or of size and more
        own = np.flatnonzero(n == k if k < size else n >= size)
        runs = n[own] - k + 1
        row = np.repeat(own, runs)
        at = offsets[row] + np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
        rows.append(row)
        values.append(folded([np.full(len(at), k, np.uint64), *(flat[at + j] for j in range(k))]).view(np.int64))
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def shingles(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, shingles): hashes of the distinct runs of `size` tokens, sorted; a shorter text is one shingle, one without tokens is left out.
    Tokens are hashed by Spark, their runs in the workers."""
    ship(docs.sparkSession)
    tokens = docs.select("doc_id", F.transform(plain("text"), lambda t: F.xxhash64(t)).alias("t"))
    kinds = StructType().add("doc_id", docs.schema["doc_id"].dataType).add("shingles", ArrayType(LongType()))
    kind = to_arrow_schema(kinds)

    def runs(frames):
        for f, flat, offsets in stretches(frames, "t"):
            row, value = shingled(flat, offsets, size)
            own, first = np.unique(row, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(value))
            yield pa.RecordBatch.from_arrays([f.column("doc_id").take(pa.array(own)), lists.cast(kind.field(1).type)], schema=kind)

    return tokens.mapInArrow(runs, kinds)


def jaccard(a, b):
    """Similarity of two arrays of distinct values; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))


def classes(docs: DataFrame, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class_id) of every document with a shingle, and (class_id, shingles) of each class; the class is named by its smallest doc_id. Texts are read
    once and their shingles written once: the sets are these without the copies."""
    rows = materialise(shingles(docs, size).withColumn("h", F.struct(F.xxhash64("shingles").alias("x"), F.hash("shingles").alias("y"))), "shingles")
    named = rows.groupBy("h").agg(F.min("doc_id").alias("class_id"))
    member = materialise(rows.select("doc_id", "h").join(named, "h").select("doc_id", "class_id"), "members")
    copies = small(materialise(member.filter("doc_id <> class_id").select("doc_id").distinct(), "copies"))
    sets = rows.join(copies, "doc_id", "left_anti").select(F.col("doc_id").alias("class_id"), "shingles")
    seen = member.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids")).first()
    return member, sets if seen.n == seen.ids else sets.dropDuplicates(["class_id"])


#: Rows of ids that may be broadcast (about 100 MB).
BROADCAST_ROWS = 2_000_000


def small(ids: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows, so that what it meets isn't shuffled."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def band_keys(flat: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """MinHash signatures (least salted hash of each set's numbers) in bands: a key for each set and band."""
    salts = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    least = [np.minimum.reduceat(mixed(flat ^ s), offsets[:-1]) for s in salts]
    return np.stack([folded(least[b * rows : (b + 1) * rows]) for b in range(bands)], 1)


def bands(sets: DataFrame, bands: int = 25, rows: int = 5) -> DataFrame:
    """(class_id, band, key) of sets, of which none is empty."""
    ship(sets.sparkSession)
    kinds = StructType().add("class_id", sets.schema["class_id"].dataType).add("band", IntegerType()).add("key", LongType())
    kind = to_arrow_schema(kinds)

    def keyed(frames):
        for f, flat, offsets in stretches(frames, "shingles"):
            keys = band_keys(flat, offsets, bands, rows)
            own, band = f.column("class_id").take(pa.array(np.repeat(np.arange(len(keys)), bands))), np.tile(np.arange(bands, dtype=np.int32), len(keys))
            yield pa.RecordBatch.from_arrays([own, pa.array(band), pa.array(keys.ravel().view(np.int64))], schema=kind)

    return sets.filter(F.size("shingles") > 0).select("class_id", F.col("shingles").cast("array<bigint>").alias("shingles")).mapInArrow(keyed, kinds)


def compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similarity) of the pairs of classes that are similar. Only the sets of classes in a pair are written, and joined."""
    pairs = materialise(pairs, "pairs")
    paired = small(materialise(pairs.select(F.explode(F.array("a", "b")).alias("class_id")).distinct(), "paired"))
    sets = materialise(sets.join(paired, "class_id", "left_semi"), "paired-sets")
    left, right = (sets.select(F.col("class_id").alias(k), F.col("shingles").alias("s" + k)) for k in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", jaccard("sa", "sb").alias("similarity")).filter(F.col("similarity") >= similarity)


def similar_pairs(sets: DataFrame, similarity: float = SIMILAR, n_bands: int = 25, n_rows: int = 5) -> DataFrame:
    """(a, b, similarity) of classes that share a band and are similar. At similarity 0.8, 25 bands of 5 miss a pair in 20,000. Signatures are made once;
    only rows whose band and key are shared are written, and joined."""
    keyed = bands(sets, n_bands, n_rows)
    many = F.count("*").over(Window.partitionBy("band", "key"))
    met = materialise(dealt(keyed, parts(sets), "band", "key").withColumn("n", many).filter("n > 1").select("class_id", "band", "key"), "met")
    pairs = met.alias("l").join(met.alias("r"), ["band", "key"]).filter("l.class_id < r.class_id").select(F.col("l.class_id").alias("a"), F.col("r.class_id").alias("b")).distinct()
    return compared(pairs, sets, similarity)


def exact_pairs(sets: DataFrame, similarity: float = SIMILAR) -> DataFrame:
    """(a, b, similarity) of all similar classes, by a prefix-filtered join: shingles are ordered by how many classes hold them; sets of which `need` are shared at
    least hold a common one among the n - need + 1 rarest of either. Lengths differ by the similarity at most; what meets is compared whole.
    All shingles are dealt once, by their value; what several classes hold is dealt by class, and only the prefixes are written, and joined."""
    n_parts = parts(sets)
    each = dealt(sets.select("class_id", F.size("shingles").alias("n"), F.explode("shingles").alias("s")), n_parts, "s")
    each = each.withColumn("df", F.count("*").over(Window.partitionBy("s"))).filter("df > 1")  # a shingle of one class joins nothing
    of = Window.partitionBy("class_id")
    place, shared = F.row_number().over(of.orderBy("df", "s")), F.count("*").over(of)
    lost = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9)  # so many of a set's shingles may be its own
    placed = dealt(each, n_parts, "class_id").withColumns({"place": place, "shared": shared})
    prefix = materialise(placed.filter(F.col("place") <= lost + 1 - (F.col("n") - F.col("shared"))).select("class_id", "n", "s"), "prefix")
    met = prefix.alias("l").join(prefix.alias("r"), "s").filter("l.class_id < r.class_id").filter(F.least("l.n", "r.n") >= similarity * F.greatest("l.n", "r.n") - 1e-9)
    return compared(met.select(F.col("l.class_id").alias("a"), F.col("r.class_id").alias("b")).distinct(), sets, similarity)


def linked_documents(docs: DataFrame, similarity: float = SIMILAR, size: int = SHINGLE, pairs=None) -> DataFrame:
    """(a, b, similarity): the similar pairs of classes (by MinHash bands, or by `pairs`, such as exact_pairs), and a row of similarity 1 for each further document of a class (a names the class).
    Documents b, b' of similar or equal classes are similar; a row for every such pair would grow with the square of a group of copies."""
    member, sets = classes(docs, size)
    copies = member.filter("doc_id <> class_id").select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("similarity"))
    return (pairs or similar_pairs)(sets, similarity).unionByName(copies)


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) by hash-to-min with pointer jumping; a written table cuts the lineage of each round."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    label = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    both = materialise(both.distinct(), "graph")
    for _ in range(most_rounds):
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        low = label.join(near, label.node == near.a).select("node", F.least("root", "near").alias("root"))
        jump = low.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = materialise(low.join(jump, "root", "left").select("node", F.least("root", F.coalesce("next", "root")).alias("root")), "labels")
        moved = new.join(label.withColumnRenamed("root", "old"), "node").filter("root <> old").limit(1).count()
        discard(label)
        label = new
        if not moved:
            return label
    raise RuntimeError("components did not settle")


def near_duplicate_groups(docs: DataFrame, similarity: float = SIMILAR, size: int = SHINGLE) -> DataFrame:
    """(doc_id, class_id, group_id) of every document; those without a token are groups of their own."""
    member, sets = classes(docs, size)
    roots = components(materialise(similar_pairs(sets, similarity), "pairs"))
    named = member.join(roots, member.class_id == roots.node, "left").select("doc_id", "class_id", F.coalesce("root", "class_id").alias("group_id"))
    return docs.select("doc_id").join(named, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("group_id", "doc_id").alias("group_id"))
