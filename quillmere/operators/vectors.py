"""Vector search: exact and through an inverted file of centroids with product codes; a small semantic search engine."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructType

from quillmere.sources.ship import ship


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products in double precision, whatever the arrays hold."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    """The length of a vector; 1 for a zero vector, so that its cosine is 0."""
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, 1.0).otherwise(n)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def l2_squared(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v)


def cosine_from_l2(d2: Column) -> Column:
    """Of unit vectors."""
    return (2 - d2) / 2


def exact_top_k(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding", where: Column | None = None, unit: bool = True, digits: int = 5) -> DataFrame:
    """(key, score): best k by cosine, ties by key. where is a filter on the rows before they are ranked. Unit vectors need the dot product only."""
    rows = vectors if where is None else vectors.filter(where)
    q = F.lit([float(x) for x in query])
    score = dot(vector, q) if unit else cosine(vector, q)
    return rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(key, F.round(score, digits).alias("score")).orderBy(F.desc("score"), key).limit(k)


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", most_queries: int = 10_000) -> DataFrame:
    """(qid, key, score, rank) of a batch of query vectors (qid, query). Blocks of about most_queries queries, by the hash of qid, are broadcast
    in turn and searched against all rows, tile by tile; each task keeps its k best per query."""
    asked = present(queries, "query")
    n_queries = asked.count()
    rows = dealt(present(vectors, vector).select(key, vector), key, n_queries, -(-n_queries // most_queries))
    found = [_block_top_k(rows, block, k, key, vector, queries.schema["qid"].dataType) for block in query_blocks(asked, most_queries, n_queries)]
    if not found:
        return vectors.sparkSession.createDataFrame([], f"qid {dict(queries.dtypes)['qid']}, {key} {dict(vectors.dtypes)[key]}, score double, rank int")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), key)
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Products of a query and a row: those of a tile that a worker holds, and those of a task, at least and about at most.
TILE, LEAST_WORK, MOST_WORK = 1 << 20, 1 << 20, 1 << 28


def dealt(rows: DataFrame, key: str, n_queries: int, n_blocks: int, most: int = MOST_WORK) -> DataFrame:
    """rows by the hash of their key, in so many parts that the tasks of all blocks of queries keep the cores busy and none has far more than `most` products.
    There are no more, for each task sends on what it keeps for every query of its block."""
    work = rows.count() * n_queries
    tasks = max(min(4 * rows.sparkSession.sparkContext.defaultParallelism, work // LEAST_WORK), work // most)
    return rows.repartition(max(1, -(-tasks // max(1, n_blocks))), key)


def query_blocks(queries: DataFrame, most: int, count: int):
    """Lists of (qid, query) of the `count` queries, one at a time; none is empty."""
    n = -(-count // most)
    for block in range(n):
        asked = [(r.qid, None if r.query is None else list(r.query)) for r in queries.filter(F.pmod(F.xxhash64("qid"), F.lit(n)) == block).collect()]
        if asked:
            yield asked


def stacked(lists: pa.Array) -> np.ndarray:
    """Vectors of one size as the rows of a matrix."""
    flat, size = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(lists.offsets.to_numpy())
    if (size != size[0]).any():
        raise ValueError(f"vectors of {size.min()} and of {size.max()} numbers")
    return flat.reshape(len(size), int(size[0]))


class Best:
    """The `most` rows with the largest scores for each of n queries, ties to the smaller key, from tiles of scores. It holds about three times what it
    keeps. within: how far a score that is given may be under the one that is kept (by rounding)."""

    def __init__(self, n: int, most: int, within: float = 0.0):
        self.n, self.most, self.within = n, most, within
        self.floor = np.full(n, -np.inf)  # what is under it is not kept
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def candidates(self, queries: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a tile (queries x rows) of what may be among the best. NaN counts as the largest, as in Spark."""
        floor = self.floor[queries]
        near = ~(scores < floor[:, None])
        if scores.shape[1] > self.most > 0 and np.count_nonzero(near) > 4 * self.most * len(queries):
            least = np.partition(scores, -self.most, axis=1)[:, -self.most]
            near = ~(scores < np.fmax(floor, np.where(np.isnan(least), np.inf, least) - self.within)[:, None])
        return np.nonzero(near)

    def add(self, queries: np.ndarray, scores: np.ndarray, keys: np.ndarray, *more: np.ndarray) -> None:
        self.parts.append((queries.astype(np.int32), scores, keys, *more))
        self.waiting += len(queries)
        if self.waiting > 2 * self.n * self.most + (1 << 18):
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        """What is kept: query, score, key, and what else was added."""
        if not self.parts:
            return np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int64), np.zeros(0)
        q, score, key, *more = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        large = np.where(np.isnan(score), np.inf, score)
        order = np.lexsort((key if key.dtype != object else np.unique(key, return_inverse=True)[1], -large, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        last = order[place == self.most - 1]
        self.floor[q[last]] = large[last] - self.within
        order = order[place < self.most]
        self.parts, self.waiting = [tuple(x[order] for x in (q, score, key, *more))], 0
        return self.parts[0]


def tiles(queries: np.ndarray, n_rows: int, most: int = TILE):
    """The queries in stretches of which each makes a tile of `most` scores at most with n_rows rows."""
    step = max(1, most // max(1, n_rows))
    for at in range(0, len(queries), step):
        yield queries[at : at + step]


def batches(frames, most: int = 4096):
    """Arrow batches of `most` rows at most, without empty ones."""
    for f in frames:
        for at in range(0, f.num_rows, most):
            yield f.slice(at, most)


def nearest(frames, asked: np.ndarray, k: int, key: str, vector: str, digits: int = 5) -> tuple[np.ndarray, ...]:
    """(query, score, key) of the k best rows of Arrow batches for each of the asked vectors; one tile of scores is held at a time."""
    best, every = Best(len(asked), k, 10.0**-digits), np.arange(len(asked))
    for f in batches(frames):
        x, own = stacked(f.column(vector)).T, f.column(key).to_numpy(zero_copy_only=False)
        for some in tiles(every, len(own)):
            s = asked[some] @ x
            i, j = best.candidates(some, s)
            best.add(some[i], np.round(s[i, j], digits) + 0.0, own[j])
    return best.settle()[:3]


def _block_top_k(rows: DataFrame, asked: list[tuple], k: int, key: str, vector: str, qkind: DataType) -> DataFrame:
    ship(rows.sparkSession)
    kinds = StructType().add("qid", qkind).add(key, rows.schema[key].dataType).add("score", "double")
    kind = to_arrow_schema(kinds)
    held = rows.sparkSession.sparkContext.broadcast((np.array([q for _, q in asked], np.float64), [i for i, _ in asked]))

    def search(frames):
        matrix, names = held.value
        q, score, own = nearest(frames, matrix, k, key, vector)
        for at in range(0, len(q), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array([names[j] for j in q[part]], kind.field(0).type), pa.array(own[part], kind.field(1).type), pa.array(score[part])], schema=kind)

    return rows.mapInArrow(search, kinds)


def present(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows with a vector that is neither null nor empty."""
    return vectors.filter(F.col(vector).isNotNull() & (F.size(vector) > 0))


def winner(a: Column, b: Column) -> Column:
    """Which of two scores is larger; the left one on a tie."""
    return F.when(a >= b, "left").otherwise("right")


def similarity_matrix(few: DataFrame, key: str = "vec_id", vector: str = "embedding", every: DataFrame | None = None, most_queries: int = 10_000) -> DataFrame:
    """(a, b, score) of all pairs of a small set, for charts; or of all pairs of a row of few and one of every, neither of which needs to be small:
    blocks of about most_queries of few are broadcast in turn, and each task multiplies them with its rows of every, tile by tile."""
    if every is not None:
        return _all_scores(few, every, key, vector, most_queries)
    a = few.select(F.col(key).alias("a"), F.col(vector).alias("va"))
    b = few.select(F.col(key).alias("b"), F.col(vector).alias("vb"))
    return a.crossJoin(F.broadcast(b)).select("a", "b", F.round(cosine("va", "vb"), 5).alias("score"))


#: Scores that a task of the similarity matrix writes, about.
WRITTEN = 1 << 24


def _all_scores(few: DataFrame, every: DataFrame, key: str, vector: str, most_queries: int) -> DataFrame:
    few, rows = few.select(F.col(key).alias("qid"), F.col(vector).alias("query")), every.select(key, vector)
    kinds = StructType().add("a", few.schema["qid"].dataType).add("b", rows.schema[key].dataType).add("score", "double")
    kind, n_few = to_arrow_schema(kinds), few.count()
    rows = dealt(rows, key, n_few, -(-n_few // most_queries), WRITTEN)
    ship(rows.sparkSession)

    def scored(asked):
        names = pa.array([i for i, _ in asked], kind.field(0).type)
        held = rows.sparkSession.sparkContext.broadcast((names, pa.array([q for _, q in asked], pa.list_(pa.float64()))))

        def score(frames):
            names, vectors = held.value
            left = by_size(vectors)
            for f in batches(frames):
                right, own = by_size(f.column(vector)), f.column(key)
                for some in tiles(np.arange(len(names)), f.num_rows):
                    s = cosines(left, right, some[0], len(some), f.num_rows)
                    i, j = np.repeat(some, f.num_rows), np.tile(np.arange(f.num_rows), len(some))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), own.take(pa.array(j)), s], schema=kind)

        return rows.mapInArrow(score, kinds)

    found = [scored(block) for block in query_blocks(few, most_queries, n_few)]
    return reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], kinds)


def by_size(lists: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, vectors, norms) of vectors of one size each, without those that are null or hold one; a zero vector's norm is 1, as for norm()."""
    sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
    if len(lists) and not lists.null_count and not flat.null_count and (sizes == sizes[0]).all():
        found = [(np.arange(len(lists)), stacked(lists))]
    else:
        own = [(k, v) for k, v in enumerate(lists.to_pylist()) if v is not None and None not in v]
        found = [(np.array([k for k, v in own if len(v) == n]), np.array([v for _, v in own if len(v) == n], np.float64)) for n in sorted({len(v) for _, v in own})]
    norms = [np.sqrt((v * v).sum(1)) for _, v in found]
    return [(at, v, np.where(n == 0, 1.0, n)) for (at, v), n in zip(found, norms, strict=True)]


def cosines(left: list, right: list, start: int, n: int, m: int, digits: int = 5) -> pa.Array:
    """Rounded cosines of n vectors of left from place `start` and all m of right (see by_size), row by row; null for vectors that are null or of two sizes."""
    out, there = np.zeros((n, m)), np.zeros((n, m), bool)
    for at, a, na in left:
        low, high = np.searchsorted(at, [start, start + n])
        for to, b, nb in right:
            if a.shape[1] == b.shape[1] and high > low:
                s = np.round(a[low:high] @ b.T / (na[low:high, None] * nb), digits) + 0.0
                if s.shape == out.shape:
                    return pa.array(s.ravel())
                place = np.ix_(at[low:high] - start, to)
                out[place], there[place] = s, True
    return pa.array(out.ravel(), mask=~there.ravel())


def principal_axes(vectors: DataFrame, k: int = 2, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, coordinates): projection to the first k principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    return PCA(k=k, inputCol="v", outputCol="p").fit(rows).transform(rows).select(key, vector_to_array("p").alias("coordinates"))


# --- inverted file with product codes -----------------------------------------------------------------------------


def kmeans(points: np.ndarray, k: int, rounds: int = 15, seed: int = 1) -> np.ndarray:
    """Centroids of a sample, started far apart."""
    rng = np.random.default_rng(seed)
    k = min(k, len(points))
    centres = points[[int(rng.integers(len(points)))]]
    gap = ((points - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        pick = int(rng.choice(len(points), p=gap / gap.sum())) if gap.sum() > 0 else int(rng.integers(len(points)))
        centres = np.concatenate([centres, points[[pick]]])
        gap = np.minimum(gap, ((points - centres[-1]) ** 2).sum(1))
    for _ in range(rounds):
        own = ((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)).argmin(1)
        for j in range(k):
            if (own == j).any():
                centres[j] = points[own == j].mean(0)
    return centres


#: Settings for recall on vectors without clear clusters: cells, stretches of a vector, codes of a stretch, cells that a search reads and rows (times k)
#: that it scores exactly.
PARTITIONS, STRETCHES, CODES, NPROBE, RERANK = 8, 16, 64, 6, 20


def parts_of_vectors(rows: DataFrame, size: int, mb: float = 32) -> int:
    """How many tasks hold a vector of `size` numbers for each of the rows at about mb MB each; files say little, for vectors may be almost all zeros."""
    n = rows.count()
    return max(int(n * size * 4 / (mb * 1e6)), min(rows.sparkSession.sparkContext.defaultParallelism, n // 1000)) + 1


@dataclass
class IvfPq:
    """Coarse centroids, and a codebook for each stretch of the residuals. Fitted on a bounded sample; every row is indexed."""

    centres: np.ndarray
    books: np.ndarray  # stretches x codes x width

    @classmethod
    def fit(cls, vectors: DataFrame, partitions: int = 4, stretches: int = 4, codes: int = 16, sample: int = 20_000, vector: str = "embedding", key: str = "vec_id") -> IvfPq:
        """The sample is the `sample` rows with the lowest hash of their key. Keys are ordered first, so that no task sends a sample's vectors of its own."""
        rows = present(vectors, vector).select(F.xxhash64(key).alias("h"), F.col(key).alias("key"), F.col(vector).alias("vector"))
        last = rows.select("h", "key").orderBy("h", "key").limit(sample).toArrow()
        if not last.num_rows:
            return cls(np.zeros((1, 1)), np.zeros((1, 1, 1)))  # nothing to index
        h, name = (F.lit(last.column(c)[-1].as_py()) for c in ("h", "key"))
        found = rows.filter((F.col("h") < h) | ((F.col("h") == h) & (F.col("key") <= name))).toArrow().sort_by([("h", "ascending"), ("key", "ascending")])
        x = stacked(found.column("vector").combine_chunks())[:sample]
        stretches = max(k for k in range(1, stretches + 1) if x.shape[1] % k == 0)
        centres = kmeans(x, partitions)
        left = x - centres[((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)]
        width = x.shape[1] // stretches
        return cls(centres, np.stack([kmeans(left[:, s * width : (s + 1) * width], codes, seed=s) for s in range(stretches)]))

    def index(self, vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
        """(key, cell, codes, vector): to be written partitioned by cell."""
        centres, books = self.centres, self.books
        kind = dict(vectors.dtypes)[key]

        def place(frames):
            for f in frames:
                x = np.stack(f[vector].to_numpy()).astype(np.float64) if len(f) else np.zeros((0, centres.shape[1]))
                cell = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
                left = x - centres[cell]
                w = books.shape[2]
                codes = [((left[:, None, s * w : (s + 1) * w] - books[s][None]) ** 2).sum(2).argmin(1) for s in range(len(books))]
                yield pd.DataFrame({key: f[key].astype(object), "cell": cell.astype(np.int32), "codes": list(np.stack(codes, 1).astype(np.int32)) if len(f) else [], vector: f[vector]})

        return present(vectors, vector).select(key, vector).mapInPandas(place, f"{key} {kind}, cell int, codes array<int>, {vector} array<float>")

    def write(self, vectors: DataFrame, path: str, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
        """The index as a table with a folder for each cell, so that a search reads the cells it probes."""
        rows = vectors.repartition(parts_of_vectors(vectors, self.centres.shape[1]), key)  # a task sorts its rows by cell
        self.index(rows, vector, key).write.mode("overwrite").partitionBy("cell").parquet(path)
        return vectors.sparkSession.read.parquet(path)

    def search(self, index: DataFrame, query: list[float], k: int, nprobe: int = NPROBE, rerank: int | None = RERANK, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
        """(key, score): the nprobe nearest cells are read; product codes choose rerank * k rows (all where it is None), which are scored exactly."""
        q = np.asarray(query, np.float64)
        cells = ((self.centres - q) ** 2).sum(1).argsort()[:nprobe]
        w = self.books.shape[2]
        table = np.stack([self.books[s] @ q[s * w : (s + 1) * w] for s in range(len(self.books))])
        near = F.lit([float(c @ q) for c in self.centres])[F.col("cell")]
        guess = near + sum((F.lit([float(v) for v in table[s]])[F.col("codes")[s]] for s in range(len(table))), F.lit(0.0))
        rows = index.filter(F.col("cell").isin([int(c) for c in cells])).select(key, vector, guess.alias("guess"))
        rows = rows if rerank is None else rows.orderBy(F.desc("guess"), key).limit(rerank * k)
        return exact_top_k(rows, query, k, key, vector)

    def batch_search(self, index: DataFrame, queries: DataFrame, k: int, nprobe: int = NPROBE, rerank: int = RERANK, vector: str = "embedding", key: str = "vec_id", most_queries: int = 2_000) -> DataFrame:
        """(qid, key, score, rank) of queries (qid, query), each as search() answers it; blocks of queries are broadcast."""
        kinds = StructType().add("qid", queries.schema["qid"].dataType).add(key, index.schema[key].dataType).add("score", "double").add("guess", "double")
        asked = present(queries, "query")
        n_queries = asked.count()
        rows = dealt(index.select(key, "cell", "codes", vector), key, n_queries, -(-n_queries // most_queries))
        found = [self._block_search(rows, block, rerank * k, nprobe, vector, key, kinds) for block in query_blocks(asked, most_queries, n_queries)]
        if not found:
            return index.sparkSession.createDataFrame([], StructType(kinds.fields[:3]).add("rank", "int"))
        best = reduce(DataFrame.unionByName, found)
        by_guess, by_score = Window.partitionBy("qid").orderBy(F.desc("guess"), key), Window.partitionBy("qid").orderBy(F.desc("score"), key)
        chosen = best.withColumn("rank", F.row_number().over(by_guess)).filter(F.col("rank") <= rerank * k)
        return chosen.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).select("qid", key, "score", "rank")

    def guessed(self, frames, asked: np.ndarray, most: int, nprobe: int, vector: str, key: str) -> tuple[np.ndarray, ...]:
        """(query, guess, key, score) of the `most` rows of Arrow batches with the best guesses for each of the asked vectors. A cell's rows meet the
        queries that probe it, tile by tile; a guess is the product with what the codes stand for, and only rows that may be among the best are scored."""
        probed = np.zeros((len(asked), len(self.centres)), bool)
        np.put_along_axis(probed, ((self.centres[None] - asked[:, None]) ** 2).sum(2).argsort(1)[:, :nprobe], True, 1)
        best, stretch = Best(len(asked), most), np.arange(len(self.books))
        for f in batches(frames):
            cell, codes = f.column("cell").to_numpy(), f.column("codes").flatten().to_numpy().reshape(f.num_rows, -1)
            x, own = stacked(f.column(vector)), f.column(key).to_numpy(zero_copy_only=False)
            meant = self.centres[cell] + self.books[stretch, codes].reshape(f.num_rows, -1)
            for c in np.unique(cell):
                rows = np.flatnonzero(cell == c)
                for some in tiles(np.flatnonzero(probed[:, c]), len(rows)):
                    guess = asked[some] @ meant[rows].T
                    i, j = best.candidates(some, guess)
                    score = [np.einsum("ij,ij->i", asked[some[i[at : at + 8192]]], x[rows[j[at : at + 8192]]]) for at in range(0, len(i), 8192)]
                    best.add(some[i], guess[i, j], own[rows[j]], np.round(np.concatenate([np.zeros(0), *score]), 5) + 0.0)
        return best.settle()

    def _block_search(self, rows: DataFrame, asked: list[tuple], most: int, nprobe: int, vector: str, key: str, kinds: StructType) -> DataFrame:
        """The `most` rows with the best guesses of each query and task."""
        ship(rows.sparkSession)
        held = rows.sparkSession.sparkContext.broadcast((self, np.array([q for _, q in asked], np.float64), [i for i, _ in asked]))
        kind = to_arrow_schema(kinds)

        def search(frames):
            model, matrix, names = held.value
            q, guess, own, score = model.guessed(frames, matrix, most, nprobe, vector, key)
            for at in range(0, len(q), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array([names[j] for j in q[part]], kind.field(0).type), pa.array(own[part], kind.field(1).type), pa.array(score[part]), pa.array(guess[part])], schema=kind)

        return rows.mapInArrow(search, kinds)


def agreement(found: DataFrame, exact: DataFrame, key: str | list[str] = "vec_id") -> DataFrame:
    """One row: how many of the exact keys were found, of how many, and whether all."""
    keys = [key] if isinstance(key, str) else key
    hit = exact.select(*keys).join(found.select(*keys, F.lit(1).alias("hit")), keys, "left")
    return hit.agg(F.count("hit").alias("agreed"), F.count("*").alias("asked"), (F.count("hit") == F.count("*")).alias("same"))


# --- named collections --------------------------------------------------------------------------------------------


class Collections:
    """Vector tables by name under a folder: recreated, added to and searched. A collection holds vectors of one size, which it checks."""

    def __init__(self, spark: SparkSession, root: str, key: str = "vec_id", vector: str = "embedding"):
        self.spark, self.root, self.key, self.vector = spark, root.rstrip("/"), key, vector

    def recreate(self, name: str, kind: str = "bigint") -> None:
        """An empty collection; one of that name is replaced. kind: the keys' type."""
        self.spark.createDataFrame([], f"{self.key} {kind}, {self.vector} array<float>").write.mode("overwrite").parquet(f"{self.root}/{name}")

    def insert(self, name: str, rows: DataFrame) -> None:
        """Add vectors; rows without one are left out. All must have the same size as those that are there."""
        own = self.rows(name)
        new = present(rows, self.vector).select(F.col(self.key).cast(dict(own.dtypes)[self.key]), F.col(self.vector).cast("array<float>"))
        size = lambda df: df.select(F.size(self.vector).alias("s"))
        found = size(own).limit(1).unionByName(size(new)).agg(F.min("s").alias("low"), F.max("s").alias("high")).first()
        if found.low != found.high:
            raise ValueError(f"vectors of {found.low} and of {found.high} numbers in {name}")
        new.write.mode("append").parquet(f"{self.root}/{name}")

    def rows(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def count(self, name: str) -> int:
        return self.rows(name).count()

    def search(self, name: str, query: list[float], k: int) -> DataFrame:
        """(key, score): exact."""
        return exact_top_k(self.rows(name), query, k, self.key, self.vector)


# --- a small semantic search engine -------------------------------------------------------------------------------


def hashed_embedding(text: str, size: int = 384) -> list[float]:
    """A deterministic stand-in for a sentence model: hashed words and letter trigrams, unit length."""
    v = np.zeros(size)
    for word in text.lower().split():
        w = f"#{word}#"
        for piece in [w, *(w[k : k + 3] for k in range(len(w) - 2))]:
            h = int.from_bytes(hashlib.blake2b(piece.encode(), digest_size=8).digest(), "little")
            v[h % size] += 1.0 if h >> 63 else -1.0
    n = math.sqrt(float(v @ v))
    return (v / n if n else v).astype(np.float32).tolist()


class SemanticSearch:
    """Records with a text each; build once, search often. Blank texts are kept apart as missing. Filters apply before ranking."""

    FALLBACKS = ("name", "description", "title", "text")

    def __init__(self, records: DataFrame, text_field: str | None = None, id_field: str = "id", model: Callable[[str], list[float]] = hashed_embedding):
        self.records, self.text_field, self.id_field, self.model = records, text_field, id_field, model
        self.table: DataFrame | None = None
        self.missing: DataFrame | None = None
        self.cells: tuple[IvfPq, DataFrame] | None = None

    def record_text(self) -> Column:
        """The first that is not blank of the chosen field and the fallbacks."""
        names = [f for f in ((self.text_field,) if self.text_field else ()) + self.FALLBACKS if f in self.records.columns]
        texts = [F.col(n).cast("string") for n in names]
        return F.coalesce(*[F.when(F.trim(t) != "", t) for t in texts], F.lit("")) if texts else F.lit("")

    def build(self, path: str, index: bool = False) -> SemanticSearch:
        """Embed all records once and write the table (overwriting it) under path; with index also an inverted file, which searches without a category then read."""
        model = self.model

        @F.pandas_udf("array<float>")
        def embed(texts: pd.Series) -> pd.Series:
            return texts.map(model)

        spark = self.records.sparkSession
        ship(spark)
        rows = self.records.withColumn("_text", self.record_text())
        rows.filter("_text = ''").select(self.id_field).write.mode("overwrite").parquet(f"{path}/missing")
        rows = rows.filter("_text <> ''")
        rows.repartition(parts_of_vectors(rows, len(model("a"))), self.id_field).withColumn("_vector", embed("_text")).write.mode("overwrite").parquet(f"{path}/vectors")
        cells = IvfPq.fit(table := spark.read.parquet(f"{path}/vectors"), PARTITIONS, STRETCHES, CODES, vector="_vector", key=self.id_field) if index else None
        if cells:
            cells.write(table, f"{path}/cells", "_vector", self.id_field)
        held = {"centres": cells.centres.tolist(), "books": cells.books.tolist()} if cells else None
        note = json.dumps({"text_field": self.text_field, "id_field": self.id_field, "index": held})
        spark.createDataFrame([(note,)], "note string").coalesce(1).write.mode("overwrite").text(f"{path}/note")
        return self._read(spark, path)

    def _read(self, spark: SparkSession, path: str) -> SemanticSearch:
        self.table, self.missing = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/missing")
        held = json.loads(spark.read.text(f"{path}/note").first()[0]).get("index")
        self.cells = (IvfPq(np.array(held["centres"]), np.array(held["books"])), spark.read.parquet(f"{path}/cells")) if held else None
        return self

    @classmethod
    def load(cls, spark: SparkSession, path: str, model: Callable[[str], list[float]] = hashed_embedding) -> SemanticSearch:
        """Open a built table; nothing is embedded again."""
        note = json.loads(spark.read.text(f"{path}/note").first()[0])
        table = spark.read.parquet(f"{path}/vectors")
        return cls(table.drop("_text", "_vector"), note["text_field"], note["id_field"], model)._read(spark, path)

    def search(self, query: str, k: int = 5, category: str | None = None) -> DataFrame:
        """All columns of the best k records, and score. A blank query or an unknown category finds nothing. With a category, or without an index, all vectors that are
        left are scored; else those of the cells near the query."""
        if self.table is None:
            raise RuntimeError("build() or load() first")
        if self.cells and category is None and query.strip():
            model, cells = self.cells
            best = model.search(cells, [float(x) for x in self.model(query)], k, vector="_vector", key=self.id_field)
            return self.table.drop("_vector", "_text").join(F.broadcast(best), self.id_field).orderBy(F.desc("score"), self.id_field).limit(k)  # k rows are broadcast
        rows = self.table if category is None else self.table.filter(F.col("category") == category)
        if not query.strip():
            rows = rows.limit(0)
        q = F.lit([float(x) for x in self.model(query)])
        return rows.withColumn("score", F.round(dot("_vector", q), 5)).drop("_vector", "_text").orderBy(F.desc("score"), self.id_field).limit(k)
