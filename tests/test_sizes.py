"""What a task holds and what a query moves, as its input grows."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmere.operators import compression, near_duplicates, ranking, vectors
from quillmere.operators import index as ix
from quillmere.sources.scratch import file_bytes


def arrow(x, start=0, **more):
    return pa.RecordBatch.from_pydict({"vec_id": list(range(start, start + len(x))), "embedding": pa.array(list(x), pa.list_(pa.float32())), **more})


def peak_mb(call):
    tracemalloc.start()
    try:
        got = call()
        return got, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_nearest_holds_a_tile_and_not_all_products():
    """A batch of 10,000 rows against 3,000 queries had 240 MB of products, several times over."""
    rng = np.random.default_rng(3)
    x, asked = rng.normal(size=(10_000, 8)).astype(np.float32), rng.normal(size=(3_000, 8))
    frames = [arrow(x[:6000]), arrow(x[6000:], 6000)]
    (q, score, own), mb = peak_mb(lambda: vectors.nearest(frames, asked, 5, "vec_id", "embedding"))
    assert mb < 120
    assert (np.bincount(q) == 5).all()
    for k in range(0, 3000, 250):
        want = np.argsort(-np.round(x.astype(float) @ asked[k], 5), kind="stable")[:5]
        assert own[q == k].tolist() == want.tolist() and (np.diff(score[q == k]) <= 0).all()


def test_guesses_hold_a_tile_and_are_the_best_of_the_probed_cells():
    rng = np.random.default_rng(4)
    x, asked = rng.normal(size=(6_000, 8)).astype(np.float32), rng.normal(size=(2_000, 8))
    model = vectors.IvfPq(rng.normal(size=(4, 8)), rng.normal(size=(2, 16, 4)))
    cell, codes = rng.integers(0, 4, 6000).astype(np.int32), rng.integers(0, 16, (6000, 2)).astype(np.int32)
    frame = arrow(x, cell=cell, codes=pa.array(list(codes), pa.list_(pa.int32())))
    (q, guess, own, score), mb = peak_mb(lambda: model.guessed([frame], asked, 10, 2, "embedding", "vec_id"))
    assert mb < 120 and (np.bincount(q) == 10).all()
    meant = model.centres[cell] + np.concatenate([model.books[s][codes[:, s]] for s in range(2)], 1)
    for k in range(0, 2000, 200):
        probed = ((model.centres - asked[k]) ** 2).sum(1).argsort()[:2]
        want = np.where(np.isin(cell, probed), meant @ asked[k], -np.inf)
        assert sorted(guess[q == k]) == pytest.approx(sorted(np.sort(want)[-10:]))
        assert score[q == k] == pytest.approx(np.round(x[own[q == k]].astype(float) @ asked[k], 5))


def test_best_keeps_ties_by_key_over_many_tiles():
    best = vectors.Best(2, 3)
    for k in range(200):
        s = np.array([[1.0, np.nan if k == 7 else 0.5, float(k % 3)], [-1.0, -1.0, -1.0]])
        i, j = best.candidates(np.arange(2), s)
        best.add(i, s[i, j], 600 - 3 * k - j)
        if k % 50 == 9:
            best.settle()
    q, score, key = best.settle()
    assert key[q == 0].tolist()[0] == 600 - 3 * 7 - 1 and np.isnan(score[0]) and score[1:3].tolist() == [2.0, 2.0]
    assert key[q == 0].tolist()[1:] == sorted(600 - 3 * k - 2 for k in range(200) if k % 3 == 2)[:2]
    assert key[q == 1].tolist() == sorted(600 - 3 * k - j for k in range(200) for j in range(3))[:3]


def test_search_is_dealt_by_its_work_and_not_by_files(spark):
    """One file gave one task, whatever it was searched for."""
    rows = spark.createDataFrame([(k, [float(k % 7), 1.0]) for k in range(4000)], "vec_id long, embedding array<float>").coalesce(1)
    asked = rows.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    assert vectors.dealt(rows, "vec_id", 2000, 1).rdd.getNumPartitions() == 7
    assert vectors.similarity_matrix(asked.withColumnsRenamed({"qid": "vec_id", "query": "embedding"}), every=rows).rdd.getNumPartitions() == 7
    assert vectors.dealt(rows, "vec_id", 1 << 32, 16).rdd.getNumPartitions() == 4000


def test_similarity_matrix_of_odd_vectors(spark):
    odd = [(1, [3.0, 4.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, []), (6, [1.0, 2.0, 3.0]), (7, [-4.0, 3.0]), (None, [1.0, 0.0])]
    rows = spark.createDataFrame(odd, "vec_id long, embedding array<float>")
    a, b = rows.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va")), rows.select(F.col("vec_id").alias("b"), F.col("embedding").alias("vb"))
    want = a.crossJoin(b).select("a", "b", F.round(vectors.cosine("va", "vb"), 5).alias("score"))
    tell = lambda df: sorted(map(repr, map(tuple, df.collect())))
    got = vectors.similarity_matrix(rows, every=rows)
    assert tell(got) == tell(want) and got.count() == 64
    assert tell(vectors.similarity_matrix(rows, every=rows, most_queries=3)) == tell(want)
    assert vectors.similarity_matrix(rows.limit(0), every=rows).count() == 0


@pytest.fixture
def texts(spark, tmp_path):
    """Documents in one file of some 0.4 MB, and their tokens."""
    rng = np.random.default_rng(6)
    words = [f"w{int(x)}" for x in rng.zipf(1.3, 120_000) % 100_000]
    rows = [(k, " ".join(words[k * 60 : k * 60 + 60])) for k in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs")), {k: t.split() for k, t in rows}


def shares(df, monkeypatch, mb):
    monkeypatch.setattr(ix, "MB_EACH", mb)
    return df().rdd.getNumPartitions()


def test_terms_are_shared_by_more_tasks_where_the_files_are_larger(texts, monkeypatch):
    """Partitions were joined to as many as there are cores, so that each held a share of the whole input."""
    docs, _ = texts
    mb = file_bytes(docs) / 1e6
    for make in (ix.term_frequencies, ix.positions, lambda d: ix.postings(ix.term_frequencies(d)), lambda d: compression.gaps(compression.numbered_postings(d)), lambda d: compression.lists(compression.numbered_postings(d))):
        assert shares(lambda: make(docs), monkeypatch, mb) >= 8  # noqa: B023
        assert 2 * 40 >= shares(lambda: make(docs), monkeypatch, mb / 40) >= 40  # noqa: B023
    assert file_bytes(docs.alias("a").join(docs.alias("b"), "doc_id")) == 2 * file_bytes(docs)
    assert ix.parts(docs.sparkSession.createDataFrame([(1, "a")], "doc_id long, text string")) is None


def test_shared_terms_give_the_same_index(texts, monkeypatch, tmp_path):
    docs, tokens = texts
    monkeypatch.setattr(ix, "MB_EACH", file_bytes(docs) / 1e6 / 20)
    own = ix.Index.build(docs, str(tmp_path / "index"))
    assert {r.doc_id: r.tf for r in own.lookup("w1").collect()} == {k: t.count("w1") for k, t in tokens.items() if "w1" in t}
    assert {r.doc_id: r.dl for r in own.lengths.collect()} == {k: len(t) for k, t in tokens.items()}
    want = {}
    for k, t in tokens.items():
        for w in set(t):
            want.setdefault(w, []).append(k)
    postings = compression.numbered_postings(docs)
    got = {}
    for r in compression.gaps(postings, span=64).collect():
        got.setdefault(r.term, []).append((r.n, r.gap))
    assert {w: [n for n, _ in sorted(v)] for w, v in got.items()} == want
    assert all(np.cumsum([g for _, g in sorted(v)]).tolist() == want[w] for w, v in got.items())
    packed = compression.decompress(compression.compress(compression.lists(postings)), "back")
    assert packed.filter("docs = back").count() == packed.count() == len(want)
    want = ranking.top_k(ranking.tfidf(docs, {"q": "w1 w17 w99"}), 10).collect()
    monkeypatch.setattr(ix, "MB_EACH", 4)
    assert ranking.top_k(ranking.tfidf(docs, {"q": "w1 w17 w99"}), 10).collect() == want


def test_runs_and_signatures_are_of_whole_sets():
    rng = np.random.default_rng(2)
    lists = [rng.integers(0, 9, n).astype(np.uint64) for n in (0, 3, 5, 40, 4, 0, 1, 200)]
    row, value = near_duplicates.shingled(np.concatenate(lists), np.cumsum([0, *map(len, lists)]), 5)
    runs = [{tuple(v[k : k + 5]) for k in range(max(len(v) - 4, 1))} if len(v) else set() for v in lists]
    assert np.bincount(row, minlength=8).tolist() == [len(r) for r in runs]
    assert len(set(value.tolist())) == len(set().union(*runs))  # equal runs of two rows have one hash
    flat, offsets = value.view(np.uint64), np.cumsum([0, *(len(r) for r in runs if r)])
    keys = near_duplicates.band_keys(flat, offsets, 4, 2)
    assert keys.shape == (6, 4)
    assert all((near_duplicates.band_keys(flat[a:b], np.array([0, b - a]), 4, 2) == k).all() for a, b, k in zip(offsets, offsets[1:], keys, strict=False))


def test_stretches_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(near_duplicates, "STRETCH", 50)
    lists = [[k] * n for k, n in enumerate((0, 20, 30, 1, 120, 0, 0, 49, 2))]
    frame = pa.RecordBatch.from_pydict({"t": pa.array(lists, pa.list_(pa.int64()))}).slice(1)
    got = list(near_duplicates.stretches([frame], "t"))
    assert [flat[a:b].tolist() for _, flat, at in got for a, b in zip(at, at[1:], strict=False)] == lists[1:]
    assert all(len(flat) <= 50 or f.num_rows == 1 for f, flat, _ in got)


def test_similar_pairs_read_texts_once_and_join_only_what_meets(spark, texts, monkeypatch):
    """Texts were tokenised four times, and all sets were shuffled for the pairs."""
    docs, tokens = texts
    made = []
    monkeypatch.setattr(near_duplicates, "materialise", lambda df, name, real=near_duplicates.materialise: made.append((name, real(df, name))) or made[-1][1])
    twin = spark.createDataFrame([(5000, " ".join(tokens[7])), (5001, " ".join(["new", *tokens[8]])), (5001, " ".join(["new", *tokens[8]]))], "doc_id long, text string")
    both = docs.unionByName(twin)
    for pairs in (None, near_duplicates.exact_pairs):
        made.clear()
        got = {(r.a, r.b) for r in near_duplicates.linked_documents(both, pairs=pairs).collect()}
        assert got == {(7, 5000), (8, 5001)}
        sizes = {name: df.count() for name, df in made}
        assert [name for name, _ in made].count("shingles") == 1 and sizes["paired-sets"] == 2 and sizes["shingles"] == 2003
    plan = near_duplicates.linked_documents(both)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan


def test_records_are_embedded_and_indexed_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """One file of short names gave one task, which then held and sorted all vectors."""
    rows = spark.createDataFrame([(k, f"name {k % 97} of {k}") for k in range(3000)], "id long, name string").coalesce(1)
    assert vectors.parts_of_vectors(rows, 384, 0.5) == 10
    assert vectors.parts_of_vectors(rows, 384, 5000) == 4  # no more than a task for 1,000 rows
    monkeypatch.setattr(vectors, "parts_of_vectors", lambda df, size, real=vectors.parts_of_vectors: real(df, size, 0.5))
    engine = vectors.SemanticSearch(rows).build(str(tmp_path / "s"), index=True)
    assert len(list((tmp_path / "s/vectors").glob("*.parquet"))) == 10
    assert len({f.name.split("-")[1] for f in (tmp_path / "s/cells").glob("*/*.parquet")}) == 10
    assert engine.search("name 11 of 11", 3).first().id == 11


def test_the_sample_is_the_rows_of_the_lowest_hashes(spark):
    rows = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(500)], "vec_id long, embedding array<float>")
    want = [r.embedding for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(40).collect()]
    seen = []
    real, vectors.kmeans = vectors.kmeans, lambda x, *a, **b: seen.append(x.tolist()) or real(x, *a, **b)
    try:
        vectors.IvfPq.fit(rows, sample=40)
    finally:
        vectors.kmeans = real
    assert seen[0] == want
