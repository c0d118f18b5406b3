"""Hand-computed values of the retrieval operators on small corpora."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmere.functions.analyzers import keep_parentheses, keyword, plain, standard, tokens_of
from quillmere.operators import boolean, evaluation, fusion, ranking, text_stats
from quillmere.operators import index as ix

MINI = [(1, "Sauce with basil. The sauce is red!"), (2, "Bread, (warm) bread and butter"), (3, "A quiet search engine"), (4, ""), (5, None), (6, "... !!")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(MINI, "doc_id long, text string").cache()


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "text string").select(f("text").alias("t")).first().t


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_analyzers(spark):
    assert one(spark, "The (cat)'s  BAT -- ok. x　y", plain) == ["the", "cat)'s", "bat", "--", "ok", "x", "y"]
    assert one(spark, "a\x1cb (c)", plain) == ["a", "b", "c"]
    assert one(spark, "(c) d.", keep_parentheses) == ["(c)", "d"]
    assert one(spark, "Don't stop-me now_x 3.5", standard) == ["don't", "stop-me", "now", "x", "3", "5"]
    assert one(spark, "As Is", keyword) == ["As Is"]
    assert one(spark, None, plain) == []


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="aB .,'()\t\n!é", max_size=30))
def test_plain_is_the_driver_tokenizer(spark, text):
    assert one(spark, text, plain) == tokens_of(text)


def test_counts_and_lines(spark):
    df = spark.createDataFrame([(1, "the cat sat\non the mat again"), (2, ""), (3, None), (4, "a\n")], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_words, r.n_chars) for r in text_stats.count_stats(df).collect()}
    assert got == {1: (2, 7, 28), 2: (0, 0, 0), 3: (0, 0, 0), 4: (1, 1, 2)}
    assert [(r.word, r.n) for r in text_stats.top_words(df, 3).collect()] == [("the", 2), ("cat", 1), ("sat", 1)]
    assert [(r.doc_id, r.line_no, r.line) for r in text_stats.find_lines(df, "mat").collect()] == [(1, 1, "on the mat again")]


def test_index(docs):
    tf = ix.term_frequencies(docs)
    assert {(r.term, r.doc_id): r.tf for r in tf.collect()}["bread", 2] == 2
    stats = ix.collection_stats(ix.doc_lengths(docs)).first()
    assert (stats.n, stats.total, stats.avgdl) == (6, 16, 16 / 6)
    assert {r.term: (r.df, r.cf) for r in ix.term_stats(tf).collect()}["sauce"] == (1, 2)
    assert [r.positions for r in ix.positions(docs).filter("term = 'bread'").collect()] == [[0, 2]]
    assert ix.collection_stats(ix.doc_lengths(docs.limit(0))).first().avgdl == 0.0


def test_index_is_read_back(docs, tmp_path):
    built = ix.Index.build(docs, str(tmp_path / "ix"))
    assert ids(built.lookup("sauce")) == [1]
    assert ids(built.lookup("absent")) == []
    assert {r.doc_id: r.dl for r in built.lengths.collect()} == {1: 7, 2: 5, 3: 4, 4: 0, 5: 0, 6: 0}


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("sauce AND NOT bread", [1]),
        ("NOT sauce", [2, 3, 4, 5, 6]),
        ("bread or basil and sauce", [1, 2]),
        ("sauce not basil", []),
        ("", []),
        ("OR bread", [2]),
        ("bread OR", [2]),
        ("NOT AND bread", [2]),
        ("NOT NOT bread", [1, 3, 4, 5, 6]),
        ("bread warm", [2]),
    ],
)
def test_boolean(docs, query, want):
    assert ids(boolean.search(docs, query)) == want
    assert ids(boolean.search_index(ix.term_frequencies(docs), docs, query)) == want


def test_nested_and_phrases(docs):
    assert ids(boolean.search_nested(docs, "(sauce OR bread) AND NOT basil")) == [2]
    assert ids(boolean.search_nested(docs, '"the sauce" OR engine')) == [1, 3]
    assert ids(boolean.search_nested(docs, "NOT (sauce OR bread OR search)")) == [4, 5, 6]
    assert ids(boolean.search_nested(docs, "")) == []


def words(**counts):
    return " ".join(w for w, n in counts.items() for _ in range(n))


@pytest.fixture(scope="module")
def golden(spark):
    pad = lambda text, n: text + " " + " ".join(f"w{k}{n}" for k in range(n - len(text.split())))
    rows = [("a", pad(words(sauce=2, basil=1), 14)), ("b", pad(words(sauce=2), 13)), ("c", pad(words(referee=1), 18))]
    return spark.createDataFrame(rows, "doc_id string, text string").cache()


def test_bm25(golden):
    one = {r.doc_id: r.score for r in ranking.bm25(golden, {"q": "sauce"}).collect()}
    assert one["a"] == pytest.approx(0.6586044, abs=1e-6)
    two = ranking.with_zeros(golden, {"q": "sauce basil"}, ranking.bm25(golden, {"q": "sauce basil"}))
    assert {r.doc_id: round(r.score, 4) for r in two.collect()} == {"a": 1.6669, "b": 0.6714, "c": 0.0}
    twice = {r.doc_id: r.score for r in ranking.bm25(golden, {"q": "sauce sauce"}).collect()}
    assert twice["a"] == pytest.approx(2 * one["a"])


def test_query_likelihood(golden):
    got = {r.qid: {} for r in ranking.query_likelihood(golden, {"s": "sauce", "t": "sauce basil", "none": "!!"}).collect()}
    for r in ranking.query_likelihood(golden, {"s": "sauce", "t": "sauce basil", "none": "!!"}).collect():
        got[r.qid][r.doc_id] = round(r.score, 4)
    assert got["s"]["a"] == pytest.approx(math.log(5.281632653 / 214), abs=1e-4)
    assert got["t"] == {"a": -8.462, "b": -9.2415, "c": -9.7638}
    assert got["none"] == {"a": 0.0, "b": 0.0, "c": 0.0}


def test_tfidf_cosine(spark):
    texts = {"a": "the cat sat", "b": "the dog ran away", "c": "cat dog"}
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {r.doc_id: r.score for r in ranking.tfidf(df, {"q": "cat dog cat"}).collect()}
    n = 3
    df_of = {"the": 2, "cat": 2, "sat": 1, "dog": 2, "ran": 1, "away": 1}
    w = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df_of.items()}
    for i, text in texts.items():
        own = text.split()
        dot = sum(w[t] ** 2 for t in own if t in ("cat", "dog"))
        want = dot / (math.sqrt(sum(w[t] ** 2 for t in own)) * math.sqrt(w["cat"] ** 2 + w["dog"] ** 2))
        assert got[i] == pytest.approx(want)


def test_grid(golden):
    rows = ranking.bm25_grid(golden, "sauce basil", [0.9, 1.2], [0.5, 0.75]).collect()
    assert len(rows) == 4 and all(0 < r.ndcg <= 1 for r in rows)
    assert ranking.bm25_grid(golden, "absent", [1.2], [0.75]).count() == 0


def test_ties_break_by_id(spark):
    df = spark.createDataFrame([("q", k, 1.0) for k in (5, 3, 9)], "qid string, doc_id long, score double")
    assert [(r.doc_id, r.rank) for r in ranking.top_k(df, 2).orderBy("rank").collect()] == [(3, 1), (5, 2)]
    assert ranking.top_k(df, 0).count() == 0


def test_metrics(spark):
    run = spark.createDataFrame([("q", d, k) for k, d in enumerate("abcdefghij", 1)] + [("lost", "z", 1)], "qid string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "c", 2), ("q", "e", 1), ("q", "x", 1), ("q", "a", 0), ("none", "a", 0), ("absent", "a", 1)], "qid string, doc_id string, grade int")
    got = {r.qid: r for r in evaluation.per_query(run, qrels, 10).collect()}
    assert sorted(got) == ["absent", "q"]
    q = got["q"]
    assert (q.p_at_k, q.r_at_k, q.r_precision, q.rr) == pytest.approx((0.2, 2 / 3, 1 / 3, 1 / 3))
    assert q.ap == pytest.approx((1 / 3 + 2 / 5) / 3)
    dcg = 3 / math.log2(4) + 1 / math.log2(6)
    assert q.ndcg == pytest.approx(dcg / (3 / math.log2(2) + 1 / math.log2(3) + 1 / math.log2(4)))
    assert q.f1_at_k == pytest.approx(2 * 0.2 * (2 / 3) / (0.2 + 2 / 3))
    assert (got["absent"].ap, got["absent"].p_at_k) == (0.0, 0.0)
    assert evaluation.evaluate(run, qrels.limit(0)).first().ap == 0.0
    short = spark.createDataFrame([("q", "c", 1)], "qid string, doc_id string, rank int")
    assert evaluation.per_query(short, qrels, 10).filter("qid = 'q'").first().p_at_k == 1.0


def test_synthetic_qrels(spark):
    df = spark.createDataFrame([(1, "food", "red sauce here"), (2, "food", "saucepan and redness"), (3, "food", "nothing"), (4, "sky", "red sauce")], "doc_id long, topic string, text string")
    got = {r.doc_id: r.grade for r in evaluation.synthetic_qrels(df, {"q": ("red sauce", "food")}).collect()}
    assert got == {1: 2, 2: 2, 3: 1}


def test_fusion(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "qid string, doc_id long, rank int")
    b = spark.createDataFrame([("q", 2, 1), ("q", 3, 2)], "qid string, doc_id long, rank int")
    got = [(r.doc_id, r.score) for r in fusion.reciprocal_rank_fusion([a, b]).orderBy("rank").collect()]
    assert got == [(2, round(1 / 62 + 1 / 61, 6)), (1, round(1 / 61, 6)), (3, round(1 / 62, 6))]
    s = spark.createDataFrame([("q", 1, 4.0), ("q", 2, 2.0), ("r", 1, 3.0)], "qid string, doc_id long, score double")
    assert sorted((r.qid, r.doc_id, r.score) for r in fusion.min_max(s).collect()) == [("q", 1, 1.0), ("q", 2, 0.0), ("r", 1, 0.0)]


def test_scan_and_gap(docs):
    assert ids(text_stats.scan_for_term(docs, "sauce")) == [1]
    assert ids(text_stats.scan_for_term(docs, "sauc")) == []
    gap = text_stats.vocabulary_gap(docs, [("soup", "sauce")]).first()
    assert (gap.typed_df, gap.written_df) == (0, 1)


def test_plan_prunes_columns(docs, spark, tmp_path):
    docs.withColumn("zzz", F.lit(1)).write.parquet(str(tmp_path / "d"))
    plan = spark.read.parquet(str(tmp_path / "d"))
    text = ranking.bm25(plan, {"q": "sauce"})._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text and "zzz" not in text.split("Physical Plan")[1]
