"""Ranked retrieval: TF-IDF cosine, BM25, query likelihood. A batch of queries is one job; only their terms leave the scan."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.functions.analyzers import plain, tokens_of
from quillmere.operators.index import idf
from quillmere.sources.scratch import materialise

K1, B = 1.2, 0.75
MU, FLOOR = 200.0, 1e-4


def query_terms(docs: DataFrame, queries: Mapping[str, str]) -> DataFrame:
    """(qid, term, qtf) of a batch of query strings."""
    rows = [(q, t, n) for q, text in queries.items() for t, n in Counter(tokens_of(text)).items()]
    return F.broadcast(docs.sparkSession.createDataFrame(rows, "qid string, term string, qtf int").coalesce(1))


def scanned(docs: DataFrame, queries: Mapping[str, str], analyzer=plain) -> DataFrame:
    """doc_id, dl, tfs: each document's length and its (term, tf) of query terms. One pass tokenises every text once, without a shuffle. (What reads it opens
    tfs with outer generators: a filter on tfs, or one that the optimiser infers from an explode, would be pushed below and put the tokeniser into the lambdas.)"""
    terms = sorted({t for q in queries.values() for t in tokens_of(q)})
    tokens = docs.select("doc_id", analyzer("text").alias("tokens"))
    own = F.filter("tokens", lambda t: t.isin(*terms)) if terms else F.array().cast("array<string>")
    counted = tokens.select("doc_id", F.size("tokens").cast("bigint").alias("dl"), own.alias("own"))
    tfs = F.transform(F.array_distinct("own"), lambda t: F.struct(t.alias("term"), F.size(F.filter("own", lambda u: u == t)).alias("tf")))
    return counted.select("doc_id", "dl", tfs.alias("tfs"))


def written(docs: DataFrame, queries: Mapping[str, str], analyzer=plain) -> DataFrame:
    """scanned() as a written table of few columns: rankers that are given it read the texts once between them."""
    return materialise(scanned(docs, queries, analyzer), "scanned")


def statistics(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, df, cf) of the query terms, and one row n, total, avgdl; both small enough to broadcast (by the batch's size)."""
    terms = rows.select(F.inline_outer("tfs")).filter("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    total = F.coalesce(F.sum("dl"), F.lit(0))
    coll = rows.agg(F.count("*").alias("n"), total.alias("total"), F.when(F.count("*") > 0, total / F.count("*")).otherwise(0.0).alias("avgdl"))
    return F.broadcast(terms), F.broadcast(coll)


def bm25_weight(tf: Column, dl: Column, avgdl: Column, k1: Column | float = K1, b: Column | float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def bm25(docs: DataFrame, queries: Mapping[str, str], k1: float = K1, b: float = B, analyzer=plain, rows: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, score) of documents that hold a query term. Repeated query terms count again. rows: what written() gave for these documents and
    queries; without it the texts are scanned for the statistics and again for the hits."""
    rows = scanned(docs, queries, analyzer) if rows is None else rows
    terms, coll = statistics(rows)
    hits = rows.select("doc_id", "dl", F.inline_outer("tfs")).filter("term IS NOT NULL")
    scored = hits.join(query_terms(docs, queries), "term").join(terms, "term").crossJoin(coll)
    part = F.col("qtf") * idf(F.col("n"), F.col("df")) * bm25_weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    return scored.groupBy("qid", "doc_id").agg(F.sum(part).alias("score"))


def with_zeros(docs: DataFrame, queries: Mapping[str, str], scores: DataFrame) -> DataFrame:
    """Every document for every query; 0 where it has no score. Rows out are documents times queries: that is what is asked."""
    qids = F.broadcast(docs.sparkSession.createDataFrame([(q,) for q in queries], "qid string").coalesce(1))
    return docs.select("doc_id").crossJoin(qids).join(scores, ["qid", "doc_id"], "left").select("qid", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def top_k(scores: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(qid, doc_id, score, rank): score rounded, best first, ties by doc_id. Spark keeps k rows of a query per task before it shuffles."""
    rounded = scores.withColumn("score", F.round("score", digits))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return rounded.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def run_bm25(docs: DataFrame, queries: Mapping[str, str], k: int = 100, rows: DataFrame | None = None) -> DataFrame:
    """A BM25 run: the best k of every query's documents, those without a score counted as 0, and of these only the ones over 0."""
    return top_k(bm25(docs, queries, rows=rows), k).filter("score > 0")


def run_tfidf(docs: DataFrame, queries: Mapping[str, str], k: int = 100) -> DataFrame:
    """A TF-IDF run: as tfidf(), but a norm of zero counts as 1."""
    return top_k(tfidf(docs, queries, zero_norm=1.0), k)


def ranked_one(scores: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """top_k of a single query, by a distributed top-k (no window)."""
    return scores.select("doc_id", F.round("score", digits).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def tfidf(docs: DataFrame, queries: Mapping[str, str], analyzer=plain, zero_norm: float | None = None) -> DataFrame:
    """(qid, doc_id, score): cosine of (1 + ln tf) * idf weights. A query has each distinct term once. The norm is over all terms of a
    document, so all tf are needed; scores of 0 or less are dropped. Where a norm is zero the score is 0, or zero_norm stands for the norm."""
    from quillmere.operators.index import dealt, parts, term_frequencies, term_stats

    # the texts are tokenised twice, for the terms' df and for the weights: cheaper than to write every tf and to shuffle it by document again
    tf, n_parts = term_frequencies(docs, analyzer=analyzer), parts(docs)
    df = materialise(term_stats(tf).select("term", "df"), "df")
    n = F.broadcast(docs.agg(F.count("*").alias("n")))
    known = df.crossJoin(n).select("term", idf(F.col("n"), F.col("df")).alias("wq"))
    weights = dealt(tf, n_parts, "term").join(dealt(known, n_parts, "term"), "term").select("term", "doc_id", ((1 + F.log("tf")) * F.col("wq")).alias("w"), "wq")
    asked = query_terms(docs, queries).select("qid", "term")
    terms = sorted({t for q in queries.values() for t in tokens_of(q)})
    is_asked = F.col("term").isin(*terms) if terms else F.lit(False)
    own = F.collect_list(F.when(is_asked, F.struct("term", "w", "wq")))
    per_doc = dealt(weights, n_parts, "doc_id").groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), own.alias("own")).filter(F.size("own") > 0)
    hits = per_doc.select("doc_id", "norm", F.inline("own")).join(asked, "term")
    q_norm = known.filter(is_asked).join(asked, "term").groupBy("qid").agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("q_norm"))
    dots = hits.groupBy("qid", "doc_id", "norm").agg(F.sum(F.col("w") * F.col("wq")).alias("dot"))
    length = lambda c: F.col(c) if zero_norm is None else F.when(F.col(c) == 0, zero_norm).otherwise(F.col(c))
    score = F.coalesce(F.try_divide(F.col("dot"), length("norm") * length("q_norm")), F.lit(0.0))
    return dots.join(F.broadcast(q_norm), "qid").select("qid", "doc_id", score.alias("score")).filter("score > 0")


def query_likelihood(docs: DataFrame, queries: Mapping[str, str], mu: float = MU, floor: float = FLOOR, analyzer=plain, rows: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, score) of every document: Dirichlet-smoothed log likelihood; repeated query terms count again.
    The collection model always smooths with MU, whatever mu is given. A query without terms scores 0.0. rows: as for bm25()."""
    rows = scanned(docs, queries, analyzer) if rows is None else rows
    terms, coll = statistics(rows)
    asked = query_terms(docs, queries).join(terms, "term", "left").crossJoin(coll).select("qid", "term", "qtf", ((F.coalesce("cf", F.lit(0)) + MU * floor) / (F.col("total") + MU)).alias("bg"))
    per_query = asked.groupBy("qid").agg(F.collect_list(F.struct("term", "qtf", "bg")).alias("terms"))  # bounded by the batch
    every = docs.sparkSession.createDataFrame([(q,) for q in queries], "qid string").coalesce(1).join(per_query, "qid", "left")
    tfs = F.map_from_entries("tfs")
    pairs = rows.select("doc_id", "dl", tfs.alias("tfs")).crossJoin(F.broadcast(every))
    one = lambda s, t: s + t.qtf * F.log((F.coalesce(F.try_element_at("tfs", t.term), F.lit(0)) + mu * t.bg) / (F.col("dl") + mu))
    score = F.aggregate(F.coalesce("terms", F.array().cast("array<struct<term:string,qtf:int,bg:double>>")), F.lit(0.0), one)
    return pairs.select("qid", "doc_id", score.alias("score"))


def bm25_grid(docs: DataFrame, query: str, k1s: list[float], bs: list[float], k: int = 10) -> DataFrame:
    """(k1, b, ndcg) of a parameter grid in one job, best first; no rows if no query term is known. A document's grade is the number of distinct
    known query terms in it where that is half of them or more, else 0; the ranking is the top k with a positive score, and its ideal is cut to as many."""
    spark = docs.sparkSession
    rows = written(docs, {"q": query})
    stats, coll = statistics(rows)
    known = F.broadcast(stats.agg(F.count("*").alias("known")))
    hits = rows.filter(F.size("tfs") > 0).select("doc_id", "dl", F.size("tfs").alias("n_terms"), F.inline("tfs"))
    grid = F.broadcast(spark.createDataFrame([(float(a), float(b)) for a in k1s for b in bs], "k1 double, b double").coalesce(1))
    base = hits.join(query_terms(docs, {"q": query}), "term").join(stats, "term").crossJoin(coll).crossJoin(known).crossJoin(grid)
    grade = F.when(F.col("n_terms") * 2 >= F.col("known"), F.col("n_terms")).otherwise(0)
    part = F.col("qtf") * idf(F.col("n"), F.col("df")) * bm25_weight(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("k1"), F.col("b"))
    scores = base.groupBy("k1", "b", "doc_id", grade.alias("grade")).agg(F.round(F.sum(part), 9).alias("score")).filter("score > 0")
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("k1", "b").orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= k)
    judged = rows.select(F.size("tfs").alias("n_terms")).filter("n_terms > 0").crossJoin(known).select(grade.alias("grade")).filter("grade > 0").orderBy(F.desc("grade")).limit(k)
    ideals = judged.agg(F.sort_array(F.collect_list("grade"), asc=False).alias("ideal"))  # k values
    gain = lambda g, p: (F.pow(F.lit(2.0), g) - 1) / F.log2(p + 1)
    dcg = ranked.groupBy("k1", "b").agg(F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"), F.count("*").alias("m")).crossJoin(F.broadcast(ideals))
    best = F.aggregate(F.transform(F.slice("ideal", F.lit(1), F.col("m").cast("int")), lambda g, p: gain(g, p + 1)), F.lit(0.0), lambda s, x: s + x)
    ndcg = F.when(F.size("ideal") == 0, 1.0).when(best > 0, F.col("dcg") / best).otherwise(0.0)
    return dcg.select("k1", "b", F.round(ndcg, 6).alias("ndcg")).orderBy(F.desc("ndcg"), "k1", "b")
