"""Ranking quality. A run is (qid, doc_id, rank from 1); judgements are (qid, doc_id, grade), relevant if over 0."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def judged_run(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run with grades (unjudged: 0), of queries with a relevant document."""
    known = qrels.filter("grade > 0").select("qid").distinct()
    return run.join(F.broadcast(known), "qid", "left_semi").join(qrels, ["qid", "doc_id"], "left").select("qid", "rank", "doc_id", F.coalesce("grade", F.lit(0)).alias("grade"))


def per_query(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(qid, p_at_k, r_at_k, f1_at_k, r_precision, rr, ap, ndcg): one grouped pass over the run and one over the judgements.
    Precision divides by what is there, up to k; recall and AP by all relevant documents; the ideal of NDCG is over all judged ones. A judged query
    that the run lacks scores 0."""
    w = Window.partitionBy("qid").orderBy("rank")
    rows = judged_run(run, qrels).withColumns({"rel": (F.col("grade") > 0).cast("int"), "hits": F.sum((F.col("grade") > 0).cast("int")).over(w)})
    ideal = qrels.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "doc_id")))
    gain = lambda g, p: (F.pow(F.lit(2.0), g) - 1) / F.log2(p + 1)
    of = ideal.groupBy("qid").agg(F.sum((F.col("grade") > 0).cast("int")).alias("n_rel"), F.sum(F.when(F.col("place") <= k, gain(F.col("grade"), F.col("place")))).alias("idcg")).filter("n_rel > 0")
    both = of.join(rows, "qid", "left")
    at = lambda cond: F.sum(F.when(cond, F.col("rel")))
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    m = both.groupBy("qid", "n_rel", "idcg").agg(
        over(at(F.col("rank") <= k), F.count(F.when(F.col("rank") <= k, 1))).alias("p_at_k"),
        over(at(F.col("rank") <= k), F.first("n_rel")).alias("r_at_k"),
        over(at(F.col("rank") <= F.col("n_rel")), F.count(F.when(F.col("rank") <= F.col("n_rel"), 1))).alias("r_precision"),
        over(F.lit(1.0), F.min(F.when(F.col("rel") > 0, F.col("rank")))).alias("rr"),
        over(F.sum(F.when(F.col("rel") > 0, F.col("hits") / F.col("rank"))), F.first("n_rel")).alias("ap"),
        F.coalesce(F.sum(F.when(F.col("rank") <= k, gain(F.col("grade"), F.col("rank")))), F.lit(0.0)).alias("dcg"),
    )
    f1 = over(2 * F.col("p_at_k") * F.col("r_at_k"), F.col("p_at_k") + F.col("r_at_k"))
    return m.select("qid", "p_at_k", "r_at_k", f1.alias("f1_at_k"), "r_precision", "rr", "ap", over(F.col("dcg"), F.col("idcg")).alias("ndcg"))


METRICS = ("p_at_k", "r_at_k", "r_precision", "rr", "ap", "ndcg")


def evaluate(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """One row of means over the judged queries; 0.0 where there are none."""
    return per_query(run, qrels, k).agg(F.count("*").alias("n_queries"), *[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS])


def compare(runs: dict[str, DataFrame], qrels: DataFrame, k: int = 10) -> DataFrame:
    """A row of means for each ranker."""
    out = None
    for name, run in runs.items():
        row = evaluate(run, qrels, k).select(F.lit(name).alias("ranker"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def synthetic_qrels(docs: DataFrame, queries: dict[str, tuple[str, str]], topic: str = "topic", text: str = "text") -> DataFrame:
    """(qid, doc_id, grade) from {qid: (query, topic)}: of a topic's documents those with two query words or more, as substrings, get 2, the others 1."""
    spark = docs.sparkSession
    asked = F.broadcast(spark.createDataFrame([(q, t, s.lower().split()) for q, (s, t) in queries.items()], "qid string, want string, words array<string>").coalesce(1))
    low = docs.select("doc_id", F.col(topic).alias("want"), F.lower(text).alias("low"))
    n = F.size(F.filter("words", lambda w: F.contains(F.col("low"), w)))
    return low.join(asked, "want").select("qid", "doc_id", F.when(n >= 2, 2).otherwise(1).alias("grade"))


def timing_stats(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, least, most, mean, median) of measured times; nulls are left out."""
    own = rows.filter(F.col(value).isNotNull()).groupBy(by)
    return own.agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.median(value).alias("median"))


def stopwatch(spark: SparkSession, stages: Mapping[str, Callable[[], object]], repeats: int = 5) -> DataFrame:
    """(stage, run, ms): each stage is called `repeats` times, after a first call that is not counted; what it returns is run whole if it is a DataFrame."""

    def once(f) -> float:
        began = perf_counter()
        made = f()
        if isinstance(made, DataFrame):
            made.write.format("noop").mode("overwrite").save()
        return (perf_counter() - began) * 1000

    rows = []
    for name, f in stages.items():
        once(f)
        rows += [(name, k, once(f)) for k in range(repeats)]
    return spark.createDataFrame(rows, "stage string, run int, ms double")


def click_log(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "hour") -> DataFrame:
    """(start, views, clicks, rate) of a log of views and clicks, by hour (or another unit); the rate is null without views."""
    n = lambda k: F.count_if(F.col(kind) == k)
    own = events.groupBy(F.date_trunc(width, F.col(time)).alias("start")).agg(n("view").alias("views"), n("click").alias("clicks"))
    return own.withColumn("rate", F.try_divide(F.col("clicks"), F.col("views")))
