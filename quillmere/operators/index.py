"""The inverted index: long tables of term frequencies, and statistics over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions.analyzers import plain
from quillmere.sources.scratch import file_bytes

#: MB of documents' files whose terms one task counts, numbers or sorts; it holds some 15 to 40 times that.
MB_EACH = 4


def tokenised(docs: DataFrame, text: str = "text", analyzer=plain) -> DataFrame:
    """doc_id, tokens."""
    return docs.select("doc_id", analyzer(text).alias("tokens"))


def parts(docs: DataFrame, least: int = 8) -> int | None:
    """How many tasks share the terms of docs: their number grows with the files, so that none holds more. None where the size isn't known."""
    size = file_bytes(docs)
    return None if size is None else max(least, int(size / (MB_EACH * 1e6)) + 1)


def dealt(rows: DataFrame, n: int | None, *columns: str) -> DataFrame:
    """rows in n parts by columns, which Spark then doesn't join to larger ones; where n is None, in as many as Spark takes."""
    return rows.repartition(*columns) if n is None else rows.repartition(n, *columns)


def by_document(docs: DataFrame) -> DataFrame:
    """docs dealt by doc_id, the key of a document: what is then counted for documents and terms needs no further shuffle, and texts are smaller than the
    counts of their terms."""
    return dealt(docs.select("doc_id", "text"), parts(docs), "doc_id")


def term_frequencies(docs: DataFrame, terms: list[str] | None = None, analyzer=plain) -> DataFrame:
    """(term, doc_id, tf). With terms, other tokens are dropped before the shuffle, which then is one of counts; without, texts are shuffled and not counts."""
    tokens = analyzer("text")
    if terms is not None:
        tokens = F.filter(tokens, lambda t: t.isin(*terms) if terms else F.lit(False))
    rows = docs if terms is not None else by_document(docs)
    return rows.select("doc_id", F.explode(tokens).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def positions(docs: DataFrame, analyzer=plain) -> DataFrame:
    """(term, doc_id, positions): sorted places from 0."""
    rows = by_document(docs).select("doc_id", F.posexplode(analyzer("text")).alias("at", "term"))
    return rows.groupBy("term", "doc_id").agg(F.array_sort(F.collect_list("at")).alias("positions"))


def postings(tf: DataFrame) -> DataFrame:
    """(term, doc_ids): the nested view, sorted. A list grows with its term's documents: for export, not for queries."""
    return dealt(tf, parts(tf), "term").groupBy("term").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))


def postings_tf(tf: DataFrame) -> DataFrame:
    """(term, {doc_id: tf}): the nested view with frequencies."""
    return dealt(tf, parts(tf), "term").groupBy("term").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("doc_id", "tf")))).alias("postings"))


def term_stats(tf: DataFrame) -> DataFrame:
    """(term, df, cf)."""
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def doc_lengths(docs: DataFrame, analyzer=plain) -> DataFrame:
    """(doc_id, dl); empty documents have 0."""
    return docs.select("doc_id", F.size(analyzer("text")).cast("bigint").alias("dl"))


def collection_stats(lengths: DataFrame) -> DataFrame:
    """One row: n documents (empty ones count), total tokens, avgdl (0.0 without documents)."""
    total = F.coalesce(F.sum("dl"), F.lit(0))
    return lengths.agg(F.count("*").alias("n"), total.alias("total"), F.when(F.count("*") > 0, total / F.count("*")).otherwise(0.0).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    """ln(1 + (n - df + 0.5) / (df + 0.5)): never negative."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


@dataclass
class Index:
    """Built once, then read: tf sorted by term within files (min-max statistics skip the rest), statistics beside it."""

    tf: DataFrame
    terms: DataFrame
    lengths: DataFrame
    stats: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, path: str, analyzer=plain) -> Index:
        """Write all tables under path, the terms' from the written tf. Lengths are of the texts: a second pass over them moves less than their tf by document."""
        spark, n = docs.sparkSession, parts(docs)
        term_frequencies(docs, analyzer=analyzer).repartitionByRange(*([] if n is None else [n]), "term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/tf")
        tf = spark.read.parquet(f"{path}/tf")
        term_stats(tf).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        doc_lengths(docs, analyzer).groupBy("doc_id").agg(F.sum("dl").alias("dl")).write.mode("overwrite").parquet(f"{path}/lengths")
        collection_stats(spark.read.parquet(f"{path}/lengths")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in ("tf", "terms", "lengths", "stats")))

    def lookup(self, term: str) -> DataFrame:
        """(doc_id, tf) of a term; no rows for an unknown one. The filter is pushed to the scan."""
        return self.tf.filter(F.col("term") == term).select("doc_id", "tf")
