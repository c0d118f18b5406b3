"""Operators as stages of a corpus pipeline: (spark, docs, sf_dir) -> DataFrame.

All but the last give back the columns of docs. Each works on every row that it gets. Null texts: the quality rules
reject them (no words). Null doc_ids stay. Rows with equal doc_ids are documents of their own; of equal rows near-dedup keeps one.
Very long texts: read whole, one at a time. Empty tables: no rows. Further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm import byte_bpe, decontaminate, near_copies, pii, quality
from quillmere.llm.batches import id_text
from quillmere.llm.rewrite import rewrite_texts


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose content lines hold enough of their words."""
    weights, step = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def decide():
        return lambda t: (bool(t) and quality.judge(t, weights, step, quality.CONTENT_SHARE)[6], t)

    return rewrite_texts(docs, decide)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that five-word shingles link at similarity 0.8 or more (pairs by SimHash fingerprints under covering
    masks, and beyond their radius by MinHash bands): the one with the group's smallest doc_id (of several such, that of the smallest text hash)."""
    groups = near_copies.groups(docs, F.xxhash64("text"))
    chosen = groups.groupBy("group").agg(F.min(F.struct("doc_id", "extra")).alias("one")).select(F.col("one.doc_id").alias("_id"), F.col("one.extra").alias("_hash")).distinct()
    on = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash"))
    kept = docs.withColumns({"_own": F.col("doc_id").cast("long"), "_text": F.xxhash64("text")}).join(chosen, on, "left_semi")
    return kept.dropDuplicates(["_own", "_text"]).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold most of an item, or windows of several; windows of an item elsewhere are cut out."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    held = spark.sparkContext.broadcast(pii.Model())

    def decide():
        model = held.value

        def judge(text):
            if not text:
                return True, text
            base, more = pii.find(text, model)
            spans = [(k, a, b) for k, v in base.items() for a, b in v] + more
            return True, pii.redacted(text, spans) if spans else text

        return judge

    return rewrite_texts(docs, decide)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the hashes of ids and decoded bytes."""
    import public_tokenizers as p

    path = p.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.decode_digest(byte_bpe.encode(id_text(docs), path, p.PATTERN), path, p.PATTERN, keep_ids=True)
