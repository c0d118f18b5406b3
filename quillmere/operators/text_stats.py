"""Counts over texts: lines, words, characters, frequent words, matching lines, document frequency of probes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.functions.analyzers import SPACE, plain


def count_stats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines (a last one need not end in a line feed), white-space words and code points of each text. Null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    ends = F.size(F.split(t, "\n")) - 1
    lines = ends + F.when((t != "") & ~t.endswith("\n"), 1).otherwise(0)
    words = F.size(F.filter(F.split(t, SPACE), lambda w: w != ""))
    return docs.select(key, lines.cast("bigint").alias("n_lines"), words.cast("bigint").alias("n_words"), F.char_length(t).cast("bigint").alias("n_chars"))


def top_words(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The n most frequent tokens of all texts; ties by first occurrence (in key, then place, order)."""
    words = docs.select(key, F.posexplode(plain(text)).alias("at", "word"))
    return words.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct(key, "at")).alias("first")).orderBy(F.desc("n"), "first").limit(n).select("word", "n")


def find_lines(docs: DataFrame, needle: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines that hold the needle, as it is; stripped; with their number from 0."""
    return (
        docs.filter(F.contains(text, F.lit(needle)))
        .select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
        .filter(F.contains("line", F.lit(needle)))
        .select(key, F.col("line_no").cast("bigint").alias("line_no"), F.regexp_replace("line", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "").alias("line"))
    )


def scan_for_term(docs: DataFrame, term: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keys of texts with the token, without an index. The substring test is cheap and lets most texts skip tokenising."""
    return docs.filter(F.contains(F.lower(text), F.lit(term)) & F.array_contains(plain(text), term)).select(key)


def vocabulary_gap(docs: DataFrame, probes: list[tuple[str, str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(typed, written) pairs with the document frequency of each word, in one pass."""
    spark = docs.sparkSession
    words = sorted({w for p in probes for w in p})
    found = docs.select(F.explode(F.array_intersect(plain(text), F.lit(words))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    asked = spark.createDataFrame(probes, "typed string, written string")
    out = asked.join(found.select(F.col("word").alias("typed"), F.col("df").alias("typed_df")), "typed", "left").join(found.select(F.col("word").alias("written"), F.col("df").alias("written_df")), "written", "left")
    return out.select("typed", "written", F.coalesce("typed_df", F.lit(0)).alias("typed_df"), F.coalesce("written_df", F.lit(0)).alias("written_df"))


def uncovered(needs: DataFrame, offers: DataFrame, on: str) -> DataFrame:
    """What is needed and not offered: a set difference."""
    return needs.select(on).distinct().join(offers.select(on).distinct(), on, "left_anti")
