"""Streams of text lines and events: counts, incremental term frequencies, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.operators.index import term_frequencies
from quillmere.sources.scratch import scratch_path


def tail(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Lines that are appended as files in a folder."""
    reader = spark.readStream.format("text")
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def event_stream(spark: SparkSession, path: str, schema, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)


def counts_by(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, n): counts in event-time windows; rows over `late` behind the newest are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user, start, end, n): runs of events without a longer gap."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), user).agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def maintain_index(stream: DataFrame, path: str, checkpoint: str):
    """Keep term frequencies of a document stream (doc_id, text) up to date: each batch is a folder named by its number, so a
    batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        term_frequencies(batch).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and give its result table, which is written to the shared folder: each complete result replaces the one
    before; in other modes each batch is a folder named by its number, so that one that is run again replaces itself."""
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
