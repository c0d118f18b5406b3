"""Edits of record tables with an explicit place (idx), and bulk actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def update_record(rows: DataFrame, at: int, name: str, value) -> DataFrame:
    """One field of the record at a place."""
    return rows.withColumn(name, F.when(F.col("idx") == at, F.lit(value)).otherwise(F.col(name)))


def delete_records(rows: DataFrame, where: Column) -> DataFrame:
    """Rows for which the predicate isn't true; an unknown one keeps its row."""
    return rows.filter(~F.coalesce(where, F.lit(False)))


def insert_at(rows: DataFrame, at: int, record: dict) -> DataFrame:
    """The record at a place; what stood there or after moves on by one."""
    moved = rows.withColumn("idx", F.when(F.col("idx") >= at, F.col("idx") + 1).otherwise(F.col("idx")))
    kind = dict(rows.dtypes)
    one = rows.sparkSession.range(1).select(*[F.lit(at if c == "idx" else record.get(c)).cast(kind[c]).alias(c) for c in rows.columns])
    return moved.unionByName(one)


def placed_actions(lines: DataFrame, stream: str = "stream", no: str = "line_no", line: str = "line") -> DataFrame:
    """(stream, no, action, id, source) from NDJSON lines of alternating actions and sources; delete has no source. A line is an action if it
    holds one at its top; the source is the line after. Streams (files) are worked on apart."""
    parsed = lines.filter(F.trim(line) != "").withColumn("keys", F.json_object_keys(line))
    first = F.get("keys", F.lit(0))
    w = Window.partitionBy(stream).orderBy(no)
    names = ("index", "create", "update", "delete")
    kind = F.when((F.size("keys") == 1) & first.isin(*names), first)
    marked = parsed.withColumns({"kind": kind, "next": F.lead(line).over(w)})
    # What follows an action that takes a source is a source, even if it looks like an action; a delete, and a line that does not look like one, start anew.
    takes = F.col("kind").isin("index", "create", "update")
    fresh = F.coalesce(~takes, F.lit(True))
    runs = marked.withColumn("run", F.coalesce(F.sum(F.when(fresh, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    turn = runs.withColumn("turn", F.row_number().over(Window.partitionBy(stream, "run").orderBy(no)))
    action = turn.filter(F.col("kind").isNotNull() & (F.col("turn") % 2 == 1))
    of = F.coalesce(*[F.get_json_object(line, f"$.{a}._id") for a in names])
    source = F.when(takes, F.col("next"))
    return action.select(F.col(stream).alias("stream"), F.col(no).alias("no"), F.col("kind").alias("action"), of.alias("id"), F.when(F.col("kind") == "update", F.coalesce(F.get_json_object(source, "$.doc"), source)).otherwise(source).alias("source"))


def bulk_actions(lines: DataFrame, stream: str = "stream", no: str = "line_no", line: str = "line") -> DataFrame:
    """(action, id, source) of the actions in NDJSON lines, as placed_actions() pairs them."""
    return placed_actions(lines, stream, no, line).select("action", "id", "source")


def apply_bulk(rows: DataFrame, lines: DataFrame, key: str = "doc_id", **names: str) -> DataFrame:
    """rows after the bulk lines: index, create and update put the source in place of the whole record of their id, delete takes the record out; the last
    action of an id counts (in order of stream and line). Fields that the source lacks are null; ids that are null do nothing."""
    last = placed_actions(lines, **names).filter("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("action", "source"), F.struct("stream", "no")).alias("a"))
    kind = dict(rows.dtypes)
    others = [c for c in rows.columns if c != key]
    schema = ", ".join(f"`{c}` {kind[c]}" for c in others)
    new = last.filter("a.action <> 'delete'").select(F.col("id").cast(kind[key]).alias(key), F.from_json("a.source", schema).alias("s"))
    kept = rows.join(last.select(F.col("id").cast(kind[key]).alias(key)), key, "left_anti")
    return kept.select(*rows.columns).unionByName(new.select(key, *[F.col(f"s.`{c}`").alias(c) for c in others]))
