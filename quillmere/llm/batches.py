"""Arrow batches of documents in, rows of plain Python values out."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillmere.sources.ship import ship

ROWS_OUT = 4096


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def release() -> None:
    """Give freed memory back to the system: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that clashing extra columns never matter and the scan reads no others."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def schema_of(ddl: str) -> StructType:
    return StructType.fromDDL(ddl) if hasattr(StructType, "fromDDL") else StructType._parse(ddl)


def rows_out(rows: Iterable[tuple], schema: pa.Schema, most_bytes: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Batches of rows, cut by count and by the bytes in their binary values."""
    held: list[tuple] = []
    size = 0
    for r in rows:
        held.append(r)
        size += sum(len(v) for v in r if isinstance(v, (bytes, str)))
        if len(held) >= ROWS_OUT or size >= most_bytes:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def pairs(batch: pa.RecordBatch, binary: bool = True) -> Iterator[tuple]:
    """(doc_id, text) of a batch; text as UTF-8 bytes or str, null as empty."""
    col = batch.column(1)
    if binary:
        col, none = col.cast(pa.binary()), b""
    else:
        none = ""
    for i, t in zip(batch.column(0).to_pylist(), col, strict=True):
        v = t.as_py()
        yield i, none if v is None else v


def map_docs(docs: DataFrame, rows: Callable[[Iterator[tuple]], Iterable[tuple]], ddl: str, binary: bool = True) -> DataFrame:
    """Run rows() over the (doc_id, text) of each task's batches; one Python call per task, one text in memory at a time beside its batch."""
    schema = schema_of(ddl)
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows_out(rows(p for b in batches for p in pairs(b, binary)), out)
        release()

    return id_text(docs).mapInArrow(run, schema)
