"""Filters and rewrites of whole document tables: all columns pass through, text and n_chars change with the text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DataType

from quillmere.llm.batches import release
from quillmere.sources.ship import ship


def rewrite_texts(docs: DataFrame, decide: Callable[[], Callable[[str | None], tuple[bool, str | None]]]) -> DataFrame:
    """decide() is called once per task and gives a function of a text: whether the row stays, and its new text. The columns
    and their order stay as they are; n_chars, where there is one of a whole-number type, is set to the new length in code points."""
    ship(docs.sparkSession)
    names = docs.columns
    at = names.index("text")
    size = next((k for k, f in enumerate(docs.schema.fields) if f.name == "n_chars" and whole_number(f.dataType)), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = decide()
        for b in batches:
            old = b.column(at).to_pylist()
            new = [judge(t) for t in old]
            columns = list(b.columns)
            if any(n is not o for (_, n), o in zip(new, old, strict=True)):
                columns[at] = pa.array([n for _, n in new], b.column(at).type)
                if size is not None:
                    lengths = b.column(size).to_pylist()
                    columns[size] = pa.array([k if n is o else len(n) for (_, n), o, k in zip(new, old, lengths, strict=True)], b.column(size).type)
            kept = pa.RecordBatch.from_arrays(columns, schema=b.schema).filter(pa.array([k for k, _ in new], pa.bool_()))
            if kept.num_rows:
                yield kept
        release()

    return docs.mapInArrow(run, docs.schema)


def whole_number(kind: DataType) -> bool:
    return kind.typeName() in ("byte", "short", "integer", "long")
