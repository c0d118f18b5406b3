"""Hands this package to the executors' Python workers, once per Spark context."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Also makes Arrow batches smaller, where their size is Spark's default. Workers may run in another folder or on another machine; they import the package from a zip that Spark sends them."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH, "10000") == "10000":  # Spark's default; a batch of texts takes its size several times in a worker
        spark.conf.set(BATCH, "1000")
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="quillmere-")) / "quillmere.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)
