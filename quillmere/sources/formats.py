"""Readers and writers of text folders, records and judgements."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from quillmere.sources.ship import ship

#: Fixed format: the fields of a packed record.
RECORD = np.dtype([("number", ">i4"), ("amount", ">f4"), ("name", "S8")])


def text_folder(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(doc_id, text): one document per file, its name without ".txt" the id. A byte-order mark stays in the text."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=glob)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]*?)(?:\.txt)?$", 1).alias("doc_id"), F.col("value").alias("text"))


def topic_folder(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, topic, title, text): the first line is "topic: name", the second the title. The topic line stays in the text."""
    lines = F.split("text", "\n")
    topic = F.btrim(F.regexp_extract(F.get(lines, F.lit(0)), r"^[^:]*:(.*)$", 1))
    return text_folder(spark, path).select("doc_id", topic.alias("topic"), F.get(lines, F.lit(1)).alias("title"), "text")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """With a header; quoted commas and line ends; all columns are strings."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"')


def flat(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON strings, as CSV needs them."""
    return rows.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else F.col(f.name) for f in rows.schema.fields])


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    flat(rows.select(*(columns or rows.columns))).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_ndjson(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path, ignoreNullFields=False)


def read_ndjson(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Blank lines are skipped."""
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path)


def write_json_array(rows: DataFrame, path: str) -> None:
    """JSON, indented by 2: each file of the folder is an array of its partition's rows, written line by line by its task."""

    def lines(frames):
        first = True
        for f in frames:
            out = []
            for row in f["value"]:
                text = json.dumps(json.loads(row), indent=2, ensure_ascii=False)
                out += ["[" if first else ",", *("  " + line for line in text.split("\n"))]
                first = False
            yield pd.DataFrame({"value": out}, dtype=object)
        yield pd.DataFrame({"value": ["[]" if first else "]"]})

    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).mapInPandas(lines, "value string").write.mode("overwrite").option("maxRecordsPerFile", 0).text(path)


def read_json_array(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path, multiLine=True)


#: Pickled records are bound to a language and unsafe to load; Parquet takes their place as the typed binary form.
FORMATS = {"csv": (read_csv, write_csv), "json": (read_json_array, write_json_array), "ndjson": (read_ndjson, write_ndjson), "parquet": (lambda s, p: s.read.parquet(p), lambda r, p: r.write.mode("overwrite").parquet(p))}


def load_any(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    return FORMATS[fmt][0](spark, path)


def save_all(rows: DataFrame, path: str) -> dict[str, int]:
    """Write every format under path; bytes of each."""
    spark = rows.sparkSession
    out = {}
    for fmt, (_, write) in FORMATS.items():
        write(rows, f"{path}/{fmt}")
        out[fmt] = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path}/{fmt}").select("length").filter("length > 0").agg(F.sum("length")).first()[0]
    return out


def append_log(rows: DataFrame, path: str) -> None:
    """Append lines to a log folder; each call is flushed whole."""
    rows.select("value").write.mode("append").text(path)


class Log:
    """A log of lines that a driver writes: every `every` lines (and close()) are flushed as one numbered file, which readers and streams see whole.
    With every <= 0 only close() flushes. Files of earlier logs in the folder are kept."""

    def __init__(self, spark: SparkSession, path: str, every: int = 1):
        self.spark, self.path, self.every, self.held, self.written = spark, path.rstrip("/"), every, [], 0
        self.flushed = _batches(spark, self.path)

    def write(self, line: str) -> None:
        self.held.append(line)
        self.written += 1
        if self.every > 0 and len(self.held) >= self.every:
            self.flush()

    def flush(self) -> None:
        if self.held:
            rows = self.spark.createDataFrame([(line,) for line in self.held], "value string").coalesce(1)
            rows.write.mode("overwrite").text(f"{self.path}/batch={self.flushed:09d}")
            self.flushed, self.held = self.flushed + 1, []

    def close(self) -> int:
        """How many lines were written."""
        self.flush()
        return self.written


def _batches(spark: SparkSession, path: str) -> int:
    """How many numbered files a log has."""
    glob = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*")
    found = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob)
    return max((int(f.getPath().getName().split("=")[1]) for f in found), default=-1) + 1


def tail_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(batch, at, value): the last n lines that a Log has flushed. Files are read from the end until they hold n lines."""
    first = top = _batches(spark, path)
    if not top:
        return spark.createDataFrame([], "batch bigint, at bigint, value string")
    lines = spark.read.schema("value string, batch bigint").option("basePath", path).text(path)
    held = 0
    while first and held < n:
        step = max(1, top - first)  # twice as many files each time
        first = max(0, first - step)
        held = lines.filter(F.col("batch") >= first).count()
    own = lines.filter(F.col("batch") >= first).select("batch", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    last = own.orderBy(F.desc("batch"), F.desc("block"), F.desc("place")).limit(n)
    return last.select("batch", F.row_number().over(Window.orderBy("batch", "block", "place")).cast("bigint").alias("at"), "value")  # n rows


def pack_records(rows: DataFrame, number: str, amount: str, name: str) -> DataFrame:
    """(record): 16 bytes a row, in network byte order: a 32-bit integer, a 32-bit float and 8 bytes of UTF-8 text, cut or filled up with zero bytes. A null is 0 or empty."""

    @F.pandas_udf("binary")
    def packed(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        out = np.zeros(len(a), RECORD)
        out["number"], out["amount"] = a.to_numpy(np.int64), b.to_numpy(np.float64)
        out["name"] = [t.encode()[:8] for t in c]
        return pd.Series([r.tobytes() for r in out], dtype=object)

    ship(rows.sparkSession)
    given = [F.coalesce(F.col(number).cast("int"), F.lit(0)), F.coalesce(F.col(amount).cast("double"), F.lit(0.0)), F.coalesce(F.col(name), F.lit(""))]
    return rows.select(packed(*given).alias("record"))


def unpack_records(packed: DataFrame) -> DataFrame:
    """(number, amount, name) of pack_records(); zero bytes at the name's end are dropped, as is a character that was cut."""

    def read(frames):
        for f in frames:
            own = np.frombuffer(b"".join(f["record"]), RECORD)
            yield pd.DataFrame({"number": own["number"].astype(np.int32), "amount": own["amount"].astype(np.float32), "name": [t.decode("utf-8", "ignore") for t in own["name"].tolist()]})

    ship(packed.sparkSession)
    return packed.select("record").mapInPandas(read, "number int, amount float, name string")


def products(spark: SparkSession, path: str) -> DataFrame:
    """Product records with the sentence that is embedded for them."""
    return spark.read.json(path, multiLine=True).withColumn("sentence", F.concat(F.col("name"), F.lit(". "), F.col("description")))


def qrels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((qid, query, topic), (qid, doc_id, grade)) of a judgement file {qid: {query, topic, relevant: {doc_id: grade}}}."""
    kind = "map<string,struct<query:string,topic:string,relevant:map<string,int>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("qid", "j"))
    return rows.select("qid", "j.query", "j.topic"), rows.select("qid", F.explode("j.relevant").alias("doc_id", "grade"))
