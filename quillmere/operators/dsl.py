"""Search bodies (JSON query DSL) compiled to DataFrames of (doc_id, score).

Rulings where a query can be read in several ways: bool.must are all required and add up; should adds, and is required only
without must and filter, or as minimum_should_match says; must_not excludes; filter requires without a score. match looks at its own field,
or at all text fields with all_text. hits.total counts all hits, not the page. sort is applied. knn may stand in the query or beside it.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions.analyzers import ANALYZERS, STOP_WORDS
from quillmere.operators.index import idf
from quillmere.operators.ranking import bm25_weight
from quillmere.operators.vectors import cosine


@dataclass
class SearchIndex:
    """A table with a key and field mappings: text, keyword, knn_vector or numeric. Unmapped fields take part in term, range and exists."""

    docs: DataFrame
    mappings: Mapping[str, str] = field(default_factory=dict)
    key: str = "doc_id"
    all_text: bool = False

    def of_kind(self, kind: str) -> list[str]:
        return [f for f, k in self.mappings.items() if k == kind]

    # --- queries ---

    def run(self, query: Mapping) -> DataFrame:
        """(doc_id, score) of a query clause."""
        kind, spec = next(iter(query.items())) if query else ("match_all", {})
        compiled = getattr(self, f"_{kind}", None)
        if compiled is None:
            raise ValueError(f"unknown query: {kind}")
        return compiled(spec)

    def _hits(self, where: Column) -> DataFrame:
        return self.docs.filter(where).select(F.col(self.key).alias("doc_id"), F.lit(1.0).alias("score"))

    def _match_all(self, spec) -> DataFrame:
        return self._hits(F.lit(True))

    def _ids(self, spec) -> DataFrame:
        return self._hits(F.col(self.key).cast("string").isin([str(v) for v in spec.get("values", [])]))

    def _exists(self, spec) -> DataFrame:
        return self._hits(self._there(spec["field"]))

    def _there(self, name: str) -> Column:
        if name not in self.docs.columns:
            return F.lit(False)
        kind = dict(self.docs.dtypes)[name]
        there = F.col(name).isNotNull()
        if kind == "string":
            there = there & (F.col(name) != "")
        elif kind.startswith(("array", "map")):
            there = there & (F.size(name) > 0)
        return there

    def _term(self, spec) -> DataFrame:
        name, value = next(iter(spec.items()))
        value = value.get("value") if isinstance(value, Mapping) else value
        if name not in self.docs.columns:
            return self._hits(F.lit(False))
        own = F.col(name).cast("string")
        if self.mappings.get(name) == "text":  # the first analysed token of the value against the whole raw string
            first = F.coalesce(F.get(ANALYZERS["standard"](F.lit(str(value))), F.lit(0)), F.lit(str(value)))
            return self._hits(own == first)
        return self._hits(own == str(value))

    def _terms(self, spec) -> DataFrame:
        name, values = next(iter(spec.items()))
        return self._hits(F.col(name).cast("string").isin([str(v) for v in values]) if name in self.docs.columns else F.lit(False))

    def _range(self, spec) -> DataFrame:
        name, bounds = next(iter(spec.items()))
        if name not in self.docs.columns:
            return self._hits(F.lit(False))
        v = F.col(name).try_cast("double")
        tests = {"gt": v.__gt__, "gte": v.__ge__, "lt": v.__lt__, "lte": v.__le__}
        return self._hits(reduce(lambda a, b: a & b, (test(float(bounds[op])) for op, test in tests.items() if op in bounds), v.isNotNull()))

    def _match(self, spec) -> DataFrame:
        """BM25 over the field's tokens (all text fields with all_text); a query word counts once; keyword fields match whole words as one occurrence."""
        name, opts = next(iter(spec.items()))
        text, every = (opts, False) if isinstance(opts, str) else (opts.get("query", ""), opts.get("operator", "or").lower() == "and")
        standard = ANALYZERS["standard"]
        words = self.docs.sparkSession.range(1).select(standard(F.lit(text)).alias("w")).first().w
        words = sorted(set(words) - set(STOP_WORDS))
        if not words:
            return self.docs.select(F.col(self.key).alias("doc_id"), F.lit(0.0).alias("score"))
        fields = (self.of_kind("text") or [name]) if self.all_text or name == "_all" else [name]
        fields = [f for f in fields if f in self.docs.columns]
        if not fields:
            return self._hits(F.lit(False))
        tokens = F.concat(*[standard(F.col(f).cast("string")) for f in fields])
        rows = self.docs.select(F.col(self.key).alias("doc_id"), tokens.alias("t"), *[F.col(f).cast("string").alias(f"k{j}") for j, f in enumerate(self.of_kind("keyword")) if f in self.docs.columns])
        keys = [c for c in rows.columns if c.startswith("k")]
        dl = F.when(F.size("t") > 0, F.size("t")).otherwise(max(1, len(self.docs.columns) - 1))
        tf = lambda w: F.when(F.array_contains("t", w), F.size(F.filter("t", lambda t: t == w))).otherwise(F.when(reduce(lambda a, b: a | b, (F.col(c) == w for c in keys), F.lit(False)), 1).otherwise(0))
        counted = rows.select("doc_id", dl.alias("dl"), *[F.coalesce(tf(w), F.lit(0)).alias(f"tf{j}") for j, w in enumerate(words)])
        stats = F.broadcast(counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{j}") > 0).alias(f"df{j}") for j in range(len(words))]))
        part = lambda j: F.when(F.col(f"tf{j}") > 0, idf(F.col("n"), F.col(f"df{j}")) * bm25_weight(F.col(f"tf{j}"), F.col("dl"), F.col("avgdl"))).otherwise(0.0)
        met = [F.col(f"tf{j}") > 0 for j in range(len(words))]
        where = reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), met)
        return counted.filter(where).crossJoin(stats).select("doc_id", sum((part(j) for j in range(1, len(words))), part(0)).alias("score"))

    def _knn(self, spec) -> DataFrame:
        name = spec.get("field") or (self.of_kind("knn_vector") or [None])[0]
        vector = spec.get("vector") or spec.get("query_vector") or []
        q = F.lit([float(x) for x in vector])
        rows = self.docs.filter(self._there(name)).select(F.col(self.key).alias("doc_id"), F.round(cosine(name, q), 6).alias("score"))
        return rows.orderBy(F.desc("score"), "doc_id").limit(int(spec.get("k", 10)))

    def _function_score(self, spec) -> DataFrame:
        """The inner score times the last weight."""
        weights = [float(f["weight"]) for f in spec.get("functions", []) if "weight" in f]
        return self.run(spec.get("query", {"match_all": {}})).withColumn("score", F.col("score") * (weights[-1] if weights else 1.0))

    def _bool(self, spec) -> DataFrame:
        listed = lambda k: [spec[k]] if isinstance(spec.get(k), Mapping) else list(spec.get(k, []))
        must, should, exclude, require = map(listed, ("must", "should", "must_not", "filter"))
        least = int(spec.get("minimum_should_match", 0 if must or require else (1 if should else 0)))
        tagged = [self.run(q).select("doc_id", "score", F.lit(kind).alias("kind")) for kind, qs in (("m", must), ("s", should), ("f", require), ("x", exclude)) for q in qs]
        if not must and not require and not should:
            tagged.append(self._match_all({}).withColumn("kind", F.lit("m")))
        n = lambda kind: F.count_if(F.col("kind") == kind)
        every = reduce(DataFrame.unionByName, tagged)
        score = F.sum(F.when(F.col("kind").isin("m", "s"), F.col("score")).otherwise(0.0))
        met = every.groupBy("doc_id").agg(score.alias("score"), n("m").alias("m"), n("s").alias("s"), n("f").alias("f"), n("x").alias("x"))
        wanted = len(must) if must or require or should else 1
        return met.filter((F.col("m") == wanted) & (F.col("f") == len(require)) & (F.col("x") == 0) & (F.col("s") >= least)).select("doc_id", "score")

    # --- responses ---

    def hits(self, body: Mapping) -> DataFrame:
        """All hits of a body: (doc_id, score), rounded."""
        query = body.get("query")
        if query is None:
            query = {"knn": body["knn"]} if "knn" in body else {"match_all": {}}
        return self.run(query).withColumn("score", F.round("score", 6))

    def page(self, body: Mapping) -> DataFrame:
        """The page of hits that from and size ask for, best first or as sort says."""
        rows, order = self.hits(body), []
        for s in [body["sort"]] if isinstance(body.get("sort"), (str, Mapping)) else body.get("sort", []):
            name, way = next(iter(s.items())) if isinstance(s, Mapping) else (s, "desc" if s == "_score" else "asc")
            way = way.get("order", "asc") if isinstance(way, Mapping) else way
            if name != "_score":
                rows = rows.join(self.docs.select(F.col(self.key).alias("doc_id"), F.col(name).alias(f"_{name}")), "doc_id")
            own = F.col("score" if name == "_score" else f"_{name}")
            order.append(own.desc() if way == "desc" else own.asc())
        return rows.orderBy(*(order or [F.desc("score")]), "doc_id").offset(int(body.get("from", 0) or 0)).limit(int(body.get("size", 10))).select("doc_id", "score")

    def search(self, body: Mapping) -> dict:
        """The response as a dictionary; its hits are one page."""
        hits = self.hits(body)
        page = [r.asDict() for r in self.page(body).join(self.docs.withColumnRenamed(self.key, "doc_id"), "doc_id").orderBy(F.desc("score"), "doc_id").collect()]
        return {"hits": {"total": {"value": hits.count(), "relation": "eq"}, "max_score": max((r["score"] for r in page), default=None), "hits": page}}

    def hit_records(self, body: Mapping) -> DataFrame:
        """The page of hits as (doc_id, score, record)."""
        own = self.docs.select(F.col(self.key).alias("doc_id"), F.struct(*self.docs.columns).alias("record"))
        return F.broadcast(self.page(body)).join(own, "doc_id")

    def count(self, query: Mapping | None = None) -> int:
        return (self.run(query) if query else self.docs).count()

    def delete_by_query(self, query: Mapping) -> SearchIndex:
        """The index without the query's hits."""
        gone = self.run(query).select(F.col("doc_id").alias(self.key))
        return SearchIndex(self.docs.join(gone, self.key, "left_anti"), self.mappings, self.key, self.all_text)

    def put(self, rows: DataFrame) -> SearchIndex:
        """Upsert: rows replace those with their keys."""
        kept = self.docs.join(rows.select(self.key), self.key, "left_anti")
        return SearchIndex(kept.unionByName(rows, allowMissingColumns=True), self.mappings, self.key, self.all_text)

    def delete(self, keys: list) -> SearchIndex:
        """Without these keys; unknown ones do not matter."""
        return SearchIndex(self.docs.filter(~F.col(self.key).isin(keys)), self.mappings, self.key, self.all_text)


def url_body(params: Mapping[str, str | list[str]]) -> dict:
    """The search body that URL parameters stand for: q (the text), df (its field; else all text fields), size, from. Of a repeated one the first counts."""
    first = {k: v if isinstance(v, str) else v[0] for k, v in params.items() if v}
    body: dict = {"query": {"match": {first.get("df") or "_all": first["q"]}}} if "q" in first else {}
    return body | {k: int(first[k]) for k in ("from", "size") if k in first}


def token_stream(rows: DataFrame, text: str = "text", key: str = "doc_id", analyzer: str = "standard") -> DataFrame:
    """(key, position, token, start_offset, end_offset, type) of an analyzer's tokens, explained: offsets are within the token, from 0 to its length."""
    tokens = rows.select(key, F.posexplode(ANALYZERS[analyzer](text)).alias("position", "token"))
    return tokens.select(key, "position", "token", F.lit(0).alias("start_offset"), F.length("token").alias("end_offset"), F.lit("<ALPHANUM>").alias("type"))


class Catalog:
    """Indexes by name. Their tables and mappings live under a folder, where another session finds them again."""

    def __init__(self, spark, root: str):
        self.spark, self.root, self.mapped = spark, root.rstrip("/"), {}
        notes = [r.value for r in spark.read.text(f"{self.root}/*.mapping").collect()] if self._any() else []  # a row per index
        for note in map(json.loads, notes):
            self.mapped[note["name"]] = (note["mappings"], note["key"])

    def _any(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/*.mapping")
        return bool(path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path))

    def create(self, name: str, docs: DataFrame, mappings: Mapping[str, str], key: str = "doc_id") -> SearchIndex:
        """Write docs as the index (replacing one of that name)."""
        docs.write.mode("overwrite").parquet(f"{self.root}/{name}")
        note = json.dumps({"name": name, "mappings": dict(mappings), "key": key})
        self.spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/{name}.mapping")
        self.mapped[name] = (dict(mappings), key)
        return self.get(name)

    def exists(self, name: str) -> bool:
        return name in self.mapped

    def get(self, name: str) -> SearchIndex:
        mappings, key = self.mapped[name]
        return SearchIndex(self.spark.read.parquet(f"{self.root}/{name}"), mappings, key)

    def mapping(self, name: str) -> dict[str, str]:
        return dict(self.mapped[name][0])

    def drop(self, name: str) -> None:
        from quillmere.sources.scratch import drop_path

        del self.mapped[name]
        drop_path(self.spark, f"{self.root}/{name}.mapping")
        drop_path(self.spark, f"{self.root}/{name}")

    def health(self) -> DataFrame:
        """(name, docs)."""
        return self.spark.createDataFrame([(n, self.get(n).count()) for n in sorted(self.mapped)], "name string, docs bigint")

    def analyze(self, text: str, analyzer: str = "standard") -> list[str]:
        return self.spark.range(1).select(ANALYZERS[analyzer](F.lit(text)).alias("t")).first().t
