"""Generators, logs, packed records, bulk edits, catalogs, collections and the index of the semantic search."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillmere.operators import boolean, crawl, evaluation, ranking, records, vectors
from quillmere.operators.dsl import Catalog, SearchIndex, token_stream, url_body
from quillmere.sources import formats, generators


def test_generators_do_not_depend_on_partitions(spark):
    topics = {"a": ["One.", "Two."], "b": ["Three."]}
    made = generators.corpus(spark, topics, 7)
    rows = sorted(tuple(r) for r in made.collect())
    assert rows == sorted(tuple(r) for r in made.repartition(3).collect()) and len(rows) == 14
    assert sorted(r[1] for r in rows) == ["a"] * 7 + ["b"] * 7 and rows[0][0] == "doc-001"
    assert all(r[3].startswith(r[2] + "\n") and 3 <= r[3].split("\n")[1].count(".") <= 5 for r in rows)
    assert rows != sorted(tuple(r) for r in generators.corpus(spark, topics, 7, seed=1).collect())
    assert generators.corpus(spark, {}, 3).count() == 0


def test_generated_products_and_profiles(spark):
    rows = {r.id: r for r in generators.products(spark, ["x", "y"], ["old"], ["cup"], each=10, copies=3).collect()}
    assert len(rows) == 23 and rows["p-022"].name == rows["p-008"].name + " Plus"
    assert rows["p-022"].price == pytest.approx(rows["p-008"].price + 1) and "Top rated" in rows["p-022"].description
    words = {k: ("A", "B") for k in ("first", "last", "domain", "city", "state", "street", "product", "tag")}
    people = generators.profiles(spark, 50, words).collect()
    assert all(18 <= p.age <= 75 and 5 <= p.price <= 500 and len(set(p.tags)) == len(p.tags) <= 3 for p in people)
    assert people[0].id == "u-00001"


def test_shop_pages_round_trip(spark):
    rows = [(k, f'cup & "saucer" <{k}>', 1.5 * k, None if k == 3 else "fine", "red" if k % 2 else "blue") for k in range(70)]
    p = spark.createDataFrame(rows, "id int, name string, price double, description string, category string")
    pages = generators.shop_pages(p).select(F.col("url").alias("page_id"), "html")
    assert pages.count() == 70 + 3 + 2 * 2
    cards = crawl.product_cards(pages).filter("page_id LIKE '/products/%'").collect()
    assert sorted(int(c.product_id) for c in cards) == list(range(70)) and {c.page_id for c in cards} == {f"/products/page-{k}.html" for k in (1, 2, 3)}
    ways = {(r.page_id, r.way): r.target for r in crawl.pager_links(pages).collect()}
    assert ways[("/products/page-1.html", "Next")] == "/products/page-2.html" and ("/products/page-1.html", "Prev") not in ways
    assert crawl.robots_rules(generators.ROBOTS) == [(True, "/"), (False, "/admin/"), (False, "/cart/")]
    assert generators.sitemap(pages.withColumnRenamed("page_id", "url"), "http://x").filter("value LIKE '  <url><loc>http://x/product%</loc></url>'").count() == 73
    assert generators.shop_pages(p.limit(0)).count() == 0


def test_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert formats.tail_lines(spark, path, 3).count() == 0
    log = formats.Log(spark, path, 2)
    for k in range(5):
        log.write(f"{k}")
    assert spark.read.text(path).count() == 4  # the last one is not flushed yet
    assert log.close() == 5
    again = formats.Log(spark, path, 0)
    again.write("more")
    assert again.close() == 1
    assert [r.value for r in formats.tail_lines(spark, path, 4).orderBy("at").collect()] == ["2", "3", "4", "more"]
    assert formats.tail_lines(spark, path, 100).count() == 6


def test_packed_records(spark):
    rows = spark.createDataFrame([(1, 2.5, "abc"), (-7, None, "eightlong"), (None, 1e9, None), (3, 0.0, "1234567é")], "a int, b double, c string")
    packed = formats.pack_records(rows, "a", "b", "c")
    assert {len(r.record) for r in packed.collect()} == {16} and bytes(packed.first().record) == b"\x00\x00\x00\x01\x40\x20\x00\x00abc\x00\x00\x00\x00\x00"
    assert sorted(tuple(r) for r in formats.unpack_records(packed).collect()) == [(-7, 0.0, "eightlon"), (0, 1e9, ""), (1, 2.5, "abc"), (3, 0.0, "1234567")]
    assert formats.unpack_records(packed.limit(0)).count() == 0


def test_bulk_is_applied(spark):
    rows = spark.createDataFrame([("1", "a", 1), ("2", "b", 2), ("3", "c", 3)], "doc_id string, name string, size int")
    lines = ['{"delete": {"_id": "1"}}', '{"index": {"_id": "2"}}', '{"name": "x"}', '{"index": {"_id": "2"}}', '{"name": "y", "size": 5}', '{"create": {}}', '{"name": "nobody"}', '{"create": {"_id": "9"}}', '{"name": "new"}']
    df = spark.createDataFrame([(0, k, s) for k, s in enumerate(lines)], "stream int, line_no int, line string")
    assert sorted(tuple(r) for r in records.apply_bulk(rows, df).collect()) == [("2", "y", 5), ("3", "c", 3), ("9", "new", None)]
    assert records.apply_bulk(rows, df.limit(0)).count() == 3


def test_catalog_is_found_again(spark, tmp_path):
    docs = spark.createDataFrame([("1", "Red cup", "x"), ("2", "blue", "red")], "doc_id string, name string, note string")
    Catalog(spark, str(tmp_path)).create("shop", docs, {"name": "text", "note": "text"})
    again = Catalog(spark, str(tmp_path))
    assert again.mapping("shop") == {"name": "text", "note": "text"}
    every = url_body({"q": "red", "size": ["5"], "df": []})
    assert every == {"query": {"match": {"_all": "red"}}, "size": 5}
    assert {r.doc_id for r in again.get("shop").page(every).collect()} == {"1", "2"}
    assert {r.record.name for r in again.get("shop").hit_records(url_body({"q": "red", "df": "name"})).collect()} == {"Red cup"}
    again.drop("shop")
    assert not Catalog(spark, str(tmp_path)).exists("shop")
    assert [tuple(r)[1:5] for r in token_stream(docs, "name").filter("doc_id = '1'").orderBy("position").collect()] == [(0, "red", 0, 3), (1, "cup", 0, 3)]
    assert isinstance(SearchIndex(docs), SearchIndex)


def test_collections(spark, tmp_path):
    held = vectors.Collections(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "vec_id bigint, embedding array<double>")
    held.recreate("a")
    held.insert("a", rows)
    assert held.count("a") == 2 and held.search("a", [1.0, 0.0], 1).first().vec_id == 1
    with pytest.raises(ValueError):
        held.insert("a", spark.createDataFrame([(4, [1.0])], "vec_id bigint, embedding array<double>"))
    held.recreate("a")
    assert held.count("a") == 0


def test_semantic_index_finds_what_exact_search_finds(spark, tmp_path):
    words = ["red", "blue", "cup", "lamp", "chair", "boots", "kettle", "drum", "stool", "rope"]
    rows = [(k, " ".join(words[(k * s) % 10] for s in (1, 3, 7)) + f" {k % 37}", "x" if k % 3 else "y") for k in range(400)]
    df = spark.createDataFrame(rows, "id bigint, name string, category string")
    plain = vectors.SemanticSearch(df).build(str(tmp_path / "p"))
    fast = vectors.SemanticSearch(df).build(str(tmp_path / "f"), index=True)
    again = vectors.SemanticSearch.load(spark, str(tmp_path / "f"))
    hit = asked = 0
    for k in range(0, 400, 40):
        # ties are wide here: a hit is one whose score the exact search has, too
        exact = [r.score for r in plain.search(rows[k][1], 5).collect()]
        found = [r.score for r in fast.search(rows[k][1], 5).collect()]
        asked += 5
        hit += sum(s >= exact[-1] for s in found)
    assert hit / asked >= 0.9 and again.cells is not None
    one = again.search("red cup", 3)
    assert [tuple(r) for r in one.collect()] == [tuple(r) for r in fast.search("red cup", 3).collect()] and set(one.columns) == {"id", "name", "category", "score"}
    assert {r.category for r in again.search("red cup", 5, category="y").collect()} == {"y"}
    assert again.search("  ").count() == 0


def test_rarest_first_and_timings(spark):
    tf = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "term string, doc_id int")
    assert [tuple(r) for r in boolean.by_rarity(tf, ["a", "b", "zz"]).orderBy("place").collect()] == [("zz", 0, 1), ("b", 1, 2), ("a", 2, 3)]
    runs = evaluation.stopwatch(spark, {"one": lambda: 1, "two": lambda: tf.groupBy("term").count()}, 3)
    assert {(r.stage, r.n) for r in evaluation.timing_stats(runs, "stage", "ms").collect()} == {("one", 3), ("two", 3)}


def test_bm25_of_a_lazy_scan_and_of_a_written_one(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red sauce"), (2, "sauce sauce"), (3, "basil"), (4, None)], "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "d"))
    own, asked = spark.read.parquet(str(tmp_path / "d")), {"q": "sauce basil", "none": "!"}
    lazy = ranking.bm25(own, asked)
    rows = lambda df: sorted((r.qid, r.doc_id, round(r.score, 9)) for r in df.collect())
    assert rows(lazy) == rows(ranking.bm25(own, asked, rows=ranking.written(own, asked)))
    ql = ranking.query_likelihood(own, asked)
    assert rows(ql) == rows(ranking.query_likelihood(own, asked, rows=ranking.written(own, asked)))
    plan = lazy._jdf.queryExecution().optimizedPlan().toString()
    # each of the plan's scans tokenises once: two splits at most for the statistics' two branches, and one for the hits
    assert plan.count("split(") == plan.count("Relation [") <= 3
