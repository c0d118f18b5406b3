"""Compression, vectors, the search DSL, records, formats, web pages, learning and streams."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmere.operators import compression, crawl, learning, near_duplicates, records, vectors
from quillmere.operators.dsl import Catalog, SearchIndex
from quillmere.sources import formats
from quillmere.streaming import tail

SAMPLE = [0, 1, 2, 5, 9, 40, 41, 100]


def test_delta(spark):
    row = spark.createDataFrame([(SAMPLE,), ([],)], "v array<bigint>").select(compression.delta(F.col("v")).alias("d"), "v")
    got = row.withColumn("back", compression.undelta(F.col("d"))).collect()
    assert got[0].d == [0, 1, 1, 3, 4, 31, 1, 59]
    assert [r.back for r in got] == [SAMPLE, []]


@given(st.lists(st.integers(0, 1 << 62), max_size=40))
def test_varint_round_trip(values):
    assert compression.varint_values(compression.varint_bytes(np.array(values, np.int64))) == values


def test_varint_bounds(spark):
    assert compression.varint_bytes([0, 127, 128, 300]) == bytes([0, 127, 128, 1, 172, 2])
    with pytest.raises(ValueError):
        compression.varint_bytes([-1])
    with pytest.raises(ValueError):
        compression.varint_values(b"\x80")
    sizes = spark.createDataFrame([(v,) for v in (0, 127, 128, 16383, 16384, 1 << 40)], "v long").select(compression.varint_size(F.col("v")).alias("n"))
    assert [r.n for r in sizes.collect()] == [len(compression.varint_bytes([v])) for v in (0, 127, 128, 16383, 16384, 1 << 40)]


def test_packed_postings(spark):
    df = spark.createDataFrame([("a", SAMPLE), ("b", [7])], "term string, docs array<bigint>")
    packed = compression.compress(df)
    assert {r.term: r.docs for r in compression.decompress(packed).collect()} == {"a": SAMPLE, "b": [7]}


def test_skips_and_blocks(spark):
    p = spark.createDataFrame([("t", n, s) for n, s in zip([1, 5, 9, 40, 41, 100], [0.1, 0.9, 0.2, 1.5, 0.3, 0.7], strict=True)], "term string, n long, score double")
    assert [(r.start, r.max_n) for r in compression.skip_list(p, 4).orderBy("start").collect()] == [(0, 40), (4, 100)]
    assert [(r.start, r.end, r.max_score) for r in compression.blocks(p, 3).orderBy("start").collect()] == [(0, 3, 0.9), (3, 6, 1.5)]
    got = compression.comparisons_plain(p.filter("n in (5, 41)").select("n"), p.select("n")).first()
    assert (got.hits, got.examined) == (2, 2 + 5)
    assert compression.skipping([], [1]) == 0
    assert compression.skipping([100], list(range(0, 101)), 10) < 20


def steps_by_hand(small, big, interval):
    """Postings looked at, from what a skip pointer may do: jump a whole block that ends before the number, else go on by one."""
    if len(small) > len(big):
        small, big = big, small
    blocks = [big[k : k + interval] for k in range(0, len(big), interval)]
    looked, at = 0, 0
    for want in small:
        ahead = [k for k, b in enumerate(blocks) if k >= at and b[-1] >= want]
        looked += (ahead[0] if ahead else len(blocks)) - at
        if not ahead:
            break
        at = ahead[0]
        looked += sum(n < want for n in blocks[at]) + (want in blocks[at])
    return looked


@pytest.mark.parametrize("seed", range(4))
def test_intersection_with_skips(spark, seed):
    rng = np.random.default_rng(seed)
    a, b = (sorted(rng.choice(700, n, replace=False).tolist()) for n in ((40, 300), (200, 200), (1, 30), (300, 20))[seed])
    left, right = (spark.createDataFrame([(int(n),) for n in v], "n long") for v in (a, b))
    for interval in (4, 32):
        row = compression.comparisons_skips(left, right, interval).first()
        assert (row.hits, row.examined) == (len(set(a) & set(b)), steps_by_hand(a, b, interval))
        assert compression.skipping(a, b, interval) == row.examined
    met = compression.intersect_skips(left, right).filter("hit")
    assert sorted(r.n for r in met.collect()) == sorted(set(a) & set(b))
    terms = left.withColumn("term", F.lit("a")).unionByName(right.withColumn("term", F.lit("b")))
    bench = compression.plain_against_skips(terms, ["none", "a", "b"]).first()
    assert bench.skips == compression.skipping(a, b) and bench.hits == len(set(a) & set(b))
    with pytest.raises(ValueError):
        compression.plain_against_skips(terms, ["a", "none"])


@pytest.mark.parametrize("span", [3, 50])
def test_ranks_in_buckets(spark, span):
    rng = np.random.default_rng(span)
    lists = {t: sorted(rng.choice(120, 40, replace=False).tolist()) for t in "ab"}
    p = spark.createDataFrame([(t, int(n)) for t, v in lists.items() for n in v], "term string, n long")
    want = sorted((t, n, k, v[k - 1] if k else None) for t, v in lists.items() for k, n in enumerate(v))
    got = compression.ranked(p, span=span)
    assert sorted((r.term, r.n, r.k, r.before) for r in got.collect()) == want
    g = compression.gaps(p, span=span).join(got.select("term", "n", "k"), ["term", "n"]).drop("n")
    assert sorted((r.term, r.n) for r in compression.undo_gaps(g, span=span).collect()) == [(t, n) for t, n, _, _ in want]


def test_top_k_by_block_maxima(spark):
    rng = np.random.default_rng(3)
    rows = [(t, int(n), float(round(rng.random(), 4))) for t in ("a", "b") for n in rng.choice(400, 150, replace=False)]
    p = spark.createDataFrame(rows, "term string, n long, score double")
    total: dict[int, float] = {}
    for _, n, s in rows:
        total[n] = total.get(n, 0) + s
    want = sorted(((round(s, 6), -n) for n, s in total.items()), reverse=True)[:7]
    assert [(r.score, -r.n) for r in compression.top_k_block_max(p, 7, 16).collect()] == want


def test_numbering_is_by_id(spark):
    got = compression.numbered(spark.createDataFrame([(k * 3,) for k in range(50)], "doc_id long")).collect()
    assert sorted((r.doc_id, r.n) for r in got) == [(k * 3, k) for k in range(50)]


def unit(*x):
    v = np.array(x, float)
    return (v / np.linalg.norm(v)).tolist()


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(k, unit(*rng.normal(size=16)), k % 3) for k in range(300)], "vec_id long, embedding array<float>, label int").cache()


def test_exact_search(points, spark):
    q = list(points.filter("vec_id = 7").first().embedding)
    x = np.array([r.embedding for r in points.orderBy("vec_id").collect()], float)
    want = np.argsort(-np.round(x @ np.array(q), 5), kind="stable")[:5].tolist()
    assert [r.vec_id for r in vectors.exact_top_k(points, q, 5).collect()] == want
    assert all(r.vec_id % 3 == 1 for r in vectors.exact_top_k(points, q, 5, where=F.col("label") == 1).collect())
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in vectors.exact_top_k(zero, [2.0, 0.0], 5, unit=False).collect()] == [(3, 1.0), (1, 0.0)]
    assert vectors.exact_top_k(points, q, 0).count() == 0


def test_batch_search_is_exact(points):
    queries = points.filter("vec_id < 4").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    got = {}
    for r in vectors.batch_top_k(points, queries, 3).collect():
        got.setdefault(r.qid, {})[r.rank] = r.vec_id
    for r in queries.collect():
        assert [got[r.qid][k] for k in (1, 2, 3)] == [x.vec_id for x in vectors.exact_top_k(points, list(r.query), 3).collect()]


def test_batch_search_in_blocks(points):
    queries = points.filter("vec_id < 9").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    tell = lambda df: sorted(map(tuple, df.select("qid", "vec_id", "score", "rank").collect()))
    want = tell(vectors.batch_top_k(points, queries, 3))
    assert len(want) == 27 and tell(vectors.batch_top_k(points, queries, 3, most_queries=2)) == want
    assert vectors.batch_top_k(points, queries.limit(0), 3).count() == 0


def test_null_and_empty_vectors_and_other_keys(spark):
    rows = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", None), ("d", []), ("e", [0.0, 1.0])], "name string, v array<float>")
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("r", None)], "qid string, query array<float>")
    got = vectors.batch_top_k(rows, asked, 2, "name", "v")
    assert sorted((r.qid, r.name, r["rank"]) for r in got.collect()) == [("q", "a", 1), ("q", "b", 2)]
    model = vectors.IvfPq.fit(rows, 2, 2, 2, vector="v", key="name")
    assert model.index(rows, "v", "name").count() == 3
    assert vectors.IvfPq.fit(rows.limit(0), vector="v", key="name").index(rows.limit(0), "v", "name").count() == 0


def test_inverted_file(points):
    model = vectors.IvfPq.fit(points)
    index = model.index(points).cache()
    assert index.count() == 300
    q = list(points.filter("vec_id = 11").first().embedding)
    exact = vectors.exact_top_k(points, q, 5)
    assert vectors.agreement(model.search(index, q, 5, nprobe=4, rerank=100), exact).first().same
    assert model.search(index, q, 5, nprobe=1).first().vec_id == 11


def test_inverted_file_in_batches(points):
    model = vectors.IvfPq.fit(points)
    index = model.index(points).cache()
    queries = points.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    got = {}
    for r in model.batch_search(index, queries, 5, nprobe=2, most_queries=4).collect():
        got.setdefault(r.qid, {})[r.rank] = (r.vec_id, r.score)
    assert len(got) == 15
    for r in queries.filter("qid < 60").collect():
        assert [got[r.qid][n] for n in range(1, 6)] == [tuple(x) for x in model.search(index, list(r.query), 5, nprobe=2).collect()]
    exact = vectors.batch_top_k(points, queries, 5)
    assert vectors.agreement(model.batch_search(index, queries, 5, nprobe=4, rerank=100), exact, ["qid", "vec_id"]).first()[:] == (75, 75, True)


def test_l2_and_winner(spark):
    row = spark.createDataFrame([(unit(1, 2), unit(2, 1))], "a array<double>, b array<double>").select(vectors.cosine("a", "b").alias("c"), vectors.cosine_from_l2(vectors.l2_squared("a", "b")).alias("d"), vectors.winner(F.lit(1), F.lit(1)).alias("w")).first()
    assert row.c == pytest.approx(row.d) and row.w == "left"


def test_semantic_engine(spark, tmp_path):
    rows = spark.createDataFrame([("p1", "red boots", None, "shoes"), ("p2", None, "tea kettle", "home"), ("bad", "", "   ", "home")], "id string, name string, description string, category string")
    engine = vectors.SemanticSearch(rows)
    with pytest.raises(RuntimeError):
        engine.search("boots")
    engine.build(str(tmp_path / "s"))
    assert [r.id for r in engine.missing.collect()] == ["bad"]
    assert engine.search("boots", 1).first().id == "p1"
    assert engine.search("boots", 5, category="home").first().id == "p2"
    assert engine.search("boots", 5, category="none").count() == 0
    assert engine.search("  ").count() == 0
    again = vectors.SemanticSearch.load(spark, str(tmp_path / "s"))
    assert [r.id for r in again.search("kettle", 2).collect()] == [r.id for r in engine.search("kettle", 2).collect()]


@pytest.fixture(scope="module")
def shop(spark):
    rows = [("1", "Red football boots", "shoes", "49.5"), ("2", "Blue boots", "shoes", "oops"), ("3", "Football", "toys", "9"), ("4", "", None, None)]
    return SearchIndex(spark.createDataFrame(rows, "doc_id string, name string, category string, price string"), {"name": "text", "category": "keyword"})


def hits(index, query):
    return {r.doc_id: r.score for r in index.hits({"query": query}).collect()}


def test_dsl_filters(shop):
    assert set(hits(shop, {"range": {"price": {"gte": 9, "lt": 49.5}}})) == {"3"}
    assert set(hits(shop, {"exists": {"field": "name"}})) == {"1", "2", "3"}
    assert set(hits(shop, {"exists": {"field": "absent"}})) == set()
    assert set(hits(shop, {"term": {"category": "shoes"}})) == {"1", "2"}
    assert set(hits(shop, {"term": {"name": "Football"}})) == set()  # one analysed token against the raw string
    assert set(hits(shop, {"ids": {"values": ["3", "9"]}})) == {"3"}
    assert hits(shop, {"match_all": {}}) == dict.fromkeys("1234", 1.0)


def test_dsl_match_and_bool(shop):
    both = hits(shop, {"match": {"name": {"query": "football boots", "operator": "and"}}})
    assert set(both) == {"1"}
    either = hits(shop, {"match": {"name": "the football boots"}})
    assert set(either) == {"1", "2", "3"} and either["1"] == both["1"]
    assert set(hits(shop, {"match": {"name": "the of"}}).values()) == {0.0}
    got = hits(shop, {"bool": {"must": [{"match": {"name": "boots"}}], "must_not": [{"ids": {"values": ["2"]}}], "should": [{"term": {"category": "shoes"}}]}})
    assert set(got) == {"1"} and got["1"] == pytest.approx(hits(shop, {"match": {"name": "boots"}})["1"] + 1, abs=1e-5)
    assert set(hits(shop, {"bool": {"should": [{"term": {"category": "toys"}}]}})) == {"3"}
    assert set(hits(shop, {"bool": {"must_not": [{"term": {"category": "toys"}}]}})) == {"1", "2", "4"}
    assert hits(shop, {"function_score": {"query": {"ids": {"values": ["1"]}}, "functions": [{"weight": 2}, {"weight": 3}]}}) == {"1": 3.0}


def test_dsl_response(shop):
    out = shop.search({"query": {"match_all": {}}, "size": 2, "from": 1, "sort": [{"doc_id": "desc"}]})
    assert out["hits"]["total"]["value"] == 4 and len(out["hits"]["hits"]) == 2
    assert [r.doc_id for r in shop.page({"size": 2, "from": 1, "sort": [{"price": {"order": "asc"}}]}).collect()] == ["1", "3"]


def test_dsl_edits(shop, spark, tmp_path):
    assert shop.delete_by_query({"term": {"category": "shoes"}}).count() == 2
    assert shop.delete(["1", "nope"]).count() == 3
    new = spark.createDataFrame([("1", "Green hat")], "doc_id string, name string")
    assert hits(shop.put(new), {"match": {"name": "hat"}}).keys() == {"1"}
    catalog = Catalog(spark, str(tmp_path))
    catalog.create("shop", shop.docs, shop.mappings)
    assert catalog.exists("shop") and catalog.health().first().docs == 4
    assert catalog.analyze("Don't Stop") == ["don't", "stop"]
    catalog.drop("shop")
    assert not catalog.exists("shop")
    with pytest.raises(KeyError):
        catalog.drop("shop")


def test_records(spark):
    rows = spark.createDataFrame([(0, "a", 1), (1, "b", None), (2, "c", 3)], "idx int, name string, size int")
    key = lambda df: sorted(tuple(r) for r in df.select("idx", "name").collect())
    assert key(records.update_record(rows, 1, "name", "z")) == [(0, "a"), (1, "z"), (2, "c")]
    assert key(records.delete_records(rows, F.col("size") > 2)) == [(0, "a"), (1, "b")]
    assert key(records.insert_at(rows, 1, {"name": "new"})) == [(0, "a"), (1, "new"), (2, "b"), (3, "c")]


def test_bulk(spark):
    lines = ['{"index": {"_id": "1"}}', '{"index": {"x": 1}}', '{"delete": {"_id": "2"}}', "", '{"update": {"_id": "3"}}', '{"doc": {"a": 5}}', '{"delete": {"_id": "4"}}', '{"create": {"_id": "5"}}', '{"b": 1}']
    df = spark.createDataFrame([(0, k, s) for k, s in enumerate(lines)], "stream int, line_no int, line string")
    got = sorted((r.id, r.action, r.source) for r in records.bulk_actions(df).collect())
    assert got == [("1", "index", '{"index": {"x": 1}}'), ("2", "delete", None), ("3", "update", '{"a":5}'), ("4", "delete", None), ("5", "create", '{"b": 1}')]


def test_formats(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'a, "b"\nc', 1.5, ["x"]), ("2", "d", None, [])], "id string, name string, price double, tags array<string>")
    sizes = formats.save_all(rows, str(tmp_path / "f"))
    assert set(sizes) == {"csv", "json", "ndjson", "parquet"} and all(sizes.values())
    back = {f: sorted((r.id, r.name) for r in formats.load_any(spark, str(tmp_path / "f" / f), f).collect()) for f in sizes}
    assert all(b == [("1", 'a, "b"\nc'), ("2", "d")] for b in back.values())
    assert dict(formats.load_any(spark, str(tmp_path / "f" / "csv"), "csv").dtypes)["price"] == "string"
    with pytest.raises(ValueError):
        formats.load_any(spark, "x", "pickle")
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "doc-1.txt").write_text("topic: food\nTitle\nbody text")
    (folder / "skip.md").write_text("x")
    assert [tuple(r) for r in formats.topic_folder(spark, str(folder)).collect()] == [("doc-1", "food", "Title", "topic: food\nTitle\nbody text")]
    (tmp_path / "q.json").write_text('{"q1": {"query": "red sauce", "topic": "food", "relevant": {"d1": 2, "d2": 1}}}')
    queries, judged = formats.qrels(spark, str(tmp_path / "q.json"))
    assert tuple(queries.first()) == ("q1", "red sauce", "food") and judged.count() == 2
    formats.append_log(spark.createDataFrame([("one",)], "value string"), str(tmp_path / "log"))
    formats.append_log(spark.createDataFrame([("two",)], "value string"), str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 2


PAGE = '<html lang="en"><title>T</title><body><!-- x --><script>var a="<a href=\\"no\\">";</script><a class="n" href="/a/b?x=1#f">A</a><a href="http://o.example.org/z">B &amp; C</a><a href="../products/p.html">D</a><div class="card" data-product-id="p-1"><span class="cat">home</span><h3><a href="p">Kettle</a></h3><p class="price">$1,012.50</p><p class="desc">Hot</p></div></body>'


def test_pages(spark):
    df = spark.createDataFrame([(1, "HTTP://Shop.example.com:80/products/page-1.html#top", PAGE)], "page_id long, url string, html string")
    assert [r.target for r in crawl.links(df).orderBy("at").collect()][:3] == ["HTTP://Shop.example.com:80/a/b?x=1#f", "http://o.example.org/z", "HTTP://Shop.example.com:80/products/p.html"]
    assert df.select(crawl.normal_url("url").alias("u"), crawl.host("url").alias("h")).first() == ("http://shop.example.com/products/page-1.html", "shop.example.com")
    card = crawl.product_cards(df).first()
    assert (card.product_id, card.name, card.price, card.category, card.description) == ("p-1", "Kettle", 1012.5, "home", "Hot")
    assert "B & C" in df.select(crawl.visible_text("html").alias("t")).first().t


def test_robots(spark):
    rules = crawl.robots_rules("User-agent: bot\nUser-agent: *\nDisallow: /a\nAllow: /a/ok\n\nUser-agent: other\nDisallow: /\n")
    urls = spark.createDataFrame([(f"http://x.org{p}",) for p in ("/a", "/a/ok/1", "/b", "")], "url string")
    assert sorted(r.url for r in crawl.robots_filter(urls, rules).collect()) == ["http://x.org", "http://x.org/a/ok/1", "http://x.org/b"]
    assert crawl.robots_rules("User-agent: z\nDisallow: /") == []


def test_frontier_and_changes(spark):
    found = spark.createDataFrame([("http://a.org/1",), ("http://A.org/1#x",), ("http://a.org/2",), ("http://b.org/",)], "url string")
    seen = spark.createDataFrame([("http://b.org",)], "url string")
    assert sorted((r.url, r.turn) for r in crawl.frontier(found, seen).collect()) == [("http://a.org/1", 1), ("http://a.org/2", 2)]
    now = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    then = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "k int, v string")
    assert sorted(tuple(r) for r in crawl.changed(now, then, "k", ["v"]).collect()) == [(2, "changed"), (3, "new"), (4, "gone")]


def test_pagerank(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")]
    got = {r.node: r.rank for r in crawl.pagerank(spark.createDataFrame(edges, "src string, dst string"), rounds=12).collect()}
    rank = dict.fromkeys("abcd", 0.25)
    for _ in range(12):
        rank = {n: 0.15 / 4 + 0.85 * sum(rank[s] for s, t in edges if t == n) for n in rank}
    assert got == pytest.approx(rank) and sum(got.values()) == pytest.approx(1)


def test_near_duplicates(spark):
    base = [f"w{k}" for k in range(60)]
    near = base[:59] + ["other"]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, "short"), (5, None), (6, " ".join(reversed(base)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.group_id) for r in near_duplicates.near_duplicate_groups(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (4, 4), 5: (5, 5), 6: (6, 6)}


def test_json_array_of_many_rows(spark, tmp_path):
    rows = spark.range(100_050).selectExpr("id", "if(id % 7 = 0, null, concat('é\\n', id)) AS name")
    formats.write_json_array(rows, str(tmp_path / "j"))
    back = formats.read_json_array(spark, str(tmp_path / "j"), rows.schema)
    assert back.count() == 100_050 and back.exceptAll(rows).isEmpty()


def test_similarity_of_queries_and_all_rows(points):
    got = vectors.similarity_matrix(points.filter("vec_id % 20 = 0"), every=points).collect()
    assert len(got) == 15 * 300 and all(r.score == 1 for r in got if r.a == r.b)


def test_exact_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    sets = {k: sorted(set(rng.choice(30, int(rng.integers(1, 14))).tolist())) for k in range(60)}
    sets |= {100 + k: sorted({*v, 99}) for k, v in sets.items() if k % 3 == 0}
    df = spark.createDataFrame([(k, v) for k, v in sets.items()], "class_id long, shingles array<bigint>")
    j = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    want = {(a, b) for a in sets for b in sets if a < b and j(sets[a], sets[b]) >= 0.8}
    assert {(r.a, r.b) for r in near_duplicates.exact_pairs(df).collect()} == want and len(want) > 10


def test_linked_documents_equal_brute_force(spark):
    base = [f"w{k}" for k in range(60)]
    near = base[:59] + ["other"]
    texts = {1: base, 500: base, 9000: near, 20000: near, 7: base[::-1], 800: base[::-1], 30000: ["short"]}
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    rows = near_duplicates.linked_documents(df).collect()
    name = {k: k for k in texts} | {r.b: r.a for r in rows if r.similarity == 1}
    met = {(r.a, r.b) for r in rows if r.similarity < 1}
    sets = {k: {tuple(t[j : j + 5]) for j in range(max(len(t) - 4, 1))} for k, t in texts.items()}
    want = {(a, b) for a in texts for b in texts if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert {(a, b) for a in texts for b in texts if a < b and (name[a] == name[b] or tuple(sorted((name[a], name[b]))) in met)} == want and (500, 20000) in want


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 30)] + [(100, 101)], "a long, b long")
    roots = {r.node: r.root for r in near_duplicates.components(edges).collect()}
    assert set(roots.values()) == {1, 100} and len(roots) == 32


def test_bayes(spark):
    docs = spark.createDataFrame([(1, "good fine good"), (2, "bad awful"), (3, "good"), (4, "awful bad bad"), (5, "unknownword"), (6, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, 1), (1, None)], "doc_id long, y int")
    got = {r.doc_id: r.label for r in learning.naive_bayes_classify(docs, learning.naive_bayes_model(docs, labels, "y")).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0}


def test_clusters(spark):
    docs = spark.createDataFrame([(k, ("red sauce basil " if k % 2 else "moon mars orbit ") * 3) for k in range(10)], "doc_id long, text string")
    out, score = learning.kmeans_clusters(learning.hashed_tfidf(docs), 2)
    assert score > 0.9 and len({(r.doc_id % 2, r.cluster) for r in out.collect()}) == 2


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00", "u"), (2, "2024-01-01 00:10:00", "u"), (3, "2024-01-01 02:00:00", "u")], "id int, t string, user string").withColumn("ts", F.to_timestamp("t"))
    events.write.parquet(str(tmp_path / "e"))
    stream = tail.event_stream(spark, str(tmp_path / "e"), events.schema)
    assert [(r.user, r.n) for r in tail.drain(tail.counts_by(stream, "user"), "by_user").collect()] == [("u", 3)]
    assert sorted(r.n for r in tail.drain(tail.sessions(stream, "ts", "user"), "by_session", "complete").collect()) == [1, 2]
    assert sum(r.n for r in tail.drain(tail.windowed_counts(stream, "ts", "user"), "by_hour", "complete").collect()) == 3
    docs = spark.createDataFrame([(1, "a b a")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "d"))
    q = tail.maintain_index(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "d")), str(tmp_path / "ix"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.term: r.tf for r in spark.read.parquet(str(tmp_path / "ix")).collect()} == {"a": 2, "b": 1}
