"""Queries of the parts around retrieval: generated tables and shop pages, logs and packed records, bulk edits and catalogs, URL parameters, token streams,
ranker runs, timings, vector collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.operators import boolean, crawl, evaluation, learning, records, vectors
from quillmere.operators import index as ix
from quillmere.operators.dsl import Catalog, SearchIndex, token_stream, url_body
from quillmere.sources import formats, generators
from quillmere.sources.scratch import materialise, scratch_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def held(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return held


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- generated tables ---------------------------------------------------------------------------------------------

TOPICS = {"garden": ("Prune roses in late winter.", "Water seedlings at dawn.", "Compost feeds the soil."), "harbour": ("Ferries leave on the hour.", "The tide turns at noon.", "Nets dry on the quay.", "Gulls follow the boats.")}
CATEGORIES, ADJECTIVES, NOUNS = ("camping", "kitchen", "music"), ("plain", "sturdy", "light"), ("kettle", "lamp", "stool", "drum")
PEOPLE = {"first": ("Ada", "Bo", "Cem"), "last": ("Lind", "Okoro"), "domain": ("mail.example", "post.example"), "city": ("Arden", "Brill"), "state": ("NO", "SO"), "street": ("Elm Road", "Mill Lane"), "product": ("kettle", "lamp"), "tag": ("new", "vip", "news", "beta")}


def _draw(purpose: str, n: int | str, number: str = "id") -> str:
    return f"CAST(CAST('0x' || substr(md5('42:' || {number} || ':{purpose}'), 1, 8) AS BIGINT) % {n} AS INTEGER)"


def _pick(purpose: str, words: tuple[str, ...], number: str = "id") -> str:
    return f"[{', '.join(repr(w) for w in words)}][{_draw(purpose, len(words), number)} + 1]"


def _cents(number: str = "id") -> str:
    return f"round(({_draw('price', 49501, number)} + 500) / 100, 2)"


def _said(name: str) -> str:
    return f"[{', '.join(_pick(f'sentence{k}', TOPICS[name]) for k in range(5))}][1:{_draw('length', 3)} + 3]"


@query(f"""WITH r AS (SELECT range AS id, CAST(floor((range * 49 + 42) % 80 / 40) AS INTEGER) AS slot FROM range(80)), s AS (SELECT id, slot, CASE slot WHEN 0 THEN {_said("garden")} ELSE {_said("harbour")} END AS said FROM r)
SELECT 'doc-' || lpad(CAST(id + 1 AS VARCHAR), 3, '0') AS doc_id, CASE slot WHEN 0 THEN 'garden' ELSE 'harbour' END AS topic, said[1] AS title, said[1] || chr(10) || array_to_string(said, ' ') AS text FROM s""")
def generated_corpus(spark, d):
    return generators.corpus(spark, TOPICS, 40)


def _product(number: str) -> str:
    adjective, noun = _pick("adjective", ADJECTIVES, number), _pick("noun", NOUNS, number)
    category = f"[{', '.join(map(repr, CATEGORIES))}][CAST({number} // 30 AS INTEGER) + 1]"
    return f"upper({adjective}[1]) || {adjective}[2:] || ' ' || {noun} || ' ' || ({number} % 30 + 1) AS name, {_cents(number)} AS price, 'A ' || {adjective} || ' ' || {noun} || ' for ' || {category} || ' lovers. Highly rated ' || {noun} || ' with reliable everyday performance.' AS description, {category} AS category"


@query(f"""SELECT 'p-' || lpad(CAST(id + 1 AS VARCHAR), 3, '0') AS id, * EXCLUDE (id) FROM (SELECT range AS id, {_product("range")} FROM range(90))
UNION ALL SELECT 'p-' || lpad(CAST(id + 91 AS VARCHAR), 3, '0'), name || ' Plus', round(price + 1, 2), replace(description, 'Highly rated', 'Top rated'), category FROM (SELECT range AS id, {_product("(range * 7)")} FROM range(8))""")
def generated_products(spark, d):
    return generators.products(spark, CATEGORIES, ADJECTIVES, NOUNS)


@query(f"""SELECT 'u-' || lpad(CAST(id + 1 AS VARCHAR), 5, '0') AS id, {_pick("first", PEOPLE["first"])} || ' ' || {_pick("last", PEOPLE["last"])} AS name, lower({_pick("first", PEOPLE["first"])} || '.' || {_pick("last", PEOPLE["last"])} || '@' || {_pick("domain", PEOPLE["domain"])}) AS email,
{_draw("age", 58)} + 18 AS age, {_cents()} AS price, {_pick("city", PEOPLE["city"])} AS city, {_pick("state", PEOPLE["state"])} AS state, {_draw("zip", 90000)} + 10000 AS zip, CAST({_draw("house", 9999)} + 1 AS VARCHAR) || ' ' || {_pick("street", PEOPLE["street"])} AS street, {_pick("product", PEOPLE["product"])} AS product,
array_to_string(list_transform(list_sort([{", ".join(f"{{'o': {_draw(f'tag{j}', 1 << 30)}, 't': {t!r}}}" for j, t in enumerate(PEOPLE["tag"]))}])[1:{_draw("tags", 4)}], lambda x: x.t), ',') AS tags FROM (SELECT range AS id FROM range(500))""")
def generated_profiles(spark, d):
    return generators.profiles(spark, 500, PEOPLE).withColumn("tags", F.array_join("tags", ","))


# --- shop pages ---------------------------------------------------------------------------------------------------

SHOP = "pr AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_retailprice AS price, p_brand AS description, p_type AS category, row_number() OVER (ORDER BY p_partkey) - 1 AS n FROM part)"


def shop(spark, d) -> DataFrame:
    """The pages of a shop of all parts, with their URLs as page_id."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("description"), F.col("p_type").alias("category"))
    return generators.shop_pages(p).select(F.col("url").alias("page_id"), "html")


@query(f"""WITH {SHOP}, c AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n) - 1 AS k FROM pr)
SELECT '/products/page-' || (n // 32 + 1) || '.html' AS page_id, id AS product_id, name, round(price, 2) AS price, category, description FROM pr
UNION ALL SELECT '/category/' || category || '/page-' || (k // 32 + 1) || '.html', id, name, round(price, 2), category, description FROM c
UNION ALL SELECT '/product/' || id || '.html', id, name, round(price, 2), category, description FROM pr""")
def product_cards(spark, d):
    """Cards read back from a shop's generated pages."""
    return crawl.product_cards(shop(spark, d))


@query(f"""WITH {SHOP}, k AS (SELECT 'products' AS kind, count(*) AS n FROM pr UNION ALL SELECT 'category/' || category, count(*) FROM pr GROUP BY category), g AS (SELECT kind, (n + 31) // 32 AS pages, unnest(range(1, (n + 31) // 32 + 1)) AS page FROM k)
SELECT '/' || kind || '/page-' || page || '.html' AS page_id, 'Prev' AS way, '/' || kind || '/page-' || (page - 1) || '.html' AS target FROM g WHERE page > 1 UNION ALL SELECT '/' || kind || '/page-' || page || '.html', 'Next', '/' || kind || '/page-' || (page + 1) || '.html' FROM g WHERE page < pages""")
def pager_links(spark, d):
    return crawl.pager_links(shop(spark, d))


# --- logs and packed records --------------------------------------------------------------------------------------


@query("SELECT CAST(n // 10 AS BIGINT) AS batch, CAST(n - 17 AS BIGINT) AS at, 'line ' || n AS value FROM (SELECT unnest(range(18, 25)) AS n)")
def log_tail(spark, d):
    """25 lines, flushed by tens; the last seven of what is there."""
    path = scratch_path(spark, "log")
    log = formats.Log(spark, path, 10)
    for k in range(25):
        log.write(f"line {k}")
    log.close()
    return formats.tail_lines(spark, path, 7)


@query("SELECT CAST(p_partkey AS INTEGER) AS number, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS amount, substr(p_name, 1, 8) AS name FROM part")
def packed_records(spark, d):
    """All parts as records of 16 bytes, written, and read again."""
    packed = materialise(formats.pack_records(table(spark, d, "part"), "p_partkey", "p_retailprice", "p_name"), "packed")
    return formats.unpack_records(packed).withColumn("amount", F.col("amount").cast("double"))


# --- index edits --------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 5 > 2 UNION ALL SELECT p_partkey, 'once ' || p_name, NULL FROM part WHERE p_partkey % 5 = 1
UNION ALL SELECT p_partkey, p_name, p_size + 1 FROM part WHERE p_partkey % 5 = 2 UNION ALL SELECT -1 - p_partkey, p_name, 7 FROM part WHERE p_partkey % 5 = 0""")
def bulk_applied(spark, d):
    """Bulk lines for all parts: of five, one is deleted and comes in again under another id, one is replaced, one is written twice, two are left alone."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    key = F.col("p_partkey")
    act = lambda kind, of: F.to_json(F.struct(F.struct(of.cast("string").alias("_id")).alias(kind)))
    name, size = F.col("p_name"), F.col("p_size")
    doc = lambda *fields: F.to_json(F.struct(*fields))
    of = key % 5
    texts = (
        F.when(of == 0, F.array(act("delete", key), act("create", -1 - key), doc(name, F.lit(7).alias("p_size"))))
        .when(of == 1, F.array(act("index", key), doc(F.concat(F.lit("once "), name).alias("p_name"))))
        .when(of == 2, F.array(act("delete", key), act("update", key), F.to_json(F.struct(F.struct(name, (size + 1).alias("p_size")).alias("doc")))))
    )
    lines = p.select((key % 7).alias("stream"), key, F.posexplode(texts).alias("at", "line")).select("stream", (key * 4 + F.col("at")).alias("line_no"), "line")
    return records.apply_bulk(p, lines, key="p_partkey")


@query("SELECT CAST(p_partkey AS BIGINT) AS doc_id, p_name, p_type FROM part WHERE p_partkey NOT IN (1, 2) UNION ALL SELECT 2, 'green hat', NULL UNION ALL SELECT -9, 'new', 'SMALL'")
def catalog_edits(spark, d):
    """An index that is made, found again by name, and edited: put replaces and adds, delete takes out."""
    root = scratch_path(spark, "catalog")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), "p_name", "p_type")
    Catalog(spark, root).create("parts", p, {"p_name": "text", "p_type": "keyword"})
    new = spark.createDataFrame([(2, "green hat", None), (-9, "new", "SMALL")], p.schema)
    return Catalog(spark, root).get("parts").put(new).delete([1, 12345678901]).docs


@query("SELECT 'parts' AS name, count(*) AS docs FROM part UNION ALL SELECT 'suppliers', count(*) FROM supplier")
def catalog_health(spark, d):
    catalog = Catalog(spark, scratch_path(spark, "catalog"))
    catalog.create("parts", table(spark, d, "part"), {"p_name": "text"}, "p_partkey")
    catalog.create("suppliers", table(spark, d, "supplier"), {"s_name": "text"}, "s_suppkey")
    return catalog.health()


STREAM = r"""t AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+(?:[''\-][\p{L}\p{N}]+)*'), lambda u: lower(u)) AS t FROM documents), p AS (SELECT doc_id, unnest(t) AS token, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS position FROM t)"""


@query(f"WITH {STREAM} SELECT doc_id, position, token, CAST(0 AS INTEGER) AS start_offset, CAST(len(token) AS INTEGER) AS end_offset, '<ALPHANUM>' AS type FROM p")
def analyzed_tokens(spark, d):
    return token_stream(table(spark, d, "documents"))


def documents(spark, d) -> SearchIndex:
    return SearchIndex(table(spark, d, "documents"), {"text": "text", "lang": "keyword", "source": "keyword", "n_chars": "numeric"})


MATCHED = f"""WITH {STREAM}, q(token) AS (VALUES ('thanon'), ('keit')), tf AS (SELECT token, doc_id, count(*) AS tf FROM p JOIN q USING (token) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
coll AS (SELECT count(*) AS n, avg(CASE WHEN len(t) > 0 THEN len(t) ELSE 4 END) AS avgdl FROM t),
s AS (SELECT tf.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avgdl))), 6) AS score FROM tf JOIN df USING (token) JOIN t USING (doc_id), coll GROUP BY tf.doc_id)"""


@query(f"{MATCHED} SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 15")
def dsl_url_parameters(spark, d):
    """?q=thanon+Keit&df=text&size=15"""
    return documents(spark, d).page(url_body({"q": ["thanon Keit"], "df": ["text"], "size": ["15"]}))


@query(f"{MATCHED}, h AS (SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 10) SELECT doc_id, score, lang, n_chars FROM h JOIN documents USING (doc_id)")
def dsl_hit_records(spark, d):
    """Hits over all text fields, with their records."""
    hits = documents(spark, d).hit_records(url_body({"q": "the thanon Keit"}))
    return hits.select("doc_id", "score", "record.lang", "record.n_chars")


@query("""WITH w(term) AS (VALUES ('the'), ('thanon'), ('und'), ('absentword')), tok AS (SELECT doc_id, list_distinct(list_transform(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda u: trim(u, '.,!?;:''"()'))) AS t FROM documents),
c AS (SELECT term, count(doc_id) AS df FROM w LEFT JOIN tok ON list_contains(t, term) GROUP BY term) SELECT term, df, CAST(row_number() OVER (ORDER BY df, term) AS INTEGER) AS place FROM c""")
def rarest_first(spark, d):
    words = ["the", "thanon", "und", "absentword"]
    return boolean.by_rarity(ix.term_frequencies(table(spark, d, "documents"), words), words)


# --- timings and clicks -------------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM events WHERE value IS NOT NULL GROUP BY event_type")
def timing_stats(spark, d):
    """The events' values as times."""
    own = evaluation.timing_stats(table(spark, d, "events"), "event_type", "value")
    return own.withColumns({c: F.round(c, 6) for c in ("mean", "median")})


@query("SELECT date_trunc('hour', ts) AS start, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, round(count(*) FILTER (event_type = 'click') / nullif(count(*) FILTER (event_type = 'view'), 0), 6) AS rate FROM events GROUP BY ALL")
def click_log(spark, d):
    own = evaluation.click_log(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return own.select(F.col("start").cast("timestamp_ntz").alias("start"), "views", "clicks", F.round("rate", 6).alias("rate"))


# --- vectors and clusters -----------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])), 5) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10""")
def collection_search(spark, d):
    """A collection that is recreated, filled in two parts and searched."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    held = vectors.Collections(spark, scratch_path(spark, "collections"))
    held.recreate("all")
    for k in range(2):
        held.insert("all", e.filter(F.pmod("vec_id", F.lit(2)) == k))
    return held.search("all", [float(x) for x in e.filter("vec_id = 0").first().embedding], 10)


@query()
def semantic_search_index(spark, d):
    """A search without a category reads the inverted file."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"))
    return vectors.SemanticSearch(p).build(scratch_path(spark, "semantic"), index=True).search("red widget", 10)


@query()
def cluster_quality(spark, d):
    """(kind, k, silhouette) of flat and hierarchical clusters of the documents."""
    rows = materialise(learning.hashed_tfidf(table(spark, d, "documents").select("doc_id", "text"), 1 << 10).select("doc_id", "features"), "features")
    found = [("hierarchy" if b else "flat", k, float(learning.kmeans_clusters(rows, k, bisecting=b)[1])) for b in (False, True) for k in (2, 4)]
    return spark.createDataFrame(found, "kind string, k int, silhouette double")
