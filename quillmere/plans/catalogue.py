"""All queries of the retrieval engine, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions.analyzers import standard, tokens_of
from quillmere.operators import boolean, compression, crawl, evaluation, fusion, learning, near_duplicates, ranking, records, text_stats, vectors
from quillmere.operators import index as ix
from quillmere.operators.dsl import SearchIndex
from quillmere.plans import services
from quillmere.sources import formats
from quillmere.sources.scratch import materialise, scratch_path
from quillmere.streaming import tail

QUERIES: dict = {}
SQL: dict[str, str] = {}

TOK = r"""tok AS (SELECT doc_id, list_filter(list_transform(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda u: trim(u, '.,!?;:''"()')), lambda u: u <> '') AS t FROM documents)"""
POS = "pos AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pl FROM tok)"
TF = "tf AS (SELECT term, doc_id, count(*) AS tf FROM pos GROUP BY term, doc_id)"
DF = "df AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term)"
COLL = "coll AS (SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS total, sum(len(t)) / count(*) AS avgdl FROM tok)"
BASE = f"WITH {TOK}, {POS}, {TF}, {DF}, {COLL}"
STD = r"""std AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+(?:[''\-][\p{L}\p{N}]+)*'), lambda u: lower(u)) AS t FROM documents)"""

ASKED = {"q1": "the erening anerinen", "q2": "de la que la", "q3": "und der keit", "q4": "thanon, THE reresh!", "q5": "eaux dans nothing"}
ONE = "the erening anerinen the"


def query(sql: str | None = None):
    def held(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return held


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def asked_sql(queries: dict[str, str]) -> str:
    rows = ", ".join(f"('{q}', '{t}', {n})" for q, s in queries.items() for t, n in Counter(tokens_of(s)).items())
    return f"q(qid, term, qtf) AS (VALUES {rows})"


def bm25_sql(queries: dict[str, str], k1: str = "1.2", b: str = "0.75") -> str:
    return f"""{BASE}, {asked_sql(queries)}, s AS (SELECT qid, tf.doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * len(t) / avgdl))) AS score
FROM tf JOIN q USING (term) JOIN df USING (term) JOIN tok USING (doc_id), coll GROUP BY qid, tf.doc_id)"""


TOP = "SELECT qid, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10"

# --- text statistics ----------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, CAST(len(text) - len(replace(text, chr(10), '')) + CASE WHEN text <> '' AND text NOT LIKE '%' || chr(10) THEN 1 ELSE 0 END AS BIGINT) AS n_lines,
CAST(len(list_filter(string_split_regex(text, '\s+'), lambda u: u <> '')) AS BIGINT) AS n_words, CAST(len(text) AS BIGINT) AS n_chars FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""")
def text_stats_counts(spark, d):
    return text_stats.count_stats(docs(spark, d))


@query(f"WITH {TOK}, {POS} SELECT term AS word, count(*) AS n FROM pos GROUP BY term ORDER BY n DESC, min((doc_id, pl)) LIMIT 25")
def top_words(spark, d):
    return text_stats.top_words(docs(spark, d), 25)


@query(r"""SELECT doc_id, CAST(pl - 1 AS BIGINT) AS line_no, trim(line) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pl FROM documents) WHERE contains(line, 'License')""")
def find_lines(spark, d):
    return text_stats.find_lines(docs(spark, d), "License")


@query(f"WITH {TOK} SELECT doc_id FROM tok WHERE list_contains(t, 'thanon')")
def term_scan(spark, d):
    return text_stats.scan_for_term(docs(spark, d), "thanon")


@query(f"""WITH {TOK}, p(typed, written) AS (VALUES ('the', 'der'), ('nothing', 'la'), ('und', 'absent')), w AS (SELECT typed AS term FROM p UNION SELECT written FROM p),
df AS MATERIALIZED (SELECT term, count(*) AS df FROM w JOIN tok ON list_contains(t, term) GROUP BY term)
SELECT typed, written, coalesce(a.df, 0) AS typed_df, coalesce(b.df, 0) AS written_df FROM p LEFT JOIN df a ON a.term = typed LEFT JOIN df b ON b.term = written""")
def vocabulary_gap(spark, d):
    return text_stats.vocabulary_gap(docs(spark, d), [("the", "der"), ("nothing", "la"), ("und", "absent")])


@query("SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def coverage_gap(spark, d):
    """Customers with orders that are outside a segment."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return text_stats.uncovered(orders, table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'"), "c_custkey")


# --- index --------------------------------------------------------------------------------------------------------


@query(f"{BASE} SELECT term, doc_id, tf FROM tf")
def inverted_index_tf(spark, d):
    return ix.term_frequencies(docs(spark, d))


@query(f"{BASE} SELECT term, CAST(len(doc_ids) AS BIGINT) AS df, doc_ids[1] AS first_doc, doc_ids[-1] AS last_doc FROM (SELECT term, list_sort(list(doc_id)) AS doc_ids FROM tf GROUP BY term)")
def inverted_index(spark, d):
    rows = ix.postings(ix.term_frequencies(docs(spark, d)))
    return rows.select("term", F.size("doc_ids").cast("bigint").alias("df"), F.element_at("doc_ids", 1).alias("first_doc"), F.element_at("doc_ids", -1).alias("last_doc"))


@query(f"{BASE} SELECT term, doc_id, CAST(min(pl) AS INTEGER) AS first_at, CAST(max(pl) AS INTEGER) AS last_at, count(*) AS tf FROM pos GROUP BY term, doc_id")
def positional_index(spark, d):
    rows = ix.positions(docs(spark, d))
    return rows.select("term", "doc_id", F.array_min("positions").alias("first_at"), F.array_max("positions").alias("last_at"), F.size("positions").cast("bigint").alias("tf"))


@query(f"{BASE} SELECT term, df, cf FROM df")
def doc_freq(spark, d):
    return ix.term_stats(ix.term_frequencies(docs(spark, d)))


@query(f"{BASE} SELECT n, total, round(avgdl, 6) AS avgdl FROM coll")
def collection_stats(spark, d):
    return ix.collection_stats(ix.doc_lengths(docs(spark, d))).select("n", "total", F.round("avgdl", 6).alias("avgdl"))


@query(f"{BASE} SELECT doc_id, CAST(len(t) AS BIGINT) AS dl FROM tok")
def doc_lengths(spark, d):
    return ix.doc_lengths(docs(spark, d))


@query(f"{BASE} SELECT count(*) AS n_terms FROM df")
def distinct_terms(spark, d):
    return ix.term_frequencies(docs(spark, d)).agg(F.countDistinct("term").alias("n_terms"))


@query(f"{BASE} SELECT doc_id, tf FROM tf WHERE term = 'thanon'")
def index_lookup(spark, d):
    return ix.Index.build(docs(spark, d), scratch_path(spark, "index")).lookup("thanon")


@query(f"{BASE} SELECT term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, coll")
def idf_table(spark, d):
    tf = ix.term_frequencies(docs(spark, d))
    n = F.broadcast(docs(spark, d).agg(F.count("*").alias("n")))
    return ix.term_stats(tf).crossJoin(n).select("term", F.round(ix.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(f"WITH {STD} SELECT term, count(*) AS n FROM (SELECT unnest(t) AS term FROM std) GROUP BY term")
def standard_tokens(spark, d):
    return docs(spark, d).select(F.explode(standard("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


# --- Boolean retrieval --------------------------------------------------------------------------------------------

BOOLEAN = {
    "bool_and": ("the AND und", "list_contains(t, 'the') AND list_contains(t, 'und')"),
    "bool_or": ("keit OR aux", "list_contains(t, 'keit') OR list_contains(t, 'aux')"),
    "bool_not": ("the NOT thanon", "list_contains(t, 'the') AND NOT list_contains(t, 'thanon')"),
    "bool_only_not": ("NOT the", "NOT list_contains(t, 'the')"),
    "bool_nested_dnf": ("the not reti or la und", "(list_contains(t, 'the') AND NOT list_contains(t, 'reti')) OR (list_contains(t, 'la') AND list_contains(t, 'und'))"),
    "bool_not_and": ("NOT AND the OR NOT NOT la", "list_contains(t, 'the') OR NOT list_contains(t, 'la')"),
}
for _name, (_query, _sql) in BOOLEAN.items():
    QUERIES[_name] = lambda spark, d, q=_query: boolean.search(docs(spark, d), q)
    SQL[_name] = f"WITH {TOK} SELECT doc_id FROM tok WHERE {_sql}"


@query(f"WITH {TOK} SELECT doc_id FROM tok WHERE (list_contains(t, 'the') AND NOT list_contains(t, 'reti')) OR NOT list_contains(t, 'la')")
def bool_index(spark, d):
    return boolean.search_index(ix.term_frequencies(docs(spark, d), ["the", "reti", "la"]), docs(spark, d), "the NOT reti OR NOT la")


@query(rf"WITH {TOK} SELECT doc_id FROM tok WHERE list_contains(t, 'the') AND NOT (list_contains(t, 'la') OR list_contains(t, 'reti')) AND contains(' ' || array_to_string(t, ' ') || ' ', ' is the ')")
def bool_phrase(spark, d):
    return boolean.search_nested(docs(spark, d), 'the AND NOT (la OR reti) AND "is the"')


@query(f"WITH {TOK} SELECT doc_id FROM tok WHERE list_contains(t, 'the') AND list_contains(t, 'of') AND NOT list_contains(t, 'thanon') UNION SELECT doc_id FROM tok WHERE list_contains(t, 'keit')")
def set_operations(spark, d):
    tf = ix.term_frequencies(docs(spark, d), ["the", "of", "thanon", "keit"])
    of = lambda t: tf.filter(F.col("term") == t)
    return boolean.union(boolean.subtract(boolean.intersect(of("the"), of("of")), of("thanon")), of("keit"))


# --- ranking ------------------------------------------------------------------------------------------------------


@query(f"{bm25_sql(ASKED)} {TOP}")
def bm25_topk(spark, d):
    own = docs(spark, d)
    return ranking.top_k(ranking.bm25(own, ASKED, rows=ranking.written(own, ASKED)), 10)


@query(f"{bm25_sql({'q': ONE})} SELECT 'q' AS qid, tok.doc_id, round(coalesce(score, 0.0), 6) AS score FROM tok LEFT JOIN s ON s.doc_id = tok.doc_id")
def bm25_all_docs(spark, d):
    own, asked = docs(spark, d), {"q": ONE}
    return ranking.with_zeros(own, asked, ranking.bm25(own, asked, rows=ranking.written(own, asked))).withColumn("score", F.round("score", 6))


@query(f"""{BASE}, {asked_sql({"q": ONE})}, g(k1, b) AS (SELECT * FROM (VALUES (0.9), (1.2), (1.6)), (VALUES (0.3), (0.75), (1.0))), known AS (SELECT count(*) AS known FROM q JOIN df USING (term)),
m AS (SELECT doc_id, count(*) AS c FROM tf JOIN q USING (term) GROUP BY doc_id), gr AS (SELECT doc_id, CASE WHEN c * 2 >= known THEN c ELSE 0 END AS grade FROM m, known),
s AS (SELECT k1, b, tf.doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / avgdl))), 9) AS score FROM tf JOIN q USING (term) JOIN df USING (term) JOIN tok USING (doc_id), coll, g GROUP BY k1, b, tf.doc_id),
r AS (SELECT k1, b, grade, row_number() OVER (PARTITION BY k1, b ORDER BY score DESC, doc_id) AS rank FROM s JOIN gr USING (doc_id) WHERE score > 0 QUALIFY rank <= 10),
i AS (SELECT grade, row_number() OVER (ORDER BY grade DESC) AS place FROM gr WHERE grade > 0 QUALIFY place <= 10), di AS (SELECT sum((pow(2, grade) - 1) / log2(place + 1)) AS best FROM i),
dc AS (SELECT k1, b, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM r GROUP BY k1, b) SELECT CAST(k1 AS DOUBLE) AS k1, CAST(b AS DOUBLE) AS b, round(dcg / best, 6) AS ndcg FROM dc, di""")
def bm25_grid(spark, d):
    return ranking.bm25_grid(docs(spark, d), ONE, [0.9, 1.2, 1.6], [0.3, 0.75, 1.0])


@query(f"""{BASE}, {asked_sql(ASKED)}, w AS (SELECT term, doc_id, (1 + ln(tf)) * ln(1 + (n - df + 0.5) / (df + 0.5)) AS w, ln(1 + (n - df + 0.5) / (df + 0.5)) AS wq FROM tf JOIN df USING (term), coll),
nd AS (SELECT doc_id, sqrt(sum(w * w)) AS nd FROM w GROUP BY doc_id), nq AS (SELECT qid, sqrt(sum(wq * wq)) AS nq FROM (SELECT DISTINCT qid, term, wq FROM q JOIN w USING (term)) GROUP BY qid),
s AS (SELECT qid, w.doc_id, sum(w * wq) / (any_value(nd) * any_value(nq)) AS score FROM w JOIN q USING (term) JOIN nd USING (doc_id) JOIN nq USING (qid) GROUP BY qid, w.doc_id) {TOP}""")
def tfidf_topk(spark, d):
    return ranking.top_k(ranking.tfidf(docs(spark, d), ASKED), 10)


@query(f"""{BASE}, {asked_sql(ASKED)}, bg AS (SELECT qid, term, qtf, (coalesce(cf, 0) + 200 * 0.0001) / (total + 200) AS bg FROM q LEFT JOIN df USING (term), coll),
s AS (SELECT qid, tok.doc_id, sum(qtf * ln((coalesce(tf, 0) + 200 * bg) / (len(t) + 200))) AS score FROM tok CROSS JOIN bg LEFT JOIN tf ON tf.doc_id = tok.doc_id AND tf.term = bg.term GROUP BY qid, tok.doc_id) {TOP}""")
def ql_topk(spark, d):
    own = docs(spark, d)
    return ranking.top_k(ranking.query_likelihood(own, ASKED, rows=ranking.written(own, ASKED)), 10)


QRELS = """qr AS (SELECT 'q' || unnest(range(1, 6)) AS qid), qrels AS (SELECT qid, doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END AS grade FROM qr, labels WHERE doc_id % 5 = CAST(substr(qid, 2) AS INTEGER) - 1)"""


def judgements(spark, d) -> DataFrame:
    """Stand-in judgements: each labelled document is judged for one query, graded by its labels."""
    grade = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).when(F.col("quality") == 1, 1).otherwise(0)
    return table(spark, d, "labels").select(F.concat(F.lit("q"), F.col("doc_id") % 5 + 1).alias("qid"), "doc_id", grade.alias("grade"))


METRIC_SQL = f"""{bm25_sql(ASKED)}, run AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s QUALIFY rank <= 100), {QRELS},
g AS (SELECT run.qid, rank, coalesce(grade, 0) AS grade, CASE WHEN coalesce(grade, 0) > 0 THEN 1 ELSE 0 END AS rel FROM run LEFT JOIN qrels USING (qid, doc_id)),
h AS (SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY rank) AS hits FROM g),
o AS (SELECT qid, count(*) FILTER (grade > 0) AS n_rel, sum((pow(2, grade) - 1) / log2(place + 1)) FILTER (place <= 10) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, doc_id) AS place FROM qrels) GROUP BY qid HAVING count(*) FILTER (grade > 0) > 0),
m AS (SELECT o.qid, coalesce(sum(rel) FILTER (rank <= 10) / nullif(count(rank) FILTER (rank <= 10), 0), 0.0) AS p_at_k, coalesce(sum(rel) FILTER (rank <= 10) / any_value(n_rel), 0.0) AS r_at_k,
 coalesce(sum(rel) FILTER (rank <= n_rel) / nullif(count(rank) FILTER (rank <= n_rel), 0), 0.0) AS r_precision, coalesce(1 / min(rank) FILTER (rel > 0), 0.0) AS rr, coalesce(sum(hits / rank) FILTER (rel > 0) / any_value(n_rel), 0.0) AS ap,
 coalesce(sum((pow(2, grade) - 1) / log2(rank + 1)) FILTER (rank <= 10) / any_value(idcg), 0.0) AS ndcg FROM o LEFT JOIN h USING (qid) GROUP BY o.qid)"""


def bm25_run(spark, d) -> DataFrame:
    own = docs(spark, d)
    return materialise(ranking.top_k(ranking.bm25(own, ASKED, rows=ranking.written(own, ASKED)), 100), "run")


@query(f"{METRIC_SQL} SELECT qid, round(p_at_k, 6) AS p_at_k, round(r_at_k, 6) AS r_at_k, round(coalesce(2 * p_at_k * r_at_k / nullif(p_at_k + r_at_k, 0), 0.0), 6) AS f1_at_k, round(r_precision, 6) AS r_precision, round(rr, 6) AS rr, round(ap, 6) AS ap, round(ndcg, 6) AS ndcg FROM m")
def metrics_per_query(spark, d):
    m = evaluation.per_query(bm25_run(spark, d), judgements(spark, d))
    return m.select("qid", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


@query(f"{METRIC_SQL} SELECT count(*) AS n_queries, {', '.join(f'round(avg({m}), 6) AS {m}' for m in evaluation.METRICS)} FROM m")
def metrics_mean(spark, d):
    m = evaluation.evaluate(bm25_run(spark, d), judgements(spark, d))
    return m.select("n_queries", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


def _means(name: str, scores: str) -> str:
    """The metrics of a ranker's run, from its scores (qid, doc_id, score)."""
    return f"""run_{name} AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM {scores} QUALIFY rank <= 100),
g_{name} AS (SELECT run_{name}.qid, rank, coalesce(grade, 0) AS grade, CASE WHEN coalesce(grade, 0) > 0 THEN 1 ELSE 0 END AS rel FROM run_{name} LEFT JOIN qrels USING (qid, doc_id)),
h_{name} AS (SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY rank) AS hits FROM g_{name}),
m_{name} AS (SELECT o.qid, coalesce(sum(rel) FILTER (rank <= 10) / nullif(count(rank) FILTER (rank <= 10), 0), 0.0) AS p_at_k, coalesce(sum(rel) FILTER (rank <= 10) / any_value(n_rel), 0.0) AS r_at_k,
 coalesce(sum(rel) FILTER (rank <= n_rel) / nullif(count(rank) FILTER (rank <= n_rel), 0), 0.0) AS r_precision, coalesce(1 / min(rank) FILTER (rel > 0), 0.0) AS rr, coalesce(sum(hits / rank) FILTER (rel > 0) / any_value(n_rel), 0.0) AS ap,
 coalesce(sum((pow(2, grade) - 1) / log2(rank + 1)) FILTER (rank <= 10) / any_value(idcg), 0.0) AS ndcg FROM o JOIN h_{name} USING (qid) GROUP BY o.qid)"""


MEAN = lambda name: f"SELECT '{name}' AS ranker, count(*) AS n_queries, {', '.join(f'round(coalesce(avg({m}), 0.0), 6) AS {m}' for m in evaluation.METRICS)} FROM m_{name}"
JUDGED = "o AS (SELECT qid, count(*) FILTER (grade > 0) AS n_rel, sum((pow(2, grade) - 1) / log2(place + 1)) FILTER (place <= 10) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, doc_id) AS place FROM qrels) GROUP BY qid HAVING count(*) FILTER (grade > 0) > 0)"


@query(f"""{bm25_sql(ASKED)}, sb AS (SELECT qid, doc_id, score FROM s), w AS (SELECT term, doc_id, (1 + ln(tf)) * ln(1 + (n - df + 0.5) / (df + 0.5)) AS w, ln(1 + (n - df + 0.5) / (df + 0.5)) AS wq FROM tf JOIN df USING (term), coll),
nd AS (SELECT doc_id, sqrt(sum(w * w)) AS nd FROM w GROUP BY doc_id), nq AS (SELECT qid, sqrt(sum(wq * wq)) AS nq FROM (SELECT DISTINCT qid, term, wq FROM q JOIN w USING (term)) GROUP BY qid),
st AS (SELECT qid, w.doc_id, sum(w * wq) / (any_value(nd) * any_value(nq)) AS score FROM w JOIN q USING (term) JOIN nd USING (doc_id) JOIN nq USING (qid) GROUP BY qid, w.doc_id),
bg AS (SELECT qid, term, qtf, (coalesce(cf, 0) + 200 * 0.0001) / (total + 200) AS bg FROM q LEFT JOIN df USING (term), coll),
sq AS (SELECT qid, tok.doc_id, sum(qtf * ln((coalesce(tf, 0) + 200 * bg) / (len(t) + 200))) AS score FROM tok CROSS JOIN bg LEFT JOIN tf ON tf.doc_id = tok.doc_id AND tf.term = bg.term GROUP BY qid, tok.doc_id), {QRELS}, {JUDGED},
{_means("bm25", "sb")}, {_means("tfidf", "st")}, {_means("ql", "sq")} {MEAN("bm25")} UNION ALL {MEAN("tfidf")} UNION ALL {MEAN("ql")}""")
def ranker_comparison(spark, d):
    own = docs(spark, d)
    rows = ranking.written(own, ASKED)
    runs = {"bm25": ranking.run_bm25(own, ASKED, rows=rows), "tfidf": ranking.run_tfidf(own, ASKED), "ql": ranking.top_k(ranking.query_likelihood(own, ASKED, rows=rows), 100)}
    m = evaluation.compare({n: materialise(r, n) for n, r in runs.items()}, judgements(spark, d))
    return m.select("ranker", "n_queries", *[F.round(c, 6).alias(c) for c in evaluation.METRICS])


@query("""SELECT qid, doc_id, CASE WHEN (SELECT count(*) FROM unnest(words) AS u(w) WHERE contains(lower(text), w)) >= 2 THEN 2 ELSE 1 END AS grade
FROM documents JOIN (VALUES ('a', ['the', 'anon'], 'en'), ('b', ['und', 'keit'], 'de')) AS q(qid, words, want) ON lang = want""")
def qrels_synthesis(spark, d):
    return evaluation.synthetic_qrels(table(spark, d, "documents"), {"a": ("the anon", "en"), "b": ("und keit", "de")}, topic="lang")


@query(f"""{bm25_sql(ASKED)}, b AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s QUALIFY rank <= 50),
bg AS (SELECT qid, term, qtf, (coalesce(cf, 0) + 200 * 0.0001) / (total + 200) AS bg FROM q LEFT JOIN df USING (term), coll),
l AS (SELECT qid, tok.doc_id, sum(qtf * ln((coalesce(tf, 0) + 200 * bg) / (len(t) + 200))) AS score FROM tok CROSS JOIN bg LEFT JOIN tf ON tf.doc_id = tok.doc_id AND tf.term = bg.term GROUP BY qid, tok.doc_id),
lr AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM l QUALIFY rank <= 50),
f AS (SELECT qid, doc_id, round(sum(1 / (60 + rank)), 6) AS score FROM (SELECT * FROM b UNION ALL SELECT * FROM lr) GROUP BY qid, doc_id)
SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 10""")
def rrf_hybrid(spark, d):
    own = docs(spark, d)
    rows = ranking.written(own, ASKED)
    a = ranking.top_k(ranking.bm25(own, ASKED, rows=rows), 50)
    b = ranking.top_k(ranking.query_likelihood(own, ASKED, rows=rows), 50)
    return fusion.reciprocal_rank_fusion([a, b])


@query()
def learned_ranker(spark, d):
    """Two-stage ranking: BM25 candidates, reranked by a pairwise model of three scores."""
    own = docs(spark, d)
    first = bm25_run(spark, d)
    read = ranking.written(own, ASKED)
    scores = {"bm25": ranking.bm25(own, ASKED, rows=read), "tfidf": ranking.tfidf(own, ASKED), "ql": ranking.query_likelihood(own, ASKED, rows=read)}
    rows = first.select("qid", "doc_id")
    for name, own_scores in scores.items():
        rows = rows.join(fusion.min_max(own_scores).select("qid", "doc_id", F.col("score").alias(name)), ["qid", "doc_id"], "left").fillna(0.0, [name])
    rows = materialise(rows, "features")
    judged = rows.join(judgements(spark, d), ["qid", "doc_id"])
    weights = learning.pairwise_ranker(judged, list(scores))
    return fusion.two_stage(first, learning.rank_with(rows, weights)).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


# --- compression --------------------------------------------------------------------------------------------------

NUM = f"{BASE}, num AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents), ip AS (SELECT term, n FROM tf JOIN num USING (doc_id)), gp AS (SELECT term, n, n - coalesce(lag(n) OVER (PARTITION BY term ORDER BY n), 0) AS gap FROM ip)"
VARINT = "CASE WHEN gap < 128 THEN 1 WHEN gap < 16384 THEN 2 WHEN gap < 2097152 THEN 3 WHEN gap < 268435456 THEN 4 ELSE 5 END"


def int_postings(spark, d) -> DataFrame:
    return compression.numbered_postings(docs(spark, d))


@query(f"{NUM} SELECT term, n, gap FROM gp")
def postings_delta(spark, d):
    return compression.gaps(int_postings(spark, d))


@query(f"{NUM} SELECT term, n FROM ip")
def postings_delta_decoded(spark, d):
    g = compression.ranked(int_postings(spark, d)).select("term", "k", (F.col("n") - F.coalesce("before", F.lit(0))).alias("gap"))
    return compression.undo_gaps(g).select("term", "n")


@query(f"{NUM} SELECT term, CAST(sum({VARINT}) AS BIGINT) AS packed_bytes FROM gp GROUP BY term")
def varint_size(spark, d):
    g = compression.gaps(int_postings(spark, d))
    return g.groupBy("term").agg(F.sum(compression.varint_size(F.col("gap"))).alias("packed_bytes"))


@query(f"{NUM} SELECT term, CAST(sum({VARINT}) AS BIGINT) AS packed_bytes, true AS same FROM gp GROUP BY term")
def varint_round_trip(spark, d):
    packed = materialise(compression.compress(compression.lists(int_postings(spark, d))), "packed")
    return compression.decompress(packed, "back").select("term", F.length("packed").cast("bigint").alias("packed_bytes"), (F.col("docs") == F.col("back")).alias("same"))


@query(f"{NUM} SELECT count(*) * 4 AS raw_bytes, CAST(sum({VARINT}) AS BIGINT) AS packed_bytes, round(count(*) * 4 / sum({VARINT}), 6) AS ratio FROM gp")
def compression_ratio(spark, d):
    return compression.compression_totals(int_postings(spark, d))


@query(f"{NUM} SELECT term, CAST(k // 32 * 32 AS BIGINT) AS start, max(n) AS max_n FROM (SELECT term, n, row_number() OVER (PARTITION BY term ORDER BY n) - 1 AS k FROM ip) GROUP BY term, k // 32")
def skip_list(spark, d):
    return compression.skip_list(int_postings(spark, d))


@query(f"""{NUM}, a AS (SELECT n FROM ip WHERE term = 'the'), b AS (SELECT n FROM ip WHERE term = 'und'), z AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb),
small AS (SELECT n FROM a, z WHERE na <= nb UNION ALL SELECT n FROM b, z WHERE na > nb), big AS (SELECT n, row_number() OVER (ORDER BY n) AS place FROM (SELECT n FROM b, z WHERE na <= nb UNION ALL SELECT n FROM a, z WHERE na > nb))
SELECT count(place) AS hits, CAST(coalesce(sum(coalesce(place, greatest(na, nb))), 0) AS BIGINT) AS examined FROM small LEFT JOIN big USING (n), z""")
def comparisons_plain(spark, d):
    return compression.comparisons_plain(*two_lists(spark, d))


SKIPS = f"""{NUM}, a AS (SELECT n FROM ip WHERE term = 'the'), b AS (SELECT n FROM ip WHERE term = 'und'), z AS (SELECT (SELECT count(*) FROM a) <= (SELECT count(*) FROM b) AS first),
small AS (SELECT n FROM a, z WHERE first UNION ALL SELECT n FROM b, z WHERE NOT first), big AS (SELECT n FROM b, z WHERE first UNION ALL SELECT n FROM a, z WHERE NOT first), m AS (SELECT count(*) AS m FROM big),
pl AS (SELECT n, (SELECT count(*) FROM big WHERE big.n < small.n) AS spot, n IN (SELECT n FROM big) AS hit FROM small),
bk AS (SELECT n, hit, spot >= m AS beyond, CASE WHEN spot >= m THEN (m + 31) // 32 ELSE spot // 32 END AS block, CASE WHEN spot >= m THEN 0 ELSE spot % 32 END AS steps FROM pl, m),
sk AS (SELECT n, hit, block - coalesce(lag(block) OVER (ORDER BY n), 0) AS jumps, steps, coalesce(lag(beyond) OVER (ORDER BY n), false) AS ended FROM bk)"""


@query(f"{SKIPS} SELECT count(*) FILTER (hit) AS hits, CAST(sum(jumps + steps + CAST(hit AS INTEGER)) AS BIGINT) AS examined FROM sk WHERE NOT ended")
def comparisons_skips(spark, d):
    return compression.comparisons_skips(*two_lists(spark, d))


@query(f"{SKIPS} SELECT n, CAST(jumps AS BIGINT) AS jumps, CAST(steps AS BIGINT) AS steps FROM sk WHERE hit AND NOT ended")
def skip_intersect(spark, d):
    return compression.intersect_skips(*two_lists(spark, d)).filter("hit").select("n", "jumps", F.col("steps").cast("bigint").alias("steps"))


def two_lists(spark, d) -> list[DataFrame]:
    p = materialise(compression.integer_postings(ix.term_frequencies(docs(spark, d), ["the", "und"]), docs(spark, d)), "lists")
    return [p.filter(F.col("term") == t).select("n") for t in ("the", "und")]


def scored_postings(spark, d, terms: list[str]) -> DataFrame:
    """(term, n, score): BM25 parts of single terms."""
    texts, asked = docs(spark, d), {t: t for t in terms}
    own = ranking.bm25(texts, asked, rows=ranking.written(texts, asked)).select(F.col("qid").alias("term"), "doc_id", F.round("score", 6).alias("score"))
    return materialise(own.join(compression.numbered(docs(spark, d)), "doc_id").select("term", "n", "score"), "scored")


SCORED = f"{bm25_sql({'the': 'the', 'of': 'of'})}, num AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents), sp AS (SELECT qid AS term, n, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY n) - 1 AS k FROM s JOIN num USING (doc_id))"


@query(f"{SCORED} SELECT term, CAST(k // 128 * 128 AS BIGINT) AS start, CAST(k // 128 * 128 + count(*) AS BIGINT) AS \"end\", max(n) AS max_n, max(score) AS max_score FROM sp GROUP BY term, k // 128")
def block_max(spark, d):
    return compression.blocks(scored_postings(spark, d, ["the", "of"]))


@query(f"""{SCORED}, bl AS (SELECT term, n, max(score) OVER (PARTITION BY term, k // 128) AS top FROM sp), u AS (SELECT DISTINCT n FROM sp),
fr AS (SELECT n, (SELECT arg_min(top, bl.n) FROM bl WHERE term = 'the' AND bl.n >= u.n) AS f0, (SELECT arg_min(top, bl.n) FROM bl WHERE term = 'of' AND bl.n >= u.n) AS f1 FROM u),
st AS (SELECT coalesce(min(n), 9223372036854775807) AS until FROM fr WHERE f0 IS NULL OR f1 IS NULL OR greatest(f0, f1) < 0.2)
SELECT CAST(a.n AS VARCHAR) AS doc, round(a.top + b.top, 6) AS score FROM bl a JOIN bl b ON a.n = b.n AND a.term = 'the' AND b.term = 'of', st WHERE a.n < until ORDER BY score DESC, a.n LIMIT 10""")
def wand_demo(spark, d):
    return compression.wand_demo(scored_postings(spark, d, ["the", "of"]), ["the", "of"], 0.2)


@query(f"{SCORED} SELECT n, round(sum(score), 6) AS score FROM sp GROUP BY n ORDER BY score DESC, n LIMIT 10")
def topk_blockmax_safe(spark, d):
    return compression.top_k_block_max(scored_postings(spark, d, ["the", "of"]), 10)


# --- vectors ------------------------------------------------------------------------------------------------------


def first_vector(spark, d) -> list[float]:
    return list(table(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()[0])


QV = "q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0)"
COS = "list_inner_product(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[]))"


@query(f"WITH {QV} SELECT vec_id, round({COS}, 5) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10")
def knn_exact(spark, d):
    return vectors.exact_top_k(table(spark, d, "embeddings"), first_vector(spark, d), 10)


@query(f"WITH {QV} SELECT vec_id, round({COS}, 5) AS score FROM embeddings, q WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10")
def knn_filtered(spark, d):
    return vectors.exact_top_k(table(spark, d, "embeddings"), first_vector(spark, d), 10, where=F.col("label") == 3)


@query(f"WITH qs AS (SELECT vec_id AS qid, embedding AS qe FROM embeddings WHERE vec_id % 20 = 0) SELECT qid, vec_id, round({COS}, 5) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round({COS}, 5) DESC, vec_id) AS INTEGER) AS rank FROM embeddings, qs QUALIFY rank <= 5")
def knn_batch(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.batch_top_k(e, e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query")), 5)


@query(f"WITH {QV} SELECT vec_id, round((2 - (list_distance(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])) ** 2)) / 2, 4) AS score FROM embeddings, q")
def l2_cosine(spark, d):
    q = F.lit([float(x) for x in first_vector(spark, d)])
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.cosine_from_l2(vectors.l2_squared("embedding", q)), 4).alias("score"))


@query(f"WITH {QV} SELECT vec_id, round({COS}, 5) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 5")
def ivf_all_cells(spark, d):
    """Every cell probed and everything reranked: the exact answer."""
    e = table(spark, d, "embeddings")
    model = vectors.IvfPq.fit(e)
    return model.search(model.index(e), first_vector(spark, d), 5, nprobe=len(model.centres), rerank=None)


def ann_queries(e):
    return e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))


@query()
def ann_batch(spark, d):
    """The index's neighbours of every row whose id is divisible by 20."""
    e = table(spark, d, "embeddings")
    model = vectors.IvfPq.fit(e, vectors.PARTITIONS, vectors.STRETCHES, vectors.CODES)
    return model.batch_search(model.write(e, scratch_path(spark, "cells")), ann_queries(e), 5)


@query()
def ann_agreement(spark, d):
    """One row: how many of the exact neighbours of those rows the index found, of how many, and the recall."""
    e = table(spark, d, "embeddings")
    both = vectors.agreement(ann_batch(spark, d), vectors.batch_top_k(e, ann_queries(e), 5), ["qid", "vec_id"])
    return both.withColumn("recall", F.try_divide("agreed", "asked"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0")
def similarity_matrix(spark, d):
    """Every row whose id is divisible by 20 (the fixed query set) against all rows."""
    e = table(spark, d, "embeddings")
    return vectors.similarity_matrix(e.filter("vec_id % 20 = 0"), every=e)


@query()
def semantic_search(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"))
    return vectors.SemanticSearch(p).build(scratch_path(spark, "semantic")).search("red widget", 10, category="ECONOMY")


@query()
def principal_axes(spark, d):
    rows = vectors.principal_axes(table(spark, d, "embeddings"))
    return rows.select("vec_id", *[F.round(F.col("coordinates")[k], 6).alias(f"axis{k + 1}") for k in range(2)])


# --- search DSL ---------------------------------------------------------------------------------------------------


def search_index(spark, d) -> SearchIndex:
    return SearchIndex(table(spark, d, "documents"), {"text": "text", "lang": "keyword", "source": "keyword", "n_chars": "numeric"})


def std_bm25(words: list[str], every: bool = False) -> str:
    rows = ", ".join(f"('{w}')" for w in words)
    return f"""WITH {STD}, q(term) AS (VALUES {rows}), p AS (SELECT doc_id, unnest(t) AS term FROM std), tf AS (SELECT term, doc_id, count(*) AS tf FROM p JOIN q USING (term) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
coll AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT CASE WHEN len(t) > 0 THEN len(t) ELSE 4 END AS dl FROM std)),
s AS (SELECT tf.doc_id, count(*) AS met, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avgdl))) AS score FROM tf JOIN df USING (term) JOIN std USING (doc_id), coll GROUP BY tf.doc_id{f" HAVING count(*) = {len(words)}" if every else ""})"""


HIT = "CAST(1.0 AS DOUBLE) AS score"
DSL = {
    "dsl_match_all": ({"query": {"match_all": {}}}, f"SELECT doc_id, {HIT} FROM documents"),
    "dsl_match": ({"query": {"match": {"text": "the thanon Keit"}}}, f"{std_bm25(['thanon', 'keit'])} SELECT doc_id, round(score, 6) AS score FROM s"),
    "dsl_match_and": ({"query": {"match": {"text": {"query": "und DER", "operator": "and"}}}}, f"{std_bm25(['und', 'der'], True)} SELECT doc_id, round(score, 6) AS score FROM s"),
    "dsl_term": ({"query": {"term": {"lang": "de"}}}, f"SELECT doc_id, {HIT} FROM documents WHERE lang = 'de'"),
    "dsl_terms": ({"query": {"terms": {"source": ["src1", "src7"]}}}, f"SELECT doc_id, {HIT} FROM documents WHERE source IN ('src1', 'src7')"),
    "dsl_range": ({"query": {"range": {"n_chars": {"gte": 500, "lt": 900}}}}, f"SELECT doc_id, {HIT} FROM documents WHERE n_chars >= 500 AND n_chars < 900"),
    "dsl_ids": ({"query": {"ids": {"values": [3, 5, "99999999"]}}}, f"SELECT doc_id, {HIT} FROM documents WHERE doc_id IN (3, 5)"),
    "dsl_function_score": ({"query": {"function_score": {"query": {"term": {"lang": "fr"}}, "functions": [{"weight": 2}, {"weight": 3.5}]}}}, "SELECT doc_id, CAST(3.5 AS DOUBLE) AS score FROM documents WHERE lang = 'fr'"),
    "dsl_bool": (
        {"query": {"bool": {"must": [{"match": {"text": "thanon keit"}}], "should": [{"term": {"source": "src1"}}], "must_not": [{"range": {"n_chars": {"gt": 4000}}}], "filter": [{"terms": {"lang": ["en", "de"]}}]}}},
        f"{std_bm25(['thanon', 'keit'])} SELECT doc_id, round(score + CASE WHEN source = 'src1' THEN 1.0 ELSE 0.0 END, 6) AS score FROM s JOIN documents USING (doc_id) WHERE lang IN ('en', 'de') AND NOT n_chars > 4000",
    ),
}
for _name, (_body, _sql) in DSL.items():
    QUERIES[_name] = lambda spark, d, b=_body: search_index(spark, d).hits(b)
    SQL[_name] = _sql


@query(f"SELECT doc_id, {HIT} FROM documents WHERE lang <> 'fr' AND lang <> ''")
def dsl_exists(spark, d):
    """French documents lose their language first, so that the field is missing somewhere."""
    rows = table(spark, d, "documents").withColumn("lang", F.nullif("lang", F.lit("fr")))
    return SearchIndex(rows, {"text": "text", "lang": "keyword"}).hits({"query": {"exists": {"field": "lang"}}})


@query("SELECT doc_id, CAST(1.0 AS DOUBLE) AS score FROM documents WHERE lang = 'de' ORDER BY n_chars DESC, doc_id LIMIT 7 OFFSET 3")
def dsl_page_sorted(spark, d):
    return search_index(spark, d).page({"query": {"term": {"lang": "de"}}, "sort": [{"n_chars": "desc"}], "from": 3, "size": 7})


@query(f"WITH {QV} SELECT vec_id AS doc_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])), 6) AS score FROM embeddings, q ORDER BY score DESC, doc_id LIMIT 10")
def dsl_knn(spark, d):
    own = SearchIndex(table(spark, d, "embeddings"), {"embedding": "knn_vector"}, key="vec_id")
    return own.hits({"knn": {"field": "embedding", "vector": first_vector(spark, d), "k": 10}})


@query("SELECT lang, count(*) AS n FROM documents WHERE NOT (lang = 'fr') OR lang IS NULL GROUP BY lang")
def dsl_delete_by_query(spark, d):
    return search_index(spark, d).delete_by_query({"term": {"lang": "fr"}}).docs.groupBy("lang").agg(F.count("*").alias("n"))


# --- records and formats ------------------------------------------------------------------------------------------


def parts(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("idx"), "p_name", "p_size", "p_retailprice")


@query("SELECT p_partkey AS idx, CASE WHEN p_partkey = 7 THEN 'renamed' ELSE p_name END AS p_name, p_size, p_retailprice FROM part")
def record_update(spark, d):
    return records.update_record(parts(spark, d), 7, "p_name", "renamed")


@query("SELECT p_partkey AS idx, p_name, p_size, p_retailprice FROM part WHERE NOT coalesce(p_size > 25, false)")
def record_delete(spark, d):
    return records.delete_records(parts(spark, d), F.col("p_size") > 25)


@query("SELECT CASE WHEN p_partkey >= 3 THEN p_partkey + 1 ELSE p_partkey END AS idx, p_name, p_size, p_retailprice FROM part UNION ALL SELECT 3, 'new', 5, 1.5")
def record_insert(spark, d):
    return records.insert_at(parts(spark, d), 3, {"p_name": "new", "p_size": 5, "p_retailprice": 1.5})


def _round_trip(fmt: str):
    def run(spark, d):
        rows, path = parts(spark, d), scratch_path(spark, fmt)
        formats.FORMATS[fmt][1](rows, path)
        back = formats.load_any(spark, path, fmt)
        return back.select(*[F.col(c).cast(t).alias(c) for c, t in rows.dtypes])

    return run


for _fmt in formats.FORMATS:
    QUERIES[f"round_trip_{_fmt}"] = _round_trip(_fmt)
    SQL[f"round_trip_{_fmt}"] = "SELECT p_partkey AS idx, p_name, p_size, p_retailprice FROM part"


@query("SELECT 'index' AS action, CAST(p_partkey AS VARCHAR) AS id, p_name AS name FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT 'delete', CAST(p_partkey AS VARCHAR), NULL FROM part WHERE p_partkey % 3 = 0")
def bulk_actions(spark, d):
    p = table(spark, d, "part")
    gone = F.col("p_partkey") % 3 == 0
    act = F.when(gone, F.to_json(F.struct(F.struct(F.col("p_partkey").cast("string").alias("_id")).alias("delete")))).otherwise(F.to_json(F.struct(F.struct(F.col("p_partkey").cast("string").alias("_id")).alias("index"))))
    two = F.array_compact(F.array(act, F.when(~gone, F.to_json(F.struct(F.col("p_name").alias("name"))))))
    lines = p.select(F.col("p_size").alias("stream"), "p_partkey", F.posexplode(two).alias("k", "line")).select("stream", (F.col("p_partkey") * 2 + F.col("k")).alias("line_no"), "line")
    return records.bulk_actions(lines).select("action", "id", F.get_json_object("source", "$.name").alias("name"))


# --- near duplicates ----------------------------------------------------------------------------------------------


SIMILAR = f"""{TOK}, sh AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(t) - 4, 1) + 1), lambda k: array_to_string(t[k:k + 4], ' ')))) AS s FROM tok WHERE len(t) > 0),
cl AS MATERIALIZED (SELECT s, min(doc_id) AS c FROM sh GROUP BY s), mem AS (SELECT doc_id, c FROM sh JOIN cl USING (s)), one AS MATERIALIZED (SELECT c, len(s) AS n, unnest(s) AS x FROM cl),
pr AS MATERIALIZED (SELECT a.c AS a, b.c AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS similarity FROM one a JOIN one b ON a.x = b.x AND a.c < b.c GROUP BY a.c, b.c HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.8)"""
PAIRS = f"WITH {SIMILAR} SELECT a, b, round(similarity, 6) AS similarity FROM pr UNION ALL SELECT c, doc_id, 1.0 FROM mem WHERE doc_id <> c"


@query(PAIRS)
def jaccard_shingles(spark, d):
    """Every pair of classes of documents whose five-word shingles are similar, by an exact join, and the further members of each class."""
    return near_duplicates.linked_documents(docs(spark, d), pairs=near_duplicates.exact_pairs).withColumn("similarity", F.round("similarity", 6))


@query(PAIRS)
def lsh_pairs(spark, d):
    """The same by MinHash bands, which miss a pair at the threshold once in 20,000 times."""
    return near_duplicates.linked_documents(docs(spark, d)).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH RECURSIVE {SIMILAR}, ed AS (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr), reach(c, r) AS (SELECT c, c FROM cl UNION SELECT reach.c, ed.b FROM reach JOIN ed ON ed.a = reach.r), low AS (SELECT c, min(r) AS g FROM reach GROUP BY c)
SELECT documents.doc_id, coalesce(mem.c, documents.doc_id) AS class_id, coalesce(g, documents.doc_id) AS group_id FROM documents LEFT JOIN mem USING (doc_id) LEFT JOIN low ON low.c = mem.c""")
def near_dup_components(spark, d):
    return near_duplicates.near_duplicate_groups(docs(spark, d))


# --- web ----------------------------------------------------------------------------------------------------------

ROOT = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
LINKS = rf"""al AS (SELECT page_id, url, regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1) AS l FROM pages), ax AS (SELECT page_id, url, unnest(l) AS raw, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pl FROM al),
lk AS (SELECT page_id, pl AS place, CASE WHEN regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN raw ELSE {ROOT} || '/' || regexp_replace(raw, '^(\.{{0,2}}/)+', '') END AS target FROM ax)"""


@query(f"WITH {LINKS} SELECT page_id, place, target FROM lk")
def html_links(spark, d):
    return crawl.links(table(spark, d, "pages")).withColumnRenamed("at", "place")


@query(r"""SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS language, CAST(len(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1)) AS BIGINT) AS n_links, regexp_extract(html, '<h1>(.*?)</h1>', 1, 's') AS heading FROM pages""")
def html_fields(spark, d):
    return crawl.page_fields(table(spark, d, "pages"))


@query(r"""SELECT url FROM pages WHERE regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/(fr/8)') OR NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/fr')""")
def robots_filter(spark, d):
    rules = crawl.robots_rules("User-agent: *\nDisallow: /fr\nAllow: /fr/8\n")
    return crawl.robots_filter(table(spark, d, "pages").select("url"), rules)


def _rounds(n: int) -> str:
    """PageRank's rounds, as one common table expression each."""
    one = "r{b} AS MATERIALIZED (SELECT node, deg, 0.15 / n + 0.85 * (coalesce(got, 0) + lost / n) AS rank FROM nd LEFT JOIN (SELECT dst AS node, sum(rank / deg) AS got FROM ed JOIN r{a} ON node = src GROUP BY dst) USING (node), (SELECT coalesce(sum(rank) FILTER (deg = 0), 0) AS lost FROM r{a}), cn)"
    return ", ".join(one.format(a=k, b=k + 1) for k in range(n))


@query(rf"""WITH {LINKS}, ed AS MATERIALIZED (SELECT DISTINCT lower(regexp_extract(target, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS src, regexp_extract(target, '([^/]*)/?$', 1) AS dst FROM lk),
nd AS MATERIALIZED (SELECT node, count(ed.src) AS deg FROM (SELECT src AS node FROM ed UNION SELECT dst FROM ed) LEFT JOIN ed ON ed.src = node GROUP BY node), cn AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nd),
r0 AS (SELECT node, deg, 1 / n AS rank FROM nd, cn), {_rounds(10)} SELECT node, round(rank, 9) AS rank FROM r10""")
def pagerank(spark, d):
    edges = crawl.links(table(spark, d, "pages")).select(crawl.host(F.col("target")).alias("src"), F.regexp_extract("target", r"([^/]*)/?$", 1).alias("dst"))
    return crawl.pagerank(edges).select("node", F.round("rank", 9).alias("rank"))


def _entities(text: str) -> str:
    for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", " "), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{c}')"
    return text


_TAGLESS = r"regexp_replace(regexp_replace(html, '<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'g')"


@query(rf"SELECT page_id, trim(regexp_replace({_entities(_TAGLESS)}, '\s+', ' ', 'g')) AS text FROM pages")
def visible_text(spark, d):
    return table(spark, d, "pages").select("page_id", crawl.visible_text("html").alias("text"))


@query("SELECT p_partkey, 'changed' AS change FROM part WHERE p_size > 40 UNION ALL SELECT p_partkey, 'new' FROM part WHERE p_partkey % 10 = 0 AND p_size <= 40")
def incremental_crawl(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    before = p.filter("p_partkey % 10 <> 0 OR p_size > 40").withColumn("p_size", F.when(F.col("p_size") > 40, 0).otherwise(F.col("p_size")))
    return crawl.changed(p, before, "p_partkey", ["p_name", "p_size"])


@query("SELECT c_custkey, 'bad price' AS reason FROM customer WHERE c_acctbal < 0")
def validation_rejects(spark, d):
    return crawl.valid_records(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), ["c_name"], "c_acctbal")[1].select("c_custkey", "reason")


# --- learning and streams -----------------------------------------------------------------------------------------


@query(f"""{BASE}, tr AS (SELECT doc_id, quality AS label FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL), c AS (SELECT label, term, CAST(sum(tf) AS BIGINT) AS n FROM tf JOIN tr USING (doc_id) GROUP BY label, term),
v AS (SELECT count(DISTINCT term) AS v FROM c), tot AS (SELECT label, sum(n) AS total FROM c GROUP BY label), pr AS (SELECT label, ln(count(*) / (SELECT count(*) FROM tr)) AS prior FROM tr GROUP BY label),
kt AS (SELECT DISTINCT term FROM c), x AS (SELECT doc_id, term, tf FROM tf JOIN kt USING (term)),
sc AS (SELECT d.doc_id, pr.label, any_value(prior) + coalesce(sum(tf * ln((coalesce(n, 0) + 1) / (total + v))), 0) AS score FROM documents d CROSS JOIN pr JOIN tot USING (label) CROSS JOIN v LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN c ON c.label = pr.label AND c.term = x.term GROUP BY d.doc_id, pr.label)
SELECT doc_id, label, round(score, 4) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, label) = 1""")
def nb_classify(spark, d):
    own = docs(spark, d)
    tf = materialise(ix.term_frequencies(own), "tf")
    return learning.naive_bayes_classify(own, learning.naive_bayes_model(own, table(spark, d, "labels"), "quality", tf=tf), tf)


@query()
def kmeans_labels(spark, d):
    rows = learning.hashed_tfidf(docs(spark, d))
    return learning.kmeans_clusters(rows, 4)[0].select("doc_id", "cluster")


def event_rows(spark, d) -> DataFrame:
    return tail.event_stream(spark, d, table(spark, d, "events").schema, "events.parquet")


def stream_name(spark) -> str:
    return "tail_" + Path(scratch_path(spark, "t")).name.replace("-", "_")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_tail_counts(spark, d):
    return tail.drain(tail.counts_by(event_rows(spark, d), "event_type"), stream_name(spark)).select("event_type", "n")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windowed_counts(spark, d):
    rows = event_rows(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return tail.drain(tail.windowed_counts(rows, "ts", "event_type"), stream_name(spark)).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH e AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 30 MINUTE, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    """Sessions of the events that are there, as a table; as a stream they need the append mode, which waits for the watermark."""
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return tail.sessions(rows, "ts", "user_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(r"""WITH u AS (SELECT DISTINCT lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) || substr(regexp_replace(url, '#.*$', ''), length(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) + 1) AS url, page_id FROM pages),
n AS (SELECT DISTINCT regexp_replace(url, '/$', '') AS url, page_id % 3 = 0 AS seen FROM u), f AS (SELECT DISTINCT url FROM n WHERE NOT seen AND url NOT IN (SELECT url FROM n WHERE seen))
SELECT url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host, row_number() OVER (PARTITION BY lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) ORDER BY url) AS turn FROM f""")
def url_frontier(spark, d):
    """Pages that are new against those with an id divisible by 3."""
    p = table(spark, d, "pages")
    return crawl.frontier(p.filter("page_id % 3 <> 0").select("url"), p.filter("page_id % 3 = 0").select("url"))


QUERIES |= services.QUERIES
SQL |= services.SQL
