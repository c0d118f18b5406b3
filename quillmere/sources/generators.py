"""Seeded corpora, products, profiles and shop pages, made in parallel: a row depends on its number and the seed alone, however the rows are partitioned.

Draws are taken from the MD5 of seed, number and purpose, so that SQL can repeat them. Word lists are parameters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.operators.compression import numbered

#: Products on a listing page, and the rules that the shop's robots.txt states.
PER_PAGE = 32
ROBOTS = "User-agent: *\nAllow: /\nDisallow: /admin/\nDisallow: /cart/\nCrawl-delay: 1\n"


def draw(seed: int, number: Column | str, purpose: str, n: int | Column) -> Column:
    """An integer from 0 to n - 1."""
    own = F.concat_ws(":", F.lit(str(seed)), F.col(number).cast("string") if isinstance(number, str) else number.cast("string"), F.lit(purpose))
    return (F.conv(F.substring(F.md5(own.cast("binary")), 1, 8), 16, 10).cast("bigint") % n).cast("int")


def pick(seed: int, number: Column | str, purpose: str, words: Sequence[str]) -> Column:
    return F.get(F.array(*map(F.lit, words)), draw(seed, number, purpose, len(words)))


def cents(seed: int, number: Column | str, purpose: str, low: int, high: int) -> Column:
    """An amount from low to high, in hundredths."""
    return F.round((draw(seed, number, purpose, (high - low) * 100 + 1) + low * 100) / 100, 2)


def code(prefix: str, number: Column, width: int) -> Column:
    """A prefix and a number with at least `width` digits."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0")))


def corpus(spark: SparkSession, topics: Mapping[str, Sequence[str]], per_topic: int, seed: int = 42) -> DataFrame:
    """(doc_id, topic, title, text): per_topic documents of each topic, mixed; a text is its title, a line feed and three to five sentences of the topic, of which
    the title is the first."""
    names, n = sorted(topics), len(topics) * per_topic
    step = next(s for s in range(int(n * 0.618) | 1, 2 * n + 3) if gcd(s, n) == 1) if n else 1
    rows = spark.range(n).withColumn("slot", F.floor((F.col("id") * step + seed) % max(n, 1) / max(per_topic, 1)).cast("int"))  # a permutation: topics stay even
    made = None
    for j, name in enumerate(names):
        said = [pick(seed, "id", f"sentence{k}", topics[name]) for k in range(5)]
        used = F.slice(F.array(*said), F.lit(1), draw(seed, "id", "length", 3) + 3)
        one = F.struct(F.lit(name).alias("topic"), said[0].alias("title"), F.concat(said[0], F.lit("\n"), F.array_join(used, " ")).alias("text"))
        made = F.when(F.col("slot") == j, one) if made is None else made.when(F.col("slot") == j, one)
    if made is None:
        return spark.createDataFrame([], "doc_id string, topic string, title string, text string")
    return rows.select(code("doc-", F.col("id") + 1, 3).alias("doc_id"), made.alias("d")).select("doc_id", "d.topic", "d.title", "d.text")


def products(spark: SparkSession, categories: Sequence[str], adjectives: Sequence[str], nouns: Sequence[str], each: int = 30, copies: int = 8, seed: int = 42) -> DataFrame:
    """(id, name, price, description, category): `each` products of each category, then near copies of every seventh one: a name with "Plus", a word of the
    description changed, and a price of 1 more."""
    n = len(categories) * each

    def fields(number: Column) -> list[Column]:
        adjective, noun = pick(seed, number, "adjective", adjectives), pick(seed, number, "noun", nouns)
        category = F.get(F.array(*map(F.lit, categories)), F.floor(number / each).cast("int"))
        name = F.concat(F.initcap(adjective), F.lit(" "), noun, F.lit(" "), (number % each + 1).cast("string"))
        description = F.concat(F.lit("A "), adjective, F.lit(" "), noun, F.lit(" for "), category, F.lit(" lovers. Highly rated "), noun, F.lit(" with reliable everyday performance."))
        return [name.alias("name"), cents(seed, number, "price", 5, 500).alias("price"), description.alias("description"), category.alias("category")]

    first = spark.range(n).select(code("p-", F.col("id") + 1, 3).alias("id"), *fields(F.col("id")))
    near = spark.range(min(copies, -(-n // 7))).select(code("p-", F.col("id") + n + 1, 3).alias("id"), *fields(F.col("id") * 7))
    changed = near.withColumns({"name": F.concat("name", F.lit(" Plus")), "description": F.replace("description", F.lit("Highly rated"), F.lit("Top rated")), "price": F.round(F.col("price") + 1, 2)})
    return first.unionByName(changed)


def profiles(spark: SparkSession, n: int, words: Mapping[str, Sequence[str]], seed: int = 42) -> DataFrame:
    """(id, name, email, age, price, city, state, zip, street, product, tags) of made-up people. words: first, last, domain, city, state, street, product, tag; a
    profile has up to three different tags."""
    at = lambda purpose: pick(seed, "id", purpose, words[purpose])
    first, last = at("first"), at("last")
    order = F.array(*[F.struct(draw(seed, "id", f"tag{j}", 1 << 30).alias("o"), F.lit(t).alias("t")) for j, t in enumerate(words["tag"])])
    tags = F.transform(F.slice(F.array_sort(order), F.lit(1), draw(seed, "id", "tags", 4)), lambda x: x.t)
    return spark.range(n).select(
        code("u-", F.col("id") + 1, 5).alias("id"),
        F.concat(first, F.lit(" "), last).alias("name"),
        F.lower(F.concat(first, F.lit("."), last, F.lit("@"), at("domain"))).alias("email"),
        (draw(seed, "id", "age", 58) + 18).alias("age"),
        cents(seed, "id", "price", 5, 500).alias("price"),
        at("city").alias("city"),
        at("state").alias("state"),
        (draw(seed, "id", "zip", 90000) + 10000).alias("zip"),
        F.concat((draw(seed, "id", "house", 9999) + 1).cast("string"), F.lit(" "), at("street")).alias("street"),
        at("product").alias("product"),
        tags.alias("tags"),
    )


def escaped(text: Column | str) -> Column:
    """For HTML text and attributes."""
    out = F.col(text) if isinstance(text, str) else text
    for c, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot")):
        out = F.replace(out, F.lit(c), F.lit(f"&{name};"))
    return out


def _card(base: str) -> Column:
    return F.concat(
        F.lit('<div class="card" data-product-id="'), escaped(F.col("id")), F.lit('"><span class="cat">'), escaped("category"), F.lit(f'</span><h3><a href="{base}product/'), F.col("id"),
        F.lit('.html">'), escaped("name"), F.lit('</a></h3><p class="price">$'), F.format_string("%.2f", "price"), F.lit('</p><p class="desc">'), escaped("description"), F.lit("</p></div>"),
    )


def _page(title: Column, body: Column) -> Column:
    return F.concat(F.lit('<!doctype html><html lang="en"><head><title>'), title, F.lit("</title></head><body><h1>"), title, F.lit("</h1>"), body, F.lit("</body></html>"))


def shop_pages(products: DataFrame, base: str = "/", per_page: int = PER_PAGE) -> DataFrame:
    """(url, html) of a shop of products (id, name, price, description, category; nulls are left blank): listing pages of per_page products in order of id, the same for
    each category, and a page for each product. No page grows with the shop."""
    rows = products.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("id", "name", "description", "category")], F.coalesce("price", F.lit(0.0)).alias("price"))
    order = numbered(products.select(F.col("id").alias("doc_id"))).select(F.col("doc_id").cast("string").alias("id"), "n")
    own = rows.join(order, "id").select("*", _card(base).alias("card"))
    single = own.select(F.concat(F.lit(f"{base}product/"), "id", F.lit(".html")).alias("url"), _page(escaped("name"), F.col("card")).alias("html"))
    every = own.select(F.lit("products").alias("kind"), "n", "card")
    placed = numbered(own.select(F.struct("category", "n").alias("doc_id"))).select("doc_id.category", "doc_id.n", F.col("n").alias("place"))
    starts = placed.groupBy("category").agg(F.min("place").alias("start"))
    by_category = own.select("category", "n", "card").join(placed, ["category", "n"]).join(starts, "category").select(F.concat(F.lit("category/"), "category").alias("kind"), (F.col("place") - F.col("start")).alias("n"), "card")
    listed = every.unionByName(by_category).withColumn("page", (F.floor(F.col("n") / per_page) + 1).cast("bigint"))
    total = listed.groupBy("kind").agg(F.max("page").alias("pages"))
    pages = listed.groupBy("kind", "page").agg(F.array_sort(F.collect_list(F.struct("n", "card"))).alias("cards")).join(total, "kind")  # per_page cards
    link = lambda to, text: F.concat(F.lit(f'<a href="{base}'), F.col("kind"), F.lit("/page-"), to.cast("string"), F.lit(f'.html">{text}</a>'))
    pager = F.concat(F.lit('<div class="pager">'), F.when(F.col("page") > 1, link(F.col("page") - 1, "Prev")).otherwise(""), F.when(F.col("page") < F.col("pages"), link(F.col("page") + 1, "Next")).otherwise(""), F.lit("</div>"))
    body = F.concat(F.array_join(F.transform("cards", lambda c: c.card), ""), pager)
    listing = pages.select(F.concat(F.lit(base), "kind", F.lit("/page-"), F.col("page").cast("string"), F.lit(".html")).alias("url"), _page(escaped("kind"), body).alias("html"))
    return listing.unionByName(single)


def sitemap(pages: DataFrame, root: str) -> DataFrame:
    """(value): lines of a sitemap of the pages' URLs, without the enclosing urlset lines, so that its parts can be written by many tasks."""
    return pages.select(F.concat(F.lit(f"  <url><loc>{root}"), escaped("url"), F.lit("</loc></url>")).alias("value"))
