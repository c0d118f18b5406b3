"""Web pages: links, fields, URL rules, PageRank, validation and what is new."""

from __future__ import annotations

from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.sources.scratch import materialise

DAMPING = 0.85


def link_targets(html: Column | str) -> Column:
    """The values of href in anchors, in order, as written."""
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))


def normal_url(url: Column | str) -> Column:
    """Scheme and host in lower case, no fragment, no default port, no trailing slash."""
    u = F.regexp_replace(url, r"#.*$", "")
    head = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    tail = F.substr(u, F.length(head) + 1)
    head = F.regexp_replace(head, r"^(http://[^/:]*):80$|^(https://[^/:]*):443$", "$1$2")
    return F.regexp_replace(F.concat(head, tail), r"/$", "")


def host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def resolve(target: Column, base: Column) -> Column:
    """A target against the site root of its page: absolute, root-relative or plain."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return F.when(F.rlike(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), target).otherwise(F.concat(root, F.lit("/"), F.regexp_replace(target, r"^(\.{0,2}/)+", "")))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, at, target): every anchor's target as a full URL."""
    return pages.select("page_id", "url", F.posexplode(link_targets("html")).alias("at", "raw")).select("page_id", F.col("at").cast("bigint").alias("at"), resolve(F.col("raw"), F.col("url")).alias("target"))


def page_fields(pages: DataFrame) -> DataFrame:
    """(page_id, title, language, n_links, heading)."""
    return pages.select(
        "page_id",
        F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract("html", r'<html lang="([^"]*)"', 1).alias("language"),
        F.size(link_targets("html")).cast("bigint").alias("n_links"),
        F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1).alias("heading"),
    )


def product_cards(pages: DataFrame) -> DataFrame:
    """(page_id, product_id, name, price, category, description) of product cards in listings; the price is a number or null."""
    card = r'(?s)<div class="card"[^>]*data-product-id="[^"]*".*?</div>'
    one = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(card), F.lit(0))).alias("card"))
    got = lambda p: F.regexp_extract("card", p, 1)
    return one.select(
        "page_id",
        got(r'data-product-id="([^"]*)"').alias("product_id"),
        got(r"(?s)<h3>\s*<a[^>]*>(.*?)</a>").alias("name"),
        F.regexp_replace(got(r'(?s)<p class="price">(.*?)</p>'), r"[$,]", "").try_cast("double").alias("price"),
        got(r'(?s)<span class="cat">(.*?)</span>').alias("category"),
        got(r'(?s)<p class="desc">(.*?)</p>').alias("description"),
    )


def pager_links(pages: DataFrame) -> DataFrame:
    """(page_id, way, target): the links to the page before ("Prev") and after ("Next") in a listing's pager."""
    inside = F.regexp_extract("html", r'(?s)<div class="pager">(.*?)</div>', 1)
    to = lambda word: F.nullif(F.regexp_extract(inside, rf'<a href="([^"]*)">[^<]*{word}[^<]*</a>', 1), F.lit(""))
    found = pages.select("page_id", F.explode(F.array(*[F.struct(F.lit(w).alias("way"), to(w).alias("target")) for w in ("Prev", "Next")])).alias("l"))
    return found.select("page_id", "l.way", "l.target").filter("target IS NOT NULL")


def visible_text(html: Column | str) -> Column:
    """Text without scripts, styles, comments and tags; the five named entities resolved."""
    t = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " "), ("amp", "&")):
        t = F.replace(t, F.lit(f"&{name};"), F.lit(c))
    return F.btrim(F.regexp_replace(t, r"\s+", " "))


def robots_rules(text: str, agent: str = "*") -> list[tuple[bool, str]]:
    """(allowed, prefix) rules of a robots.txt for an agent (or for all)."""
    rules: dict[str, list] = {}
    names: list[str] = []
    open_group = False
    for line in text.splitlines():
        key, _, value = line.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            names = [*names, value.lower()] if open_group else [value.lower()]
            open_group = True
        elif key in ("allow", "disallow"):
            open_group = False
            if value:
                for n in names:
                    rules.setdefault(n, []).append((key == "allow", value))
    return rules.get(agent.lower(), rules.get("*", []))


def robots_filter(urls: DataFrame, rules: list[tuple[bool, str]], url: str = "url") -> DataFrame:
    """URLs that the rules allow: the longest matching prefix decides, allow wins ties, no match allows."""
    path = F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    verdict = F.lit(True)
    for allowed, prefix in sorted(rules, key=lambda r: (len(r[1]), r[0])):
        verdict = F.when(F.startswith(path, F.lit(prefix)), allowed).otherwise(verdict)
    return urls.filter(verdict)


def frontier(found: DataFrame, seen: DataFrame, per_host: int | None = None) -> DataFrame:
    """(url, host, turn): new URLs, once each; turn numbers a host's URLs, for a rate limit."""
    from pyspark.sql import Window

    new = found.select(normal_url("url").alias("url")).distinct().join(seen.select(normal_url("url").alias("url")).distinct(), "url", "left_anti").withColumn("host", host("url"))
    out = new.withColumn("turn", F.row_number().over(Window.partitionBy("host").orderBy("url")).cast("bigint"))
    return out if per_host is None else out.filter(F.col("turn") <= per_host)


def absolute(base: str, target: str) -> str:
    """RFC 3986 resolution of one link, on the driver."""
    return urljoin(base, target)


def host_graph(pages: DataFrame) -> DataFrame:
    """(src, dst): distinct links between pages' paths: from each page's URL to the URLs of pages that it names, by last path part."""
    return links(pages).join(pages.select(F.col("page_id").alias("src"), normal_url("url").alias("own")), F.col("page_id") == F.col("src")).select(F.col("own").alias("src"), normal_url(F.col("target")).alias("dst")).distinct()


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = DAMPING) -> DataFrame:
    """(node, rank), summing to 1; nodes without links share their rank with all. A written table cuts the lineage every third round."""
    edges = materialise(edges.select("src", "dst").distinct(), "edges")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    out = edges.groupBy("src").agg(F.count("*").alias("deg"))
    nodes = materialise(nodes.join(out, nodes.node == out.src, "left").select("node", F.coalesce("deg", F.lit(0)).alias("deg")), "nodes")
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for k in range(rounds):
        lost = F.broadcast(ranks.agg(F.coalesce(F.sum(F.when(F.col("deg") == 0, F.col("rank"))), F.lit(0.0)).alias("lost")))
        given = edges.join(ranks.filter("deg > 0").select(F.col("node").alias("src"), (F.col("rank") / F.col("deg")).alias("part")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("part").alias("got"))
        ranks = nodes.join(given, "node", "left").crossJoin(lost).select("node", "deg", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        if k % 3 == 2:
            ranks = materialise(ranks, "ranks")
    return ranks.select("node", "rank")


def valid_records(rows: DataFrame, needed: list[str], price: str = "price") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with a reason): nothing needed is null or blank, and the price is a number of 0 or more."""
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(f"no {c}")) for c in needed]))
    amount = F.regexp_replace(F.col(price).cast("string"), r"[$,]", "").try_cast("double")
    bad = F.when(amount.isNull() | (amount < 0), F.array(F.lit("bad price"))).otherwise(F.array().cast("array<string>"))
    marked = rows.withColumn("_why", F.array_join(F.concat(missing, bad), "; "))
    return marked.filter("_why = ''").drop("_why"), marked.filter("_why <> ''").withColumnRenamed("_why", "reason")


def changed(now: DataFrame, before: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change): new, changed and gone records between two crawls."""
    a = now.select(key, F.xxhash64(*columns).alias("a"))
    b = before.select(key, F.xxhash64(*columns).alias("b"))
    kind = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "gone").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, key, "full").select(key, kind.alias("change")).filter("change is not null")
