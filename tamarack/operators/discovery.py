"""Discovery of product addresses: listing pages and the pages that they lead to, by joins of landed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as u


def follow(landed: DataFrame, starts: DataFrame, max_pages: int = 5) -> DataFrame:
    """(start_url, url), each pair once, of pages (url, links, more): their product addresses and
    those of the pages that they lead to."""
    own = landed.select(F.col("url").alias("page_url"), "links", "more")
    first = starts.select("start_url").join(own, F.col("start_url") == F.col("page_url"))
    if max_pages == 1:
        return first.select("start_url", F.explode("links").alias("url")).distinct()
    # One pass over the start pages: a row a product (no page to go to) and a row a further page.
    here = F.transform("links", lambda u: F.struct(u.alias("url"), F.lit(None).cast("string").alias("page")))
    there = F.transform("more", lambda u: F.struct(F.lit(None).cast("string").alias("url"), u.alias("page")))
    steps = first.select("start_url", F.explode(F.concat(here, there)).alias("s")).select("start_url", "s.url", "s.page")
    met = steps.join(landed.select(F.col("url").alias("__page"), F.col("links").alias("__links")), F.col("page") == F.col("__page"), "left")
    return met.select("start_url", F.explode(F.when(F.col("url").isNotNull(), F.array("url")).otherwise(F.col("__links"))).alias("url")).distinct()


def check_pages(max_pages: int) -> None:
    if not 1 <= max_pages <= 50:
        raise ValueError("max_pages must be 1 to 50")


def discover(pages: DataFrame, starts: DataFrame, base: str, max_pages: int = 5) -> DataFrame:
    """(start_url, url), each pair once: the product addresses of each start page and of the first
    ``max_pages`` - 1 pages that it links to. A start that was not landed leads nowhere. ``pages``
    has url, html and linksOnPage, an address at most once."""
    check_pages(max_pages)
    landed = pages.select("url", u.page_products("html", "linksOnPage", base).alias("links"), u.pagination("html", "url", base, max_pages).alias("more"))
    return follow(landed, starts, max_pages)


def discover_from_search(pages: DataFrame, queries: DataFrame, base: str, max_results: int = 50) -> DataFrame:
    """(query, url): at most ``max_results`` addresses of each search page, in order of address."""
    asked = queries.select("query", u.search_url(base, "query").alias("start_url"))
    found = asked.join(discover(pages, asked.select("start_url").distinct(), base), "start_url").select("query", "url").distinct()
    ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("url")))  # Spark keeps max_results rows a task before it shuffles
    return ranked.where(F.col("n") <= max_results).drop("n")


def envelope(found: DataFrame, starts: DataFrame, max_pages: int = 5) -> DataFrame:
    """(url, max_pages, discovered_urls, total) of each start, empty for those that lead nowhere."""
    lists = found.groupBy("start_url").agg(F.array_sort(F.collect_list("url")).alias("urls"))
    urls = F.coalesce("urls", F.array().cast("array<string>"))
    return starts.join(lists, "start_url", "left").select(F.col("start_url").alias("url"), F.lit(max_pages).alias("max_pages"), urls.alias("discovered_urls"), F.size(urls).alias("total"))
