"""Product addresses: extraction, absolute and canonical form, pagination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col, first_match, strip

# The path of product pages and what a link looks like.
PRODUCT_PATH = "/p/"
HREF = r"""href=["']([^"']+)["']"""


def hrefs(html, pattern: str = HREF) -> Column:
    return F.regexp_extract_all(F.coalesce(col(html), F.lit("")), F.lit(pattern), F.lit(1))


def product_hrefs(html, path: str = PRODUCT_PATH, key: str = r"\d+") -> Column:
    """All link targets that have the product path and a key (a number) after it."""
    return hrefs(html, rf"""href=["']([^"']*?{path}{key}[^"']*?)["']""")


def absolute(links: Column, base: str) -> Column:
    """http addresses as they are, rooted paths after the site's base; other forms go."""
    full = F.transform(links, lambda u: F.when(u.startswith("http"), u).when(u.startswith("/"), F.concat(F.lit(base), u)))
    return F.filter(full, lambda u: u.isNotNull())


def without_query(u: Column) -> Column:
    return F.split_part(F.split_part(u, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))


def canonical(links: Column, path: str = PRODUCT_PATH) -> Column:
    """Without query and fragment, product addresses only, each once in first-seen order."""
    return F.array_distinct(F.filter(F.transform(links, without_query), lambda u: F.contains(u, F.lit(path))))


def page_products(html, links_on_page, base: str, path: str = PRODUCT_PATH, key: str = r"\d+") -> Column:
    """A page's product addresses: those in its html, made absolute, then listed links as they are."""
    listed = F.filter(F.coalesce(col(links_on_page), F.array().cast("array<string>")), lambda u: F.contains(u, F.lit(path)))
    return canonical(F.concat(absolute(product_hrefs(html, path, key), base), listed), path)


def crawl_urls(url, html, links_on_page, base: str, path: str = PRODUCT_PATH, key: str = r"\d+") -> Column:
    """A crawled item's addresses: its own, listed product links (repeats kept), then new ones in its html."""
    listed = absolute(F.filter(F.coalesce(col(links_on_page), F.array().cast("array<string>")), lambda u: F.contains(u, F.lit(path))), base)
    first = F.concat(F.filter(F.array(col(url)), lambda u: u.isNotNull() & (u != "")), listed)
    fresh = F.array_distinct(F.filter(absolute(product_hrefs(html, path, key), base), lambda u: ~F.array_contains(first, u)))
    return F.concat(first, fresh)


def pagination(html, page_url, base: str, max_pages: int = 5) -> Column:
    """The first max_pages - 1 distinct pagination addresses in text order (page=10 before page=2)."""
    links = hrefs(html, r"""(?i)href=["']([^"']*?page[=/]\d+[^"']*?)["']""")
    full = F.transform(links, lambda u: F.when(u.startswith("http"), u).when(u.startswith("/"), F.concat(F.lit(base), u)).when(u.startswith("?"), F.concat(col(page_url), u)))
    return F.slice(F.array_sort(F.array_distinct(F.filter(full, lambda u: u.isNotNull()))), 1, max(0, max_pages - 1))


def product_id(url, path: str = PRODUCT_PATH) -> Column:
    return first_match(url, rf"{path}(\d+)")


def fallback_sku(url, prefix: str = "HP-") -> Column:
    return F.concat(F.lit(prefix), F.upper(F.substring(F.md5(col(url).cast("binary")), 1, 8)))


def search_url(base: str, query) -> Column:
    return F.concat(F.lit(f"{base}/search?q="), F.url_encode(col(query)))


def pasted_urls(text) -> Column:
    """The lines of pasted text that aren't blank, trimmed, in order."""
    lines = F.transform(F.split(F.coalesce(col(text), F.lit("")), "\n"), strip)
    return F.filter(lines, lambda u: u != "")


def preview(df: DataFrame, n: int = 10, column: str = "url") -> DataFrame:
    """One row: the first ``n`` distinct addresses, space-joined, and how many more there are."""
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    first = distinct.orderBy(column).limit(n).agg(F.array_join(F.array_sort(F.collect_list(column)), " "))
    return distinct.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("remaining")).withColumn("preview", first.scalar())
