"""Crawl output whose items are texts, objects or lists of either, read as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as u


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _listed(v: Column) -> Column:
    """The elements of a list; null for anything else."""
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), _get(v, "$", "array<variant>"))


def crawl_items(output: DataFrame, column: str = "item") -> tuple[DataFrame, DataFrame]:
    """(items, rejected) of a table with JSON texts in ``column``; both keep the other columns.

    A text may hold one item or a list of items and of lists of items; ``position`` is an item's place
    in the whole text, from 0. An item has kind text or object, url, html and links_on_page. An
    object's address is the first that isn't empty of metadata.sourceURL, metadata.url, url and
    sourceUrl; of its links only texts count. What is no JSON, or no item, is rejected with its
    position (null if the whole text is no JSON), ``reason`` and the item as text."""
    keep = [c for c in output.columns if c != column]
    parsed = output.withColumn("__v", F.try_parse_json(column))
    whole = F.coalesce(_listed(F.col("__v")), F.array("__v"))
    flat = F.flatten(F.transform(whole, lambda x: F.coalesce(_listed(x), F.array(x))))
    placed = parsed.where("__v is not null").select(*keep, F.posexplode(flat).alias("position", "__i"))
    item = F.col("__i")
    kinds = placed.withColumn("__kind", F.when(F.schema_of_variant(item) == "STRING", "text").when(F.schema_of_variant(item).startswith("OBJECT"), "object"))
    first = lambda *paths: F.coalesce(*[F.nullif(_get(item, p, "string"), F.lit("")) for p in paths])
    address = F.when(F.col("__kind") == "text", _get(item, "$", "string")).otherwise(first("$.metadata.sourceURL", "$.metadata.url", "$.url", "$.sourceUrl"))
    texts = F.filter(_get(item, "$.linksOnPage", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    links = F.transform(texts, lambda x: x.cast("string"))
    of_object = lambda c: F.when(F.col("__kind") == "object", c)
    items = kinds.where("__kind is not null").select(*keep, "position", F.col("__kind").alias("kind"), address.alias("url"), of_object(_get(item, "$.html", "string")).alias("html"), of_object(links).alias("links_on_page"))
    odd = kinds.where("__kind is null").select(*keep, "position", F.concat(F.lit("neither text nor object: "), F.schema_of_variant(item)).alias("reason"), F.to_json(item).alias("item"))
    broken = parsed.where(f"`{column}` is not null and __v is null").select(*keep, F.lit(None).cast("int").alias("position"), F.lit("not JSON").alias("reason"), F.col(column).alias("item"))
    return items, odd.union(broken)


def item_urls(items: DataFrame, base: str, path: str = u.PRODUCT_PATH, key: str = r"\d+") -> DataFrame:
    """Each item's addresses in order: its own, then product links listed and in its html."""
    found = u.crawl_urls("url", "html", "links_on_page", base, path, key)
    return items.withColumn("urls", F.when(F.col("kind") == "text", F.filter(F.array("url"), lambda x: x != "")).otherwise(found))


def read_crawl(spark: SparkSession, path: str, lines: bool = True) -> tuple[DataFrame, DataFrame]:
    """(items, rejected) of landed crawl output, a JSON text a line or a file, with the file's name."""
    raw = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("item"))
    return crawl_items(raw.where("trim(item) <> ''"))
