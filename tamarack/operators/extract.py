"""Raw pages to product records, one projection without Python code, and a quarantine of rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import urls as u
from .checks import rejection

# Words by which a markdown line shows a product's name.
APPLIANCE, NAME_LABELS = "เครื่อง", ["ชื่อสินค้า", "Product Name"]


def _markdown_name(markdown: Column) -> Column:
    """From the first line that is a heading of an appliance or has a name label."""
    labelled = lambda line: F.contains(line, F.lit(NAME_LABELS[0])) | F.contains(line, F.lit(NAME_LABELS[1]))
    heading = lambda line: line.startswith("# ") & F.contains(line, F.lit(APPLIANCE))
    name = lambda line: t.clean_text(F.when(heading(line), F.substring(line, F.lit(3), F.length(line))).otherwise(F.get(F.split(line, ":"), F.lit(1))))
    return t.let(F.get(F.filter(F.split(markdown, "\n"), lambda x: heading(x) | labelled(x)), F.lit(0)), name)


def extract(pages: DataFrame, *carried: str) -> DataFrame:
    """Rows of ``schemas.RAW_PAGE`` with the product's columns and the ``carried`` ones; name is null where a page shows none."""
    description = F.coalesce("metadata.description", F.lit(""))
    fields = F.split(description, ",")
    name = F.coalesce(
        t.missing_to_null(t.strip("metadata.title")), t.missing_to_null(_markdown_name(F.coalesce("markdown", F.lit("")))),
        F.when(F.size(fields) > 1, t.missing_to_null(t.strip(F.get(fields, F.lit(0))))),
    )
    sku = F.coalesce(u.product_id("url"), t.extract_sku(description), t.extract_sku(F.coalesce("markdown", F.lit(""))), u.fallback_sku("url"))
    nonzero = lambda c: F.nullif(c, F.lit(0).cast("decimal(12,2)"))
    either = lambda a, b: t.extract_price(F.coalesce(t.missing_to_null(a), t.missing_to_null(b)))
    empty = F.array().cast("array<string>")
    rows = pages.withColumn("pair", t.price_pair(F.coalesce("markdown", F.lit(""))))
    rows = rows.withColumns({"cur": F.coalesce(nonzero(F.col("pair.current")), either("price", "current_price")), "orig": F.coalesce(nonzero(F.col("pair.original")), either("originalPrice", "original_price"))})
    return rows.select(
        F.sha2(sku, 256).alias("id"), sku.alias("sku"), name.alias("name"),
        F.coalesce(F.when(F.size(fields) > 1, t.missing_to_null(t.clean_text(F.get(fields, F.lit(1))))), t.clean_text("brand")).alias("brand"),
        t.clean_text("category").alias("category"), t.clean_text("description").alias("description"),
        F.col("cur").alias("current_price"), F.col("orig").alias("original_price"), t.discount("cur", "orig").alias("discount_percentage"),
        F.coalesce("features_arr", t.feature_list("features_str")).alias("features"),
        t.image_urls(F.coalesce(F.col("images_arr"), F.when(F.col("images_str") != "", F.array("images_str")), empty)).alias("images"),
        F.coalesce("specifications", F.create_map().cast("map<string,string>")).alias("specifications"),
        t.availability(F.coalesce(t.missing_to_null("availability"), F.col("stock_status"))).alias("availability"), F.col("url"), *carried,
    )


def split_valid(products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their reason)."""
    judged = products.withColumn("reason", rejection())
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")
