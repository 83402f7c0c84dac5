"""Data quality: product validity, enumerations, duplicate keys, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def rejection(name="name", sku="sku", url="url", price="current_price") -> Column:
    """Why a product isn't valid, null if it is: sku, name and url present, price null or
    positive, name of 3 to 500 characters, sku of 3 to 50."""
    absent = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return (
        F.when(absent(sku) | absent(name) | absent(url), "missing")
        .when(F.col(price) <= 0, "price")
        .when(~F.length(name).between(3, 500), "name")
        .when(~F.length(sku).between(3, 50), "sku")
    )


def model_errors(df: DataFrame) -> Column:
    """The names of the columns that a stored record may not have like this, comma-joined, null if
    there are none: sku, and a category's name, empty once trimmed; a negative price. Columns that
    the table lacks aren't looked at."""
    blank = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    tests = {c: blank(c) for c in ("sku", "category_name")} | {c: F.col(c) < 0 for c in ("current_price", "original_price", "price")}
    found = F.array_compact(F.array(*[F.when(t, F.lit(c)) for c, t in tests.items() if c in df.columns]))
    return F.nullif(F.array_join(found, ","), F.lit(""))


def modelled(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records as they are stored, refused ones with ``errors``): sku and category_name are trimmed."""
    judged_ = df.withColumn("errors", model_errors(df))
    trimmed = {c: strip(F.col(c)) for c in ("sku", "category_name") if c in df.columns}
    return judged_.where("errors is null").drop("errors").withColumns(trimmed), judged_.where("errors is not null")


def enum_violations(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return df.where(F.col(column).isNull() | ~F.col(column).isin(allowed)).groupBy(column).agg(F.count("*").alias("n"))


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose key no parent has; null keys are no orphans."""
    parents = parent.select(F.col(parent_key).alias("__parent"))
    return child.where(F.col(child_key).isNotNull()).join(parents, F.col(child_key) == F.col("__parent"), "left_anti")
