"""Product search: options to a lazy plan that ends in one TakeOrderedAndProject."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SORT_COLUMNS = {"name": "name", "price": "current_price", "discount": "discount_percentage", "created_at": "created_at", "current_price": "current_price", "discount_percentage": "discount_percentage"}


@dataclass(frozen=True)
class SearchSpec:
    """Filters that are None or empty don't apply. ``query`` is a substring of name, description
    or sku in any case; % and _ are wildcards unless ``literal``."""

    query: str | None = None
    brands: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    min_price: float | None = None
    max_price: float | None = None
    on_sale_only: bool = False
    in_stock_only: bool = False
    sort_by: str = "name"
    sort_order: str = "asc"
    page: int = 1
    page_size: int = 20
    literal: bool = False

    def __post_init__(self):
        if self.sort_by not in SORT_COLUMNS or self.sort_order not in ("asc", "desc"):
            raise ValueError(f"unknown sort: {self.sort_by} {self.sort_order}")
        if self.page < 1 or not 1 <= self.page_size <= 100:
            raise ValueError("page must be 1 or more, page_size 1 to 100")

    @staticmethod
    def fits(page: str, page_size: str) -> Column:
        """The same rule for a table of requests."""
        return (F.col(page) >= 1) & F.col(page_size).between(1, 100)


def text_condition(columns: list[str], query: str, literal: bool) -> Column:
    """Whether one of the columns has the query as a substring, in any case."""
    if literal:
        tests = [F.contains(F.lower(c), F.lit(query.lower())) for c in columns]
    else:
        tests = [F.col(c).ilike(f"%{query}%") for c in columns]
    return reduce(lambda a, b: a | b, tests)


def matching(products: DataFrame, spec: SearchSpec) -> DataFrame:
    out = products
    if spec.query:
        out = out.where(text_condition([c for c in ("name", "description", "sku") if c in out.columns], spec.query, spec.literal))
    if spec.brands:
        out = out.where(F.col("brand").isin(spec.brands))
    if spec.categories:
        out = out.where(F.col("category").isin(spec.categories))
    if spec.min_price is not None:
        out = out.where(F.col("current_price") >= spec.min_price)
    if spec.max_price is not None:
        out = out.where(F.col("current_price") <= spec.max_price)
    if spec.on_sale_only:
        out = out.where("discount_percentage > 0")
    if spec.in_stock_only:
        out = out.where("availability = 'in_stock'")
    return out


def search(products: DataFrame, spec: SearchSpec) -> DataFrame:
    """One page; nulls last ascending and first descending, ties by id."""
    by = F.col(SORT_COLUMNS[spec.sort_by])
    order = by.asc_nulls_last() if spec.sort_order == "asc" else by.desc_nulls_first()
    return matching(products, spec).orderBy(order, "id").offset((spec.page - 1) * spec.page_size).limit(spec.page_size)


def cursor_of(row, spec: SearchSpec) -> tuple:
    """Where a page ends: the sort value and id of its last row."""
    return row[SORT_COLUMNS[spec.sort_by]], row["id"]


def after(products: DataFrame, spec: SearchSpec, cursor: tuple) -> Column:
    """Rows that come after the cursor in the search's order. The bound on the sort column stands
    alone, so that a scan can skip what lies before it."""
    by, (value, last) = F.col(SORT_COLUMNS[spec.sort_by]), cursor
    kind = products.schema[SORT_COLUMNS[spec.sort_by]].dataType
    v, seen = F.lit(value).cast(kind), F.col("id") <= F.lit(last)
    if value is None:
        return by.isNull() & ~seen if spec.sort_order == "asc" else by.isNotNull() | ~seen
    bound = by.isNull() | (by >= v) if spec.sort_order == "asc" else by <= v  # nulls are last, or first
    return bound & ~(by.eqNullSafe(v) & seen)


def search_after(products: DataFrame, spec: SearchSpec, cursor: tuple | None = None) -> DataFrame:
    """The page of ``spec.page_size`` rows after a cursor (the first page without one), in the order
    of ``search``. However deep the page, no task keeps more than a page of rows; ``spec.page`` is not looked at."""
    by = F.col(SORT_COLUMNS[spec.sort_by])
    order = by.asc_nulls_last() if spec.sort_order == "asc" else by.desc_nulls_first()
    rows = products if cursor is None else products.where(after(products, spec, cursor))
    return matching(rows, spec).orderBy(order, "id").limit(spec.page_size)


def totals(products: DataFrame, spec: SearchSpec) -> DataFrame:
    """(total, page, page_size, total_pages) of a search."""
    n = F.count("*")
    pages = F.floor((n + spec.page_size - 1) / spec.page_size).cast("long")
    return matching(products, spec).agg(n.alias("total"), F.lit(spec.page).alias("page"), F.lit(spec.page_size).alias("page_size"), pages.alias("total_pages"))
