"""Queries over the search index, the snapshot store, the change log and ordered passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trigrams
from ..operators.bucketed import Snapshot
from ..operators.changes import ChangeLog
from ..operators.search import SearchSpec, cursor_of, search_after
from ..operators.sequence import as_of, previous
from ..sources import catalog as c
from ..sources.storage import scratch
from .registry import HISTORY, NEWEST_FIRST, PRODUCTS, SHOWN_SQL, TIES, query, shown

DESCRIBED = PRODUCTS.replace("AS availability\n", "AS availability, concat_ws(' ', p_type, p_brand, 'size', p_size) AS description\n")


def described(s, d):
    """Products with a description."""
    size = c.read(s, d, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_size")
    p = c.products(s, d).join(size, "id")
    return p.withColumn("description", F.concat_ws(" ", "category", "brand", F.lit("size"), "p_size")).drop("p_size")


# --- search by index ----------------------------------------------------------------------
INDEXED = {
    "index_search": ("RING", False, "ILIKE '%ring%'"),  # in descriptions too
    "index_search_wildcard": ("br_nd%ize 1", False, "ILIKE '%br_nd%ize 1%'"),
    "index_search_short": ("z", False, "ILIKE '%z%'"),  # too short for a trigram: a scan
}
for _name, (_query, _literal, _test) in INDEXED.items():
    query(_name, f"WITH {DESCRIBED} SELECT {SHOWN_SQL} FROM products WHERE name {_test} OR description {_test} OR sku {_test}")(
        lambda s, d, q=_query, literal=_literal: shown(trigrams.search_index(s, _index(s, d), q, literal))
    )
query("index_search_literal", f"WITH {DESCRIBED} SELECT id FROM products WHERE contains(lower(name), 'd#12 s') OR contains(lower(description), 'd#12 s') OR contains(lower(sku), 'd#12 s')")(
    lambda s, d: trigrams.search_index(s, _index(s, d), "D#12 S", True).select("id")
)
query("index_postings", f"""WITH {DESCRIBED}, grams AS (SELECT DISTINCT id, unnest(list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: substr(t, i, 3))) AS gram
    FROM (SELECT id, lower(unnest([name, description, sku])) AS t FROM products)) SELECT gram, count(*) AS n FROM grams WHERE len(gram) = 3 GROUP BY 1""")(  # fmt: skip
    lambda s, d: s.read.parquet(f"{_index(s, d)}/postings").groupBy("gram").agg(F.sum(F.size("places")).alias("n"))
)


def _index(s, d):
    path = scratch(s, "index")
    trigrams.build(described(s, d), path)
    return path


# --- snapshot and history under late pages --------------------------------------------------
def pages_seen(s, d):
    """Prices as pages: the product's key, when it was seen, and for how much."""
    return c.price_history(s, d).select(F.col("product_id").alias("sku"), F.col("price").alias("current_price"), F.col("recorded_at").cast("timestamp").alias("scraped_at"), F.col("recorded_at").cast("timestamp").alias("created_at"), "tie_order")


def late_batches(df, order="tie_order"):
    """Three batches, each with times from the whole range: later batches have many late rows."""
    return [df.where(F.col(order) % 3 == n).drop(order) for n in (2, 0, 1)]


SEEN = HISTORY + ", seen AS (SELECT product_id AS sku, recorded_at AS scraped_at, min(price) AS current_price FROM history GROUP BY 1, 2)"


@query("snapshot_merge", f"""WITH {SEEN} SELECT sku, CAST(current_price AS DOUBLE) AS current_price, scraped_at, min(scraped_at) OVER (PARTITION BY sku) AS created_at FROM seen
    QUALIFY row_number() OVER (PARTITION BY sku ORDER BY scraped_at DESC) = 1""")  # fmt: skip
def snapshot_merge(s, d):
    """The snapshot store after three batches with late rows, the last of them twice."""
    store = Snapshot(s, scratch(s, "snapshot"), ties=["-current_price"], buckets=4)
    batches = late_batches(pages_seen(s, d))
    for n, b in enumerate([*batches, batches[-1]]):
        store.merge(b, n)
    at = lambda x: F.col(x).cast("timestamp_ntz").alias(x)
    return store.read().select("sku", F.col("current_price").cast("double").alias("current_price"), at("scraped_at"), at("created_at"))


@query("snapshot_rewrites", """WITH parts AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS sku FROM lineitem) SELECT count(*) AS keys, 1 AS buckets_of_one_key, 0 AS buckets_of_a_repeat FROM parts""")
def snapshot_rewrites(s, d):
    """How many bucket folders a change of one key rewrites, and a batch that changes nothing."""
    store = Snapshot(s, scratch(s, "snapshot"), ties=["-current_price"], buckets=4)
    rows = pages_seen(s, d).drop("tie_order")
    before = store.merge(rows, 0).folders
    newest = store.read().orderBy(F.desc("scraped_at"), "sku").limit(1)
    one = store.merge(newest.withColumn("scraped_at", F.col("scraped_at") + F.expr("interval 1 day")), 1).folders
    again = store.merge(rows, 2).folders
    differ = lambda a, b: sum(a.get(k) != v for k, v in b.items())
    return store.read().agg(F.count("*").alias("keys"), F.lit(differ(before, one)).alias("buckets_of_one_key"), F.lit(differ(one, again)).alias("buckets_of_a_repeat"))


CHANGED = f"""WITH {SEEN}, marked AS (SELECT *, lag(current_price) OVER w AS before, row_number() OVER w AS n FROM seen WINDOW w AS (PARTITION BY sku ORDER BY scraped_at))
    SELECT sku, CAST(current_price AS DOUBLE) AS price, scraped_at AS recorded_at FROM marked WHERE n > 1 AND current_price IS NOT NULL AND current_price IS DISTINCT FROM before"""


@query("change_capture", CHANGED)
def change_capture(s, d):
    """The history that the differences of three batches with late rows add up to."""
    log = ChangeLog(s, scratch(s, "changes"), buckets=4)
    for n, b in enumerate(late_batches(pages_seen(s, d))):
        log.append(b.select(F.col("sku").alias("key"), F.col("scraped_at").alias("at"), F.col("current_price").alias("price")), n)
    return log.history().select(F.col("key").alias("sku"), F.col("price").cast("double").alias("price"), F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"))


@query("change_log_hot_keys", f"""WITH {HISTORY}, hot AS (SELECT CASE WHEN CAST(product_id AS BIGINT) % 3 = 0 THEN 'hot' ELSE product_id END AS product_id, * EXCLUDE (product_id) FROM history),
    marked AS (SELECT *, lag(price) OVER w AS previous_price, row_number() OVER w AS n FROM hot WINDOW w AS (PARTITION BY product_id ORDER BY recorded_at, tie_order, tie_line, tie_supplier, price, tie_quantity))
    SELECT product_id, count(*) AS changes, CAST(sum(price - previous_price) AS DOUBLE) AS moved FROM marked WHERE n > 1 AND price IS DISTINCT FROM previous_price GROUP BY 1""")  # fmt: skip
def change_log_hot_keys(s, d):
    """Changes where one key holds a third of the prices: passes over ranges, not a window a key."""
    h = c.price_history(s, d).withColumn("product_id", F.when(F.col("product_id").cast("long") % 3 == 0, "hot").otherwise(F.col("product_id")))
    met = previous(h, ["product_id"], TIES, {"before": F.struct("price")})
    changed = met.where("before is not null and not (price <=> before.price)")
    return changed.groupBy("product_id").agg(F.count("*").alias("changes"), F.sum(F.col("price") - F.col("before.price")).cast("double").alias("moved"))


# --- a price at a time ----------------------------------------------------------------------
@query("price_as_of", f"""WITH {HISTORY}, latest AS (SELECT product_id, recorded_at, price FROM history QUALIFY row_number() OVER (PARTITION BY product_id, recorded_at ORDER BY {NEWEST_FIRST}) = 1),
    asked AS (SELECT o_orderkey, CAST(o_orderkey % (SELECT max(p_partkey) FROM part) + 1 AS VARCHAR) AS product_id, o_orderdate AS asked_at FROM orders)
    SELECT o_orderkey, asked.product_id, asked_at, CAST(price AS DOUBLE) AS price, recorded_at FROM asked ASOF LEFT JOIN latest ON asked.product_id = latest.product_id AND asked_at >= recorded_at""")  # fmt: skip
def price_as_of(s, d):
    """The price of a product at the time of each order."""
    parts = c.read(s, d, "part").agg(F.max("p_partkey")).scalar()
    asked = c.read(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % parts + 1).cast("string").alias("product_id"), F.col("o_orderdate").alias("at"))
    prices = c.price_history(s, d).withColumns({"at": F.col("recorded_at"), "cents": F.col("price").cast("double")})
    met = as_of(asked, prices, "product_id", "at", ["cents", "recorded_at"], TIES[1:])
    return met.select("o_orderkey", "product_id", F.col("at").alias("asked_at"), F.col("cents").alias("price"), "recorded_at")


# --- deep pages -----------------------------------------------------------------------------
def followed(products, spec, pages):
    """The page to which so many cursors lead."""
    cursor = None
    for _ in range(pages - 1):
        cursor = cursor_of(search_after(products, spec, cursor).collect()[-1], spec)  # a page of rows
    return search_after(products, spec, cursor)


CURSORS = {
    "keyset_by_name": (SearchSpec(page_size=30), 3, "name ASC NULLS LAST", "true"),
    "keyset_by_price": (SearchSpec(sort_by="price", sort_order="desc", page_size=20, in_stock_only=True), 3, "current_price DESC NULLS FIRST", "availability = 'in_stock'"),
    "keyset_by_discount": (SearchSpec(sort_by="discount", page_size=40), 3, "discount_percentage ASC NULLS LAST", "true"),
    "keyset_by_discount_desc": (SearchSpec(sort_by="discount", sort_order="desc", page_size=40), 2, "discount_percentage DESC NULLS FIRST", "true"),
}
for _name, (_spec, _page, _order, _where) in CURSORS.items():
    query(_name, f"WITH {PRODUCTS} SELECT {SHOWN_SQL} FROM products WHERE {_where} ORDER BY {_order}, id LIMIT {_spec.page_size} OFFSET {_spec.page_size * (_page - 1)}")(
        lambda s, d, spec=_spec, page=_page: shown(followed(c.products(s, d), spec, page))
    )
