"""Every catalogue query by name, with the SQL that has to give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as t
from ..functions import urls as u
from ..operators import analytics as a
from ..operators import checks, discovery, upsert
from ..operators import jobs as j
from ..operators.search import SearchSpec, matching, search, totals
from ..sources import catalog as c

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PRODUCTS = """products AS (
    SELECT CAST(p_partkey AS VARCHAR) AS id, concat('P', lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS sku, p_name AS name, p_brand AS brand, p_type AS category,
        CAST(p_retailprice AS DECIMAL(12,2)) AS current_price,
        CASE WHEN p_size % 2 = 0 THEN CAST(p_retailprice + p_size AS DECIMAL(12,2)) END AS original_price,
        CASE WHEN p_size % 2 = 0 THEN round(p_size * 100.0::DOUBLE / (p_retailprice + p_size), 4) END AS discount_percentage,
        CASE WHEN p_size <= 10 THEN 'out_of_stock' WHEN p_size <= 40 THEN 'in_stock' ELSE 'unknown' END AS availability
    FROM part)"""
DATED = PRODUCTS + """, dated AS (
    SELECT p.*, d.created_at, d.scraped_at FROM products p JOIN (SELECT CAST(l_partkey AS VARCHAR) AS id, min(l_shipdate) AS created_at, max(l_shipdate) AS scraped_at FROM lineitem GROUP BY 1) d USING (id))"""
HISTORY = """history AS (
    SELECT CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_extendedprice AS DECIMAL(12,2)) AS price, l_shipdate AS recorded_at,
        l_orderkey AS tie_order, l_linenumber AS tie_line, l_suppkey AS tie_supplier, l_quantity AS tie_quantity FROM lineitem)"""
JOBS = """jobs AS (
    SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'pending' END AS status, o_orderdate AS created_at, o_orderdate AS started_at,
        coalesce(n, 0) AS total_items, coalesce(n, 0) AS processed_items, coalesce(n, 0) - coalesce(bad, 0) AS success_items, coalesce(bad, 0) AS failed_items,
        CASE WHEN o_orderstatus = 'F' THEN o_orderdate + coalesce(n, 0) * INTERVAL 1 HOUR END AS completed_at
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS bad FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""
BASE_URL = "https://shop.example.com"
TIES = ["recorded_at", "tie_order", "tie_line", "tie_supplier", "price", "tie_quantity"]
SHOWN = ["id", "sku", "name", "brand", "category", "current_price", "original_price", "discount_percentage", "availability"]


def shown(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(x).cast("double").alias(x) if x.endswith("price") else F.col(x) for x in SHOWN])


SHOWN_SQL = ", ".join(f"CAST({x} AS DOUBLE) AS {x}" if x.endswith("price") else x for x in SHOWN)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- product search ---------------------------------------------------------------------
SEARCHES = {
    "search_text": (SearchSpec(query="RIN", page_size=100), "name ILIKE '%rin%' OR sku ILIKE '%rin%'"),
    "search_brand_in": (SearchSpec(brands=["Brand#2", "Brand#17"], page_size=100), "brand IN ('Brand#2', 'Brand#17')"),
    "search_category_in": (SearchSpec(categories=["ECONOMY"], page_size=100), "category IN ('ECONOMY')"),
    "search_price_range": (SearchSpec(min_price=910, max_price=920), "current_price >= 910 AND current_price <= 920"),
    "search_on_sale": (SearchSpec(on_sale_only=True, page_size=50), "discount_percentage > 0"),
    "search_in_stock": (SearchSpec(in_stock_only=True, page_size=50), "availability = 'in_stock'"),
    "search_combined": (SearchSpec(query="r", min_price=900, max_price=990, on_sale_only=True, in_stock_only=True, sort_by="discount", sort_order="desc", page=2), "(name ILIKE '%r%' OR sku ILIKE '%r%') AND current_price >= 900 AND current_price <= 990 AND discount_percentage > 0 AND availability = 'in_stock'"),
    "search_page_name": (SearchSpec(page=3), "true"),
    "search_page_price": (SearchSpec(sort_by="price", page=2), "true"),
    "search_page_discount": (SearchSpec(sort_by="discount", page=2), "true"),
    "search_page_desc": (SearchSpec(sort_by="price", sort_order="desc", page=2), "true"),
}
ORDERS = {"name": "name", "price": "current_price", "discount": "discount_percentage"}
for _name, (_spec, _where) in SEARCHES.items():
    _nulls = "ASC NULLS LAST" if _spec.sort_order == "asc" else "DESC NULLS FIRST"
    query(_name, f"WITH {PRODUCTS} SELECT {SHOWN_SQL} FROM products WHERE {_where} ORDER BY {ORDERS[_spec.sort_by]} {_nulls}, id LIMIT {_spec.page_size} OFFSET {(_spec.page - 1) * _spec.page_size}")(
        lambda s, d, spec=_spec: shown(search(c.products(s, d), spec))
    )

query("search_by_date", f"WITH {DATED} SELECT id, created_at FROM dated ORDER BY created_at DESC NULLS FIRST, id LIMIT 20")(
    lambda s, d: search(c.products(s, d, True), SearchSpec(sort_by="created_at", sort_order="desc")).select("id", "created_at")
)
query("search_total_pages", f"WITH {PRODUCTS} SELECT count(*) AS total, 1 AS page, 20 AS page_size, CAST((count(*) + 19) // 20 AS BIGINT) AS total_pages FROM products WHERE availability = 'in_stock'")(
    lambda s, d: totals(c.products(s, d), SearchSpec(in_stock_only=True))
)
query("product_by_id", f"WITH {PRODUCTS} SELECT {SHOWN_SQL} FROM products WHERE id = '42'")(lambda s, d: shown(c.products(s, d).where("id = '42'").limit(1)))
query("product_by_sku", f"WITH {PRODUCTS} SELECT {SHOWN_SQL} FROM products WHERE sku = 'P000000007'")(lambda s, d: shown(c.products(s, d).where("sku = 'P000000007'").limit(1)))


@query("product_dto", f"""WITH {DATED} SELECT id, sku, name, brand, category, nullif(CAST(current_price AS DOUBLE), 0) AS current_price, nullif(CAST(original_price AS DOUBLE), 0) AS original_price,
    discount_percentage, availability, coalesce(scraped_at, created_at) AS last_scraped, created_at,
    '฿' || printf('%.2f', CAST(current_price AS DOUBLE)) AS price_text, CASE WHEN discount_percentage <> 0 THEN printf('%.0f%%', discount_percentage) END AS discount_text FROM dated""")  # fmt: skip
def product_dto(s, d):
    """Halves of a percent go to the even number, as C's printf rounds them; Java's goes up."""
    p = c.products(s, d, True)
    plain = lambda x: F.nullif(F.col(x).cast("double"), F.lit(0.0)).alias(x)
    return p.select(
        "id", "sku", "name", "brand", "category", plain("current_price"), plain("original_price"), "discount_percentage", "availability", F.coalesce("scraped_at", "created_at").alias("last_scraped"), "created_at",
        F.format_string("฿%.2f", F.col("current_price").cast("double")).alias("price_text"), F.when(F.col("discount_percentage") != 0, F.format_string("%.0f%%", F.bround("discount_percentage"))).alias("discount_text"),
    )


# --- catalogue statistics ---------------------------------------------------------------
query("product_stats", f"""WITH {PRODUCTS} SELECT count(*) AS total_products, count(DISTINCT brand) AS total_brands, count(DISTINCT category) AS total_categories,
    round(avg(CAST(current_price AS DOUBLE)), 4) AS avg_price, CAST(min(current_price) AS DOUBLE) AS min_price, CAST(max(current_price) AS DOUBLE) AS max_price,
    count(*) FILTER (discount_percentage > 0) AS products_on_sale, round(avg(discount_percentage) FILTER (discount_percentage > 0), 4) AS avg_discount FROM products""")(lambda s, d: a.product_stats(c.products(s, d)))  # fmt: skip
for _one, _many in (("brand", "brands"), ("category", "categories")):
    query(_many, f"WITH {PRODUCTS} SELECT DISTINCT {_one} FROM products WHERE {_one} <> ''")(lambda s, d, x=_one: a.distinct_values(c.products(s, d), x))
    query(f"{_one}_distribution", f"WITH {PRODUCTS} SELECT {_one}, count(*) AS \"count\" FROM products WHERE {_one} <> '' GROUP BY 1")(lambda s, d, x=_one: a.distribution(c.products(s, d), x))
    query(f"top_{_many}", f"WITH {PRODUCTS} SELECT {_one}, count(*) AS \"count\" FROM products WHERE {_one} <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")(
        lambda s, d, x=_one: a.distribution(c.products(s, d), x).orderBy(F.desc("count"), x).limit(5)
    )
query("price_histogram", f"""WITH {HISTORY}, labels AS (SELECT unnest(['0-500', '500-1000', '1000-2000', '2000-5000', '5000+']) AS bucket)
    SELECT bucket, coalesce(n, 0) AS n FROM labels LEFT JOIN (SELECT CASE WHEN price < 500 THEN '0-500' WHEN price < 1000 THEN '500-1000' WHEN price < 2000 THEN '1000-2000' WHEN price < 5000 THEN '2000-5000' ELSE '5000+' END AS b, count(*) AS n FROM history WHERE price >= 0 GROUP BY 1) ON bucket = b""")(lambda s, d: a.price_histogram(c.price_history(s, d), "price"))  # fmt: skip


@query("dashboard_kpis", f"""WITH {PRODUCTS}, {JOBS} SELECT (SELECT count(*) FROM products) AS total_products, (SELECT count(*) FROM jobs) AS total_jobs,
    (SELECT coalesce(round(avg(CAST(current_price AS DOUBLE)) FILTER (current_price <> 0), 2), 0) FROM products) AS average_price, (SELECT count(*) FILTER (discount_percentage > 0) FROM products) AS products_on_sale""")  # fmt: skip
def dashboard_kpis(s, d):
    p = c.products(s, d).agg(
        F.count("*").alias("total_products"), F.coalesce(F.round(F.avg(F.when(F.col("current_price") != 0, F.col("current_price").cast("double"))), 2), F.lit(0.0)).alias("average_price"), F.count_if(F.col("discount_percentage") > 0).alias("products_on_sale")
    )
    return p.join(F.broadcast(c.read(s, d, "orders").agg(F.count("*").alias("total_jobs"))))  # one row each


# --- prices -----------------------------------------------------------------------------
NEWEST_FIRST = "recorded_at DESC, tie_order DESC, tie_line DESC, tie_supplier DESC, price DESC, tie_quantity DESC"
query("price_history_latest", f"WITH {HISTORY} SELECT product_id, CAST(price AS DOUBLE) AS price, recorded_at FROM history WHERE product_id = '42' ORDER BY {NEWEST_FIRST} LIMIT 30")(
    lambda s, d: c.price_history(s, d).where("product_id = '42'").orderBy(*[F.desc(x) for x in TIES]).limit(30).select("product_id", F.col("price").cast("double").alias("price"), "recorded_at")
)


@query("price_history_window", f"WITH {HISTORY} SELECT product_id, CAST(price AS DOUBLE) AS price, recorded_at FROM history WHERE product_id = '42' AND recorded_at > (SELECT max(recorded_at) FROM history) - INTERVAL 365 DAY")
def price_history_window(s, d):
    h = c.price_history(s, d)
    return h.where((F.col("product_id") == "42") & (F.col("recorded_at") > h.agg(F.max("recorded_at")).scalar() - F.make_dt_interval(F.lit(365)))).select("product_id", F.col("price").cast("double").alias("price"), "recorded_at")


query("price_history_envelope", f"WITH {HISTORY} SELECT product_id, count(*) AS entries, CAST(max(price) AS DOUBLE) AS highest, CAST(min(price) AS DOUBLE) AS lowest FROM history GROUP BY 1")(
    lambda s, d: c.price_history(s, d).groupBy("product_id").agg(F.count("*").alias("entries"), F.max("price").cast("double").alias("highest"), F.min("price").cast("double").alias("lowest"))
)
TRENDS = f"""WITH {PRODUCTS}, {HISTORY}, trends AS (
    SELECT p.id, p.name, p.brand, CAST(p.current_price AS DOUBLE) AS current_price, CAST(h.price AS DOUBLE) AS historical_price, recorded_at, tie_order, tie_line, tie_supplier, tie_quantity,
        round(CAST(p.current_price AS DOUBLE) - CAST(h.price AS DOUBLE), 4) AS price_change,
        round((CAST(p.current_price AS DOUBLE) - CAST(h.price AS DOUBLE)) / nullif(CAST(h.price AS DOUBLE), 0) * 100, 4) AS price_change_percent
    FROM products p JOIN history h ON p.id = h.product_id WHERE recorded_at > (SELECT max(recorded_at) FROM history) - INTERVAL 365 DAY)"""
TREND_TIES = ["id", "recorded_at", "tie_order", "tie_line", "tie_supplier", "tie_quantity", "historical_price"]
TREND_COLUMNS = ["id", "name", "brand", "current_price", "historical_price", "recorded_at", "price_change", "price_change_percent"]
for _name, _sign in (("price_trends", 0), ("price_increases", 1), ("price_decreases", -1)):
    _where = f"WHERE sign(price_change) = {_sign}" if _sign else ""
    query(_name, f"{TRENDS} SELECT {', '.join(TREND_COLUMNS)} FROM trends {_where} ORDER BY abs(price_change_percent) DESC NULLS LAST, {', '.join(TREND_TIES)} LIMIT 20")(
        lambda s, d, sign=_sign: a.top_changes(a.price_trends(c.products(s, d), c.price_history(s, d), None, 365, sign), TREND_TIES).select(*TREND_COLUMNS)
    )


@query("new_products", f"WITH {DATED} SELECT id, created_at FROM dated WHERE created_at > (SELECT max(created_at) FROM dated) - INTERVAL 30 DAY")
def new_products(s, d):
    p = c.products(s, d, True)
    return p.where(F.col("created_at") > p.agg(F.max("created_at")).scalar() - F.make_dt_interval(F.lit(30))).select("id", "created_at")


query("out_of_stock", f"WITH {PRODUCTS} SELECT id, name FROM products WHERE availability = 'out_of_stock'")(lambda s, d: c.products(s, d).where("availability = 'out_of_stock'").select("id", "name"))

# --- upsert and change capture ----------------------------------------------------------
ORDERED = "recorded_at, tie_order, tie_line, tie_supplier, price, tie_quantity"
query("upsert_latest", f"WITH {HISTORY} SELECT product_id, CAST(price AS DOUBLE) AS price, recorded_at FROM history QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY {NEWEST_FIRST}) = 1")(
    lambda s, d: upsert.latest(c.price_history(s, d), ["product_id"], TIES).select("product_id", F.col("price").cast("double").alias("price"), "recorded_at")
)
query("price_change_log", f"""WITH {HISTORY}, marked AS (SELECT product_id, price, recorded_at, lag(price) OVER w AS previous_price, row_number() OVER w AS n FROM history WINDOW w AS (PARTITION BY product_id ORDER BY {ORDERED}))
    SELECT product_id, CAST(price AS DOUBLE) AS price, CAST(previous_price AS DOUBLE) AS previous_price, recorded_at FROM marked WHERE n > 1 AND price IS NOT NULL AND price IS DISTINCT FROM previous_price""")(  # fmt: skip
    lambda s, d: upsert.price_changes(c.price_history(s, d), "product_id", "price", [F.col(x) for x in TIES]).select("product_id", F.col("price").cast("double").alias("price"), F.col("previous_price").cast("double").alias("previous_price"), "recorded_at")
)


@query("snapshot_upsert", f"""WITH {HISTORY}, log AS (SELECT product_id AS sku, price AS current_price, recorded_at AS scraped_at, {ORDERED.replace('price', 'price AS p')} FROM history)
    SELECT sku, CAST(current_price AS DOUBLE) AS current_price, scraped_at FROM log QUALIFY row_number() OVER (PARTITION BY sku ORDER BY (scraped_at >= TIMESTAMP '2000-01-01') DESC, scraped_at DESC, current_price DESC) = 1""")  # fmt: skip
def snapshot_upsert(s, d):
    """The log before 2000 as the stored snapshot, the rest as one batch."""
    log = c.price_history(s, d).select(F.col("product_id").alias("sku"), F.col("price").alias("current_price"), F.col("recorded_at").alias("scraped_at"))
    new = F.col("scraped_at") >= F.lit("2000-01-01").cast("timestamp_ntz")
    stored = upsert.latest(log.where(~new), ["sku"], ["scraped_at", "current_price"])
    return upsert.upsert(stored, log.where(new), ties=["current_price"]).select("sku", F.col("current_price").cast("double").alias("current_price"), "scraped_at")


query("job_fold", """SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) FILTER (event_type = 'view') AS started_at, max(ts) FILTER (event_type IN ('purchase', 'error')) AS completed_at FROM events GROUP BY 1""")(
    lambda s, d: job_events(s, d)
)
STATUS_OF = {"signup": "pending", "click": "pending", "view": "running", "purchase": "completed", "error": "failed"}


def job_events(s, d):
    kinds = F.create_map(*[F.lit(x) for kv in STATUS_OF.items() for x in kv])
    events = c.read(s, d, "events").withColumn("status", kinds[F.col("event_type")])
    folded = upsert.fold_jobs(events, "user_id", "status", "ts", ["event_id"])
    last = events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type"))["event_type"].alias("event_type"))
    return folded.join(last, "user_id").select("user_id", F.col("event_type").alias("status"), "started_at", "completed_at")


# --- jobs -------------------------------------------------------------------------------
DAILY = f"""WITH {JOBS}, daily AS (SELECT CAST(created_at AS DATE) AS date, count(*) AS jobs_run, CAST(sum(success_items) AS BIGINT) AS total_success, CAST(sum(failed_items) AS BIGINT) AS total_failed,
    round(avg(CASE WHEN processed_items > 0 THEN CAST(success_items AS DOUBLE) / processed_items * 100 ELSE 0 END), 4) AS avg_success_rate FROM jobs WHERE status = 'completed' GROUP BY 1)"""  # fmt: skip
query("daily_scrape_stats", f"{DAILY} SELECT * FROM daily")(lambda s, d: a.daily_stats(c.jobs(s, d)))
query("daily_stats_last_n", f"{DAILY} SELECT * FROM daily ORDER BY date DESC LIMIT 7")(lambda s, d: a.daily_stats(c.jobs(s, d)).orderBy(F.desc("date")).limit(7))
JOB_COLUMNS = ["id", "status", "total_items", "processed_items", "success_items", "failed_items", "created_at", "started_at", "completed_at"]


def newest_jobs(s, d, where="true", columns=JOB_COLUMNS):
    """The 20 newest jobs; only their items are counted."""
    few = c.orders_as_jobs(s, d).where(where).orderBy(F.desc("created_at"), "id").limit(20)
    return c.jobs(s, d, few).orderBy(F.desc("created_at"), "id").select(*columns)


query("jobs_list", f"WITH {JOBS} SELECT {', '.join(JOB_COLUMNS)} FROM jobs ORDER BY created_at DESC, id LIMIT 20")(lambda s, d: newest_jobs(s, d))
query("jobs_by_status", f"WITH {JOBS} SELECT {', '.join(JOB_COLUMNS)} FROM jobs WHERE status = 'running' ORDER BY created_at DESC, id LIMIT 20")(
    lambda s, d: newest_jobs(s, d, "status = 'running'")
)
query("job_by_id", f"WITH {JOBS} SELECT {', '.join(JOB_COLUMNS)} FROM jobs WHERE id = 3")(lambda s, d: c.jobs(s, d).where("id = 3").select(*JOB_COLUMNS))
query("job_tallies", f"WITH {JOBS} SELECT count(*) AS total, count(*) FILTER (status IN ('pending', 'running')) AS active, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM (FROM jobs ORDER BY created_at DESC, id LIMIT 20)")(
    lambda s, d: a.job_tallies(c.orders_as_jobs(s, d).orderBy(F.desc("created_at"), "id").limit(20))
)
query("job_rates", f"""WITH {JOBS} SELECT id, coalesce(round(processed_items * 100.0::DOUBLE / nullif(total_items, 0), 4), 0) AS progress, coalesce(round(success_items * 100.0::DOUBLE / nullif(processed_items, 0), 4), 0) AS success_of_processed,
    coalesce(round(success_items * 100.0::DOUBLE / nullif(success_items + failed_items, 0), 4), 0) AS success_of_finished, status IN ('pending', 'running') AS is_running FROM jobs""")(lambda s, d: a.job_rates(c.jobs(s, d)))  # fmt: skip
query("scraping_performance", f"""WITH {JOBS} SELECT count(*) AS total_jobs, CAST(sum(success_items) AS BIGINT) AS total_success, CAST(sum(failed_items) AS BIGINT) AS total_failed,
    coalesce(round(sum(success_items) * 100.0::DOUBLE / nullif(sum(success_items) + sum(failed_items), 0), 2), 0) AS average_success_rate FROM jobs WHERE status = 'completed'""")(lambda s, d: a.performance(c.jobs(s, d)))  # fmt: skip
query("job_duration", f"WITH {JOBS} SELECT coalesce(round(avg(CAST(epoch(completed_at) - epoch(started_at) AS DOUBLE)), 2), 0) AS average_job_duration_seconds FROM jobs WHERE started_at IS NOT NULL AND completed_at IS NOT NULL")(
    lambda s, d: a.job_duration(c.jobs(s, d))
)

# --- data quality and categories --------------------------------------------------------
query("duplicate_lines", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")(lambda s, d: checks.duplicates(c.read(s, d, "lineitem"), "l_orderkey", "l_linenumber"))
query("duplicate_sku", f"WITH {PRODUCTS} SELECT sku, count(*) AS n FROM products GROUP BY 1 HAVING count(*) > 1")(lambda s, d: checks.duplicates(c.products(s, d), "sku"))
query("orphan_history", f"WITH {PRODUCTS}, {HISTORY} SELECT product_id, count(*) AS n FROM history WHERE product_id IS NOT NULL AND product_id NOT IN (SELECT id FROM products WHERE availability = 'in_stock') GROUP BY 1")(
    lambda s, d: checks.orphans(c.price_history(s, d), c.products(s, d).where("availability = 'in_stock'"), "product_id", "id").groupBy("product_id").agg(F.count("*").alias("n"))
)
query("enum_violations", "SELECT event_type, count(*) AS n FROM events WHERE event_type IS NULL OR event_type NOT IN ('view', 'click') GROUP BY 1")(lambda s, d: checks.enum_violations(c.read(s, d, "events"), "event_type", ["view", "click"]))
query("job_enum_violations", f"WITH {JOBS} SELECT status, count(*) AS n FROM jobs WHERE status NOT IN ('pending', 'running', 'completed', 'failed', 'cancelled') GROUP BY 1")(
    lambda s, d: checks.enum_violations(c.jobs(s, d), "status", schemas.JOB_STATUSES)
)
query("category_tree", """WITH RECURSIVE cats AS (SELECT 'R' || r_regionkey AS id, r_name AS name, CAST(NULL AS VARCHAR) AS parent_id FROM region UNION ALL SELECT 'N' || n_nationkey, n_name, 'R' || n_regionkey FROM nation),
    tree AS (SELECT id, name, 0 AS level, name AS path FROM cats WHERE parent_id IS NULL UNION ALL SELECT c.id, c.name, t.level + 1, t.path || '/' || c.name FROM cats c JOIN tree t ON c.parent_id = t.id) SELECT id, name, level, path FROM tree""")(  # fmt: skip
    lambda s, d: a.category_tree(c.categories(s, d))
)

# --- pages ------------------------------------------------------------------------------
SQL_HREF = "href=[\"'']([^\"'']+)[\"'']"
PAGE_PATH = r"/(?:en|de|fr|es)/"
BASE = BASE_URL
query("discover_hrefs", f"SELECT DISTINCT unnest(regexp_extract_all(html, '{SQL_HREF}', 1)) AS href FROM pages")(lambda s, d: c.read(s, d, "pages").select(F.explode(u.hrefs("html")).alias("href")).distinct())
query("absolute_urls", f"""SELECT DISTINCT CASE WHEN h LIKE 'http%' THEN h ELSE '{BASE}' || h END AS url FROM (SELECT unnest(regexp_extract_all(html, '{SQL_HREF}', 1)) AS h FROM pages) WHERE h LIKE 'http%' OR h LIKE '/%'""")(
    lambda s, d: c.read(s, d, "pages").select(F.explode(u.absolute(u.hrefs("html"), BASE)).alias("url")).distinct()
)
query("canonical_urls", "SELECT page_id, split_part(split_part(url, '?', 1), '#', 1) AS url FROM pages")(lambda s, d: c.read(s, d, "pages").select("page_id", u.without_query(F.col("url")).alias("url")))
query("url_product_id", "SELECT page_id, nullif(regexp_extract(url, '/(?:en|de|fr|es)/(\\d+)', 1), '') AS product_id FROM pages")(lambda s, d: c.read(s, d, "pages").select("page_id", u.product_id("url", PAGE_PATH).alias("product_id")))
query("fallback_sku", "SELECT page_id, 'HP-' || upper(substr(md5(url), 1, 8)) AS sku FROM pages")(lambda s, d: c.read(s, d, "pages").select("page_id", u.fallback_sku("url").alias("sku")))
query("page_title", "SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages")(lambda s, d: c.read(s, d, "pages").select("page_id", t.first_match("html", "<title>([^<]*)</title>").alias("title")))
query("page_number", "SELECT page_id, CAST(nullif(regexp_extract(url, 'page[=/](\\d+)', 1), '') AS BIGINT) AS page_number FROM pages")(
    lambda s, d: c.read(s, d, "pages").select("page_id", t.first_match("url", r"page[=/](\d+)").cast("long").alias("page_number"))
)
ABSOLUTE = f"""links AS (SELECT DISTINCT page_id, url, CASE WHEN h LIKE 'http%' THEN h ELSE '{BASE}' || h END AS link FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '{SQL_HREF}', 1)) AS h FROM pages) WHERE h LIKE 'http%' OR h LIKE '/%')"""
query("crawl_urls", f"WITH {ABSOLUTE} SELECT page_id, url FROM pages WHERE url <> '' UNION ALL SELECT page_id, link FROM links WHERE link <> url")(
    lambda s, d: c.read(s, d, "pages").select("page_id", F.explode(u.crawl_urls("url", "html", F.lit(None).cast("array<string>"), BASE, "/", "")).alias("url"))
)
query("discover_products", f"WITH {ABSOLUTE} SELECT DISTINCT split_part(split_part(link, '?', 1), '#', 1) AS url FROM links")(
    lambda s, d: c.read(s, d, "pages").select(F.explode(u.page_products("html", F.lit(None).cast("array<string>"), BASE, "/", "")).alias("url")).distinct()
)
query("pagination_urls", "SELECT page_id, url FROM pages WHERE regexp_matches(url, 'page[=/]\\d+')")(
    lambda s, d: c.read(s, d, "pages").select("page_id", F.explode(u.pagination(F.concat(F.lit('<a href="'), "url", F.lit('">')), "url", BASE)).alias("url"))
)
query("search_urls", f"WITH {PRODUCTS} SELECT id, '{BASE}/search?q=' || replace(name, ' ', '+') AS url FROM products")(lambda s, d: c.products(s, d).select("id", u.search_url(BASE, "name").alias("url")))


@query("batch_summary", "SELECT count(*) AS total, count(*) FILTER (html LIKE '%<title>%') AS success, count(*) FILTER (html NOT LIKE '%<title>%') AS failed, round(count(*) FILTER (html LIKE '%<title>%') * 100.0::DOUBLE / count(*), 4) AS success_rate FROM pages")
def batch_summary(s, d):
    return a.batch_summary(c.read(s, d, "pages").select(F.contains("html", F.lit("<title>")).alias("ok")), "ok")


def raw_pages(s, d):
    """The pages in the raw page schema."""
    none = lambda kind: F.lit(None).cast(kind)
    p = c.read(s, d, "pages")
    price = F.concat(F.lit("฿"), F.format_number(F.col("page_id") * 7 % 4000 + 100, 0), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" ฿"), F.col("page_id") * 3 % 5000)).otherwise(F.lit("")))
    title = t.first_match("html", "<title>([^<]*)</title>")
    return p.select(
        "url", price.alias("markdown"), "html", none("array<string>").alias("linksOnPage"),
        F.struct(title.alias("title"), none("string").alias("description"), F.col("url").alias("sourceURL"), F.col("url").alias("url")).alias("metadata"),
        *[none("string").alias(x) for x in ("price", "current_price", "originalPrice", "original_price", "brand", "category", "description", "features_str")], none("array<string>").alias("features_arr"),
        none("map<string,string>").alias("specifications"), none("string").alias("images_str"), none("array<string>").alias("images_arr"), none("string").alias("availability"), none("string").alias("stock_status"),
    )


RECORDS = """raw AS (SELECT url, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, page_id * 7 % 4000 + 100 AS a, CASE WHEN page_id % 2 = 0 THEN page_id * 3 % 5000 END AS b FROM pages),
    priced AS (SELECT url, nullif(title, '') AS name, 'HP-' || upper(substr(md5(url), 1, 8)) AS sku, CASE WHEN b IS NULL THEN a WHEN b <> 0 THEN least(a, b) END AS cur, CASE WHEN b <> 0 THEN greatest(a, b) END AS orig FROM raw)"""


@query("extract_products", f"WITH {RECORDS} SELECT url, name, sku, CAST(cur AS DOUBLE) AS current_price, CAST(orig AS DOUBLE) AS original_price, CASE WHEN orig > cur THEN round((orig - cur) / CAST(orig AS DOUBLE) * 100, 4) END AS discount_percentage, 'unknown' AS availability FROM priced")
def extract_products(s, d):
    from ..operators.extract import extract

    p = extract(raw_pages(s, d))
    return p.select("url", "name", "sku", F.col("current_price").cast("double").alias("current_price"), F.col("original_price").cast("double").alias("original_price"), F.round("discount_percentage", 4).alias("discount_percentage"), "availability")


@query("quarantine", f"WITH {RECORDS}, judged AS (SELECT CASE WHEN name IS NULL THEN 'missing' WHEN cur <= 0 THEN 'price' WHEN length(name) NOT BETWEEN 3 AND 500 THEN 'name' ELSE 'valid' END AS outcome FROM priced) SELECT outcome, count(*) AS n FROM judged GROUP BY 1")
def quarantine(s, d):
    from ..operators.extract import extract

    return extract(raw_pages(s, d)).groupBy(F.coalesce(checks.rejection(), F.lit("valid")).alias("outcome")).agg(F.count("*").alias("n"))


# --- text -------------------------------------------------------------------------------
@query("extract_price", "SELECT p_partkey, p_retailprice AS price FROM part")
def extract_price(s, d):
    """Prices written as text and read again."""
    text = F.concat(F.lit("ราคา ฿ "), F.format_number("p_retailprice", 2), F.lit(" บาท"))
    return c.read(s, d, "part").select("p_partkey", t.extract_price(text).cast("double").alias("price"))


query("clean_text", "SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g')) AS text FROM documents")(lambda s, d: c.read(s, d, "documents").select("doc_id", t.clean_text("text").alias("text")))
query("extract_sku", f"WITH {PRODUCTS} SELECT id, sku AS found FROM products")(lambda s, d: c.products(s, d).select("id", t.extract_sku(F.concat(F.lit("Code: "), "sku", F.lit(" "), "name")).alias("found")))
for _name, _corrected in (("availability", False), ("availability_corrected", True)):
    query(_name, f"WITH {PRODUCTS} SELECT id, CASE WHEN availability = 'unknown' THEN 'unknown' WHEN availability = 'in_stock' THEN 'in_stock' ELSE '{'out_of_stock' if _corrected else 'in_stock'}' END AS state FROM products")(
        lambda s, d, n=_corrected: c.products(s, d).select("id", t.availability(F.when(F.col("availability") == "in_stock", "Ready, In Stock").when(F.col("availability") == "out_of_stock", "Unavailable").otherwise("call us"), n).alias("state"))
    )
query("features", "SELECT p_partkey, string_split(p_name, ' ') AS parts FROM part")(lambda s, d: c.read(s, d, "part").select("p_partkey", t.feature_list(F.concat(F.replace("p_name", F.lit(" "), F.lit(" , ")), F.lit(", "))).alias("parts")))
query("images", "SELECT page_id, ['https:' || regexp_replace(url, '^https?:', '')] AS images FROM pages")(
    lambda s, d: c.read(s, d, "pages").select("page_id", t.image_urls(F.array(F.concat(F.lit(" "), F.regexp_replace("url", "^https?:", ""), F.lit(" ")), F.lit("ftp://x"), F.lit(""))).alias("images"))
)
query("discount", f"WITH {PRODUCTS} SELECT id, CASE WHEN original_price > current_price THEN round((CAST(original_price AS DOUBLE) - CAST(current_price AS DOUBLE)) / CAST(original_price AS DOUBLE) * 100, 4) END AS discount FROM products")(
    lambda s, d: c.products(s, d).select("id", F.round(t.discount("current_price", "original_price"), 4).alias("discount"))
)
@query("serialised_products", f"""WITH {PRODUCTS} SELECT sku, name, brand, CAST(current_price AS DOUBLE) AS current_price, CAST(original_price AS DOUBLE) AS original_price, '2024-03-01T12:30:00' AS scraped_at,
    '[]' AS features, '{{}}' AS specifications, '[]' AS images, CASE WHEN original_price IS NULL THEN 'null' ELSE 'number' END AS original_kind, 13 AS keys FROM products""")  # fmt: skip
def serialised_products(s, d):
    """Products as JSON texts, and what a reader finds in them."""
    from ..sources.sinks import serialised

    full = c.products(s, d).withColumns({"scraped_at": F.lit("2024-03-01 12:30:00").cast("timestamp_ntz"), "created_at": F.lit("2024-03-01").cast("timestamp_ntz"), "features": F.lit(None).cast("array<string>"), "images": F.lit(None).cast("array<string>"), "specifications": F.lit(None).cast("map<string,string>"), "url": F.lit("u")})
    text = serialised(full)
    at = lambda k, kind="string": F.get_json_object("json", f"$.{k}").cast(kind).alias(k)
    return text.select(
        at("sku"), at("name"), at("brand"), at("current_price", "double"), at("original_price", "double"), at("scraped_at"), at("features"), at("specifications"), at("images"),
        F.when(F.contains("json", F.lit('"original_price":null')), "null").otherwise("number").alias("original_kind"), F.size(F.json_object_keys("json")).alias("keys"),
    )


# --- full forms of products, jobs and histories -------------------------------------------
@query("product_full_dto", f"""WITH {DATED} SELECT id, sku, name, brand, category, nullif(CAST(current_price AS DOUBLE), 0) AS current_price, nullif(CAST(original_price AS DOUBLE), 0) AS original_price, discount_percentage,
    CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN name END AS description, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN array_to_string(string_split(name, ' '), '|') ELSE '' END AS features, CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN brand END AS specification,
    availability, '' AS images, '{BASE_URL}/p/' || id AS url, scraped_at AS last_scraped, created_at, CAST(NULL AS TIMESTAMP) AS updated_at FROM dated""")  # fmt: skip
def product_full_dto(s, d):
    n = F.col("id").cast("long")
    p = c.products(s, d, True).withColumns({
        "description": F.when(n % 3 == 0, F.col("name")), "features": F.when(n % 2 == 0, F.split("name", " ")), "images": F.lit(None).cast("array<string>"),
        "specifications": F.when(n % 5 == 0, F.create_map(F.lit("brand"), "brand")), "url": F.concat(F.lit(f"{BASE_URL}/p/"), "id"), "updated_at": F.lit(None).cast("timestamp_ntz"),
    })
    dto = product_response(p)
    return dto.withColumns({"features": F.array_join("features", "|"), "images": F.array_join("images", "|"), "specification": dto.specifications["brand"]}).drop("specifications")


def product_response(p: DataFrame) -> DataFrame:
    """The 17 columns that a reader of a product gets; collections are never null, prices of 0 are."""
    plain = lambda x: F.nullif(F.col(x).cast("double"), F.lit(0.0)).alias(x)
    listed = lambda x: F.coalesce(x, F.array().cast("array<string>")).alias(x)
    return p.select(
        "id", "sku", "name", "brand", "category", plain("current_price"), plain("original_price"), "discount_percentage", "description", listed("features"), F.coalesce("specifications", F.create_map().cast("map<string,string>")).alias("specifications"),
        F.coalesce("availability", F.lit("unknown")).alias("availability"), listed("images"), "url", F.coalesce("scraped_at", "created_at").alias("last_scraped"), "created_at", "updated_at",
    )


query("jobs_full", f"WITH {JOBS} SELECT {', '.join(JOB_COLUMNS)}, 'product' AS job_type, CAST(NULL AS VARCHAR) AS target_url, CAST(NULL AS VARCHAR) AS error_message FROM jobs ORDER BY created_at DESC, id LIMIT 20")(
    lambda s, d: newest_jobs(s, d, columns=[*JOB_COLUMNS, "job_type", "target_url", "error_message"])
)


@query("price_history_list", f"""WITH {HISTORY}, ranked AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {NEWEST_FIRST}) AS n FROM history)
    SELECT product_id, 7 AS days, string_agg(CAST(CAST(price * 100 AS BIGINT) AS VARCHAR), ' ' ORDER BY n) AS history FROM ranked WHERE n <= 7 GROUP BY 1""")  # fmt: skip
def price_history_list(s, d):
    lists = a.history_lists(c.price_history(s, d), TIES, 7)
    return lists.select("product_id", "days", F.array_join(F.transform("history", lambda h: (h["price"] * 100).cast("long").cast("string")), " ").alias("history"))


query("search_ui_defaults", f"WITH {PRODUCTS}, lines AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber % 5 <> 0 THEN CAST(l_extendedprice AS DECIMAL(12,2)) END AS current_price FROM lineitem) SELECT count(*) AS shown FROM lines WHERE current_price BETWEEN 0 AND 10000")(
    lambda s, d: matching(c.read(s, d, "lineitem").select(F.when(F.col("l_linenumber") % 5 != 0, F.col("l_extendedprice").cast("decimal(12,2)")).alias("current_price")), SearchSpec(min_price=0, max_price=10000)).agg(F.count("*").alias("shown"))
)
query("search_literal", f"WITH {PRODUCTS} SELECT id, name FROM products WHERE contains(lower(name), 'in_') OR contains(lower(sku), 'in_') ORDER BY name, id LIMIT 20")(
    lambda s, d: search(c.products(s, d), SearchSpec(query="IN_", literal=True)).select("id", "name")
)
query("brands_empty_as_null", f"WITH {PRODUCTS} SELECT count(DISTINCT brand) AS with_empty, count(DISTINCT nullif(brand, '')) AS total_brands FROM (SELECT CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN '' ELSE brand END AS brand FROM products)")(
    lambda s, d: (p := c.products(s, d).select(F.when(F.col("id").cast("long") % 4 == 0, "").otherwise(F.col("brand")).alias("brand")).withColumn("stored", F.col("brand")))
    and a.empty_as_null(p, "brand").agg(F.countDistinct("stored").alias("with_empty"), F.countDistinct("brand").alias("total_brands"))
)
query("daily_calendar_window", f"{DAILY} SELECT * FROM daily WHERE date > (SELECT max(date) FROM daily) - INTERVAL 30 DAY")(lambda s, d: a.daily_window(a.daily_stats(c.jobs(s, d)), 30))


@query("scraping_stats", f"""{DAILY.replace('WITH ', f'WITH {PRODUCTS}, ', 1)} SELECT (SELECT count(*) FROM products) AS total_products, (SELECT round(avg(CAST(current_price AS DOUBLE)), 4) FROM products) AS avg_price,
    (SELECT string_agg(CAST(date AS VARCHAR) || ':' || jobs_run, ' ' ORDER BY date DESC) FROM (FROM daily ORDER BY date DESC LIMIT 7)) AS recent_activity""")  # fmt: skip
def scraping_stats(s, d):
    """One row: the catalogue's statistics and the last days' runs."""
    stats = a.product_stats(c.products(s, d)).select("total_products", "avg_price")
    days = a.daily_stats(c.jobs(s, d)).orderBy(F.desc("date")).limit(7).agg(F.array_join(F.reverse(F.array_sort(F.collect_list(F.concat(F.col("date").cast("string"), F.lit(":"), "jobs_run")))), " ").alias("recent_activity"))
    return stats.withColumn("recent_activity", days.scalar())


query("url_preview", "SELECT (SELECT string_agg(url, ' ' ORDER BY url) FROM (SELECT DISTINCT url FROM pages ORDER BY url LIMIT 10)) AS preview, greatest(count(DISTINCT url) - 10, 0) AS remaining FROM pages")(
    lambda s, d: u.preview(c.read(s, d, "pages"), 10)
)
query("pasted_urls", "SELECT page_id, trim(line, ' \t') AS url FROM (SELECT page_id, unnest(string_split(url || chr(10) || '  ' || chr(10) || chr(10) || ' ' || upper(url) || ' ', chr(10))) AS line FROM pages) WHERE trim(line, ' \t') <> ''")(
    lambda s, d: c.read(s, d, "pages").select("page_id", F.explode(u.pasted_urls(F.concat("url", F.lit("\n  \n\n "), F.upper("url"), F.lit(" ")))).alias("url"))
)

# --- jobs: requests, runs, ends -------------------------------------------------------------
#: Orders as requests: product, category and search jobs, with addresses or a target missing in some.
REQUESTS = f"""requests AS (SELECT 'job-' || o_orderkey AS job_id, ['product', 'category', 'search', 'discovery'][o_orderkey % 4 + 1] AS job_type, CASE WHEN o_custkey % 3 <> 0 THEN '{BASE_URL}/c/' || o_custkey END AS target_url,
    CASE WHEN o_orderkey % 5 <> 0 THEN '{BASE_URL}/p/' || o_custkey END AS first_url, o_orderdate AS asked_at FROM orders)"""
REFUSED = f"CASE WHEN job_type = 'discovery' THEN '{j.BAD_JOB}' WHEN job_type = 'product' AND first_url IS NULL THEN '{j.NO_URLS}' WHEN job_type <> 'product' AND target_url IS NULL THEN '{j.NO_TARGET}' END"


def requests(s, d):
    o = c.read(s, d, "orders")
    kinds = F.array(*map(F.lit, ["product", "category", "search", "discovery"]))
    urls = F.when(F.col("o_orderkey") % 5 != 0, F.array(F.concat(F.lit(f"{BASE_URL}/p/"), "o_custkey"))).otherwise(F.array().cast("array<string>"))
    return o.select(F.concat(F.lit("job-"), "o_orderkey").alias("job_id"), F.get(kinds, (F.col("o_orderkey") % 4).cast("int")).alias("job_type"), F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit(f"{BASE_URL}/c/"), "o_custkey")).alias("target_url"), urls.alias("urls"), F.col("o_orderdate").alias("at"))


query("job_requests", f"WITH {REQUESTS} SELECT job_id, {REFUSED} AS error, coalesce(target_url, first_url) AS target_url FROM requests")(lambda s, d: j.requested(requests(s, d)).select("job_id", "error", "target_url"))
query("job_creation", f"WITH {REQUESTS} SELECT job_type, 'pending' AS status, count(*) AS jobs, min(asked_at) AS first_at, 0 AS items FROM requests WHERE {REFUSED} IS NULL GROUP BY 1")(
    lambda s, d: j.job_table(j.created(requests(s, d))).groupBy("job_type", "status").agg(F.count("*").alias("jobs"), F.min("created_at").alias("first_at"), F.sum("total_items").alias("items"))
)


@query("job_life_cycle", """WITH log AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status FROM events)
    SELECT user_id, max(ts) FILTER (status = 'running') AS started_at, max(ts) FILTER (status IN ('completed', 'failed')) AS completed_at, min(ts) AS created_at, arg_max(CASE WHEN status = 'failed' THEN 'error ' || event_id END, (ts, event_id)) FILTER (status = 'failed') AS error_message FROM log GROUP BY 1""")  # fmt: skip
def job_life_cycle(s, d):
    """Events as a log of jobs' changes; the number of an event stands for the items done."""
    kinds = F.create_map(*[F.lit(x) for kv in STATUS_OF.items() for x in kv])
    e = c.read(s, d, "events").withColumn("status", kinds[F.col("event_type")])
    none = lambda kind: F.lit(None).cast(kind)
    log = e.select(
        F.col("user_id").cast("string").alias("job_id"), F.col("ts").alias("at"), F.lit("product").alias("job_type"), "status", none("string").alias("target_url"), none("long").alias("total_items"), F.col("event_id").alias("processed_items"),
        none("long").alias("success_items"), none("long").alias("failed_items"), F.when(F.col("status") == "failed", F.concat(F.lit("error "), "event_id")).alias("error_message"),
    )
    return j.job_table(log).select(F.col("job_id").cast("long").alias("user_id"), "started_at", "completed_at", "created_at", "error_message")


@query("cancel_jobs", f"""WITH {JOBS}, asked AS (SELECT o_orderkey AS id FROM orders UNION ALL SELECT -o_orderkey - 1 FROM orders WHERE o_orderkey % 10 = 0)
    SELECT asked.id, CASE WHEN status IN ('pending', 'running') THEN 'cancelled' END AS event, CASE WHEN status IS NULL THEN '{j.NO_JOB}' WHEN status IN ('pending', 'running') THEN '{j.CANCELLED}' ELSE 'Cannot cancel job with status: ' || status END AS message FROM asked LEFT JOIN jobs USING (id)""")  # fmt: skip
def cancel_jobs(s, d):
    jobs = c.orders_as_jobs(s, d).withColumnRenamed("id", "job_id")
    asked = jobs.select("job_id").union(jobs.where("job_id % 10 = 0").select(-F.col("job_id") - 1))
    return j.cancelled(jobs, asked).withColumnRenamed("job_id", "id")


#: Parts as a shop: a listing of four pages a brand, and a page a product; some weren't landed, some have no price or too short a name or key.
LANDED = "p_partkey % 7 <> 0"
SAVED = f"{LANDED} AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_partkey >= 100"


def shop(s, d):
    part = c.read(s, d, "part").select("p_partkey", "p_name", F.concat(F.lit(f"{BASE_URL}/c/"), F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("listing"), "p_retailprice")
    n = F.col("p_partkey") % 4 + 1
    link = F.concat(F.lit('<a href="/p/'), "p_partkey", F.lit('?ref=list">x</a>'))
    more = F.array_join(F.transform(F.array(*map(F.lit, "234")), lambda x: F.concat(F.lit('<a href="?page='), x, F.lit('">more</a>'))), "")
    links = part.select("listing", n.alias("n"), link.alias("link")).union(part.select("listing", F.lit(1), F.lit("")))  # a brand has a first page, if without products
    listings = links.groupBy("listing", "n").agg(F.array_join(F.collect_list("link"), " ").alias("links"))
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    none = lambda kind: F.lit(None).cast(kind)
    blank = {"linksOnPage": "array<string>", "originalPrice": "string", "original_price": "string", "current_price": "string", "brand": "string", "category": "string", "description": "string", "features_str": "string", "features_arr": "array<string>", "specifications": "map<string,string>", "images_str": "string", "images_arr": "array<string>", "availability": "string", "stock_status": "string", "markdown": "string"}
    title = lambda t: F.struct(t.alias("title"), none("string").alias("description"), none("string").alias("sourceURL"), none("string").alias("url"))
    pages = listings.select(F.when(F.col("n") == 1, F.col("listing")).otherwise(F.concat("listing", F.lit("?page="), "n")).alias("url"), F.concat("links", more).alias("html"), none("string").alias("price"), title(none("string")).alias("metadata"), at.alias("scraped_at"))
    key = F.col("p_partkey")
    price = F.when(key % 11 == 0, "0").otherwise(F.format_string("฿%.2f", "p_retailprice"))
    name = F.when(key % 13 == 0, "xx").otherwise(F.col("p_name"))
    products = part.where(LANDED).select(F.concat(F.lit(f"{BASE_URL}/p/"), "p_partkey").alias("url"), none("string").alias("html"), price.alias("price"), title(name).alias("metadata"), at.alias("scraped_at"))
    return pages.union(products).select("*", *[none(k).alias(x) for x, k in blank.items()])


def starts(s, d):
    brands = c.read(s, d, "part").select(F.concat(F.lit(f"{BASE_URL}/c/"), F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("start_url")).distinct()
    return brands.union(s.range(1).select(F.lit(f"{BASE_URL}/c/none").alias("start_url")))


START_SQL = f"'{BASE_URL}/c/' || replace(p_brand, '#', '-')"
query("discover_category", f"SELECT {START_SQL} AS start_url, '{BASE_URL}/p/' || p_partkey AS url FROM part WHERE p_partkey % 4 < 3")(lambda s, d: discovery.discover(shop(s, d), starts(s, d), BASE_URL, 3))
query("discover_envelope", f"SELECT {START_SQL} AS url, 2 AS max_pages, min('{BASE_URL}/p/' || p_partkey) AS first_url, count(*) AS total FROM part WHERE p_partkey % 4 < 2 GROUP BY 1 UNION ALL SELECT '{BASE_URL}/c/none', 2, NULL, 0")(
    lambda s, d: discovery.envelope(discovery.discover(shop(s, d), starts(s, d), BASE_URL, 2), starts(s, d), 2).select("url", "max_pages", F.get("discovered_urls", F.lit(0)).alias("first_url"), "total")
)


@query("discover_search", f"""SELECT q.query, url FROM (SELECT DISTINCT p_brand AS query FROM part) q, LATERAL (SELECT '{BASE_URL}/p/' || p_partkey AS url FROM part WHERE p_brand = q.query AND p_partkey % 4 = 0 ORDER BY url LIMIT 5)""")
def discover_search(s, d):
    """The listings' first pages as search pages."""
    own = F.regexp_extract("url", r"/c/(Brand-\d+)$", 1)
    found = shop(s, d).where(own != "").withColumn("url", u.search_url(BASE_URL, F.replace(own, F.lit("-"), F.lit("#"))))
    return discovery.discover_from_search(found, c.read(s, d, "part").select(F.col("p_brand").alias("query")).distinct(), BASE_URL, 5)


def wanted(s, d):
    """A job a brand, with its products' addresses in order of key."""
    p = c.read(s, d, "part")
    return p.select(F.col("p_brand").alias("job_id"), F.concat(F.lit(f"{BASE_URL}/p/"), "p_partkey").alias("url"), F.col("p_partkey").alias("position"))


query("batch_run", f"SELECT p_brand AS job_id, count(*) AS total, count(*) FILTER ({SAVED}) AS success, count(*) FILTER (NOT ({SAVED})) AS failed, round(count(*) FILTER ({SAVED}) * 100.0::DOUBLE / count(*), 4) AS success_rate FROM part GROUP BY 1")(
    lambda s, d: j.batch_summary(j.outcomes(wanted(s, d), shop(s, d), ["scraped_at"])[0]).withColumn("success_rate", F.col("success_rate").cast("double"))
)
query("batch_outcomes", f"SELECT CASE WHEN NOT ({LANDED}) THEN 'not fetched' WHEN p_partkey % 11 = 0 THEN 'price' WHEN p_partkey % 13 = 0 THEN 'name' WHEN p_partkey < 100 THEN 'sku' ELSE 'saved' END AS outcome, count(*) AS n FROM part GROUP BY 1")(
    lambda s, d: j.outcomes(wanted(s, d), shop(s, d), ["scraped_at"])[0].groupBy("outcome").agg(F.count("*").alias("n"))
)
query("batch_progress", f"""WITH chunks AS (SELECT p_brand AS job_id, p_partkey // 50 AS chunk, count(*) AS n, count(*) FILTER ({SAVED}) AS good FROM part GROUP BY 1, 2)
    SELECT job_id, chunk, CAST(sum(n) OVER w AS BIGINT) AS processed_items, CAST(sum(good) OVER w AS BIGINT) AS success_items, CAST(sum(n - good) OVER w AS BIGINT) AS failed_items FROM chunks WINDOW w AS (PARTITION BY job_id ORDER BY chunk)""")(  # fmt: skip
    lambda s, d: j.chunk_progress(j.outcomes(wanted(s, d), shop(s, d), ["scraped_at"])[0], 50)
)
query("batch_products", f"SELECT CAST(p_partkey AS VARCHAR) AS sku, p_name AS name, p_retailprice AS current_price FROM part WHERE {SAVED}")(
    lambda s, d: j.outcomes(wanted(s, d), shop(s, d), ["scraped_at"])[1].select("sku", "name", F.col("current_price").cast("double").alias("current_price"))
)


@query("run_jobs", f"""WITH found AS (SELECT 'c ' || {START_SQL} AS job_id, {SAVED} AS ok FROM part WHERE p_partkey % 4 < 3 UNION ALL SELECT 'p ' || p_partkey, {SAVED} FROM part WHERE p_partkey % 3 = 0)
    SELECT job_id, 'completed' AS status, count(*) AS total_items, count(*) FILTER (ok) AS success_items, count(*) FILTER (NOT ok) AS failed_items, CAST(NULL AS VARCHAR) AS error_message FROM found GROUP BY 1
    UNION ALL SELECT 'c {BASE_URL}/c/none', 'failed', NULL, NULL, NULL, '{j.NOTHING_FOUND}' UNION ALL SELECT DISTINCT 's ' || {START_SQL}, 'failed', NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, '{j.BAD_JOB}' FROM part""")  # fmt: skip
def run_jobs(s, d):
    """Jobs as their log folds."""
    return j.job_table(ran(s, d)[0]).select("job_id", "status", "total_items", "success_items", "failed_items", "error_message")


query("run_jobs_log", f"""WITH found AS (SELECT 'c ' || {START_SQL} AS job_id, {SAVED} AS ok FROM part WHERE p_partkey % 4 < 3 UNION ALL SELECT 'p ' || p_partkey, {SAVED} FROM part WHERE p_partkey % 3 = 0), sums AS (SELECT job_id, count(*) AS n, count(*) FILTER (ok) AS good FROM found GROUP BY 1)
    SELECT job_id, 1 + CAST(ceil(n / 5.0) AS BIGINT) AS running, 1 AS ended, n AS processed, good AS saved FROM sums UNION ALL SELECT 'c {BASE_URL}/c/none', 0, 1, NULL, NULL UNION ALL SELECT DISTINCT 's ' || {START_SQL}, 0, 1, NULL::BIGINT, NULL::BIGINT FROM part""")(  # fmt: skip
    lambda s, d: ran(s, d)[0].groupBy("job_id").agg(F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status").isin("completed", "failed")).alias("ended"), F.max("processed_items").alias("processed"), F.max("success_items").alias("saved"))
)


@query("run_jobs_products", f"SELECT CAST(p_partkey AS VARCHAR) AS sku, p_name AS name, p_retailprice AS current_price FROM part WHERE ({SAVED}) AND (p_partkey % 4 < 3 OR p_partkey % 3 = 0)")
def run_jobs_products(s, d):
    """What the jobs' products leave in a snapshot store."""
    from ..operators.bucketed import Snapshot
    from ..sources.storage import scratch

    store = Snapshot(s, scratch(s, "snapshot"), buckets=4)
    store.merge(ran(s, d)[1], 0)
    return store.read().select("sku", "name", F.col("current_price").cast("double").alias("current_price"))


def ran(s, d):
    """A category job a brand (and one that leads nowhere), a product job for some parts, a search job a brand."""
    none, at = F.array().cast("array<string>"), F.lit("2024-01-01").cast("timestamp_ntz")
    listings = starts(s, d)
    part = c.read(s, d, "part").where("p_partkey % 3 = 0")
    asked = listings.select(F.concat(F.lit("c "), "start_url").alias("job_id"), F.lit("category").alias("job_type"), F.col("start_url").alias("target_url"), none.alias("urls"), at.alias("at"))
    asked = asked.union(listings.where(~F.col("start_url").endswith("none")).select(F.concat(F.lit("s "), "start_url"), F.lit("search"), "start_url", none, at))
    asked = asked.union(part.select(F.concat(F.lit("p "), "p_partkey"), F.lit("product"), F.lit(None).cast("string"), F.array(F.concat(F.lit(f"{BASE_URL}/p/"), "p_partkey")), at))
    return j.run_jobs(asked, shop(s, d), ["scraped_at"], BASE_URL, 3)


query("rescrape", f"SELECT 'rescrape-' || p_partkey AS job_id, 'pending' AS status, '{BASE_URL}/p/' || p_partkey AS target_url FROM part WHERE p_partkey % 5 = 1 AND p_partkey % 2 = 0")(
    lambda s, d: j.created(j.rescrape(c.products(s, d).withColumn("url", F.when(F.col("id").cast("long") % 2 == 0, F.concat(F.lit(f"{BASE_URL}/p/"), "id"))), c.read(s, d, "part").where("p_partkey % 5 = 1").select(F.col("p_partkey").cast("string").alias("id")), F.lit("2024-01-01").cast("timestamp_ntz"))).select("job_id", "status", "target_url")
)


@query("snapshot_touch", f"""WITH {HISTORY}, log AS (SELECT product_id AS sku, price AS current_price, recorded_at AS scraped_at FROM history), sides AS (SELECT sku, bool_or(scraped_at < TIMESTAMP '2000-01-01') AS stored, bool_or(scraped_at >= TIMESTAMP '2000-01-01') AS came, min(scraped_at) AS first_at FROM log GROUP BY 1)
    SELECT count(*) FILTER (stored AND came) AS updated, count(*) FILTER (stored AND NOT came) AS untouched, count(*) FILTER (NOT stored) AS inserted FROM sides""")  # fmt: skip
def snapshot_touch(s, d):
    """updated_at is set on the rows that an upsert updates, and on no others."""
    log = c.price_history(s, d).select(F.col("product_id").alias("sku"), F.col("price").alias("current_price"), F.col("recorded_at").alias("scraped_at"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    new = F.col("scraped_at") >= F.lit("2000-01-01").cast("timestamp_ntz")
    stored = upsert.latest(log.where(~new), ["sku"], ["scraped_at", "current_price"])
    after = upsert.upsert(stored, log.where(new), ties=["current_price"], now=F.lit("2024-01-01").cast("timestamp_ntz"))
    was = F.col("scraped_at") < F.lit("2000-01-01").cast("timestamp_ntz")
    return after.agg(F.count("updated_at").alias("updated"), F.count_if(F.col("updated_at").isNull() & was).alias("untouched"), F.count_if(F.col("updated_at").isNull() & ~was).alias("inserted"))


from . import pages, stores, structures  # noqa: E402, F401  they register further queries
