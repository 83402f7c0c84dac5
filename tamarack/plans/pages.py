"""Queries over raw pages with every field filled, over sinks, checks and jobs that stop."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import checks
from ..operators import jobs as j
from ..operators.bucketed import Snapshot
from ..operators.extract import extract, split_valid
from ..operators.search import SearchSpec
from ..sources import catalog as c
from ..sources import sinks
from ..sources.storage import scratch
from .registry import BASE_URL, PRODUCTS, STATUS_OF, query


# --- full pages -------------------------------------------------------------------------------
def full_pages(s, d):
    """Parts as raw pages: each third says its prices, brand, and stock in another way."""
    p = c.spread(c.read(s, d, "part"), "p_partkey")
    n, none = F.col("p_partkey"), lambda kind: F.lit(None).cast(kind)
    third = lambda a, b, z: F.when(n % 3 == 0, a).when(n % 3 == 1, b).otherwise(z)
    low, high = F.floor("p_retailprice"), F.floor("p_retailprice") + F.col("p_size")
    sold = F.concat(F.lit("มีคนซื้อไปแล้ว 12 ชิ้น\n฿"), low, F.lit(" /each ฿"), high)
    title = F.concat(F.lit("  "), F.col("p_name"), F.lit("\n"))
    described = third(F.concat("p_name", F.lit(" ,  "), "p_brand", F.lit(" , SKU: x-"), n), F.lit("no fields"), none("string"))
    return p.select(
        F.concat(F.lit(f"{BASE_URL}/x/"), n).alias("url"), third(sold, F.concat(F.lit("# เครื่อง "), "p_name", F.lit("\nprice ฿"), high, F.lit(" now ฿"), low), none("string")).alias("markdown"), none("string").alias("html"), none("array<string>").alias("linksOnPage"),
        F.struct(third(title, none("string"), title).alias("title"), described.alias("description"), none("string").alias("sourceURL"), none("string").alias("url")).alias("metadata"),
        none("string").alias("price"), F.concat(F.lit("฿"), low).alias("current_price"), none("string").alias("originalPrice"), F.concat(high, F.lit(".50 บาท")).alias("original_price"),
        F.concat(F.lit(" own\t"), "p_brand").alias("brand"), F.concat(F.lit("\n"), "p_type", F.lit("  ")).alias("category"), F.concat("p_name", F.lit(" \x07 and  more")).alias("description"),
        F.lit("a, b,,c ").alias("features_str"), third(F.array("p_brand"), none("array<string>"), none("array<string>")).alias("features_arr"), third(F.create_map(F.lit("size"), F.col("p_size").cast("string")), none("map<string,string>"), none("map<string,string>")).alias("specifications"),
        F.lit("//cdn.example.com/i.jpg").alias("images_str"), none("array<string>").alias("images_arr"), third(F.lit(""), F.lit("In stock"), none("string")).alias("availability"), F.lit("sold out").alias("stock_status"),
    )


FULL = f"""WITH full_pages AS (SELECT *, p_partkey % 3 AS k, CAST(floor(p_retailprice) AS BIGINT) AS low, CAST(floor(p_retailprice) AS BIGINT) + p_size AS high, '{BASE_URL}/x/' || p_partkey AS url FROM part),
    extracted AS (SELECT url, CASE WHEN k = 0 THEN 'X-' || p_partkey ELSE 'HP-' || upper(substr(md5(url), 1, 8)) END AS sku, CASE WHEN k = 1 THEN 'เครื่อง ' || p_name ELSE p_name END AS name,
        CASE WHEN k = 0 THEN p_brand ELSE 'own ' || p_brand END AS brand, p_type AS category, p_name || '  and more' AS description, CAST(low AS DOUBLE) AS current_price, CAST(CASE WHEN k = 2 THEN high + 0.5 ELSE high END AS DOUBLE) AS original_price,
        CASE WHEN k = 0 THEN p_brand ELSE 'a|b|c' END AS features, CASE WHEN k = 0 THEN CAST(p_size AS VARCHAR) END AS size, 'https://cdn.example.com/i.jpg' AS images, CASE WHEN k = 1 THEN 'in_stock' ELSE 'out_of_stock' END AS availability FROM full_pages)"""


def extracted(s, d):
    return extract(full_pages(s, d))


query("extract_full", f"{FULL} SELECT url, sku, name, brand, category, replace(description, '  ', ' ') AS description, current_price, original_price, round((original_price - current_price) / original_price * 100, 4) AS discount_percentage, features, size, images, availability FROM extracted")(
    lambda s, d: extracted(s, d).select(
        "url", "sku", "name", "brand", "category", F.replace("description", F.lit("  "), F.lit(" ")).alias("description"), F.col("current_price").cast("double").alias("current_price"), F.col("original_price").cast("double").alias("original_price"), F.round("discount_percentage", 4).alias("discount_percentage"),
        F.array_join("features", "|").alias("features"), F.col("specifications")["size"].alias("size"), F.array_join("images", "|").alias("images"), "availability",
    )
)
query("record_ids", f"{FULL} SELECT sku, sha256(sku) AS id, count(*) AS n FROM extracted GROUP BY 1, 2")(lambda s, d: extracted(s, d).groupBy("sku", "id").agg(F.count("*").alias("n")))


@query("page_to_snapshot", f"{FULL} SELECT sku, name, current_price, 1 AS changes FROM extracted")
def page_to_snapshot(s, d):
    """Pages through extraction, checks, snapshot and history: each page once at a higher price, then at its own.
    The key is the address: skus made of eight digits of its hash meet by chance from some 10,000 pages on."""
    from ..operators.changes import ChangeLog

    pages = full_pages(s, d).withColumn("scraped_at", F.lit("2024-01-02").cast("timestamp"))
    dear = F.regexp_replace(F.col("markdown"), "฿", "฿1")
    before = pages.withColumns({"scraped_at": F.lit("2024-01-01").cast("timestamp"), "markdown": dear, "current_price": F.concat(F.lit("1"), F.regexp_replace("current_price", "฿", ""))})
    store, log = Snapshot(s, scratch(s, "snapshot"), key="url", buckets=4), ChangeLog(s, scratch(s, "changes"), buckets=4)
    for n, batch in enumerate((pages, before)):  # the newer ones first
        rows = split_valid(extract(batch, "scraped_at"))[0].withColumn("created_at", F.col("scraped_at"))
        store.merge(rows, n)
        log.append(rows.select(F.col("url").alias("key"), F.col("scraped_at").alias("at"), F.col("current_price").alias("price")), n)
    changes = log.history().groupBy(F.col("key").alias("__url")).agg(F.count("*").alias("changes"))
    return store.read().join(changes, F.col("url") == F.col("__url"), "left").select("sku", "name", F.col("current_price").cast("double").alias("current_price"), F.coalesce("changes", F.lit(0)).alias("changes"))


# --- sinks --------------------------------------------------------------------------------------
@query("url_file", "SELECT url AS value FROM pages WHERE url <> ''")
def url_file(s, d):
    """The lines of an address list."""
    path = scratch(s, "urls")
    sinks.write_urls(c.read(s, d, "pages").where("url <> ''"), path)
    return s.read.text(path)


@query("csv_export", f"WITH {PRODUCTS} SELECT id, sku, name, CAST(current_price AS DOUBLE) AS current_price, CAST(original_price AS DOUBLE) AS original_price, '[\"' || brand || '\",\"' || category || '\"]' AS features FROM products")
def csv_export(s, d):
    """An export, read back: names, quotes, nulls and nested columns."""
    path = scratch(s, "csv")
    sinks.export_csv(c.products(s, d).withColumn("features", F.array("brand", "category")), path)
    rows = s.read.option("header", True).option("escape", "\\").csv(path)
    return rows.select("id", "sku", "name", F.col("current_price").cast("double").alias("current_price"), F.col("original_price").cast("double").alias("original_price"), "features")


# --- checks -------------------------------------------------------------------------------------
@query("model_errors", f"""WITH {PRODUCTS}, odd AS (SELECT id, CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN '   ' ELSE '  ' || sku || ' ' END AS sku, CASE WHEN CAST(id AS BIGINT) % 11 = 0 THEN '' ELSE category || ' ' END AS category_name, CASE WHEN CAST(id AS BIGINT) % 13 = 0 THEN -1 ELSE current_price END AS current_price, CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN -original_price ELSE original_price END AS original_price FROM products)
    SELECT id, CASE WHEN CAST(id AS BIGINT) % 7 = 0 OR CAST(id AS BIGINT) % 11 = 0 OR current_price < 0 OR coalesce(original_price < 0, false) THEN NULL ELSE trim(sku) END AS sku, CASE WHEN CAST(id AS BIGINT) % 7 = 0 OR CAST(id AS BIGINT) % 11 = 0 OR current_price < 0 OR coalesce(original_price < 0, false) THEN NULL ELSE trim(category_name) END AS category_name,
        nullif(concat_ws(',', CASE WHEN trim(sku) = '' THEN 'sku' END, CASE WHEN category_name = '' THEN 'category_name' END, CASE WHEN current_price < 0 THEN 'current_price' END, CASE WHEN original_price < 0 THEN 'original_price' END), '') AS errors FROM odd""")  # fmt: skip
def model_errors(s, d):
    n = F.col("id").cast("long")
    odd = c.products(s, d).select("id", F.when(n % 7 == 0, "   ").otherwise(F.concat(F.lit("  "), "sku", F.lit(" "))).alias("sku"), F.when(n % 11 == 0, "").otherwise(F.concat("category", F.lit(" "))).alias("category_name"), F.when(n % 13 == 0, -1).otherwise(F.col("current_price")).alias("current_price"), F.when(n % 5 == 0, -F.col("original_price")).otherwise(F.col("original_price")).alias("original_price"))
    good, bad = checks.modelled(odd)
    none = F.lit(None).cast("string")
    return good.select("id", "sku", "category_name", none.alias("errors")).union(bad.select("id", none, none, "errors"))


query("page_requests", """SELECT o_orderkey AS id, o_custkey % 4 AS page, o_orderkey % 150 AS page_size, o_custkey % 4 >= 1 AND o_orderkey % 150 BETWEEN 1 AND 100 AS fits FROM orders""")(
    lambda s, d: c.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 4).alias("page"), (F.col("o_orderkey") % 150).alias("page_size")).withColumn("fits", SearchSpec.fits("page", "page_size"))
)


# --- jobs that stop -------------------------------------------------------------------------------
def job_log(s, d):
    kinds = F.create_map(*[F.lit(x) for kv in STATUS_OF.items() for x in kv])
    none = lambda kind: F.lit(None).cast(kind)
    e = c.read(s, d, "events")
    return e.select(
        F.col("user_id").cast("string").alias("job_id"), F.col("ts").alias("at"), F.lit("product").alias("job_type"), kinds[F.col("event_type")].alias("status"), none("string").alias("target_url"), none("long").alias("total_items"), F.col("event_id").alias("processed_items"),
        none("long").alias("success_items"), none("long").alias("failed_items"), none("string").alias("error_message"),
    )


@query("job_timeouts", f"""WITH log AS (SELECT user_id, ts, event_id, event_type IN ('purchase', 'error') AS over FROM events), ends AS (SELECT user_id, min(ts) FILTER (over) AS end_at FROM log GROUP BY 1),
    met AS (SELECT l.*, end_at, lag(ts) OVER (PARTITION BY l.user_id ORDER BY ts, event_id) AS before FROM log l JOIN ends e ON l.user_id = e.user_id WHERE end_at IS NULL OR ts <= end_at),
    silent AS (SELECT user_id, min(before) FILTER (CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(before)) AS BIGINT) > 21600) AS first_at, max(ts) AS last_at, max(end_at) AS end_at FROM met GROUP BY 1),
    since AS (SELECT user_id, coalesce(first_at, CASE WHEN end_at IS NULL AND floor(epoch((SELECT max(ts) FROM events))) - floor(epoch(last_at)) > 21600 THEN last_at END) AS at_time FROM silent)
    SELECT user_id, at_time + INTERVAL 21600 SECOND AS failed_at, '{j.TIMED_OUT}' AS message FROM since WHERE at_time IS NOT NULL""")  # fmt: skip
def job_timeouts(s, d):
    """Jobs that made no progress for six hours."""
    log = job_log(s, d)
    newest = log.agg(F.max("at")).scalar()
    return j.timed_out(log, newest, 21_600).select(F.col("job_id").cast("long").alias("user_id"), F.col("at").alias("failed_at"), F.col("error_message").alias("message"))


# --- rows that break a rule -----------------------------------------------------------------------
query("duplicate_keys", "SELECT 'K' || p_partkey // 3 AS sku, count(*) AS n FROM part WHERE p_partkey % 7 <> 0 GROUP BY 1 HAVING count(*) > 1")(
    lambda s, d: checks.duplicates(c.read(s, d, "part").where("p_partkey % 7 <> 0").select(F.concat(F.lit("K"), F.floor(F.col("p_partkey") / 3)).alias("sku")), "sku")
)
ODD_STATUS = ["pending", "paused", "completed", "queued", None]
query("job_status_violations", "SELECT ['pending', 'paused', 'completed', 'queued', NULL][o_orderkey % 5 + 1] AS status, count(*) AS n FROM orders WHERE o_orderkey % 5 IN (1, 3, 4) GROUP BY 1")(
    lambda s, d: checks.enum_violations(c.read(s, d, "orders").select(F.get(F.array(*[F.lit(x).cast("string") for x in ODD_STATUS]), (F.col("o_orderkey") % 5).cast("int")).alias("status")), "status", ["pending", "running", "completed", "failed", "cancelled"])
)


@query("quarantine_reasons", """WITH odd AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN 'missing' WHEN p_partkey % 7 = 0 THEN 'price' WHEN p_partkey % 5 = 0 OR p_partkey % 13 = 0 THEN 'name' WHEN p_partkey % 3 = 0 THEN 'sku' ELSE 'valid' END AS outcome FROM part)
    SELECT outcome, count(*) AS n FROM odd GROUP BY 1""")  # fmt: skip
def quarantine_reasons(s, d):
    """Products of which each breaks another rule, the first of those that it breaks."""
    k = F.col("p_partkey")
    odd = c.read(s, d, "part").select(
        F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise(F.lit("u")).alias("url"), F.when(k % 7 == 0, 0).otherwise(1).cast("decimal(12,2)").alias("current_price"),
        F.when(k % 5 == 0, "ab").when(k % 13 == 0, F.repeat(F.lit("n"), 501)).otherwise("abc").alias("name"), F.when(k % 3 == 0, "x").otherwise("xyz").alias("sku"),
    )
    valid, rejected = split_valid(odd)
    return rejected.select(F.col("reason").alias("outcome")).union(valid.select(F.lit("valid"))).groupBy("outcome").agg(F.count("*").alias("n"))


#: What pages say of stock; in the plain order, and in the corrected one.
STOCK = [("In Stock", "in_stock", "in_stock"), ("OUT OF STOCK", "out_of_stock", "out_of_stock"), ("ไม่มีสินค้า", "in_stock", "out_of_stock"), ("already sold out", "in_stock", "out_of_stock"), ("พร้อมส่ง 3 วัน", "in_stock", "in_stock"), ("หมด", "out_of_stock", "out_of_stock"), ("call us", "unknown", "unknown"), ("", "unknown", "unknown"), (None, "unknown", "unknown"), ("Unavailable", "in_stock", "out_of_stock")]
query("stock_phrases", f"SELECT p_partkey, {[p for _, p, _ in STOCK]}[p_partkey % {len(STOCK)} + 1] AS plain, {[x for _, _, x in STOCK]}[p_partkey % {len(STOCK)} + 1] AS corrected FROM part")(
    lambda s, d: c.read(s, d, "part")
    .select("p_partkey", F.get(F.array(*[F.lit(x).cast("string") for x, _, _ in STOCK]), (F.col("p_partkey") % len(STOCK)).cast("int")).alias("said"))
    .select("p_partkey", t.availability("said").alias("plain"), t.availability("said", True).alias("corrected"))
)


@query("serialised_full", f"""WITH {PRODUCTS} SELECT sku, strftime(DATE '2024-01-01' + CAST(CAST(id AS BIGINT) % 300 AS INTEGER), '%Y-%m-%dT00:00:00') AS scraped_at, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN '["' || replace(name, ' ', '","') || '"]' ELSE '[]' END AS features,
    CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN brand END AS brand_told, CAST(original_price AS DOUBLE) AS original_price FROM products""")  # fmt: skip
def serialised_full(s, d):
    """Products with times, lists and maps of their own as JSON, read back."""
    n = F.col("id").cast("long")
    p = c.products(s, d).withColumns({
        "scraped_at": F.date_add(F.lit("2024-01-01").cast("date"), (n % 300).cast("int")).cast("timestamp_ntz"), "features": F.when(n % 2 == 0, F.split("name", " ")), "specifications": F.when(n % 3 == 0, F.create_map(F.lit("brand"), "brand")),
    })
    at = lambda path, name, kind="string": F.get_json_object("json", path).cast(kind).alias(name)
    return sinks.serialised(p).select(at("$.sku", "sku"), at("$.scraped_at", "scraped_at"), at("$.features", "features"), at("$.specifications.brand", "brand_told"), at("$.original_price", "original_price", "double"))
