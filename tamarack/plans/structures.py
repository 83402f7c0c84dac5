"""Queries over category trees, deletes, crawl output, attempts and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attempts, dashboard, hierarchy
from ..sources import catalog as c
from ..sources.crawl import crawl_items as read_items
from ..sources.crawl import item_urls
from ..sources.storage import scratch, written
from .registry import BASE_URL, HISTORY, JOBS, PRODUCTS, SQL_HREF, query

# --- category trees ---------------------------------------------------------------------------
#: Parts as a tree of categories: 1 is the root, a part hangs below the half of its number; below every 50th there is a
#: chain of one child each; numbers ending in 07 hang below their own double and so make a cycle, with all below it.
NODES = """nodes AS (SELECT p_partkey AS id, CASE WHEN p_partkey = 1 THEN NULL WHEN p_partkey % 100 = 7 THEN p_partkey * 2 WHEN p_partkey % 50 BETWEEN 1 AND 40 AND p_partkey > 100 THEN p_partkey - 1 ELSE p_partkey // 2 END AS parent_id FROM part)"""
LINKS = f"""WITH RECURSIVE {NODES}, sound AS (SELECT id, CASE WHEN parent_id IN (SELECT id FROM nodes) THEN parent_id END AS parent_id FROM nodes),
    rooted AS (SELECT id FROM sound WHERE parent_id IS NULL UNION ALL SELECT n.id FROM sound n JOIN rooted r ON n.parent_id = r.id),
    pairs AS (SELECT id, id AS ancestor, 0 AS distance FROM rooted UNION ALL SELECT p.id, s.parent_id, p.distance + 1 FROM pairs p JOIN sound s ON p.ancestor = s.id WHERE s.parent_id IS NOT NULL)"""


def nodes(s, d):
    k = F.col("p_partkey")
    parent = F.when(k == 1, None).when(k % 100 == 7, k * 2).when((k % 50).between(1, 40) & (k > 100), k - 1).otherwise(F.floor(k / 2))
    return c.read(s, d, "part").select(k.alias("id"), parent.cast("long").alias("parent_id"))


query("category_closure", f"{LINKS} SELECT id, ancestor, distance FROM pairs")(lambda s, d: hierarchy.closure(nodes(s, d)))
query("category_roll_up", f"""{LINKS}, counts AS (SELECT l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT ancestor AS id, CAST(coalesce(sum(n) FILTER (distance = 0), 0) AS BIGINT) AS own, CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM pairs LEFT JOIN counts USING (id) GROUP BY 1""")(  # fmt: skip
    lambda s, d: hierarchy.roll_up(c.read(s, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")), hierarchy.closure(nodes(s, d)), "l_partkey")
)
query("category_paths", f"{LINKS} SELECT id, max(distance) AS level, string_agg(ancestor, '/' ORDER BY distance DESC) AS path FROM pairs GROUP BY 1")(
    lambda s, d: hierarchy.paths(nodes(s, d).withColumn("name", F.col("id").cast("string")))
)
query("category_cycles", f"""{LINKS}, lost AS (SELECT id, parent_id FROM sound WHERE id NOT IN (SELECT id FROM rooted)),
    walk AS (SELECT id AS start, parent_id AS place, 1 AS steps FROM lost UNION ALL SELECT start, l.parent_id, steps + 1 FROM walk JOIN lost l ON walk.place = l.id WHERE steps < 100 AND walk.place <> walk.start)
    SELECT id, id IN (SELECT start FROM walk WHERE place = start) AS on_cycle FROM lost""")(lambda s, d: hierarchy.cycles(nodes(s, d)))  # fmt: skip


# --- deletes that spread ----------------------------------------------------------------------
def catalogue(s, d):
    products = c.products(s, d).select("id", "name", F.concat(F.lit("N"), F.col("id").cast("long") % 25).alias("category_id"))
    return {"categories": c.categories(s, d), "products": products, "history": c.price_history(s, d).withColumn("line", F.concat_ws("-", "tie_order", "tie_line", "product_id", "tie_supplier"))}


def deleted(s, d):
    """Region 1 and nation 3 go, and every product whose number ends in 3."""
    asked = {"categories": s.range(2).select(F.when(F.col("id") == 0, "R1").otherwise("N3").alias("id")), "products": c.products(s, d).where("id like '%3'").select("id")}
    return hierarchy.survivors(catalogue(s, d), {"categories": "id", "products": "id", "history": "line"}, hierarchy.REFERENCES, asked)


GONE = "gone AS (SELECT 'R1' AS id UNION ALL SELECT 'N' || n_nationkey FROM nation WHERE n_regionkey = 1 OR n_nationkey = 3)"
query("cascade_categories", f"WITH {GONE}, cats AS (SELECT 'R' || r_regionkey AS id, r_name AS name, CAST(NULL AS VARCHAR) AS parent_id FROM region UNION ALL SELECT 'N' || n_nationkey, n_name, 'R' || n_regionkey FROM nation) SELECT * FROM cats WHERE id NOT IN (SELECT id FROM gone)")(
    lambda s, d: deleted(s, d)["categories"].select("id", "name", "parent_id")
)
query("cascade_products", f"WITH {PRODUCTS}, {GONE} SELECT id, name, CASE WHEN 'N' || CAST(id AS BIGINT) % 25 NOT IN (SELECT id FROM gone) THEN 'N' || CAST(id AS BIGINT) % 25 END AS category_id FROM products WHERE id NOT LIKE '%3'")(
    lambda s, d: deleted(s, d)["products"].select("id", "name", "category_id")
)
query("cascade_history", f"WITH {HISTORY} SELECT product_id, count(*) AS n FROM history WHERE product_id NOT LIKE '%3' GROUP BY 1")(lambda s, d: deleted(s, d)["history"].groupBy("product_id").agg(F.count("*").alias("n")))


@query("delete_vectors", f"WITH {PRODUCTS} SELECT id, name FROM products WHERE id NOT LIKE '%3'")
def delete_vectors(s, d):
    """The same products out of the snapshot store, by vectors beside its buckets."""
    from ..operators.bucketed import Snapshot

    store = Snapshot(s, scratch(s, "snapshot"), key="id", at="scraped_at", buckets=4)
    rows = c.products(s, d).select("id", "name", F.lit("2024-01-01").cast("timestamp").alias("scraped_at"))
    store.merge(rows, 0)
    store.delete(rows.where("id like '%3'").select("id"))
    return store.read().select("id", "name")


# --- crawl output -------------------------------------------------------------------------------
def crawl_output(s, d):
    """Pages as crawl output: an address, an object, a list of both (an inner list too), numbers, or no JSON."""
    p = c.read(s, d, "pages").select("page_id", "url", F.regexp_replace("html", r"[^\x20-\x7e]", "").alias("html"))
    quoted = F.concat(F.lit('"'), "url", F.lit('"'))
    links = F.array(F.lit("/p/1"), F.concat(F.lit("http://x/p/"), "page_id"), F.lit("/q/2"))
    full = F.to_json(F.struct(F.struct(F.col("url").alias("sourceURL"), F.lit("t").alias("title")).alias("metadata"), links.alias("linksOnPage")))
    plain = F.to_json(F.struct(F.col("url"), F.col("html")))
    mixed = F.concat(F.lit("["), quoted, F.lit(","), full, F.lit(", ["), plain, F.lit(", 7], null]"))
    n = F.col("page_id") % 6
    return p.select("page_id", F.when(n == 0, quoted).when(n == 1, full).when(n == 2, plain).when(n == 3, mixed).when(n == 4, F.concat(F.lit("{"), "url")).otherwise(F.col("page_id").cast("string")).alias("item"))


#: The same items from the pages themselves: position, and which form the item has.
FORMS = "forms AS (SELECT page_id, url, html, unnest(CASE page_id % 6 WHEN 0 THEN [0] WHEN 1 THEN [0] WHEN 2 THEN [0] WHEN 3 THEN [0, 1, 2] ELSE [] END) AS position, unnest(CASE page_id % 6 WHEN 0 THEN ['text'] WHEN 1 THEN ['full'] WHEN 2 THEN ['plain'] WHEN 3 THEN ['text', 'full', 'plain'] ELSE [] END) AS form FROM pages)"
query("crawl_items", f"""WITH {FORMS}, own AS (SELECT page_id, position, url AS own, CASE WHEN form = 'plain' THEN regexp_replace(html, '[^\\x20-\\x7e]', '', 'g') ELSE '' END AS html, form FROM forms),
    hrefs AS (SELECT DISTINCT page_id, position, CASE WHEN h LIKE 'http%' THEN h ELSE '{BASE_URL}' || h END AS link FROM (SELECT page_id, position, unnest(regexp_extract_all(html, '{SQL_HREF}', 1)) AS h FROM own) WHERE (h LIKE 'http%' OR h LIKE '/%') AND h LIKE '%/%')
    SELECT page_id, position, CASE WHEN form = 'text' THEN 'text' ELSE 'object' END AS kind, own AS url FROM own
    UNION ALL SELECT page_id, position, 'object', unnest(['{BASE_URL}/p/1', 'http://x/p/' || page_id, '{BASE_URL}/q/2']) FROM own WHERE form = 'full'
    UNION ALL SELECT h.page_id, h.position, 'object', link FROM hrefs h JOIN own o USING (page_id, position) WHERE link <> o.own""")(  # fmt: skip
    lambda s, d: item_urls(read_items(crawl_output(s, d))[0], BASE_URL, "/", "").select("page_id", "position", "kind", F.explode("urls").alias("url"))
)
query("crawl_rejected", """SELECT page_id, unnest(CASE page_id % 6 WHEN 3 THEN [3, 4] WHEN 4 THEN [NULL] WHEN 5 THEN [0] ELSE [] END) AS position,
    unnest(CASE page_id % 6 WHEN 3 THEN ['neither text nor object: BIGINT', 'neither text nor object: VOID'] WHEN 4 THEN ['not JSON'] WHEN 5 THEN ['neither text nor object: BIGINT'] ELSE [] END) AS reason FROM pages""")(  # fmt: skip
    lambda s, d: read_items(crawl_output(s, d))[1].select("page_id", "position", "reason")
)


# --- attempts -----------------------------------------------------------------------------------
@query("attempt_sessions", """WITH log AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 200 WHEN 'click' THEN 429 WHEN 'view' THEN 500 WHEN 'signup' THEN 200 END AS status, CASE WHEN event_id % 2 = 0 THEN 30 END AS retry_after FROM events),
    met AS (SELECT *, lag(status) OVER w AS before, lag(ts) OVER w AS before_at, lag(retry_after) OVER w AS asked, row_number() OVER w = 1 AS first FROM log WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    gaps AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(before_at)) AS BIGINT) AS gone FROM met),
    runs AS (SELECT *, sum(CASE WHEN first OR coalesce(before = 200, false) OR gone > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM gaps),
    tries AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1 AS tried FROM runs),
    kept AS (SELECT *, tried // 3 AS number, tried % 3 = 0 OR gone >= CASE WHEN before IS NULL THEN CAST(2 ** (tried % 3 - 1) AS BIGINT) WHEN before = 429 THEN coalesce(asked, 60) ELSE 0 END AS waited FROM tries),
    grouped AS (SELECT user_id, run, number, min(ts) AS first_at, max(ts) AS last_at, count(*) AS attempts, last(status ORDER BY ts, event_id) AS status, bool_and(waited) AS waited FROM kept GROUP BY 1, 2, 3)
    SELECT user_id, first_at, last_at, attempts, CASE WHEN coalesce(status = 200, false) THEN 'saved' WHEN attempts < 3 AND row_number() OVER (PARTITION BY user_id ORDER BY run DESC, number DESC) = 1 THEN 'open' ELSE 'failed' END AS outcome, waited FROM grouped""")  # fmt: skip
def attempt_sessions(s, d):
    """Events as attempts: what a user did stands for how the fetch ended."""
    e = c.read(s, d, "events")
    kinds = F.when(F.col("event_type").isin("purchase", "signup"), 200).when(F.col("event_type") == "click", 429).when(F.col("event_type") == "view", 500)
    log = e.select(F.col("user_id").alias("url"), F.col("ts").alias("at"), kinds.alias("status"), F.when(F.col("event_id") % 2 == 0, 30).alias("retry_after"), F.col("event_id").alias("attempt_id"))
    return attempts.sessions(log, 43_200).withColumnRenamed("url", "user_id")


# --- dashboards ---------------------------------------------------------------------------------
query("dashboard", f"""WITH {PRODUCTS}, {JOBS}, days AS (SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS n, round(avg(CASE WHEN processed_items > 0 THEN success_items * 100.0::DOUBLE / processed_items ELSE 0 END), 4) AS rate FROM jobs WHERE status = 'completed' GROUP BY 1),
    averages AS (SELECT 'brand' AS section, brand AS name, current_price FROM products UNION ALL SELECT 'category', category, current_price FROM products
        UNION ALL SELECT 'price', CASE WHEN current_price < 500 THEN '0-500' WHEN current_price < 1000 THEN '500-1000' WHEN current_price < 2000 THEN '1000-2000' WHEN current_price < 5000 THEN '2000-5000' ELSE '5000+' END, current_price FROM products WHERE current_price >= 0)
    SELECT 'kpi' AS section, 'total_products' AS name, count(*) AS n, CAST(count(*) AS DOUBLE) AS value FROM products
    UNION ALL SELECT 'kpi', 'average_price', count(*), coalesce(round(avg(CAST(current_price AS DOUBLE)) FILTER (current_price <> 0), 2), 0) FROM products
    UNION ALL SELECT 'kpi', 'products_on_sale', count(*), CAST(count(*) FILTER (discount_percentage > 0) AS DOUBLE) FROM products
    UNION ALL SELECT section, name, count(*), coalesce(round(avg(CAST(nullif(current_price, 0) AS DOUBLE)), 2), 0) FROM averages WHERE name <> '' GROUP BY 1, 2
    UNION ALL SELECT 'kpi', 'total_jobs', count(*), CAST(count(*) AS DOUBLE) FROM jobs UNION ALL SELECT 'status', status, count(*), CAST(count(*) AS DOUBLE) FROM jobs GROUP BY 2
    UNION ALL SELECT 'day', day, n, rate FROM (FROM days ORDER BY day DESC LIMIT 7)""")(  # fmt: skip
    lambda s, d: dashboard.dashboard(c.products(s, d), c.jobs(s, d))
)


def branded_prices(s, d):
    brands = c.products(s, d).select(F.col("id").alias("product_id"), "brand")
    return c.price_history(s, d).select("product_id", "price", "recorded_at").join(brands, "product_id")


@query("sketched_brands", f"""WITH {PRODUCTS}, {HISTORY} SELECT brand, count(*) AS n, CAST(min(price) AS DOUBLE) AS lowest, CAST(max(price) AS DOUBLE) AS highest, count(DISTINCT product_id) AS exact_products, true AS products_within, true AS quantiles_within
    FROM history JOIN products ON product_id = id WHERE recorded_at >= TIMESTAMP '1995-01-01' AND recorded_at < TIMESTAMP '2000-01-01' GROUP BY 1""")  # fmt: skip
def sketched_brands(s, d):
    """Five years added up from daily sketches, and whether they keep their error next to the exact figures."""
    rows, shares = branded_prices(s, d), (0.1, 0.5, 0.9)
    sketches = written(dashboard.daily_sketches(rows, ["brand"]), scratch(s, "sketches"))
    found = dashboard.merged_sketches(sketches, ["brand"], shares, "1995-01-01", "1999-12-31")
    span = rows.where((F.col("recorded_at") >= F.lit("1995-01-01").cast("timestamp_ntz")) & (F.col("recorded_at") < F.lit("2000-01-01").cast("timestamp_ntz")))
    price = F.col("price").cast("double")
    met = span.join(found.select("brand", "products", "prices"), "brand")
    below = [F.avg((price <= F.get("prices", F.lit(i))).cast("double")).alias(f"r{i}") for i in range(len(shares))]
    under = [F.avg((price < F.get("prices", F.lit(i))).cast("double")).alias(f"u{i}") for i in range(len(shares))]
    exact = met.groupBy("brand").agg(F.count("*").alias("n"), F.min(price).alias("lowest"), F.max(price).alias("highest"), F.countDistinct("product_id").alias("exact_products"), F.first("products").alias("products"), *below, *under)
    within = F.lit(True)
    for i, q in enumerate(shares):
        within = within & (F.col(f"u{i}") <= q + dashboard.RANK_ERROR) & (F.col(f"r{i}") >= q - dashboard.RANK_ERROR)
    near = F.abs(F.col("products") - F.col("exact_products")) <= F.greatest(F.lit(1.0), F.col("exact_products") * dashboard.DISTINCT_ERROR)
    return exact.select("brand", "n", "lowest", "highest", "exact_products", near.alias("products_within"), within.alias("quantiles_within"))
