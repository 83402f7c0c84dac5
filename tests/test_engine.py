import datetime as dt

import pytest
from pyspark.sql import functions as F

from tamarack import schemas
from tamarack.operators import analytics, checks, discovery, jobs, upsert
from tamarack.operators.extract import extract, split_valid
from tamarack.operators.search import SearchSpec, matching, search
from tamarack.plans import registry
from tamarack.sources import catalog, sinks


def day(n):
    return dt.datetime(2024, 1, n)


def test_upsert_and_history(spark):
    kind = "sku string, current_price decimal(12,2), scraped_at timestamp, id string, created_at timestamp"
    stored = spark.createDataFrame([("a", 100, day(1), "id-a", day(1)), ("b", 5, day(1), "id-b", day(1))], "sku string, current_price int, scraped_at timestamp, id string, created_at timestamp").withColumn("current_price", F.col("current_price").cast("decimal(12,2)"))
    rows = [("a", 100, day(2)), ("a", 90, day(3)), ("a", None, day(4)), ("a", 80, day(5)), ("n", 7, day(2))]
    batch = spark.createDataFrame([(s, p, d, "new", d) for s, p, d in rows], "sku string, current_price int, scraped_at timestamp, id string, created_at timestamp").withColumn("current_price", F.col("current_price").cast("decimal(12,2)"))
    assert kind
    once = upsert.upsert(stored, batch)
    got = {r.sku: (r.current_price, r.id) for r in once.collect()}
    assert got["a"] == (80, "id-a") and got["b"] == (5, "id-b") and got["n"] == (7, "new")
    assert sorted(map(tuple, upsert.upsert(once, batch).collect())) == sorted(map(tuple, once.collect()))
    assert [int(r.price) for r in upsert.history_delta(stored, batch).orderBy("recorded_at").collect()] == [90, 80]


def test_rates_are_not_pooled(spark):
    jobs = spark.createDataFrame([("completed", 10, 10, 0), ("completed", 90, 45, 45), ("failed", 5, 1, 4)], "status string, processed_items int, success_items int, failed_items int").withColumn("created_at", F.lit(day(1)))
    assert analytics.daily_stats(jobs).first().avg_success_rate == 75
    assert analytics.performance(jobs).first().average_success_rate == 55


@pytest.mark.parametrize("name, sku, price, url, reason", [("ab", "123", 1, "u", "name"), ("n" * 501, "123", 1, "u", "name"), ("abc", "12", 1, "u", "sku"), ("abc", "s" * 51, 1, "u", "sku"), ("abc", "123", 0, "u", "price"), ("abc", "123", 1, "", "missing"), ("abc", "123", None, "u", None), ("n" * 500, "s" * 50, 1, "u", None)])
def test_validation(spark, name, sku, price, url, reason):
    row = spark.createDataFrame([(name, sku, price, url)], "name string, sku string, current_price int, url string")
    assert row.select(checks.rejection()).first()[0] == reason


def test_orphans(spark):
    child = spark.createDataFrame([("1",), ("2",), (None,)], "k string")
    assert [r.k for r in checks.orphans(child, spark.createDataFrame([("1",)], "id string"), "k", "id").collect()] == ["2"]


def test_extract_reads_every_source(spark):
    blank = dict.fromkeys([f.split()[0] for f in ("markdown", "html", "linksOnPage", "price", "current_price", "originalPrice", "original_price", "brand", "category", "description", "features_str", "features_arr", "specifications", "images_str", "images_arr", "availability", "stock_status")])
    pages = [
        {**blank, "url": "https://h/p/1243357?x=1", "metadata": ("  Lamp ", "Lamp, Acme, SKU: ab-12", None, None), "markdown": "฿1,200 now ฿900", "features_str": "a, b", "stock_status": "in stock"},
        {**blank, "url": "https://h/x", "metadata": None, "markdown": "# เครื่อง A\nx", "price": "900", "originalPrice": "1200"},
        {**blank, "url": "https://h/y", "metadata": None},
    ]
    rows = extract(spark.createDataFrame(pages, schemas.RAW_PAGE))
    valid, rejected = split_valid(rows)
    got = {r.url: r for r in valid.collect()}
    lamp = got["https://h/p/1243357?x=1"]
    assert (lamp.sku, lamp.name, lamp.brand, int(lamp.current_price), lamp.discount_percentage, lamp.features, lamp.availability) == ("1243357", "Lamp", "Acme", 900, 25.0, ["a", "b"], "in_stock")
    assert got["https://h/x"].name == "เครื่อง A" and got["https://h/x"].discount_percentage == 25.0
    assert [r.reason for r in rejected.collect()] == ["missing"]
    assert "Python" not in rows._jdf.queryExecution().toString()


def test_search_pages_make_the_whole(spark, sf_dir):
    products = catalog.products(spark, sf_dir)
    spec = {"query": "r", "sort_by": "price"}
    total = matching(products, SearchSpec(**spec)).count()
    got = [r.id for p in range(1, total // 50 + 2) for r in search(products, SearchSpec(**spec, page=p, page_size=50)).collect()]
    assert len(got) == len(set(got)) == total
    with pytest.raises(ValueError):
        SearchSpec(page=0)
    plan = search(products, SearchSpec(in_stock_only=True))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_sinks(spark, sf_dir, tmp_path):
    sinks.write_urls(spark.createDataFrame([("u1",), ("u2",)], "url string"), str(tmp_path / "urls"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "urls")).collect()) == ["u1", "u2"]
    sinks.export_csv(catalog.products(spark, sf_dir), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == catalog.products(spark, sf_dir).count()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_upsert_sets_updated_at_and_shuffles_each_side_once(spark):
    kind = "sku string, current_price int, scraped_at timestamp, id string, created_at timestamp, updated_at timestamp"
    stored = spark.createDataFrame([("a", 1, day(1), "ia", day(1), None), ("b", 2, day(1), "ib", day(1), day(2))], kind)
    batch = spark.createDataFrame([("a", 3, day(3), "xa", day(3), None), ("a", 4, day(2), "xa", day(2), None), ("n", 5, day(3), "xn", day(3), None), (None, 6, day(3), "x", day(3), None)], kind)
    out = upsert.upsert(stored, batch, now=F.lit(day(9)))
    plan = plan_of(out)
    got = {r.sku: tuple(r)[1:] for r in out.collect()}
    assert got["a"] == (3, day(3), "ia", day(1), day(9)) and got["b"] == (2, day(1), "ib", day(1), day(2)) and got["n"] == (5, day(3), "xn", day(3), None)
    assert len(got) == 3 and plan.count("Exchange hashpartitioning") <= 2 and "Window" not in plan


def test_trend_bound_reaches_the_scan(spark, sf_dir):
    plan = plan_of(analytics.price_trends(catalog.products(spark, sf_dir), catalog.price_history(spark, sf_dir), None, 365))
    assert "NestedLoop" not in plan and "subquery" in plan.lower() and "Python" not in plan


def test_few_jobs_count_few_items(spark, sf_dir):
    few = catalog.orders_as_jobs(spark, sf_dir).orderBy("id").limit(3)
    plan = plan_of(catalog.jobs(spark, sf_dir, few))
    assert "LeftSemi" in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("bad", [{"job_type": "other", "urls": ["u"]}, {"job_type": "product"}, {"job_type": "category"}, {"job_type": "search", "target_url": ""}, {"job_type": "product", "urls": ["u"], "max_pages": 51}, {"job_type": "product", "urls": ["u"], "max_concurrent": 11}])
def test_job_requests_are_checked(bad):
    with pytest.raises(ValueError):
        jobs.JobRequest(**bad)
    assert jobs.JobRequest("product", urls=["u"]).max_pages == 5


def test_jobs_from_request_to_end(spark):
    asked = spark.createDataFrame([("1", "product", None, ["u1", "u2"], day(1)), ("2", "search", "s", [], day(1)), ("3", "product", None, [], day(1)), ("4", "category", None, [], day(1)), ("5", None, None, None, day(1))], "job_id string, job_type string, target_url string, urls array<string>, at timestamp")
    assert {r.job_id: r.error for r in jobs.requested(asked).collect()} == {"1": None, "2": None, "3": jobs.NO_URLS, "4": jobs.NO_TARGET, "5": jobs.BAD_JOB}
    log = jobs.created(asked)
    assert {(r.job_id, r.status, r.target_url, r.total_items) for r in jobs.job_table(log).collect()} == {("1", "pending", "u1", 0), ("2", "pending", "s", 0)}
    later = spark.createDataFrame([("1", day(2), None, "running", None, 2, None, None, None, None), ("1", day(3), None, "completed", None, None, 2, 1, 1, None), ("2", day(2), None, "failed", None, None, None, None, None, "why")], jobs.EVENT)
    table = jobs.job_table(log.union(later))
    got = {r.job_id: r for r in table.collect()}
    assert (got["1"].status, got["1"].total_items, got["1"].success_items, got["1"].started_at, got["1"].completed_at, got["1"].created_at) == ("completed", 2, 1, day(2), day(3), day(1))
    assert (got["2"].status, got["2"].error_message, got["2"].started_at) == ("failed", "why", None)
    asks = spark.createDataFrame([("1",), ("9",)], "job_id string")
    assert {r.job_id: r.message for r in jobs.cancelled(table, asks).collect()} == {"1": "Cannot cancel job with status: completed", "9": jobs.NO_JOB}


def test_discovery_follows_listings_only(spark):
    pages = spark.createDataFrame([("http://h/c", '<a href="/p/1?x"> <a href="/q/2"> <a href="?page=2"> <a href="?page=3">', ["/x/p/9"]), ("http://h/c?page=2", '<a href="/p/1"><a href="/p/2#y">', None), ("http://h/c?page=3", '<a href="/p/3">', None)], "url string, html string, linksOnPage array<string>")
    starts = spark.createDataFrame([("http://h/c",), ("http://h/none",)], "start_url string")
    found = lambda n: sorted(r.url for r in discovery.discover(pages, starts, "http://h", n).collect())
    assert found(1) == ["/x/p/9", "http://h/p/1"] and found(2) == ["/x/p/9", "http://h/p/1", "http://h/p/2"] and len(found(5)) == 4
    with pytest.raises(ValueError):
        discovery.discover(pages, starts, "http://h", 51)


def landed(rows):
    return [{"url": f"https://h/p/{n}", "metadata": {"title": f"Lamp {n}"}, "price": str(p), "scraped_at": f"2024-01-{d:02d}T00:00:00Z"} for d, n, p in rows]


def ingested(spark, root, batches):
    import json

    from tamarack.streaming import ingest

    (root / "in").mkdir(parents=True)
    for i, rows in enumerate(batches):
        (root / "in" / f"{i}.json").write_text("\n".join(map(json.dumps, landed(rows))))
        ingest.ingest(ingest.page_stream(spark, str(root / "in")), str(root / "out"), str(root / "ck"), buckets=4).awaitTermination()
    snapshot, log = ingest.stores(spark, str(root / "out"), 4)
    runs = spark.read.parquet(str(root / "out" / "runs")).select("batch", "processed_items", "success_items", "failed_items").orderBy("batch").collect()
    assert [tuple(r) for r in runs] == [(n, len(b), len(b), 0) for n, b in enumerate(batches)]
    return {r.sku: (int(r.current_price), r.scraped_at.day, r.created_at.day) for r in snapshot.read().collect()}, sorted((r.key, r.recorded_at.day, int(r.price)) for r in log.history().collect())


def test_stream_equals_batch(spark, tmp_path):
    """Addresses and keys that repeat within a batch and across batches."""
    rows = [(1, 100, 10), (2, 100, 12), (3, 100, 15), (1, 101, 20), (3, 100, 14), (4, 100, 15), (4, 101, 20), (5, 102, 7), (6, 100, 15), (7, 101, 21)]
    snapshot = {"100": (15, 6, 1), "101": (21, 7, 1), "102": (7, 5, 5)}
    changes = [("100", 2, 12), ("100", 3, 14), ("100", 4, 15), ("101", 7, 21)]
    whole = ingested(spark, tmp_path / "one", [rows])
    assert whole == (snapshot, changes)
    assert ingested(spark, tmp_path / "many", [rows[:6], rows[6:8], rows[8:]]) == whole
    assert ingested(spark, tmp_path / "late", [rows[5:], rows[2:4], rows[4:5], rows[:2]]) == whole  # newest first


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, sf_dir, name):
    import duckdb

    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    assert name in registry.ORACLES
    con = duckdb.connect()
    for t in ("region", "nation", "part", "orders", "lineitem", "events", "documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    other = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
    plain = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    assert sorted(tuple(map(plain, r)) for r in rows) == sorted(tuple(map(plain, r)) for r in other)
