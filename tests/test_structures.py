"""Trees, deletes, crawl items, attempts, pages by cursor, dashboards and job state on small tables."""

import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tamarack.operators import attempts, checks, dashboard, hierarchy, jobs
from tamarack.operators.search import SearchSpec, cursor_of, search, search_after
from tamarack.plans import registry
from tamarack.sources import catalog, crawl
from tamarack.streaming import job_state


def day(n, seconds=0):
    return dt.datetime(2024, 1, n) + dt.timedelta(seconds=seconds)


def tree(spark, pairs):
    return spark.createDataFrame(pairs, "id string, parent_id string")


def test_closure_of_a_deep_chain_and_cycles(spark):
    chain = [(str(i), str(i - 1) if i else None) for i in range(301)]
    loops = [("x", "y"), ("y", "z"), ("z", "x"), ("into", "x"), ("below", "into"), ("self", "self"), ("orphan", "gone"), ("leaf", "orphan"), (None, "0")]
    got = hierarchy.closure(tree(spark, chain + loops))
    rows = {(r.id, r.ancestor): r.distance for r in got.where("try_cast(id as int) is null or id in ('300', '0')").collect()}
    assert [rows["300", str(300 - k)] for k in range(301)] == list(range(301)) and rows["0", "0"] == 0
    assert {k: v for k, v in rows.items() if not k[0].isdigit()} == {("orphan", "orphan"): 0, ("leaf", "leaf"): 0, ("leaf", "orphan"): 1}
    assert {r.id: r.on_cycle for r in hierarchy.cycles(tree(spark, chain + loops)).collect()} == {"x": True, "y": True, "z": True, "self": True, "into": False, "below": False}
    assert hierarchy.closure(tree(spark, [])).collect() == [] and hierarchy.cycles(tree(spark, chain[:3])).collect() == []


def test_roll_up_adds_every_subtree(spark):
    nodes = tree(spark, [("r", None), ("a", "r"), ("b", "r"), ("c", "a")])
    counts = spark.createDataFrame([("c", 2), ("c", 3), ("b", 4), ("nowhere", 9)], "id string, n long")
    assert {r.id: (r.own, r.total) for r in hierarchy.roll_up(counts, hierarchy.closure(nodes)).collect()} == {"r": (0, 9), "a": (0, 5), "b": (4, 4), "c": (5, 5)}


def test_deletes_spread_as_references_say(spark):
    tables = {
        "categories": tree(spark, [("r", None), ("a", "r"), ("c", "a"), ("d", "c"), ("b", "r")]),
        "products": spark.createDataFrame([("1", "d"), ("2", "b"), ("3", None), ("4", "a")], "id string, category_id string"),
        "history": spark.createDataFrame([(1, "1"), (2, "2"), (3, "2"), (4, None)], "line long, product_id string"),
    }
    keys = {"categories": "id", "products": "id", "history": "line"}
    ask = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    out = hierarchy.survivors(tables, keys, hierarchy.REFERENCES, {"categories": ask("a", "none", None), "products": ask("2")})
    assert sorted(r.id for r in out["categories"].collect()) == ["b", "r"]
    assert sorted((r.id, r.category_id or "") for r in out["products"].collect()) == [("1", ""), ("3", ""), ("4", "")]
    assert sorted(r.line for r in out["history"].collect()) == [1, 4]
    whole = hierarchy.survivors(tables, keys, [hierarchy.REFERENCES[0], hierarchy.Reference("products", "category_id", "categories", "id"), hierarchy.REFERENCES[2]], {"categories": ask("r")})
    assert [t.count() for t in whole.values()] == [0, 1, 1]


def test_crawl_output_of_mixed_items(spark, tmp_path):
    lines = [
        '"http://h/p/1"', json.dumps({"metadata": {"sourceURL": "", "url": "http://h/x"}, "url": "no", "linksOnPage": ["/p/2", 7, "/q", None], "html": '<a href="/p/3?a">'}),
        '["u1", {"sourceUrl": "u2"}, ["u3", 5], null, true]', "{broken", "7", '{"metadata": "text", "linksOnPage": "x"}', "", "[]", '""',
    ]
    (tmp_path / "crawl.json").write_text("\n".join(lines))
    items, rejected = crawl.read_crawl(spark, str(tmp_path))
    found = crawl.item_urls(items, "http://h")
    assert sorted((r.position, r.kind, r.url or "", ",".join(r.urls)) for r in found.collect()) == sorted([
        (0, "text", "http://h/p/1", "http://h/p/1"), (0, "object", "http://h/x", "http://h/x,http://h/p/2,http://h/p/3?a"), (0, "text", "u1", "u1"), (1, "object", "u2", "u2"), (2, "text", "u3", "u3"), (0, "object", "", ""), (0, "text", "", ""),
    ])
    assert sorted((-1 if r.position is None else r.position, r.reason.split(":")[0], r.item) for r in rejected.collect()) == [(-1, "not JSON", "{broken"), (0, "neither text nor object", "7"), (3, "neither text nor object", "5"), (4, "neither text nor object", "null"), (5, "neither text nor object", "true")]


def test_attempts_become_sessions(spark):
    log = [("a", day(1, 0), None), ("a", day(1, 1), None), ("a", day(1, 3), 200), ("a", day(1, 4), 500), ("a", day(1, 4), 500), ("b", day(1, 0), 429), ("b", day(1, 30), 429), ("b", day(1, 90), 429), ("b", day(1, 91), 500), ("b", day(1, 9000), 200), (None, day(1), 200)]
    df = spark.createDataFrame([(u, t, s, 45 if i == 6 else None, i) for i, (u, t, s) in enumerate(log)], "url string, at timestamp, status int, retry_after int, attempt_id int")
    got = sorted((r.url, r.first_at, r.attempts, r.outcome, r.waited) for r in attempts.sessions(df).collect())
    assert got == [("a", day(1, 0), 3, "saved", True), ("a", day(1, 4), 2, "open", True), ("b", day(1, 0), 3, "failed", False), ("b", day(1, 91), 1, "failed", True), ("b", day(1, 9000), 1, "saved", True)]


@pytest.mark.parametrize("by, order", [("name", "asc"), ("discount", "asc"), ("discount", "desc"), ("price", "desc")])
def test_pages_by_cursor_are_the_pages_by_offset(spark, by, order):
    rng = random.Random(2)
    rows = [(f"i{n}", rng.choice("abcd"), rng.choice([None, Decimal(1), Decimal(2)]), rng.choice([None, 1.0, 2.5])) for n in range(47)]
    products = spark.createDataFrame(rows, "id string, name string, current_price decimal(12,2), discount_percentage double").cache()
    cursor, got = None, []
    for page in range(1, 7):
        spec = SearchSpec(sort_by=by, sort_order=order, page_size=9, page=page)
        own = search_after(products, spec, cursor).collect()
        assert own == search(products, spec).collect()
        got += own
        cursor = cursor_of(own[-1], spec) if own else cursor
    assert len({r.id for r in got}) == 47


def test_a_cursor_bounds_the_scan(spark, sf_dir):
    products = catalog.products(spark, sf_dir)
    spec = SearchSpec(page_size=20)
    cursor = cursor_of(search_after(products, spec).collect()[-1], spec)
    plan = search_after(products, spec, cursor)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(p_name" in plan and "TakeOrderedAndProject(limit=20" in plan


def test_a_dashboard_takes_one_scan_a_table(spark, sf_dir):
    products, jobs_ = catalog.products(spark, sf_dir), catalog.orders_as_jobs(spark, sf_dir).withColumns({"processed_items": F.lit(2), "success_items": F.lit(1)})
    plan = dashboard.product_sections(products)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Expand" in plan
    none = dashboard.dashboard(products.limit(0), jobs_.limit(0)).collect()
    assert {r.name: r.value for r in none if r.section == "kpi"} == {"total_products": 0, "average_price": 0, "products_on_sale": 0, "total_jobs": 0}


def test_sketches_add_up_over_days(spark):
    rng = random.Random(1)
    rows = [(f"p{rng.randint(0, 3000)}", Decimal(rng.randint(1, 100_000)) / 100, day(rng.randint(1, 9)), "b") for _ in range(20_000)] + [("p1", None, day(3), "b")]
    df = spark.createDataFrame(rows, "product_id string, price decimal(12,2), recorded_at timestamp, brand string")
    daily = dashboard.daily_sketches(df, ["brand"])
    assert daily.count() == 9
    got = dashboard.merged_sketches(daily, ["brand"], (0.25, 0.5), "2024-01-02", "2024-01-05").first()
    own = [r for r in rows if 2 <= r[2].day <= 5]
    prices = sorted(float(r[1]) for r in own if r[1] is not None)
    exact = len({r[0] for r in own})
    assert got.n == len(own) and abs(got.products - exact) <= exact * dashboard.DISTINCT_ERROR
    for q, v in zip((0.25, 0.5), got.prices, strict=True):
        assert abs(sum(p <= v for p in prices) / len(prices) - q) <= dashboard.RANK_ERROR + 1 / len(prices)


def test_models_refuse_blank_keys_and_negative_prices(spark):
    rows = spark.createDataFrame([(" a ", " c ", 1, None), ("  ", "c", -1, 2), (None, "", 1, -2)], "sku string, category_name string, current_price int, original_price int")
    good, bad = checks.modelled(rows)
    assert [tuple(r) for r in good.collect()] == [("a", "c", 1, None)]
    assert sorted(r.errors for r in bad.collect()) == ["sku,category_name,original_price", "sku,current_price"]


EVENT = jobs.EVENT


def log_of(spark, rows):
    return spark.createDataFrame([(k, t, "product", s, None, 9, n, n, 0, e) for k, t, s, n, e in rows], EVENT)


LOG = [
    ("done", day(1, 0), "pending", 0, None), ("done", day(1, 10), "running", 3, None), ("done", day(1, 200), "running", 6, None), ("done", day(1, 400), "completed", 9, None),
    ("gap", day(1, 0), "pending", 0, None), ("gap", day(1, 301), "running", 1, None), ("gap", day(1, 302), "completed", 9, None),
    ("silent", day(1, 0), "pending", 0, None), ("silent", day(1, 100), "running", 2, None), ("broke", day(1, 5), "failed", 1, "why"), ("fresh", day(2, 0), "running", 1, None),
]


def test_jobs_time_out_in_a_log(spark):
    now = F.lit(day(2, 10))
    got = {r.job_id: r["at"] for r in jobs.timed_out(log_of(spark, LOG), now).collect()}
    assert got == {"gap": day(1, 300), "silent": day(1, 400)}
    table = {r.job_id: (r.status, r.processed_items, r.error_message) for r in jobs.job_table(jobs.within_time(log_of(spark, LOG), now)).collect()}
    assert table == {"done": ("completed", 9, None), "gap": ("failed", 0, jobs.TIMED_OUT), "silent": ("failed", 2, jobs.TIMED_OUT), "broke": ("failed", 1, "why"), "fresh": ("running", 1, None)}


def test_streamed_jobs_end_as_the_log_says(spark, tmp_path):
    spark.conf.set(*job_state.STORE)
    for n, part in enumerate((LOG[:6], LOG[6:10], LOG[10:])):  # the last one moves the watermark on
        log_of(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b={n}"))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    job_state.job_changes(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(300)
    changes = spark.read.parquet(str(tmp_path / "out"))
    last = {r.job_id: r for r in changes.groupBy("job_id").agg(F.max_by(F.struct("*"), F.struct("at", "processed_items")).alias("r")).select("r.*").collect()}
    want = {r.job_id: r for r in jobs.job_table(jobs.within_time(log_of(spark, LOG), F.lit(day(2, 0)))).collect()}
    assert {k: (r.status, r.processed_items, r.error_message) for k, r in last.items()} == {k: (r.status, r.processed_items, r.error_message) for k, r in want.items()}
    assert changes.where("job_id = 'done'").count() == 4 and last["gap"]["at"] == day(1, 300)


def page(url, at, html=None, price=None, title=None):
    return {"url": url, "html": html, "price": price, "metadata": (title, None, None, None), "scraped_at": at}


def test_jobs_see_the_newest_page_only(spark):
    from tamarack import schemas

    kind = f"{schemas.RAW_PAGE}, scraped_at timestamp"
    names = [f.split()[0] for f in ("markdown", "html", "linksOnPage", "price", "current_price", "originalPrice", "original_price", "brand", "category", "description", "features_str", "features_arr", "specifications", "images_str", "images_arr", "availability", "stock_status")]
    pages = [{**dict.fromkeys(names), **p} for p in (page("http://h/c", day(1), '<a href="/p/100">'), page("http://h/c", day(2), '<a href="/p/200">'), page("http://h/p/100", day(1), price="5", title="Lamp 100"), page("http://h/p/200", day(1), price="0", title="Lamp"), page("http://h/p/200", day(3), price="7", title="Lamp 200"))]
    asked = spark.createDataFrame([("1", "category", "http://h/c", None, day(4))], "job_id string, job_type string, target_url string, urls array<string>, at timestamp")
    events, products = jobs.run_jobs(asked, spark.createDataFrame(pages, kind), ["scraped_at"], "http://h")
    assert [(r.status, r.total_items, r.processed_items, r.success_items) for r in events.orderBy("status", "processed_items").collect()] == [("completed", 1, 1, 1), ("running", 1, 0, 0), ("running", 1, 1, 1)]
    assert [(r.sku, int(r.current_price)) for r in products.collect()] == [("200", 7)]
    end = jobs.job_table(events).first()
    assert (end.status, end.total_items, end.failed_items) == ("completed", 1, 0)


def test_a_run_reads_pages_once(spark, sf_dir):
    plan = registry.QUERIES["run_jobs"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 6 and plan.count("Exchange ") <= 8


def test_landed_pages_and_counts_by_window(spark, tmp_path):
    from tamarack.streaming import ingest

    rows = [{"url": "u1", "html": "<p>", "scraped_at": "2024-01-01T00:10:00Z"}, {"url": "u2", "markdown": "x", "scraped_at": "2024-01-01T00:50:00Z"}, {"url": "u3", "scraped_at": "2024-01-01T05:00:00Z"}, {"html": "<p>", "scraped_at": "2024-01-01T09:00:00Z"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    assert sorted(r.url for r in catalog.landed_pages(spark, str(tmp_path / "in")).collect()) == ["u1", "u2"]
    counts = ingest.windowed_counts(ingest.page_stream(spark, str(tmp_path / "in")))
    counts.writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.window.start.hour, r.pages) for r in spark.table("hours").collect()) == [(0, 2), (5, 1), (9, 1)]
