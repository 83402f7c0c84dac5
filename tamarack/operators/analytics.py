"""Catalogue, price and job analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bounds and labels of the price histogram; a bucket has its lower bound.
PRICE_BUCKETS = [(0, "0-500"), (500, "500-1000"), (1000, "1000-2000"), (2000, "2000-5000"), (5000, "5000+")]


def product_stats(products: DataFrame) -> DataFrame:
    sale = F.col("discount_percentage") > 0
    return products.agg(
        F.count("*").alias("total_products"), F.countDistinct("brand").alias("total_brands"), F.countDistinct("category").alias("total_categories"),
        F.round(F.avg(F.col("current_price").cast("double")), 4).alias("avg_price"), F.min("current_price").cast("double").alias("min_price"), F.max("current_price").cast("double").alias("max_price"),
        F.count_if(sale).alias("products_on_sale"), F.round(F.avg(F.when(sale, F.col("discount_percentage"))), 4).alias("avg_discount"),
    )


def daily_stats(jobs: DataFrame) -> DataFrame:
    """Completed jobs by day; the rate is the mean of the jobs' rates, 0 for a job that processed nothing."""
    rate = F.when(F.col("processed_items") > 0, F.col("success_items").cast("double") / F.col("processed_items") * 100).otherwise(0.0)
    return jobs.where("status = 'completed'").groupBy(F.to_date("created_at").alias("date")).agg(
        F.count("*").alias("jobs_run"), F.sum("success_items").alias("total_success"), F.sum("failed_items").alias("total_failed"), F.round(F.avg(rate), 4).alias("avg_success_rate")
    )


def daily_window(daily: DataFrame, days: int, as_of: str | None = None) -> DataFrame:
    """The rows of the ``days`` calendar days up to ``as_of`` (default: the newest date); days without jobs have no row."""
    newest = daily.agg(F.max("date")).scalar() if as_of is None else F.lit(as_of).cast("date")
    return daily.where((F.col("date") > F.date_sub(newest, days)) & (F.col("date") <= newest))


def empty_as_null(products: DataFrame, *columns: str) -> DataFrame:
    """Missing brands and categories are stored as empty text, which counts as a value; here it doesn't."""
    return products.withColumns({c: F.nullif(c, F.lit("")) for c in columns or ("brand", "category")})


def distribution(products: DataFrame, column: str) -> DataFrame:
    return products.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(column).agg(F.count("*").alias("count"))


def distinct_values(products: DataFrame, column: str) -> DataFrame:
    return products.select(column).where(F.col(column).isNotNull() & (F.col(column) != "")).distinct().orderBy(column)


def price_bucket(price: Column) -> Column:
    out = F.when(price.isNull() | (price < 0), F.lit(None).cast("string"))
    for (_, label), (upper, _) in zip(PRICE_BUCKETS, PRICE_BUCKETS[1:], strict=False):
        out = out.when(price < upper, label)
    return out.otherwise(PRICE_BUCKETS[-1][1])


def price_histogram(prices: DataFrame, price: str) -> DataFrame:
    """A count a bucket, empty ones too; nulls are left out."""
    labels = prices.sparkSession.createDataFrame([(x,) for _, x in PRICE_BUCKETS], "bucket string")
    counts = prices.select(price_bucket(F.col(price)).alias("b")).where("b is not null").groupBy("b").agg(F.count("*").alias("n"))
    return labels.join(counts, F.col("bucket") == F.col("b"), "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def price_trends(products: DataFrame, history: DataFrame, as_of: str | None, days: int = 30, sign: int = 0) -> DataFrame:
    """History rows of the ``days`` before ``as_of`` (default: the newest row) with the change to the
    current price; sign 1 or -1 keeps increases or decreases."""
    newest = history.agg(F.max("recorded_at")).scalar() if as_of is None else F.lit(as_of).cast("timestamp_ntz")
    recent = history.where(F.col("recorded_at") > newest - F.make_dt_interval(F.lit(days)))  # a bound that reaches the scan
    p = products.select("id", "name", "brand", F.col("current_price").cast("double").alias("current_price"))
    h = recent.select(F.col("product_id"), F.col("price").cast("double").alias("historical_price"), "recorded_at", *[c for c in recent.columns if c.startswith("tie")])
    change = F.col("current_price") - F.col("historical_price")
    out = p.join(h, F.col("id") == F.col("product_id")).drop("product_id")
    out = out.withColumns({"price_change": F.round(change, 4), "price_change_percent": F.round(F.try_divide(change, F.col("historical_price")) * 100, 4)})
    return out.where(F.signum("price_change") == sign) if sign else out


def top_changes(trends: DataFrame, ties: list[str], n: int = 20) -> DataFrame:
    return trends.orderBy(F.abs("price_change_percent").desc_nulls_last(), *ties).limit(n)


def performance(jobs: DataFrame) -> DataFrame:
    """Sums over completed jobs and the pooled success rate."""
    s, f = F.sum("success_items"), F.sum("failed_items")
    return jobs.where("status = 'completed'").agg(
        F.count("*").alias("total_jobs"), s.alias("total_success"), f.alias("total_failed"), F.coalesce(F.round(F.try_divide(s * 100.0, s + f), 2), F.lit(0.0)).alias("average_success_rate")
    )


def job_duration(jobs: DataFrame) -> DataFrame:
    both = F.col("started_at").isNotNull() & F.col("completed_at").isNotNull()
    seconds = (F.unix_timestamp(F.col("completed_at").cast("timestamp")) - F.unix_timestamp(F.col("started_at").cast("timestamp"))).cast("double")
    return jobs.where(both).agg(F.coalesce(F.round(F.avg(seconds), 2), F.lit(0.0)).alias("average_job_duration_seconds"))


def job_rates(jobs: DataFrame) -> DataFrame:
    """Progress and both success rates (of processed, and of finished items); 0 where there is nothing to divide by."""
    rate = lambda a, b: F.coalesce(F.round(F.try_divide(F.col(a) * 100.0, b), 4), F.lit(0.0))
    return jobs.select(
        "id", rate("processed_items", F.col("total_items")).alias("progress"), rate("success_items", F.col("processed_items")).alias("success_of_processed"),
        rate("success_items", F.col("success_items") + F.col("failed_items")).alias("success_of_finished"), F.col("status").isin("pending", "running").alias("is_running"),
    )


def job_tallies(jobs: DataFrame) -> DataFrame:
    status = F.col("status")
    return jobs.agg(F.count("*").alias("total"), F.count_if(status.isin("pending", "running")).alias("active"), F.count_if(status == "completed").alias("completed"), F.count_if(status == "failed").alias("failed"))


def batch_summary(outcomes: DataFrame, ok: str) -> DataFrame:
    n, good = F.count("*"), F.count_if(F.col(ok))
    return outcomes.agg(n.alias("total"), good.alias("success"), (n - good).alias("failed"), F.coalesce(F.round(F.try_divide(good * 100.0, n), 4), F.lit(0.0)).alias("success_rate"))


def category_tree(categories: DataFrame) -> DataFrame:
    """(id, name, level, path) from the roots down, by recursive SQL."""
    return categories.sparkSession.sql("""
        WITH RECURSIVE tree AS (
            SELECT id, name, 0 AS level, name AS path FROM {rows} WHERE parent_id IS NULL
            UNION ALL
            SELECT c.id, c.name, t.level + 1, concat(t.path, '/', c.name) FROM {rows} c JOIN tree t ON c.parent_id = t.id
        ) SELECT id, name, level, path FROM tree""", rows=categories)  # fmt: skip


def history_lists(history: DataFrame, by: list[str], days: int = 30) -> DataFrame:
    """(product_id, days, history): each product's newest ``days`` prices, newest first."""
    if not 1 <= days <= 365:
        raise ValueError("days must be 1 to 365")
    newest = Window.partitionBy("product_id").orderBy(*[F.desc(c) for c in by])
    few = history.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= days)
    lists = few.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("n", "price", "recorded_at"))).alias("history"))
    return lists.select("product_id", F.lit(days).alias("days"), F.transform("history", lambda h: F.struct(h["price"].alias("price"), h["recorded_at"].alias("recorded_at"))).alias("history"))
