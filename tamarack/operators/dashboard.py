"""A dashboard as one answer, and sketches that add up over any range of days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .analytics import price_bucket

#: Sketch sizes, and the errors that they keep: of a count of distinct values, and of a rank, at three deviations.
LG_K, KLL_K = 12, 400
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / (1 << LG_K) ** 0.5, 0.012


def _with_zeros(rows: DataFrame, kpis: list[str]) -> DataFrame:
    """KPIs are there for an empty table too, of which grouping sets make no row at all."""
    zeros = rows.sparkSession.createDataFrame([("kpi", k, 0, 0.0) for k in kpis], "section string, name string, n long, value double")
    return rows.union(zeros).groupBy("section", "name").agg(F.max("n").alias("n"), F.max_by("value", "n").alias("value"))


def product_sections(products: DataFrame) -> DataFrame:
    """(section, name, n, value) of one scan: the KPIs (value is their number), products by brand and
    by category, and by price bucket. Empty names and missing prices have no row of their own."""
    p = products.select(
        F.nullif("brand", F.lit("")).alias("brand"), F.nullif("category", F.lit("")).alias("category"), price_bucket(F.col("current_price")).alias("bucket"),
        F.when(F.col("current_price") != 0, F.col("current_price").cast("double")).alias("price"), (F.col("discount_percentage") > 0).alias("on_sale"),
    )
    sets = p.groupingSets([[], ["brand"], ["category"], ["bucket"]], "brand", "category", "bucket").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.coalesce(F.round(F.avg("price"), 2), F.lit(0.0)).alias("average_price"), F.count_if("on_sale").alias("on_sale")
    )
    row = lambda section, name, value: F.struct(F.lit(section).alias("section"), name.alias("name"), F.col("n").alias("n"), value.cast("double").alias("value"))
    whole = F.array(row("kpi", F.lit("total_products"), F.col("n")), row("kpi", F.lit("average_price"), F.col("average_price")), row("kpi", F.lit("products_on_sale"), F.col("on_sale")))
    one = lambda section, c: F.array(row(section, F.col(c), F.col("average_price")))
    each = F.when(F.col("g") == 7, whole).when(F.col("g") == 3, one("brand", "brand")).when(F.col("g") == 5, one("category", "category")).otherwise(one("price", "bucket"))
    rows = sets.select(F.explode(each).alias("r")).select("r.*").where("name is not null")
    return _with_zeros(rows, ["total_products", "average_price", "products_on_sale"])


def job_sections(jobs: DataFrame, days: int = 7) -> DataFrame:
    """(section, name, n, value) of one scan: jobs in all, by status, and of the newest ``days`` days
    with completed jobs, value being the mean of the rates."""
    rate = F.when(F.col("processed_items") > 0, F.col("success_items") * 100.0 / F.col("processed_items")).otherwise(0.0).cast("double")
    j = jobs.select("status", F.when(F.col("status") == "completed", F.to_date("created_at")).alias("day"), rate.alias("rate"))
    sets = j.groupingSets([[], ["status"], ["day"]], "status", "day").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.round(F.avg("rate"), 4).alias("rate"))
    name = F.when(F.col("g") == 3, "total_jobs").when(F.col("g") == 1, F.col("status")).otherwise(F.col("day").cast("string"))
    section = F.when(F.col("g") == 3, "kpi").when(F.col("g") == 1, "status").otherwise("day")
    value = F.when(F.col("g") == 2, F.col("rate")).otherwise(F.col("n").cast("double"))
    rows = _with_zeros(sets.select(section.alias("section"), name.alias("name"), "n", value.alias("value")).where("name is not null"), ["total_jobs"])
    # As many rows as there are days with jobs are ordered.
    newest = rows.where("section = 'day'").orderBy(F.desc("name")).limit(days)
    return rows.where("section <> 'day'").union(newest)


def dashboard(products: DataFrame, jobs: DataFrame, days: int = 7) -> DataFrame:
    return product_sections(products).union(job_sections(jobs, days))


def daily_sketches(prices: DataFrame, by: list[str]) -> DataFrame:
    """Of (product_id, price, recorded_at, ...) a row a day and ``by``: rows, lowest and highest price,
    a sketch of the distinct products (HLL) and one of the prices (KLL). A few KB each, whatever
    they stand for. Null prices are in n only."""
    return prices.groupBy(F.to_date("recorded_at").alias("day"), *by).agg(
        F.count("*").alias("n"), F.min("price").alias("lowest"), F.max("price").alias("highest"),
        F.hll_sketch_agg("product_id", LG_K).alias("products"), F.kll_sketch_agg_double(F.col("price").cast("double"), F.lit(KLL_K)).alias("prices"),
    )


def merged_sketches(sketches: DataFrame, by: list[str], quantiles: tuple[float, ...] = (0.5,), first: str | None = None, last: str | None = None) -> DataFrame:
    """Sketches of a range of days added up: by, n, lowest, highest, products (within DISTINCT_ERROR
    of the number of distinct ones) and prices (an array of values whose ranks are within RANK_ERROR
    of the quantiles)."""
    rows = sketches
    if first is not None:
        rows = rows.where(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        rows = rows.where(F.col("day") <= F.lit(last).cast("date"))
    added = rows.groupBy(*by).agg(F.sum("n").alias("n"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"), F.hll_sketch_estimate(F.hll_union_agg("products")).alias("products"), F.kll_merge_agg_double("prices").alias("__p"))
    return added.select(*by, "n", "lowest", "highest", "products", F.kll_sketch_get_quantile_double("__p", F.array(*map(F.lit, quantiles))).alias("prices"))
