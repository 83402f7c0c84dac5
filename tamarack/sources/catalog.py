"""The catalogue's tables as views of the given tables, and landed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *key: str) -> DataFrame:
    """The rows by a hash of the key over all cores, for costly work on a small table: one of few or
    large row groups would be one task's or some tasks' work."""
    n = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(n, df.rdd.getNumPartitions()), *key)


def products(spark: SparkSession, sf_dir: str, dated: bool = False) -> DataFrame:
    part = read(spark, sf_dir, "part")
    even = F.col("p_size") % 2 == 0
    out = part.select(
        F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("P"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("sku"), F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_retailprice").cast("decimal(12,2)").alias("current_price"),
        F.when(even, (F.col("p_retailprice") + F.col("p_size")).cast("decimal(12,2)")).alias("original_price"),
        F.when(even, F.round(F.col("p_size") * 100.0 / (F.col("p_retailprice") + F.col("p_size")), 4)).alias("discount_percentage"),
        F.when(F.col("p_size") <= 10, "out_of_stock").when(F.col("p_size") <= 40, "in_stock").otherwise("unknown").alias("availability"),
    )
    if not dated:
        return out
    dates = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_shipdate").alias("created_at"), F.max("l_shipdate").alias("scraped_at"))
    return out.join(dates.withColumn("id", F.col("l_partkey").cast("string")).drop("l_partkey"), "id")


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With tie-break columns: a product may have several prices at one time."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("product_id"), F.col("l_extendedprice").cast("decimal(12,2)").alias("price"), F.col("l_shipdate").alias("recorded_at"),
        F.col("l_orderkey").alias("tie_order"), F.col("l_linenumber").alias("tie_line"), F.col("l_suppkey").alias("tie_supplier"), F.col("l_quantity").alias("tie_quantity"),
    )


def orders_as_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a job that need no look at its items."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("pending")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("created_at"))


def jobs(spark: SparkSession, sf_dir: str, few: DataFrame | None = None) -> DataFrame:
    """All jobs, or only ``few`` (a handful of rows of ``orders_as_jobs``), whose items alone are then counted."""
    own = orders_as_jobs(spark, sf_dir) if few is None else few
    lines = read(spark, sf_dir, "lineitem")
    if few is not None:
        lines = lines.join(F.broadcast(few.select("id")), F.col("l_orderkey") == F.col("id"), "left_semi")
    items = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("bad"))
    n, bad = F.coalesce("n", F.lit(0)), F.coalesce("bad", F.lit(0))
    return own.join(items, F.col("id") == F.col("l_orderkey"), "left").select(
        "id", F.lit("product").alias("job_type"), "status", n.alias("total_items"), n.alias("processed_items"), (n - bad).alias("success_items"), bad.alias("failed_items"),
        "created_at", F.col("created_at").alias("started_at"), F.when(F.col("status") == "completed", F.col("created_at") + F.make_dt_interval(F.lit(0), n.cast("int"))).alias("completed_at"),
        F.lit(None).cast("string").alias("target_url"), F.lit(None).cast("string").alias("error_message"),
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = read(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_id"))
    nation = read(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("R"), "n_regionkey").alias("parent_id"))
    return region.unionByName(nation)


def landed_pages(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Pages that a fetcher has landed, under the raw page schema; pages without content are left out."""
    from ..schemas import RAW_PAGE

    pages = spark.read.schema(RAW_PAGE).format(fmt).load(path)
    return pages.where("url is not null and (markdown is not null or html is not null or metadata is not null)")
