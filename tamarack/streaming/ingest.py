"""Structured Streaming: landed pages into the product snapshot and price history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.bucketed import Snapshot
from ..operators.changes import ChangeLog
from ..operators.extract import extract, split_valid
from ..schemas import RAW_PAGE


def page_stream(spark: SparkSession, path: str, fmt: str = "json", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(f"{RAW_PAGE}, scraped_at timestamp").format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def windowed_counts(pages: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Pages by event-time window; state older than the watermark is dropped."""
    return pages.withWatermark("scraped_at", late).groupBy(F.window("scraped_at", window)).agg(F.count("*").alias("pages"))


def products_of(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(products, rejected rows) of landed pages with scraped_at."""
    valid, rejected = split_valid(extract(pages, "scraped_at"))
    return valid.withColumn("created_at", F.col("scraped_at")), rejected


def stores(spark: SparkSession, root: str, buckets: int = 64) -> tuple[Snapshot, ChangeLog]:
    """The snapshot and the price history below ``root``. Of pages of one product and time that with
    the lowest price counts, then that with the last address and name."""
    return Snapshot(spark, f"{root}/snapshot", ties=["-current_price", "url", "name"], buckets=buckets), ChangeLog(spark, f"{root}/history", buckets=buckets)


def ingest(pages: DataFrame, root: str, checkpoint: str, keep: int = 2, buckets: int = 64):
    """Start a query that merges each micro-batch into the snapshot and the price history of
    ``stores`` and writes ``root/quarantine`` and a row of counters to ``root/runs``. Only buckets with a changed row are written, and of
    the history only differences; pages may come in any order. A batch that runs again after a
    failure has no further effect. Of the snapshot's versions the last ``keep`` stay."""

    def run(batch: DataFrame, number: int) -> None:
        snapshot, log = stores(batch.sparkSession, root, buckets)
        landed = batch.persist()  # the writes read the same rows
        try:
            rows, rejected = products_of(landed)
            good, bad = Observation("good"), Observation("bad")  # counted while they are written
            seen = rows.observe(good, F.count("*").alias("n"))
            log.append(seen.select(F.col("sku").alias("key"), F.col("scraped_at").alias("at"), F.col("current_price").alias("price")), number)
            snapshot.merge(rows, number)
            rejected.observe(bad, F.count("*").alias("n")).write.mode("overwrite").parquet(f"{root}/quarantine/batch={number}")
            done = [(number, good.get["n"] + bad.get["n"], good.get["n"], bad.get["n"])]
            batch.sparkSession.createDataFrame(done, "batch long, processed_items long, success_items long, failed_items long").coalesce(1).write.mode("overwrite").parquet(f"{root}/runs/batch={number}")
        finally:
            landed.unpersist()
        snapshot.expire(max(2, keep))

    return pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
