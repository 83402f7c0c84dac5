"""Price history under late and out-of-order pages: an event-time log and its corrections.

What was seen of a product (key, time, price) goes to a log that only grows; the history is the
log's changes in order of time. A batch changes the history near its own times only: a price
that is put between two earlier ones can make or unmake a change there and at the next one. So of
the log only the batch's keys, between the last row before and the first row after them, matter;
the rest is left out early for a batch of few rows, and else makes no difference by itself.
What comes out is a difference: rows to append (+1) and rows to take back (-1). Summed up, the
differences of any batches, in any order, are the history of their union.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import Files
from .sequence import parts, previous_in, sliced

SEEN = ["key", "at", "price"]
FEW = 100_000  # rows of a batch whose keys every task can hold


def lowest(seen: DataFrame) -> DataFrame:
    """One row a key and time, with the lowest price; null only where no row has one."""
    return seen.where("key is not null and at is not null").groupBy("key", "at").agg(F.min("price").alias("price"))


def affected(log: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of the log (key, at, price) that the few rows of a batch can bear on: of its keys, from the
    last row before the batch's first time (marked as ``edge``) to the first one after its last."""
    bounds = batch.groupBy(F.col("key").alias("__key")).agg(F.min("at").alias("__lo"), F.max("at").alias("__hi"))
    own = log.join(F.broadcast(bounds), F.col("key") == F.col("__key"))
    reach = own.groupBy("__key").agg(F.max(F.when(F.col("at") < F.col("__lo"), F.col("at"))).alias("__from"), F.min(F.when(F.col("at") > F.col("__hi"), F.col("at"))).alias("__to"))
    near = own.drop("__key").join(F.broadcast(reach), F.col("key") == F.col("__key"))
    inside = (F.col("__from").isNull() | (F.col("at") >= F.col("__from"))) & (F.col("__to").isNull() | (F.col("at") <= F.col("__to")))
    return near.where(inside).select(*SEEN, F.coalesce(F.col("at") == F.col("__from"), F.lit(False)).alias("edge"))


def corrections(log: DataFrame, batch: DataFrame) -> DataFrame:
    """(key, price, recorded_at, change) of a batch over a log, both (key, at, price) that lie in
    files: a row's change is +1 to append it to the history, -1 to take it back. A key's first row
    and null prices are no change. A key may hold any share of the rows. Rows move once: equal
    times are met, and rows with the ones before them, where the key's part lies."""
    few = batch.count() <= FEW
    old = affected(log, batch) if few else log.select(*SEEN, F.lit(False).alias("edge"))
    new = batch.select("key", "at", F.col("price").cast(log.schema["price"].dataType).alias("price"), F.lit(False).alias("edge"))
    rows = old.withColumn("is_new", F.lit(False)).unionByName(new.withColumn("is_new", F.lit(True)))
    parted = (parts if few else sliced)(rows, ["key", "at"]).repartition("key", "__part")
    was_seen, low = F.bool_or(~F.col("is_new")), F.min(F.when(~F.col("is_new"), F.col("price")))
    met = parted.groupBy("key", "__part", "at").agg(F.when(was_seen, F.struct(low.alias("price"))).alias("old"), F.struct(F.min("price").alias("price")).alias("now"), F.bool_or("edge").alias("edge"))
    met = previous_in(met.withColumns({"__v_before_old": F.col("old"), "__v_before_now": F.col("now")}), ["key"], ["at"], ["before_old", "before_now"])
    changed = lambda own, before: F.col(own).isNotNull() & F.col(before).isNotNull() & F.col(f"{own}.price").isNotNull() & ~F.col(f"{own}.price").eqNullSafe(F.col(f"{before}.price"))
    was, is_now = changed("old", "before_old"), changed("now", "before_now")
    same = was & is_now & F.col("old.price").eqNullSafe(F.col("now.price"))
    event = lambda price, change: F.struct(F.col(price).alias("price"), F.lit(change).alias("change"))
    events = F.array_compact(F.array(F.when(was & ~same, event("old.price", -1)), F.when(is_now & ~same, event("now.price", 1))))
    return met.where("not edge").select("key", "at", F.explode(events).alias("e")).select("key", F.col("e.price").alias("price"), F.col("at").alias("recorded_at"), F.col("e.change").alias("change"))


def history(events: DataFrame) -> DataFrame:
    """(key, price, recorded_at) that differences add up to."""
    return events.groupBy("key", "price", "recorded_at").agg(F.sum("change").alias("n")).where("n > 0").drop("n")


class ChangeLog:
    """The log and the differences as folders: ``seen`` by bucket of the key and batch, ``changes`` by batch."""

    def __init__(self, spark: SparkSession, root: str, price: str = "decimal(12,2)", buckets: int = 64):
        self.spark, self.root, self.price, self.buckets, self.files = spark, root, price, buckets, Files(spark)
        self.kind = f"key string, at timestamp, price {price}"

    def seen(self, before: int | None = None, buckets: list[int] | None = None, number: int | None = None) -> DataFrame:
        if not self.files.names(f"{self.root}/seen"):
            return self.spark.createDataFrame([], self.kind)
        rows = self.spark.read.schema(f"{self.kind}, b int, batch long").parquet(f"{self.root}/seen")
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        if number is not None:
            rows = rows.where(F.col("batch") == number)
        if buckets is not None:
            rows = rows.where(F.col("b").isin(buckets))
        return rows.select(*SEEN)

    def _folders(self, number: int) -> list[str]:
        """The buckets' folders that have rows of a batch."""
        return [b for b in self.files.names(f"{self.root}/seen") if b.startswith("b=") and f"batch={number}" in self.files.names(f"{self.root}/seen/{b}")]

    def append(self, batch: DataFrame, number: int) -> DataFrame:
        """Log a batch (key, at, price) and return its differences, which are written. Batches have
        numbers of their own, ascending; one that comes again is written over, with the same rows."""
        new = lowest(batch.select(F.col("key").cast("string").alias("key"), F.col("at").cast("timestamp").alias("at"), F.col("price").cast(self.price).alias("price")))
        for b in self._folders(number):
            self.files.delete(f"{self.root}/seen/{b}/batch={number}")
        logged = new.withColumns({"b": F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"), "batch": F.lit(number)})
        logged.write.mode("append").partitionBy("b", "batch").parquet(f"{self.root}/seen")
        touched = [int(b.removeprefix("b=")) for b in self._folders(number)]
        place = f"{self.root}/changes/batch={number}"
        corrections(self.seen(number, touched), self.seen(None, touched, number)).write.mode("overwrite").parquet(place)
        return self.spark.read.parquet(place)

    def history(self) -> DataFrame:
        if not self.files.names(f"{self.root}/changes"):
            return self.spark.createDataFrame([], f"key string, price {self.price}, recorded_at timestamp")
        return history(self.spark.read.schema(f"key string, price {self.price}, recorded_at timestamp, change int, batch long").parquet(f"{self.root}/changes"))
