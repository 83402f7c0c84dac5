"""Scrape jobs: requests, the life cycle as a log of events, and batch runs over landed pages.

A job is never updated in place. Every change is a row of a log (``EVENT``), and the table of
jobs is the fold of the log, so runs on any number of executors only append.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as u
from ..schemas import JOB_TYPES
from ..sources.storage import scratch, written
from .checks import rejection
from .discovery import check_pages, follow
from .extract import extract
from .sequence import previous, running_sum
from .upsert import latest

EVENT = (
    "job_id string, at timestamp, job_type string, status string, target_url string, total_items long, processed_items long, "
    "success_items long, failed_items long, error_message string"
)
ACTIVE = ["pending", "running"]
# What a request or a run that can't go on is told.
NO_URLS, NO_TARGET, NO_JOB = "URLs required for product scraping", "Target URL required for category/search scraping", "Job not found"
NOTHING_FOUND, BAD_JOB, CANCELLED = "No products found in category", "Invalid job type or missing parameters", "Cancelled by user"
#: What a job is told that made no progress for too long.
TIMED_OUT = "No progress in time"


@dataclass(frozen=True)
class JobRequest:
    """One request; raises ValueError where it may not be made."""

    job_type: str
    target_url: str | None = None
    urls: list[str] = field(default_factory=list)
    max_pages: int = 5
    max_concurrent: int = 5

    def __post_init__(self):
        if self.job_type not in JOB_TYPES[1:]:
            raise ValueError(f"job_type must be one of {JOB_TYPES[1:]}")
        if not 1 <= self.max_pages <= 50 or not 1 <= self.max_concurrent <= 10:
            raise ValueError("max_pages must be 1 to 50, max_concurrent 1 to 10")
        if self.job_type == "product" and not self.urls:
            raise ValueError(NO_URLS)
        if self.job_type != "product" and not self.target_url:
            raise ValueError(NO_TARGET)


def requested(requests: DataFrame) -> DataFrame:
    """Requests (job_id, job_type, target_url, urls, at) with ``error``, null for those that may
    be made, and the job's target: the address asked for, else the first of its addresses."""
    no_urls = F.coalesce(F.size("urls"), F.lit(0)) < 1
    error = (
        F.when(F.col("job_type").isNull() | ~F.col("job_type").isin(JOB_TYPES[1:]), BAD_JOB)
        .when((F.col("job_type") == "product") & no_urls, NO_URLS)
        .when((F.col("job_type") != "product") & (F.coalesce("target_url", F.lit("")) == ""), NO_TARGET)
    )
    return requests.withColumns({"error": error, "target_url": F.coalesce(F.nullif("target_url", F.lit("")), F.get("urls", F.lit(0)))})


def created(requests: DataFrame) -> DataFrame:
    """The first events, status pending, of the requests that may be made."""
    ok = requested(requests).where("error is null")
    none = lambda kind: F.lit(None).cast(kind)
    return ok.select("job_id", "at", "job_type", F.lit("pending").alias("status"), "target_url", *[F.lit(0).cast("long").alias(c) for c in ("total_items", "processed_items", "success_items", "failed_items")], none("string").alias("error_message"))


def job_table(events: DataFrame) -> DataFrame:
    """A row a job: of each column the newest value that isn't null (by ``at``, then the further
    status), created_at, and when it last began and ended."""
    rank = F.array_position(F.array(*map(F.lit, ["pending", "running", "completed", "failed", "cancelled"])), F.col("status"))
    order = F.struct("at", rank.alias("rank"), "processed_items")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    columns = [c.split()[0] for c in EVENT.split(", ")][2:]
    return events.groupBy("job_id").agg(
        *map(last, columns), F.min("at").alias("created_at"), F.max(F.when(F.col("status") == "running", F.col("at"))).alias("started_at"),
        F.max(F.when(F.col("status").isin("completed", "failed"), F.col("at"))).alias("completed_at"),
    )


def cancelled(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """Each asked (job_id) with what came of it: ``event`` is cancelled for a pending or running
    job, else null with the reason in ``message``. Cancelling marks the job; it stops no work."""
    state = jobs.select(F.col("job_id").alias("__job"), "status")
    met = asked.join(state, F.col("job_id") == F.col("__job"), "left").drop("__job")
    can = F.col("status").isin(ACTIVE)
    message = F.when(F.col("status").isNull(), NO_JOB).when(can, CANCELLED).otherwise(F.concat(F.lit("Cannot cancel job with status: "), "status"))
    return met.select("job_id", F.when(can, "cancelled").alias("event"), message.alias("message"))


def harvest(pages: DataFrame, by: list[str], base: str = "", max_pages: int = 5) -> DataFrame:
    """A row an address, of its newest page (by ``by``): the product's columns, ``outcome`` (saved, or
    why it is rejected), ``links`` and ``more`` (the addresses that the page leads to). One pass: a page
    is read, and then only what was found in it is moved."""
    seen = pages.withColumns({"links": u.page_products("html", "linksOnPage", base), "more": u.pagination("html", "url", base, max_pages)})
    rows = extract(seen, *by, "links", "more").withColumn("outcome", F.coalesce(rejection(), F.lit("saved")))
    return latest(rows, ["url"], by)


def judged(wanted: DataFrame, harvested: DataFrame) -> DataFrame:
    """Each wanted row (..., url) with its outcome; an address without a page failed to be fetched."""
    own = harvested.select(F.col("url").alias("__url"), "outcome")
    found = wanted.join(own, F.col("url") == F.col("__url"), "left").drop("__url")
    return found.withColumn("outcome", F.coalesce("outcome", F.lit("not fetched")))


def outcomes(wanted: DataFrame, pages: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(outcome of each wanted row (..., url), valid products of the wanted addresses with scraped_at).
    A page is the newest landed of its address (by ``by``; the first is scraped_at)."""
    harvested = harvest(pages, by)
    asked = wanted.select(F.col("url").alias("__url")).distinct()
    valid = harvested.where("outcome = 'saved'").join(asked, F.col("url") == F.col("__url"), "left_semi")
    return judged(wanted, harvested), valid.drop("outcome", "links", "more", *by[1:])


def batch_summary(found: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, total, success, failed, success_rate in percent) of outcomes."""
    good = F.count_if(F.col("outcome") == "saved")
    return found.groupBy(key).agg(F.count("*").alias("total"), good.alias("success"), (F.count("*") - good).alias("failed"), F.round(good * 100.0 / F.count("*"), 4).alias("success_rate"))


def chunk_progress(found: DataFrame, max_concurrent: int = 5, key: str = "job_id", position: str = "position") -> DataFrame:
    """A job's progress after each chunk of ``max_concurrent`` addresses, in the order of ``position``
    (from 0). Chunks are counted before they are ordered."""
    chunks = found.groupBy(key, F.floor(F.col(position) / max_concurrent).alias("chunk")).agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "saved").alias("good"))
    so_far = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done, good = F.sum("n").over(so_far), F.sum("good").over(so_far)
    return chunks.select(key, "chunk", done.alias("processed_items"), good.alias("success_items"), (done - good).alias("failed_items"))


def run_jobs(requests: DataFrame, pages: DataFrame, by: list[str], base: str, max_pages: int = 5, max_concurrent: int = 5) -> tuple[DataFrame, DataFrame]:
    """(events of each created job, its valid products). A product job takes its addresses, a
    category job those that its listing leads to; one without any fails, as does any other job. A job
    that runs logs that it is running, its progress after each ``max_concurrent`` addresses, and
    its end; ``job_table`` folds that. Pages are read once, for what is found in the newest of each
    address, which is written; so are the wanted addresses."""
    check_pages(max_pages)
    spark = pages.sparkSession
    jobs = requested(requests).where("error is null")
    harvested = written(harvest(pages, by, base, max_pages), scratch(spark, "harvest"))
    listed = jobs.where("job_type = 'product'").select("job_id", F.posexplode("urls").alias("place", "url"))
    starts = jobs.where("job_type = 'category'").select("job_id", F.col("target_url").alias("start_url"))
    met = follow(harvested, starts.select("start_url").distinct(), max_pages)
    led = starts.join(met, "start_url").select("job_id", F.lit(None).cast("int").alias("place"), "url")
    wanted = running_sum(judged(listed.union(led), harvested), ["job_id"], ["place", "url"], {"position": F.lit(1)}).withColumn("position", F.col("position") - 1)
    found = written(wanted, scratch(spark, "wanted"))
    progress = chunk_progress(found, max_concurrent)
    none = lambda kind: F.lit(None).cast(kind)
    # The chunks of a job, and its end, as one list: the last chunk has the job's sums.
    last = F.col("processed_items") == F.col("total_items")
    sums = found.groupBy(F.col("job_id").alias("__job")).agg(F.count("*").alias("total_items"))
    own = jobs.join(sums, F.col("job_id") == F.col("__job"), "left").drop("__job")
    chunks = own.join(progress.withColumnRenamed("job_id", "__job"), F.col("job_id") == F.col("__job"), "left")
    event = lambda status, total, processed, success, failed, error: F.struct(
        F.lit(status).alias("status"), total.cast("long").alias("total_items"), processed.cast("long").alias("processed_items"), success.cast("long").alias("success_items"), failed.cast("long").alias("failed_items"), error.cast("string").alias("error_message")
    )
    total, processed, success, failed = (F.col(c) for c in ("total_items", "processed_items", "success_items", "failed_items"))
    nil = none("long")
    begins = F.when(F.col("chunk") == 0, event("running", total, F.lit(0), F.lit(0), F.lit(0), none("string")))
    goes_on = F.when(processed.isNotNull(), event("running", total, processed, success, failed, none("string")))
    ends = F.when(last, event("completed", total, processed, success, failed, none("string")))
    reason = F.when(F.col("job_type") == "category", NOTHING_FOUND).otherwise(BAD_JOB)
    fails = F.when(total.isNull(), event("failed", nil, nil, nil, nil, reason))
    rows = chunks.select("job_id", "at", "job_type", "target_url", F.explode(F.array_compact(F.array(begins, goes_on, ends, fails))).alias("e"))
    valid = harvested.where("outcome = 'saved'").join(found.select(F.col("url").alias("__url")).distinct(), F.col("url") == F.col("__url"), "left_semi")
    return rows.select("job_id", "at", "job_type", "e.status", "target_url", "e.total_items", "e.processed_items", "e.success_items", "e.failed_items", "e.error_message"), valid.drop("outcome", "links", "more", *by[1:])


def timed_out(events: DataFrame, now, seconds: int = 300) -> DataFrame:
    """A failed event for each job that made no progress for longer than ``seconds`` before it ended:
    at the end of the first such pause, between two of its events or from its last one to ``now`` (a
    time). What a job logs after that doesn't count (``within_time``)."""
    order = ["at", "processed_items", "status"]
    second = lambda c: F.unix_timestamp(c.cast("timestamp"))
    over = F.col("status").isin("completed", "failed", "cancelled")
    ends = events.groupBy("job_id").agg(F.min(F.when(over, F.col("at"))).alias("__end"))
    open_ = events.join(ends.withColumnRenamed("job_id", "__job"), F.col("job_id") == F.col("__job")).where("__end is null or at <= __end")
    met = previous(open_.select(*events.columns, "__end"), ["job_id"], order, {"before": F.col("at")})
    pause = F.when(second(F.col("at")) - second(F.col("before")) > seconds, F.col("before"))
    silent = met.groupBy("job_id").agg(F.min(pause).alias("first"), F.max("at").alias("last"), F.max("__end").alias("end"), F.max("job_type").alias("job_type"))
    ended = F.when(F.col("end").isNull() & (second(now) - second(F.col("last")) > seconds), F.col("last"))
    since = F.coalesce("first", ended)
    none = lambda kind: F.lit(None).cast(kind)
    failed = silent.where(since.isNotNull()).select(
        "job_id", (since + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))).alias("at"), "job_type", F.lit("failed").alias("status"), none("string").alias("target_url"),
        *[none("long").alias(c) for c in ("total_items", "processed_items", "success_items", "failed_items")], F.lit(TIMED_OUT).alias("error_message"),
    )
    return failed.select(*events.columns)


def within_time(events: DataFrame, now, seconds: int = 300) -> DataFrame:
    """The log in which jobs that timed out have failed: events after that are left out."""
    failed = timed_out(events, now, seconds)
    ends = failed.select(F.col("job_id").alias("__job"), F.col("at").alias("__at"))
    kept = events.join(ends, F.col("job_id") == F.col("__job"), "left").where("__at is null or at <= __at").drop("__job", "__at")
    return kept.unionByName(failed)


def rescrape(products: DataFrame, ids: DataFrame, at) -> DataFrame:
    """A product request for each asked (id) that has an address; others get none."""
    met = ids.select(F.col("id").alias("__id")).distinct().join(products.select("id", "url"), F.col("id") == F.col("__id")).where("url <> ''")
    return met.select(F.concat(F.lit("rescrape-"), "id").alias("job_id"), F.lit("product").alias("job_type"), F.col("url").alias("target_url"), F.array("url").alias("urls"), at.alias("at"))
