"""Fetch attempts as sessions: at most three tries an address, with waits between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import previous, running_sum

# Tries of a session, the wait after "too many requests" if none is named, and that status.
TRIES, DEFAULT_WAIT, TOO_MANY, OK = 3, 60, 429, 200


def wait_after(status: Column, retry_after: Column, tried: Column) -> Column:
    """Seconds to wait before the next try: as long as the answer asked for after "too many
    requests", 1, 2, ... (doubled) after an error without an answer (null status), else none."""
    return F.when(status.isNull(), F.pow(F.lit(2), tried - 1).cast("long")).when(status == TOO_MANY, F.coalesce(retry_after, F.lit(DEFAULT_WAIT)).cast("long")).otherwise(F.lit(0).cast("long"))


def sessions(log: DataFrame, pause: int = 3600, ties: tuple[str, ...] = ("attempt_id",)) -> DataFrame:
    """A row a session of (url, at, status, retry_after): url, first_at, last_at, attempts, outcome
    and waited.

    Tries of an address in order of time are one session until one succeeds, three are made, or
    more than ``pause`` seconds go by. ``outcome`` is saved, failed (three tries, or given up for
    a later session) or open (the address's last session, with tries left); ``waited`` says whether
    every try came after the wait that the one before asked for. A hot address is spread over parts."""
    order = ["at", *ties]
    met = previous(log.where("url is not null and at is not null"), ["url"], order, {"before": F.struct("at", "status", "retry_after")})
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    gone = seconds("at") - seconds("before.at")
    begins = F.col("before").isNull() | F.coalesce(F.col("before.status") == OK, F.lit(False)) | (gone > pause)
    runs = running_sum(met.withColumns({"begins": begins, "gone": gone}), ["url"], order, {"run": F.col("begins").cast("long")})
    tries = running_sum(runs, ["url", "run"], order, {"tried": F.lit(1)})
    number, place = F.floor((F.col("tried") - 1) / TRIES), (F.col("tried") - 1) % TRIES + 1
    needed = wait_after(F.col("before.status"), F.col("before.retry_after"), place - 1)
    kept = (place == 1) | (F.col("gone") >= needed)
    last = F.max_by(F.struct(F.col("status").alias("status")), F.struct(*order))["status"]
    grouped = tries.groupBy("url", "run", number.alias("number")).agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("attempts"), last.alias("status"), F.bool_and(kept).alias("waited"))
    ends = grouped.groupBy(F.col("url").alias("__url")).agg(F.max(F.struct("run", "number")).alias("__end"))
    both = grouped.join(ends, F.col("url") == F.col("__url"))
    open_ = (F.struct("run", "number") == F.col("__end")) & (F.col("attempts") < TRIES)
    outcome = F.when(F.coalesce(F.col("status") == OK, F.lit(False)), "saved").when(open_, "open").otherwise("failed")
    return both.select("url", "first_at", "last_at", "attempts", outcome.alias("outcome"), "waited")
