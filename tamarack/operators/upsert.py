"""Keyed snapshots and change capture, set-based. A batch folds to one row a key, combined before
its only shuffle, and meets the snapshot in one full outer join on the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """The row of each key that is greatest by these columns, nulls least; they have to be a total order for a stable result."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("__row")).select(*[F.col(c) if c in key else F.col(f"__row.{c}").alias(c) for c in df.columns])


def order_of(at: str, ties: list[str], prefix: str = "") -> Column:
    """What tells which of two rows is the later: the time, then the ties, of which the largest wins
    (of "-x" the smallest x); nulls are least."""
    one = lambda t: -F.col(f"{prefix}{t[1:]}") if t.startswith("-") else F.col(f"{prefix}{t}")
    return F.struct(F.col(f"{prefix}{at}").alias("at"), *[one(t).alias(f"t{i}") for i, t in enumerate(ties)])


def fold(batch: DataFrame, key: str, at: str, ties: list[str] = ()) -> DataFrame:
    """The latest row of each key, created when the batch first saw the key. Rows without a key go."""
    rest = [c for c in batch.columns if c != key]
    first = F.min("created_at" if "created_at" in rest else at).alias("__first")
    grouped = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order_of(at, ties)).alias("__row"), first)
    return grouped.select(key, *[(F.col("__first") if c == "created_at" else F.col(f"__row.{c}")).alias(c) for c in rest])


def merged(snapshot: DataFrame, batch: DataFrame, key: str, at: str, ties: list[str], now: Column | None) -> dict[str, Column]:
    """The new value of each of the snapshot's columns, over a join of it with the folded batch,
    whose columns are prefixed by two underscores. A batch row that is older than the stored one
    changes nothing but created_at."""
    stored = F.col(key).isNotNull()
    wins = F.col(f"__{key}").isNotNull() & (~stored | (order_of(at, ties, "__") >= order_of(at, ties)))
    out = {}
    for c in snapshot.columns:
        fresh = F.col(f"__{c}") if c in batch.columns else F.lit(None).cast(snapshot.schema[c].dataType)
        if c == "updated_at":
            out[c] = F.when(wins & stored, F.col(f"__{at}") if now is None else now).otherwise(F.col(c))
        elif c == "id":
            out[c] = F.coalesce(F.col(c), fresh)
        elif c == "created_at":
            out[c] = F.least(F.col(c), fresh)  # nulls don't count
        else:
            out[c] = F.when(wins, fresh).otherwise(F.col(c))
    return out


def prefixed(batch: DataFrame) -> DataFrame:
    return batch.select(*[F.col(c).alias(f"__{c}") for c in batch.columns])


def upsert(snapshot: DataFrame, batch: DataFrame, key: str = "sku", at: str = "scraped_at", ties: list[str] = (), now: Column | None = None) -> DataFrame:
    """The new snapshot: every column, nulls included, of the latest row of a key, stored or of the
    batch, so that batches may come in any order. Rows that are as late as the stored one replace it.
    The stored id of a key stays, created_at is the earliest; updated_at, where there is one, is
    ``now`` (else the batch row's time) for stored keys whose row is replaced. Batch rows without a key go."""
    joined = snapshot.join(prefixed(fold(batch, key, at, ties)), F.col(key) == F.col(f"__{key}"), "full_outer")
    return joined.select(*[v.alias(c) for c, v in merged(snapshot, batch, key, at, ties, now).items()])


def price_changes(log: DataFrame, key: str, price: str, order: list[Column]) -> DataFrame:
    """Rows of a log whose price differs from the row before of the same key; a key's first row
    and null prices are no changes."""
    before = F.lag(price).over(Window.partitionBy(key).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    marked = log.withColumns({"previous_price": before, "__first": first})
    return marked.where(~F.col("__first") & F.col(price).isNotNull() & ~F.col(price).eqNullSafe(F.col("previous_price"))).drop("__first")


def history_delta(snapshot: DataFrame, batch: DataFrame, key: str = "sku", at: str = "scraped_at", price: str = "current_price") -> DataFrame:
    """(key, price, recorded_at) to append: the batch's changes in order, starting from the stored price."""
    stored = snapshot.select(key, F.col(price), F.lit(None).cast("timestamp").alias(at))
    log = stored.unionByName(batch.select(key, price, F.col(at).cast("timestamp").alias(at)))
    return price_changes(log, key, price, [F.asc_nulls_first(at)]).select(key, F.col(price).alias("price"), F.col(at).alias("recorded_at"))


def fold_jobs(events: DataFrame, key: str, status: str, at: str, ties: list[str] = ()) -> DataFrame:
    """The state of each job from its status events: last status, last time of running, last terminal time."""
    newest = F.struct(at, *ties, status)
    return events.groupBy(key).agg(
        F.max(newest)[status].alias("status"),
        F.max(F.when(F.col(status) == "running", F.col(at))).alias("started_at"),
        F.max(F.when(F.col(status).isin("completed", "failed"), F.col(at))).alias("completed_at"),
    )
