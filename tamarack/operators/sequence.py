"""Order within keys, where one key may hold a third of all rows.

A window over a key puts all its rows into one task. Here the rows of a key that holds more than a
task's share are dealt out by ranges of their order, so that a hot key lies in many parts; a key's
part is a window of its own, and what a part has to know of the parts before it is one row a part
of a hot key. All other keys are one part each, and rows move once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import scratch, written


SAMPLE = 200_000  # rows that are looked at for hot keys and where to cut them; the cuts change no result


def sliced(df: DataFrame, by: list[str]) -> DataFrame:
    """The rows of a table that lies in files, with a number in ``__part``: null, but for keys (the
    first column of ``by``) of more rows than a shuffled partition's share the range of the other
    columns. Rows that are equal in ``by`` share a part."""
    n, tasks = df.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = df.select(F.col(by[0]).alias("__hot"), F.struct(*by[1:]).alias("o"))
    picked = some.sample(SAMPLE / n, 7) if n > SAMPLE else some
    step = max(1, min(n, SAMPLE) // (2 * tasks))  # rows of the sample that make a part
    number = F.row_number().over(Window.partitionBy("__hot").orderBy("o"))
    hot = picked.groupBy("__hot").agg(F.count("*").alias("n")).where(F.col("n") > 2 * step).select(F.col("__hot").alias("__of"))
    ends = picked.join(F.broadcast(hot), F.col("__hot").eqNullSafe(F.col("__of"))).withColumn("n", number).where(F.col("n") % step == 0)
    cuts = written(ends.groupBy("__hot").agg(F.sort_array(F.collect_set("o")).alias("__cuts")), scratch(df.sparkSession, "cuts"))
    if cuts.isEmpty():
        return df.withColumn("__part", F.lit(None).cast("int"))
    met = df.join(F.broadcast(cuts), F.col(by[0]).eqNullSafe(F.col("__hot")), "left")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range((8 * tasks).bit_length()))])  # halving: a key has fewer cuts than that
    below = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get("__cuts", at + step - 1) < F.struct(*by[1:]), step).otherwise(0))
    part = F.when(F.col("__cuts").isNotNull(), below)
    return met.select(*df.columns, part.alias("__part"))


def parts(df: DataFrame, by: list[str]) -> DataFrame:
    """The rows, written, with the number of the part as in ``sliced``."""
    return sliced(written(df, scratch(df.sparkSession, "parts")), by)


def _carried(parted: DataFrame, key: list[str], ends: list[Column], carry: dict[str, Column]) -> DataFrame:
    """(part, key, carried values) of the parts to which an earlier one carries something."""
    lasts = parted.where("__part is not null").groupBy("__part", *key).agg(*ends)
    carried = lasts.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], *[v.alias(f"__c_{n}") for n, v in carry.items()])
    return carried.where(reduce(lambda a, b: a | b, [F.col(f"__c_{n}").isNotNull() for n in carry]))


def _met(marked: DataFrame, carried: DataFrame, key: list[str]) -> DataFrame:
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key)]
    return marked.join(F.broadcast(carried), reduce(lambda a, b: a & b, [F.col("__part") == F.col("__p"), *same]), "left")


def previous(df: DataFrame, key: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """The rows with, for each of ``values``, the last one that isn't null before the row in its key.
    A value that may be null itself is wrapped in a struct. ``order`` has to be total; nulls come first."""
    out = previous_in(parts(df.withColumns({f"__v_{n}": v for n, v in values.items()}), [*key, *order]), key, order, list(values))
    return out.select(*df.columns, *values)


def previous_in(parted: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """``previous`` over parted rows, of the columns ``__v_`` and a value's name."""
    before = Window.partitionBy("__part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ends = [F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.struct(*order))).alias(f"__v_{n}") for n in values]
    carried = _carried(parted, key, ends, {n: F.last(f"__v_{n}", True).over(earlier) for n in values})
    marked = parted.withColumns({f"__l_{n}": F.last(f"__v_{n}", True).over(before) for n in values})
    return _met(marked, carried, key).withColumns({n: F.coalesce(f"__l_{n}", f"__c_{n}") for n in values})


def running_sum(df: DataFrame, key: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """The rows with the sums of ``values`` over the rows of their key up to and with them."""
    parted = parts(df.withColumns({f"__v_{n}": v.cast("long") for n, v in values.items()}), [*key, *order])
    upto = Window.partitionBy("__part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ends = [F.sum(f"__v_{n}").alias(f"__v_{n}") for n in values]
    carried = _carried(parted, key, ends, {n: F.sum(f"__v_{n}").over(earlier) for n in values})
    marked = parted.withColumns({f"__l_{n}": F.sum(f"__v_{n}").over(upto) for n in values})
    out = _met(marked, carried, key).withColumns({n: F.col(f"__l_{n}") + F.coalesce(f"__c_{n}", F.lit(0)) for n in values})
    return out.select(*df.columns, *values)


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str], ties: list[str] = ()) -> DataFrame:
    """The rows of ``left`` with the ``values`` of the last row of ``right`` of the same key at or
    before their time, null where there is none. Both have ``key`` and ``at``; ``ties`` orders rows
    of ``right`` of one time. One union and one sorted pass; no row of ``left`` is compared with
    another's. Rows of ``left`` without key or time have no values."""
    own = [c for c in left.columns if c not in (key, at)]
    kind = lambda df, c: df.schema[c].dataType
    none = lambda df, c: F.lit(None).cast(kind(df, c))
    probes = left.select(F.col(key), F.col(at), F.lit(1).alias("__side"), *[none(right, c).alias(f"__tie_{c}") for c in ties], F.struct(*[F.col(c) for c in own] or [F.lit(0).alias("__none")]).alias("__left"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__right"))
    known = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).cast(kind(left, key)).alias(key), F.col(at).cast(kind(left, at)).alias(at), F.lit(0).alias("__side"), *[F.col(c).alias(f"__tie_{c}") for c in ties], F.lit(None).cast(probes.schema["__left"].dataType).alias("__left"), F.struct(*values).alias("__right"))
    both = known.unionByName(probes)
    met = previous(both, [key], [at, "__side", *[f"__tie_{c}" for c in ties]], {"__found": F.col("__right")}).where("__side = 1")
    given = F.when(F.col(key).isNotNull() & F.col(at).isNotNull(), F.col("__found"))
    return met.select(key, at, *[F.col(f"__left.{c}").alias(c) for c in own], *[given[c].alias(c) for c in values])
