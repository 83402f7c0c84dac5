"""Operator 10: one-permutation MinHash fingerprints, in DataFrame functions only.

A text's 5-word shingles (lower case, white-space separated words; fewer words: the whole
sequence) are hashed once. The top bits of a hash pick one of 128 bins, the least hash of a
bin stands for it. An empty bin takes the value of the first non-empty one on its own
random sequence of 64 bins (optimal densification), the same sequence for every text; should all
of those be empty, that of the first non-empty bin. Of each
bin the low 4 bits are stored, packed 16 to a long, and shown as one hex digit a bin.
Likeness corrects for bins that agree by chance: (share - 1/16) / (1 - 1/16), within 0 to 1.

A text without words has the empty fingerprint; two of those are alike (1), one of them and
any other text are not (0). Null text counts as empty.

The next document is the next row by (doc_id, hash of the text), null ids first; after the
last comes the first. Ids are dealt into ranges of about equal size, so a window never spans
more than one range; the first text of each range is joined to the range before.
"""

from __future__ import annotations

import json
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table

BINS = 128
SHIFT = 57  # 64 - log2(BINS)
LOW = 4
SHINGLE = 5
PROBES = 8
MORE_PROBES = 56


def _let(value: Column, body) -> Column:
    """body(value), with value computed once even where body has it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), "[ \t\n\x0b\x0c\r]+"), "")
    from_here = lambda w: F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, SHINGLE)]))
    return _let(
        words,
        lambda w: F.when(F.size(w) >= SHINGLE, F.slice(from_here(w), F.lit(1), F.size(w) - (SHINGLE - 1)))
        .when(F.size(w) > 0, F.slice(from_here(w), 1, 1))  # hashing passes over the nulls beyond the end
        .otherwise(F.array().cast("array<bigint>")),
    )


def bin_minima(hashes: Column) -> Column:
    """The least hash of each bin that has one, in the order of bins."""
    bin_of = lambda h: F.shiftright(h, SHIFT)
    return _let(F.sort_array(hashes), lambda s: F.filter(s, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(s, i - 1)))))


def _probe_sequences() -> list[list[int]]:
    rng = random.Random(42)
    return [[rng.randrange(BINS) for _ in range(PROBES + MORE_PROBES)] for _ in range(BINS)]


def densified(minima: Column) -> Column:
    """A value for each bin; an empty array if no bin has one."""
    sparse = lambda m: F.map_from_arrays(F.transform(m, lambda h: (F.shiftright(h, SHIFT) + BINS // 2).cast("int")), m)

    sequences = F.from_json(F.lit(json.dumps(_probe_sequences())), "array<array<int>>")  # a constant

    def probe(d: Column, bins: Column) -> Column:
        return F.get(F.array_compact(F.transform(bins, lambda j: F.get(d, j))), F.lit(0))

    def fill(d: Column) -> Column:
        own = lambda b: F.get(sequences, b)
        return F.transform(d, lambda v, b: F.coalesce(v, probe(d, F.slice(own(b), 1, PROBES)), probe(d, F.slice(own(b), PROBES + 1, MORE_PROBES)), F.get(F.array_compact(d), F.lit(0))))

    dense = lambda m: _let(_let(sparse(m), lambda at: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.try_element_at(at, b))), fill)
    return _let(minima, lambda m: F.when(F.size(m) > 0, dense(m)).otherwise(F.array().cast("array<bigint>")))


def packed(values: Column) -> Column:
    """Low-order bits of the bins, 16 bins to a long."""
    per_long = 64 // LOW
    word = lambda v, k: F.aggregate(F.slice(v, k * per_long + 1, per_long), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, LOW).bitwiseOR(x.bitwiseAND(F.lit((1 << LOW) - 1))))
    return _let(values, lambda v: F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), F.lit(BINS // per_long - 1)), lambda k: word(v, k))).otherwise(v))


def fingerprint(text: Column) -> Column:
    return packed(densified(bin_minima(shingle_hashes(text))))


def hexadecimal(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles of two fingerprints, corrected for chance agreement."""

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))

    apart = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    chance = 1 / (1 << LOW)
    estimate = (1 - apart / BINS - chance) / (1 - chance)
    both, none = (F.size(a) > 0) & (F.size(b) > 0), (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(both, F.greatest(F.lit(0.0), estimate)).when(none, F.lit(1.0)).otherwise(F.lit(0.0))


def _ranges(docs: DataFrame, rows_per_range: int, most: int):
    """(range of a doc_id, as a Column function). At most ``most`` bounds reach the driver."""
    rows = docs.agg(F.count("doc_id")).first()[0]
    n = min(most, rows // rows_per_range + 1)
    if n == 1:
        return lambda doc_id: F.lit(0)
    bounds = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0]
    bounds = sorted(set(bounds))
    step = int(len(bounds) ** 0.5) + 1  # two short look-ups rather than one long one
    coarse = F.array(*[F.lit(b) for b in bounds[step - 1 :: step]]) if len(bounds) >= step else F.array().cast("array<bigint>")
    fine = F.array(*[F.array(*[F.lit(b) for b in bounds[a : a + step]]) for a in range(0, len(bounds), step)])
    below = lambda values, x: F.size(F.filter(values, lambda b: b <= x))

    def of(doc_id: Column) -> Column:
        at = below(coarse, doc_id)
        return F.when(doc_id.isNull(), F.lit(0)).otherwise(at * step + F.coalesce(below(F.get(fine, at), doc_id), F.lit(0)))

    return of


def with_next(docs: DataFrame, rows_per_range: int = 2000, most_ranges: int = 20_000) -> DataFrame:
    """(doc_id, text, h, range, lead, head): lead is the next text within the range; on the last
    row of a range lead is null and head is the first text of the next range."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("range", _ranges(docs, rows_per_range, most_ranges)(F.col("doc_id"))).withColumn("h", F.xxhash64("text"))
    first = rows.groupBy("range").agg(F.min("doc_id").alias("first_id"), (F.count("*") > F.count("doc_id")).alias("nulls")).collect()  # at most most_ranges rows
    spark = docs.sparkSession
    order = sorted((r["range"], None if r["nulls"] else r["first_id"]) for r in first)
    table = [(k, i, order[at - 1][0]) for at, (k, i) in enumerate(order)]
    heads = F.broadcast(spark.createDataFrame(table, "k int, first_id long, before int"))
    head = rows.join(heads, (F.col("range") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    head = head.groupBy("before").agg(F.min_by("text", "h").alias("first_text")).withColumnRenamed("before", "range")
    w = Window.partitionBy("range").orderBy("doc_id", "h")
    out = rows.withColumn("lead", F.lead("text").over(w)).join(head, "range", "left")
    return out.withColumn("head", F.when(F.col("lead").isNull(), F.col("first_text"))).drop("first_text")


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(read_table(spark, sf_dir, "documents"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("lead", "head"), F.lit(1), half))
    rows = rows.select("doc_id", "h", "range", "head", n.cast("long").alias("n_chars"), edited.alias("edited"), fingerprint(F.col("text")).alias("fp"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).withColumn("edited_fp", fingerprint(F.col("edited"))).drop("edited")
    following = F.lead("fp").over(Window.partitionBy("range").orderBy("doc_id", "h"))
    rows = rows.withColumn("lead_fp", following)
    next_fp = F.coalesce("lead_fp", fingerprint(F.col("head")))
    rows = rows.withColumn("near_next", _let(next_fp, lambda b: likeness(F.col("fp"), b)))
    return rows.select("doc_id", "n_chars", "edited_sha256", hexadecimal(F.col("fp")).alias("fingerprint"), hexadecimal(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), "near_next")
