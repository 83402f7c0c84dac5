"""Operator 6: SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits; two link if at most ``radius`` bits differ. Every bit position
gets a non-zero vector of radius + 1 bits, and every non-zero vector v makes a mask: the
positions whose vector has an odd product with v. Up to ``radius`` positions can't span
all vectors, so some v is orthogonal to those of any differing positions: its mask hides
all differences, and the pair meets in that table. No pair within the radius is missed.

Only distinct fingerprints are compared. A bucket of more than ``bucket_rows``
fingerprints is dealt out again by covering masks over the bits that its own mask hides;
after three such levels, at radius 4, a mask hides 8 bits at most, so at most 256 distinct
values share a bucket. Within a bucket only a spanning forest of the links is emitted,
never all pairs; components come from alternating large-star and small-star steps over
tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, kept, materialize, read_table

BITS = 64
SHINGLE = 4
SEED = 42


def fingerprint_of(text: bytes, xxh64=None) -> int:
    """The 64-bit fingerprint, unsigned; 0 for a text without words."""
    if xxh64 is None:
        from xxhash import xxh64_intdigest as xxh64
    words = text.lower().split()  # of bytes: A-Z only, and white space is 0x20 and 0x09-0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        hashes = [xxh64(joined, SEED)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        end = np.cumsum(size) - 1
        start = end - size + 1
        hashes = [xxh64(joined[a:b], SEED) for a, b in zip(start[: 1 - SHINGLE].tolist(), end[SHINGLE - 1 :].tolist(), strict=True)]
    h = np.array(hashes, "<u8")
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(h), 1 << 15):
        part = np.unpackbits(h[a : a + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(part, axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` with fp (the fingerprint as a signed long). Null text counts as empty."""
    rows = docs.select(*keep, F.coalesce(text, F.lit("")).alias("__text"))
    schema = rows.select(*keep).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for whole in batches:
            for batch in blocks(whole, "__text", 8 << 20):
                fp = [fingerprint_of(t, xxh64_intdigest) for t in batch.column("__text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.array(fp, np.uint64).view(np.int64))], names=schema.names)

    return rows.mapInArrow(run, schema)


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


@lru_cache(maxsize=None)
def spread_vectors(n: int, radius: int) -> tuple[int, ...]:
    """A vector for each of n positions, chosen one by one so that no mask shows much fewer positions
    than another: about half of them stay hidden under any mask, however few they are."""
    vectors = range(1, 1 << (radius + 1))
    shown = [0] * len(vectors)  # positions that the mask of each vector shows
    out = []
    for _ in range(n):
        best = max(vectors, key=lambda g: sorted(s + (g & v).bit_count() % 2 for s, v in zip(shown, vectors, strict=True)))
        shown = [s + (best & v).bit_count() % 2 for s, v in zip(shown, vectors, strict=True)]
        out.append(best)
    return tuple(out)


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """Masks over these bit positions such that any ``radius`` of them are hidden by one mask at least."""
    given = list(zip(positions, spread_vectors(len(positions), radius), strict=True))
    return [sum(1 << p for p, g in given if (g & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def spanning_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (larger, smaller of the component) that connect just what links within the radius connect."""
    n = len(fps)
    label = np.arange(n)
    near = []
    for a in range(0, n, 1024):
        x, y = np.nonzero(np.bitwise_count(fps[a : a + 1024, None] ^ fps[None, :]) <= radius)
        near.append(np.stack([x + a, y]))
    x, y = np.concatenate(near, axis=1)
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        new = new[new]
        if (new == label).all():
            break
        label = new
    order = np.argsort(fps.view(np.int64))
    least: dict[int, int] = {}
    for i in order.tolist():
        least.setdefault(int(label[i]), i)
    signed = fps.view(np.int64).tolist()
    return [(signed[i], signed[least[label[i]]]) for i in range(n) if least[label[i]] != i]


def _bucket_links(radius: int):
    """Over rows sorted by (bucket, key): links of each bucket. Buckets are bounded, so one is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None

        def links(fps):
            fps = np.unique(fps)
            if len(fps) == 2:
                a, b = fps.view(np.int64).tolist()
                return [(max(a, b), min(a, b))] if int(fps[0] ^ fps[1]).bit_count() <= radius else []
            return spanning_links(fps, radius) if len(fps) > 2 else []

        def packed(out):
            u, v = zip(*out, strict=True)
            return pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

        for batch in batches:
            out = []
            k, b, fp = (batch.column(c).to_numpy() for c in ("bucket", "key", "fp"))
            if not len(k):
                continue
            cuts = np.flatnonzero((k[1:] != k[:-1]) | (b[1:] != b[:-1])) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)], strict=True):
                if last != (k[a], b[a]):
                    if held:
                        out += links(np.concatenate(held).view(np.uint64))
                    held, last = [], (k[a], b[a])
                held.append(fp[a:z])
            if out:
                yield packed(out)
        if held and (out := links(np.concatenate(held).view(np.uint64))):
            yield packed(out)

    return run


def covering_links(fps: DataFrame, radius: int, bucket_rows: int = 2048) -> DataFrame:
    """(u, v), u > v: links between distinct fingerprints of column fp whose components are
    those of all links within the radius."""
    masks = covering_masks(list(range(BITS)), radius)
    found = []
    rows = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("bucket"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(masks)])).alias("t"))
    rows = rows.select("fp", F.col("t.bucket").cast("long").alias("bucket"), F.col("t.mask").alias("mask"))
    for level in (1, 2, 3):
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = materialize(rows.groupBy("bucket", "key").agg(F.count("*").alias("n")).where("n > 1"), f"buckets-{level}")
        some = sizes.where(F.lit(level == 3) | (F.col("n") <= bucket_rows))
        met = rows.join(some, ["bucket", "key"]).select("bucket", "key", "fp")
        parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        met = met.repartition(parts, "bucket", "key").sortWithinPartitions("bucket", "key")
        found.append(materialize(met.mapInArrow(_bucket_links(radius), "u long, v long").distinct(), f"links-{level}"))
        large = sizes.where(F.col("n") > bucket_rows)
        if level == 3 or large.isEmpty():
            break
        rows = rows.join(large.select("bucket", "key"), ["bucket", "key"])
        rows = materialize(_finer(rows, radius), f"finer-{level}")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def _finer(rows: DataFrame, radius: int) -> DataFrame:
    """Each row under every covering mask of the bits that its mask hides, beside those it shows."""
    hidden_masks = {}
    for (mask,) in rows.select("mask").distinct().collect():  # 31 at level 1, 31 * 31 at level 2
        hidden = [p for p in range(BITS) if not mask >> p & 1]
        hidden_masks[mask] = [_signed((mask | m) & ((1 << BITS) - 1)) for m in covering_masks(hidden, radius)]
    table = rows.sparkSession.createDataFrame([(m, i, f) for m, fs in hidden_masks.items() for i, f in enumerate(fs)], "mask long, i long, finer long")
    finer = rows.join(F.broadcast(table), "mask")
    return finer.select("fp", F.xxhash64("bucket", "key", "i").alias("bucket"), F.col("finer").alias("mask"))


def components(links: DataFrame) -> DataFrame:
    """(u, root): each end of a link and the least end of its component. Links have u > v."""

    def state(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now, before = links, None
    for turn in range(100):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        star = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = star.groupBy("u").agg(F.min("v").alias("m"))
        star = star.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(star.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"stars-{turn}")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select("u", F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, keep: list[str] | None = None, radius: int = 4, bucket_rows: int = 2048) -> DataFrame:
    """(doc_id, columns ``keep``, fp, component_id) a row of docs: component_id is the smallest doc_id that links
    reach, its own included. Null ids come last (a component of null ids only has a null id);
    repeated rows are linked like any others. Texts of any length are taken whole; an empty table has
    no rows. A kept column with the name of a result goes."""
    keep = kept(keep or [], ("doc_id", "fp", "component_id"))
    fps = materialize(fingerprints(docs, ["doc_id", *keep]), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(covering_links(distinct, radius, bucket_rows))
    rooted = distinct.join(roots, F.col("fp") == F.col("u"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    label = materialize(rooted.join(of_root, "root").select("fp", "component_id"), "components")
    return fps.join(label, "fp").select("doc_id", *keep, "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")
