"""Operator 8: quality scores by regularised quadratic discriminant analysis.

Every text becomes a vector of transformed statistics (``FEATURES``), computed over the
whole text. Class means and covariances come from sums over all labelled training rows
(one row a class reaches the driver). Each covariance is shrunk towards the pooled one and
its diagonal; its Cholesky factor is kept, and the score is the logistic of the
difference of the two log densities and log priors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, ascii_lower, blocks, kept, materialize, read_table, utf8

FEATURES = ["words", "word_length", "stops", "shouts", "symbols", "bars", "digits", "upper", "foreign", "distinct", "top_word", "repeats", "lines", "same_lines"]
# The byte classes counted, from 1.
CLASSES = [b".,;:'\"-()", b"!?", b"#$%&*@^~", b"|<>{}[]\\/=+_`", b"0123456789", bytes(range(65, 91)), bytes(range(128, 256))]


def _class_table() -> np.ndarray:
    table = np.zeros(256, np.int64)
    for i, own in enumerate(CLASSES, 1):
        table[list(own)] = i
    return table


def _spread(h: np.ndarray) -> np.ndarray:
    """Hashes whose high bits tell short words apart too."""
    return h * np.uint64(0x9E3779B97F4A7C15)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a block."""
    n, kinds, table = len(offsets) - 1, len(CLASSES) + 1, _class_table()
    size = np.diff(offsets)
    counts = np.bincount(np.repeat(np.arange(n) * kinds, size) + table[data], minlength=n * kinds).reshape(n, kinds)
    inside = np.isin(table, (0, 5, 6, 7)) & (np.arange(256) > 32)
    w = Words(data, offsets, inside[data], ascii_lower())
    words = np.diff(w.first)
    some, many = np.maximum(words, 1), np.maximum(size, 1)
    key = np.sort(w.doc.astype(np.uint64) << np.uint64(40) | _spread(w.hash) >> np.uint64(24))
    begin = np.flatnonzero(np.diff(key, prepend=np.uint64(0)) | (np.arange(len(key)) == 0)) if len(key) else np.zeros(0, np.int64)
    owner = (key[begin] >> np.uint64(40)).astype(np.int64)
    run = np.diff(np.append(begin, len(key)))
    distinct = np.bincount(owner, minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner, run)
    again = np.bincount(w.doc[1:][(w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])], minlength=n) if len(key) else np.zeros(n)
    feeds = np.cumsum(data == 10)
    line = feeds[w.start] + w.doc if len(key) else np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(line, prepend=-1))
    lines = np.bincount(w.doc[first], minlength=n) if len(key) else np.zeros(n, np.int64)
    if len(key):
        mark = np.add.reduceat(_spread(w.hash) * (w.hash >> np.uint64(7) | np.uint64(1)), first)
        kinds_of_line = np.unique(w.doc[first].astype(np.uint64) << np.uint64(40) | mark >> np.uint64(24))
        fresh = np.bincount((kinds_of_line >> np.uint64(40)).astype(np.int64), minlength=n)
    else:
        fresh = lines
    share = np.log1p(1000 * counts[:, 1:] / many[:, None])
    return np.column_stack(
        [
            np.log1p(words), np.log1p(size / some), share,
            np.log((distinct + 1) / (words + 1)), np.log1p(100 * top / some), np.log1p(100 * again / some),
            np.log1p(size / np.maximum(lines, 1)), np.log1p(100 * (lines - fresh) / np.maximum(lines, 1)),
        ]
    )


def features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and x, the statistics of the whole text. Null text counts as empty; texts of
    any length are taken whole; repeated rows have theirs each, an empty table has none. A kept
    column called x goes."""
    keep = kept(keep, ["x"])
    rows = docs.select(*keep, F.coalesce(text, F.lit("")).alias("__text"))
    schema = rows.select(*keep).schema.add("x", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "__text"):
                x = statistics(*utf8(batch.column("__text")))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), flat], names=schema.names)

    return rows.mapInArrow(run, schema)


@dataclass
class Model:
    """By class (0, 1): mean, Cholesky factor of the covariance, log prior less half its log
    determinant. The factors' inverses, triangular too, are made once and kept."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def __post_init__(self):
        self.whiteners = np.array([np.tril(np.linalg.inv(f)) for f in self.factors])

    def score(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for m, f, o in zip(self.means, self.whiteners, self.offsets, strict=True):
            y = (x - m) @ f.T
            logs.append(o - 0.5 * (y * y).sum(1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def train(labelled: DataFrame, pooled_share: float = 0.1, floor: float = 1e-3) -> Model | float:
    """Fit on rows of (x, label 0 or 1). With one class only: that class's share, as every text's score; with none: 0.5."""
    p = len(FEATURES)
    x = [F.get("x", F.lit(i)) for i in range(p)]
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)] + [F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i in range(p) for j in range(i + 1)]
    got = {r["label"]: r for r in labelled.where("label in (0, 1)").groupBy("label").agg(F.count("*").alias("n"), *sums).collect()}
    if len(got) < 2:
        return float(next(iter(got))) if got else 0.5
    n, means, spread = [], [], []
    for c in (0, 1):
        r = got[c]
        m = np.array([r[f"s{i}"] for i in range(p)]) / r["n"]
        q = np.zeros((p, p))
        for i in range(p):
            for j in range(i + 1):
                q[i, j] = q[j, i] = r[f"q{i}_{j}"] / r["n"]
        n.append(r["n"])
        means.append(m)
        spread.append(q - np.outer(m, m))
    share = np.array(n) / sum(n)
    pooled = share[0] * spread[0] + share[1] * spread[1]
    factors, offsets = [], []
    for c in (0, 1):
        s = (1 - pooled_share) * spread[c] + pooled_share * pooled + np.diag(0.02 * np.diag(pooled) + floor)
        f = np.linalg.cholesky(s)
        factors.append(f)
        offsets.append(np.log(share[c]) - np.log(np.diag(f)).sum())
    return Model(np.array(means), np.array(factors), np.array(offsets))


def score(rows: DataFrame, model: Model | float, keep: list[str], threshold: float = 0.3) -> DataFrame:
    """Columns ``keep`` with score (0 to 1, higher: label 1 likelier) and predicted (1 from
    ``threshold`` on, ties included). Kept columns of these names go."""
    keep = kept(keep, ["score", "predicted"])
    schema = rows.select(*keep).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, len(FEATURES))
            s = model.score(x) if isinstance(model, Model) else np.full(batch.num_rows, model)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return rows.select(*keep, "x").mapInArrow(run, schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    rows = materialize(features(read_table(spark, sf_dir, "documents").withColumn("held_out", held), ["doc_id", "held_out"]), "features")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return score(rows, train(rows.where("not held_out").join(labels, "doc_id")), ["doc_id", "held_out"])
