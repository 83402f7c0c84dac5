"""Helpers that the training-data operators share.

Nothing here depends on the machine: intermediate tables go to the folder that the
session names in ``spark.checkpoint.dir`` and are read back through Spark.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a numpy kernel takes at once; bounds a Python worker's memory.
BLOCK_BYTES = 2 << 20


#: Bytes of a batch of rows that goes to a Python worker; ten thousand long texts would not fit one.
ARROW_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bound on batches to ARROW_BATCH where it is Spark's default of 64 MB or more; one that was set in other units stays."""
    key, most = ARROW_BATCH
    held = spark.conf.get(key).lower().removesuffix("b")
    if held in ("", "-1", "64m") or (held.isdigit() and int(held) > most):
        spark.conf.set(key, str(most))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that ``workspace`` has given out and ``discard`` has not removed.
_given: list[str] = []


def workspace(spark: SparkSession, label: str) -> str:
    """A new folder name that the driver and all executors see. Without a shared folder, only a
    session on one machine gets one, which goes with the process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_root()
    _given.append(f"{root}/{label}-{uuid.uuid4().hex}")
    return _given[-1]


@lru_cache(maxsize=1)
def _local_root() -> str:
    root = tempfile.mkdtemp(prefix="spark-checkpoint-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


@contextmanager
def discarding(spark: SparkSession) -> Iterator[None]:
    """Removes the folders that were given out within, once they aren't read any more."""
    before = len(_given)
    try:
        yield
    finally:
        discard(spark, _given[before:])


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove folders that ``workspace`` has given out."""
    for path in list(paths):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _given.remove(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    bounded_batches(df.sparkSession)
    path = workspace(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(keep: list[str], results: tuple[str, ...] | list[str]) -> list[str]:
    """The columns to keep, each once. One with the name of a result goes: the operator's own column stays."""
    return [c for c in dict.fromkeys(keep) if c not in results]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (bytes, offsets); null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``most`` bytes; a longer text makes a run of its own."""
    if not batch.num_rows:
        return
    lengths = np.asarray(pc.binary_length(batch.column(column).fill_null("")), np.int64)
    part = (np.cumsum(lengths) - lengths) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


class Words:
    """The words of a block of texts: maximal runs of bytes that ``is_word`` marks.

    ``start`` and ``end`` are byte positions in the block, ``doc`` the row, ``first`` the
    index of each row's first word (one more entry than rows), ``hash`` a 64-bit
    polynomial hash of the word's bytes after ``fold`` (a 256-entry byte map). A word also
    ends before the bytes at ``cuts``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, fold: np.ndarray, cuts: np.ndarray | None = None):
        self.data, self.offsets = data, offsets
        mark = inside.astype(np.int8)
        step = np.diff(mark, prepend=np.int8(0))
        edges = offsets[1:-1][offsets[1:-1] < len(data)]
        begins = step == 1
        begins[edges] |= inside[edges]  # a word never spans two rows
        if cuts is not None:
            begins[cuts] |= inside[cuts]
        self.start = np.flatnonzero(begins)
        word_bytes = np.flatnonzero(inside)
        if len(self.start):
            at = np.searchsorted(word_bytes, self.start)
            size = np.diff(np.append(at, len(word_bytes)))
            self.end = self.start + size
            place = np.arange(len(word_bytes)) - np.repeat(at, size)
            powers = _powers(int(size.max()))
            self.hash = np.add.reduceat((fold[data[word_bytes]].astype(np.uint64) + np.uint64(1)) * powers[place], at)
        else:
            self.end = self.start
            self.hash = np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


_POWER = np.uint64(0x9E3779B97F4A7C15)
_cache = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _cache
    if len(_cache) < n:
        factors = np.full(max(n, 256), _POWER, np.uint64)
        factors[0] = 1
        _cache = np.multiply.accumulate(factors)
    return _cache


def word_hash(word: bytes) -> int:
    """The hash that ``Words`` gives a (folded) word."""
    b = np.frombuffer(word, np.uint8).astype(np.uint64) + np.uint64(1)
    return int(np.add.reduce(b * _powers(len(b))[: len(b)]))


def ascii_lower() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold
