"""Operator 1: language identification by prediction by partial matching (PPM).

Each language has a context tree over bytes, of orders 0 to 3. A context gives a byte it has
seen ``n / (total + distinct)`` and escapes with ``distinct / (total + distinct)`` (method C);
the escaped mass goes to the bytes it has not seen, in the proportions of the next shorter
context, down to a uniform order -1. The statistics are frozen after training, so a text's
exact code length under a language is a sum over its bytes of the entry of the longest
context that has seen the byte and of the escapes of the longer ones, found for all
positions at once in tables of the strings of four and three bytes (``Tree``).

Training takes at most ``per_language`` rows a language (chosen by hash) and of each at most
``span`` characters (from a place chosen by hash); these bounds are the only sampling. A tree
keeps every context of its sample, however many languages there are: some megabytes a
language. Prediction reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, kept, read_table, utf8

UNDETERMINED = "und"
RESULTS = ("lang_pred", "score", "bits_per_byte")
ORDER = 3
_MULTIPLIER, _EMPTY = np.uint32(2654435769), np.uint32(0xFFFFFFFF)  # no UTF-8 text has four bytes of 255


class HashTable:
    """Values by 32-bit key, found for many keys at once: open addressing, at most half full."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        self.shift = np.uint32(32 - max(4, int(2 * len(keys)).bit_length()))
        home = ((keys * _MULTIPLIER) >> self.shift).astype(np.int64)
        order = np.argsort(home, kind="stable")
        at = np.maximum.accumulate(home[order] - np.arange(len(keys))) + np.arange(len(keys)) if len(keys) else order
        size = (1 << (32 - int(self.shift))) + (max(0, int(at[-1]) - (1 << (32 - int(self.shift))) + 1) if len(keys) else 0) + 1
        self.keys = np.full(size, _EMPTY, np.uint32)
        self.keys[at] = keys[order]
        self.values = []
        for v in values:
            self.values.append(np.zeros(size, np.float32))
            self.values[-1][at] = v[order]

    def find(self, keys: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found) of each key; ``hashed`` is the key times the multiplier."""
        at = (hashed >> self.shift).astype(np.int32)
        held = self.keys[at]
        found = held == keys
        left = np.flatnonzero(~found & (held != _EMPTY))
        while len(left):
            at[left] += 1
            held = self.keys[at[left]]
            hit = held == keys[left]
            found[left[hit]] = True
            left = left[~hit & (held != _EMPTY)]
        return at, found


@dataclass
class Tree:
    """Bits by string of bytes. ``four`` and ``three`` have the cost of a string's last byte after
    the others, where that context has seen it; ``three`` also has the escape of the string as a
    context. Contexts of up to one byte have every byte (``two``, ``one``), those of two their
    escape (``pair``), 0 for a context that was never seen."""

    four: HashTable
    three: HashTable
    pair: np.ndarray
    two: np.ndarray
    one: np.ndarray


@dataclass
class Model:
    languages: list[str]
    trees: list[Tree]


def windows(data: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` bytes up to each position, as a number (fewer at the beginning)."""
    out = data.astype(np.uint32)
    for i in range(1, min(n, len(data))):
        out[i:] |= data[:-i].astype(np.uint32) << np.uint32(8 * i)
    return out


def build(texts: list[bytes]) -> Tree:
    """The tree of one language's sample."""
    strings, costs, escapes = [], [], []
    for k in range(ORDER + 1):
        seen = [windows(np.frombuffer(t, np.uint8), k + 1)[k:] for t in texts if len(t) > k]
        gram, n = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.uint32), return_counts=True)
        first = np.flatnonzero(np.diff(gram >> np.uint32(8), prepend=np.int64(-1))) if k else np.zeros(min(1, len(gram)), np.int64)
        total, kinds = np.add.reduceat(n, first) if len(gram) else n, np.diff(np.append(first, len(gram)))
        if k:
            shorter = costs[-1][np.searchsorted(strings[-1], gram & np.uint32((1 << 8 * k) - 1))]
            lower = np.exp2(-shorter)
        else:
            lower = np.full(len(gram), 1 / 256)
        left = np.maximum(1 - np.add.reduceat(lower, first), 1e-12) if len(gram) else total
        weight = np.where(kinds < 256, total + kinds, total)
        with np.errstate(divide="ignore"):
            escapes.append(np.where(kinds < 256, -np.log2(kinds / (weight * left)), 0.0))
        strings.append(gram)
        costs.append(-np.log2(n / np.repeat(weight, kinds)))
    one = np.full(256, 8.0)
    if len(strings[0]):
        one += escapes[0][0]
        one[strings[0]] = costs[0]
    two = np.tile(one, (256, 1))
    contexts = [np.unique(s >> np.uint32(8)) for s in strings]
    two[contexts[1]] += escapes[1][:, None]
    two.ravel()[strings[1]] = costs[1]
    pair = np.zeros(1 << 16)
    pair[contexts[2]] = escapes[2]
    keys = np.union1d(strings[2], contexts[3]).astype(np.uint32)
    cost, escape = np.full(len(keys), np.inf), np.zeros(len(keys))
    cost[np.searchsorted(keys, strings[2])] = costs[2]
    escape[np.searchsorted(keys, contexts[3])] = escapes[3]
    return Tree(HashTable(strings[3], costs[3]), HashTable(keys, cost, escape), pair.astype(np.float32), two.ravel().astype(np.float32), one.astype(np.float32))


def train(docs: DataFrame, per_language: int = 300, span: int = 30_000) -> Model | None:
    """Fit on rows of (text, lang); rows without text or lang are passed over, repeated texts count once. None: nothing to learn from."""
    usable = docs.select("text", "lang").where("lang is not null and octet_length(text) > 0")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.5 * per_language / n + 0.001))])
    usable = usable.withColumn("h", F.xxhash64("text", "lang"))
    near = usable.where(F.pmod(F.col("h"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    begin = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - span + 1, F.lit(1))).cast("int") + 1
    cut = near.select("lang", "h", F.substring("text", begin, F.lit(span)).alias("text")).dropDuplicates(["h"])
    few = cut.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= per_language)

    def fit(rows):
        import pickle

        import pandas as pd

        return pd.DataFrame({"lang": [rows.lang.iloc[0]], "tree": [pickle.dumps(build([t.encode() for t in rows.text]))]})

    import pickle

    fitted = sorted(few.groupBy("lang").applyInPandas(fit, "lang string, tree binary").collect())
    return Model([r["lang"] for r in fitted], [pickle.loads(r["tree"]) for r in fitted])


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text under each language."""
    out = np.zeros((len(offsets) - 1, len(model.trees)))
    for a in range(0, len(data), 1 << 18):
        lo, b = max(0, a - ORDER), min(len(data), a + (1 << 18))
        part = data[lo:b]
        place = np.arange(lo, b) - offsets[np.searchsorted(offsets, np.arange(lo, b), "right") - 1]  # within the text
        four, three = windows(part, 4), windows(part, 3)
        four_hashed, three_hashed, two = four * _MULTIPLIER, three * _MULTIPLIER, three & np.uint32(0xFFFF)
        cuts = np.unique(np.concatenate([[a], offsets[1:-1][(offsets[1:-1] > a) & (offsets[1:-1] < b)]]))
        rows = np.searchsorted(offsets, cuts, "right") - 1
        early = np.flatnonzero(place < ORDER)
        for j, tree in enumerate(model.trees):
            at, found = tree.four.find(four, four_hashed)
            bits = tree.four.values[0][at]
            found[early] = False
            rest = np.flatnonzero(~found)
            own, known = tree.three.find(three[rest], three_hashed[rest])
            cost = tree.three.values[0][own]
            known &= (cost < np.inf) & (place[rest] >= 2)
            before, seen = tree.three.find(three[rest - 1], three_hashed[rest - 1])
            escape = np.where(seen & (place[rest] >= 3), tree.three.values[1][before], 0)
            shorter = np.where(place[rest] >= 1, tree.two[two[rest]], tree.one[part[rest]]) + np.where(place[rest] >= 2, tree.pair[two[rest - 1]], 0)
            bits[rest] = escape + np.where(known, cost, shorter)
            out[rows, j] += np.add.reduceat(bits[a - lo :], cuts - a, dtype=np.float64)
    return out


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of docs with lang_pred, score (posterior of the language under equal
    priors, 0 to 1) and bits_per_byte. Null text or a text without a letter: ``und``, 0, null.
    Equal code lengths: the language that sorts first. Repeated rows have equal results, a row
    each; an empty table gives no rows. A kept column with the name of a result goes."""
    keep = kept(docs.columns if keep is None else keep, RESULTS)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    rows = docs.select(*keep, F.col("text").alias("__text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__letter"))
    schema = rows.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in blocks(whole, "__text"):
                n = batch.num_rows
                lang, best, rate = np.full(n, UNDETERMINED, object), np.zeros(n), np.full(n, np.nan)
                if m is not None:
                    data, offsets = utf8(batch.column("__text"))
                    bits = code_lengths(m, data, offsets)
                    low = bits.min(1, keepdims=True)
                    share = 1 / np.exp2(np.maximum(low - bits, -1000)).sum(1)
                    yes = np.asarray(batch.column("__letter").to_numpy(zero_copy_only=False), bool)
                    lang[yes] = np.array(m.languages, object)[bits.argmin(1)][yes]
                    best[yes] = share[yes]
                    rate[yes] = (low[:, 0] / np.maximum(np.diff(offsets), 1))[yes]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(best), pa.array(rate, from_pandas=True)], names=schema.names)

    return rows.mapInArrow(score, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rest = F.crc32(F.col("doc_id").cast("string")) % 4
    model = train(docs.where(rest != 2))
    held = docs.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "text")
    return identify(held, model, ["doc_id", "held_out"])
