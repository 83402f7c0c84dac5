"""Operator 5: BPE encoding and decoding through a table of distinct words.

One plan at every size:

1. Texts are split into units and the distinct units are counted (``distinct_units``).
2. The table holds the most frequent units, as many as fit ``table_bytes``, whatever the size
   of the corpus (``frequent``). Each is encoded once by the tokenizers library, and its ids are
   decoded by a join with the id-to-piece table (``word_table``).
3. The table is broadcast, and ids are joined back by position where the texts are
   (``encode_decode``), so no text is shuffled and no unit is a hot key. A unit that the table
   can't hold is encoded where it stands, once a task. Equal texts are done once a task.

The other way, a join of every rare unit with a table of all units, was built and measured;
the README has its figures.

A unit is a run of letters or of marks of a white-space separated chunk, if the chunk has
plain characters only (``_LETTERS``, ``_MARKS``); any other chunk is a unit whole. The
tokenizer drops white space and splits plain chunks at just these places, so the ids of a
text are those of its units in order.

Null text counts as empty: no tokens, digests of the empty string. Equal texts and repeated
rows have equal results, a row each. An empty table gives no rows. A long text without white
space, letters only, is one unit: it takes memory in proportion to itself, and isn't
remembered. A kept column with the name of a result goes; the result stays.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, kept, materialize, read_table
from .token_counts import load

#: A unit of more characters is neither counted for the table nor remembered.
LONG = 256
#: Words beyond the table that a task remembers at most.
REMEMBER = 60_000
#: Distinct units that a task counts before it passes them on.
COUNTED = 150_000
#: Texts whose results a task remembers at most, 300 bytes each.
REMEMBER_TEXTS = 20_000
#: Latin, Cyrillic, kana, Han and Hangul letters that stay as they are under the tokenizer's normaliser, but for case.
_LETTERS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0400-\u045f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_MARKS = r'.,;:!?"()\[\]#&%*$+=@/_\-\u3001\u3002\u300c\u300d\uff01\uff08\uff09\uff0c\uff1a\uff1b\uff1f'
_RUN = re.compile(f"[{_MARKS}]+")
#: Any other character makes its chunk odd; what follows in the chunk.
_ODD, _REST = re.compile(rf"[^\s{_LETTERS}{_MARKS}]"), re.compile(r"\S*")
#: str.split() also splits at these four, which are no white space to the tokenizer.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
RESULTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def units(text: str) -> list[str]:
    """A text's units in order. Plain stretches are cut at once, other chunks are units whole."""
    if _SEPARATORS.search(text):
        return [u for c in _SPACE.split(text) for u in units(c) if u] if _SPACE.search(text) else [text]
    out, last, odd = [], 0, _ODD.search(text)
    while odd:
        begin, end = odd.start(), _REST.match(text, odd.end()).end()
        while begin > last and not text[begin - 1].isspace():
            begin -= 1
        out += _plain(text[last:begin])
        out.append(text[begin:end])
        last, odd = end, _ODD.search(text, end)
    return out + _plain(text[last:]) if last else _plain(text)


def _plain(text: str) -> list[str]:
    """The runs of letters and of marks of a stretch without odd characters, in lower case."""
    return _RUN.sub(r" \g<0> ", text.lower()).split()


def distinct_units(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): every distinct unit of all texts and how often it occurs; units of over LONG characters have no part in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            words = [w for w in seen if len(w) <= LONG]
            for a in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_pydict({"word": words[a : a + 50_000], "n": [seen[w] for w in words[a : a + 50_000]]})
            seen.clear()

        for whole in batches:
            for batch in blocks(whole, "__text"):
                for t in batch.column("__text").to_pylist():
                    seen.update(units(t))
                if len(seen) > COUNTED:
                    yield from out()
        yield from out()

    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("__text")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


@lru_cache(maxsize=2)
def pieces_of(path: str) -> list[str]:
    """Piece by id: what ``decode`` puts for it, before pieces are joined by a space."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    table = {i: p for p, i in t["model"]["vocab"].items()} | {a["id"]: a["content"] for a in t["added_tokens"]}
    return [table.get(i, "") for i in range(max(table) + 1)]


def frequent(words: DataFrame, table_bytes: int) -> DataFrame:
    """The rows of (word, n) with the highest n, down to the n from which they fit ``table_bytes``
    as a worker holds them. A word has at most an id a byte, of at most five digits."""
    ranked = words.withColumn("level", F.floor(F.log2("n") * 8).cast("int"))  # at most some hundred levels
    sizes = ranked.groupBy("level").agg(F.sum(F.octet_length("word") * 9 + 200).alias("size"))
    least, total = None, 0
    for r in sizes.orderBy(F.desc("level")).collect():
        if (total := total + r["size"]) > table_bytes:
            break
        least = r["level"]
    return ranked.where(F.col("level") >= F.lit(least).cast("int")).drop("level")


def word_table(words: DataFrame, path: str) -> DataFrame:
    """(word, coded, plain): each word's ids from one call of the library, joined by a space, and
    its decoded text, by a join of its ids with the id-to-piece table (as large as the vocabulary,
    so it is broadcast)."""

    @F.arrow_udf("array<int>")
    def encode(word: pa.Array) -> pa.Array:
        return pa.array(encoded(path, word.to_pylist()), pa.list_(pa.int32()))

    pieces = words.sparkSession.createDataFrame(list(enumerate(pieces_of(path))), "id int, piece string")
    placed = words.withColumn("ids", encode("word")).select("word", F.posexplode_outer("ids").alias("at", "id"))
    entry = F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("at", "id", "piece"))))
    rows = placed.join(F.broadcast(pieces), "id", "left").groupBy("word").agg(entry.alias("ids"))
    return rows.select("word", F.array_join(F.transform("ids", lambda e: e["id"].cast("string")), " ").alias("coded"), F.array_join("ids.piece", " ").alias("plain"))


def encoded(path: str, words: list[str]) -> list[list[int]]:
    tokenizer, ids = load(path), []
    for a in range(0, len(words), 4096):
        ids += [e.ids for e in tokenizer.encode_batch(words[a : a + 4096], add_special_tokens=False)]
    return ids


class Codec:
    """Results of texts from a table of ids and decoded texts by word, and from the library for other words."""

    def __init__(self, path: str, coded: dict[str, str], plain: dict[str, str]):
        self.path, self.pieces = path, pieces_of(path)
        self.coded, self.plain = dict(coded), dict(plain)
        self.most = len(coded) + REMEMBER
        self.silent = {w for w, c in self.coded.items() if not c}
        self.texts: dict[bytes, tuple[int, str, str]] = {}

    def learn(self, new: list[str]) -> None:
        for u, ids in zip(new, encoded(self.path, new), strict=True):
            self.coded[u] = " ".join(map(str, ids))
            self.plain[u] = " ".join([self.pieces[i] for i in ids])

    def forget(self, new: list[str]) -> None:
        """Of the words that the table lacks those that a task meets first stay, the frequent ones among them."""
        spare = self.most - (len(self.coded) - len(new))
        for u in new:
            if spare <= 0 or len(u) > LONG:
                del self.coded[u], self.plain[u]
            else:
                spare -= 1

    def results(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(n_tokens, ids_sha256, decoded_sha256) of each text."""
        keys = [hashlib.md5(t.encode(), usedforsecurity=False).digest() for t in texts]
        if len(self.texts) > REMEMBER_TEXTS:
            self.texts.clear()
        todo = {k: units(t) for k, t in zip(keys, texts, strict=True) if k not in self.texts}
        new = list(set().union(*todo.values()) - self.coded.keys())
        self.learn(new)
        coded, plain = self.coded.__getitem__, self.plain.__getitem__
        silent = {u for u in new if not self.coded[u]} | self.silent  # without any token
        for k, us in todo.items():
            if silent and not silent.isdisjoint(us):
                us = [u for u in us if u not in silent]
            ids = " ".join(map(coded, us))
            self.texts[k] = (ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(" ".join(map(plain, us)).encode()).hexdigest())
        self.forget(new)
        self.silent = {u for u in silent if u in self.coded}
        return [self.texts[k] for k in keys]


def encode_decode(docs: DataFrame, path: str, keep: list[str], text: str = "text", table_bytes: int = 64 << 20) -> DataFrame:
    """Columns ``keep`` of docs with n_tokens, ids_sha256 and decoded_sha256. ``table_bytes``
    bounds what is broadcast; it doesn't change results."""
    keep = kept(keep, RESULTS)
    words = materialize(distinct_units(docs, text), "bpe-words")
    t = word_table(frequent(words, table_bytes), path).toArrow()
    word = t["word"].to_pylist()
    table = docs.sparkSession.sparkContext.broadcast((dict(zip(word, t["coded"].to_pylist(), strict=True)), dict(zip(word, t["plain"].to_pylist(), strict=True))))
    rows = docs.select(*keep, F.coalesce(text, F.lit("")).alias("__text"))
    schema = rows.select(*keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, *table.value)
        for whole in batches:
            for batch in blocks(whole, "__text", 1 << 19):
                n, coded, plain = zip(*codec.results(batch.column("__text").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())], names=schema.names)

    return rows.mapInArrow(assemble, schema)


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])
