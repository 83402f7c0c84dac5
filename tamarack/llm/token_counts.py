"""Operator 4: token counts without token lists.

Arrow functions take batches of texts and return lengths only. A text is cut at safe
boundaries, which no pre-token of the byte-level pattern reaches across: before a single space
between two characters that aren't white space, and, where that leaves a long piece, before
any white space that follows something else and between letters and marks of Chinese, Japanese
and Korean. So counts of the pieces add up to the count of the text. Equal short pieces of a
task are encoded once; pieces go to the library in batches of about ``batch_bytes`` bytes.

Null text counts as empty: 0 bytes, 0 tokens. Special strings in a text are tokens of their
own, as is the library's default. Repeated rows have equal results, a row each; an empty table
gives no rows. A piece without a safe boundary, of whatever length, is encoded whole, in memory
in proportion to it, and isn't remembered. A kept column with the name of a result goes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, kept, read_table

_SAFE = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"\s | \s|\A | \Z|\0")
#: A piece of more characters is cut at further boundaries and isn't remembered.
LONG = 256
_LETTERS, _MARKS = r"[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]", r"[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f]"
_FINE = re.compile(rf"(?<=[^\s\x1c-\x1f\x85])(?=[ \t\n\r])|(?<={_LETTERS})(?={_MARKS})|(?<={_MARKS})(?={_LETTERS})")
#: Piece counts that a task remembers at most; beyond that it starts anew.
REMEMBER = 300_000
RESULTS = ("n_bytes", "n_tokens", "over_limit")


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pieces(text: str) -> list[str]:
    """Cut a text at its safe boundaries; joined, the pieces are the text."""
    if _ODD.search(text):
        out, last = [], 0
        for m in _SAFE.finditer(text):
            out.append(text[last : m.start()])
            last = m.start()
        out.append(text[last:])
    else:
        out = text.replace(" ", "\0 ").split("\0")
    if len(text) > LONG and max(map(len, out)) > LONG:
        out = [q for p in out for q in (_FINE.split(p) if len(p) > LONG else [p])]
    return out


def _count_new(tokenizer, new: list[str], batch_bytes: int) -> dict[str, int]:
    """The counts of pieces, encoded in batches of pieces of about one length and of so many bytes."""
    made, batch, size = {}, [], 0
    for p in chain(sorted(new, key=len), [None]):
        n = 0 if p is None else (len(p) if p.isascii() else len(p.encode())) + 16
        if batch and (p is None or size + n > batch_bytes):
            made.update(zip(batch, map(len, tokenizer.encode_batch(batch, add_special_tokens=False)), strict=True))
            batch, size = [], 0
        if p is not None:
            batch.append(p)
            size += n
    return made


def count_tokens(docs: DataFrame, path: str, keep: list[str], text: str = "text", limit: int = 512, batch_bytes: int = 1 << 20) -> DataFrame:
    """Columns ``keep`` of docs with n_bytes (UTF-8), n_tokens and over_limit (more than
    ``limit`` tokens). ``path`` is that of a byte-level tokenizer without normaliser; it has to
    be readable on every machine."""
    keep = kept(keep, RESULTS)
    names = [*keep, *RESULTS]
    rows = docs.select(*keep, F.coalesce(text, F.lit("")).alias("__text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("__bytes"))
    schema = rows.select(*keep).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known = load(path), {}
        for whole in batches:
            for batch in blocks(whole, "__text"):
                cut = [pieces(t) if t else [] for t in batch.column("__text").to_pylist()]
                if len(known) > REMEMBER:
                    known.clear()
                made = _count_new(tokenizer, list(set(chain.from_iterable(cut)) - known.keys()), batch_bytes)
                long = {p: n for p, n in made.items() if len(p) > LONG}
                known.update(made)
                n = np.array([sum(map(known.__getitem__, c)) for c in cut], np.int64)
                for p in long:
                    del known[p]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), batch.column("__bytes"), pa.array(n), pa.array(n > limit)], names=names)

    return rows.mapInArrow(count, schema)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"])
