"""Prefix trie of conversations by van Emde Boas recursion.

A sequence is a binary string of fixed-width symbols, one a turn. The recursion works on problems,
a problem being the trie below one node (its context) down to some height. A round takes every
problem of height 2s at once: sequences are cut at s, equal cut prefixes are one row from then on
and are named by their smallest member, and what follows the cut goes into a problem of its own
below that name. So upper tries and lower forests are built side by side, and after log2(height)
rounds each problem is a single node. The way back grafts totals upward: what a lower forest sums
to is added to the cut node above it and to that node's ancestors in the upper trie, s at a time.

No group of conversations is gathered anywhere. A conversation itself is one row, of 24 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table

#: Bytes of a symbol: 16 of a digest of role and text, 8 of the text's length in bytes.
DIGEST, SYMBOL = 16, 24
#: Bytes of joined ids that are hashed at once.
PIECE = 1 << 20

ROWS = ["context", "above", "seq", "n", "least", "end"]
KEY = ["conv_id", "depth"]


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq) of each conversation that has an id: the symbols of its turns, in order of
    turn, null first; turns of one number are ordered by their digest. Null role or text is empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)), 256), 1, 2 * DIGEST)
    symbol = F.concat(digest, F.lpad(F.hex(F.octet_length(text).cast("long")), 2 * (SYMBOL - DIGEST), "0"))
    turns = conversations.where("conv_id is not null").select("conv_id", F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"), symbol.alias("c")).alias("t"))
    ordered = F.transform(F.array_sort(F.collect_list("t")), lambda t: t["c"])
    return turns.groupBy("conv_id").agg(F.unhex(F.array_join(ordered, "")).alias("seq"))


def turns_in(seq: Column | str) -> Column:
    return (F.octet_length(seq) / SYMBOL).cast("int")


def first_turns(seq: Column | str, n) -> Column:
    return F.substring(seq, F.lit(1), F.lit(SYMBOL) * n)


def after_turns(seq: Column | str, n) -> Column:
    return F.substring(seq, F.lit(SYMBOL) * n + 1, F.octet_length(seq))


def rebuilt(own: DataFrame) -> DataFrame:
    """(conv_id, seq) where each conversation c begins with the first crc32(c) % 9 turns of
    conversation c - c % 5 and goes on with its own turns after as many."""
    h = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    base = own.select(F.col("conv_id").alias("base_id"), F.col("seq").alias("base"))
    met = own.join(base, F.col("conv_id") - F.col("conv_id") % 5 == F.col("base_id"), "left")
    head = F.coalesce(first_turns("base", h), F.unhex(F.lit("")))
    return met.select("conv_id", F.concat(head, after_turns("seq", h)).alias("seq"))


def cut(rows: DataFrame, s: int) -> tuple[DataFrame, DataFrame]:
    """Rows of at least ``s`` turns, cut there: (named upper rows of s turns, lower rows in their contexts)."""
    # Written, so that both sides of the join below are dealt out by it alone and a hot prefix can be split.
    upper = rows.groupBy("context", "above", first_turns("seq", s).alias("seq")).agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max(F.when(turns_in("seq") == s, F.col("end"))).alias("end")
    )
    upper = materialize(upper.select(*ROWS), "trie-upper")
    names = upper.select(F.col("context").alias("__c"), F.col("above").alias("__a"), F.col("seq").alias("__s"), F.col("least").alias("__name"))
    deep = rows.where(turns_in("seq") > s)
    met = deep.join(names, (F.col("context") == F.col("__c")) & (F.col("above") == F.col("__a")) & (first_turns("seq", s) == F.col("__s")))
    lower = met.select(F.col("__name").alias("context"), (F.col("above") + s).alias("above"), after_turns("seq", s).alias("seq"), "n", "least", "end")
    return upper, materialize(lower, "trie-lower")


def build(rows: DataFrame, height: int) -> DataFrame:
    """The nodes of the trie of distinct sequences: (conv_id, depth, parent_conv_id, n_convs, bytes, end)."""
    waiting, s = [rows], 1
    while s < height:
        s *= 2
    while s > 1:
        s //= 2
        every = reduce(DataFrame.union, waiting)
        upper, lower = cut(every.where(turns_in("seq") >= s), s)
        waiting = [x.where(turns_in("seq") < s) for x in waiting] + [upper, lower]
    last = reduce(DataFrame.union, waiting)
    size = F.conv(F.hex(F.substring("seq", DIGEST + 1, SYMBOL - DIGEST)), 16, 10).cast("long")
    return last.select(F.col("least").alias("conv_id"), (F.col("above") + 1).alias("depth"), F.col("context").alias("parent_conv_id"), F.col("n").alias("n_convs"), size.alias("bytes"), "end")


def graft(nodes: DataFrame, height: int) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) summed over each node's subtree, from nodes' own values."""
    shares = [nodes.select(*KEY, "parent_conv_id", "n_leaves", "saved_tokens")]
    sums = [F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")]
    # The path of the s nodes that end at a node whose depth is a multiple of s, and what stands above it.
    paths = nodes.select(*KEY, F.array("conv_id").alias("path"), F.col("parent_conv_id").alias("context"))
    s = 1
    while s < height:
        tops = reduce(DataFrame.union, shares).where(F.col("depth") % (2 * s) == (s + 1) % (2 * s))
        forests = tops.groupBy(F.col("parent_conv_id").alias("__id"), (F.col("depth") - 1).alias("__depth")).agg(*sums)
        above = forests.join(paths, (F.col("__id") == F.col("conv_id")) & (F.col("__depth") == F.col("depth")))
        place = above.select("depth", "path", "context", "n_leaves", "saved_tokens", F.posexplode("path").alias("i", "conv_id"))
        parent = F.when(F.col("i") == 0, F.col("context")).otherwise(F.get("path", F.col("i") - 1))
        given = place.select("conv_id", (F.col("depth") - s + 1 + F.col("i")).alias("depth"), parent.alias("parent_conv_id"), "n_leaves", "saved_tokens")
        shares.append(materialize(given.groupBy(*KEY, "parent_conv_id").agg(*sums), "trie-shares"))
        if 2 * s < height:
            low = paths.where(F.col("depth") % (2 * s) == 0)
            high = paths.select(F.col("conv_id").alias("__id"), F.col("depth").alias("__depth"), F.col("path").alias("__path"), F.col("context").alias("__context"))
            met = low.join(high, (F.col("context") == F.col("__id")) & (F.col("depth") - s == F.col("__depth")))
            paths = materialize(met.select(*KEY, F.concat("__path", "path").alias("path"), F.col("__context").alias("context")), "trie-paths")
        s *= 2
    return reduce(DataFrame.union, shares).groupBy(*KEY).agg(*sums)


def _runs(end: pa.Array) -> list[tuple[int, int]]:
    values, starts = end.to_pylist(), [0]
    starts += [i for i in range(1, len(values)) if values[i] != values[i - 1]]
    return list(zip(starts, [*starts[1:], len(values)], strict=True))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (end, conv_id) to (end, first id, ids joined by commas) of at most about PIECE bytes."""
    held, first, parts, size, done = None, 0, [], 0, []

    def flush() -> None:
        if parts:
            done.append((held, first, ",".join(parts)))

    for batch in batches:
        end, ids = batch.column(0), batch.column(1)
        for a, b in _runs(end) if batch.num_rows else ():
            key, own = end[a].as_py(), ids.slice(a, b - a)
            if key != held or size > PIECE:
                flush()
                held, first, parts, size = key, own[0].as_py(), [], 0
            text = ",".join(map(str, own.to_pylist()))
            parts.append(text)
            size += len(text)
        if done:
            yield pa.RecordBatch.from_pylist([{"end": e, "first": f, "ids": t} for e, f, t in done], schema=_PIECES)
            done.clear()
    flush()
    if done:
        yield pa.RecordBatch.from_pylist([{"end": e, "first": f, "ids": t} for e, f, t in done], schema=_PIECES)


_PIECES = pa.schema([("end", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
_HASHES = pa.schema([("end", pa.binary()), ("ends_sha256", pa.string())])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one SHA-256 an end, read as a stream."""
    held, state, done = None, None, []
    for batch in batches:
        for end, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if end == held:
                state.update(b",")
            else:
                if state:
                    done.append({"end": held, "ends_sha256": state.hexdigest()})
                held, state = end, hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_HASHES)
            done = []
    if state:
        yield pa.RecordBatch.from_pylist([{"end": held, "ends_sha256": state.hexdigest()}], schema=_HASHES)


def end_hashes(members: DataFrame) -> DataFrame:
    """(end, ends_sha256) of (end, conv_id): the SHA-256 of each end's ids, ascending, joined by
    commas. Ids are joined where a range of them lies, so one end's may be spread over many tasks;
    only the joined pieces of an end go through one, as a stream, for a digest is of bytes in order."""
    pieces = members.select("end", "conv_id").repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id").mapInArrow(_pieces, "end binary, first long, ids string")
    return pieces.repartition("end").sortWithinPartitions("end", "first").mapInArrow(_hashes, "end binary, ends_sha256 string")


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """The trie of (conv_id, seq), an id once: a row a node with conv_id (its smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256. The root has depth 0
    and every conversation, those without turns too; without conversations there is no row. Equal
    sequences are one from the start; extra columns are not looked at."""
    seqs = materialize(seqs.select("conv_id", "seq"), "trie-sequences")
    root = seqs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.coalesce(F.max(turns_in("seq")), F.lit(0)).alias("height"), F.count_if(turns_in("seq") == 0).alias("bare")).first()
    end = F.unhex(F.sha2("seq", 256))
    hashes = materialize(end_hashes(seqs.select(end.alias("end"), "conv_id")), "trie-ends")
    grouped = seqs.where(turns_in("seq") > 0).groupBy("seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    rows = materialize(grouped.select(F.lit(root.conv_id).cast("long").alias("context"), F.lit(0).alias("above"), "seq", "n", "least", end.alias("end")), "trie-rows")
    found = materialize(build(rows, root.height), "trie-nodes")
    below = found.groupBy(F.col("parent_conv_id").alias("__id"), (F.col("depth") - 1).alias("__depth")).agg(F.count("*").alias("n_children"))
    own = (F.col("n_convs") - 1) * F.col("bytes")
    nodes = found.join(below, (F.col("conv_id") == F.col("__id")) & (F.col("depth") == F.col("__depth")), "left").drop("__id", "__depth")
    nodes = materialize(nodes.withColumns({"n_leaves": F.col("n_children").isNull().cast("long"), "saved_tokens": own, "n_children": F.coalesce("n_children", F.lit(0).cast("long"))}), "trie-nodes")
    totals = materialize(graft(nodes, root.height), "trie-totals")
    whole = nodes.drop("n_leaves", "saved_tokens").join(totals, KEY)
    top = totals.where("depth = 1").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    lone = lambda x: F.lit(x).cast("long")
    top = top.select(
        lone(root.conv_id).alias("conv_id"), F.lit(0).alias("depth"), lone(None).alias("parent_conv_id"), lone(root.n).alias("n_convs"), lone(0).alias("bytes"),
        F.when(lone(root.bare) > 0, F.unhex(F.sha2(F.unhex(F.lit("")), 256))).alias("end"), "n_children", F.coalesce("n_leaves", lone(1)).alias("n_leaves"), "saved_tokens",
    )
    if root.conv_id is not None:
        whole = whole.unionByName(top)
    names = hashes.withColumnRenamed("end", "__end")
    met = whole.join(names, F.col("end") == F.col("__end"), "left")
    return met.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256")
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt conversations. Rows without conv_id belong to none and are left out."""
    own = materialize(sequences(read_table(spark, sf_dir, "conversations")), "trie-turns")
    return prefix_trie(rebuilt(own))
