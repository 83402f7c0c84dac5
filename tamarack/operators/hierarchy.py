"""Category trees: ancestors by pointer doubling, cycles, roll-ups, and deletes that spread.

A join that follows one edge takes as many rounds as the tree is deep. Following 2^k edges at once
takes the logarithm of that: the pairs at distance 2^k meet the pairs of at most 2^k.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import scratch, written


def _kept(df: DataFrame) -> DataFrame:
    return written(df, scratch(df.sparkSession, "closure"))


def links(nodes: DataFrame, id: str = "id", parent: str = "parent_id") -> DataFrame:
    """(id, ancestor) of nodes whose parent is a node itself."""
    known = nodes.select(F.col(id).alias("__parent")).distinct()
    own = nodes.where(F.col(id).isNotNull() & F.col(parent).isNotNull()).select(F.col(id).alias("id"), F.col(parent).alias("ancestor")).distinct()
    return own.join(known, F.col("ancestor") == F.col("__parent"), "left_semi")


def _step(near: DataFrame, far: DataFrame) -> DataFrame:
    """(id, ancestor) of those that follow ``near`` and then ``far``."""
    beyond = far.select(F.col("id").alias("__mid"), F.col("ancestor").alias("__far"))
    return near.join(beyond, F.col("ancestor") == F.col("__mid")).select("id", F.col("__far").alias("ancestor"))


def cycles(nodes: DataFrame, id: str = "id", parent: str = "parent_id") -> DataFrame:
    """(id, on_cycle) of the nodes that have no root above them: those on a cycle and those that lead
    into one. Pointers are doubled until they reach over more edges than there are; whoever still points somewhere is such a node, and what is pointed to lies on a cycle."""
    hop = _kept(links(nodes, id, parent))
    n, reach = hop.count(), 1
    while reach <= n and not hop.isEmpty():
        hop, reach = _kept(_step(hop, hop)), 2 * reach
    on = hop.select(F.col("ancestor").alias("__on")).distinct()
    return hop.select("id").distinct().join(on, F.col("id") == F.col("__on"), "left").select("id", F.col("__on").isNotNull().alias("on_cycle"))


def closure(nodes: DataFrame, id: str = "id", parent: str = "parent_id") -> DataFrame:
    """(id, ancestor, distance): every node with itself (0) and all its ancestors. Nodes without a
    root above them (``cycles``) have no rows; a parent that is no node counts as none. Each id
    has one parent."""
    bad = cycles(nodes, id, parent).select(F.col("id").alias("__bad"))
    own = nodes.where(F.col(id).isNotNull()).select(F.col(id).alias("id")).distinct().join(bad, F.col("id") == F.col("__bad"), "left_anti")
    exact = _kept(links(nodes, id, parent).join(bad, F.col("id") == F.col("__bad"), "left_anti"))
    near, reach = exact.select("id", "ancestor", F.lit(1).alias("distance")), 1
    while not exact.isEmpty():
        beyond = near.select(F.col("id").alias("__mid"), F.col("ancestor").alias("__far"), F.col("distance").alias("__more"))
        more = exact.join(beyond, F.col("ancestor") == F.col("__mid")).select("id", F.col("__far").alias("ancestor"), (F.col("__more") + reach).cast("int").alias("distance"))
        near = _kept(near.union(more))
        exact, reach = _kept(_step(exact, exact)), 2 * reach
    return own.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance")).union(near)


def roll_up(counts: DataFrame, closed: DataFrame, id: str = "id", value: str = "n") -> DataFrame:
    """(id, own, total) of each node of a closure: its own value (0 if it has none) and the sum over
    its subtree. Values are added up by node before they go to the ancestors."""
    own = counts.groupBy(F.col(id).alias("__id")).agg(F.sum(value).alias("__n"))
    met = closed.join(own, F.col("id") == F.col("__id"), "left").select("ancestor", "distance", F.coalesce("__n", F.lit(0)).alias("__n"))
    return met.groupBy(F.col("ancestor").alias("id")).agg(F.sum(F.when(F.col("distance") == 0, F.col("__n")).otherwise(0)).alias("own"), F.sum("__n").alias("total"))


def paths(nodes: DataFrame, name: str = "name", id: str = "id", parent: str = "parent_id", separator: str = "/") -> DataFrame:
    """(id, level, path) of every node that a root stands above: the names from the root down. As
    deep as the tree is; a row holds a node's ancestors only."""
    names = nodes.select(F.col(id).alias("__id"), F.col(name).alias("__name"))
    met = closure(nodes, id, parent).join(names, F.col("ancestor") == F.col("__id"))
    steps = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), F.col("__name").alias("n"))))
    return met.groupBy("id").agg(F.max("distance").alias("level"), F.array_join(F.transform(steps, lambda x: x["n"]), separator).alias("path"))


@dataclass(frozen=True)
class Reference:
    """``child.column`` names a row of ``parent`` by its ``key``; what a delete of that row does."""

    child: str
    column: str
    parent: str
    key: str
    action: str = "cascade"  # or "set null"


def delete_sets(tables: dict[str, DataFrame], keys: dict[str, str], references: list[Reference], asked: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Of each table the keys (column ``gone``) that have to go when the ``asked`` ones (tables of one
    column) do. References are followed in the order given, so parents come before what hangs on
    them; a table that refers to itself is followed to any depth at once, by its closure. A node
    on a cycle goes with the others of its cycle only if it is asked for or hangs below such a one
    through rooted nodes."""
    gone = {t: asked[t].toDF("gone").where("gone is not null").distinct() for t in asked}
    for r in references:
        if r.action != "cascade" or r.parent not in gone:
            continue
        up = gone[r.parent]
        if r.child == r.parent:
            nodes = tables[r.child]
            spread = closure(nodes, r.key, r.column).join(up, F.col("ancestor") == F.col("gone"), "left_semi").select(F.col("id").alias("gone"))
            own = nodes.select(F.col(r.key).alias("__own"))
            spread = spread.union(up.join(own, F.col("gone") == F.col("__own"), "left_semi"))
        else:
            if r.key != keys[r.parent]:
                up = tables[r.parent].join(up, F.col(keys[r.parent]) == F.col("gone"), "left_semi").select(F.col(r.key).alias("gone"))
            spread = tables[r.child].join(up, F.col(r.column) == F.col("gone"), "left_semi").select(F.col(keys[r.child]).alias("gone"))
        before = gone.get(r.child)
        gone[r.child] = (spread if before is None or r.child == r.parent else spread.union(before)).distinct()
    return gone


def survivors(tables: dict[str, DataFrame], keys: dict[str, str], references: list[Reference], asked: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after the deletes: rows that go are left out, columns that are set to null are null."""
    gone = {t: _kept(g) for t, g in delete_sets(tables, keys, references, asked).items()}
    out = {}
    for name, table in tables.items():
        rows = table
        if name in gone:
            rows = rows.join(gone[name], F.col(keys[name]) == F.col("gone"), "left_anti")
        for r in references:
            if r.child == name and r.action == "set null" and r.parent in gone:
                left = gone[r.parent].withColumnRenamed("gone", "__gone")
                rows = rows.join(left, F.col(r.column) == F.col("__gone"), "left").withColumn(r.column, F.when(F.col("__gone").isNull(), F.col(r.column))).drop("__gone")
        out[name] = rows
    return out


# The catalogue's references and what they do.
REFERENCES = [
    Reference("categories", "parent_id", "categories", "id"),
    Reference("products", "category_id", "categories", "id", "set null"),
    Reference("history", "product_id", "products", "id"),
]
