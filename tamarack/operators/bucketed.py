"""A keyed snapshot whose files are replaced bucket by bucket.

Rows lie in folders by a hash of their key. Which folders make up the snapshot is said by a
manifest, a small file a version that names for each bucket the folder it was last written to;
a reader takes the newest manifest and never sees half a merge. A merge reads the buckets that its
batch touches, finds the rows that really change, and writes only buckets that have one; all
other files stay as they are, name and content. Deletes are vectors: keys beside a bucket, left
out when it is read and gone when the bucket is next written.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.storage import Files
from .upsert import fold, merged, prefixed


@dataclass
class Manifest:
    """Version ``number``; ``folders`` has the folder of each bucket that holds rows, ``vectors`` the
    folders of its deleted keys, ``batch`` the last batch that was merged."""

    number: int = -1
    batch: int = -1
    schema: str | None = None
    folders: dict[int, str] = field(default_factory=dict)
    vectors: dict[int, list[str]] = field(default_factory=dict)


def comparable(df: DataFrame, c: str) -> Column:
    """A column as something that can be compared; maps as sorted entries."""
    kind = df.schema[c].dataType.typeName()
    return F.array_sort(F.map_entries(c)) if kind == "map" else F.col(c)


class Snapshot:
    """``key`` has no nulls in it: rows without key are not stored. ``at`` and ``ties`` say which of
    two rows of a key is the later one, as in ``upsert``."""

    def __init__(self, spark: SparkSession, root: str, key: str = "sku", at: str = "scraped_at", ties: list[str] = (), buckets: int = 64):
        self.spark, self.root, self.key, self.at, self.ties, self.buckets, self.files = spark, root, key, at, list(ties), buckets, Files(spark)

    def manifest(self) -> Manifest:
        names = [n for n in self.files.names(f"{self.root}/manifest") if n.endswith(".json")]
        if not names:
            return Manifest()
        m = json.loads(self.files.read(f"{self.root}/manifest/{names[-1]}"))
        whole = lambda d: {int(k): v for k, v in d.items()}
        return Manifest(m["number"], m["batch"], m["schema"], whole(m["folders"]), whole(m["vectors"]))

    def _switch(self, m: Manifest) -> Manifest:
        self.files.create(f"{self.root}/manifest/{m.number:012d}.json", json.dumps(m.__dict__))
        return m

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _rows(self, m: Manifest, buckets: list[int] | None = None, schema: StructType | None = None) -> DataFrame:
        own = sorted(b for b in m.folders if buckets is None or b in buckets)
        schema = StructType.fromJson(json.loads(m.schema)) if m.schema else schema
        if not own:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[m.folders[b] for b in own])
        vectors = [v for b in own for v in m.vectors.get(b, [])]
        if vectors:
            gone = self.spark.read.schema(StructType([schema[self.key]])).parquet(*vectors).withColumnRenamed(self.key, "__gone")
            rows = rows.join(gone, F.col(self.key) == F.col("__gone"), "left_anti")
        return rows

    def read(self, keys: list | None = None) -> DataFrame:
        """The snapshot; with ``keys`` only the rows of these, from their buckets alone."""
        m = self.manifest()
        if m.schema is None:
            raise FileNotFoundError(f"no snapshot at {self.root}")
        if keys is None:
            return self._rows(m)
        kind = StructType.fromJson(json.loads(m.schema))[self.key].dataType.simpleString()
        own = self.spark.createDataFrame([(k,) for k in keys], f"`{self.key}` {kind}").select(self._bucket().alias("b")).distinct().collect()
        return self._rows(m, [r.b for r in own]).where(F.col(self.key).isin(list(keys)))

    def _written(self, path: str) -> list[int]:
        return [int(n.removeprefix("b=")) for n in self.files.names(path) if n.startswith("b=")]

    def merge(self, batch: DataFrame, number: int | None = None, now: Column | None = None) -> Manifest:
        """Fold a batch into the snapshot as ``upsert`` does and switch to the new version. A batch
        that changes nothing, or a ``number`` that was merged already, leaves the manifest as it is."""
        m = self.manifest()
        if number is not None and number <= m.batch:
            return m
        draft = f"{self.root}/draft/{uuid.uuid4().hex}"
        schema = StructType.fromJson(json.loads(m.schema)) if m.schema else batch.schema
        folded = fold(batch.where(F.col(self.key).isNotNull()), self.key, self.at, self.ties)
        folded.withColumn("b", self._bucket()).write.partitionBy("b").parquet(f"{draft}/batch")
        touched = self._written(f"{draft}/batch")
        if touched:
            new = self.spark.read.schema(folded.schema).parquet(f"{draft}/batch").drop("b")
            stored = self._rows(m, touched, schema)
            self._changes(stored, new, now).withColumn("b", self._bucket()).write.partitionBy("b").parquet(f"{draft}/changed")
            changed = self._written(f"{draft}/changed")
            if changed:
                rows = self.spark.read.schema(schema).parquet(f"{draft}/changed").drop("b")
                gone = rows.select(F.col(self.key).alias("__key"))
                kept = self._rows(m, changed, schema).join(gone, F.col(self.key) == F.col("__key"), "left_anti")
                m = self._replace(m, kept.unionByName(rows), schema, m.batch if number is None else number)
            elif number is not None:
                m = self._switch(Manifest(m.number + 1, number, m.schema, m.folders, m.vectors))
        self.files.delete(draft)
        return m

    def _changes(self, stored: DataFrame, new: DataFrame, now: Column | None) -> DataFrame:
        """The rows of the snapshot to be that aren't in it yet."""
        joined = prefixed(new).join(stored, F.col(f"__{self.key}") == F.col(self.key), "left")
        values = merged(stored, new, self.key, self.at, self.ties, now)
        after = joined.select(*stored.columns, *[v.alias(f"__new_{c}") for c, v in values.items()])
        differs = [~comparable(after, c).eqNullSafe(comparable(after, f"__new_{c}")) for c in stored.columns if c != "updated_at"]
        return after.where(reduce(lambda a, b: a | b, differs)).select(*[F.col(f"__new_{c}").alias(c) for c in stored.columns])

    def _replace(self, m: Manifest, rows: DataFrame, schema: StructType, batch: int) -> Manifest:
        """A new version in which these rows are their buckets."""
        version = m.number + 1
        place = f"{self.root}/data/v={version:012d}-{uuid.uuid4().hex[:8]}"
        rows.select(*schema.names).withColumn("b", self._bucket()).hint("rebalance", F.col("b")).write.partitionBy("b").parquet(place)
        folders, vectors = dict(m.folders), dict(m.vectors)
        for b in self._written(place):
            folders[b] = f"{place}/b={b}"
            vectors.pop(b, None)
        return self._switch(Manifest(version, batch, schema.json(), folders, vectors))

    def delete(self, keys: DataFrame) -> Manifest:
        """Leave out the rows of these keys (a table of one column) from now on. Only their buckets
        are read, and no data file is written: a vector of the keys met is put beside each bucket."""
        m = self.manifest()
        draft = f"{self.root}/draft/{uuid.uuid4().hex}"
        named = keys.toDF(self.key).where(F.col(self.key).isNotNull()).distinct()
        named.withColumn("b", self._bucket()).write.partitionBy("b").parquet(f"{draft}/asked")
        touched = [b for b in self._written(f"{draft}/asked") if b in m.folders]
        if touched:
            place = f"{self.root}/deleted/v={m.number + 1:012d}-{uuid.uuid4().hex[:8]}"
            asked = self.spark.read.schema(named.schema).parquet(f"{draft}/asked").drop("b").withColumnRenamed(self.key, "__asked")
            met = self._rows(m, touched).select(self.key).join(asked, F.col(self.key) == F.col("__asked"), "left_semi")
            met.withColumn("b", self._bucket()).write.partitionBy("b").parquet(place)
            vectors = dict(m.vectors)
            for b in self._written(place):
                vectors[b] = [*vectors.get(b, []), f"{place}/b={b}"]
            if vectors != m.vectors:
                m = self._switch(Manifest(m.number + 1, m.batch, m.schema, m.folders, vectors))
        self.files.delete(draft)
        return m

    def expire(self, keep: int = 2) -> None:
        """Remove what only versions before the last ``keep`` use. Readers of those must be done."""
        names = [n for n in self.files.names(f"{self.root}/manifest") if n.endswith(".json")]
        used = set()
        for n in names[-keep:]:
            m = json.loads(self.files.read(f"{self.root}/manifest/{n}"))
            used |= {*m["folders"].values(), *[v for vs in m["vectors"].values() for v in vs]}
        for n in names[:-keep]:
            self.files.delete(f"{self.root}/manifest/{n}")
        for kind in ("data", "deleted"):
            for v in self.files.names(f"{self.root}/{kind}"):
                for b in self.files.names(f"{self.root}/{kind}/{v}"):
                    if b.startswith("b=") and f"{self.root}/{kind}/{v}/{b}" not in used:
                        self.files.delete(f"{self.root}/{kind}/{v}/{b}")

