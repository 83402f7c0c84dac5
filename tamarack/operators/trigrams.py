"""Substring search by an inverted index of trigrams.

The index holds a table of documents, numbered and cut into ranges, and for each trigram and range
a posting list: the places in the range, ascending, which Parquet packs as steps. A range bounds
every list, however common its trigram. Both tables are folders by value (postings by a hash of the trigram,
documents by range), so a search reads the folders of its trigrams, intersects lists within each
range, and then reads only ranges that have a candidate. Candidates are verified by the same
condition that a scan would use, so the result is the scan's.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import text_condition

#: Documents of a range, as a power of two; folders of postings.
RANGE, BUCKETS = 16, 64
GRAM = 3


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case; [] for null and short ones."""
    low = F.lower(F.coalesce(text, F.lit("")))
    places = F.sequence(F.lit(1), F.greatest(F.length(low) - (GRAM - 1), F.lit(1)))
    return F.array_distinct(F.filter(F.transform(places, lambda i: F.substring(low, i, F.lit(GRAM))), lambda g: F.length(g) == GRAM))


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def build(products: DataFrame, path: str, columns: tuple[str, ...] = ("name", "description", "sku")) -> None:
    """Write the index of ``products`` to ``path``. Columns that it lacks are left out."""
    columns = [c for c in columns if c in products.columns]
    numbered = products.withColumn("__n", F.monotonically_increasing_id())
    places = numbered.withColumns({"__range": F.shiftright("__n", RANGE), "__place": F.col("__n").bitwiseAND((1 << RANGE) - 1).cast("int")}).drop("__n")
    places.write.partitionBy("__range").parquet(f"{path}/documents")
    docs = products.sparkSession.read.parquet(f"{path}/documents")  # numbers are fixed from here on
    seen = docs.select("__range", "__place", F.explode(F.array_distinct(F.flatten(F.array(*[grams(F.col(c)) for c in columns])))).alias("gram"))
    lists = seen.groupBy("gram", F.col("__range").alias("range")).agg(F.array_sort(F.collect_list("__place")).alias("places"))
    packed = lists.withColumn("bucket", bucket(F.col("gram"))).repartition("bucket", "range").sortWithinPartitions("bucket", "gram")
    packed.write.partitionBy("bucket").option("parquet.writer.version", "v2").parquet(f"{path}/postings")


def query_grams(query: str, literal: bool) -> list[str]:
    """The trigrams that any match has; none if the query is too short to have one."""
    pieces = [query] if literal else re.split(r"[%_]|\\.", query)
    low = [p.lower() for p in pieces]
    return sorted({p[i : i + GRAM] for p in low for i in range(len(p) - GRAM + 1)})


def candidates(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """(range, place) of the documents that have all these trigrams: lists meet within their range."""
    folders = [r.b for r in spark.createDataFrame([(g,) for g in wanted], "g string").select(bucket(F.col("g")).alias("b")).distinct().collect()]  # as many as trigrams at most
    found = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(folders) & F.col("gram").isin(wanted))
    lists = found.groupBy("range").agg(F.collect_list("places").alias("lists")).where(F.size("lists") == len(wanted))
    common = F.aggregate(F.slice("lists", F.lit(2), F.size("lists")), F.get("lists", F.lit(0)), F.array_intersect)
    return lists.select("range", F.explode(common).alias("place"))


def search_index(spark: SparkSession, path: str, query: str, literal: bool = False, columns: tuple[str, ...] = ("name", "description", "sku")) -> DataFrame:
    """The indexed products that match, with their own columns; rows as often as they were indexed.
    A query without a trigram scans all of them; an empty one is met by all."""
    docs = spark.read.parquet(f"{path}/documents")
    if not query:
        return docs.drop("__range", "__place")
    test = text_condition([c for c in columns if c in docs.columns], query, literal)
    if wanted := query_grams(query, literal):
        met = candidates(spark, path, wanted)
        docs = docs.join(met, (docs["__range"] == met["range"]) & (docs["__place"] == met["place"]), "left_semi")
    return docs.where(test).drop("__range", "__place")
