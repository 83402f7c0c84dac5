"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next stage's docs.

ORACLE_SQL is None: code lengths, XXH64 fingerprints and forests have no SQL form; the
pipeline is tested against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import bpe_codec, decontaminate, language_id, secrets, simhash
from tamarack.llm.common import bounded_batches, discard, discarding, materialize, read_table, workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_POSTERIOR = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language isn't clear, go. Trained as op1 is."""
    bounded_batches(spark)
    model = language_id.train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    found = language_id.identify(docs, model, COLUMNS)
    return found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_POSTERIOR)).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays (null ids
    count as largest), once if its row is repeated. Rows are told apart by doc_id and text."""
    docs = docs.select(*COLUMNS, F.xxhash64("text").alias("__h"))
    found = materialize(simhash.near_duplicates(docs, ["__h"]), "groups")
    goes = ~F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = found.where(goes).select(F.col("doc_id").alias("__id"), F.col("__h").alias("__g")).distinct()
    kept = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__g")), "left_anti")
    again = found.where(~goes).groupBy("doc_id", "__h").count().where("count > 1").select(F.col("doc_id").alias("__id"), F.col("__h").alias("__g"))
    if not again.isEmpty():
        same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__g"))
        kept = kept.join(again, same, "left_anti").union(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "__h"]))
    return kept.select(*COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; all documents stay."""
    return secrets.redact(docs.select(*COLUMNS), secrets.fit(docs))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text."""
    return bpe_codec.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])


STAGES = [
    ("language_id", language_stage),
    ("simhash_dedup", dedup_stage),
    ("decontamination", decontaminate_stage),
    ("secret_scan", secrets_stage),
    ("bpe_encode", encode_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order. Each one's result is kept until the next is written; what a stage has
    written for itself goes with it."""
    docs, before = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = workspace(spark, f"stage-{name}")
        with discarding(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        discard(spark, before)
        docs, before = spark.read.parquet(path), [path]
    return docs
