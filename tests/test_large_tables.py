"""Rows and plans of larger tables, in small."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tamarack.operators import changes, sequence
from tamarack.plans import registry

PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def test_half_percents_go_to_the_even_number(spark, tmp_path):
    sizes = {1: (936.0, 24), 2: (965.0, 35), 3: (97.5, 2), 4: (386.0, 14), 5: (193.0, 14)}
    spark.createDataFrame([(k, "hot anvil", "Brand#1", "SMALL", size, price) for k, (price, size) in sizes.items()], PART).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k, dt.datetime(2024, 1, 1)) for k in sizes], "l_partkey long, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.id: (r.discount_percentage, r.discount_text) for r in registry.QUERIES["product_dto"](spark, str(tmp_path)).collect()}
    assert got == {"1": (2.5, "2%"), "2": (None, None), "3": (2.0101, "2%"), "4": (3.5, "4%"), "5": (6.7633, "7%")}


def test_pages_whose_skus_meet_stay_apart(spark, tmp_path):
    spark.createDataFrame([(k, "red anvil", "Brand#1", "SMALL", 4, 930.0) for k in (1730, 23030, 3)], PART).write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(map(tuple, registry.QUERIES["page_to_snapshot"](spark, str(tmp_path)).collect()))
    assert got == [("HP-220981F8", "red anvil", 930.0, 1), ("HP-220981F8", "red anvil", 930.0, 1), ("X-3", "red anvil", 930.0, 1)]


def test_pages_are_read_once_by_each_pattern_on_all_cores(spark, sf_dir):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = registry.QUERIES["extract_full"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("regexp_extract_all(") == 1 and plan.count("/each") == 3  # twice read, once composed
    assert "hashpartitioning(p_partkey" in plan


def test_a_large_batch_moves_once_and_hot_keys_are_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "FEW", 0)
    kind = "key string, at timestamp, price decimal(12,2)"
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)
    seen = [("hot" if n % 2 else f"k{n % 16}", at(n * 7 % 400), Decimal(n % 3)) for n in range(400)]
    log = changes.ChangeLog(spark, str(tmp_path / "log"), buckets=2)
    for n in range(3):
        log.append(spark.createDataFrame(seen[n::3], kind), n)
    last, want = {}, []
    for key, when, price in sorted(seen):
        if key in last and last[key] != price:
            want.append((key, price, when))
        last[key] = price
    assert sorted(map(tuple, log.history().collect())) == sorted(want)
    cut = sequence.sliced(log.seen(), ["key", "at"]).groupBy("key").agg(F.count_distinct("__part").alias("n"))
    assert {r.key: r.n for r in cut.collect()}["hot"] > 1 and cut.where("key <> 'hot' and n > 1").isEmpty()
    cold = [spark.createDataFrame([(f"k{i}", at(n), Decimal(i % 3)) for i in range(50)], kind) for n in range(2)]
    plan = changes.corrections(*cold)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan
