"""The snapshot store, the change log and the search index against plain versions."""

import datetime as dt
import os
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tamarack.operators import changes, sequence, trigrams
from tamarack.operators.bucketed import Snapshot
from tamarack.operators.search import SearchSpec, matching

ROW = "sku string, name string, current_price decimal(12,2), specifications map<string,string>, scraped_at timestamp, created_at timestamp, updated_at timestamp"


def day(n):
    return dt.datetime(2024, 1, n)


def rows_of(spark, *rows):
    return spark.createDataFrame([(k, f"{k} at {d}", None if p is None else Decimal(p), {"day": str(d)}, day(d), day(d), None) for k, d, p in rows], ROW)


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{root}/data") for f in names if f.endswith(".parquet")}


def held(store):
    return {r.sku: (r.name, r.current_price and int(r.current_price), r.created_at.day) for r in store.read().collect()}


def test_a_merge_writes_only_buckets_that_change(spark, tmp_path):
    store = Snapshot(spark, str(tmp_path), ties=["-current_price"], buckets=8)
    store.merge(rows_of(spark, *[(f"k{i}", 1, i) for i in range(40)]), 0)
    before, first = files(tmp_path), store.manifest()
    assert len(held(store)) == 40 and len(first.folders) > 4
    again = store.merge(rows_of(spark, *[(f"k{i}", 1, i) for i in range(40)]), 1)  # changes nothing
    assert files(tmp_path) == before and again.folders == first.folders and again.batch == 1
    assert store.merge(rows_of(spark, ("k3", 9, 99)), 1).number == again.number  # merged already
    store.merge(rows_of(spark, ("k3", 5, 7), ("k3", 4, 8), (None, 5, 1)), 2)
    after = store.manifest()
    changed = [b for b in after.folders if after.folders[b] != first.folders[b]]
    assert len(changed) == 1 and before < files(tmp_path)
    assert held(store)["k3"] == ("k3 at 5", 7, 1) and len(held(store)) == 40
    assert [r.sku for r in store.read(["k3"]).collect()] == ["k3"]
    store.merge(rows_of(spark, ("k3", 2, 1)), 3)  # late: only created_at could change
    assert held(store)["k3"] == ("k3 at 5", 7, 1) and store.manifest().folders == after.folders
    store.expire(1)
    assert len([f for f in files(tmp_path) if f in before]) < len(before) and len(held(store)) == 40


def test_deletes_are_vectors_until_the_bucket_is_written(spark, tmp_path):
    store = Snapshot(spark, str(tmp_path), buckets=4)
    store.merge(rows_of(spark, *[(f"k{i}", 1, i) for i in range(12)]))
    before = files(tmp_path)
    store.delete(spark.createDataFrame([("k1",), ("k2",), ("none",), (None,)], "k string"))
    assert files(tmp_path) == before and sorted(held(store)) == sorted(f"k{i}" for i in range(12) if i not in (1, 2))
    number = store.manifest().number
    store.delete(spark.createDataFrame([("k1",)], "k string"))
    assert store.manifest().number == number
    store.merge(rows_of(spark, ("k1", 2, 5)))  # comes back
    assert held(store)["k1"] == ("k1 at 2", 5, 2) and "k2" not in held(store)


def test_any_order_of_batches_gives_one_snapshot(spark, tmp_path):
    batches = [[("a", 1, 5), ("b", 4, 1)], [("a", 3, 7)], [("a", 2, 9), ("b", 4, 2), ("c", 1, None)]]
    found = []
    for i, order in enumerate([batches, batches[::-1], [batches[2], batches[0], batches[1]]]):
        store = Snapshot(spark, str(tmp_path / str(i)), ties=["-current_price"], buckets=2)
        for n, b in enumerate(order):
            store.merge(rows_of(spark, *b), n)
        found.append(held(store))
    assert found[0] == {"a": ("a at 3", 7, 1), "b": ("b at 4", 1, 4), "c": ("c at 1", None, 1)} and all(f == found[0] for f in found)


def test_a_reader_never_sees_a_draft(spark, tmp_path):
    store = Snapshot(spark, str(tmp_path), buckets=2)
    with pytest.raises(FileNotFoundError):
        store.read()
    assert store.merge(rows_of(spark)).number == -1
    store.merge(rows_of(spark, ("a", 1, 1)))
    with pytest.raises(FileExistsError):
        store.files.create(f"{tmp_path}/manifest/{0:012d}.json", "{}")
    assert not os.listdir(tmp_path / "draft")


def plain_history(seen):
    lowest = {}
    for k, d, p in seen:
        old = lowest.get((k, d))
        lowest[k, d] = p if old is None else old if p is None else min(old, p)
    out, last = [], {}
    for (k, d), p in sorted(lowest.items(), key=lambda x: x[0]):
        if k in last and p is not None and p != last[k]:
            out.append((k, d, p))
        last[k] = p
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_corrections_add_up_to_the_history(spark, tmp_path, seed):
    rng = random.Random(seed)
    seen = [(rng.choice("aaab"), rng.randint(1, 20), rng.choice([1, 1, 2, 3, None])) for _ in range(40)]
    log = changes.ChangeLog(spark, str(tmp_path), buckets=2)
    for n in range(4):
        part = seen[n * 10 : n * 10 + 10]
        batch = spark.createDataFrame([(k, day(d), p and Decimal(p)) for k, d, p in part], "key string, at timestamp, price decimal(12,2)")
        diff = sorted(map(tuple, log.append(batch, n).collect()), key=str)
        if n == 3:
            assert sorted(map(tuple, log.append(batch, n).collect()), key=str) == diff  # again after a failure
        assert sorted((r.key, r.recorded_at.day, int(r.price)) for r in log.history().collect()) == plain_history(seen[: n * 10 + 10])


def test_only_the_neighbours_of_a_late_price_are_read(spark):
    kind = "key string, at timestamp, price decimal(12,2)"
    log = spark.createDataFrame([("a", day(d), Decimal(d)) for d in (1, 5, 9, 13)] + [("b", day(5), Decimal(1))], kind)
    late = spark.createDataFrame([("a", day(7), Decimal(9))], kind)
    assert sorted((r["at"].day, r.edge) for r in changes.affected(log, late).collect()) == [(5, True), (9, False)]
    assert sorted((r.recorded_at.day, int(r.price), r.change) for r in changes.corrections(log, late).collect()) == [(7, 9, 1), (9, 9, -1)]


def test_previous_and_sums_over_hot_keys(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many parts of few rows
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 9)}", i, rng.choice([None, 1, 2, 3])) for i in range(600)] + [(None, 1, 5), (None, 2, None), (None, 3, 7)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(3)
    got = {(r.k, r.i): r.before and r.before.v for r in sequence.previous(df, ["k"], ["i"], {"before": F.when(F.col("v").isNotNull(), F.struct("v"))}).collect()}
    sums = {(r.k, r.i): r.s for r in sequence.running_sum(df, ["k"], ["i"], {"s": F.coalesce("v", F.lit(0))}).collect()}
    last, total = {}, {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        total[k] = total.get(k, 0) + (v or 0)
        assert got[k, i] == last.get(k) and sums[k, i] == total[k]
        last[k] = v if v is not None else last.get(k)
    assert sequence.parts(df, ["k", "i"]).where("k = 'hot'").select("__part").distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_as_of_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([("a", day(5), 1), ("a", day(1), 2), ("a", day(9), 3), ("b", day(5), 4), (None, day(5), 5), ("a", None, 6), ("a", day(5), 1)], "k string, at timestamp, n int")
    right = spark.createDataFrame([("a", day(5), 10, 1), ("a", day(5), 11, 2), ("a", day(2), None, 1), ("c", day(1), 9, 1), (None, day(1), 8, 1)], "k string, at timestamp, price int, tie int")
    got = sorted((r.n, r.price) for r in sequence.as_of(left, right, "k", "at", ["price"], ["tie"]).collect())
    assert got == [(1, 11), (1, 11), (2, None), (3, 11), (4, None), (5, None), (6, None)]


QUERIES = [("rin", False), ("RIN", True), ("r", False), ("in%ng", False), ("_tee", False), ("a_c", True), ("", False), ("nowhere to be found", False), ("ÉLÈ", False), ("P000000007", False), ("100%", True)]


@pytest.mark.parametrize("query, literal", QUERIES)
def test_index_finds_what_a_scan_finds(spark, indexed, query, literal):
    products, path = indexed
    got = trigrams.search_index(spark, path, query, literal)
    assert got.columns == products.columns
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in (matching(products, SearchSpec(query=query, literal=literal)) if query else products).collect())


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    from tamarack.sources import catalog

    path = str(tmp_path_factory.mktemp("index") / "i")
    own = catalog.products(spark, "/root/testdata/sf0.001").withColumn("description", F.concat_ws(" ", "category", "brand")).select("id", "sku", "name", "description")
    odd = spark.createDataFrame([("x1", None, None, None), ("x2", "ab", "", "élève a_c 100%"), ("x3", "abc", "ABC", "aXc"), ("x3", "abc", "ABC", "aXc")], "id string, sku string, name string, description string")
    products = own.union(odd).cache()
    trigrams.build(products, path)
    return products, path


def test_a_search_reads_the_folders_of_its_trigrams_first(spark, indexed):
    _, path = indexed
    wanted = trigrams.query_grams("ring", False)
    assert wanted == ["ing", "rin"] and trigrams.query_grams("ab%cd", False) == []
    plan = trigrams.search_index(spark, path, "ring")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "Python" not in plan
    folders = [r[0] for r in spark.createDataFrame([(g,) for g in wanted], "g string").select(trigrams.bucket(F.col("g"))).collect()]
    read = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(folders)).select(F.input_file_name()).distinct().count()
    assert len([d for d in os.listdir(f"{path}/postings") if d.startswith("bucket=")]) > 10 > len(wanted) >= read
    lists = trigrams.candidates(spark, path, wanted)
    assert lists.columns == ["range", "place"] and lists.distinct().count() == lists.count()
