"""Whitening against numpy on one machine."""

import numpy as np
import pytest

from tamarack.llm import whitening

KIND = "vec_id long, embedding array<float>, label int, n long, whitened string"


def plain(vectors, most=32):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    c = x - sums / n
    v = c.T @ c / n
    e, w = np.linalg.eigh(v)
    keep = np.flatnonzero(e[::-1][:most] > 1e-12 * e[-1])
    e, w = e[::-1][keep], w[:, ::-1][:, keep]
    return ((n * x - sums) ** 2).sum(1), c @ w / np.sqrt(e), e / np.trace(v)


def compare(got, ids, vectors, most=32):
    deviation, z, explained = plain(vectors, most)
    rows, found, own = got.collect(), {}, {}
    k = z.shape[1]
    assert len(rows) == len(ids) * k
    for r in rows:  # repeated rows have equal results
        found.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    for i, d, v in zip(ids, deviation.tolist(), z, strict=True):
        own.setdefault((i, d), []).append(v)
    assert found.keys() == own.keys()
    keys = sorted(found)
    assert all(sorted(found[x]) == list(range(1, k + 1)) and {len(v) for v in found[x].values()} == {len(own[x])} and np.ptp([found[x][c] for c in found[x]], axis=1).max() == 0 for x in keys)
    mine, theirs = np.array([[found[x][c][0] for c in range(1, k + 1)] for x in keys]), np.array([own[x][0] for x in keys])
    assert np.allclose(mine, theirs * np.sign((mine * theirs).sum(0)), atol=1e-7)
    assert np.allclose([v for _, v in sorted({(r.component, r.explained) for r in rows})], explained)
    assert {r.n for r in rows} == {len(ids)} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_whitening_of_the_given_embeddings(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    compare(whitening.op13_whitening(spark, sf_dir), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_unusable_rows_go_and_repeated_rows_stay(spark):
    rng = np.random.default_rng(3)
    good = [(int(i), [float(v) for v in np.float32(rng.normal(size=5) * [3, 1, 1, 2, 0])]) for i in [*range(40), 7, 7]]  # the last dimension has no variance
    good += [good[3], good[3]]
    bad = [(90, None), (91, []), (92, [1.0, None, 0.0, 0.0, 0.0]), (93, [1.0, float("nan"), 0.0, 0.0, 0.0]), (94, [float("inf")] * 5), (95, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 7, "clash") for i, v in good + bad], KIND).repartition(3)
    got = whitening.whiten(df)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and {r.component for r in got.collect()} == {1, 2, 3, 4}
    compare(got, [i for i, _ in good], [v for _, v in good])
    lone = spark.createDataFrame([(None, [1.0, 2.0], 1, 1, ""), (2, [3.0, -1.0], 1, 1, "")], KIND)
    assert sorted((r.vec_id or 0, round(abs(r.whitened), 9)) for r in whitening.whiten(lone).collect()) == [(0, 1.0), (2, 1.0)]


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 1, 1, "")], [(1, [1.0], 1, 1, ""), (2, [1.0], 1, 1, "")], [(1, None, 1, 1, "")]])
def test_without_variance_there_is_no_component(spark, rows):
    got = whitening.whiten(spark.createDataFrame(rows, KIND))
    assert got.collect() == [] and got.columns[0] == "vec_id"


def test_many_blocks_slabs_and_columns(spark, monkeypatch):
    monkeypatch.setattr(whitening, "rows_of", lambda dim: 16)
    monkeypatch.setattr(whitening, "WIDE", 4)
    monkeypatch.setattr(whitening, "SLAB", 3)
    monkeypatch.setattr(whitening, "TALL", 2)
    monkeypatch.setattr(whitening, "SPLIT", 2048)
    rng = np.random.default_rng(5)
    vectors = [[float(v) for v in np.float32(rng.normal(size=10) * np.arange(1, 11))] for _ in range(150)]
    df = spark.createDataFrame([(i, v, 1, 1, "") for i, v in enumerate(vectors)], KIND).repartition(4)
    compare(whitening.whiten(df, 6), list(range(150)), vectors, 6)


def test_exact_sums_beyond_a_long():
    x = np.array([[1 << 60, 0], [0, 5], [-(1 << 60), 7]])
    sums = [sum(map(int, c)) for c in x.T]
    assert whitening.deviations(x, 3, sums) == [None, (3 * 5 - 12) ** 2, None]
    assert whitening.integers(np.array([1e300, -1e300, -0.01])).tolist() == [(1 << 61) + 1_000_000, -(1 << 61) + 1_000_000, 999_999]
    near = np.array([[1_000_000, 3], [1_000_001, 3]])
    assert whitening.centred(near, 2, [2_000_001, 6]).tolist() == [[-0.5, 0.0], [0.5, 0.0]]
