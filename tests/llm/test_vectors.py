"""Similar vectors against brute force; error bounds; edge cases."""

import numpy as np
import pytest

from gristmill.llm import vectors as V

SCHEMA = "id long, v array<float>, cell int, block string"


def data(n=1500, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n - 1, 10):
        x[i + 1] = x[i] + rng.normal(size=dim) * 0.08  # near copies
    x[5], x[6] = x[4] * 3, x[4]
    return (x * rng.uniform(0.3, 4, size=(n, 1))).astype(np.float32)


def frame(spark, x, more=()):
    return spark.createDataFrame([(i, v.tolist(), 1, "x") for i, v in enumerate(x)] + list(more), SCHEMA).repartition(4)


def brute(x, threshold):
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    s = y @ y.T
    i, j = np.nonzero(np.triu(s >= threshold, 1))
    return s, set(zip(i.tolist(), j.tolist()))


def test_error_bound_holds():
    x = data(300)
    y = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    product, error = V.bounds(y[:100], y[100:])
    assert (np.abs(product - y[:100].astype(float) @ y[100:].astype(float).T) <= error).all() and error.max() < 0.05


def test_pairs(spark):
    x = data()
    odd = [(9000, None, 1, None), (9001, [], 1, None), (9002, [0.0] * 16, 1, ""), (9003, [1.0] * 8, 1, ""), (9004, [float("nan")] * 16, 1, ""), (3, x[3].tolist(), 1, "repeated")]
    got = V.similar_pairs(frame(spark, x, odd), "id", "v", 0.9, dim=16).collect()
    s, want = brute(x, 0.9)
    found = {(r.id_a, r.id_b) for r in got}
    assert found <= want and len(found) >= 0.98 * len(want) and len(found) == len(got)
    assert all(abs(r.similarity - s[r.id_a, r.id_b]) < 1e-6 for r in got)


def test_copies_are_partners_of_each_other_and_of_others(spark):
    x = data(400)
    x[100:160] = x[40]  # a hot group of equal vectors
    got = {(r.id_a, r.id_b) for r in V.similar_pairs(frame(spark, x), "id", "v", 0.9, dim=16).collect()}
    assert got == brute(x, 0.9)[1]


def test_exact_mode_in_blocks(spark):
    x = data(600)
    got = {(r.id_a, r.id_b) for r in V.similar_pairs(frame(spark, x), "id", "v", 0.9, dim=16, exact=True, block=40).collect()}
    assert got == brute(x, 0.9)[1]


def crowded(n=3000, dim=16):
    """A third of the vectors in one narrow area, as many in a wider one."""
    rng = np.random.default_rng(3)
    x = data(n, dim)
    x[: n // 3] = x[0] / np.linalg.norm(x[0]) + rng.normal(size=(n // 3, dim)) * 0.12
    return x.astype(np.float32)


def test_large_cells_are_divided(spark):
    x = crowded()
    s, want = brute(x, 0.985)
    got = {(r.id_a, r.id_b) for r in V.similar_pairs(frame(spark, x), "id", "v", 0.985, dim=16, fit_rows=64, block=100).collect()}
    assert got <= want and len(got) >= 0.98 * len(want)


def test_rows_of_a_cell_and_copies_stay_bounded(spark, monkeypatch):
    x = crowded()
    monkeypatch.setattr(V, "DIVIDED_ROWS", 300)  # several tasks divide one cell
    base, total, _ = V._collapsed(frame(spark, x), "id", "v", 16, None)
    assert total == len(x)
    centres, _ = V._fit(base, total, 16, 64)
    placed, large = V._divided(V._place(base, centres, 16, V.PROBES, V.MARGIN), 16, V.MARGIN, V.PROBES_BELOW, V.COPIES, 100)
    rows = placed.select("id", "cell", "home").toPandas()
    assert large.count() == 0 and rows[rows.home].groupby("cell").size().max() <= 200
    assert sorted(rows[rows.home].id) == list(range(len(x))) and rows.groupby("id").size().max() <= V.COPIES
    assert not rows.duplicated(["id", "cell"]).any()


def test_cells_that_cannot_be_divided_are_cut_into_blocks(spark):
    rng = np.random.default_rng(4)
    x = (np.ones((400, 16)) + rng.normal(size=(400, 16)) * 1e-4).astype(np.float32)
    got = V.similar_pairs(frame(spark, x), "id", "v", 0.9, dim=16, fit_rows=8, block=30).count()
    assert got == 400 * 399 // 2


@pytest.mark.parametrize("total", [1, 10**6, 10**9, 10**10, 10**12, 10**15])
def test_sample_and_cells_at_any_size(total):
    """The share of hashes below the bound is that of the rows asked for, and never nothing."""
    bound = V.hash_below(1.25 * V.FIT_ROWS, total)
    expected = (bound + 2**63) / 2**64 * total
    assert bound >= -(2**63) and expected >= min(total, V.FIT_ROWS) * 0.99 and expected <= 1.3 * V.FIT_ROWS
    assert V.cells_for(min(total, V.FIT_ROWS), total) >= 1
    # Divisions that bring the rows of a cell below two blocks, each by up to DIVIDED.
    per_cell, depth = total / V.cells_for(min(total, V.FIT_ROWS), total), 0
    while per_cell > 2 * V.BLOCK:
        per_cell, depth = per_cell / min(V.DIVIDED, per_cell * 2 / V.BLOCK), depth + 1
    assert depth <= V.DEPTH


def test_nearest_recall(spark):
    x = data(1000)
    s, _ = brute(x, 2)
    got = {}
    for r in V.nearest(frame(spark, x), "id", "v", 5, dim=16, query="id % 10 = 0").collect():
        got.setdefault(r.id, {})[r.position] = (r.neighbour, r.similarity)
    assert set(got) == set(range(0, 1000, 10)) and all(sorted(v) == [1, 2, 3, 4, 5] for v in got.values())
    hits = 0
    for i, v in got.items():
        order = [j for j in np.argsort(-s[i], kind="stable") if j != i][:5]
        hits += len({n for n, _ in v.values()} & set(map(int, order)))
        assert i not in {n for n, _ in v.values()}
        sims = [v[k][1] for k in range(1, 6)]
        assert sims == sorted(sims, reverse=True)
    assert hits >= 0.9 * 5 * len(got)


@pytest.mark.parametrize("rows", [[], [(1, None, 1, "")], [(1, [1.0] * 16, 1, "")]])
def test_nothing_to_compare(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert V.similar_pairs(df, "id", "v", 0.9, dim=16).count() == 0
    assert V.nearest(df, "id", "v", 3, dim=16).count() == 0
