"""Filling of gaps: methods, fallbacks, medians over all rows, edge cases."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gristmill.functions.numbers import has_digit, read_count, read_money, read_rating
from gristmill.operators.imputation import fit_on, fit_prototypes, impute, masked_error

SCHEMA = "k string, kind string, price double, rating double, value string"


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r.k, r.field_name): r for r in impute(df, "k", ["rating"], ["price", "rating"], ["kind"], **more).collect()}


def test_clusters_fill_from_their_own(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        far = i % 2
        rating = None if i < 20 else float((2 if far else 4) + rng.normal(0, 0.05))
        rows.append((str(i), "dear" if far else "cheap", 100.0 + 900 * far + rng.normal(), rating, "x"))
    got = run(spark, rows, clusters=4)
    for i in range(20):
        r = got[str(i), "rating"]
        assert r.method == "cluster" and abs(r.value - (2 if i % 2 else 4)) < 0.2
    assert all(got[str(i), "rating"].method == "observed" and got[str(i), "rating"].value == rows[i][3] for i in range(20, 300))


def test_fallbacks(spark):
    got = run(spark, [("a", "x", 1.0, None, ""), ("b", "y", 1000.0, 3.0, "")], clusters=2)
    assert got["a", "rating"].method == "global" and got["a", "rating"].value == 3.0
    got = run(spark, [("a", "x", 1.0, None, ""), ("b", None, None, None, None)])
    assert {r.method for r in got.values()} == {"none"}


def test_nan_null_repeats_empty_and_clashing_columns(spark):
    rows = [("a", "x", 1.0, float("nan"), "1"), ("b", "x", 1.0, 4.0, "2"), ("b", "x", 1.0, 4.0, "2"), (None, None, None, 5.0, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = impute(df, "k", ["rating"], ["price", "rating"], ["kind"]).collect()
    assert len(out) == 4 and next(r for r in out if r.k == "a").method != "observed"
    assert impute(spark.createDataFrame([], SCHEMA), "k", ["rating"], ["price"], ["kind"]).count() == 0


def test_medians_are_of_all_rows_not_of_the_sample(spark):
    rows = [(str(i), "x", 1.0, float(i % 5), "") for i in range(500)] + [("gap", "x", 1.0, None, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.k: r for r in impute(df, "k", ["rating"], ["price"], ["kind"], clusters=1, fit_rows=3).collect()}
    assert out["gap"].value == 2.0 and out["gap"].method == "cluster"


def test_prototypes_and_scaling_are_of_all_rows_not_of_the_sample(spark):
    # Two starting points drawn from two rows by hash; the groups at 0 and 100 are told apart only by rounds over all rows.
    rows = [(str(i), "a" if i % 2 else "b", 100.0 * (i % 2) + i % 7, None if i < 2 else 5.0 if i % 2 else 1.0, "") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).select("k", F.coalesce("kind", F.lit("")).alias("kind"), "price").repartition(3)
    two = pd.DataFrame({"price": [98.0, 104.0], "kind": ["a", "a"]})
    start = fit_prototypes(two, ["price"], ["kind"], clusters=2)
    m = fit_on(df, ["price"], ["kind"], start)
    prices = np.array([r[2] for r in rows])
    assert abs(m.mean[0] - prices.mean()) < 1e-9 and abs(m.scale[0] - prices.std()) < 1e-9
    got = sorted(zip((m.centres[:, 0] * m.scale[0] + m.mean[0]).tolist(), m.modes[:, 0].tolist()))
    want = [(prices[::2].mean(), "b"), (prices[1::2].mean(), "a")]
    assert [w for _, w in got] == [w for _, w in want] and np.allclose([c for c, _ in got], [c for c, _ in want])


def test_prototypes_separate_mixed_features():
    p = pd.DataFrame({"n": [1.0, 1.1, None, 9.0, 9.1], "c": ["a", "a", "a", "b", None]})
    m = fit_prototypes(p, ["n"], ["c"], clusters=2)
    at = m.assign(p[["n"]].to_numpy(float), p[["c"]].fillna("").to_numpy(object))
    assert at[0] == at[1] == at[2] and at[3] == at[4] != at[0]


def test_numbers(spark):
    texts = ["6,28,789", "216+", "19 reviews", "1.2k", "3 lakh", None, "", "n/a", "78 214"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.c for r in df.select(read_count(F.col("t")).alias("c")).collect()] == [628789.0, 216.0, 19.0, 1200.0, 300000.0, None, None, None, 78214.0]
    df = spark.createDataFrame([(t,) for t in ["4,0", "3.7 ★", "4.2 out of 5", " 4.0 ", "4.1/5", "-", None]], "t string")
    assert [r.c for r in df.select(read_rating(F.col("t")).alias("c")).collect()] == [4.0, 3.7, 4.2, 4.0, 4.1, None, None]
    df = spark.createDataFrame([("₹1,099",), ("free",), (None,)], "t string")
    assert [tuple(r) for r in df.select(read_money(F.col("t")), has_digit(F.col("t"))).collect()] == [(1099.0, True), (None, False), (None, False)]


def test_categories_are_filled_by_mode(spark):
    rows = [(str(i), "dear" if i % 2 else "cheap", 100.0 + 900 * (i % 2) + i % 5, 1.0, "gold" if i % 2 and i % 10 != 1 else "tin") for i in range(200)]
    rows += [("gap1", None, 1001.0, None, None), ("gap0", None, 101.0, 1.0, ""), ("half", "dear", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.k, r.field_name): r for r in impute(df, "k", ["rating"], ["price"], ["kind", "value"], clusters=4, words=["value", "kind"]).collect()}
    assert len(got) == 3 * len(rows) and got["gap1", "rating"].value == 1.0 and got["gap1", "rating"].text_value is None
    assert (got["gap1", "kind"].text_value, got["gap0", "kind"].text_value) == ("dear", "cheap") and got["gap1", "kind"].method == "wide_cluster"
    assert (got["gap1", "value"].text_value, got["gap0", "value"].text_value, got["half", "value"].text_value) == ("gold", "tin", "gold")
    assert got["1", "value"].method == "observed" and got["1", "value"].text_value == "tin" and got["1", "value"].value is None
    empty = impute(df.limit(0), "k", ["rating"], ["price"], ["kind"], words=["value"])
    assert empty.count() == 0 and empty.columns == ["k", "field_name", "value", "text_value", "method", "cluster"]


def test_masked_error_is_no_worse_than_the_parents(spark):
    rng = np.random.default_rng(2)
    rows = [(str(i), "ab"[i % 2], float(i % 4 > 1) * 100, (i % 2) * 2.0 + (i % 4 > 1) * 1.0 + float(rng.normal(0, 0.05)), "") for i in range(2000)]
    got = {r.way: r for r in masked_error(spark.createDataFrame(rows, SCHEMA), "k", "rating", ["price", "rating"], ["kind"]).collect()}
    assert got["filled"].n == got["parent"].n > 100 and got["filled"].error < 0.1 < got["parent"].error
