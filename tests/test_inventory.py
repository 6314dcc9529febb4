"""Smaller operators: bounds, casts, hot keys, quantiles, prompts, matrix files."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gristmill.functions import numbers as N
from gristmill.functions import text as T
from gristmill.functions import vectors as V
from gristmill.operators import detectors, fusion, plugins, relational
from gristmill.sources import files


def column(spark, kind, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_bounds(spark):
    rows = [(5.0, 6.0), (6.0, 6.0), (5.0, None), (None, None), (None, 0.0), (None, 6.0), (float("nan"), 6.0)]
    df = spark.createDataFrame(rows, "v double, b double").coalesce(1)
    assert [r.x for r in df.select(fusion.below(F.col("v"), F.col("b")).alias("x")).collect()] == [True, False, True, True, True, False, False]
    assert column(spark, "double", [-1.0, 0.5, 2.0, None], lambda c: fusion.within(c, 0.0, 1.0)) == [0.0, 0.5, 1.0, None]


def test_strict_cast_and_interpolation(spark):
    assert column(spark, "string", ["1.5", None, " 2 "], N.strict_number) == [1.5, None, 2.0]
    with pytest.raises(PySparkException, match="not a number: n/a"):
        column(spark, "string", ["1", "n/a"], N.strict_number)
    sized = lambda lo, hi: column(spark, "double", [0.0, 5.0, 10.0], lambda c: N.interpolated(c, F.lit(lo), F.lit(hi), 20.0, 200.0))
    assert sized(0.0, 10.0) == [20.0, 110.0, 200.0] and sized(3.0, 3.0) == [20.0] * 3


def test_sample_bound():
    assert N.hash_below(0, 100) == -(2**63) and N.hash_below(200, 100) == 2**63 - 1 and N.hash_below(1, 10**15) > -(2**63)


def test_vector_gaps(spark):
    assert column(spark, "array<float>", [None, [1.0, 2.0]], lambda c: V.or_zero(c, 2)) == [[0.0, 0.0], [1.0, 2.0]]
    assert column(spark, "double", [None, float("nan"), 2.0], V.clean_number) == [0.0, 0.0, 2.0]


def test_accents_of_any_script(spark):
    texts = ["Crème brûlée", "ǅ ệ ά й ё", "ß ø Đ", "é", "ﬁ ² ½ …", "日本", None, ""]
    assert column(spark, "string", texts, T.strip_accents) == ["Creme brulee", "ǅ e α и е", "ß ø Đ", "e", "ﬁ ² ½ …", "日本", None, ""]
    assert column(spark, "string", texts, T.to_ascii) == ["Creme brulee", "Dz e   ", "  ", "e", "fi 2 12 ...", "", None, ""]


@pytest.mark.parametrize("piece", [10_000, 7])
def test_concatenation_of_hot_keys(spark, piece):
    rng = np.random.default_rng(5)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.integers(5)}", int(rng.integers(40)), i, rng.choice(["a", "b", "", None, "long value"])) for i in range(400)]
    rows += [(None, 1, 1, "x"), ("empty", 1, 1, None), ("empty", 1, 2, "")]
    df = spark.createDataFrame(rows, "k string, o int, i int, v string").repartition(5)
    want = {}
    for k, o, i, v in sorted((r for r in rows if r[0]), key=lambda r: (r[1], r[2])):
        want.setdefault(k, []).extend([v] if v else [])
    got = {r.k: r.v for r in relational.group_concat(df, "k", "v", ["o", "i"], "; ", piece).collect()}
    assert got == {k: "; ".join(v) for k, v in want.items()}
    assert relational.group_concat(df.limit(0), "k", "v", ["o"]).count() == 0


def test_exact_quantiles(spark):
    rng = np.random.default_rng(6)
    values = {"a": rng.normal(size=501), "b": rng.integers(0, 4, 1000).astype(float), "c": np.array([7.0])}
    df = spark.createDataFrame([(g, float(x)) for g, xs in values.items() for x in xs] + [("a", None), ("d", None)], "g string, x double").repartition(6)
    got = {r.g: r.q for r in relational.exact_quantiles(df, "g", "x", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    assert set(got) == set(values)
    for g, xs in values.items():
        assert np.allclose(got[g], np.quantile(xs, [0.0, 0.25, 0.5, 0.9, 1.0]))


def test_profile_first_match_and_members(spark):
    df = spark.createDataFrame([(2, "b"), (1, None)], "id int, t string")
    rows = {r.column_name: r for r in relational.profile(df).collect()}
    assert (rows["t"].nulls, rows["t"].n_rows, rows["t"].n_columns, rows["t"].position, rows["t"].kind, rows["id"].first_value) == (1, 2, 2, 2, "string", "1")
    assert relational.first_match(df, F.col("id") > 0, "id").first().id == 1 and relational.first_match(df, F.col("id") > 5, "id").count() == 0
    flags = relational.member_flags(df, "t", spark.createDataFrame([("b",), ("b",)], "x string"), "known")
    assert sorted((r.id, r.known) for r in flags.collect()) == [(1, False), (2, True)]


def test_prompts(spark):
    class Echo:
        def answer(self, prompts):
            return [f"I give it {len(p)} of 100" for p in prompts]

    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, p string")
    assert [r.a for r in plugins.prompted(df, "p", "a", Echo).orderBy("id").collect()] == ["I give it 3 of 100", "I give it 0 of 100"]
    assert {r.a for r in plugins.prompted(df, "p", "a").collect()} == {'{"error": "no model is loaded"}'}
    assert column(spark, "string", ["I give it 88 of 100", "900", "none", None], plugins.percent_score) == [88.0, 100.0, 0.0, 0.0]


def test_only_unsure_rows_are_asked_again(spark):
    df = spark.createDataFrame([(1, 0.9), (2, 0.1), (3, None)], "id int, c double").select("id", F.struct(F.lit("x").alias("language"), F.col("c").alias("confidence")).alias("r"))
    asked = []

    def further(unsure):
        asked.extend(r.id for r in unsure.collect())
        return unsure.withColumn("r", F.struct(F.lit("y").alias("language"), F.when(F.col("id") == 2, 0.05).otherwise(0.5).alias("confidence")))

    got = {r.id: r.r.language for r in detectors.asked_again(df, "r", 0.6, further).collect()}
    assert sorted(asked) == [2, 3] and got == {1: "x", 2: "x", 3: "y"}


def test_matrix_files_by_tasks(spark, tmp_path):
    m = np.random.default_rng(7).normal(size=(500, 6)).astype(np.float32)
    df = spark.createDataFrame([(int(i), m[i].tolist()) for i in np.random.default_rng(8).permutation(500)], "i int, v array<float>").repartition(7)
    files.write_npy(df, "i", "v", str(tmp_path / "m.npy"))
    assert (np.load(tmp_path / "m.npy") == m).all()
    assert sorted((r.row, r.embedding[0]) for r in files.read_npy(spark, str(tmp_path / "m.npy")).collect()) == [(i, float(m[i, 0])) for i in range(500)]
    files.write_npy(df.limit(0), "i", "v", str(tmp_path / "e.npy"))
    assert np.load(tmp_path / "e.npy").size == 0


def test_zscores_of_gaps(spark):
    from gristmill.operators import dense

    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, None]), (3, [2.0, 5.0])], "i int, v array<double>")
    got = {(r.i, r.dim): r.z for r in dense.zscores(df, "i", "v").collect()}
    assert got[2, 1] == 0.0 and got[1, 1] == 0.0 and abs(got[1, 0] + 1.5**0.5) < 1e-9
