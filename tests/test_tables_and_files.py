"""Relational, incremental, source, plug-in and streaming operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import incremental as I
from gristmill.operators import plugins
from gristmill.operators import relational as R
from gristmill.sources import files
from gristmill.sources.tables import require
from gristmill.streaming import events


def test_group_concat(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, ""), ("a", 4, "y"), ("a", 3, "x"), ("b", 1, None), (None, 1, "z")], "k string, o int, v string")
    assert {r.k: r.v for r in R.group_concat(df, "k", "v", ["o"]).collect()} == {"a": "x | y", "b": ""}


def test_profiles(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "a"), (3.0, None)], "x double, g string")
    assert {r.column_name: (r.nulls, r.filled) for r in R.null_profile(df).collect()} == {"x": (1, 2), "g": (1, 2)}
    d = R.describe(df, "x").first()
    assert (d.n, d.mean, d.middle) == (2, 2.0, 2.0)
    assert [tuple(r) for r in R.histogram(df.limit(0), "x", 4).collect()] == []
    assert {r.bin for r in R.histogram(df, "x", 4).collect()} == {0, 3}
    assert R.value_counts(df, "g").collect()[0].n == 2


def test_sample_is_exact_and_stable(spark):
    df = spark.range(50)
    a, b = [sorted(r.id for r in R.exact_sample(df, "id", 7).collect()) for _ in range(2)]
    assert a == b and len(a) == 7 and R.exact_sample(df, "id", 99).count() == 50


def test_upsert_twice_changes_nothing(spark):
    state = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = I.upsert(state, new, "k")
    assert sorted(once.collect()) == sorted(I.upsert(once, new, "k").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert [r.k for r in I.new_rows(new, state, "k").collect()] == [3]


def test_expiry(spark):
    df = spark.createDataFrame([(1, 100.0), (2, 90.0), (3, None)], "k int, ts double")
    assert [r.k for r in I.valid_entries(df, F.lit(100.0), 10).collect()] == [1]


def test_chunks_resume(spark, tmp_path):
    df = spark.range(25).withColumn("x", F.col("id") * 2)
    out = str(tmp_path / "chunks")
    assert I.run_chunks(df.filter("id < 10"), "id", 10, out, lambda d: d) == 10
    assert I.run_chunks(df, "id", 10, out, lambda d: d) == 15
    assert I.run_chunks(df, "id", 10, out, lambda d: d) == 0
    assert spark.read.parquet(out).count() == 25


def test_csv_keeps_what_was_written(spark, tmp_path):
    rows = [(1, ' a "quoted"\nline '), (2, None), (3, ""), (4, "x,y")]
    df = spark.createDataFrame(rows, "id int, t string")
    files.write_csv(df, str(tmp_path / "c"), null="\\N")
    assert sorted(files.read_csv(spark, str(tmp_path / "c"), df.schema, null="\\N").collect()) == sorted(df.collect())
    assert files.read_csv(spark, str(tmp_path / "none"), df.schema).count() == 0
    with pytest.raises(ValueError, match="nope"):
        files.read_csv(spark, str(tmp_path / "c"), df.schema, ["nope"])
    with pytest.raises(ValueError):
        require(df, "id", "zz")


def test_csv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes("﻿name,english\nx,y\n".encode())
    assert files.read_csv(spark, str(tmp_path / "b.csv"), "name string, english string").first().name == "x"
    assert files.csv_header(spark, str(tmp_path / "b.csv")) == ["name", "english"]
    assert files.list_files(spark, str(tmp_path)).count() == 1


def test_npy(spark, tmp_path):
    m = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "m.npy", m)
    df = files.read_npy(spark, str(tmp_path / "m.npy"))
    files.write_npy(df, "row", "embedding", str(tmp_path / "n.npy"))
    assert (np.load(tmp_path / "n.npy") == m).all()


def test_state(tmp_path):
    p = str(tmp_path / "s.json")
    assert files.read_state(p, {"a": 1}) == {"a": 1}
    files.write_state(p, {"b": 2})
    assert files.read_state(p, {}) == {"b": 2}
    (tmp_path / "s.json").write_text("{broken")
    assert files.read_state(p, {"c": 3}) == {"c": 3}


def test_log_round_trip(spark):
    df = spark.createDataFrame([("word_list", "a\nb", "pt", 0.5, 1.25)], "d string, t string, l string, c double, ms double")
    back = df.select(files.parse_log(files.log_text(*[F.col(c) for c in ("d", "t", "l", "c", "ms")])).alias("r")).first().r
    assert [tuple(x) for x in back] == [("word_list", "a\nb", "pt", 0.5, 1.25)]


def test_pages():
    page = '<div id="imgTagWrapperId"><img src="c"></div><img class="image-item" src="b"><img id="landingImage" src="a">'
    assert files.image_of_page(page) == "a"
    assert files.image_of_page("<img data-a-dynamic-image='{\"u1\": [1], \"u2\": [2]}'>") == "u1"
    assert files.image_of_page("<img data-a-dynamic-image='{broken'>") is None
    assert files.image_of_page("<img alt='A Product' src='p'>") == "p" and files.image_of_page("<p>no</p>") is None
    assert files.image_of_page('<div id="imgTagWrapperId"><img src="c"></div>') == "c" and files.image_of_page(None) is None


def test_plugins(spark):
    df = spark.createDataFrame([("a b",), ("a b",), ("",), (None,)], "t string")
    v = [r.v for r in plugins.encode(df, "t", "v").collect()]
    assert v[0] == v[1] and abs(sum(x * x for x in v[0]) - 1) < 1e-9 and set(v[2]) == {0.0}
    assert {r.s for r in plugins.score(df.withColumn("q", F.lit("x")), "q", "t", "s").collect()} == {0.0}
    one = spark.createDataFrame([([[1.0, 3.0], [3.0, 5.0], [9.0, 9.0]], [1, 1, 0], [0.0, 0.0])], "v array<array<double>>, m array<int>, l array<double>")
    r = one.select(plugins.mean_pool(F.col("v"), F.col("m")).alias("p"), plugins.softmax(F.col("l")).alias("s")).first()
    assert r.p == [2.0, 4.0] and r.s == [0.5, 0.5]


def test_stream_equals_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, f"2024-01-01 0{i % 3}:10:00", "a" if i % 2 else "b", float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "id int, t string, kind string, value double").withColumn("ts", F.to_timestamp("t"))
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    counted = events.tumbling_counts(stream, "ts", "kind", "value", late="10 minutes")
    q = counted.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("counted").collect()) == sorted(events.tumbling_counts(df, "ts", "kind", "value").collect())
    q = events.each_batch(stream, lambda d, n: d.write.mode("append").parquet(out), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(out).count() == 12


def test_sessions(spark):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:20:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "user int, t string").withColumn("ts", F.to_timestamp("t"))
    assert sorted((r.user, r.n) for r in events.session_counts(df, "ts", "user").collect()) == [(1, 1), (1, 2), (2, 1)]
