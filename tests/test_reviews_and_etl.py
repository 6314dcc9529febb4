"""Review analysis, topic scores, the product job, file plug-ins, clustered index."""

import numpy as np
from pyspark.sql import functions as F

from gristmill.operators import dense, etl, plugins
from gristmill.operators import reviews as V


def test_review_scores(spark):
    rows = [("good good bad | ok",), (None,), ("  ",), ("broken",)]
    df = spark.createDataFrame(rows, "t string").select(V.analyse_reviews(V.first_reviews(F.col("t"))).alias("a"))
    got = [r.a for r in df.collect()]
    assert [round(a.sentiment_score, 4) for a in got] == [6.6667, 5.0, 5.0, 0.0]
    assert [a.general_sentiment for a in got] == ["positive", "neutral", "neutral", "negative"] and got[0].positive_features == ["good"]
    df = spark.createDataFrame([(8.0,), (None,)], "s double").select(V.review_score(F.col("s")).alias("r"))
    assert [r.r for r in df.collect()] == [0.8, 0.5]


def test_review_cache_expires(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, r string")
    empty = spark.createDataFrame([], "cache_key string, ts double, score double")
    answers, cache = V.cached_reviews(df, "id", "r", empty, F.lit(100.0), 50)
    assert {r.id: r.score for r in answers.collect()} == {1: 10.0, 2: 0.0}
    stale = cache.withColumn("score", F.lit(7.0))
    again, _ = V.cached_reviews(df, "id", "r", stale, F.lit(149.0), 50)
    assert {r.score for r in again.collect()} == {7.0}
    later, fresh = V.cached_reviews(df, "id", "r", stale, F.lit(151.0), 50)
    assert {r.id: r.score for r in later.collect()} == {1: 10.0, 2: 0.0} and {r.ts for r in fresh.collect()} == {151.0}


def test_topic_scores(spark):
    rows = [("The charger is good. The lamp is bad. A charger!",), ("Nothing.",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(V.topic_score(F.col("t"), ["charger"]).alias("s"))
    got = [r.s for r in df.collect()]
    assert got == [4.0, None, None]
    q = df.select(V.quality_of(F.col("s")).alias("q"))
    assert [r.q for r in q.collect()] == ["strong", "none", "none"]


def test_product_job(spark):
    products = spark.createDataFrame([("p1", "casa"), ("p1", "casa"), ("p2", None)], "product_id string, product_category_name string")
    tr = spark.createDataFrame([("casa", "home")], "product_category_name string, product_category_name_english string")
    items = spark.createDataFrame([("o1", "p1", 2.0), ("o1", "p1", 2.0), ("o2", "p1", 4.0), ("o3", None, 1.0)], "order_id string, product_id string, price double")
    reviews = spark.createDataFrame(
        [(1, "o1", "produto ótimo", 5, "2024-01-01"), (2, "o2", "", 3, "2024-01-02"), (3, "o9", "lost", 1, "2024-01-03")],
        "review_id int, order_id string, review_comment_message string, review_score int, created_at string",
    )
    t = {r.product_id: r for r in etl.product_table(products, tr, items, reviews).collect()}
    assert t["p1"].reviews == "produto ótimo" and t["p1"].mean_score == 4.0 and t["p1"].price == 3.0 and t["p1"].product_category_name_english == "home"
    assert t["p2"].reviews is None and t["p2"].price is None and len(t) == 2
    s = {r.product_id: r for r in etl.searchable(etl.product_table(products, tr, items, reviews)).collect()}
    assert s["p1"].detected_language == "pt" and s["p2"].detected_language == "no_content" and s["p2"].original_text == "product: p2"


def test_reports(spark):
    a = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 8, 1), (1, 9, 2)], "query_id int, doc_id int, rank int")
    assert {r.doc_id: r.moved for r in etl.compare_rankings(a, b).collect()} == {7: None, 8: 1, 9: None}
    assert etl.shown(a, ["doc_id", "nope"]).columns == ["doc_id"] and "<table" in etl.html_report(a, ["rank"])
    n, seconds = etl.timed(a.count)
    assert n == 2 and seconds >= 0


def test_files(spark, tmp_path):
    (tmp_path / "p1.jpg").write_bytes(b"\xff" * 9)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    more = files.unionAll(spark.createDataFrame([("x/none.jpg", None)], "path string, content binary"))
    v = {r.path[-6:]: r.embedding for r in plugins.embed_files(more, plugins.ByteCountEncoder, 16).collect()}
    assert v["p1.jpg"][15] == 1.0 and set(v["ne.jpg"]) == {0.0}
    c = {r.path[-6:]: r.caption for r in plugins.caption(more, plugins.SizeCaptioner).collect()}
    assert c == {"p1.jpg": "file of 9 bytes", "ne.jpg": None}
    df = spark.createDataFrame([("p1",), ("p3",)], "product_id string")
    have, lack = etl.with_files(df, files.select("path"), "product_id")
    assert [r.product_id for r in have.collect()] == ["p1"] and [r.product_id for r in lack.collect()] == ["p3"]


def test_failing_detector(spark):
    df = spark.createDataFrame([("não",), (None,)], "t string")
    r = plugins.detect(plugins.detect(df, "t", "a", plugins.AccentDetector), "t", "b", plugins.FailingDetector).collect()
    assert [x.a.language for x in r] == ["pt", "unknown"] and {x.b.method_used for x in r} == {"broken_failed"}


def test_saved_cells_prune_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, 0.1, (30, 4)) for m in (-5, 0, 5)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    placed, centres = dense.kmeans_cells(df, "id", "v", 3)
    dense.save_cells(placed, centres, str(tmp_path))
    q = x[80].tolist()
    got = dense.search_cells(spark, str(tmp_path), "id", "v", q, 3, 1)
    want = sorted(range(90), key=lambda i: -round(float(x[i] @ x[80]), 6))[:3]
    assert [r.doc_id for r in got.collect()] == want
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "cell_id" in plan
