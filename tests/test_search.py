"""Search operators: hand-computed scores, properties, traps."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gristmill.operators import dense, fusion, sparse


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(0, "red cable red"), (1, "blue cable"), (2, "red mouse"), (3, None), (4, "")], "doc_id int, text string")


def test_bm25_by_hand(spark, corpus):
    index = sparse.fit_bm25(corpus.filter("doc_id < 3"), "doc_id", "text")
    assert {r.term: (r.cf, r.df) for r in index.vocabulary.collect()} == {"red": (3, 2), "cable": (2, 2)}
    assert {r.doc_id: r.dl for r in index.documents.collect()} == {0: 3, 1: 1, 2: 1}
    got = sparse.search_bm25(index, spark.createDataFrame([(1, "red red")], "query_id int, text string"), 10).collect()
    assert [(r.doc_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(2, 0.162843), (0, 0.15174)]


def test_bm25_empty_texts_count_as_documents(corpus):
    index = sparse.fit_bm25(corpus, "doc_id", "text")
    assert {r.doc_id: r.dl for r in index.documents.collect()}[3] == 0 and index.documents.count() == 5


def test_bm25_on_nothing(spark):
    df = spark.createDataFrame([], "doc_id int, text string")
    q = spark.createDataFrame([(1, "red")], "query_id int, text string")
    assert sparse.search_bm25(sparse.fit_bm25(df, "doc_id", "text"), q).count() == 0


def test_index_survives_writing(spark, corpus, tmp_path):
    index = sparse.fit_bm25(corpus, "doc_id", "text")
    index.save(str(tmp_path))
    q = spark.createDataFrame([(1, "red cable")], "query_id int, text string")
    again = sparse.Bm25Index.load(spark, str(tmp_path))
    assert sorted(sparse.search_bm25(index, q).collect()) == sorted(sparse.search_bm25(again, q).collect())


def test_scan_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [0.0] * 8), (903, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "doc_id long, v array<float>").repartition(3)
    q = df.filter("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    for metric in ("ip", "cosine", "l2"):
        got = {}
        for r in dense.scan_topk(df, q, 5, 8, metric).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = r.doc_id
        for i in (0, 50, 100, 150):
            y = x.astype(float)
            s = {"ip": y @ y[i], "cosine": y @ y[i] / np.linalg.norm(y, axis=1), "l2": -((y - y[i]) ** 2).sum(1)}[metric]
            best = [int(j) for j in np.argsort(-s)[:5]]
            mine = [got[i][k] for k in range(1, 6)]
            assert [j for j in mine if j < 900] == [j for j in best if j in mine] and len(set(best) & set(mine)) >= 4
    assert dense.scan_topk(df.limit(0), q, 5, 8).count() == 0 and dense.scan_topk(df, q.limit(0), 5, 8).count() == 0


def test_scan_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 4)))], "doc_id long, v array<double>")
    q = df.withColumnRenamed("doc_id", "query_id")
    whole = sorted(dense.scan_topk(df, q, 3, 4, "l2").collect())
    monkeypatch.setattr(dense, "QUERY_BLOCK", 25)
    monkeypatch.setattr(dense, "QUERY_NUMBERS", 0)
    assert sorted(dense.scan_topk(df, q, 3, 4, "l2").collect()) == whole and len(whole) == 180


def test_ties_follow_ids(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], "doc_id long, v array<double>").repartition(3)
    got = dense.scan_topk(df, df.filter("doc_id = 7").withColumnRenamed("doc_id", "query_id"), 4, 2).collect()
    assert [(r["rank"], r.doc_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_zscores_of_a_constant_dimension(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 4.0])], "id int, v array<double>")
    assert {(r.id, r.dim): r.z for r in dense.zscores(df, "id", "v").collect()} == {(1, 0): 0.0, (2, 0): 0.0, (1, 1): -1.0, (2, 1): 1.0}


def candidates(spark, rows, score):
    return spark.createDataFrame(rows, f"query_id int, doc_id int, {score} double")


def test_merge_keeps_first_or_both(spark):
    a, b = candidates(spark, [(1, 1, 2.0), (1, 1, 2.0), (1, 2, 1.0)], "a"), candidates(spark, [(1, 2, 9.0), (1, 3, 8.0)], "b")
    first = {r.doc_id: (r.a, r.b) for r in fusion.merge_candidates(a, b).collect()}
    assert first == {1: (2.0, None), 2: (1.0, None), 3: (None, 8.0)}
    both = {r.doc_id: (r.a, r.b) for r in fusion.merge_candidates(a, b, "outer").collect()}
    assert both == {1: (2.0, None), 2: (1.0, 9.0), 3: (None, 8.0)}
    with pytest.raises(ValueError):
        fusion.merge_candidates(a, b, "other")


def test_minmax_keeps_constants_and_nulls(spark):
    df = candidates(spark, [(1, 1, 2.0), (1, 2, 4.0), (1, 3, 4.0), (2, 1, 3.0), (2, 2, 3.0), (1, 4, None)], "s").withColumn("n", fusion.minmax("s"))
    assert {(r.query_id, r.doc_id): r.n for r in df.collect()} == {(1, 1): 0.0, (1, 2): 1.0, (1, 3): 1.0, (2, 1): 3.0, (2, 2): 3.0, (1, 4): None}


def test_rules_add_up_and_inject(spark):
    c = candidates(spark, [(1, 1, 0.5)], "hybrid_score")
    rules = candidates(spark, [(1, 1, 3.0), (1, 1, 1.0), (1, 2, 3.0), (1, 9, 3.0)], "boost")
    catalogue = spark.createDataFrame([(1,), (2,)], "doc_id int")
    assert {r.doc_id: r.hybrid_score for r in fusion.rule_boost(c, rules, catalogue).collect()} == {1: 4.5, 2: 6.0}


def test_review_boost_and_rerank(spark):
    c = candidates(spark, [(1, i, 1.0 - i / 10) for i in range(4)], "hybrid_score")
    reviews = spark.createDataFrame([(0, 0.8), (3, 1.0)], "doc_id int, review_score double")
    got = {r.doc_id: round(r.hybrid_score, 6) for r in fusion.review_boost(c, reviews, top=2).collect()}
    assert got == {0: 1.12, 1: 0.9, 2: 0.8, 3: 0.7}
    r = fusion.rerank(c, F.lit(0.0), top=2).collect()
    assert sorted((x.doc_id, x["rank"]) for x in r) == [(0, 1), (1, 2)]


def test_empty_terms_give_no_boost(spark):
    df = spark.createDataFrame([("A > USB Cables", [""]), ("A > USB Cables", ["cable"]), (None, ["cable"])], "p string, t array<string>")
    assert [r.b for r in df.select(fusion.path_boost(F.col("p"), F.col("t")).alias("b")).collect()] == [0.0, 2.0, 0.0]
    df = spark.createDataFrame([("Long WARRANTY", ["warranty", "warranty"]), (None, ["x"]), ("x", None)], "p string, t array<string>")
    assert [r.b for r in df.select(fusion.feature_boost(F.col("p"), F.col("t")).alias("b")).collect()] == [1.0, 0.0, 0.0]


def test_clustered_search_reaches_its_recall(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(900, 16)))] + [(9000, None), (9001, [1.0]), (9002, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "doc_id long, v array<double>").repartition(3)
    q = df.filter("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    exact = dense.scan_topk(df, q, 5, 16)
    got = dense.recall_of(dense.ivf_topk(df, "doc_id", "v", q, 5, 16), exact).first()
    assert got.queries == 90 and got.recall >= 0.9
    # Four cells of sixteen lose neighbours; all cells lose none.
    assert dense.recall_of(dense.ivf_topk(df, "doc_id", "v", q, 5, 16, 16, 4), exact).first().recall < 0.9
    assert sorted(dense.ivf_topk(df, "doc_id", "v", q, 5, 16, 16, 16).collect()) == sorted(exact.collect())
    assert dense.ivf_topk(df.limit(0), "doc_id", "v", q, 5, 16).count() == 0


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01", "sf0.1"])
def test_ivf_queries(spark, folder):
    folder = f"/root/testdata/{folder}"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    ids = {r.vec_id for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id").collect() if r.vec_id % 100 == 0}
    found = entry.queries()["ivf_topk"](spark, folder)
    assert {(r.query_id, r["rank"]) for r in found.collect()} == {(i, k) for i in ids for k in range(1, 11)}
    got = entry.queries()["ivf_recall"](spark, folder).first()
    assert got.queries == len(ids) and got.recall >= 0.9


def offers(spark, folder, names, stored):
    """Tables of offers (name, category, rating, rating_count) and of the stored candidates (query_id, text, product_id)."""
    rows = [(f"P{i}", n, c, None, None, r, k) for i, (n, c, r, k) in enumerate(names)]
    columns = "product_id string, product_name string, category string, about_product string, review_content string, rating string, rating_count string"
    spark.createDataFrame([*rows, rows[0]], columns).write.parquet(f"{folder}/catalog_raw.parquet")
    spark.createDataFrame(stored, "query_id long, query_text string, product_id string").write.parquet(f"{folder}/search_results.parquet")
    return str(folder)


def test_hybrid_search_finds_offers_outside_the_stored_lists(spark, tmp_path):
    names = [("steel bottle", "Kitchen", "4", "1"), ("red cable", "USB>Cables", "4", "1"), ("blue cable", "USB>Cables", "4", "1"), ("bottle rack", "Kitchen", "4", "1")]
    folder = offers(spark, tmp_path, names, [(1, "red cable", "P0"), (2, "red cable", "P0"), (3, "bottle", "P1"), (4, "zzz", "P1")])
    got = {}
    for r in entry.queries()["hybrid_search"](spark, folder).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.doc_id, r.score)
    assert got[1] == got[2] and got[1][1][0] == "P1" and got[1][2][0] == "P2" and got[1][1][1] > got[1][2][1] > 2
    assert {d for d, _ in list(got[3].values())[:2]} == {"P0", "P3"}


def test_hybrid_search_against_its_parts(spark):
    """Both pools computed here over all offers of the smallest tables, for one query at a time."""
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    from gristmill.operators.plugins import HashingEncoder

    stored = {}
    for r in spark.read.parquet(f"{folder}/search_results.parquet").collect():
        stored.setdefault(r.query_id, (r.query_text, set()))[1].add(r.product_id)
    rows = sorted({(r.product_id, " ".join(x for x in (r.product_name, r.category, r.about_product) if x is not None)) for r in spark.read.parquet(f"{folder}/catalog_raw.parquet").collect()})
    x = np.array(HashingEncoder().encode([t for _, t in rows]))
    found = {}
    for r in entry.queries()["hybrid_search"](spark, folder).collect():
        found.setdefault(r.query_id, []).append(r.doc_id)
    assert set(found) == set(stored) and any(set(found[q]) - stored[q][1] for q in found)
    index = sparse.fit_bm25(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string"), "doc_id", "text")
    for q, (text, _) in stored.items():
        s = np.round(x @ np.array(HashingEncoder().encode([text])[0]), 6)
        near = set(np.lexsort((np.arange(len(s)), -s))[:100].tolist())
        words = {r.doc_id for r in sparse.search_bm25(index, spark.createDataFrame([(1, text)], "query_id int, text string"), 100).collect()}
        assert {d for d in found[q]} <= {rows[i][0] for i in near | words}


def test_multimodal_improved_adds_every_gain(spark, tmp_path):
    names = [("red cable", "USBCables", "4,0", "50"), ("red cable", "Kitchen", "4", "100"), ("red cable", "Kitchen", "n/a", None), ("blue bottle", None, "5", "100")]
    folder = offers(spark, tmp_path, names, [(1, "red cable", "P3"), (2, "red cable", "P3")])
    got = {}
    for r in entry.queries()["multimodal_improved"](spark, folder).collect():
        got.setdefault(r.query_id, {})[r.doc_id] = (r.score, r["rank"])
    assert got[1] == got[2] and {d: k for d, (_, k) in got[1].items()} == {"P0": 1, "P1": 2, "P2": 3, "P3": 4}
    score = {d: x for d, (x, _) in got[1].items()}
    # P1 and P2 have equal texts: what parts them is the rating over 5 and the count over the largest.
    assert abs(score["P1"] - score["P2"] - 0.8 - 0.5) < 1e-6
    from gristmill.operators.plugins import HashingEncoder

    x = np.array(HashingEncoder().encode(["red cable", "red cable USBCables", "red cable Kitchen", "blue bottle"]))
    near = np.round(x @ x[0], 6)
    keyword = score["P1"] - 1.5 * near[2] - 1.3
    assert 0 < keyword < 1.5
    assert score["P0"] > 1.5 * near[1] + 2.0 + 0.8 + 0.25 and abs(score["P3"] - 1.5 * near[3] - 1.5) < 1e-6


def _written(spark, run):
    """(result of `run`, bytes that its checkpoints wrote)."""
    before, wrote = sparse.checkpointed, []

    def measured(df):
        out = before(df)
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
        wrote.append(sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files))
        return out

    folder = before(spark.range(1)) and spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    start = sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(sparse, "checkpointed", measured)
        return run(), max([0, *(w - start for w in wrote)])


def test_tfidf_search_writes_no_words(spark, tmp_path):
    # Every word of every text used to be written as a row.
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{j}" for j in rng.integers(0, 900, 200))) for i in range(2_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "w1 w2 w3"), (2, "W3 w2 w1"), (3, "none")], "query_id long, query_text string").write.parquet(str(tmp_path / "search_results.parquet"))
    got, wrote = _written(spark, lambda: entry.queries()["tfidf_topk"](spark, str(tmp_path)).collect())
    assert len(got) == 40 and wrote < 100_000


def test_best_by_tfidf_equals_joins(spark, monkeypatch):
    rng = np.random.default_rng(6)
    # Repeated ids, one of them null, whose texts count as one; equal texts, whose ids decide.
    rows = [(i % 70, " ".join(f"w{j}" for j in rng.integers(0, 40, rng.integers(0, 12)))) for i in range(100)]
    rows += [(None, "w1 w2"), (None, "w3"), (200, "w1 w5"), (201, "w1 w5"), (202, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame([(1, "w1 w2 w2"), (2, "W2, w1 w2"), (3, "unknown"), (4, "w5 w6 w7 w8"), (5, "")], "query_id long, text string")
    keep = lambda t: F.length(t) >= 2
    want = sorted(map(tuple, sparse.search_tfidf(*sparse.fit_tfidf(df.filter("doc_id IS NOT NULL"), "doc_id", "text", keep), q, keep, 7).collect()))
    mine = lambda d: sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in sparse.best_by_tfidf(d, "doc_id", "text", q, keep, 7).collect())
    assert mine(df.filter("doc_id IS NOT NULL")) == want and len(want) == 21
    named = df.filter("doc_id IS NOT NULL").select(F.format_string("d%03d", "doc_id").alias("doc_id"), "text")
    assert mine(named) == [(a, f"d{d:03d}", s, r) for a, d, s, r in want]
    one = spark.createDataFrame([(1, "w3 w1")], "query_id long, text string")
    of_null = [r for r in sparse.best_by_tfidf(df, "doc_id", "text", one, keep, 99).collect() if r.doc_id is None]
    assert len(of_null) == 1 and of_null[0].score > 0  # once, with the words of both rows
    for name, few in (("SENT_TERMS", 2), ("SCORES", 1), ("SENT_VOCABULARY", 5)):  # blocks of queries, of texts, and the other way
        with monkeypatch.context() as m:
            m.setattr(sparse, name, few)
            assert mine(df.filter("doc_id IS NOT NULL")) == want


def test_demo_search_writes_no_words(spark):
    # It used to write every word of every offer, and moved all texts to find the rows loaded twice.
    folder = "/root/testdata/sf0.01"
    got, wrote = _written(spark, lambda: entry.queries()["demo_search"](spark, folder).collect())
    assert len(got) == 125 and wrote < 300_000


def test_only_repeated_rows_are_gathered(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c"), (None, "d"), (None, "e"), (4, "f"), (4, "g")], "doc_id long, text string")
    seen = []

    def gather(several):
        seen.append(several.count())
        return several.distinct()

    got = sparse.where_repeated(df, "doc_id", gather).collect()
    assert seen == [6] and sorted(map(str, got)) == sorted(map(str, df.distinct().collect()))
    monkeypatch.setattr(sparse, "SENT_TERMS", 1)
    assert sparse.where_repeated(df, "doc_id", gather).count() == 7 and seen == [6, 8]
