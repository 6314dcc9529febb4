"""Sparse, dense and hybrid search queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.functions import vectors as V
from gristmill.functions.numbers import read_count, read_count_sql, read_money, read_rating
from gristmill.operators import analysis as A
from gristmill.operators import dense, fusion, sparse
from gristmill.operators.plugins import encode
from gristmill.session import checkpointed
from gristmill.sources.tables import table

K = 10
#: Candidates that each list of a hybrid search takes from the whole corpus.
POOL = 100


def _docs(s: SparkSession, sf: str) -> DataFrame:
    return table(s, sf, "documents").select("doc_id", "text")


def _queries(s: SparkSession, sf: str) -> DataFrame:
    return table(s, sf, "search_results").select("query_id", F.col("query_text").alias("text")).distinct()


def _index(s: SparkSession, sf: str, **params) -> sparse.Bm25Index:
    stemmed = params.pop("stemmed", False)
    return sparse.fit_bm25(_docs(s, sf), "doc_id", "text", sparse.Bm25Params(**params), stemmed=stemmed)


def tokenize_counts(s, sf):
    """Occurrences of every token of the corpus."""
    c = sparse.term_counts(_docs(s, sf), "doc_id", "text")
    return c.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


def term_stats(s, sf):
    v = _index(s, sf).vocabulary
    return v.select("term", "cf", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(s, sf, **params):
    return sparse.search_bm25(_index(s, sf, **params), _queries(s, sf), 20)


def bm25_corpus_totals(s, sf):
    d = _index(s, sf).documents
    return d.agg(F.count("*").alias("n"), F.sum("dl").alias("total"), F.round(F.avg("dl"), 6).alias("avgdl"))


def key_terms(s, sf):
    return sparse.key_terms(_index(s, sf), _queries(s, sf), 5)


def tfidf_topk(s, sf):
    return sparse.best_by_tfidf(_docs(s, sf), "doc_id", "text", _queries(s, sf), T.is_long_token, 20).drop("gain")


def tfidf_top_features(s, sf):
    return sparse.top_features(_docs(s, sf), "doc_id", "text", T.is_search_token, 20)


_TOK = "list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+'), lambda t: length(t) >= 2)"
_STOPS = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_STOK = f"list_filter({_TOK}, lambda t: NOT contains(t, '_') AND NOT list_contains({_STOPS}, t))"


def _counts_sql(tok: str) -> str:
    return f"counted AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tok}) AS term FROM documents) GROUP BY doc_id, term)"


_QUERIES_SQL = "queries AS (SELECT DISTINCT query_id, query_text AS text FROM search_results)"


def _bm25_sql(frequency: str = "cf", before: str = "", queries: str = _QUERIES_SQL) -> str:
    return f"""
    WITH {before} {_counts_sql(_STOK)},
    n AS (SELECT count(*)::DOUBLE AS n FROM documents),
    vocabulary AS (
        SELECT term, cf, df, ln(((SELECT n FROM n) + 1.0::DOUBLE) / ({frequency} + 0.5::DOUBLE)) AS idf
        FROM (SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM counted GROUP BY term) WHERE df >= 2),
    postings AS (SELECT c.* FROM counted c JOIN vocabulary USING (term)),
    docs AS (
        SELECT d.doc_id, coalesce(l.dl, 0)::BIGINT AS dl FROM documents d
        LEFT JOIN (SELECT doc_id, sum(tf) AS dl FROM postings GROUP BY doc_id) l USING (doc_id)),
    {queries},
    terms AS (SELECT DISTINCT query_id, unnest({_STOK}) AS term FROM queries),
    scored AS (
        SELECT query_id, doc_id, round(sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avg(dl) FROM docs)))), 6) AS score
        FROM terms JOIN vocabulary USING (term) JOIN postings USING (term) JOIN docs USING (doc_id) GROUP BY query_id, doc_id)
    """


def _top(source: str, k: int, order: str = "score DESC, doc_id") -> str:
    return f"""SELECT query_id, doc_id, score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM {source}) WHERE rank <= {k}"""


_TFIDF = f"""
    WITH {_counts_sql(_TOK)},
    vocabulary AS (
        SELECT term, ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) + 1.0::DOUBLE AS idf
        FROM counted GROUP BY term),
    raw AS (SELECT doc_id, term, tf * idf AS x FROM counted JOIN vocabulary USING (term)),
    weights AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS w FROM raw)
"""


def _vectors(s: SparkSession, sf: str) -> DataFrame:
    return table(s, sf, "combined_embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))


def _asked(df: DataFrame) -> DataFrame:
    return df.filter(F.col("doc_id") % 100 == 0).withColumnRenamed("doc_id", "query_id")


def vector_topk(s, sf, metric):
    df = _vectors(s, sf)
    return dense.scan_topk(df, _asked(df), K, 64, metric)


def self_retrieval(s, sf):
    """Each query vector's best match by cosine is a vector equal to it up to length."""
    df = _vectors(s, sf)
    top = dense.scan_topk(df, _asked(df), 1, 64, "cosine")
    return top.select("query_id", "score")


def unit_norm_check(s, sf):
    v = F.col("embedding")
    return table(s, sf, "combined_embeddings").select("vec_id", F.round(V.norm(v), 6).alias("norm"), F.round(V.norm(V.unit(v)), 6).alias("unit_norm"))


def pair_similarity(s, sf):
    """Similarity and distance of each full vector and the one of the next id."""
    df = table(s, sf, "combined_embeddings").filter("embedding_dimension = 64").select("vec_id", "embedding")
    a, b = df.alias("a"), df.alias("b")
    return a.join(b, F.col("a.vec_id") + 1 == F.col("b.vec_id")).select(
        F.col("a.vec_id").alias("vec_id_a"),
        F.col("b.vec_id").alias("vec_id_b"),
        F.round(V.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("cosine"),
        F.round(V.squared_distance(F.col("a.embedding"), F.col("b.embedding")), 6).alias("distance"),
    )


def zscore_stats(s, sf):
    df = table(s, sf, "embeddings")
    z = dense.zscores(df, "vec_id", "embedding")
    return z.groupBy("dim").agg(F.count("*").alias("n"), F.round(F.sum(F.abs("z")), 4).alias("total"))


def zscore_concat(s, sf):
    df = table(s, sf, "embeddings").select("vec_id", "embedding", F.transform("embedding", lambda x: x * x).alias("squares"))
    return dense.zscore_concat(df, "vec_id", "embedding", "squares")


def _clustered(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All vectors, those of them that ask, and what the clustered index finds."""
    df = table(s, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    return df, _asked(df), dense.ivf_topk(df, "doc_id", "v", _asked(df), K, 64)


def ivf_topk(s, sf):
    """Every hundredth vector against all, by a clustered index."""
    return _clustered(s, sf)[2]


def ivf_recall(s, sf):
    """Share of the true nearest that the clustered index finds."""
    df, asked, found = _clustered(s, sf)
    return dense.recall_of(found, dense.scan_topk(df, asked, K, 64))


def _found(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The stored candidate lists of each query: those with a sparse score, and those with a dense score."""
    df = table(s, sf, "search_results").distinct().withColumnRenamed("product_id", "doc_id")
    sparse_list = df.filter("bm25_score > 0").select("query_id", "doc_id", "bm25_score")
    return sparse_list, df.select("query_id", "doc_id", "vector_score")


def _hybrid(s: SparkSession, sf: str, how: str) -> DataFrame:
    return fusion.fuse(fusion.merge_candidates(*_found(s, sf), how), {"bm25_score": 0.4, "vector_score": 0.6})


def hybrid(s, sf, how):
    top = fusion.head(_hybrid(s, sf, how), "hybrid_score", 5)
    return top.select("query_id", "doc_id", F.round("hybrid_score", 6).alias("score"), "rank")


_HYBRID = """
    WITH r AS (SELECT DISTINCT query_id, product_id AS doc_id, bm25_score, vector_score FROM search_results),
    a AS (SELECT query_id, doc_id, max(bm25_score) AS bm25_score FROM r WHERE bm25_score > 0 GROUP BY ALL),
    b AS (SELECT query_id, doc_id, max(vector_score) AS vector_score FROM r GROUP BY ALL),
    merged_keep_first AS (
        SELECT query_id, doc_id, bm25_score, NULL::DOUBLE AS vector_score FROM a
        UNION ALL SELECT query_id, doc_id, NULL, vector_score FROM b ANTI JOIN a USING (query_id, doc_id)),
    merged_outer AS (SELECT query_id, doc_id, bm25_score, vector_score FROM a FULL JOIN b USING (query_id, doc_id))
"""


def _fused_sql(merged: str) -> str:
    norm = lambda c: f"CASE WHEN max({c}) OVER q > min({c}) OVER q THEN ({c} - min({c}) OVER q) / (max({c}) OVER q - min({c}) OVER q) ELSE {c} END"
    return f"""{_HYBRID}, fused AS (
        SELECT query_id, doc_id, coalesce({norm('bm25_score')}, 0) * 0.4::DOUBLE + coalesce({norm('vector_score')}, 0) * 0.6::DOUBLE AS h
        FROM {merged} WINDOW q AS (PARTITION BY query_id))"""


def _offers(s: SparkSession, sf: str) -> DataFrame:
    """Offers once each under the name of candidates."""
    return table(s, sf, "catalog_raw").select(F.col("product_id").alias("doc_id"), "product_name", "category", "about_product", "review_content").distinct()


def _with_gains(candidates: DataFrame, queries: DataFrame, offers: DataFrame) -> DataFrame:
    """Candidates with their offers, the analysis of their query, and both boosts."""
    q = queries.select("query_id", A.product_type(F.col("text")).alias("kind"), A.key_features(F.col("text"), A.DEMO_FEATURES).alias("features"))
    c = candidates.join(q, "query_id").join(offers, "doc_id")
    text = F.concat_ws(" ", "product_name", "category", "about_product", "review_content")
    return c.withColumns(
        {"category_gain": fusion.path_boost(F.col("category"), A.category_terms(F.col("kind"))), "feature_gain": fusion.feature_boost(text, F.col("features"))}
    )


def _boosted(s: SparkSession, sf: str) -> DataFrame:
    """Fused stored candidates with both boosts."""
    return _with_gains(_hybrid(s, sf, "outer"), _queries(s, sf), _offers(s, sf))


def category_boost(s, sf):
    return _boosted(s, sf).select("query_id", "doc_id", "category_gain")


def feature_boost(s, sf):
    return _boosted(s, sf).select("query_id", "doc_id", "feature_gain")


def boosted_search(s, sf):
    c = _boosted(s, sf).withColumn("hybrid_score", F.round(F.col("hybrid_score") + F.col("category_gain") + F.col("feature_gain"), 9))
    return fusion.head(c, "hybrid_score", K).select("query_id", "doc_id", F.col("hybrid_score").alias("score"), "rank")


def _numbered_offers(s: SparkSession, sf: str, *more: str) -> DataFrame:
    """Every offer under a number, `doc_id`, in the order of its product_id, with the text that is searched."""
    offers = table(s, sf, "catalog_raw").select("product_id", "product_name", "category", "about_product", "review_content", "rating", "rating_count", *more).distinct()
    text = F.concat_ws(" ", "product_name", "category", "about_product")
    return checkpointed(offers.orderBy("product_id").select(F.monotonically_increasing_id().alias("doc_id"), "*", text.alias("text")))


def _texts(s: SparkSession, sf: str) -> DataFrame:
    """The different query texts, each under the smallest query_id that asks it."""
    return _queries(s, sf).groupBy("text").agg(F.min("query_id").alias("query_id"))


def _nearest(offers: DataFrame, texts: DataFrame, column: str, k: int, to: str) -> DataFrame:
    """The `k` offers whose encoded column is nearest to the encoded query, of all offers."""
    vectors = encode(offers.select("doc_id", F.col(column).alias("text")), "text", "v").select("doc_id", "v")
    found = dense.scan_topk(vectors, encode(texts, "text", "v").select("query_id", "v"), k, 64, "cosine")
    return found.select("query_id", "doc_id", F.col("score").alias(to))


def _for_all_who_ask(s: SparkSession, sf: str, results: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, doc_id, score, rank): results of a text for each query of this text, offers by their own id."""
    of_text = results.join(texts, "query_id").select(F.col("text"), F.col("product_id").alias("doc_id"), "score", "rank")
    return _queries(s, sf).join(of_text, "text").select("query_id", "doc_id", "score", "rank")


def hybrid_search(s, sf):
    """BM25 and a dense scan over all offers for every query text; both pools are fused and boosted."""
    offers, texts = _numbered_offers(s, sf), checkpointed(_texts(s, sf))
    words = sparse.search_bm25(sparse.fit_bm25(offers, "doc_id", "text"), texts, POOL)
    words = words.select("query_id", "doc_id", F.col("score").alias("bm25_score"))
    near = _nearest(offers, texts, "text", POOL, "vector_score")
    c = fusion.fuse(fusion.merge_candidates(words, near, "outer"), {"bm25_score": 0.4, "vector_score": 0.6})
    c = _with_gains(c, texts, offers.drop("text"))
    c = c.withColumn("score", F.round(F.col("hybrid_score") + F.col("category_gain") + F.col("feature_gain"), 9))
    return _for_all_who_ask(s, sf, fusion.head(c, "score", K), texts)


def hybrid_reranked(s, sf):
    """The whole course of a search: analysis, two pools of all offers, keep-first merging, the bound of the query, boosts,
    rules, reviews on the first 20, reranking of the first 10."""
    offers, texts = _numbered_offers(s, sf, "discounted_price"), checkpointed(_texts(s, sf))
    words = sparse.search_bm25(sparse.fit_bm25(offers, "doc_id", "text"), texts, POOL)
    words = words.select("query_id", "doc_id", F.col("score").alias("bm25_score"))
    near = _nearest(offers, texts, "text", POOL, "vector_score")
    c = fusion.fuse(fusion.merge_candidates(words, near), {"bm25_score": 0.4, "vector_score": 0.6})
    asked = texts.select("query_id", A.analyse(F.col("text")).alias("a"))
    c = c.join(asked, "query_id").join(offers.drop("text", "rating_count"), "doc_id")
    c = c.filter(fusion.below(read_money(F.col("discounted_price")), F.col("a.price_constraint")))
    everything = F.concat_ws(" ", "product_name", "category", "about_product", "review_content")
    gain = fusion.path_boost(F.col("category"), A.category_terms(F.col("a.product_type"))) + fusion.feature_boost(everything, F.col("a.key_features"))
    scored = c.select("query_id", "doc_id", F.round(F.col("hybrid_score") + gain, 9).alias("hybrid_score"))
    # Rules are data: the first offer of all is pinned to every query that asks for a cable.
    first = offers.select(F.min("doc_id")).scalar()
    rules = asked.filter("a.product_type = 'cable'").select("query_id", first.alias("doc_id"), F.lit(3.0).alias("boost"))
    scored = fusion.rule_boost(scored, rules, offers.select("doc_id"))
    reviews = offers.select("doc_id", (read_rating(F.col("rating")) / 5).alias("review_score"))
    scored = fusion.review_boost(scored, reviews).drop("review_score").join(offers.select("doc_id", "product_name", "about_product"), "doc_id")
    top = fusion.rerank(scored, A.wording_boost(F.concat_ws(" ", "product_name", "about_product")), places="rank")
    return _for_all_who_ask(s, sf, top.filter(F.col("rank") <= 5).withColumn("score", F.col("final_score")).join(offers.select("doc_id", "product_id"), "doc_id"), texts)


def rule_boost(s, sf):
    """Rules as data: each query's last candidate by id is lifted, and an offer of every second query comes in."""
    c = _hybrid(s, sf, "outer")
    last = c.groupBy("query_id").agg(F.max("doc_id").alias("doc_id")).withColumn("boost", F.lit(3.0))
    offers = _offers(s, sf)
    first = offers.select(F.min("doc_id")).scalar()
    extra = last.filter("query_id % 2 = 0").select("query_id", first.alias("doc_id"), F.lit(3.0).alias("boost"))
    out = fusion.rule_boost(c, last.unionByName(extra.select("query_id", "doc_id", "boost")), offers)
    return fusion.head(out, "hybrid_score", 5).select("query_id", "doc_id", F.round("hybrid_score", 6).alias("score"), "rank")


def review_boost(s, sf):
    ratings = table(s, sf, "catalog_raw").select(F.col("product_id").alias("doc_id"), (read_rating(F.col("rating")) / 5).alias("r"))
    ratings = ratings.groupBy("doc_id").agg(F.max("r").alias("review_score"))
    out = fusion.review_boost(_hybrid(s, sf, "outer"), ratings)
    return out.select("query_id", "doc_id", F.round("hybrid_score", 9).alias("score"), "rank")


def rerank_fusion(s, sf):
    c = _hybrid(s, sf, "outer").join(_offers(s, sf), "doc_id")
    semantic = A.wording_boost(F.concat_ws(" ", "product_name", "about_product"))
    return fusion.rerank(c, semantic).select("query_id", "doc_id", F.col("final_score").alias("score"), "rank")


def constant_rerank(s, sf):
    """Reranking by a scorer that gives every pair 0 keeps the order of the first ten."""
    return fusion.rerank(_hybrid(s, sf, "outer"), F.lit(0.0)).select("query_id", "doc_id", F.col("final_score").alias("score"), "rank")


def custom_boost(s, sf):
    return table(s, sf, "documents").select("doc_id", A.wording_boost(F.col("text")).alias("boost"))


def _multimodal(s: SparkSession, sf: str, pools: tuple[int, int], categories: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, Column]:
    """Candidates of two dense pools over all offers with their facts, the query texts, and the score both multimodal searches share.

    The first pool is by the whole text; the second by the name, which stands for the picture. Without price terms.
    """
    offers, texts = _numbered_offers(s, sf), checkpointed(_texts(s, sf))
    found = _nearest(offers, texts, "text", pools[0], "text_score"), _nearest(offers, texts, "product_name", pools[1], "image_score")
    c = checkpointed(fusion.merge_candidates(*found))
    w, v = sparse.fit_tfidf(offers, "doc_id", "text", T.is_long_token, 5000)
    keyword = sparse.score_tfidf(w, v, texts, T.is_long_token, c).withColumnRenamed("score", "keyword_score")
    kinds = texts.select("query_id", A.product_type(F.col("text")).alias("kind"))
    facts = offers.select("doc_id", "product_id", "category", F.coalesce(read_rating(F.col("rating")), F.lit(0.0)).alias("rating"), read_count(F.col("rating_count")).alias("count"))
    c = c.join(keyword, fusion.KEYS, "left").join(kinds, "query_id").join(facts, "doc_id")
    zero = F.lit(0.0)
    score = F.coalesce("text_score", zero) * 1.5 + F.coalesce("image_score", zero) * 0.5
    score += fusion.path_boost(F.col("category"), categories(F.col("kind"))) + F.coalesce("keyword_score", zero) * 1.5
    return c, texts, score


def multimodal_search(s, sf):
    """Both pools of 250, the narrow category lists, keywords."""
    c, texts, score = _multimodal(s, sf, (250, 250), lambda kind: F.slice(A.multimodal_categories(kind), 1, 1))
    return _for_all_who_ask(s, sf, fusion.head(c.withColumn("score", F.round(score, 9)), "score", 5), texts)


def multimodal_improved(s, sf):
    """Pools of 250 and 100, wide category lists, keywords, rating and popularity."""
    c, texts, score = _multimodal(s, sf, (250, 100), A.multimodal_categories)
    score += F.col("rating") / 5 + fusion.over_max("count", "query_id") * 0.5
    return _for_all_who_ask(s, sf, fusion.head(c.withColumn("score", F.round(score, 9)), "score", 5), texts)


def demo_search(s, sf):
    """Keyword score plus boosts with labels of relevance, over all offers; an offer without either does not come out.

    Kinds and features are few, so offers fall into few profiles of what they have and queries into few of what they want; what
    these share is worked out once for each pair. Offers without a keyword differ only in their profile, so of each the first
    five can come out at most.
    """
    queries, k = _queries(s, sf), 5
    rows = table(s, sf, "catalog_raw").select(F.col("product_id").alias("doc_id"), "product_name", "category", "about_product", "review_content")
    # Only rows whose id is repeated are compared with each other; the texts of all others stay where they are.
    offers = sparse.where_repeated(rows, "doc_id", DataFrame.distinct)
    offers = offers.select("doc_id", "category", F.concat_ws(" ", "product_name", "category", "about_product").alias("text"))
    kinds, features = [name for name, _ in A.DEMO_TYPES], [name for name, _ in A.DEMO_FEATURES]
    has = [F.when(F.coalesce(F.contains(F.lower("category"), F.lit(x)), F.lit(False)), F.lit(x)) for x in kinds]
    has += [F.when(F.contains(F.lower("text"), F.lit(x)), F.lit(x)) for x in features]
    offers = offers.withColumn("has", F.array_compact(F.array(*has))).withColumn("profile", F.xxhash64("has"))
    kind = F.nullif(A.product_type(F.col("text"), A.DEMO_TYPES), F.lit(""))
    asked = queries.select("query_id", "text", F.array_compact(F.array_append(A.key_features(F.col("text"), A.DEMO_FEATURES), kind)).alias("wants"))
    asked = checkpointed(asked.withColumn("wish", F.xxhash64("wants")))
    first = checkpointed(sparse.top_k(offers.select("profile", "doc_id", "has"), "profile", [F.col("doc_id")], k).drop("rank"))
    what = lambda df, by, of: df.groupBy(by).agg(F.first(of).alias(of)).select(by, F.explode(of).alias("one"))
    gain = F.sum(F.when(F.col("one").isin(kinds), 2.0).otherwise(0.5)).alias("semantic")
    gains = checkpointed(what(asked, "wish", "wants").join(what(first, "profile", "has"), "one").groupBy("wish", "profile").agg(gain))

    found = sparse.best_by_tfidf(offers, "doc_id", "text", asked.select("query_id", "text", "wish"), T.is_long_token, k, 5000, gains.withColumnRenamed("semantic", "gain"))
    hits = found.select("query_id", "doc_id", "score", F.col("gain").alias("semantic"))
    without = sparse.top_k(gains.join(first.drop("has"), "profile"), "wish", [F.col("semantic").desc(), F.col("doc_id")], k)
    without = asked.select("query_id", "wish").join(without, "wish").select("query_id", "doc_id", F.lit(0.0).alias("score"), "semantic")

    final = lambda df: df.withColumn("final_score", F.round(F.col("score") + F.col("semantic"), 6)).filter("final_score > 0")
    best = final(hits).unionByName(final(without))
    c = fusion.head(best.groupBy("query_id", "doc_id").agg(*[F.max(c).alias(c) for c in ("score", "semantic", "final_score")]), "final_score", k)
    return c.select(
        "query_id", "doc_id", "final_score", "rank",
        fusion.relevance_label(F.col("score"), 0.1, 0.2).alias("keyword_label"), fusion.relevance_label(F.col("semantic"), 1, 2).alias("semantic_label"),
    )


def rank_of_target(s, sf):
    """Where the best rated candidate of each query came out."""
    c = fusion.ranked(_hybrid(s, sf, "outer"), "hybrid_score")
    targets = c.groupBy("query_id").agg(F.min("doc_id").alias("doc_id"))
    return fusion.hit_at_k(c, targets, 5)


def union_dedup_keep_first(s, sf):
    a, b = _found(s, sf)
    return fusion.merge_candidates(a, b).withColumns({c: F.round(c, 6) for c in ("bm25_score", "vector_score")})


def query_analysis_rules(s, sf):
    a = A.analyse(F.col("text"))
    return _queries(s, sf).select("query_id", a["product_type"].alias("product_type"), F.array_join(a["key_features"], ",").alias("key_features"), a["price_constraint"].alias("price_constraint"))


def price_constraint_extract(s, sf):
    d = table(s, sf, "documents")
    return d.select("doc_id", A.upper_bound(F.concat(F.lit("under "), F.regexp_extract("text", r"Price: ([0-9.]+ USD)", 1))).alias("bound"))


def json_repair_parse(s, sf):
    """Answers in several broken notations, made from the events, parsed back."""
    e = table(s, sf, "events")
    k = F.regexp_extract("props", r"(\d+)", 1)
    text = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"score": '), k, F.lit("}")))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("Answer: {score: "), k, F.lit(",} done")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit("I rate this "), k, F.lit(" of 100")))
        .otherwise(F.lit("product_type: usb cable"))
    )
    p = A.parse_answer(text)
    return e.select("event_id", p["score"].alias("score"), p["product_type"].alias("product_type"))


QUERIES = {
    "tokenize_counts": tokenize_counts, "term_stats": term_stats, "bm25_topk": bm25_topk,
    "bm25_docfreq_topk": partial(bm25_topk, frequency="document"), "bm25_stemmed_topk": partial(bm25_topk, stemmed=True),
    "bm25_corpus_totals": bm25_corpus_totals, "key_terms": key_terms, "tfidf_topk": tfidf_topk, "tfidf_top_features": tfidf_top_features,
    "inner_product_topk": partial(vector_topk, metric="ip"), "cosine_topk": partial(vector_topk, metric="cosine"),
    "l2_topk": partial(vector_topk, metric="l2"), "self_retrieval": self_retrieval, "unit_norm_check": unit_norm_check,
    "pair_similarity": pair_similarity, "zscore_stats": zscore_stats, "zscore_concat": zscore_concat, "ivf_topk": ivf_topk, "ivf_recall": ivf_recall,
    "hybrid_keep_first": partial(hybrid, how="keep_first"), "hybrid_outer": partial(hybrid, how="outer"), "category_boost": category_boost,
    "feature_boost": feature_boost, "boosted_search": boosted_search, "hybrid_search": hybrid_search, "hybrid_reranked": hybrid_reranked, "rule_boost_inject": rule_boost, "review_boost": review_boost,
    "rerank_fusion": rerank_fusion, "constant_rerank": constant_rerank, "custom_boost": custom_boost, "multimodal_search": multimodal_search, "multimodal_improved": multimodal_improved,
    "demo_search": demo_search, "rank_of_target": rank_of_target, "union_dedup_keep_first": union_dedup_keep_first,
    "query_analysis_rules": query_analysis_rules, "price_constraint_extract": price_constraint_extract, "json_repair_parse": json_repair_parse,
}


def _vector_sql(score: str, k: int = K, order: str = "score DESC, doc_id") -> str:
    return f"""
    WITH c AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM combined_embeddings WHERE len(embedding) = 64),
    scored AS (
        SELECT q.doc_id AS query_id, c.doc_id, round({score}, 6) AS score FROM c JOIN c q ON q.doc_id % 100 = 0)
    {_top("(SELECT * FROM scored WHERE NOT isnan(score))", k, order)}"""


_BOOST = (
    _fused_sql("merged_outer")
    + """, queries AS (SELECT DISTINCT query_id, lower(query_text) AS t FROM search_results),
    offers AS (SELECT DISTINCT product_id AS doc_id, product_name, category, about_product, review_content FROM catalog_raw),
    joined AS (
        SELECT f.*, o.category, lower(concat_ws(' ', product_name, category, about_product, review_content)) AS text,
            CASE WHEN regexp_matches(t, 'cable|charger|cord') THEN ['cable', 'charger', 'usb', 'lightning']
                 WHEN regexp_matches(t, 'headset|headphone|earphone|earbud') THEN ['headphone', 'headset', 'earphone', 'earbuds'] ELSE [] END AS terms,
            list_filter([
                CASE WHEN contains(t, 'quality') THEN 'high quality' END,
                CASE WHEN contains(t, 'fast') AND contains(t, 'charging') THEN 'fast charging' END,
                CASE WHEN contains(t, 'noise') AND contains(t, 'cancel') THEN 'noise cancellation' END,
                CASE WHEN contains(t, 'warranty') THEN 'warranty' END, CASE WHEN contains(t, 'wireless') THEN 'wireless' END,
                CASE WHEN contains(t, 'battery') THEN 'long battery life' END], lambda f: f IS NOT NULL) AS features
        FROM fused f JOIN queries USING (query_id) JOIN offers o USING (doc_id)),
    gains AS (
        SELECT query_id, doc_id, h,
            CASE WHEN len(list_filter(terms, lambda x: contains(lower(category), x))) > 0 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS category_gain,
            len(list_filter(features, lambda x: contains(text, x))) * 0.5::DOUBLE AS feature_gain
        FROM joined)"""
)

_WORDING = """CASE WHEN contains(t, 'wireless') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN contains(t, 'excellent noise cancellation') THEN 2.0::DOUBLE
           WHEN contains(t, 'noise cancellation') OR contains(t, 'anc') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"""

_RERANK = f""", first AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY h DESC, doc_id) AS r FROM cand) WHERE r <= 10),
    final AS (
        SELECT query_id, doc_id, round(CASE WHEN max(h) OVER q > min(h) OVER q
            THEN (h - min(h) OVER q) / (max(h) OVER q - min(h) OVER q) * 10.0::DOUBLE ELSE h END * 0.3::DOUBLE + semantic * 0.7::DOUBLE, 6) AS score
        FROM first WINDOW q AS (PARTITION BY query_id))
    {_top("final", 10)}"""

_OUTER = _fused_sql("merged_outer")

_RATING = "try_cast(replace(nullif(regexp_extract(rating, '([0-9]+([.,][0-9]{1,2})?)', 1), ''), ',', '.') AS DOUBLE)"
_COUNT = read_count_sql("rating_count")
_MONEY = "try_cast(replace(nullif(regexp_extract(discounted_price, '([0-9][0-9,]*([.][0-9]+)?)', 1), ''), ',', '') AS DOUBLE)"
#: All offers as documents, and the different query texts.
_ALL_OFFERS = """documents AS (
        SELECT product_id AS doc_id, concat_ws(' ', product_name, category, about_product) AS text, * FROM (
            SELECT DISTINCT product_id, product_name, category, about_product, review_content, rating, rating_count, discounted_price FROM catalog_raw)),"""
_ALL_TEXTS = "queries AS (SELECT query_text AS text, min(query_id) AS query_id FROM search_results GROUP BY query_text)"


def _encoded_sql(source: str, key: str, column: str, to: str) -> str:
    """The hashing encoder in SQL: components `<to>_v` and lengths `<to>_n` of the vectors of a column."""
    return f"""{to}_h AS (
        SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM (SELECT {key}, unnest(regexp_extract_all(lower(coalesce({column}, '')), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM {source})),
    {to}_v AS (SELECT {key}, h % 64 AS d, sum(CASE WHEN (h >> 16) & 1 = 1 THEN 1 ELSE -1 END)::DOUBLE AS x FROM {to}_h GROUP BY ALL),
    {to}_n AS (SELECT {key}, sqrt(sum(x * x)) AS n FROM {to}_v GROUP BY {key} HAVING sum(x * x) > 0)"""


def _dense_sql(source: str, column: str, to: str = "documents") -> str:
    """`<to>_sims`: the cosine of every query text and every document."""
    return f"""{_encoded_sql("queries", "query_id", "text", f"{to}_q")}, {_encoded_sql(source, "doc_id", column, to)},
    {to}_dots AS (SELECT query_id, doc_id, sum(a.x * b.x) AS s FROM {to}_q_v a JOIN {to}_v b USING (d) GROUP BY ALL),
    {to}_sims AS (
        SELECT query_id, doc_id, round(coalesce(s, 0) / (a.n * b.n), 6) + 0.0 AS score
        FROM {to}_q_n a CROSS JOIN {to}_n b LEFT JOIN {to}_dots USING (query_id, doc_id))"""


_FUSED_POOLS = """fused AS (
        SELECT query_id, doc_id,
            coalesce(CASE WHEN max(bm25_score) OVER q > min(bm25_score) OVER q THEN (bm25_score - min(bm25_score) OVER q) / (max(bm25_score) OVER q - min(bm25_score) OVER q) ELSE bm25_score END, 0) * 0.4::DOUBLE
            + coalesce(CASE WHEN max(vector_score) OVER q > min(vector_score) OVER q THEN (vector_score - min(vector_score) OVER q) / (max(vector_score) OVER q - min(vector_score) OVER q) ELSE vector_score END, 0) * 0.6::DOUBLE AS h
        FROM merged WINDOW q AS (PARTITION BY query_id))"""
_DEMO_WANTS = """list_filter([
                CASE WHEN contains(t, 'quality') THEN 'high quality' END,
                CASE WHEN contains(t, 'fast') AND contains(t, 'charging') THEN 'fast charging' END,
                CASE WHEN contains(t, 'noise') AND contains(t, 'cancel') THEN 'noise cancellation' END,
                CASE WHEN contains(t, 'warranty') THEN 'warranty' END, CASE WHEN contains(t, 'wireless') THEN 'wireless' END,
                CASE WHEN contains(t, 'battery') THEN 'long battery life' END], lambda f: f IS NOT NULL)"""
_WANTS = """list_filter([
                CASE WHEN contains(t, 'quality') THEN 'high quality' END, CASE WHEN contains(t, 'fast') AND contains(t, 'charging') THEN 'fast charging' END,
                CASE WHEN contains(t, 'noise') AND contains(t, 'cancelling') THEN 'noise cancelling' END, CASE WHEN contains(t, 'warranty') THEN 'warranty' END,
                CASE WHEN regexp_matches(t, 'warranty|guarantee|year') THEN 'warranty' END, CASE WHEN contains(t, 'iphone') THEN 'iphone compatible' END],
                lambda x: x IS NOT NULL)"""


def _gains_sql(wants: str) -> str:
    return f"""joined AS (
        SELECT f.*, d.category, {_MONEY} AS price, lower(concat_ws(' ', product_name, category, about_product, review_content)) AS everything, {wants} AS features,
            try_cast(nullif(regexp_extract(t, 'under ([0-9]+([.][0-9]+)?)\\s*usd', 1), '') AS DOUBLE) AS bound,
            CASE WHEN regexp_matches(t, 'cable|charger|cord') THEN ['cable', 'charger', 'usb', 'lightning']
                 WHEN regexp_matches(t, 'headset|headphone|earphone|earbud') THEN ['headphone', 'headset', 'earphone', 'earbuds'] ELSE [] END AS terms
        FROM fused f JOIN (SELECT query_id, lower(text) AS t FROM queries) USING (query_id) JOIN documents d USING (doc_id)),
    gains AS (
        SELECT *, CASE WHEN len(list_filter(terms, lambda x: contains(lower(category), x))) > 0 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS category_gain,
            len(list_filter(features, lambda x: contains(everything, x))) * 0.5::DOUBLE AS feature_gain FROM joined)"""


def _multimodal_sql(images: int, cable: str, headphone: str, more: str) -> str:
    return f"""
    WITH {_ALL_OFFERS} {_ALL_TEXTS}, {_dense_sql("documents", "text")}, {_dense_sql("documents", "product_name", "names")},
    a AS ({_top("documents_sims", 250)}), b AS ({_top("names_sims", images)}),
    c AS (
        SELECT query_id, doc_id, score AS text_score, NULL::DOUBLE AS image_score FROM a
        UNION ALL SELECT query_id, doc_id, NULL, score FROM b ANTI JOIN a USING (query_id, doc_id)),
    {_counts_sql(_TOK)},
    vocabulary AS (
        SELECT term, ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1.0::DOUBLE AS idf FROM (
            SELECT term, sum(tf) AS cf, count(*) AS df FROM counted GROUP BY term ORDER BY cf DESC, term LIMIT 5000)),
    raw AS (SELECT doc_id, term, tf * idf AS x FROM counted JOIN vocabulary USING (term)),
    weights AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS w FROM raw),
    q AS (
        SELECT query_id, term, count(*) * any_value(idf) AS x
        FROM (SELECT query_id, unnest({_TOK}) AS term FROM queries) JOIN vocabulary USING (term) GROUP BY query_id, term),
    qw AS (SELECT query_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS qw FROM q),
    keyword AS (SELECT query_id, doc_id, round(sum(w * qw), 6) AS k FROM qw JOIN weights USING (term) GROUP BY query_id, doc_id),
    joined AS (
        SELECT c.*, k, rating, rating_count, lower(category) AS category, CASE WHEN regexp_matches(lower(q.text), 'cable|charger|cord') THEN {cable}
            WHEN regexp_matches(lower(q.text), 'headset|headphone|earphone|earbud') THEN {headphone} ELSE [] END AS terms
        FROM c JOIN queries q USING (query_id) JOIN documents d USING (doc_id) LEFT JOIN keyword USING (query_id, doc_id)),
    final AS (
        SELECT query_id, doc_id, round(coalesce(text_score, 0) * 1.5::DOUBLE + coalesce(image_score, 0) * 0.5::DOUBLE
            + CASE WHEN len(list_filter(terms, lambda x: contains(category, x))) > 0 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END
            + coalesce(k, 0) * 1.5::DOUBLE {more}, 9) AS score FROM joined)
    SELECT s.query_id, doc_id, score, rank FROM ({_top("final", 5)}) r
    JOIN queries t USING (query_id) JOIN (SELECT DISTINCT query_id, query_text FROM search_results) s ON s.query_text = t.text"""


SQL = {
    "tokenize_counts": f"WITH {_counts_sql(_STOK)} SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM counted GROUP BY term",
    "term_stats": _bm25_sql() + "SELECT term, cf, df, round(idf, 6) AS idf FROM vocabulary",
    "bm25_topk": _bm25_sql() + _top("scored", 20),
    "bm25_docfreq_topk": _bm25_sql("df") + _top("scored", 20),
    "bm25_corpus_totals": _bm25_sql() + "SELECT count(*) AS n, sum(dl)::BIGINT AS total, round(avg(dl), 6) AS avgdl FROM docs",
    "key_terms": _bm25_sql()
    + """SELECT query_id, term, idf, rank FROM (
        SELECT query_id, term, round(idf, 6) AS idf, row_number() OVER (PARTITION BY query_id ORDER BY round(idf, 6) DESC, term) AS rank
        FROM terms JOIN vocabulary USING (term)) WHERE rank <= 5""",
    "tfidf_topk": _TFIDF
    + f""", {_QUERIES_SQL},
    q AS (SELECT query_id, term, count(*) * any_value(idf) AS x FROM (SELECT query_id, unnest({_TOK}) AS term FROM queries) JOIN vocabulary USING (term) GROUP BY query_id, term),
    qw AS (SELECT query_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS qw FROM q),
    scored AS (SELECT query_id, doc_id, round(sum(w * qw), 6) AS score FROM qw JOIN weights USING (term) GROUP BY query_id, doc_id)
    """
    + _top("scored", 20),
    "tfidf_top_features": _TFIDF.replace(_TOK, _STOK)
    + """SELECT term, total, row_number() OVER (ORDER BY total DESC, term) AS rank FROM (
        SELECT term, round(sum(w), 4) AS total FROM weights GROUP BY term) ORDER BY total DESC, term LIMIT 20""",
    "inner_product_topk": _vector_sql("list_inner_product(q.v, c.v)"),
    "cosine_topk": _vector_sql("list_cosine_similarity(q.v, c.v)"),
    "l2_topk": _vector_sql("list_inner_product(q.v, q.v) - 2 * list_inner_product(q.v, c.v) + list_inner_product(c.v, c.v)", K, "score, doc_id"),
    "self_retrieval": "SELECT query_id, score FROM (" + _vector_sql("list_cosine_similarity(q.v, c.v)", 1) + ")",
    "unit_norm_check": """
        SELECT vec_id, round(n, 6) AS norm, CASE WHEN n > 0 THEN 1.0::DOUBLE END AS unit_norm
        FROM (SELECT vec_id, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM combined_embeddings)""",
    "pair_similarity": """
        WITH d AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM combined_embeddings WHERE embedding_dimension = 64)
        SELECT a.vec_id AS vec_id_a, b.vec_id AS vec_id_b,
            CASE WHEN list_inner_product(a.v, a.v) > 0 AND list_inner_product(b.v, b.v) > 0
                THEN round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 6) END AS cosine,
            round(power(list_distance(a.v, b.v), 2), 6) AS distance
        FROM d a JOIN d b ON a.vec_id + 1 = b.vec_id""",
    "zscore_stats": """
        WITH l AS (SELECT unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
        s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS d FROM l GROUP BY dim)
        SELECT dim, count(*) AS n, round(sum(abs((x - m) / CASE WHEN d = 0 THEN 1 ELSE d END)), 4) AS total FROM l JOIN s USING (dim) GROUP BY dim""",
    "hybrid_keep_first": _fused_sql("merged_keep_first") + _top("(SELECT query_id, doc_id, h, round(h, 6) AS score FROM fused)", 5, "h DESC, doc_id"),
    "hybrid_outer": _OUTER + _top("(SELECT query_id, doc_id, h, round(h, 6) AS score FROM fused)", 5, "h DESC, doc_id"),
    "category_boost": _BOOST + "SELECT query_id, doc_id, category_gain FROM gains",
    "feature_boost": _BOOST + "SELECT query_id, doc_id, feature_gain FROM gains",
    "boosted_search": _BOOST + _top("(SELECT query_id, doc_id, round(h + category_gain + feature_gain, 9) AS score FROM gains)", K),
    "rule_boost_inject": _OUTER
    + """, last AS (SELECT query_id, max(doc_id) AS doc_id FROM fused GROUP BY query_id),
    rules AS (
        SELECT query_id, doc_id, sum(boost) AS boost FROM (
            SELECT query_id, doc_id, 3.0::DOUBLE AS boost FROM last
            UNION ALL SELECT query_id, (SELECT min(product_id) FROM catalog_raw), 3.0::DOUBLE FROM last WHERE query_id % 2 = 0) GROUP BY ALL),
    boosted AS (
        SELECT query_id, doc_id, h + coalesce(boost, 0) AS h FROM fused LEFT JOIN rules USING (query_id, doc_id)
        UNION ALL SELECT query_id, doc_id, boost * 2 FROM rules ANTI JOIN fused USING (query_id, doc_id)
            WHERE doc_id IN (SELECT product_id FROM catalog_raw))
    """
    + _top("(SELECT query_id, doc_id, h, round(h, 6) AS score FROM boosted)", 5, "h DESC, doc_id"),
    "review_boost": _OUTER
    + """, ratings AS (SELECT product_id AS doc_id, max(""" + _RATING + """ / 5) AS r FROM catalog_raw GROUP BY 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY h DESC, doc_id) AS rank FROM fused)
    SELECT query_id, doc_id, round(CASE WHEN rank <= 20 THEN h + (coalesce(r, 0.5) - 0.5::DOUBLE) * 0.4::DOUBLE ELSE h END, 9) AS score, rank
    FROM ranked LEFT JOIN ratings USING (doc_id)""",
    "rerank_fusion": _OUTER
    + f""", offers AS (SELECT DISTINCT product_id AS doc_id, lower(concat_ws(' ', product_name, about_product)) AS t FROM catalog_raw),
    cand AS (SELECT query_id, doc_id, h, {_WORDING} AS semantic FROM fused JOIN offers USING (doc_id))"""
    + _RERANK,
    "constant_rerank": _OUTER + ", cand AS (SELECT query_id, doc_id, h, 0.0::DOUBLE AS semantic FROM fused)" + _RERANK,
    "custom_boost": f"SELECT doc_id, {_WORDING} AS boost FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)",
    "hybrid_search": _bm25_sql(before=_ALL_OFFERS, queries=_ALL_TEXTS)
    + f""", words AS ({_top("scored", 100)}), {_dense_sql("documents", "text")}, near AS ({_top("documents_sims", 100)}),
    merged AS (SELECT query_id, doc_id, w.score AS bm25_score, n.score AS vector_score FROM words w FULL JOIN near n USING (query_id, doc_id)),
    {_FUSED_POOLS}, {_gains_sql(_DEMO_WANTS)}
    SELECT s.query_id, doc_id, score, rank FROM ({_top("(SELECT query_id, doc_id, round(h + category_gain + feature_gain, 9) AS score FROM gains)", K)}) r
    JOIN queries t USING (query_id) JOIN (SELECT DISTINCT query_id, query_text FROM search_results) s ON s.query_text = t.text""",
    "hybrid_reranked": _bm25_sql(before=_ALL_OFFERS, queries=_ALL_TEXTS)
    + f""", words AS ({_top("scored", 100)}), {_dense_sql("documents", "text")}, near AS ({_top("documents_sims", 100)}),
    merged AS (
        SELECT query_id, doc_id, score AS bm25_score, NULL::DOUBLE AS vector_score FROM words
        UNION ALL SELECT query_id, doc_id, NULL, score FROM near ANTI JOIN words USING (query_id, doc_id)),
    {_FUSED_POOLS}, {_gains_sql(_WANTS)},
    bounded AS (SELECT * FROM gains WHERE bound IS NULL OR bound = 0 OR coalesce(price < bound, false)),
    scored1 AS (SELECT query_id, doc_id, round(h + category_gain + feature_gain, 9) AS h FROM bounded),
    rules AS (SELECT query_id, (SELECT min(doc_id) FROM documents) AS doc_id, 3.0::DOUBLE AS boost FROM queries WHERE regexp_matches(lower(text), 'cable|charger|cord')),
    scored2 AS (
        SELECT query_id, doc_id, h + coalesce(boost, 0) AS h FROM scored1 LEFT JOIN rules USING (query_id, doc_id)
        UNION ALL SELECT query_id, doc_id, boost * 2 FROM rules ANTI JOIN scored1 USING (query_id, doc_id)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY h DESC, doc_id) AS place FROM scored2),
    reviewed AS (
        SELECT query_id, doc_id, h + (coalesce({_RATING} / 5, 0.5) - 0.5::DOUBLE) * 0.4::DOUBLE AS h, {_WORDING.replace("t, ", "t2, ")} AS semantic
        FROM (SELECT *, lower(concat_ws(' ', product_name, about_product)) AS t2 FROM placed JOIN documents USING (doc_id) WHERE place <= 10)),
    final AS (
        SELECT query_id, doc_id, round(CASE WHEN max(h) OVER q > min(h) OVER q
            THEN (h - min(h) OVER q) / (max(h) OVER q - min(h) OVER q) * 10.0::DOUBLE ELSE h END * 0.3::DOUBLE + semantic * 0.7::DOUBLE, 6) AS score
        FROM reviewed WINDOW q AS (PARTITION BY query_id))
    SELECT s.query_id, doc_id, score, rank FROM ({_top("final", 5)}) r
    JOIN queries t USING (query_id) JOIN (SELECT DISTINCT query_id, query_text FROM search_results) s ON s.query_text = t.text""",
    "multimodal_search": _multimodal_sql(250, "['usbcables']", "['pcheadsets']", ""),
    "multimodal_improved": _multimodal_sql(
        100, "['usbcables', 'cable', 'charger']", "['pcheadsets', 'headphones', 'earbuds']",
        f"+ coalesce({_RATING}, 0) / 5 + coalesce({_COUNT} / nullif(max({_COUNT}) OVER (PARTITION BY query_id), 0), 0) * 0.5::DOUBLE",
    ),
    "demo_search": f"""
        WITH offers AS (
            SELECT DISTINCT product_id AS doc_id, category, concat_ws(' ', product_name, category, about_product) AS text,
                product_name, about_product, review_content FROM catalog_raw),
        counted AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM offers) GROUP BY doc_id, term),
        vocabulary AS (
            SELECT term, ln(((SELECT count(*) FROM offers) + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1.0::DOUBLE AS idf FROM (
                SELECT term, sum(tf) AS cf, count(*) AS df FROM counted GROUP BY term ORDER BY cf DESC, term LIMIT 5000)),
        raw AS (SELECT doc_id, term, tf * idf AS x FROM counted JOIN vocabulary USING (term)),
        weights AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS w FROM raw),
        {_QUERIES_SQL},
        q AS (
            SELECT query_id, term, count(*) * any_value(idf) AS x
            FROM (SELECT query_id, unnest({_TOK}) AS term FROM queries) JOIN vocabulary USING (term) GROUP BY query_id, term),
        qw AS (SELECT query_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS qw FROM q),
        scored AS (SELECT query_id, doc_id, round(sum(w * qw), 6) AS score FROM qw JOIN weights USING (term) GROUP BY query_id, doc_id),
        asked AS (
            SELECT query_id, lower(text) AS t, CASE WHEN regexp_matches(t, 'cable|charger|cord') THEN 'cable'
                WHEN regexp_matches(t, 'headset|headphone|earphone|earbud') THEN 'headphone' WHEN contains(t, 'mouse') THEN 'mouse' ELSE '' END AS kind,
                list_filter([
                    CASE WHEN contains(t, 'quality') THEN 'high quality' END,
                    CASE WHEN contains(t, 'fast') AND contains(t, 'charging') THEN 'fast charging' END,
                    CASE WHEN contains(t, 'noise') AND contains(t, 'cancel') THEN 'noise cancellation' END,
                    CASE WHEN contains(t, 'warranty') THEN 'warranty' END, CASE WHEN contains(t, 'wireless') THEN 'wireless' END,
                    CASE WHEN contains(t, 'battery') THEN 'long battery life' END], lambda f: f IS NOT NULL) AS features FROM queries),
        joined AS (
            SELECT asked.query_id, o.doc_id, coalesce(score, 0) AS score,
                CASE WHEN kind <> '' AND contains(lower(category), kind) THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END
                    + len(list_filter(features, lambda x: contains(lower(o.text), x))) * 0.5::DOUBLE AS semantic
            FROM asked CROSS JOIN offers o LEFT JOIN scored USING (query_id, doc_id)),
        final AS (
            SELECT *, round(score + semantic, 6) AS final_score, row_number() OVER (PARTITION BY query_id ORDER BY round(score + semantic, 6) DESC, doc_id) AS rank
            FROM joined WHERE round(score + semantic, 6) > 0)
        SELECT query_id, doc_id, final_score, rank,
            CASE WHEN score > 0.2 THEN 'High' WHEN score > 0.1 THEN 'Medium' ELSE 'Low' END AS keyword_label,
            CASE WHEN semantic > 2 THEN 'High' WHEN semantic > 1 THEN 'Medium' ELSE 'Low' END AS semantic_label
        FROM final WHERE rank <= 5""",
    "zscore_concat": """
        WITH l AS (SELECT vec_id, unnest(range(64)) AS dim, unnest(embedding) AS x FROM embeddings),
        l2 AS (SELECT vec_id, dim, x::DOUBLE AS x FROM l UNION ALL SELECT vec_id, dim + 64, (x * x)::DOUBLE FROM l),
        s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS d FROM l2 GROUP BY dim)
        SELECT vec_id, list(round((x - m) / CASE WHEN d = 0 THEN 1 ELSE d END, 6) ORDER BY dim) AS combined FROM l2 JOIN s USING (dim) GROUP BY vec_id""",
    "rank_of_target": _OUTER
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY h DESC, doc_id) AS rank, min(doc_id) OVER (PARTITION BY query_id) AS target FROM fused)
    SELECT query_id, rank, round(1.0::DOUBLE / rank, 6) AS reciprocal_rank, rank <= 5 AS hit FROM ranked WHERE doc_id = target""",
    "union_dedup_keep_first": _HYBRID + "SELECT query_id, doc_id, round(bm25_score, 6) AS bm25_score, round(vector_score, 6) AS vector_score FROM merged_keep_first",
    "query_analysis_rules": """
        WITH q AS (SELECT DISTINCT query_id, lower(query_text) AS t FROM search_results)
        SELECT query_id,
            CASE WHEN regexp_matches(t, 'cable|charger|cord') THEN 'cable' WHEN regexp_matches(t, 'headset|headphone|earphone|earbud') THEN 'headphone' ELSE '' END AS product_type,
            array_to_string(list_filter([
                CASE WHEN contains(t, 'quality') THEN 'high quality' END, CASE WHEN contains(t, 'fast') AND contains(t, 'charging') THEN 'fast charging' END,
                CASE WHEN contains(t, 'noise') AND contains(t, 'cancelling') THEN 'noise cancelling' END, CASE WHEN contains(t, 'warranty') THEN 'warranty' END,
                CASE WHEN regexp_matches(t, 'warranty|guarantee|year') THEN 'warranty' END, CASE WHEN contains(t, 'iphone') THEN 'iphone compatible' END],
                lambda x: x IS NOT NULL), ',') AS key_features,
            try_cast(nullif(regexp_extract(t, 'under ([0-9]+([.][0-9]+)?)\\s*usd', 1), '') AS DOUBLE) AS price_constraint
        FROM q""",
    "price_constraint_extract": "SELECT doc_id, try_cast(nullif(regexp_extract('under ' || regexp_extract(text, 'Price: ([0-9.]+ USD)', 1), 'under ([0-9]+([.][0-9]+)?)\\s*USD', 1), '') AS DOUBLE) AS bound FROM documents",
    "json_repair_parse": """
        SELECT event_id, CASE WHEN event_id % 4 < 3 THEN regexp_extract(props, '([0-9]+)', 1)::DOUBLE END AS score,
            CASE WHEN event_id % 4 = 3 THEN 'usb cable' END AS product_type FROM events""",
}
