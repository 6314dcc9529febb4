"""Relational, profiling, incremental, source, model and window queries with their SQL."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.functions.numbers import read_count, read_rating
from gristmill.operators import etl
from gristmill.operators import incremental as I
from gristmill.operators import plugins
from gristmill.operators import relational as R
from gristmill.operators import reviews as V
from gristmill.plans import texts as X
from gristmill.sources import files
from gristmill.session import shared_folder
from gristmill.sources.tables import table
from gristmill.streaming import events as E


def _products(s: SparkSession, sf: str) -> DataFrame:
    return table(s, sf, "products").distinct()


def _items(s: SparkSession, sf: str) -> DataFrame:
    return table(s, sf, "order_items").select("order_id", "product_id", "price", "created_at").distinct()


def _reviews(s: SparkSession, sf: str) -> DataFrame:
    return table(s, sf, "order_reviews").select("review_id", "order_id", "review_comment_message", "review_score", "created_at").distinct()


def _numbers(s: SparkSession, sf: str) -> DataFrame:
    """Offers once each with their numbers."""
    return table(s, sf, "catalog_raw").select(
        "product_id", "seller_id", T.currency(F.col("discounted_price")).alias("price"), read_rating(F.col("rating")).alias("rating"),
        read_count(F.col("rating_count")).alias("rating_count"), T.currency(F.col("discount_percentage")).alias("discount"),
        F.get(F.split("category", r"[|>»/;]"), F.lit(0)).alias("main"), F.trim(F.get(F.split("category", r"[|>»/;]"), F.lit(1))).alias("sub"),
    ).distinct()


def left_join_translate(s, sf):
    return R.left_lookup(_products(s, sf), table(s, sf, "translations"), "product_category_name")


def translate_with_additions(s, sf):
    """The dictionary with entries of its own for the names it lacks."""
    tr = table(s, sf, "translations")
    names = _products(s, sf).select("product_category_name").filter("product_category_name IS NOT NULL").distinct()
    more = names.join(tr, "product_category_name", "left_anti").withColumn("product_category_name_english", F.concat(F.lit("other_"), "product_category_name"))
    return R.left_lookup(_products(s, sf), tr.unionByName(more), "product_category_name").select("product_id", "product_category_name_english").distinct()


def untranslated(s, sf):
    j = left_join_translate(s, sf).filter("product_category_name_english IS NULL AND product_category_name IS NOT NULL")
    return R.value_counts(j, "product_category_name")


def fanout_join(s, sf):
    return _reviews(s, sf).join(_items(s, sf).select("order_id", "product_id"), "order_id", "left").select("review_id", "order_id", "product_id", "review_score")


def group_listagg(s, sf):
    j = _reviews(s, sf).join(_items(s, sf).select("order_id", "product_id").distinct(), "order_id", "left")
    return R.group_concat(j, "product_id", "review_comment_message", ["created_at", "review_id"])


def review_means(s, sf):
    j = fanout_join(s, sf).filter("product_id IS NOT NULL")
    return j.groupBy("product_id").agg(F.round(F.avg("review_score"), 6).alias("mean_score"), F.count("*").alias("n"))


def avg_price_left_join(s, sf):
    p = _items(s, sf).groupBy("product_id").agg(F.round(F.avg("price"), 6).alias("avg_price"))
    return _products(s, sf).select("product_id").distinct().join(p, "product_id", "left")


def orders_without_items(s, sf):
    return _reviews(s, sf).select("order_id").distinct().join(_items(s, sf), "order_id", "left_anti")


def integrity_counts(s, sf):
    """Products sold, and those of them that the catalogue lacks."""
    sold = _items(s, sf).select("product_id").distinct()
    known = _products(s, sf).select("product_id").distinct().withColumn("known", F.lit(1))
    return sold.join(known, "product_id", "left").agg(F.count("*").alias("sold"), F.count_if(F.col("known").isNull()).alias("unknown"))


def value_counts(s, sf):
    return R.value_counts(_products(s, sf), "product_category_name")


def two_key_counts(s, sf):
    return R.value_counts(_numbers(s, sf), "main", "sub")


def nunique(s, sf):
    return _items(s, sf).agg(F.countDistinct("product_id").alias("products"), F.countDistinct("order_id").alias("orders"), F.count("*").alias("n"))


def distinct_with_null(s, sf):
    return table(s, sf, "products").select("product_category_name").distinct()


def null_profile(s, sf):
    return R.null_profile(table(s, sf, "catalog_raw"))


def describe_numeric(s, sf):
    return R.describe(_numbers(s, sf), "price", "rating", "rating_count", "discount")


def quadrant_counts(s, sf):
    return R.quadrants(_numbers(s, sf), "price", "rating")


def boxplot_summary(s, sf):
    return R.five_numbers(_numbers(s, sf), "sub", "price", 5)


def histogram(s, sf):
    return R.histogram(_numbers(s, sf), "rating", 20)


def top_brands(s, sf):
    b = table(s, sf, "catalog_raw").select("product_id", T.brand(F.col("product_name")).alias("brand")).distinct()
    return R.value_counts(b, "brand").orderBy(F.col("n").desc(), "brand").limit(10)


def word_frequencies(s, sf):
    return table(s, sf, "catalog_raw").select("product_id", "review_content").distinct().select(F.explode(T.tokens(F.col("review_content"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def any_null_filter(s, sf):
    return _numbers(s, sf).dropna(how="any").select("product_id", "price", "rating", "rating_count")


def percentages(s, sf):
    c = R.value_counts(table(s, sf, "documents").select("source"), "source")
    total = c.select(F.sum("n").alias("n")).scalar()
    return c.select("source", "n", F.round(F.col("n") / total * 100, 4).alias("percent"))


def word_ranges(s, sf):
    """Documents by how many words they have."""
    n = F.size(T.words(F.col("text")))
    size = F.when(n < 5, "short").when((n > 10) & (n < 20), "medium").when(n > 50, "long").otherwise("other")
    return table(s, sf, "documents").filter("text IS NOT NULL").groupBy(size.alias("size")).agg(F.count("*").alias("n"))


def predicates(s, sf):
    """Documents that speak of a cable in any case, or hold accents."""
    return table(s, sf, "documents").filter(F.lower("text").contains("cable") | F.col("text").rlike("[áéíóúãõâêîôûç]")).select("doc_id")


def price_range(s, sf):
    return _numbers(s, sf).filter(F.col("price").between(500, 1500)).select("product_id", "price")


def unpivot_scores(s, sf):
    df = table(s, sf, "search_results").select("query_id", "product_id", "bm25_score_norm", "vector_score_norm").distinct()
    return R.long_form(df, ["query_id", "product_id"], ["bm25_score_norm", "vector_score_norm"], "score_name", "score")


def head_per_group(s, sf):
    return R.head_per_group(_products(s, sf).filter("product_category_name IS NOT NULL"), "product_category_name", [F.col("product_id")], 2)


def exact_sample(s, sf):
    """A hundred documents, the same ones at every run."""
    return R.exact_sample(table(s, sf, "documents").select("doc_id", "source"), "doc_id", 100)


def star_join(s, sf):
    """Revenue by region and segment over five tables."""
    li = table(s, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    o = table(s, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(s, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n, r = table(s, sf, "nation").select("n_nationkey", "n_regionkey"), table(s, sf, "region").select("r_regionkey", "r_name")
    j = (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(c, F.col("o_custkey") == c.c_custkey)
        .join(n, F.col("c_nationkey") == n.n_nationkey)
        .join(r, F.col("n_regionkey") == r.r_regionkey)
    )
    revenue = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(38,6)")
    return j.groupBy("r_name", "c_mktsegment").agg(F.sum(revenue).cast("double").alias("revenue"), F.count("*").alias("n"))


def _halves(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A state of vectors loaded up to mid-2024, and all vectors as the new delivery."""
    v = table(s, sf, "combined_embeddings").select("vec_id", "product_id", "updated_at")
    return v.filter("updated_at < TIMESTAMP '2024-07-01' OR vec_id % 2 = 0"), v


def new_products(s, sf):
    state, now = _halves(s, sf)
    return I.new_rows(now, state, "vec_id")


def updated_products(s, sf):
    state, now = _halves(s, sf)
    return I.updated_rows(now, state, "vec_id", "updated_at", F.lit("2024-07-01").cast("timestamp"))


def embedding_upsert(s, sf):
    state, now = _halves(s, sf)
    changed = new_products(s, sf).unionByName(updated_products(s, sf)).withColumn("kind", F.lit("fresh"))
    return I.upsert(state.withColumn("kind", F.lit("kept")), changed, "vec_id")


def ttl_cache_valid(s, sf):
    e = table(s, sf, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    now = e.select(F.max("ts").alias("t")).scalar()
    return I.valid_entries(e, now, 7 * 86400).select("event_id")


def chunk_resume(s, sf):
    d = table(s, sf, "documents").select("doc_id")
    done = d.select(F.floor(F.col("doc_id") / 100).cast("bigint").alias("chunk_id")).filter("chunk_id % 3 = 0").distinct()
    return I.pending_chunks(d, "doc_id", 100, done)


def cache_keys(s, sf):
    d = table(s, sf, "documents").select("doc_id", I.cache_key(F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))).alias("key"))
    return d


def _folder(s: SparkSession, name: str) -> str:
    shared = shared_folder(s)
    return f"{shared.rstrip('/')}/{name}-{s.sparkContext.applicationId}" if shared else tempfile.mkdtemp(prefix=f"gristmill-{name}-")


def csv_roundtrip(s, sf):
    df = table(s, sf, "order_reviews").select("review_id", "order_id", "review_comment_message")
    path = _folder(s, "csv")
    files.write_csv(df, path, null="\\N")
    return files.read_csv(s, path, df.schema, ["review_id"], null="\\N")


def log_parse(s, sf):
    d = table(s, sf, "documents").filter("source = 'detector_log'").select("doc_id", F.explode(files.parse_log(F.col("text"))).alias("r"))
    return d.select("doc_id", "r.detector", "r.language", "r.confidence", "r.time_ms")


def log_statistics(s, sf):
    r = log_parse(s, sf)
    return r.groupBy("detector", "language").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.max("time_ms"), 4).alias("slowest"))


def html_image_url(s, sf):
    """Pages made of the offers' images, in two of the ways shops write them, read back."""
    c = table(s, sf, "catalog_raw").select("product_id", "image_url").distinct()
    data = F.concat(F.lit("<html><img data-a-dynamic-image='{\""), "image_url", F.lit("\": [1, 2]}'></html>"))
    plain = F.concat(F.lit("<div><img src='x.png'><img id=landingImage src='"), "image_url", F.lit("'></div>"))
    return files.image_urls(c.select("product_id", F.when(F.crc32("product_id") % 2 == 0, data).otherwise(plain).alias("page")), "product_id", "page")


def product_etl(s, sf):
    """The searchable product table: three joins, two aggregates, cleaning and detection."""
    reviews = table(s, sf, "order_reviews").select("review_id", "order_id", "review_comment_message", "review_score", "created_at")
    items = table(s, sf, "order_items").select("order_id", "product_id", "price", "created_at")
    out = etl.searchable(etl.product_table(table(s, sf, "products"), table(s, sf, "translations"), items, reviews))
    return out.withColumns({"confidence": F.round("confidence", 6), "price": F.round("price", 6)})


def review_analysis(s, sf):
    """Sentiment of the first reviews of each offer, and the score the boost takes."""
    c = table(s, sf, "catalog_raw").select("product_id", "review_content").distinct()
    a = c.select("product_id", V.analyse_reviews(V.first_reviews(F.col("review_content"))).alias("a"))
    return a.select("product_id", F.round("a.sentiment_score", 6).alias("sentiment"), "a.general_sentiment", F.round(V.review_score(F.col("a.sentiment_score")), 6).alias("score"))


def topic_quality(s, sf):
    """What each document says of the charger."""
    stars = table(s, sf, "documents").select("doc_id", V.topic_score(F.col("text"), ["charger"]).alias("stars"))
    return stars.select("doc_id", F.round("stars", 6).alias("stars"), V.quality_of(F.col("stars")).alias("quality"))


def plugin_detector(s, sf):
    """A detector plug-in over all reviews, and one that fails."""
    df = table(s, sf, "order_reviews").select("review_id", F.col("review_comment_message").alias("text")).distinct()
    out = plugins.detect(plugins.detect(df, "text", "a", plugins.AccentDetector), "text", "b", plugins.FailingDetector)
    return out.groupBy(F.col("a.language").alias("language"), F.col("b.method_used").alias("second")).agg(F.count("*").alias("n"))


def rating_feature_importance(s, sf):
    """Which numbers and categories tell the rating, by a forest over all offers that have them."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    df = _numbers(s, sf).dropna(subset=["price", "rating", "rating_count", "discount", "sub"]).filter("sub <> ''")
    steps = [
        StringIndexer(inputCol="sub", outputCol="sub_i", handleInvalid="keep"), OneHotEncoder(inputCols=["sub_i"], outputCols=["sub_v"]),
        VectorAssembler(inputCols=["price", "rating_count", "discount", "sub_v"], outputCol="features"),
        RandomForestRegressor(featuresCol="features", labelCol="rating", numTrees=20, seed=42),
    ]
    model = Pipeline(stages=steps).fit(df)
    weights = model.stages[-1].featureImportances.toArray()
    rows = [("price", weights[0]), ("rating_count", weights[1]), ("discount", weights[2]), ("category", sum(weights[3:]))]
    return s.createDataFrame([(n, round(float(w), 4)) for n, w in rows], "feature string, importance double")


def events_tumbling(s, sf):
    """Extension: counts by hour."""
    return E.tumbling_counts(table(s, sf, "events"), "ts", "event_type", "value")


def events_session(s, sf):
    """Extension: sessions of a user."""
    return E.session_counts(table(s, sf, "events"), "ts", "user_id")


QUERIES = {
    f.__name__: f
    for f in (
        left_join_translate, translate_with_additions, untranslated, fanout_join, group_listagg, review_means, avg_price_left_join,
        orders_without_items, integrity_counts, value_counts, two_key_counts, nunique, distinct_with_null, null_profile, describe_numeric,
        quadrant_counts, boxplot_summary, histogram, top_brands, word_frequencies, any_null_filter, percentages, word_ranges, predicates,
        price_range, unpivot_scores, head_per_group, exact_sample, star_join, new_products, updated_products, embedding_upsert,
        ttl_cache_valid, chunk_resume, cache_keys, csv_roundtrip, log_parse, log_statistics, html_image_url,
        product_etl, review_analysis, topic_quality, plugin_detector, rating_feature_importance, events_tumbling, events_session,
    )
}

_P = "p AS (SELECT DISTINCT * FROM products)"
_I = "i AS (SELECT DISTINCT order_id, product_id, price, created_at FROM order_items)"
_R = "r AS (SELECT DISTINCT review_id, order_id, review_comment_message, review_score, created_at FROM order_reviews)"
_COUNT = "try_cast(replace(nullif(regexp_extract(rating_count, '([0-9][0-9,]*)', 1), ''), ',', '') AS DOUBLE)"
_RATING = "try_cast(replace(nullif(regexp_extract(rating, '([0-9]+([.,][0-9]{1,2})?)', 1), ''), ',', '.') AS DOUBLE)"
_MONEY = "try_cast(regexp_replace({}, '[₹$,%]', '', 'g') AS DOUBLE)"
_N = f"""n AS (SELECT DISTINCT product_id, seller_id, {_MONEY.format('discounted_price')} AS price, {_RATING} AS rating, {_COUNT} AS rating_count,
    {_MONEY.format('discount_percentage')} AS discount, regexp_split_to_array(category, '[|>»/;]')[1] AS main, trim(regexp_split_to_array(category, '[|>»/;]')[2]) AS sub FROM catalog_raw)"""
_COLUMNS = (
    "product_id product_name category discounted_price actual_price discount_percentage rating rating_count about_product review_content "
    "review_lang product_link image_url seller_id scraped_at loaded_at"
).split()
_STATE = "v AS (SELECT vec_id, product_id, updated_at FROM combined_embeddings), s AS (SELECT * FROM v WHERE updated_at < TIMESTAMP '2024-07-01' OR vec_id % 2 = 0)"
_RECORD = "(?s)^([^\\n]*)\\nText: (.*?)\\nLanguage: ([^\\n]*)\\nConfidence: ([0-9.]+)\\nProcessing Time: ([0-9.]+)"
_LOG = f"""l AS (
    SELECT doc_id, regexp_extract(x, '{_RECORD}', 1) AS detector, regexp_extract(x, '{_RECORD}', 3) AS language,
        try_cast(regexp_extract(x, '{_RECORD}', 4) AS DOUBLE) AS confidence, try_cast(regexp_extract(x, '{_RECORD}', 5) AS DOUBLE) AS time_ms
    FROM (SELECT doc_id, unnest(string_split(text, 'Detector: ')[2:]) AS x FROM documents WHERE source = 'detector_log') WHERE regexp_matches(x, '{_RECORD}'))"""
_STATS = ", ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n, avg({c}) AS mean, stddev({c}) AS sd, min({c}) AS lowest, quantile_cont({c}, 0.25) AS q1, "
    f"quantile_cont({c}, 0.5) AS middle, quantile_cont({c}, 0.75) AS q3, max({c}) AS highest FROM n"
    for c in ("price", "rating", "rating_count", "discount")
).replace(", SELECT", " UNION ALL SELECT")

SQL = {
    "left_join_translate": f"WITH {_P} SELECT p.product_category_name, product_id, product_name_lenght, product_description_lenght, product_category_name_english FROM p LEFT JOIN translations t ON p.product_category_name = t.product_category_name",
    "translate_with_additions": f"""WITH {_P} SELECT DISTINCT product_id, CASE WHEN t.product_category_name IS NOT NULL THEN product_category_name_english
        ELSE 'other_' || p.product_category_name END AS product_category_name_english FROM p LEFT JOIN translations t ON p.product_category_name = t.product_category_name""",
    "untranslated": f"WITH {_P} SELECT product_category_name, count(*) AS n FROM p ANTI JOIN translations USING (product_category_name) WHERE product_category_name IS NOT NULL GROUP BY 1",
    "fanout_join": f"WITH {_R}, {_I} SELECT review_id, r.order_id, product_id, review_score FROM r LEFT JOIN i ON r.order_id = i.order_id",
    "group_listagg": f"""WITH {_R}, {_I}, j AS (SELECT DISTINCT order_id, product_id FROM i)
        SELECT product_id, coalesce(string_agg(nullif(review_comment_message, ''), ' | ' ORDER BY r.created_at, review_id), '') AS review_comment_message
        FROM r JOIN j ON r.order_id = j.order_id WHERE product_id IS NOT NULL GROUP BY product_id""",
    "review_means": f"WITH {_R}, {_I} SELECT product_id, round(avg(review_score), 6) AS mean_score, count(*) AS n FROM r JOIN i ON r.order_id = i.order_id WHERE product_id IS NOT NULL GROUP BY product_id",
    "avg_price_left_join": f"WITH {_P}, {_I}, a AS (SELECT product_id, round(avg(price), 6) AS avg_price FROM i GROUP BY 1) SELECT product_id, avg_price FROM (SELECT DISTINCT product_id FROM p) LEFT JOIN a USING (product_id)",
    "orders_without_items": f"WITH {_R}, {_I} SELECT DISTINCT order_id FROM r ANTI JOIN i USING (order_id)",
    "integrity_counts": f"WITH {_I}, {_P}, d AS (SELECT DISTINCT product_id FROM i) SELECT count(*) AS sold, count(*) FILTER (WHERE product_id NOT IN (SELECT product_id FROM p)) AS \"unknown\" FROM d",
    "value_counts": f"WITH {_P} SELECT product_category_name, count(*) AS n FROM p WHERE product_category_name IS NOT NULL GROUP BY 1",
    "two_key_counts": f"WITH {_N} SELECT main, sub, count(*) AS n FROM n WHERE main IS NOT NULL AND sub IS NOT NULL GROUP BY 1, 2",
    "nunique": f"WITH {_I} SELECT count(DISTINCT product_id) AS products, count(DISTINCT order_id) AS orders, count(*) AS n FROM i",
    "distinct_with_null": "SELECT DISTINCT product_category_name FROM products",
    "null_profile": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, count({c}) AS filled FROM catalog_raw" for c in _COLUMNS),
    "describe_numeric": f"WITH {_N}, d AS ({_STATS}) SELECT column_name, n, " + ", ".join(f"round({c}, 4) AS {c}" for c in "mean sd lowest q1 middle q3 highest".split()) + " FROM d",
    "quadrant_counts": f"""WITH {_N}, m AS (SELECT median(price) AS p, median(rating) AS r FROM n)
        SELECT count(*) FILTER (WHERE price >= p AND rating >= r) AS premium, count(*) FILTER (WHERE price < p AND rating >= r) AS high_value,
            count(*) FILTER (WHERE price >= p AND rating < r) AS overpriced, count(*) FILTER (WHERE price < p AND rating < r) AS budget FROM n, m""",
    "boxplot_summary": f"""WITH {_N}, x AS (SELECT * FROM n WHERE price IS NOT NULL AND sub IS NOT NULL),
        t AS (SELECT sub FROM x GROUP BY sub ORDER BY count(*) DESC, sub LIMIT 5)
        SELECT sub, round(min(price), 4) AS lowest, round(quantile_cont(price, 0.25), 4) AS q1, round(quantile_cont(price, 0.5), 4) AS middle,
            round(quantile_cont(price, 0.75), 4) AS q3, round(max(price), 4) AS highest FROM x SEMI JOIN t USING (sub) GROUP BY sub""",
    "histogram": f"""WITH {_N}, x AS (SELECT rating AS x FROM n WHERE rating IS NOT NULL), m AS (SELECT min(x) AS lo, max(x) AS hi FROM x)
        SELECT least(floor((x - lo) / ((hi - lo) / 20)), 19)::BIGINT AS bin, count(*) AS n FROM x, m GROUP BY 1""",
    "top_brands": """WITH b AS (SELECT DISTINCT product_id, nullif(regexp_extract(product_name, '^([A-Za-z0-9]+)', 1), '') AS brand FROM catalog_raw)
        SELECT brand, count(*) AS n FROM b WHERE brand IS NOT NULL GROUP BY brand ORDER BY n DESC, brand LIMIT 10""",
    "word_frequencies": """WITH d AS (SELECT DISTINCT product_id, review_content FROM catalog_raw)
        SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(review_content), '[\\p{L}\\p{N}_]+')) AS word FROM d) GROUP BY word""",
    "any_null_filter": f"WITH {_N} SELECT product_id, price, rating, rating_count FROM n WHERE price IS NOT NULL AND rating IS NOT NULL AND rating_count IS NOT NULL AND discount IS NOT NULL AND main IS NOT NULL AND sub IS NOT NULL",
    "percentages": "SELECT source, count(*) AS n, round(count(*) / (SELECT count(source) FROM documents) * 100, 4) AS percent FROM documents WHERE source IS NOT NULL GROUP BY source",
    "word_ranges": """WITH x AS (SELECT len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n FROM documents WHERE text IS NOT NULL)
        SELECT CASE WHEN n < 5 THEN 'short' WHEN n > 10 AND n < 20 THEN 'medium' WHEN n > 50 THEN 'long' ELSE 'other' END AS size, count(*) AS n FROM x GROUP BY 1""",
    "predicates": "SELECT doc_id FROM documents WHERE contains(lower(text), 'cable') OR regexp_matches(text, '[áéíóúãõâêîôûç]')",
    "price_range": f"WITH {_N} SELECT product_id, price FROM n WHERE price BETWEEN 500 AND 1500",
    "unpivot_scores": """WITH d AS (SELECT DISTINCT query_id, product_id, bm25_score_norm, vector_score_norm FROM search_results)
        SELECT query_id, product_id, 'bm25_score_norm' AS score_name, bm25_score_norm AS score FROM d UNION ALL SELECT query_id, product_id, 'vector_score_norm', vector_score_norm FROM d""",
    "head_per_group": f"WITH {_P} SELECT * FROM p WHERE product_category_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY product_category_name ORDER BY product_id) <= 2",
    "star_join": """SELECT r_name, c_mktsegment, sum((l_extendedprice * (1 - l_discount))::DECIMAL(38,6))::DOUBLE AS revenue, count(*) AS n
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
    "new_products": f"WITH {_STATE} SELECT * FROM v ANTI JOIN s USING (vec_id)",
    "updated_products": f"WITH {_STATE} SELECT * FROM v SEMI JOIN s USING (vec_id) WHERE updated_at > TIMESTAMP '2024-07-01'",
    "embedding_upsert": f"""WITH {_STATE} SELECT *, CASE WHEN vec_id NOT IN (SELECT vec_id FROM s) OR updated_at > TIMESTAMP '2024-07-01' THEN 'fresh' ELSE 'kept' END AS kind FROM v""",
    "ttl_cache_valid": "SELECT event_id FROM events WHERE epoch_us((SELECT max(ts) FROM events)) / 1e6 - epoch_us(ts) / 1e6 < 604800",
    "chunk_resume": "SELECT doc_id, doc_id // 100 AS chunk_id FROM documents WHERE (doc_id // 100) % 3 <> 0",
    "cache_keys": "SELECT doc_id, doc_id || '_' || sha256(coalesce(text, '')) AS key FROM documents",
    "csv_roundtrip": "SELECT review_id, order_id, review_comment_message FROM order_reviews",
    "log_parse": f"WITH {_LOG} SELECT * FROM l",
    "log_statistics": f"WITH {_LOG} SELECT detector, language, count(*) AS n, round(avg(confidence), 6) AS confidence, round(max(time_ms), 4) AS slowest FROM l GROUP BY ALL",
    "html_image_url": "SELECT DISTINCT product_id, image_url FROM catalog_raw",
    "product_etl": f"""WITH pr AS (SELECT DISTINCT product_id, product_category_name FROM products), it AS (SELECT DISTINCT order_id, product_id, price, created_at FROM order_items),
        rv AS (SELECT DISTINCT review_id, order_id, review_comment_message, review_score, created_at FROM order_reviews),
        j AS (SELECT rv.*, product_id FROM rv JOIN (SELECT DISTINCT order_id, product_id FROM it) k ON rv.order_id = k.order_id),
        texts AS (SELECT product_id, coalesce(string_agg(nullif(review_comment_message, ''), ' | ' ORDER BY created_at, review_id), '') AS reviews FROM j WHERE product_id IS NOT NULL GROUP BY 1),
        prices AS (SELECT product_id, avg(price) AS price FROM it GROUP BY 1),
        base AS (
            SELECT pr.product_id AS doc_id, price, concat_ws(' | ', 'category: ' || product_category_name, 'product: ' || pr.product_id, 'review: ' || nullif(reviews, '')) AS text
            FROM pr LEFT JOIN texts ON pr.product_id = texts.product_id LEFT JOIN prices ON pr.product_id = prices.product_id),
        {X.DETECT_SQL.replace("FROM documents", "FROM base")},
        c AS (SELECT *, {X.clean_sql('text', True, 3)} AS cleaned_text FROM base),
        n AS (SELECT *, len({X.words_sql('cleaned_text')}) AS word_count FROM c)
        SELECT n.doc_id AS product_id, text AS original_text, cleaned_text, {X.share_sql('text')} AS preprocessor_language,
            CASE WHEN word_count < 3 THEN 'no_content' ELSE language END AS detected_language, CASE WHEN word_count < 3 THEN 0.0::DOUBLE ELSE round(confidence, 6) END AS confidence,
            round(price, 6) AS price, word_count FROM n JOIN found USING (doc_id)""",
    "review_analysis": f"""WITH c AS (SELECT DISTINCT product_id, review_content FROM catalog_raw),
        t AS (SELECT product_id, lower(array_to_string(list_filter(string_split(coalesce(review_content, ''), ' | '), lambda r: trim(r) <> '')[:10], ' ')) AS t FROM c),
        n AS (SELECT product_id, len(list_filter(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+'), lambda w: list_contains({V.PRAISE}, w))) AS p,
            len(list_filter(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+'), lambda w: list_contains({V.REGRET}, w))) AS m FROM t),
        s AS (SELECT product_id, CASE WHEN p + m > 0 THEN p / (p + m) * 10.0::DOUBLE ELSE 5.0::DOUBLE END AS s FROM n)
        SELECT product_id, round(s, 6) AS sentiment, CASE WHEN s > 6 THEN 'positive' WHEN s < 4 THEN 'negative' ELSE 'neutral' END AS general_sentiment, round(s / 10, 6) AS score FROM s""",
    "topic_quality": f"""WITH x AS (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: contains(lower(s), 'charger')) AS ss FROM documents),
        u AS (SELECT doc_id, regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM (SELECT doc_id, unnest(ss) AS s FROM x)),
        n AS (SELECT doc_id, len(list_filter(ws, lambda w: list_contains({V.PRAISE}, w))) AS p, len(list_filter(ws, lambda w: list_contains({V.REGRET}, w))) AS m FROM u),
        a AS (SELECT doc_id, avg(CASE WHEN p + m > 0 THEN p / (p + m) * 10.0::DOUBLE ELSE 5.0::DOUBLE END * 0.4::DOUBLE + 1) AS stars FROM n GROUP BY doc_id)
        SELECT doc_id, round(stars, 6) AS stars, CASE WHEN round(stars, 9) >= 4 THEN 'strong' WHEN round(stars, 9) >= 3 THEN 'moderate' ELSE 'none' END AS quality FROM documents LEFT JOIN a USING (doc_id)""",
    "plugin_detector": """SELECT CASE WHEN regexp_matches(coalesce(review_comment_message, ''), '[ãõç]') THEN 'pt' ELSE 'unknown' END AS language, 'broken_failed' AS second, count(*) AS n
        FROM (SELECT DISTINCT review_id, review_comment_message FROM order_reviews) GROUP BY ALL""",
    "events_tumbling": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "events_session": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        k AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, min(ts) AS session_start, count(*) AS n FROM k GROUP BY user_id, k""",
}
