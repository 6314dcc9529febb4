"""Queries of the llm problems, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.numbers import read_count, read_count_sql
from gristmill.llm.bpe import corpus_ids
from gristmill.llm.folding import fold_sql, same_look_classes, same_look_pairs, with_folded
from gristmill.llm.language import languages_of, mislabelled, train_on, with_languages
from gristmill.llm.leakage import leaked
from gristmill.llm.listings import group_listings, same_product_pairs
from gristmill.llm.ranking import leximin, leximin_top
from gristmill.llm.vectors import nearest, similar_pairs
from gristmill.sources.tables import table


def _candidates(spark: SparkSession, sf: str) -> tuple[DataFrame, dict]:
    df = table(spark, sf, "search_results")
    return df, {
        "hybrid_score": F.col("hybrid_score"),
        "rating_count": read_count(F.col("rating_count")),
        "price_usd": -F.col("price_usd"),
    }


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """The first five products of each query."""
    df, scores = _candidates(spark, sf)
    return leximin_top(df, "query_id", "product_id", scores, 5).select("query_id", "product_id")


def p1_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate of each query with its place."""
    df, scores = _candidates(spark, sf)
    return leximin(df, "query_id", "product_id", scores).select("query_id", "product_id", "position")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of vectors with cosine similarity of at least 0.9."""
    df = table(spark, sf, "combined_embeddings").select("vec_id", "embedding")
    return similar_pairs(df, "vec_id", "embedding", 0.9).select("vec_id_a", "vec_id_b")


def p2_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most similar vectors of every hundredth vector, among all vectors."""
    df = table(spark, sf, "combined_embeddings").select("vec_id", "embedding")
    return nearest(df, "vec_id", "embedding", 10, query="vec_id % 100 = 0").withColumn("similarity", F.round("similarity", 6))


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The product group of every offer."""
    return group_listings(table(spark, sf, "catalog_raw"), "product_id", "product_name", "about_product")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every two offers of one product."""
    return same_product_pairs(p3_groups(spark, sf), "product_id")


def _comments(spark: SparkSession, sf: str) -> DataFrame:
    """Comments of both tables with their declared language."""
    reviews = table(spark, sf, "order_reviews").select(
        F.lit("order_reviews").alias("src_table"),
        F.col("review_id").cast("string").alias("record_id"),
        F.col("review_comment_message").alias("text"),
        F.col("declared_lang").alias("label"),
    )
    offers = table(spark, sf, "catalog_raw").select(
        F.lit("catalog_raw").alias("src_table"),
        F.col("product_id").alias("record_id"),
        F.col("review_content").alias("text"),
        F.col("review_lang").alias("label"),
    )
    return reviews.unionAll(offers)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Comments whose label is missing, wrong or not enough, with each language they hold."""
    df = _comments(spark, sf)
    model = train_on(df, "record_id", "text", "label")
    seen = with_languages(df, "text", "parts", model).select("src_table", "record_id", "label", languages_of(F.col("parts")).alias("languages"))
    cases = seen.filter(mislabelled(F.col("label"), F.col("languages")))
    return cases.select("src_table", "record_id", F.explode("languages").alias("lang_code")).distinct()


def p4_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Every sentence of every comment, and every part of one that changes its language, with its place, language and confidence."""
    df = _comments(spark, sf).distinct()
    model = train_on(df, "record_id", "text", "label")
    parts = with_languages(df, "text", "parts", model, within=True).select("src_table", "record_id", F.inline("parts"))
    return parts.withColumn("confidence", F.round("confidence", 4)).distinct()


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document."""
    return corpus_ids(table(spark, sf, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold ten or more consecutive words of a test question."""
    found = leaked(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "question")
    return found.select("doc_id", "item_id")


def p8_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the length of the longest shared run, the test side read from question and answer."""
    tests = table(spark, sf, "eval_items").select("item_id", F.concat_ws(" ", "question", "answer").alias("passage"))
    return leaked(table(spark, sf, "documents"), "doc_id", "text", tests, "item_id", "passage")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that look the same and are stored differently."""
    return same_look_pairs(table(spark, sf, "documents"), "doc_id", "text")


def p9_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Every document in its one consistent form."""
    return with_folded(table(spark, sf, "documents").select("doc_id", "text"), "text", "folded").select("doc_id", "folded")


def p9_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The class of every document that looks the same as another one that is stored differently."""
    return same_look_classes(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "class_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_ranking": p1_ranking,
    "p2_found": p2_found,
    "p2_nearest": p2_nearest,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p4_found": p4_found,
    "p4_segments": p4_segments,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_runs": p8_runs,
    "p9_found": p9_found,
    "p9_texts": p9_texts,
    "p9_classes": p9_classes,
}

_P1 = f"""
    WITH c AS (
        SELECT query_id, product_id, max(hybrid_score) AS h, max(-price_usd) AS p,
            max({read_count_sql("rating_count")}) AS r
        FROM search_results GROUP BY query_id, product_id),
    l AS (
        SELECT query_id, product_id, s.d AS d, coalesce(s.v, '-inf'::DOUBLE) AS v
        FROM (SELECT query_id, product_id, unnest([{{'d': 1, 'v': h}}, {{'d': 2, 'v': r}}, {{'d': 3, 'v': p}}]) AS s FROM c)),
    s AS (
        SELECT query_id, product_id,
            (rank() OVER (PARTITION BY query_id, d ORDER BY v) - 1 + count(*) OVER (PARTITION BY query_id, d, v) / 2.0)
            / count(*) OVER (PARTITION BY query_id, d) AS p
        FROM l),
    a AS (SELECT query_id, product_id, list_sort(list(p)) AS standing FROM s GROUP BY query_id, product_id),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY standing DESC, product_id) AS position FROM a)
"""

_FOLDED = f"folded AS (SELECT doc_id, text, {fold_sql('text')} AS f FROM documents WHERE text <> '')"
_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
#: Windows of ten words as one string each.
_TENS = "unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(list_slice(w, i, i + 9), ' ')))"

SQL = {
    "p8_found": f"""
        WITH d AS (SELECT DISTINCT doc_id, {_WORDS.format(fold_sql("text"))} AS w FROM documents),
        e AS (SELECT item_id, {_WORDS.format(fold_sql("question"))} AS w FROM eval_items),
        dw AS (SELECT doc_id, {_TENS} AS ten FROM d WHERE len(w) >= 10), ew AS (SELECT item_id, {_TENS} AS ten FROM e WHERE len(w) >= 10)
        SELECT DISTINCT doc_id, item_id FROM dw JOIN ew USING (ten)
    """,
    "p8_runs": f"""
        WITH d AS (SELECT DISTINCT doc_id, {_WORDS.format(fold_sql("text"))} AS w FROM documents),
        e AS (SELECT item_id, {_WORDS.format(fold_sql("concat_ws(' ', question, answer)"))} AS w FROM eval_items),
        dw AS (SELECT doc_id, hash(w) AS of, {_TENS} AS ten, unnest(range(1, len(w) - 8)) AS i FROM d WHERE len(w) >= 10),
        ew AS (SELECT item_id, {_TENS} AS ten, unnest(range(1, len(w) - 8)) AS j FROM e WHERE len(w) >= 10),
        met AS (SELECT DISTINCT doc_id, of, item_id, i, i - j AS apart FROM dw JOIN ew USING (ten)),
        runs AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, of, item_id, apart ORDER BY i) AS run FROM met),
        sized AS (SELECT doc_id, item_id, count(*) + 9 AS words FROM runs GROUP BY doc_id, of, item_id, apart, run)
        SELECT doc_id, item_id, max(words)::INT AS words FROM sized GROUP BY ALL
    """,
    "p9_texts": f"SELECT doc_id, {fold_sql('text')} AS folded FROM documents",
    "p9_found": f"""
        WITH {_FOLDED}
        SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM folded a JOIN folded b ON a.f = b.f AND a.doc_id < b.doc_id AND a.text <> b.text
        WHERE regexp_matches(a.f, '[^\\s]')
    """,
    "p9_classes": f"""
        WITH {_FOLDED}
        SELECT DISTINCT doc_id, md5(f) AS class_id FROM folded WHERE f IN (
            SELECT f FROM folded WHERE regexp_matches(f, '[^\\s]') GROUP BY f HAVING count(DISTINCT text) > 1)
    """,
    "p1_found": _P1 + "SELECT query_id, product_id FROM o WHERE position <= 5",
    "p1_ranking": _P1 + "SELECT query_id, product_id, position FROM o",
    "p2_found": """
        WITH n AS (
            SELECT vec_id, embedding::DOUBLE[64] AS v FROM (
                SELECT DISTINCT vec_id, embedding FROM combined_embeddings WHERE len(embedding) = 64)
            WHERE list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0)
        SELECT a.vec_id AS vec_id_a, b.vec_id AS vec_id_b FROM n a JOIN n b ON a.vec_id < b.vec_id
        WHERE array_cosine_similarity(a.v, b.v) >= 0.9
    """,
}
