"""The batch job that makes the searchable product table, and small tools around results."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import labelled
from gristmill.operators import detectors as D
from gristmill.operators.relational import group_concat, left_lookup


def product_table(products: DataFrame, translations: DataFrame, items: DataFrame, reviews: DataFrame) -> DataFrame:
    """(product_id, product_category_name, product_category_name_english, reviews, mean_score, price) of each product.

    Rows that are repeated count once; products without reviews or items have nulls there.
    """
    products, items, reviews = products.distinct(), items.distinct(), reviews.distinct()
    joined = reviews.join(items.select("order_id", "product_id").distinct(), "order_id", "left").filter(F.col("product_id").isNotNull())
    texts = group_concat(joined, "product_id", "review_comment_message", ["created_at", "review_id"]).withColumnRenamed("review_comment_message", "reviews")
    scores = joined.groupBy("product_id").agg(F.avg("review_score").alias("mean_score"))
    prices = items.groupBy("product_id").agg(F.avg("price").alias("price"))
    out = left_lookup(products.select("product_id", "product_category_name").distinct(), translations, "product_category_name")
    for part in (texts, scores, prices):
        out = out.join(part, "product_id", "left")
    return out


def searchable(table: DataFrame, min_words: int = 3) -> DataFrame:
    """The product table with its combined text cleaned and its language detected; short texts are not asked."""
    text = labelled(" | ", ("category: ", F.col("product_category_name")), ("product: ", F.col("product_id")), ("review: ", F.nullif("reviews", F.lit(""))))
    with_text = table.withColumn("original_text", text)
    read = with_text.select("product_id", "price", "original_text", D.with_metadata(F.col("original_text")).alias("m"), D.word_list(F.col("original_text")).alias("d"))
    short = F.col("m.word_count") < min_words
    return read.select(
        "product_id", "original_text", F.col("m.cleaned").alias("cleaned_text"), F.col("m.language").alias("preprocessor_language"),
        F.when(short, "no_content").otherwise(F.col("d.language")).alias("detected_language"),
        F.when(short, 0.0).otherwise(F.col("d.confidence")).alias("confidence"), "price", "m.word_count",
    )


def with_files(df: DataFrame, files: DataFrame, name: str, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(rows that have a file of their name, side table of those that have none); the name is the file's stem."""
    stems = files.withColumn(name, F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1))
    return df.join(stems, name), df.join(stems.select(name), name, "left_anti").select(name)


def shown(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of `columns` that the table has."""
    return df.select(*[c for c in columns if c in df.columns])


def html_report(df: DataFrame, order: list[str], rows: int = 50) -> str:
    """The first rows, in order, as an HTML table: a report for people."""
    return df.orderBy(*order).limit(rows).toPandas().to_html(index=False)


def compare_rankings(first: DataFrame, second: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank_before, rank_after, moved) of documents in either of two rankings."""
    a = first.select("query_id", "doc_id", F.col("rank").alias("rank_before"))
    b = second.select("query_id", "doc_id", F.col("rank").alias("rank_after"))
    return a.join(b, ["query_id", "doc_id"], "full").withColumn("moved", F.col("rank_before") - F.col("rank_after"))


def timed(work: Callable, *args, **kwargs) -> tuple[object, float]:
    """The result of a call and its seconds; pass a call that ends in an action."""
    began = time.perf_counter()
    return work(*args, **kwargs), time.perf_counter() - began
