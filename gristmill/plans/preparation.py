"""Queries of the general preparation problems: gaps in numeric fields, and packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.numbers import read_count, read_money, read_rating
from gristmill.operators.imputation import impute, masked_error
from gristmill.operators.packed import CATEGORY, REVIEWS, split_values, unpack
from gristmill.sources.tables import table


def _offers(spark: SparkSession, sf: str) -> DataFrame:
    """Offers once each, with the numbers of their text fields and the top of their category path."""
    raw = table(spark, sf, "catalog_raw").select(
        "product_id", "category", "discounted_price", "actual_price", "rating", "rating_count", "seller_id"
    )
    raw = raw.distinct()  # an offer loaded twice is the same in all of these
    levels = split_values(F.col("category"), CATEGORY)
    return raw.select(
        "product_id",
        F.get(levels, F.lit(0))["item_value"].alias("top_category"),
        F.get(levels, F.size(levels) - 1)["item_value"].alias("leaf_category"),
        F.log1p(read_money(F.col("discounted_price"))).alias("log_price"),
        F.log1p(read_money(F.col("actual_price"))).alias("log_list_price"),
        read_rating(F.col("rating")).alias("rating"),
        read_count(F.col("rating_count")).alias("rating_count"),
        F.log1p(read_count(F.col("rating_count"))).alias("log_count"),
    )


# The fields to be filled steer no cluster: clusters that differ by them would be told apart by chance where they are missing.
FEATURES, KINDS = ["log_price", "log_list_price"], ["leaf_category", "top_category"]


def p5_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Every rating and rating_count of the catalogue, read or filled, with the method that gave it."""
    return impute(_offers(spark, sf), "product_id", ["rating", "rating_count"], FEATURES, KINDS)


def p5_categories(spark: SparkSession, sf: str) -> DataFrame:
    """The category levels and the rating of every offer, read or filled with the mode or median of its cluster."""
    return impute(_offers(spark, sf), "product_id", ["rating"], FEATURES, KINDS, words=KINDS)


def p5_masked(spark: SparkSession, sf: str) -> DataFrame:
    """Mean absolute error of filled values where a tenth of the known ones was hidden, beside that of category medians."""
    offers = _offers(spark, sf)
    counts = masked_error(offers, "product_id", "log_count", FEATURES, KINDS)
    return masked_error(offers, "product_id", "rating", FEATURES, KINDS).unionByName(counts)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The fields that had to be filled."""
    return p5_filled(spark, sf).filter(F.col("method") != "observed").select("product_id", "field_name").distinct()


def p6_values(spark: SparkSession, sf: str) -> DataFrame:
    """All values of the packed fields with how each was written."""
    return unpack(table(spark, sf, "catalog_raw"), "product_id", {"category": CATEGORY, "review_content": REVIEWS})


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """All values of the packed fields, one per row."""
    return p6_values(spark, sf).select("product_id", "field_name", "pos", "item_value")


QUERIES = {"p5_found": p5_found, "p5_filled": p5_filled, "p5_categories": p5_categories, "p5_masked": p5_masked, "p6_found": p6_found, "p6_values": p6_values}

_BLANKS = "\\x{0B}\\f\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"


def _items_sql(field: str, delimiter: str) -> str:
    """(product_id, field_name, n, value) of a packed field, one value a step: a quoted one, if a delimiter or the end follows, else a bare one."""
    quoted = f"regexp_extract(rest, '^[\\s{_BLANKS}]*(\"(?:[^\"]|\"\")*\")[ {_BLANKS}]*(?:(?:{delimiter})|\\z)', 1)"
    whole = f"regexp_extract(rest, '^[\\s{_BLANKS}]*\"(?:[^\"]|\"\")*\"[ {_BLANKS}]*')"
    bare = f"regexp_extract(rest, '(?s)^(.*?)(?:(?:{delimiter})|\\z)', 1)"
    strip = lambda t: f"regexp_replace({t}, '^[\\s\\x{{0B}}\\x{{A0}}\\x{{3000}}]+|[\\s\\x{{0B}}\\x{{A0}}\\x{{3000}}]+$', '', 'g')"
    return f"""
        {field}_steps(product_id, source, n, value, quoted, rest) AS (
            SELECT product_id, source, 0, NULL::VARCHAR, NULL::BOOLEAN, {field} FROM (SELECT product_id, {field} || coalesce(md5({"review_content" if field == "category" else "category"}), '') AS source, {field} FROM once) WHERE {field} IS NOT NULL
            UNION ALL
            SELECT product_id, source, n + 1, value, quoted, CASE WHEN left_over <> '' THEN regexp_replace(left_over, '^(?:{delimiter})', '') END FROM (
                SELECT product_id, source, n, q <> '' AS quoted,
                    CASE WHEN q <> '' THEN {strip("replace(substr(q, 2, length(q) - 2), '\"\"', '\"')")} ELSE {strip("b")} END AS value,
                    substr(rest, length(CASE WHEN q <> '' THEN w ELSE b END) + 1) AS left_over
                FROM (SELECT *, {quoted} AS q, {whole} AS w, {bare} AS b FROM {field}_steps WHERE rest IS NOT NULL))),
        {field}_values AS (
            SELECT DISTINCT product_id, '{field}' AS field_name, row_number() OVER (PARTITION BY product_id, source ORDER BY n)::INT AS pos, value AS item_value,
                CASE WHEN quoted THEN 'quoted' ELSE 'bare' END AS kind, NOT quoted AND (value LIKE '\"%' OR value LIKE '%\"') AS malformed
            FROM {field}_steps WHERE value <> '')"""


_VALUES = f"""
        WITH RECURSIVE once AS (SELECT DISTINCT product_id, category, review_content FROM catalog_raw),
        {_items_sql("category", CATEGORY.delimiter)}, {_items_sql("review_content", REVIEWS.delimiter)},
        found AS (SELECT * FROM category_values UNION ALL SELECT * FROM review_content_values)
        SELECT"""

SQL = {
    "p6_found": f"{_VALUES} product_id, field_name, pos, item_value FROM found",
    "p6_values": f"{_VALUES} * FROM found",
    "p5_found": """
        SELECT DISTINCT product_id, 'rating' AS field_name FROM catalog_raw
        WHERE NOT regexp_matches(coalesce(rating, ''), '[0-9]')
        UNION ALL
        SELECT DISTINCT product_id, 'rating_count' AS field_name FROM catalog_raw
        WHERE NOT regexp_matches(coalesce(rating_count, ''), '[0-9]')
    """,
}
