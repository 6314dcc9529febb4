"""Smaller operators of the inventory as queries: filters, casts, profiles, files, plug-ins, comparisons of rankings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import numbers as N
from gristmill.functions import text as T
from gristmill.functions import vectors as V
from gristmill.operators import analysis as A
from gristmill.operators import dense, detectors, etl, fusion, incremental, plugins, relational
from gristmill.plans import search, tables, texts
from gristmill.session import shared_folder
from gristmill.sources import files
from gristmill.sources.tables import table


def _candidates(s: SparkSession, sf: str) -> DataFrame:
    return table(s, sf, "search_results").select("query_id", F.col("product_id").alias("doc_id"), "query_text", "vector_score", "bm25_score", "price_usd").distinct()


def _folder(s: SparkSession, name: str) -> str:
    """A new folder for files that a query writes and reads again, where all executors see it."""
    shared = shared_folder(s)
    parent = shared.removeprefix("file://") if shared else None
    if parent:
        os.makedirs(parent, exist_ok=True)
    return tempfile.mkdtemp(prefix=f"gristmill-{name}-", dir=parent)


def bounded_candidates(s, sf):
    """Candidates below the bound that their query's text names; here each query names one, and every fifth the bound 0."""
    bound = A.upper_bound(F.concat("query_text", F.lit(" under "), (F.col("query_id") % 5 * 20).cast("string"), F.lit(" USD")))
    return _candidates(s, sf).filter(fusion.below(F.col("price_usd"), bound)).select("query_id", "doc_id").distinct()


def near_vectors(s, sf):
    """The ten nearest by squared distance of every hundredth vector, those within a distance."""
    df = table(s, sf, "combined_embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    asked = df.filter(F.col("doc_id") % 100 == 0).withColumnRenamed("doc_id", "query_id")
    return dense.scan_topk(df, asked, 10, 64, "l2").filter(F.col("score") <= 1.0).select("query_id", "doc_id", "score")


CATEGORY_TERMS = ["cable", "charger", "lamp"]


def in_categories(s, sf):
    """Offers whose category holds any of a list of terms, in any case."""
    offers = table(s, sf, "catalog_raw").filter(T.contains_any(F.lower("category"), CATEGORY_TERMS))
    return offers.select("product_id", "category").distinct()


def strict_numbers(s, sf):
    """Prices of orders as text and back by the cast that fails on what is no number."""
    rows = table(s, sf, "order_items").select("order_id", "product_id", "price").distinct()
    return rows.withColumn("price", N.strict_number(F.col("price").cast("string")))


def point_sizes(s, sf):
    """Lengths of documents carried over to sizes from 20 to 200."""
    d = table(s, sf, "documents").select("doc_id", "n_chars")
    lo, hi = d.select(F.min("n_chars")).scalar(), d.select(F.max("n_chars")).scalar()
    return d.select("doc_id", F.round(N.interpolated(F.col("n_chars"), lo, hi, 20.0, 200.0), 6).alias("size"))


def table_profile(s, sf):
    return relational.profile(table(s, sf, "order_reviews").select("review_id", "order_id", "review_comment_title", "review_score"))


def first_match(s, sf):
    d = table(s, sf, "catalog_raw").select("product_id", "product_name")
    return relational.first_match(d, F.lower("product_name").contains("cable"), "product_id", "product_name")


def membership(s, sf):
    """Whether the product of each order item stands in the product table."""
    items = table(s, sf, "order_items").select("order_id", "product_id").distinct()
    return relational.member_flags(items, "product_id", table(s, sf, "products").select("product_id"), "known")


def clamped_scores(s, sf):
    """Scores clamped to 0 to 1 and to 0 to 10, with gaps as 0."""
    c = _candidates(s, sf)
    return c.select(
        "query_id", "doc_id", fusion.within(F.col("vector_score"), 0.0, 1.0).alias("unit"), fusion.within(F.col("bm25_score"), 0.0, 10.0).alias("ten"),
        V.clean_number(F.col("price_usd")).alias("price"),
    )


def zero_vectors(s, sf):
    """Length of each vector after those that are missing were given as zeros."""
    d = table(s, sf, "combined_embeddings").select("vec_id", V.or_zero(F.col("embedding"), 64).alias("v"))
    return d.select("vec_id", F.size("v").alias("dim"), F.round(V.norm(F.col("v")), 5).alias("norm"))


def product_content(s, sf):
    """Name, description, category and reviews as one text with its language and counts."""
    d = table(s, sf, "catalog_raw").select("product_id", "product_name", "about_product", "category", "review_content").distinct()
    m = detectors.with_metadata(F.concat_ws(" ", "product_name", "about_product", "category", "review_content"))
    return d.select("product_id", m.alias("m")).select("product_id", F.col("m.language").alias("language"), F.col("m.has_accents").alias("has_accents"), F.col("m.word_count").alias("word_count"))


def unknown_texts(s, sf):
    """Texts whose language the word lists do not know, the longest first in their own right."""
    d = table(s, sf, "documents").select("doc_id", "text", detectors.word_list(F.col("text")).alias("r"))
    return d.filter("r.language = 'unknown'").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("length"))


def asked_again(s, sf):
    """Word lists first; the older lists are asked only for texts of which those are unsure."""
    d = table(s, sf, "documents").select("doc_id", "text", detectors.word_list(F.col("text")).alias("r"))
    found = detectors.asked_again(d, "r", 0.6, lambda unsure: unsure.withColumn("r", detectors.word_list_v1(F.col("text"))))
    return found.select("doc_id", F.col("r.language").alias("language"), F.round("r.confidence", 6).alias("confidence"))


def slowest_detector(s, sf):
    """The longest processing time among the records of one log."""
    logs = table(s, sf, "documents").filter("source = 'detector_log'").select("doc_id", files.parse_log(F.col("text")).alias("r"))
    return logs.select("doc_id", F.round(F.array_max(F.transform("r", lambda r: r["time_ms"])), 4).alias("slowest")).filter("slowest IS NOT NULL")


def prompt_answers(s, sf):
    """Prompts where no model is loaded: every answer names the error."""
    q = table(s, sf, "search_results").select("query_id", "query_text").distinct()
    return plugins.prompted(q, "query_text", "answer").select("query_id", F.get_json_object("answer", "$.error").alias("error"))


def percent_rerank(s, sf):
    """The first five of each query by a 0 to 100 score, the first whole number of an answer; the name of the offer answers."""
    names = table(s, sf, "catalog_raw").select(F.col("product_id").alias("doc_id"), "product_name").distinct()
    c = _candidates(s, sf).select("query_id", "doc_id").distinct().join(names, "doc_id").withColumn("score", plugins.percent_score(F.col("product_name")))
    return fusion.head(c, "score", 5).select("query_id", "doc_id", "score", "rank")


def matrix_file(s, sf):
    """Vectors written as a matrix file and read again, by their place in the order of ids."""
    path = os.path.join(_folder(s, "matrix"), "m.npy")
    files.write_npy(table(s, sf, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", path)
    return files.read_npy(s, path).select("row", F.round(V.norm(F.col("embedding")), 4).alias("norm"))


def stored_cells(s, sf):
    """A clustered index written, and searched in all its cells for one vector: the exact result."""
    folder = _folder(s, "cells")
    df = table(s, sf, "embeddings").select("vec_id", "embedding")
    dense.save_cells(*dense.kmeans_cells(df, "vec_id", "embedding", 8), folder)
    query = df.orderBy("vec_id").first().embedding
    return dense.search_cells(s, folder, "vec_id", "embedding", list(query), 10, 8)


def chunked_run(s, sf):
    """Texts measured chunk by chunk in two runs, the second of which finds some chunks done."""
    folder = _folder(s, "chunks")
    d = table(s, sf, "documents").select("doc_id", "n_chars")
    work = lambda part: part.select("doc_id", (F.col("n_chars") * 2).alias("twice"), "chunk_id")
    incremental.run_chunks(d.filter("doc_id % 200 < 100"), "doc_id", 100, folder, work)
    incremental.run_chunks(d, "doc_id", 100, folder, work)
    return s.read.parquet(folder).select("doc_id", "twice", F.col("chunk_id").cast("bigint").alias("chunk_id"))


def moved_ranks(s, sf):
    """How the sparse and the dense order of the candidates of each query differ."""
    c = _candidates(s, sf).groupBy("query_id", "doc_id").agg(F.max("bm25_score").alias("a"), F.max("vector_score").alias("b"))
    return etl.compare_rankings(fusion.ranked(c, "a"), fusion.ranked(c, "b"))


def _as_files(s: SparkSession, sf: str) -> DataFrame:
    """Documents as the files they might be: their path and bytes."""
    d = table(s, sf, "documents").filter("text <> ''")
    return d.select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "utf-8").alias("content"))


def file_embeddings(s, sf):
    e = plugins.embed_files(_as_files(s, sf), plugins.ByteCountEncoder, 16)
    return e.select(F.col("path").cast("bigint").alias("doc_id"), F.round(V.norm(F.col("embedding")), 6).alias("norm"))


def file_captions(s, sf):
    return plugins.caption(_as_files(s, sf), plugins.SizeCaptioner).select(F.col("path").cast("bigint").alias("doc_id"), "caption")


def pooled_vectors(s, sf):
    """Mean of the vectors of each label, those of even ids taken, and its softmax."""
    d = table(s, sf, "embeddings").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", F.slice("embedding", 1, 4).cast("array<double>").alias("v")))).alias("r"))
    vectors, mask = F.transform("r", lambda x: x["v"]), F.transform("r", lambda x: F.when(x["vec_id"] % 2 == 0, 1).otherwise(0))
    d = d.select("label", plugins.mean_pool(vectors, mask).alias("m"))
    return d.select("label", F.transform("m", lambda x: F.round(x, 5)).alias("mean"), F.transform(plugins.softmax(F.col("m")), lambda x: F.round(x, 5)).alias("softmax"))


def hashed_encoding(s, sf):
    """Vectors of documents by the default encoder, component by component."""
    e = plugins.encode(table(s, sf, "documents").select("doc_id", "text"), "text", "v")
    return e.select("doc_id", F.transform("v", lambda x: F.round(x, 6)).alias("vector"))


def short_encoding(s, sf):
    """The same of the first 77 words of each text."""
    e = plugins.encode(table(s, sf, "documents").select("doc_id", "text"), "text", "v", lambda: plugins.HashingEncoder(words=77))
    return e.select("doc_id", F.transform("v", lambda x: F.round(x, 6)).alias("vector"))


def text_search(s, sf):
    """The ten documents nearest to each query text, by squared distance of their vectors."""
    texts = table(s, sf, "search_results").select("query_id", F.col("query_text").alias("text")).distinct()
    vectors = plugins.encode(table(s, sf, "documents").select("doc_id", "text"), "text", "v").select("doc_id", "v")
    found = dense.scan_topk(vectors, plugins.encode(texts, "text", "v").select("query_id", "v"), 10, 64, "l2")
    return found.select("query_id", "doc_id", F.col("score").alias("distance"), "rank")


def query_analysis_demo(s, sf):
    """The rules of the demonstration search."""
    q = table(s, sf, "search_results").select("query_id", "query_text").distinct()
    features = F.array_join(A.key_features(F.col("query_text"), A.DEMO_FEATURES), ",")
    return q.select("query_id", A.product_type(F.col("query_text"), A.DEMO_TYPES).alias("product_type"), features.alias("key_features"))


def snapshot_history(s, sf):
    """What an update of a stored half of the vectors brings in."""
    v = table(s, sf, "combined_embeddings").select("vec_id", "updated_at")
    since = F.lit("2024-07-01").cast("timestamp_ntz")
    state, history = incremental.update_snapshot(v.filter("vec_id % 2 = 0"), v, "vec_id", "updated_at", since, F.lit("2025-01-01"))
    return history.join(state.agg(F.count("*").alias("n_rows")))


def missing_csv(s, sf):
    """A path that is not there is an empty table of the schema."""
    return files.read_csv(s, os.path.join(_folder(s, "none"), "absent.csv"), "id bigint, name string")


def csv_columns(s, sf):
    """The header of a CSV that a table was written to, and its columns that are shown."""
    path = os.path.join(_folder(s, "header"), "t")
    files.write_csv(etl.shown(table(s, sf, "order_reviews"), ["review_id", "absent", "order_id"]), path)
    return s.createDataFrame([(i, c) for i, c in enumerate(files.csv_header(s, path))], "position bigint, column_name string")


def listed_files(s, sf):
    """Names and sizes of files in a folder that were written there, and the products that have none."""
    folder = _folder(s, "files")
    for name, content in (("a.csv", "x"), ("b.csv", "xyz"), ("c.txt", "")):
        with open(os.path.join(folder, name), "w") as f:
            f.write(content)
    found = files.list_files(s, folder)
    names = s.createDataFrame([("a",), ("b",), ("d",)], "name string")
    have, lack = etl.with_files(names, found.select("path", "length"), "name")
    return have.select("name", "length").unionByName(lack.select("name", F.lit(None).cast("bigint").alias("length")))


def log_roundtrip(s, sf):
    """Detections written as records of a log and read again."""
    d = table(s, sf, "documents").select("doc_id", "text", detectors.word_list(F.col("text")).alias("r"))
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z ]", "")
    log = files.log_text(F.col("r.method_used"), plain, F.col("r.language"), F.lit(0.75), F.lit(1.5))
    return d.select("doc_id", F.inline(files.parse_log(log))).select("doc_id", "detector", "text", "language", "confidence", "time_ms")


def report_rows(s, sf):
    """How many rows, and which columns, the report of a table shows."""
    html = etl.html_report(etl.shown(table(s, sf, "region"), ["r_regionkey", "r_name"]), ["r_regionkey"], 3)
    return s.createDataFrame([(html.count("<tr") - 1, html.count("<th>r_"))], "n_rows bigint, n_columns bigint")


def state_document(s, sf):
    """A small state written, replaced and read again; a broken one gives the default."""
    path = os.path.join(_folder(s, "state"), "s.json")
    n = table(s, sf, "documents").count()
    before = files.read_state(path, {"total": -1})["total"]
    files.write_state(path, {"total": n})
    return s.createDataFrame([(before, files.read_state(path, {})["total"])], "before bigint, after bigint")


_NAMES = (
    hashed_encoding, short_encoding, text_search, query_analysis_demo, snapshot_history, missing_csv, csv_columns, listed_files, log_roundtrip, report_rows, state_document,
    bounded_candidates, near_vectors, in_categories, strict_numbers, point_sizes, table_profile, first_match, membership, clamped_scores, zero_vectors,
    product_content, unknown_texts, asked_again, slowest_detector, prompt_answers, percent_rerank, matrix_file, stored_cells, chunked_run, moved_ranks,
    file_embeddings, file_captions, pooled_vectors,
)
QUERIES = {f.__name__: f for f in _NAMES}

_C = "c AS (SELECT DISTINCT query_id, product_id AS doc_id, query_text, vector_score, bm25_score, price_usd FROM search_results)"



def _vector_sql(limit: str) -> str:
    words = f"(SELECT doc_id, array_to_string(list_slice(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+'), 1, {limit}), ' ') AS words FROM documents)"
    return f"""
        WITH src AS {words}, {search._encoded_sql("src", "doc_id", "words", "e")}
        SELECT d.doc_id, list(round(coalesce(x, 0) / coalesce(n, 1), 6) ORDER BY k) AS vector
        FROM documents d CROSS JOIN (SELECT unnest(range(64)) AS k) t LEFT JOIN e_v v ON v.doc_id = d.doc_id AND v.d = k LEFT JOIN e_n m ON m.doc_id = d.doc_id
        GROUP BY d.doc_id"""


SQL = {
    "hashed_encoding": _vector_sql("NULL").replace("list_slice(", "(").replace(", 1, NULL)", ")"),
    "short_encoding": _vector_sql("77"),
    "text_search": f"""
        WITH queries AS (SELECT DISTINCT query_id, query_text AS text FROM search_results),
        {search._encoded_sql("queries", "query_id", "text", "q")}, {search._encoded_sql("documents", "doc_id", "text", "e")},
        dots AS (SELECT query_id, doc_id, sum(a.x * b.x) AS s FROM q_v a JOIN e_v b USING (d) GROUP BY ALL),
        f AS (
            SELECT a.query_id, d.doc_id, round(1 + CASE WHEN b.n IS NULL THEN 0 ELSE 1 END - 2 * coalesce(s, 0) / (a.n * coalesce(b.n, 1)), 6) + 0.0 AS distance
            FROM q_n a CROSS JOIN documents d LEFT JOIN e_n b ON b.doc_id = d.doc_id LEFT JOIN dots t ON t.query_id = a.query_id AND t.doc_id = d.doc_id)
        SELECT query_id, doc_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM f) WHERE rank <= 10""",
    "query_analysis_demo": f"""
        WITH q AS (SELECT DISTINCT query_id, lower(query_text) AS t FROM search_results)
        SELECT query_id, CASE WHEN regexp_matches(t, 'cable|charger|cord') THEN 'cable' WHEN regexp_matches(t, 'headset|headphone|earphone|earbud') THEN 'headphone'
            WHEN contains(t, 'mouse') THEN 'mouse' ELSE '' END AS product_type, array_to_string({search._DEMO_WANTS}, ',') AS key_features FROM q""",
    "snapshot_history": """
        SELECT '2025-01-01' AS at, count(*) FILTER (vec_id % 2 <> 0) AS new, count(*) FILTER (vec_id % 2 = 0 AND updated_at > TIMESTAMP '2024-07-01') AS updated, count(*) AS n_rows
        FROM combined_embeddings""",
    "missing_csv": "SELECT 1::BIGINT AS id, 'x' AS name WHERE false",
    "csv_columns": "SELECT * FROM (VALUES (0::BIGINT, 'review_id'), (1::BIGINT, 'order_id')) t(position, column_name)",
    "listed_files": "SELECT * FROM (VALUES ('a', 1::BIGINT), ('b', 3::BIGINT), ('d', NULL)) t(name, length)",
    "log_roundtrip": f"""
        SELECT doc_id, 'word_list' AS detector, left(regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g'), 100) AS text, language, 0.75::DOUBLE AS confidence, 1.5::DOUBLE AS time_ms
        FROM ({texts.SQL['wordlist_detect']}) JOIN documents USING (doc_id)""",
    "report_rows": "SELECT least(count(*), 3)::BIGINT AS n_rows, 2::BIGINT AS n_columns FROM region",
    "state_document": "SELECT (-1)::BIGINT AS before, count(*) AS after FROM documents",
    "product_content": f"""
        WITH p AS (SELECT DISTINCT product_id, product_name, about_product, category, review_content FROM catalog_raw),
        o AS (SELECT product_id, concat_ws(' ', product_name, about_product, category, review_content) AS text FROM p),
        t AS (SELECT product_id, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS original FROM o),
        c AS (SELECT *, CASE WHEN original = '' THEN '' ELSE {texts.clean_sql('text', True, 3)} END AS cleaned FROM t)
        SELECT product_id, CASE WHEN original = '' THEN 'unknown' ELSE {texts.share_sql('original')} END AS language,
            regexp_matches(original, '[áéíóúãõâêîôûç]') AS has_accents, len({texts.words_sql('cleaned')}) AS word_count FROM c""",
    "bounded_candidates": f"WITH {_C} SELECT DISTINCT query_id, doc_id FROM c WHERE query_id % 5 = 0 OR price_usd < query_id % 5 * 20",
    "near_vectors": """
        WITH c AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM combined_embeddings WHERE len(embedding) = 64),
        d AS (
            SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_inner_product(a.v, a.v) - 2 * list_inner_product(a.v, b.v) + list_inner_product(b.v, b.v), 6) AS score
            FROM c a JOIN c b ON a.vec_id % 100 = 0)
        SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) AS r FROM d) WHERE r <= 10 AND score <= 1.0""",
    "in_categories": f"SELECT DISTINCT product_id, category FROM catalog_raw WHERE regexp_matches(lower(category), '{'|'.join(CATEGORY_TERMS)}')",
    "strict_numbers": "SELECT DISTINCT order_id, product_id, price FROM order_items",
    "point_sizes": """
        SELECT doc_id, round(20 + (n_chars - min(n_chars) OVER ()) / nullif(max(n_chars) OVER () - min(n_chars) OVER (), 0)::DOUBLE * 180.0::DOUBLE, 6) AS size FROM documents""",
    "table_profile": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {i + 1} AS position, '{t}' AS kind, count(*) AS n_rows, 4 AS n_columns, count(*) - count({c}) AS nulls, min({c}::VARCHAR) AS first_value FROM order_reviews"
        for i, (c, t) in enumerate((("review_id", "bigint"), ("order_id", "string"), ("review_comment_title", "string"), ("review_score", "int")))
    ),
    "first_match": "SELECT product_id, product_name FROM catalog_raw WHERE contains(lower(product_name), 'cable') ORDER BY product_id, product_name LIMIT 1",
    "membership": "SELECT DISTINCT order_id, product_id, coalesce(product_id IN (SELECT product_id FROM products), false) AS known FROM order_items",
    "clamped_scores": f"WITH {_C} SELECT query_id, doc_id, least(greatest(vector_score, 0), 1) AS unit, least(greatest(bm25_score, 0), 10) AS ten, coalesce(price_usd, 0) AS price FROM c",
    "zero_vectors": """
        SELECT vec_id, coalesce(len(embedding), 64)::INT AS dim, round(coalesce(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 0), 5) AS norm FROM combined_embeddings""",
    "slowest_detector": f"SELECT doc_id, round(max(time_ms), 4) AS slowest FROM ({tables.SQL['log_parse']}) GROUP BY doc_id HAVING max(time_ms) IS NOT NULL",
    "unknown_texts": f"SELECT doc_id, length(coalesce(text, '')) AS length FROM ({texts.SQL['wordlist_detect']}) JOIN documents USING (doc_id) WHERE language = 'unknown'",
    "asked_again": f"""
        WITH a AS ({texts.SQL['wordlist_detect']}), b AS ({texts.SQL['wordlist_detect_v1']})
        SELECT doc_id, CASE WHEN a.confidence < 0.6 AND b.confidence > a.confidence THEN b.language ELSE a.language END AS language,
            CASE WHEN a.confidence < 0.6 AND b.confidence > a.confidence THEN b.confidence ELSE a.confidence END AS confidence
        FROM a JOIN b USING (doc_id)""",
    "prompt_answers": "SELECT DISTINCT query_id, 'no model is loaded' AS error FROM search_results",
    "percent_rerank": """
        WITH c AS (
            SELECT DISTINCT query_id, s.product_id AS doc_id, product_name FROM search_results s JOIN (SELECT DISTINCT product_id, product_name FROM catalog_raw) p USING (product_id)),
        d AS (SELECT query_id, doc_id, least(coalesce(try_cast(nullif(regexp_extract(product_name, '[0-9]+'), '') AS DOUBLE), 0), 100) AS score FROM c)
        SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM d) WHERE rank <= 5""",
    "matrix_file": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm FROM embeddings",
    "stored_cells": """
        WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1)
        SELECT vec_id AS doc_id, round(list_inner_product(embedding::DOUBLE[], (SELECT v FROM q)), 6) AS score FROM embeddings ORDER BY score DESC, doc_id LIMIT 10""",
    "chunked_run": "SELECT doc_id, n_chars * 2 AS twice, (doc_id // 100)::BIGINT AS chunk_id FROM documents",
    "moved_ranks": f"""
        WITH {_C}, g AS (SELECT query_id, doc_id, max(bm25_score) AS a, max(vector_score) AS b FROM c GROUP BY ALL),
        r AS (
            SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY a DESC NULLS LAST, doc_id) AS rank_before,
                row_number() OVER (PARTITION BY query_id ORDER BY b DESC NULLS LAST, doc_id) AS rank_after FROM g)
        SELECT *, rank_before - rank_after AS moved FROM r""",
    "file_embeddings": "SELECT doc_id, 1.0::DOUBLE AS norm FROM documents WHERE text <> ''",
    "file_captions": "SELECT doc_id, 'file of ' || octet_length(encode(text)) || ' bytes' AS caption FROM documents WHERE text <> ''",
    "pooled_vectors": """
        WITH x AS (SELECT label, unnest(range(4)) AS d, unnest(embedding[1:4])::DOUBLE AS v FROM embeddings WHERE vec_id % 2 = 0),
        a AS (SELECT label, d, avg(v) AS m FROM x GROUP BY ALL)
        SELECT label, list(round(m, 5) ORDER BY d) AS mean, list(round(exp(m) / s, 5) ORDER BY d) AS softmax FROM (SELECT *, sum(exp(m)) OVER (PARTITION BY label) AS s FROM a) GROUP BY label""",
}
