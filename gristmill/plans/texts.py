"""Text, category, price and language queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import analysis as A
from gristmill.operators import detectors as D
from gristmill.operators.relational import joined_strings
from gristmill.sources.tables import table


def _docs(s: SparkSession, sf: str) -> DataFrame:
    return table(s, sf, "documents").select("doc_id", "text")


def _offers(s: SparkSession, sf: str) -> DataFrame:
    return table(s, sf, "catalog_raw").drop("loaded_at", "scraped_at").distinct()


def clean_text_basic(s, sf):
    return _docs(s, sf).select("doc_id", T.clean(F.col("text")).alias("cleaned"))


def clean_text_multilingual(s, sf):
    return _docs(s, sf).select("doc_id", T.clean(F.col("text"), accents=True, min_length=3).alias("cleaned"))


def clean_text_unicode(s, sf):
    return _docs(s, sf).select("doc_id", T.clean_unicode(F.col("text")).alias("cleaned"))


def strip_accents(s, sf):
    return _docs(s, sf).select("doc_id", T.strip_accents(F.lower("text")).alias("plain"))


def strip_punct(s, sf):
    return _docs(s, sf).select("doc_id", T.strip_punctuation(F.col("text")).alias("plain"))


def text_metadata(s, sf):
    m = D.with_metadata(F.col("text"))
    return _docs(s, sf).select("doc_id", *[m[c].alias(c) for c in ("original", "cleaned", "language", "has_accents", "word_count")])


def review_explode_stats(s, sf):
    """One row per review of a packed field, with its length, words and accents."""
    r = _offers(s, sf).select("product_id", F.explode(F.split("review_content", r" \| ")).alias("review"))
    low = F.lower("review")
    return r.select(
        "product_id", "review", F.length("review").cast("bigint").alias("n_chars"), F.size(T.words(F.col("review"))).cast("bigint").alias("n_words"),
        low.rlike("[áéíóúãõâêîôûç]").alias("has_accents"),
    )


def review_totals(s, sf):
    r = review_explode_stats(s, sf)
    return r.agg(
        F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.round(F.avg("n_words"), 4).alias("mean_words"),
        F.max("n_words").alias("most_words"), F.min("n_words").alias("least_words"), F.count_if("has_accents").alias("accented"),
    )


# The labels, thresholds and separators of the product texts below.
def product_text_v1(s, sf):
    t = T.labelled(
        " ", ("Product Name: ", F.col("product_name")), ("Product Hierarchical Category: ", F.col("category")),
        ("Product Description: ", F.col("about_product")), ("Product Review Contents: ", F.col("review_content")),
    )
    return _offers(s, sf).select("product_id", t.alias("text"))


def _category_lines() -> list[tuple[str, Column]]:
    parts = F.when(F.col("category").contains("|"), F.split("category", r"\|")).when(F.col("category").contains(">"), F.split("category", ">")).otherwise(F.array("category"))
    has = F.col("category").isNotNull()
    return [
        ("Category: ", F.when(has, F.array_join(parts, " > "))),
        ("Primary Category: ", F.when(has, F.get(parts, F.lit(0)))),
        ("Sub-Category: ", F.when(has, F.get(parts, F.lit(1)))),
    ]


def _price() -> Column:
    return F.format_string("%.2f USD", T.currency(F.col("discounted_price")) / 83.0)


def _price_or_null() -> Column:
    return F.when(T.currency(F.col("discounted_price")).isNotNull(), _price())


def product_text_v2(s, sf):
    c = _category_lines()
    t = T.labelled(
        "\n", ("Product: ", F.col("product_name")), *c, ("Description: ", F.col("about_product")), ("Price: ", _price_or_null()), ("Reviews: ", F.col("review_content")),
    )
    return _offers(s, sf).select("product_id", t.alias("text"))


def product_text_v3(s, sf):
    levels = F.array_join(F.transform(F.split("category", ">"), lambda p: F.trim(p)), " ")
    t = T.labelled(" ", ("", F.col("product_name")), ("", F.col("about_product")), ("", levels), ("Price: ", _price_or_null()), ("", F.col("review_content")))
    return _offers(s, sf).select("product_id", t.alias("text"))


def product_text_v4(s, sf):
    c = _category_lines()[:2]
    rating = F.nullif(F.regexp_replace("rating", r"[^\d.]", ""), F.lit("")).try_cast("double")
    good = F.when(rating > 0, rating)
    t = T.labelled(
        "\n", ("Product: ", F.col("product_name")), c[0], (c[1][0], F.trim(c[1][1])), ("Description: ", F.col("about_product")),
        ("Quality: High Rating", F.when(good >= 4.0, F.lit(""))), ("Rating: ", F.when(good.isNotNull(), F.format_string("%.2f", good))), ("Price: ", _price_or_null()),
        ("Reviews: ", F.col("review_content")),
    )
    return _offers(s, sf).select("product_id", t.alias("text"))


def combined_text(s, sf):
    t = T.labelled(" | ", ("category: ", F.col("category")), ("product: ", F.col("product_id")), ("review: ", F.col("review_content")))
    return _offers(s, sf).select("product_id", t.alias("text"))


def joined_columns(s, sf):
    """All text columns of an offer in one."""
    df = _offers(s, sf)
    return df.select("product_id", joined_strings(df).alias("text"))


def primary_category(s, sf):
    return _offers(s, sf).select("product_id", T.primary_category(F.col("category")).alias("primary_category"))


def category_info(s, sf):
    return _offers(s, sf).select("product_id", T.category_info(F.col("category"), 2).alias("category_info"), F.size(T.path_parts(F.col("category"))).cast("bigint").alias("depth"))


def brand_extract(s, sf):
    return _offers(s, sf).select("product_id", T.brand(F.col("product_name")).alias("brand"))


def url_canonicalise(s, sf):
    df = _offers(s, sf)
    return df.select("product_id", T.canonical_url(F.col("product_link"), "https://shop.example/p/").alias("url"), T.is_image_url(F.col("image_url")).alias("is_image"))


def price_parse(s, sf):
    return _offers(s, sf).select(
        "product_id", F.round(T.currency(F.col("discounted_price")) / 83.0, 6).alias("price_usd"), T.currency(F.col("discount_percentage")).alias("percent")
    )


def short_numbers(s, sf):
    return table(s, sf, "orders").select("o_orderkey", T.short_number(F.floor(F.col("o_totalprice")).cast("double") * 4).alias("short"))


def listing_kinds(s, sf):
    return _offers(s, sf).select("product_id", A.listing_kind(F.col("product_name")).alias("kind"))


def topic_sentences(s, sf):
    """Sentences of each document and those that speak of the charger."""
    ss = T.sentences(F.col("text"))
    return _docs(s, sf).select(
        "doc_id", F.size(ss).cast("bigint").alias("n"), F.size(F.filter(ss, lambda x: F.lower(x).contains("charger"))).cast("bigint").alias("on_topic")
    )


def _detected(s: SparkSession, sf: str, how) -> DataFrame:
    r = how(F.col("text"))
    return _docs(s, sf).select("doc_id", r["language"].alias("language"), F.round(r["confidence"], 6).alias("confidence"))


def wordlist_detect(s, sf):
    return _detected(s, sf, D.word_list)


def wordlist_detect_v1(s, sf):
    return _detected(s, sf, D.word_list_v1)


def pt_share_detect(s, sf):
    return _docs(s, sf).select("doc_id", D.indicator_share(F.col("text")).alias("language"))


def _declared(c: str) -> Column:
    """The declared language as a second detector's result."""
    known = F.col(c).isin("pt", "en")
    return F.struct(F.when(known, F.col(c)).otherwise("unknown").alias("language"), F.when(known, 0.9).otherwise(0.0).alias("confidence"), F.lit("deep").alias("method_used"))


def _failed() -> Column:
    return F.struct(F.lit("unknown").alias("language"), F.lit(0.0).alias("confidence"), F.lit("cloud_failed").alias("method_used"))


def _asked(s: SparkSession, sf: str) -> DataFrame:
    """Documents with the result of each detector in a column of its own, so that none is computed twice."""
    df = table(s, sf, "documents")
    return df.select("doc_id", D.word_list(F.col("text")).alias("a"), _declared("lang").alias("b"), _failed().alias("c"))


def ensemble_vote(s, sf):
    voted = _asked(s, sf).select("doc_id", D.vote([F.col("a"), F.col("b"), F.col("c")]).alias("v"))
    return voted.select("doc_id", "v.language", F.round("v.confidence", 6).alias("confidence"), "v.method_used")


def detector_cascade(s, sf):
    first = _asked(s, sf).select("doc_id", D.cascade(F.col("a"), F.col("b"), enough=[0.6]).alias("v"))
    return first.select("doc_id", "v.language", F.round("v.confidence", 6).alias("confidence"), "v.method_used")


def language_statistics(s, sf):
    return D.statistics(_docs(s, sf).select(D.word_list(F.col("text")).alias("r")), "r")


def preview(s, sf):
    """Reviews with what cleaning and detection make of them; those of fewer than three words are not asked."""
    m = D.with_metadata(F.col("text"))
    df = table(s, sf, "order_reviews").select("review_id", F.col("review_comment_message").alias("text")).distinct().select("review_id", "text", m.alias("m"))
    r = D.word_list(F.col("text"))
    short = F.col("m.word_count") < 3
    return df.select(
        "review_id", F.col("m.cleaned").alias("cleaned"), F.col("m.language").alias("guess"),
        F.when(short, "no_content").otherwise(r["language"]).alias("language"), F.when(short, 0.0).otherwise(F.round(r["confidence"], 6)).alias("confidence"),
        F.when(short, "skip").otherwise(r["method_used"]).alias("method_used"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        clean_text_basic, clean_text_multilingual, clean_text_unicode, strip_accents, strip_punct, text_metadata, review_explode_stats,
        review_totals, product_text_v1, product_text_v2, product_text_v3, product_text_v4, combined_text, joined_columns, primary_category,
        category_info, brand_extract, url_canonicalise, price_parse, short_numbers, listing_kinds, topic_sentences, wordlist_detect,
        wordlist_detect_v1, pt_share_detect, ensemble_vote, detector_cascade, language_statistics, preview,
    )
}

def _spelt_sql(t: str, ascii_only: bool) -> str:
    one, several = T.plain_letters(ascii_only)
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = f"MAP([{', '.join(map(quoted, several))}], [{', '.join(map(quoted, several.values()))}])"
    held = "".join(f"\\x{{{ord(c):04X}}}" for c in several)
    each = f"array_to_string(list_transform(regexp_extract_all(x.t, '(?s).'), lambda c: coalesce({known}[c], c)), '')"
    t = f"translate({t}, {quoted(''.join(one))}, {quoted(''.join(one.values()))})"
    return f"list_transform([{{'t': {t}}}], lambda x: CASE WHEN regexp_matches(x.t, '[{held}]') THEN {each} ELSE x.t END)[1]"


_PUNCT = T.PUNCTUATION.replace("'", "''")


def clean_sql(text: str, accents: bool, least: int) -> str:
    t = f"lower(trim(coalesce({text}, ''), E' \\t\\n\\r\\f\\x0b'))"
    if not accents:
        t = f"regexp_replace({_spelt_sql(t, ascii_only=True)}, '[^\\x00-\\x7F]', '', 'g')"
    t = f"regexp_replace({t}, '[^a-zA-Z0-9\\s]', ' ', 'g')"
    return f"array_to_string(list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: length(w) >= {least}), ' ')"


def words_sql(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> '')"


def _array(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_OFFERS = "offers AS (SELECT DISTINCT * EXCLUDE (loaded_at, scraped_at) FROM catalog_raw)"
_PARTS = "CASE WHEN contains(category, '|') THEN string_split(category, '|') WHEN contains(category, '>') THEN string_split(category, '>') WHEN category IS NOT NULL THEN [category] END"
_MONEY = "try_cast(regexp_replace({}, '[₹$,%]', '', 'g') AS DOUBLE)"
_USD = f"'Price: ' || printf('%.2f USD', {_MONEY.format('discounted_price')} / 83.0::DOUBLE)"


def share_sql(t: str) -> str:
    return f"CASE WHEN len(list_filter({words_sql(f'lower({t})')}, lambda w: list_contains({_array(D.INDICATORS)}, w))) / greatest(len({words_sql(f'lower({t})')}), 1) > 0.1 THEN 'pt' ELSE 'en' END"


_AFTER = "($|[^\\p{L}\\p{N}_])"


def _wordlist_sql(weights: dict, patterns: list) -> str:
    ws = f"list_distinct({words_sql('t')})"
    pairs = "MAP {" + ", ".join(f"'{w}': {x}::DOUBLE" for w, x in weights.items()) + "}"
    hits = " + ".join(f"regexp_matches(t, '{p}')::INT" for p in [*[p + _AFTER for p in patterns], D.ACCENTS])
    return f"""
    low AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS t FROM documents),
    m AS (
        SELECT doc_id, t, list_filter(list_transform({ws}, lambda w: {pairs}[w]), lambda x: x IS NOT NULL) AS xs, {hits} AS hit,
            len(list_filter({ws}, lambda w: list_contains({_array(D.ENGLISH)}, w))) AS en FROM low),
    p AS (SELECT *, len(xs) + hit AS n, CASE WHEN len(xs) + hit > 0 THEN (coalesce(list_sum(xs), 0) + hit * 0.8::DOUBLE) / (len(xs) + hit) ELSE 0 END AS c FROM m)"""


DETECT_SQL = f"""{_wordlist_sql(D.PORTUGUESE, D.PATTERNS)},
    b AS (SELECT *, CASE WHEN hit > 0 AND n > 2 THEN least(c + 0.1::DOUBLE, 1.0::DOUBLE) ELSE c END AS pt FROM p),
    found AS (
        SELECT doc_id, CASE WHEN round(pt, 9) > 0.5 THEN 'pt' WHEN en > 1 THEN 'en' ELSE 'unknown' END AS language,
            CASE WHEN round(pt, 9) > 0.5 THEN pt WHEN en > 1 THEN en * 0.1::DOUBLE + 0.6::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM b)"""
_DETECT = f"WITH {DETECT_SQL} "
_SECOND = "CASE WHEN lang IN ('pt', 'en') THEN lang ELSE 'unknown' END AS l2, CASE WHEN lang IN ('pt', 'en') THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS c2"

SQL = {
    "clean_text_basic": f"SELECT doc_id, {clean_sql('text', False, 2)} AS cleaned FROM documents",
    "clean_text_multilingual": f"SELECT doc_id, {clean_sql('text', True, 3)} AS cleaned FROM documents",
    "clean_text_unicode": f"SELECT doc_id, trim(regexp_replace(translate(lower(trim(coalesce(text, ''), E' \\t\\n\\r\\f\\x0b')), '{_PUNCT}', ''), '\\s+', ' ', 'g')) AS cleaned FROM documents",
    "strip_accents": f"SELECT doc_id, regexp_replace({_spelt_sql('lower(text)', ascii_only=False)}, '\\p{{Mn}}+', '', 'g') AS plain FROM documents",
    "strip_punct": f"SELECT doc_id, translate(text, '{_PUNCT}', '') AS plain FROM documents",
    "text_metadata": f"""
        WITH o AS (SELECT doc_id, text, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS original FROM documents),
        c AS (SELECT *, CASE WHEN original = '' THEN '' ELSE {clean_sql('text', True, 3)} END AS cleaned FROM o)
        SELECT doc_id, original, cleaned, CASE WHEN original = '' THEN 'unknown' ELSE {share_sql('original')} END AS language,
            regexp_matches(original, '[áéíóúãõâêîôûç]') AS has_accents, len({words_sql('cleaned')}) AS word_count FROM c""",
    "review_explode_stats": f"""
        WITH {_OFFERS}, r AS (SELECT product_id, unnest(string_split(review_content, ' | ')) AS review FROM offers)
        SELECT product_id, review, length(review) AS n_chars, len({words_sql('review')}) AS n_words, regexp_matches(lower(review), '[áéíóúãõâêîôûç]') AS has_accents FROM r""",
    "review_totals": f"""
        WITH {_OFFERS}, r AS (SELECT unnest(string_split(review_content, ' | ')) AS review FROM offers),
        x AS (SELECT length(review) AS n_chars, len({words_sql('review')}) AS n_words, regexp_matches(lower(review), '[áéíóúãõâêîôûç]') AS a FROM r)
        SELECT count(*) AS n, round(avg(n_chars), 4) AS mean_chars, round(avg(n_words), 4) AS mean_words, max(n_words) AS most_words,
            min(n_words) AS least_words, count(*) FILTER (WHERE a) AS accented FROM x""",
    "product_text_v1": f"""WITH {_OFFERS} SELECT product_id, concat_ws(' ', 'Product Name: ' || product_name, 'Product Hierarchical Category: ' || category,
        'Product Description: ' || about_product, 'Product Review Contents: ' || review_content) AS text FROM offers""",
    "product_text_v2": f"""WITH {_OFFERS}, o AS (SELECT *, {_PARTS} AS parts FROM offers)
        SELECT product_id, concat_ws(chr(10), 'Product: ' || product_name, 'Category: ' || array_to_string(parts, ' > '), 'Primary Category: ' || parts[1],
            'Sub-Category: ' || parts[2], 'Description: ' || about_product, {_USD}, 'Reviews: ' || review_content) AS text FROM o""",
    "product_text_v3": f"""WITH {_OFFERS} SELECT product_id, concat_ws(' ', product_name, about_product,
        array_to_string(list_transform(string_split(category, '>'), lambda x: trim(x)), ' '), {_USD}, review_content) AS text FROM offers""",
    "product_text_v4": f"""WITH {_OFFERS}, o AS (SELECT *, {_PARTS} AS parts, try_cast(nullif(regexp_replace(rating, '[^0-9.]', '', 'g'), '') AS DOUBLE) AS r FROM offers)
        SELECT product_id, concat_ws(chr(10), 'Product: ' || product_name, 'Category: ' || array_to_string(parts, ' > '), 'Primary Category: ' || trim(parts[1]),
            'Description: ' || about_product, CASE WHEN r >= 4.0 THEN 'Quality: High Rating' END, CASE WHEN r > 0 THEN printf('Rating: %.2f', r) END,
            {_USD}, 'Reviews: ' || review_content) AS text FROM o""",
    "combined_text": f"WITH {_OFFERS} SELECT product_id, concat_ws(' | ', 'category: ' || category, 'product: ' || product_id, 'review: ' || review_content) AS text FROM offers",
    "joined_columns": f"""WITH {_OFFERS} SELECT product_id, concat_ws(' ', product_id, product_name, category, discounted_price, actual_price, discount_percentage,
        rating, rating_count, about_product, review_content, review_lang, product_link, image_url, seller_id) AS text FROM offers""",
    "primary_category": f"WITH {_OFFERS} SELECT product_id, lower(trim(string_split(coalesce(category, ''), '|')[1])) AS primary_category FROM offers",
    "category_info": f"""WITH {_OFFERS} SELECT product_id,
        array_to_string(list_transform(string_split(coalesce(category, ''), '|')[:2], lambda x: trim(x)), ' | ') AS category_info, coalesce(len({_PARTS}), 0)::BIGINT AS depth FROM offers""",
    "brand_extract": f"WITH {_OFFERS} SELECT product_id, nullif(regexp_extract(product_name, '^([A-Za-z0-9]+)', 1), '') AS brand FROM offers",
    "url_canonicalise": f"""WITH {_OFFERS} SELECT product_id,
        CASE WHEN regexp_matches(product_link, '/dp/[A-Za-z0-9_]{{10}}') THEN 'https://shop.example/p/' || regexp_extract(product_link, '/dp/([A-Za-z0-9_]{{10}})', 1) ELSE product_link END AS url,
        coalesce(regexp_matches(lower(image_url), '[.](jpg|jpeg|png|gif|bmp|webp)$'), false) AS is_image FROM offers""",
    "price_parse": f"WITH {_OFFERS} SELECT product_id, round({_MONEY.format('discounted_price')} / 83.0::DOUBLE, 6) AS price_usd, {_MONEY.format('discount_percentage')} AS percent FROM offers",
    "short_numbers": """SELECT o_orderkey, CASE WHEN x >= 1000000 THEN printf('%.1fM', round_even(x / 1000000, 1)) WHEN x >= 1000 THEN printf('%.0fK', round_even(x / 1000, 0)) ELSE printf('%.0f', x) END AS short
        FROM (SELECT o_orderkey, floor(o_totalprice)::DOUBLE * 4 AS x FROM orders)""",
    "listing_kinds": f"""WITH {_OFFERS} SELECT product_id, CASE WHEN regexp_matches(lower(product_name), 'earbud|earphone') THEN 'earphone'
        WHEN contains(lower(product_name), 'headphone') THEN 'headphone' ELSE 'unknown' END AS kind FROM offers""",
    "topic_sentences": """WITH x AS (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS ss FROM documents)
        SELECT doc_id, len(ss) AS n, len(list_filter(ss, lambda s: contains(lower(s), 'charger'))) AS on_topic FROM x""",
    "wordlist_detect": _DETECT + "SELECT doc_id, language, round(confidence, 6) AS confidence FROM found",
    "wordlist_detect_v1": f"""WITH {_wordlist_sql(D.PORTUGUESE_V1, D.PATTERNS_V1)}
        SELECT doc_id, CASE WHEN t = '' THEN 'unknown' WHEN c > 0.3 THEN 'pt' ELSE 'en' END AS language, round(CASE WHEN t = '' THEN 0 ELSE c END, 6) AS confidence FROM p""",
    "pt_share_detect": f"SELECT doc_id, {share_sql(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS language FROM documents",
    "ensemble_vote": _DETECT
    + f""", two AS (SELECT f.*, {_SECOND} FROM found f JOIN documents USING (doc_id)),
    s AS (
        SELECT doc_id, language AS l1, l2,
            (CASE WHEN language = language THEN confidence ELSE 0 END + CASE WHEN l2 = language THEN c2 * 1.5::DOUBLE ELSE 0 END) / 2.5::DOUBLE AS s1,
            (CASE WHEN language = l2 THEN confidence ELSE 0 END + c2 * 1.5::DOUBLE) / 2.5::DOUBLE AS s2,
            (CASE WHEN language = 'unknown' THEN confidence ELSE 0 END + CASE WHEN l2 = 'unknown' THEN c2 * 1.5::DOUBLE ELSE 0 END) / 2.5::DOUBLE AS s3
        FROM two)
    SELECT doc_id, CASE WHEN s1 >= s2 AND s1 >= s3 THEN l1 WHEN s2 >= s3 THEN l2 ELSE 'unknown' END AS language, round(greatest(s1, s2, s3), 6) AS confidence,
        'ensemble(word_list,deep,cloud_failed)' AS method_used FROM s""",
    "detector_cascade": _DETECT
    + f""", two AS (SELECT f.*, {_SECOND} FROM found f JOIN documents USING (doc_id))
    SELECT doc_id, CASE WHEN confidence < 0.6 AND c2 > confidence THEN l2 ELSE language END AS language,
        round(CASE WHEN confidence < 0.6 AND c2 > confidence THEN c2 ELSE confidence END, 6) AS confidence,
        CASE WHEN confidence < 0.6 AND c2 > confidence THEN 'deep' ELSE 'word_list' END AS method_used FROM two""",
    "language_statistics": _DETECT
    + "SELECT language, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM found), 4) AS share, round(avg(confidence), 6) AS mean_confidence FROM found GROUP BY language",
    "preview": (
        _DETECT.replace("SELECT doc_id, trim(", "SELECT review_id AS doc_id, trim(").replace(
            "coalesce(text, '')), '\\s+', ' ', 'g')) AS t FROM documents",
            "coalesce(review_comment_message, '')), '\\s+', ' ', 'g')) AS t FROM (SELECT DISTINCT review_id, review_comment_message FROM order_reviews)",
        )
        + f""", o AS (
        SELECT review_id AS doc_id, review_comment_message AS text, regexp_replace(coalesce(review_comment_message, ''), '^\\s+|\\s+$', '', 'g') AS original
        FROM (SELECT DISTINCT review_id, review_comment_message FROM order_reviews)),
    c AS (SELECT *, CASE WHEN original = '' THEN '' ELSE {clean_sql('text', True, 3)} END AS cleaned FROM o),
    n AS (SELECT *, CASE WHEN original = '' THEN 'unknown' ELSE {share_sql('original')} END AS guess, len({words_sql('cleaned')}) < 3 AS short FROM c)
    SELECT doc_id AS review_id, cleaned, guess, CASE WHEN short THEN 'no_content' ELSE language END AS language,
        CASE WHEN short THEN 0.0::DOUBLE ELSE round(confidence, 6) END AS confidence, CASE WHEN short THEN 'skip' ELSE 'word_list' END AS method_used
    FROM n JOIN found USING (doc_id)"""
    ),
}
