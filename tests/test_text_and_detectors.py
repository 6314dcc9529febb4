"""Hand-computed values of text expressions and detectors."""

import math

import pytest
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import analysis as A
from gristmill.operators import detectors as D
from gristmill.operators.stemming import stem


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(expr(F.col("t")).alias("r")).first().r


def test_cleaning(spark):
    assert one(spark, "  Câmera 16MP - Preto! a ", T.clean) == "camera 16mp preto"
    assert one(spark, "Não é bom", lambda c: T.clean(c, accents=True, min_length=3)) == "bom"
    assert one(spark, None, T.clean) == "" and one(spark, "", T.clean) == ""
    assert one(spark, "  Olá,  Mundo! ", T.clean_unicode) == "olá mundo"
    assert one(spark, "ação" * 20_000, T.clean) == "acao" * 20_000


def test_paths_prices_and_names(spark):
    assert one(spark, "A&B|C|D", T.primary_category) == "a&b"
    assert one(spark, "A&B|C|D", T.category_info) == "A&B | C"
    assert one(spark, None, T.category_info) == "" and one(spark, None, T.path_parts) == []
    assert one(spark, "a > b", T.path_parts) == ["a", "b"]
    assert one(spark, "₹1,099", lambda c: F.round(T.currency(c) / 83.0, 6)) == 13.240964
    assert one(spark, "Acme-2 x", T.brand) == "Acme" and one(spark, "-x", T.brand) is None
    assert one(spark, "http://a/dp/ABCDEFGHIJ/x", lambda c: T.canonical_url(c, "r/")) == "r/ABCDEFGHIJ"
    assert [one(spark, x, T.short_number, "double") for x in (2_500_000.0, 34_000.0, 56.0, None)] == ["2.5M", "34K", "56", None]


def test_tokens(spark):
    assert one(spark, "O não_x é the Cable2", T.tokens) == ["o", "não_x", "é", "the", "cable2"]
    assert one(spark, "the red_x cables a", T.search_tokens) == ["cables"]
    assert one(spark, None, T.search_tokens) == []


@pytest.mark.parametrize(
    "text, language, confidence",
    [
        ("produto ótimo", "pt", 0.833333),
        ("good quality product", "en", 0.9),
        ("the product para", "en", 0.8),
        ("hello world", "unknown", 0.0),
        ("", "unknown", 0.0),
        (None, "unknown", 0.0),
    ],
)
def test_word_list(spark, text, language, confidence):
    r = one(spark, text, D.word_list)
    assert r.language == language and math.isclose(r.confidence, confidence, abs_tol=1e-6)


def test_vote_and_cascade(spark):
    def result(language, confidence, method):
        return F.struct(F.lit(language).alias("language"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method_used"))

    df = spark.range(1)
    v = df.select(D.vote([result("unknown", 0.0, "word_list"), result("pt", 0.9, "deep"), result("pt", 0.8, "cloud")]).alias("v")).first().v
    assert v.language == "pt" and math.isclose(v.confidence, 0.624324, abs_tol=1e-6) and v.method_used == "ensemble(word_list,deep,cloud)"
    v = df.select(D.vote([result("pt", 0.7, "word_list"), result("pt", 0.9, "deep"), result("unknown", 0.0, "cloud_failed")]).alias("v")).first().v
    assert v.language == "pt" and math.isclose(v.confidence, 0.82, abs_tol=1e-6)
    v = df.select(D.vote([result("en", 0.5, "a"), result("pt", 0.5, "b")]).alias("v")).first().v
    assert v.language == "en"  # the first among equals
    c = df.select(D.cascade(result("pt", 0.7, "a"), result("en", 0.9, "b"), enough=[0.6]).alias("v")).first().v
    assert c.language == "pt"
    c = df.select(D.cascade(result("pt", 0.5, "a"), result("en", 0.9, "b"), enough=[0.6]).alias("v")).first().v
    assert c.language == "en"


def test_query_analysis(spark):
    r = one(spark, "Fast charging cable with warranty under 25.5 usd", A.analyse)
    assert r.product_type == "cable" and r.key_features == ["fast charging", "warranty", "warranty"] and r.price_constraint == 25.5
    r = one(spark, "", A.analyse)
    assert r.product_type == "" and r.key_features == [] and r.price_constraint is None


def test_answers(spark):
    assert one(spark, '{"score": 7}', A.parse_answer).score == 7.0
    r = one(spark, "Sure: {product_type: \"usb\", key_features: ['a'],}", A.parse_answer)
    assert r is not None
    assert one(spark, "I rate it 8.5 of 10", A.parse_answer).score == 8.5
    assert one(spark, "product_type: usb cable", A.parse_answer).product_type == "usb cable"
    assert one(spark, "nothing here", A.parse_answer) is None and one(spark, None, A.parse_answer) is None


def test_loose_json(spark):
    fixed = lambda t: one(spark, t, A.repair_json)
    assert fixed('{a: 1, "b": [1, 2, ], c_d: True, e: None,}') == '{"a": 1, "b": [1, 2 ], "c_d": true, "e": null}'
    assert fixed('{"k": "x, } y: True"}') == '{"k": "x, } y: True"}' and fixed("") == "" and fixed(None) is None
    r = one(spark, 'Here {broken} it is: {product_type: "usb", key_features: ["a", "b",], score: 3} ok', A.parse_answer)
    assert (r.product_type, r.key_features, r.score) == ("usb", ["a", "b"], 3.0)
    r = one(spark, "Product Type: usb cable\nKey features: ['fast', \"long\"]", A.parse_answer)
    assert r.product_type == "usb cable" and r.key_features == ["fast", "long"] and r.score is None
    assert one(spark, "x" * 200_000, A.parse_answer) is None


def test_wording_boost(spark):
    assert one(spark, "wireless with excellent noise cancellation", A.wording_boost) == 3.0
    assert one(spark, "high performance", A.wording_boost) == 0.5 and one(spark, None, A.wording_boost) == 0.0 and one(spark, "balance", A.wording_boost) == 0.5


@pytest.mark.parametrize(
    "word, expected",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"),
        ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"),
        ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"),
        ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"),
        ("is", "is"), ("não", "não"),
    ],
)
def test_stems(word, expected):
    assert stem(word) == expected
