"""Reviews of a product analysed and scored; sentences on a topic scored. Scorers are plug-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import sentences, tokens
from gristmill.operators.incremental import cache_key

#: Words of the default lexicon: what reviewers praise and what they regret.
PRAISE = "good great excellent love perfect happy recommend bom ótimo excelente gostei perfeito gut schön bien buono contenta satisfeita zufrieden".split()
REGRET = "bad broken broke useless poor never scratched strange louder cheaper ruim quebrou péssimo kaputt schlecht roto malo rotto rovinata".split()
#: Reviews of a product that are read.
MOST_REVIEWS = 10


def first_reviews(packed: Column, sep: str = r" \| ", most: int = MOST_REVIEWS) -> Column:
    """The first reviews of a packed field as an array; null and blank fields give none."""
    parts = F.split(F.coalesce(packed, F.lit("")), sep)
    return F.slice(F.filter(parts, lambda r: F.trim(r) != ""), 1, most)


def lexicon_score(texts: Column) -> Column:
    """0 to 10 by the words of an array of texts: 5 where praise and regret balance or neither occurs."""
    ws = tokens(F.array_join(texts, " "))
    n = lambda terms: F.size(F.filter(ws, lambda w: w.isin(terms)))
    plus, minus = n(PRAISE), n(REGRET)
    return F.when(plus + minus > 0, plus / (plus + minus) * 10.0).otherwise(F.lit(5.0))


def analyse_reviews(texts: Column) -> Column:
    """STRUCT(sentiment_score, positive_features, negative_features, key_concerns, general_sentiment) by the lexicon."""
    ws = F.array_distinct(tokens(F.array_join(texts, " ")))
    plus, minus = F.array_sort(F.filter(ws, lambda w: w.isin(PRAISE))), F.array_sort(F.filter(ws, lambda w: w.isin(REGRET)))
    s = lexicon_score(texts)
    return F.struct(
        s.alias("sentiment_score"), plus.alias("positive_features"), minus.alias("negative_features"), F.slice(minus, 1, 3).alias("key_concerns"),
        F.when(s > 6, "positive").when(s < 4, "negative").otherwise("neutral").alias("general_sentiment"),
    )


def review_score(sentiment: Column) -> Column:
    """Sentiment from 0 to 1; 0.5 where there is none."""
    return F.coalesce(sentiment / 10, F.lit(0.5))


def cached_reviews(df: DataFrame, key: str, packed: str, cache: DataFrame, now: Column, ttl_seconds: float = 7 * 86400) -> tuple[DataFrame, DataFrame]:
    """(answers, new cache): (key, cache_key, ts, score) of each product, taken from unexpired entries or made anew."""
    asked = df.select(F.col(key), first_reviews(F.col(packed)).alias("texts"))
    asked = asked.withColumn("cache_key", cache_key(F.col(key).cast("string"), F.to_json("texts")))
    valid = cache.filter(now - F.col("ts") < ttl_seconds).select("cache_key", "ts", "score").dropDuplicates(["cache_key"])
    found = asked.join(valid, "cache_key", "left")
    answers = found.select(key, "cache_key", F.coalesce("ts", now).alias("ts"), F.coalesce("score", lexicon_score(F.col("texts"))).alias("score"))
    return answers, answers.select("cache_key", "ts", "score").distinct()


def topic_score(text: Column, terms: list[str], score: Column | None = None) -> Column:
    """Mean of the 1-to-5 scores of the sentences that hold one of `terms`; null where none does.

    The default scorer gives a sentence 3, more for praise and less for regret.
    """
    about = F.filter(sentences(text), lambda s: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(s), t)))
    each = score if score is not None else F.transform(about, lambda s: lexicon_score(F.array(s)) * 0.4 + 1)
    return F.when(F.size(about) > 0, F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.size(about))


def quality_of(stars: Column) -> Column:
    """strong from 4 stars, moderate from 3, else none."""
    return F.when(stars >= 4, "strong").when(stars >= 3, "moderate").otherwise("none")
