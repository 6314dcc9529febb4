"""Rule-based language detectors, their cascade and their weighted vote, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import clean, collapsed, text_of, words

# Portuguese words with their weight, and English words.
PORTUGUESE = {
    "não": 0.9, "está": 0.9, "português": 0.9, "obrigado": 0.9, "então": 0.9, "correto": 0.7, "produto": 0.7, "entrega": 0.7,
    "chegou": 0.7, "recebi": 0.7, "comprei": 0.7, "ótimo": 0.7, "péssimo": 0.7, "bom": 0.7, "ruim": 0.7, "sim": 0.7, "vale": 0.6,
    "pena": 0.6, "para": 0.5, "com": 0.5, "mas": 0.5, "bem": 0.5,
}
PATTERNS = ["ção", "ões", "inho", "inha"]
ENGLISH = "the product delivery received arrived good bad excellent shipping ordered quality".split()
# The older, shorter lists.
PORTUGUESE_V1 = {
    "não": 0.9, "está": 0.9, "português": 0.9, "produto": 0.7, "entrega": 0.7, "chegou": 0.7, "recebi": 0.7, "comprei": 0.7,
    "para": 0.5, "com": 0.5, "mas": 0.5,
}
PATTERNS_V1 = ["ção", "ões"]
ACCENTS = "[áéíóúâêîôûãõç]"
# Words whose share tells Portuguese.
INDICATORS = "produto muito bom ótimo excelente recomendo chegou recebi não para comprei gostei veio até mais".split()
#: Weights of the vote by detector.
WEIGHTS = {"word_list": 1.0, "deep": 1.5, "cloud": 1.2, "cloud_failed": 0.0}
#: What stands after an ending: the end, or no word character.
_AFTER = r"($|[^\p{L}\p{N}_])"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hits(low: Column, lists: list[list[str]]) -> Column:
    """The different words of a text that stand in any of the lists; one look at the text for all of them."""
    every = list(dict.fromkeys(w for ws in lists for w in ws))
    return F.array_intersect(F.split(low, " "), F.array(*[F.lit(w) for w in every]))


def _matches(low: Column, hits: Column, weights: dict[str, float], patterns: list[str]) -> tuple[Column, Column, Column]:
    """(sum of weights, number of matches, number of patterns) of the words hit and the patterns of a text."""
    by_weight: dict[float, list[str]] = {}
    for w, x in weights.items():
        by_weight.setdefault(x, []).append(w)
    total, count, hit = F.lit(0.0), F.lit(0), F.lit(0)
    for x, ws in by_weight.items():
        n = F.size(F.array_intersect(hits, F.array(*[F.lit(w) for w in ws])))
        total, count = total + n * F.lit(x), count + n
    for p in patterns:
        # The plain search is cheap and rules out most texts.
        hit = hit + (low.contains(p) & low.rlike(p + _AFTER)).cast("int")
    hit = hit + low.rlike(ACCENTS).cast("int")
    return total + hit * F.lit(0.8), count + hit, hit


def word_list(text: Column) -> Column:
    """STRUCT(language, confidence, method_used): pt by weighted words and endings, else en by two English words."""

    def judged(low: Column, hits: Column) -> Column:
        total, count, hit = _matches(low, hits, PORTUGUESE, PATTERNS)
        mean = F.when(count > 0, total / count).otherwise(F.lit(0.0))
        pt = F.when((hit > 0) & (count > 2), F.least(mean + 0.1, F.lit(1.0))).otherwise(mean)
        english = F.size(F.array_intersect(hits, F.array(*[F.lit(w) for w in ENGLISH])))
        language = F.when(pt > 0.5, "pt").when(english > 1, "en").otherwise("unknown")
        confidence = F.when(pt > 0.5, pt).when(english > 1, english * F.lit(0.1) + 0.6).otherwise(F.lit(0.0))
        return F.struct(language.alias("language"), confidence.alias("confidence"), F.lit("word_list").alias("method_used"))

    return _bound(collapsed(F.lower(text_of(text))), lambda low: _bound(_hits(low, [[*PORTUGUESE], ENGLISH]), lambda hits: judged(low, hits)))


def word_list_v1(text: Column) -> Column:
    """The older detector: pt above 0.3, else en; unknown for blank texts."""

    def judged(low: Column, hits: Column) -> Column:
        total, count, _ = _matches(low, hits, PORTUGUESE_V1, PATTERNS_V1)
        blank = collapsed(low) == ""
        confidence = F.when(~blank & (count > 0), total / count).otherwise(F.lit(0.0))
        language = F.when(blank, "unknown").when(confidence > 0.3, "pt").otherwise("en")
        return F.struct(language.alias("language"), confidence.alias("confidence"), F.lit("word_list").alias("method_used"))

    return _bound(F.trim(F.lower(text_of(text))), lambda low: _bound(_hits(collapsed(low), [[*PORTUGUESE_V1]]), lambda hits: judged(low, hits)))


def indicator_share(text: Column) -> Column:
    """pt where more than a tenth of the words are indicators, else en."""
    ws = words(F.lower(text_of(text)))
    n = F.size(F.filter(ws, lambda w: w.isin(INDICATORS)))
    return F.when(n / F.greatest(F.size(ws), F.lit(1)) > 0.1, "pt").otherwise("en")


def with_metadata(text: Column) -> Column:
    """STRUCT(original, cleaned, language, has_accents, word_count); blank texts are unknown."""
    original = F.regexp_replace(text_of(text), r"^\s+|\s+$", "")
    blank = original == ""
    cleaned = F.when(blank, "").otherwise(clean(text, accents=True, min_length=3))
    return F.struct(
        original.alias("original"),
        cleaned.alias("cleaned"),
        F.when(blank, "unknown").otherwise(indicator_share(original)).alias("language"),
        (~blank & original.rlike("[áéíóúãõâêîôûç]")).alias("has_accents"),
        F.size(words(cleaned)).cast("bigint").alias("word_count"),
    )


def cascade(*results: Column, enough: list[float]) -> Column:
    """The first detector's result; each further one is asked while confidence is below its threshold, and
    taken where it is more confident."""
    out = results[0]
    for r, limit in zip(results[1:], enough):
        out = F.when((out["confidence"] < limit) & (r["confidence"] > out["confidence"]), r).otherwise(out)
    return out


def vote(results: list[Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """STRUCT(language, confidence, method_used): weighted confidences summed by language over the sum of weights.

    Among equal languages the one named first wins. Unknown methods weigh 1.
    """
    weight = [F.coalesce(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])[r["method_used"]], F.lit(1.0)) for r in results]
    total = sum(weight[1:], weight[0])
    scored = F.array(*[F.struct(r["language"].alias("language"), (r["confidence"] * w).alias("s")) for r, w in zip(results, weight)])

    def of(language: Column) -> Column:
        return F.aggregate(F.filter(scored, lambda x: x["language"] == language), F.lit(0.0), lambda a, x: a + x["s"])

    named = F.array_distinct(F.transform(scored, lambda x: x["language"]))
    sums = F.transform(named, lambda n, i: F.struct((of(n) / F.nullif(total, F.lit(0.0))).alias("confidence"), (-i).alias("order"), n.alias("language")))
    best = F.array_max(sums)
    method = F.concat(F.lit("ensemble("), F.concat_ws(",", *[r["method_used"] for r in results]), F.lit(")"))
    return F.struct(best["language"].alias("language"), F.coalesce(best["confidence"], F.lit(0.0)).alias("confidence"), method.alias("method_used"))


def slowest(results: list[Column], time: str = "time_ms") -> Column:
    """The longest time that any of the detectors took; null where none says."""
    return F.array_max(F.array(*[r[time] for r in results]))


def asked_again(df: DataFrame, result: str, limit: float, further: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`df` with `result` replaced where it was less sure than `limit` and a further detector is surer.

    Only the unsure rows go to the further detector, which gives its own result in the same column; the sure ones never do.
    """
    sure = F.coalesce(F.col(f"{result}.confidence") >= limit, F.lit(False))
    unsure = df.filter(~sure).withColumn("__before", F.col(result))
    second = further(unsure).withColumn(result, F.when(F.col(f"{result}.confidence") > F.coalesce("__before.confidence", F.lit(-1.0)), F.col(result)).otherwise(F.col("__before")))
    return df.filter(sure).unionByName(second.drop("__before"))


def statistics(df: DataFrame, result: str) -> DataFrame:
    """(language, n, share, mean_confidence) of a column of results."""
    by = df.groupBy(F.col(f"{result}.language").alias("language")).agg(F.count("*").alias("n"), F.avg(f"{result}.confidence").alias("c"))
    total = by.select(F.sum("n").alias("n")).scalar()
    return by.select("language", "n", F.round(F.col("n") / total * 100, 4).alias("share"), F.round("c", 6).alias("mean_confidence"))
