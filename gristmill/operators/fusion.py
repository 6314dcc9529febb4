"""Fusing candidate lists: merge, normalise, weigh, boost by data, rerank.

Candidates are tables (query_id, doc_id, <score columns>); all statistics are per query, so a batch of
queries runs as one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["query_id", "doc_id"]


def merge_candidates(first: DataFrame, second: DataFrame, how: str = "keep_first") -> DataFrame:
    """Candidates of both lists, once each, missing scores null.

    `keep_first` takes a document found by both with the scores of the first list only; `outer` with both.
    A document repeated within a list is taken once, with its largest scores.
    """
    own = {id(d): [c for c in d.columns if c not in KEYS] for d in (first, second)}
    one = first.groupBy(*KEYS).agg(*[F.max(c).alias(c) for c in own[id(first)]])
    two = second.groupBy(*KEYS).agg(*[F.max(c).alias(c) for c in own[id(second)]])
    if how == "outer":
        return one.join(two, KEYS, "full")
    if how != "keep_first":
        raise ValueError(f"unknown merge {how}")
    return one.unionByName(two.join(one, KEYS, "left_anti"), allowMissingColumns=True)


def minmax(score: str, group: str = "query_id", scale: float = 1.0) -> Column:
    """The score between 0 and `scale` within its group; as it is where all are equal; null stays null."""
    w = Window.partitionBy(group)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi > lo, (F.col(score) - lo) / (hi - lo) * scale).otherwise(F.col(score))


def over_max(score: str, group: str) -> Column:
    """The score over the largest of its group; 0 where that is 0 or null."""
    return F.coalesce(F.col(score) / F.nullif(F.max(score).over(Window.partitionBy(group)), F.lit(0.0)), F.lit(0.0))


def fuse(candidates: DataFrame, weights: dict[str, float], to: str = "hybrid_score") -> DataFrame:
    """`candidates` with `<score>_norm` of every weighted score and their weighted sum, missing ones as 0."""
    out = candidates.withColumns({f"{c}_norm": minmax(c) for c in weights})
    total = sum((F.coalesce(F.col(f"{c}_norm"), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    return out.withColumn(to, total)


def path_boost(path: Column, terms: Column, boost: float = 2.0) -> Column:
    """`boost` once where any term (array, lower-case) is part of any level of the path; empty terms don't count."""
    some = F.filter(terms, lambda t: t != "")
    return F.when(F.coalesce(F.exists(some, lambda t: F.contains(F.lower(path), t)), F.lit(False)), F.lit(boost)).otherwise(F.lit(0.0))


def feature_boost(text: Column, features: Column, boost: float = 0.5) -> Column:
    """`boost` for every feature (array; repeats count again) that is part of the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.size(F.filter(F.coalesce(features, F.array().cast("array<string>")), lambda f: F.contains(low, F.lower(f)))) * F.lit(boost)


def rule_boost(candidates: DataFrame, rules: DataFrame, catalogue: DataFrame, score: str = "hybrid_score") -> DataFrame:
    """Add the boosts of `rules` (query_id, doc_id, boost); a ruled document that is no candidate comes in with twice its boost.

    Several rules of one document add up. Rules for documents that `catalogue` (doc_id) lacks have no effect.
    """
    total = rules.groupBy(*KEYS).agg(F.sum("boost").alias("__boost"))
    boosted = candidates.join(total, KEYS, "left").withColumn(score, F.col(score) + F.coalesce("__boost", F.lit(0.0))).drop("__boost")
    new = total.join(catalogue.select("doc_id").distinct(), "doc_id", "left_semi").join(candidates, KEYS, "left_anti")
    return boosted.unionByName(new.select(*KEYS, (F.col("__boost") * 2).alias(score)), allowMissingColumns=True)


def ranked(candidates: DataFrame, score: str, to: str = "rank") -> DataFrame:
    """With the place of each candidate in its query, ties by doc_id, null scores last."""
    w = Window.partitionBy("query_id").orderBy(F.col(score).desc_nulls_last(), "doc_id")
    return candidates.withColumn(to, F.row_number().over(w).cast("bigint"))


def head(candidates: DataFrame, score: str, k: int) -> DataFrame:
    """The first `k` of each query."""
    return ranked(candidates, score).filter(F.col("rank") <= k)


def review_boost(candidates: DataFrame, reviews: DataFrame, top: int = 20, weight: float = 0.4, score: str = "hybrid_score") -> DataFrame:
    """(review - 0.5) * weight added to the first `top` of each query; `reviews` is (doc_id, review_score); none is neutral.

    Places are those before the boost, so the caller decides whether to rank again.
    """
    r = ranked(candidates, score).join(reviews, "doc_id", "left")
    gain = (F.coalesce("review_score", F.lit(0.5)) - 0.5) * weight
    return r.withColumn(score, F.when(F.col("rank") <= top, F.col(score) + gain).otherwise(F.col(score)))


def rerank(candidates: DataFrame, semantic: Column, top: int = 10, share: float = 0.3, score: str = "hybrid_score", places: str | None = None) -> DataFrame:
    """The first `top` of each query by share * (score scaled to 0..10) + (1 - share) * semantic; the rest are dropped.

    Who is first says the score, or the column `places`."""
    first = candidates.filter(F.col(places) <= top).drop(places) if places else head(candidates, score, top).drop("rank")
    first = first.withColumn("normalized_score", minmax(score, scale=10.0)).withColumn("semantic_score", semantic)
    final = F.col("normalized_score") * share + F.col("semantic_score") * (1 - share)
    return ranked(first.withColumn("final_score", F.round(final, 6)), "final_score")


def below(value: Column, bound: Column) -> Column:
    """True where a value is below a bound, strictly; a bound of null or 0 is none, and a null or NaN value fails any other."""
    return bound.isNull() | (bound == 0) | F.coalesce((value < bound) & ~F.isnan(value), F.lit(False))


def within(value: Column, low: float, high: float) -> Column:
    """The value clamped to [low, high]; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def hit_at_k(results: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, reciprocal_rank, hit): where each query's target (query_id, doc_id) came out; 0 where it didn't."""
    found = targets.join(results.select(*KEYS, "rank"), KEYS, "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return found.select(
        "query_id",
        "rank",
        F.round(F.coalesce(1 / F.col("rank"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.coalesce(F.col("rank") <= k, F.lit(False)).alias("hit"),
    )


def relevance_label(score: Column, medium: float, high: float) -> Column:
    """High above `high`, Medium above `medium`, else Low."""
    return F.when(score > high, "High").when(score > medium, "Medium").otherwise("Low")
