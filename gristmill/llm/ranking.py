"""One ranking from several differently scaled scores: leximin over percentiles.

Each score becomes the item's percentile among the items of its group, so neither range nor extreme
values matter. An item's percentiles are sorted ascending and the arrays are compared
lexicographically, largest first: the weakest score decides, then the next weakest, so no strong
score can mask a weak one.

Ranks are counted without putting a group into one task: equal values of a group are counted together
first, the values are cut into ranges of equal size, and a rank is the count of the group's ranges
below plus the count within the range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.session import checkpointed


def _counted_below(counted: DataFrame, keys: list[str], order: list[Column], n: str) -> DataFrame:
    """`counted` with __below, the sum of `n` over the rows of its group that come earlier, and __all.

    Rows are cut into ranges of equal size over the whole table, so a group spans as many ranges as it
    needs; the ranges are written once, since two readers must see the same cut.
    """
    ranges = checkpointed(counted.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    totals = ranges.groupBy(*keys, "__part").agg(F.sum(n).alias("__n_part"))
    by_part = Window.partitionBy(*keys).orderBy("__part")
    totals = totals.select(
        *keys,
        "__part",
        (F.sum("__n_part").over(by_part) - F.col("__n_part")).alias("__offset"),
        F.sum("__n_part").over(Window.partitionBy(*keys)).alias("__all"),
    )
    inside = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranges.withColumn("__inside", F.coalesce(F.sum(n).over(inside), F.lit(0)))
        .join(totals, [*keys, "__part"])
        .withColumn("__below", F.col("__offset") + F.col("__inside"))
        .drop("__offset", "__inside", "__part")
    )


def standings(df: DataFrame, group: str, item: str, scores: dict[str, Column | str]) -> DataFrame:
    """(group, item, standing ARRAY<DOUBLE>): each item's percentiles over `scores`, ascending.

    Every score, a column or SQL expression, is "higher is better"; negate one that is not. A percentile
    is the share of the group's items that are worse, ties counting half. Null and NaN scores are tied at the bottom.
    A (group, item) that is repeated counts once, with the best value of each score. An empty table
    gives no row; a group of one item gives 0.5 throughout. Other columns are not read.
    """
    bottom = F.lit(float("-inf"))
    columns = []
    for i, c in enumerate(scores.values()):
        d = (F.expr(c) if isinstance(c, str) else c).cast("double")
        columns.append(F.max(F.when(F.isnan(d), None).otherwise(d)).alias(f"__s{i}"))
    items = df.groupBy(F.col(group).alias("__g"), F.col(item).alias("__i")).agg(*columns)
    long = items.select(
        "__g",
        "__i",
        F.inline(F.array(*[F.struct(F.lit(i).alias("__dim"), F.coalesce(f"__s{i}", bottom).alias("__v")) for i in range(len(scores))])),
    ).withColumn("__g", F.struct(F.col("__g").alias("g")))  # a struct is never null, so null groups join too
    values = long.groupBy("__g", "__dim", "__v").agg(F.count("*").alias("__n"))
    keys = ["__g", "__dim"]
    ranked = _counted_below(values, keys, [F.col("__v")], "__n")
    share = ranked.select(*keys, "__v", ((F.col("__below") + F.col("__n") / 2) / F.col("__all")).alias("__p"))
    joined = long.join(share, [*keys, "__v"])
    return (
        joined.groupBy("__g", "__i")
        .agg(F.array_sort(F.collect_list("__p")).alias("standing"))
        .select(F.col("__g.g").alias(group), F.col("__i").alias(item), "standing")
    )


def leximin(df: DataFrame, group: str, item: str, scores: dict[str, Column | str]) -> DataFrame:
    """(group, item, standing, position): the whole ranking; equal standings follow the item id."""
    s = standings(df, group, item, scores).withColumnsRenamed({group: "__g", item: "__i"})
    s = s.withColumn("__g", F.struct(F.col("__g").alias("g"))).withColumn("__one", F.lit(1))
    order = [F.col("standing").desc(), F.col("__i").asc_nulls_last()]
    ranked = _counted_below(s, ["__g"], order, "__one")
    return ranked.select(F.col("__g.g").alias(group), F.col("__i").alias(item), "standing", (F.col("__below") + 1).alias("position"))


def leximin_top(df: DataFrame, group: str, item: str, scores: dict[str, Column | str], k: int) -> DataFrame:
    """The first `k` of each group's ranking, with position; each task keeps k rows of a group before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.col("standing").desc(), F.col(item).asc_nulls_last())
    return (
        standings(df, group, item, scores).withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)
    )
