"""Joins, aggregates and profiles of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.session import checkpointed


def left_lookup(df: DataFrame, lookup: DataFrame, on: str) -> DataFrame:
    """`df` with the columns of `lookup`; keys that `lookup` lacks give nulls. The strategy is the optimizer's."""
    return df.join(lookup, on, "left")


#: Rows of a key up to which one task sorts and joins them; the rows of a larger key are sorted by many tasks.
PIECE = 4_096


def group_concat(df: DataFrame, key: str, value: str, order: list[str], sep: str = " | ", piece: int = PIECE) -> DataFrame:
    """(key, value): non-empty values of each key joined in the given order; empty where a key has none. Null keys are dropped.

    Rows of keys with more than `piece` rows are sorted across the cluster, by key and order; each partition joins the run
    it holds of a key, and the runs are put together. So only the text of a hot key, the result, is ever in one place.
    """
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("__k"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], F.col(value).cast("string").alias("__v"))
    by = [f"__o{i}" for i in range(len(order))]

    def joined(part: DataFrame, keys: list[str]) -> DataFrame:
        packed = F.array_sort(F.collect_list(F.struct(*by, "__v")))
        parts = F.filter(F.transform(packed, lambda s: s["__v"]), lambda v: v.isNotNull() & (v != ""))
        return part.groupBy(*keys).agg(F.array_join(parts, sep).alias("__v"))

    large = checkpointed(rows.groupBy("__k").agg(F.count("*").alias("n")).filter(F.col("n") > piece))
    if large.isEmpty():
        return joined(rows, ["__k"]).select(F.col("__k").alias(key), F.col("__v").alias(value))
    hot = large.agg(F.sum("n").alias("n")).first().n
    small = joined(rows.join(large.select("__k"), "__k", "left_anti"), ["__k"])
    ranged = rows.join(large.select("__k"), "__k", "left_semi").repartitionByRange(max(2, -(-hot // piece)), "__k", *by, "__v")
    # Ranges follow each other, so the number of a partition orders the runs of a key.
    runs = joined(checkpointed(ranged.withColumn("__run", F.spark_partition_id())), ["__k", "__run"])
    whole = F.array_sort(F.collect_list(F.when(F.col("__v") != "", F.struct("__run", "__v"))))
    together = runs.groupBy("__k").agg(F.array_join(F.transform(whole, lambda s: s["__v"]), sep).alias("__v"))
    return small.unionByName(together).select(F.col("__k").alias(key), F.col("__v").alias(value))


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """(columns, n); rows with a null in a column are left out."""
    return df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias("n"))


def null_profile(df: DataFrame) -> DataFrame:
    """(column_name, nulls, filled) of every column, in one pass."""
    counts = df.select(F.count("*").alias("__n"), *[F.count(F.col(c)).alias(c) for c in df.columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), (F.col("__n") - F.col(c)).alias("nulls"), F.col(c).alias("filled")) for c in df.columns])
    return counts.select(F.inline(cells))


def exact_quantiles(long: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """(group, q): the exact quantiles, interpolated between neighbours, as an array; nulls count nowhere.

    Values are counted first, map-side; running counts are taken within ranges of values and added up over the ranges, so
    neither a group nor its different values are ever in one buffer.
    """
    counts = long.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("__g"), F.col(value).alias("__x")).agg(F.count("*").alias("n"))
    ranged = checkpointed(counts.repartitionByRange("__g", "__x").withColumn("__r", F.spark_partition_id()))
    sums = ranged.groupBy("__g", "__r").agg(F.sum("n").alias("in_range"))
    before = sums.withColumn("before", F.sum("in_range").over(Window.partitionBy("__g").orderBy("__r")) - F.col("in_range"))
    total = before.withColumn("total", F.sum("in_range").over(Window.partitionBy("__g"))).select("__g", "__r", "before", "total")
    running = F.sum("n").over(Window.partitionBy("__g", "__r").orderBy("__x"))
    placed = ranged.withColumn("upto", running).join(total, ["__g", "__r"]).select("__g", "__x", "total", (F.col("before") + F.col("upto")).alias("upto"), "n")
    # Rank positions from 0; a value stands at the positions from upto - n to upto - 1.
    found = []
    for p in shares:
        at = F.lit(p) * (F.col("total") - 1)
        holds = lambda k: (F.col("upto") - F.col("n") <= k) & (k < F.col("upto"))
        lo, hi = F.max(F.when(holds(F.floor(at)), F.col("__x"))), F.max(F.when(holds(F.ceil(at)), F.col("__x")))
        part = F.max(at - F.floor(at))
        found.append(F.when(hi > lo, lo + (hi - lo) * part).otherwise(lo))
    return placed.groupBy("__g").agg(F.array(*found).alias("q")).withColumnRenamed("__g", group)


def describe(df: DataFrame, *columns: str) -> DataFrame:
    """(column_name, n, mean, sd, lowest, q1, middle, q3, highest) of number columns; exact quantiles."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in columns])))
    out = long.groupBy("column_name").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev("x").alias("sd"), F.min("x").alias("lowest"), F.max("x").alias("highest")
    ).join(exact_quantiles(long, "column_name", "x", [0.25, 0.5, 0.75]), "column_name", "left")
    r = lambda c: F.round(c, 4)
    return out.select(
        "column_name", "n", r("mean").alias("mean"), r("sd").alias("sd"), r("lowest").alias("lowest"),
        r(F.col("q")[0]).alias("q1"), r(F.col("q")[1]).alias("middle"), r(F.col("q")[2]).alias("q3"), r("highest").alias("highest"),
    )


def profile(df: DataFrame) -> DataFrame:
    """(column_name, position, kind, n_rows, n_columns, nulls, first_value): shape, schema and gaps of a table in one pass; `first_value` is the smallest as text."""
    counts = df.select(F.count("*").alias("__n"), *[F.struct(F.count(F.col(c)).alias("filled"), F.min(F.col(c).cast("string")).alias("v")).alias(f"__{i}") for i, c in enumerate(df.columns)])
    cells = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(i + 1).alias("position"), F.lit(t).alias("kind"), F.col("__n").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"),
            (F.col("__n") - F.col(f"__{i}.filled")).alias("nulls"), F.col(f"__{i}.v").alias("first_value"),
        )
        for i, (c, t) in enumerate(df.dtypes)
    ]
    return counts.select(F.inline(F.array(*cells)))


def first_match(df: DataFrame, condition: Column, *order: str) -> DataFrame:
    """The first row, in the given order, that fulfils a condition; none where none does."""
    return df.filter(condition).orderBy(*order).limit(1)


def member_flags(df: DataFrame, column: str, of: DataFrame, to: str) -> DataFrame:
    """`df` with True in `to` where the value of `column` stands in the one column of `of`; null is no member."""
    known = of.select(F.col(of.columns[0]).alias(column)).distinct().withColumn(to, F.lit(True))
    return df.join(known, column, "left").withColumn(to, F.coalesce(to, F.lit(False)))


def five_numbers(df: DataFrame, group: str, value: str, top: int) -> DataFrame:
    """Minimum, quartiles and maximum of `value` in the `top` largest groups (ties by name)."""
    some = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    largest = some.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), group).limit(top)
    out = exact_quantiles(some.join(largest.select(group), group, "left_semi").select(group, F.col(value).cast("double").alias("__value")), group, "__value", [0.0, 0.25, 0.5, 0.75, 1.0])
    return out.select(group, *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(["lowest", "q1", "middle", "q3", "highest"])])


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n) over `bins` equal parts from the smallest to the largest value; nulls are left out."""
    x = df.select(F.col(value).cast("double").alias("x")).filter(F.col("x").isNotNull())
    lo, hi = x.select(F.min("x").alias("v")).scalar(), x.select(F.max("x").alias("v")).scalar()
    at = F.when(hi > lo, F.least(F.floor((F.col("x") - lo) / ((hi - lo) / bins)), F.lit(bins - 1))).otherwise(F.lit(0))
    return x.groupBy(at.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def quadrants(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row of counts above and below the medians of two columns."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in (x, y)])))
    middles = {r.c: r.q[0] for r in exact_quantiles(long, "c", "v", [0.5]).collect()}  # two rows
    mx, my = (F.lit(middles.get(c)).cast("double") for c in (x, y))
    high_x, high_y = F.col(x) >= mx, F.col(y) >= my
    low_x, low_y = F.col(x) < mx, F.col(y) < my
    return df.agg(
        F.count_if(high_x & high_y).alias("premium"),
        F.count_if(low_x & high_y).alias("high_value"),
        F.count_if(high_x & low_y).alias("overpriced"),
        F.count_if(low_x & low_y).alias("budget"),
    )


def head_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first `n` rows of each group."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def long_form(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    """Wide to long: one row for each of `values`."""
    return df.unpivot(ids, values, name, value)


def joined_strings(df: DataFrame) -> Column:
    """All string columns of a row, in order, joined by blanks; nulls are left out."""
    return F.concat_ws(" ", *[c for c, t in df.dtypes if t == "string"])


def exact_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """`n` rows (all if there are fewer), the same ones at every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)
