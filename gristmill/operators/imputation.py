"""Filling missing numbers and categories from similar records by k-prototypes clusters.

1. `fit_on` fits k prototypes (numeric centres and categorical modes) on all rows: each round assigns every
   row and sums up by prototype before the shuffle; a bounded sample gives the starting points only. Numeric
   distance runs over the features a row has, categorical distance over the categories it has, so rows with
   gaps take part.
2. `impute` assigns every row to its nearest prototype and takes, over all rows, the median or the mode of each
   cluster within its parent (the first categorical feature but the field itself); a gap is filled from
   there if `LEAST` rows are, else from the parent, else from the cluster at large, else from the whole
   table, and each value carries the method that gave it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gristmill.functions.numbers import hash_below
from gristmill.session import checkpointed

#: Rows the starting prototypes are drawn from; scaling, rounds, assignment and medians cover all rows.
FIT_ROWS = 20_000
#: Prototypes, and rounds of fitting.
CLUSTERS, ROUNDS = 32, 12
#: Weight of one differing category against one standard deviation squared.
GAMMA = 0.5
#: Known values that a cluster within a parent must have for its median or mode to be taken.
LEAST = 20
#: Accuracy of the medians: at most one part in this of the rows off in rank.
MEDIAN_ACCURACY = 10_000


@dataclass(frozen=True)
class Prototypes:
    """Centres of the scaled numeric features, modes of the categorical ones, and the scaling."""

    numeric: list[str]
    categorical: list[str]
    mean: np.ndarray
    scale: np.ndarray
    centres: np.ndarray
    modes: np.ndarray
    gamma: float

    def assign(self, numbers: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The nearest prototype of each row, the lowest number among equals; NaN numbers are left out."""
        x = (numbers - self.mean) / self.scale
        seen = ~np.isnan(x)
        x = np.where(seen, x, 0.0)
        w = seen.astype(float)
        # Sum over observed features of (x - c)^2, scaled up to the full number of features.
        d = (x * x).sum(1)[:, None] - 2 * x @ self.centres.T + w @ (self.centres**2).T
        d *= (x.shape[1] / np.maximum(w.sum(1), 1.0))[:, None]
        for j in range(words.shape[1]):
            code, values = pd.factorize(words[:, j])
            d += self.gamma * ((values[:, None] != self.modes[:, j][None, :]) & (values != "")[:, None])[code]
        return d.argmin(1).astype(np.int32)


def fit_prototypes(
    sample: pd.DataFrame, numeric: list[str], categorical: list[str], clusters: int = CLUSTERS, gamma: float = GAMMA, seed: int = 7
) -> Prototypes:
    """K-prototypes on the rows of `sample`; null and empty categories are gaps.

    With fewer different rows than `clusters` there are as many prototypes as rows; an empty sample
    gives one prototype at the origin.
    """
    x = sample[numeric].to_numpy(dtype=float) if len(sample) else np.zeros((1, len(numeric)))
    words = sample[categorical].fillna("").astype(str).to_numpy(dtype=object) if len(sample) else np.full((1, len(categorical)), "", object)
    with np.errstate(all="ignore"):
        mean = np.nan_to_num(np.array([np.nanmean(c) if (~np.isnan(c)).any() else 0.0 for c in x.T]))
        scale = np.array([np.nanstd(c) if (~np.isnan(c)).any() else 1.0 for c in x.T])
    scale = np.where(scale > 0, scale, 1.0)
    rng = np.random.default_rng(seed)
    start = rng.choice(len(x), min(clusters, len(x)), replace=False)
    z = (x - mean) / scale
    model = Prototypes(numeric, categorical, mean, scale, np.nan_to_num(z[start]), words[start], gamma)
    for _ in range(ROUNDS):
        at = model.assign(x, words)
        centres, modes = model.centres.copy(), model.modes.copy()
        for k in range(len(centres)):
            own = at == k
            if not own.any():
                continue
            seen = ~np.isnan(z[own])
            n = seen.sum(0)
            centres[k] = np.where(n > 0, np.where(seen, z[own], 0).sum(0) / np.maximum(n, 1), centres[k])
            for j in range(words.shape[1]):
                values, counts = np.unique(words[own & (words[:, j] != ""), j].astype(str), return_counts=True)
                if len(values):
                    modes[k, j] = values[counts.argmax()]
        if np.array_equal(centres, model.centres) and np.array_equal(modes, model.modes):
            break
        model = Prototypes(numeric, categorical, mean, scale, centres, modes, gamma)
    return model


def fit_on(base: DataFrame, numeric: list[str], categorical: list[str], start: Prototypes) -> Prototypes:
    """K-prototypes by rounds over all rows of `base` from `start`, whose scaling is replaced by that of all rows.

    Each task keeps sums and counts by prototype, and one row of counts for each value of a category it has met; what
    comes to the driver is the most frequent value of each prototype, the smaller among equals.
    """
    facts = base.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("scale")).alias(c) for c in numeric]).first()
    mean = np.array([facts[c]["mean"] or 0.0 for c in numeric])
    scale = np.array([facts[c]["scale"] or 1.0 for c in numeric])
    centres = (start.centres * start.scale + start.mean - mean) / scale
    model = Prototypes(numeric, categorical, mean, scale, centres, start.modes, start.gamma)
    for _ in range(ROUNDS):
        found = _round(base, model)
        centres, modes = model.centres.copy(), model.modes.copy()
        for r in found:
            if r.feature < len(numeric):
                centres[r.cluster, r.feature] = r.total / r.rows
            else:
                modes[r.cluster, r.feature - len(numeric)] = r.value
        done = np.allclose(centres, model.centres, rtol=0, atol=1e-9) and np.array_equal(modes, model.modes)
        if done:
            break
        model = Prototypes(numeric, categorical, mean, scale, centres, modes, model.gamma)
    return model


def _round(base: DataFrame, model: Prototypes) -> list:
    """(cluster, feature, value, total, rows): the sum of each scaled number, and the most frequent value of each category."""
    sent = base.sparkSession.sparkContext.broadcast(model)
    names, words = model.numeric, model.categorical

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        sums, counts = np.zeros(m.centres.shape), np.zeros(m.centres.shape)
        seen: list[dict[tuple[int, str], int]] = [{} for _ in words]
        for b in batches:
            x, w = _features(b, names, words)
            at = m.assign(x, w)
            z = (x - m.mean) / m.scale
            np.add.at(sums, at, np.nan_to_num(z))
            np.add.at(counts, at, ~np.isnan(z))
            for j, of in enumerate(seen):
                code, values = pd.factorize(w[:, j])
                which, n = np.unique(at * np.int64(len(values)) + code, return_counts=True)
                for i, more in zip(which.tolist(), n.tolist()):
                    key = i // len(values), values[i % len(values)]
                    if key[1] != "":
                        of[key] = of.get(key, 0) + more
        rows = [(int(k), int(j), None, float(sums[k, j]), int(counts[k, j])) for k, j in zip(*np.nonzero(counts))]
        rows += [(k, len(names) + j, v, None, n) for j, of in enumerate(seen) for (k, v), n in of.items()]
        columns = list(zip(*rows)) if rows else [()] * 5
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["cluster", "feature", "value", "total", "rows"])

    tallied = base.select(*names, *words).mapInArrow(tally, "cluster int, feature int, value string, total double, rows long")
    summed = tallied.groupBy("cluster", "feature", "value").agg(F.sum("total").alias("total"), F.sum("rows").alias("rows"))
    ordered = Window.partitionBy("cluster", "feature").orderBy(F.col("rows").desc(), "value")
    return summed.withColumn("place", F.row_number().over(ordered)).filter("place = 1").collect()


def _features(b: pa.RecordBatch, names: list[str], words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names])
    w = np.column_stack([np.asarray(b.column(c).to_pylist(), dtype=object) for c in words]) if words else np.empty((b.num_rows, 0), object)
    return x, w


def _modes(seen: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __found, __rows): the most frequent value of each group, the smaller among equals; counted map-side."""
    counts = seen.groupBy(*keys, "__value").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("__value").alias("v")))["v"]
    return counts.groupBy(*keys).agg(best.alias("__found"), F.sum("n").alias("__rows"))


def _medians(seen: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __found, __rows): the median of each group, by map-side sketches."""
    return seen.groupBy(*keys).agg(F.percentile_approx("__value", 0.5, MEDIAN_ACCURACY).alias("__found"), F.count("*").alias("__rows"))


def _filled(long: DataFrame, typical: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """(__key, field_name, value, method, __cluster) of (__key, __cluster, __parent, field_name, __value)."""
    # Small tables by cluster, parent and target. The parents are as many as the data have, so those tables
    # are joined by whatever strategy their size allows.
    seen = long.filter(F.col("__value").isNotNull())
    levels = {"cluster": ["__cluster", "__parent"], "parent": ["__parent"], "wide_cluster": ["__cluster"], "global": []}
    found, value, method = long, F.col("__value"), F.when(F.col("__value").isNotNull(), "observed")
    for name, by in levels.items():
        keys = [*by, "field_name"]
        table = typical(seen, keys).filter(F.col("__rows") >= (LEAST if name == "cluster" else 1)).drop("__rows")
        found = found.join(table.withColumnRenamed("__found", f"__of_{name}"), keys, "left")
        value, method = F.coalesce(value, f"__of_{name}"), method.when(F.col(f"__of_{name}").isNotNull(), name)
    return found.select("__key", "field_name", value.alias("value"), method.otherwise("none").alias("method"), "__cluster")


def impute(
    df: DataFrame,
    key: str,
    targets: list[str],
    numeric: list[str],
    categorical: list[str],
    clusters: int = CLUSTERS,
    fit_rows: int = FIT_ROWS,
    words: list[str] = (),
) -> DataFrame:
    """(key, field_name, value, method, cluster): one row per row of `df` and target field.

    `targets` are number fields, `words` text fields filled with the most frequent value; where there are `words`, a
    column `text_value` holds theirs. `numeric` holds double columns; a target among them steers the
    clusters, which costs accuracy (see `masked_error`); `categorical` may hold targets. `method` is `observed`, `cluster` (within the parent), `parent` (the
    first of `categorical` but the target itself), `wide_cluster` (of all parents), `global`, or `none` where the whole column is null; NaN counts as null, an
    empty category as a gap. Rows are not removed: repeated keys give a row each. An empty table gives an empty
    result. Medians and modes are taken with map-side sums, so one cluster may hold any share of the rows.
    """
    spark = df.sparkSession
    columns = list(dict.fromkeys([*numeric, *targets]))
    base = df.select(
        F.col(key).alias("__key"),
        *[F.when(~F.isnan(c), F.col(c).cast("double")).alias(f"__n_{c}") for c in columns],
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"__c_{c}") for c in dict.fromkeys([*categorical, *words])],
    )
    names, kinds = [f"__n_{c}" for c in numeric], [f"__c_{c}" for c in categorical]
    # Written once: the sample, every round and the assignment read it.
    base = checkpointed(base)
    sample = base.select(*names, *kinds).orderBy(F.xxhash64("__key"), *names, *kinds).limit(fit_rows).toPandas()
    start = fit_prototypes(sample, names, kinds, clusters)
    model = spark.sparkContext.broadcast(fit_on(base, names, kinds, start) if len(sample) else start)

    schema = StructType([*base.schema.fields, StructField("__cluster", IntegerType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            x, w = _features(b, names, kinds)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m.assign(x, w))], names=[*b.schema.names, "__cluster"])

    def parent(target: str) -> Column:
        others = [c for c in categorical if c != target]
        return F.nullif(F.col(f"__c_{others[0]}"), F.lit("")) if others else F.lit(None).cast("string")

    def long(fields: list[str], prefix: str, empty: Column) -> DataFrame:
        cells = [F.struct(F.lit(t).alias("field_name"), F.nullif(F.col(f"{prefix}{t}"), empty).alias("__value"), parent(t).alias("__parent")) for t in fields]
        return placed.select("__key", "__cluster", F.inline(F.array(*cells)))

    # Written once: the medians, the modes and the filling read it.
    placed = checkpointed(base.mapInArrow(assign, schema).select("__key", "__cluster", *[c for c in base.columns if c != "__key"]))
    out = []
    if targets:
        out.append(_filled(long(targets, "__n_", F.lit(None).cast("double")), _medians))
    if words:
        texts = _filled(long(list(words), "__c_", F.lit("")), _modes).withColumnRenamed("value", "text_value")
        out = [d.withColumn("text_value", F.lit(None).cast("string")) for d in out]
        out.append(texts.withColumn("value", F.lit(None).cast("double")))
    filled = functools.reduce(DataFrame.unionByName, out)
    return filled.select(F.col("__key").alias(key), "field_name", "value", *(["text_value"] if words else []), "method", F.col("__cluster").alias("cluster"))


def masked_error(df: DataFrame, key: str, target: str, numeric: list[str], categorical: list[str], of_target: list[str] = (), share: float = 0.1) -> DataFrame:
    """(field_name, way, n, error): how far filled values are from known ones that were hidden from the operator.

    About `share` of the known values of `target`, by hash of the key, are taken away and filled; `way` is `filled` for the
    operator's values and `parent` for the median of the first categorical feature alone. The error is the mean absolute one.
    `of_target` are features computed from the target, hidden with it.
    """
    hide = F.col(target).isNotNull() & (F.xxhash64(F.lit("masked"), F.col(key).cast("string")) <= hash_below(share * 2**32, 2**32))
    kept = checkpointed(df.withColumns({"__known": F.col(target), **{c: F.when(~hide, F.col(c)) for c in (target, *of_target)}}))
    got = impute(kept, key, [target], numeric, categorical).filter("method <> 'observed'").select(key, F.col("value").alias("filled"))
    medians = kept.groupBy(F.col(categorical[0]).alias("__p")).agg(F.percentile_approx(target, 0.5, MEDIAN_ACCURACY).alias("parent"))
    hidden = kept.filter(F.col("__known").isNotNull() & F.col(target).isNull()).select(key, "__known", F.col(categorical[0]).alias("__p"))
    both = hidden.join(got, key).join(medians, "__p", "left")
    cells = F.array(*[F.struct(F.lit(w).alias("way"), F.abs(F.col(w) - F.col("__known")).alias("e")) for w in ("filled", "parent")])
    return both.select(F.inline(cells)).groupBy("way").agg(F.count("e").alias("n"), F.round(F.avg("e"), 4).alias("error")).select(F.lit(target).alias("field_name"), "way", "n", "error")
