"""Dense search: exact scans of a stated query set in blocks, clustered cells, per-dimension scaling."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.numbers import hash_below
from gristmill.operators.sparse import top_k
from gristmill.session import checkpointed

#: Numbers that the queries of a block and their results may take in a task (32 MB): a scan of the corpus serves as many
#: queries as fit, further blocks take further scans.
QUERY_NUMBERS, QUERY_BLOCK = 1 << 22, 1_024
#: Rows that meet the queries of a block at once, and scores that may take.
ROW_BLOCK, SCORES = 1_024, 1 << 22
#: Share of the true neighbours a clustered search aims at, and the rows by which its probes are measured.
IVF_RECALL, PROBE_QUERIES = 0.97, 500


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows) of the vectors of `dim` finite components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy(zero_copy_only=False)
    at = np.flatnonzero(np.asarray(column.is_valid()) & (np.diff(ends) == dim))
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = values[ends[at][:, None] + np.arange(dim)[None, :]] if len(at) else np.empty((0, dim))
    good = np.isfinite(x).all(1)
    return at[good], x[good]


def scan_topk(corpus: DataFrame, queries: DataFrame, k: int, dim: int, metric: str = "ip") -> DataFrame:
    """(query_id, doc_id, score, rank): exact `k` best of each query by inner product, cosine or squared distance.

    `corpus` is (doc_id, v), `queries` (query_id, v). Vectors that are null, of another dimension or not
    finite, and for cosine zero vectors, neither ask nor answer. Each partition keeps k results a query.
    Score is a similarity for `ip` and `cosine`, a distance for `l2`; ties follow doc_id.
    """
    if metric not in ("ip", "cosine", "l2"):
        raise ValueError(f"unknown metric {metric}")

    def block(ids: np.ndarray, q: np.ndarray) -> DataFrame:
        if metric == "cosine":
            n = np.linalg.norm(q, axis=1)
            ids, q = ids[n > 0], q[n > 0] / n[n > 0, None]
        return _scan(corpus, ids, q, k, dim, metric)

    return _in_blocks(queries, dim, block, k, ascending=metric == "l2")


def _in_blocks(queries: DataFrame, dim: int, search: Callable[[np.ndarray, np.ndarray], DataFrame], k: int, ascending: bool = False) -> DataFrame:
    """The `k` best of what `search` finds for each block of (ids, vectors) of the queries."""
    asked = queries.select(F.col("query_id").cast("long"), "v")
    # A single block comes in one job; only where there are more are they counted.
    size = max(QUERY_BLOCK, QUERY_NUMBERS // (dim + 2 * k))
    few = asked.limit(size + 1).toArrow()
    blocks = 1 if few.num_rows <= size else -(-asked.count() // size)
    found = None
    for i in range(blocks):
        # The driver holds one block at a time; with several, each block's results are written before the next.
        got = few if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow()
        at, q = _matrix(got.column("v"), dim)
        block = search(got.column("query_id").to_numpy()[at], q)
        block = checkpointed(block) if blocks > 1 else block
        found = block if found is None else found.unionAll(block)
    order = F.col("score").asc() if ascending else F.col("score").desc()
    return top_k(found.withColumn("score", F.round("score", 6)), "query_id", [order, F.col("doc_id")], k)


def _best(scores: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The `k` highest scores of each row with their documents, the lower id among equals."""
    if scores.shape[1] <= k:
        return scores, docs
    keep = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    last = np.take_along_axis(scores, keep, 1).min(1, initial=np.inf)
    # Where more than k reach the last score, ids decide.
    for i in np.flatnonzero((scores >= last[:, None]).sum(1) > k):
        some = np.flatnonzero(scores[i] >= last[i])
        keep[i] = some[np.lexsort((docs[i][some], -scores[i][some]))[:k]]
    return np.take_along_axis(scores, keep, 1), np.take_along_axis(docs, keep, 1)


def _scan(corpus: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, dim: int, metric: str, visits: np.ndarray | None = None) -> DataFrame:
    """The `k` best of each partition; with `visits` (queries x cells), among the rows whose cell_id a query visits."""
    sent = corpus.sparkSession.sparkContext.broadcast((ids, q, visits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, visits = sent.value
        best = np.full((len(ids), k), -np.inf)
        docs = np.full((len(ids), k), np.iinfo(np.int64).max)
        for b in batches:
            at, x = _matrix(b.column("v"), dim)
            own = b.column("doc_id").to_numpy()[at]
            if metric == "cosine":
                n = np.linalg.norm(x, axis=1)
                own, x = own[n > 0], x[n > 0] / n[n > 0, None]
            step = max(16, min(ROW_BLOCK, SCORES // max(len(ids), 1)))
            parts = [(slice(None), np.arange(i, min(i + step, len(x)))) for i in range(0, len(x), step)]
            if visits is not None:
                cell = b.column("cell_id").to_numpy()[at]
                parts = [(np.flatnonzero(visits[:, c]), np.flatnonzero(cell == c)) for c in np.unique(cell)]
            for asks, rows in parts:
                s = q[asks] @ x[rows].T
                if metric == "l2":
                    s = -np.maximum((q[asks] * q[asks]).sum(1)[:, None] - 2 * s + (x[rows] * x[rows]).sum(1)[None, :], 0)
                scores = np.concatenate([best[asks], np.round(s, 6)], axis=1)
                which = np.concatenate([docs[asks], np.broadcast_to(own[rows], s.shape)], axis=1)
                best[asks], docs[asks] = _best(scores, which, k)
        real = best > -np.inf
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, real.sum(1)).astype(np.int64)), pa.array(docs[real]), pa.array((-best if metric == "l2" else best)[real])],
            names=["query_id", "doc_id", "score"],
        )

    columns = [F.col("doc_id").cast("long").alias("doc_id"), "v", *(["cell_id"] if visits is not None else [])]
    return corpus.select(*columns).mapInArrow(run, "query_id long, doc_id long, score double")


def zscores(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, dim, z): each component less its mean over its population deviation; a deviation of 0 counts as 1, NaN and null become 0."""
    long = df.select(F.col(key), F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))
    stats = long.groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = (F.col("x") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))
    return long.join(stats, "dim").select(key, F.col("dim").cast("bigint").alias("dim"), F.coalesce(F.nanvl(z, F.lit(0.0)), F.lit(0.0)).alias("z"))


def zscore_concat(df: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """(key, combined): both vectors scaled per dimension and joined end to end."""

    def scaled(column: str, name: str) -> DataFrame:
        z = zscores(df, key, column)
        packed = F.array_sort(F.collect_list(F.struct("dim", F.round("z", 6).alias("z"))))
        return z.groupBy(key).agg(F.transform(packed, lambda s: s["z"]).alias(name))

    return scaled(first, "a").join(scaled(second, "b"), key).select(key, F.concat("a", "b").alias("combined"))


def kmeans_cells(df: DataFrame, key: str, vector: str, cells: int, seed: int = 1) -> tuple[DataFrame, list[np.ndarray]]:
    """(table with cell_id, centres): cells of a clustered index; write it partitioned by cell_id."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ml = df.withColumn("__features", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="__features", predictionCol="cell_id").fit(ml)
    return model.transform(ml).drop("__features"), model.clusterCenters()


def save_cells(placed: DataFrame, centres: list[np.ndarray], folder: str) -> None:
    """Write a clustered index: vectors by cell, so that a search reads its cells only, and the centres."""
    spark = placed.sparkSession
    placed.repartition("cell_id").write.mode("overwrite").partitionBy("cell_id").parquet(f"{folder}/vectors")
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    spark.createDataFrame(rows, "cell_id int, centre array<double>").write.mode("overwrite").parquet(f"{folder}/centres")


def search_cells(spark, folder: str, key: str, vector: str, query: list[float], k: int, probes: int) -> DataFrame:
    """The `k` best by inner product in the `probes` cells nearest to the query; other cells' files are not read."""
    from gristmill.functions.vectors import dot

    centres = spark.read.parquet(f"{folder}/centres").collect()  # as many as there are cells
    near = sorted(centres, key=lambda r: sum((a - b) ** 2 for a, b in zip(r.centre, query)))[:probes]
    some = spark.read.parquet(f"{folder}/vectors").filter(F.col("cell_id").isin([r.cell_id for r in near]))
    score = F.round(dot(F.col(vector), F.array(*[F.lit(float(x)) for x in query])), 6)
    return some.select(F.col(key).alias("doc_id"), score.alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(k)


def ivf_topk(
    df: DataFrame, key: str, vector: str, queries: DataFrame, k: int, dim: int, cells: int | None = None, probes: int | None = None, recall: float = IVF_RECALL
) -> DataFrame:
    """(query_id, doc_id, score, rank): the `k` best of each query by inner product among the cells nearest to it; never padded.

    `queries` is (query_id, v). There are sqrt(rows) cells if not stated, and as many are visited as
    `enough_probes` measures for this recall, or `probes`. Vectors that `scan_topk` leaves out take no part here either.
    """
    usable = df.select(F.col(key).alias("doc_id"), F.col(vector).alias("v")).filter((F.size("v") == dim) & F.forall("v", _finite))
    total = usable.count()
    if not total:
        return scan_topk(usable, queries, k, dim)
    placed, centres = kmeans_cells(usable, "doc_id", "v", cells or max(1, int(total**0.5)))
    # Written once: the measurement of the probes and every block of queries read it.
    placed, centres = checkpointed(placed), np.array(centres)
    probes = probes or enough_probes(placed, centres, k, dim, recall, total)
    return _in_blocks(queries, dim, lambda ids, q: _scan(placed, ids, q, k, dim, "ip", _cell_ranks(q, centres) < probes), k)


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def _cell_ranks(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(queries x cells): the place of each cell among those of a query, 0 the nearest."""
    order = np.argsort((centres**2).sum(1)[None, :] - 2 * q @ centres.T, axis=1, kind="stable")
    ranks = np.empty_like(order)
    np.put_along_axis(ranks, order, np.arange(order.shape[1])[None, :], axis=1)
    return ranks


def enough_probes(placed: DataFrame, centres: np.ndarray, k: int, dim: int, recall: float, total: int, asked: int = PROBE_QUERIES) -> int:
    """Cells to visit so that this share of the true `k` best of about `asked` rows, by hash, lives in one of them.

    The true ones come from an exact scan of all rows for the sample.
    """
    sample = placed.filter(F.xxhash64("doc_id") <= hash_below(asked, total)).select(F.col("doc_id").alias("query_id"), "v")
    best = scan_topk(placed.select("doc_id", "v"), sample, k, dim).select("query_id", "doc_id")
    home = best.join(placed.select("doc_id", "cell_id"), "doc_id").select("query_id", "cell_id").toArrow()
    if not home.num_rows:
        return len(centres)
    got = sample.toArrow()
    at, q = _matrix(got.column("v"), dim)
    row = {int(i): n for n, i in enumerate(got.column("query_id").to_numpy()[at])}
    rows = np.array([row[i] for i in home.column("query_id").to_pylist()])
    needed = np.sort(_cell_ranks(q, centres)[rows, home.column("cell_id").to_numpy()]) + 1
    return int(needed[math.ceil(recall * len(needed)) - 1])


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): the share of each query's exact results that were found, on average; null without queries."""
    hits = exact.join(found.select("query_id", "doc_id", F.lit(1.0).alias("hit")), ["query_id", "doc_id"], "left")
    each = hits.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("share"))
    return each.agg(F.count("*").alias("queries"), F.round(F.avg("share"), 6).alias("recall"))
