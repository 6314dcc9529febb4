"""Most similar vectors for every vector: a block matrix join in int8 with exact float recomputation.

1. Equal vectors are put into classes by hash; one of each class goes on, so a group of copies of any
   size costs as much as one vector until results are expanded.
2. Vectors become unit vectors. Cell centres are fitted by k-means on a bounded sample; every vector
   has a home cell, its nearest centre, and visits the next nearest cells as well. Cells that would hold
   more than `BLOCK` rows are divided again, by centres fitted in the cluster on a sample of each, until
   none is left, so rows a cell and copies a vector stay bounded whatever the size of the table.
3. Homes and visitors of a cell meet in tiles of bounded size. A tile multiplies the int8 forms of its
   two blocks (in float32 matrix products, exact here: 64 products of 127^2 stay below 2^24) and knows
   for each vector the norm of its rounding error, so every product comes with an error bound.
4. Pairs that the bound cannot rule out are recomputed in float64. For k nearest, each tile keeps a
   heap of k per vector, and the heaps of a vector's tiles are merged.

Cells are found on a sample, all rows are indexed; what is lost is only a pair neither of whose vectors
visits the other's home. README.md has the recall measured against brute force. `exact=True` takes no
cells: the whole matrix is cut into tiles of `BLOCK` x `BLOCK`, nothing is lost, and work is quadratic.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.numbers import hash_below
from gristmill.session import checkpointed

#: Classes of equal vectors up to which their table is broadcast.
BROADCAST_CLASSES = 50_000
#: Vectors the centres are fitted on, at most.
FIT_ROWS = 16_384
#: Rounds of k-means.
ROUNDS = 10
#: Cells a vector visits at most for pairs above a threshold, and by how much less its product with
#: their centre may be than with the centre of its home.
PROBES, MARGIN = 12, 0.07
#: Rows of one side of a tile that are aimed at; a cell with more is divided, or cut into several blocks.
BLOCK = 4_096
#: A cell is divided into this many at most at once, by centres fitted on so many of its rows for each.
DIVIDED, FIT_EACH = 256, 16
#: Share of pairs above the threshold from which a cell is not divided.
CROWDED = 0.02
#: Numbers of cells of one depth: 8,192 at first, times `DIVIDED` with each division.
LEVEL = 1 << 48
#: Rows of a cell that one task divides, about.
DIVIDED_ROWS = 65_536
#: Parts of a divided cell a vector visits at most, for pairs and for nearest.
PROBES_BELOW, PROBES_BELOW_NEAREST = 4, 32
#: Divisions of divisions; copies of one vector in all, for pairs.
DEPTH, COPIES = 4, 16


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, unit float32 rows) of the vectors that have `dim` finite components, not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    ok = np.asarray(column.is_valid()) & (sizes == dim)
    at = np.flatnonzero(ok)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = values[ends[at][:, None] + np.arange(dim)[None, :]] if len(at) else np.empty((0, dim))
    norms = np.sqrt((x * x).sum(1))
    good = np.isfinite(norms) & (norms > 0)
    return at[good], (x[good] / norms[good, None]).astype(np.float32)


def cells_for(sample: int, total: int) -> int:
    """How many cells a table of `total` vectors gets: about its square root, so that cells and their sizes grow alike,
    as long as the sample has four vectors for each; beyond that cells are divided."""
    return max(1, min(sample // 4, math.isqrt(total), 8192))


def fit_centres(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Spherical k-means: `k` centres of the unit vectors `x`, or as many as there are vectors."""
    if not len(x):
        return np.zeros((1, x.shape[1]), np.float32)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        home = _nearest(x, c, 1)[:, 0]
        order = np.argsort(home, kind="stable")
        filled, starts = np.unique(home[order], return_index=True)
        sums = np.add.reduceat(x[order], starts, axis=0)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c[filled] = np.where(norms > 0, sums / np.maximum(norms, 1e-12), c[filled])
    return c


def _nearest(x: np.ndarray, c: np.ndarray, p: int) -> np.ndarray:
    """The `p` nearest centres of each row, nearest first."""
    out = np.empty((len(x), min(p, len(c))), np.int32)
    for s in range(0, len(x), 4096):
        d = x[s : s + 4096] @ c.T
        if out.shape[1] > 8:
            few = np.argpartition(-d, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
            order = np.argsort(-np.take_along_axis(d, few, axis=1), axis=1)
            out[s : s + 4096] = np.take_along_axis(few, order, axis=1)
            continue
        for j in range(out.shape[1]):
            best = d.argmax(1)
            out[s : s + 4096, j] = best
            d[np.arange(len(d)), best] = -np.inf
    return out


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scale, norm of the rounded row, norm of the rounding error)."""
    scale = np.maximum(np.abs(x).max(1), 1e-12) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(approximate products, error bound) of all rows of `a` with all rows of `b`, from their int8 forms.

    x.y - x'.y' = (x - x').y + x'.(y - y'), so the error is at most |x - x'| |y| + |x'| |y - y'|.
    """
    qa, sa, na, ea = quantise(a)
    qb, sb, _, eb = quantise(b)
    product = (qa.astype(np.float32) @ qb.astype(np.float32).T) * (sa[:, None] * sb[None, :]).astype(np.float32)
    return product, (ea[:, None] + na[:, None] * eb[None, :] + 1e-6).astype(np.float32)


_PLACED = "id long, cell long, home boolean, query boolean, gap float, v binary"


def _collapsed(df: DataFrame, key: str, vector: str, dim: int, query: str | None) -> tuple[DataFrame, int, DataFrame | None]:
    """(id, query, v) with one row for each class of equal vectors, how many vectors there are, and the classes of several rows.

    The third is (rep, id, query) of every row of those classes, the representative among them, or None
    where all vectors differ. Hashes are written once; only they are shuffled to find the classes. The
    vectors themselves are read again where they are used.
    """
    base = df.select(F.col(key).cast("long").alias("id"), (F.expr(query) if query else F.lit(True)).alias("query"), F.col(vector).alias("v"))
    hi, lo = F.array_max("v"), F.array_min("v")
    usable = (F.size(F.array_compact("v")) == dim) & ~F.isnan(hi) & (hi < float("inf")) & (lo > float("-inf")) & ((hi != 0) | (lo != 0))
    base = base.filter((F.size("v") == dim) & usable)
    hashes = [F.xxhash64("v").alias("h1"), F.hash("v").alias("h2")]
    marks = checkpointed(base.select("id", "query", *hashes))
    by_id = marks.groupBy("h1", "h2", "id").agg(F.count("*").alias("rows"), F.max("query").alias("query"))
    classes = by_id.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("ids"), F.max("rows").alias("rows"), F.max("query").alias("any_asks"))
    classes = checkpointed(classes.filter("ids > 1 OR rows > 1"))
    total = marks.count()
    facts = classes.agg(F.count("*").alias("n"), F.max("rows").alias("rows")).first()
    if not facts.n:
        return base, total, None
    known = F.broadcast(classes) if facts.n <= BROADCAST_CLASSES else classes
    marked = base.select("*", *hashes).join(known, ["h1", "h2"], "left").withColumn("query", F.coalesce("any_asks", "query"))
    if facts.rows > 1:  # rows repeated under one id: one of each is taken
        first = marked.filter("rep = id").dropDuplicates(["h1", "h2"])
        each = marked.filter("rep IS NULL").select("id", "query", "v").unionAll(first.select("id", "query", "v"))
    else:
        each = marked.filter("rep IS NULL OR rep = id").select("id", "query", "v")
    members = marks.join(known.select("h1", "h2", "rep"), ["h1", "h2"]).select("rep", "id", "query").distinct()
    return each, total, members


def enough_probes(x: np.ndarray, centres: np.ndarray, k: int, recall: float, queries: int = 200) -> int:
    """Cells a vector must visit so that this share of its `k` nearest in the sample live in one of them.

    Neighbours are farther apart in a sample than in the whole, so the count errs towards more cells.
    """
    if len(x) < 2:
        return 1
    q = x[: min(queries, len(x))]
    s = q @ x.T
    s[np.arange(len(q)), np.arange(len(q))] = -np.inf
    top = np.argsort(-s, axis=1)[:, : min(k, len(x) - 1)]
    home = _nearest(x, centres, 1)[:, 0]
    order = np.argsort(-(q @ centres.T), axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], axis=1)
    needed = np.sort(np.take_along_axis(rank, home[top], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)])


def _fit(base: DataFrame, total: int, dim: int, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Centres of the table and the sample they were fitted on."""
    picked = base.filter(F.xxhash64("id") <= hash_below(1.25 * fit_rows, total)).select("v").limit(2 * fit_rows)
    _, x = unit_rows(picked.toArrow().column("v"), dim)
    x = x[:fit_rows]
    return fit_centres(x, cells_for(len(x), total)), x


def _binary(x: np.ndarray) -> pa.Array:
    step = x.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * step).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _visits(x: np.ndarray, home: np.ndarray, centres: np.ndarray, probes: int, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, gap) of the cells of each row besides its home: up to `probes` with it, their products less by `margin` at most."""
    out = []
    for s in range(0, len(x), 512):
        part, own = x[s : s + 512], home[s : s + 512]
        near = _nearest(part, centres, probes)
        gap = np.einsum("ij,ij->i", part, centres[own])[:, None] - np.einsum("ij,ikj->ik", part, centres[near])
        row, rank = np.nonzero((gap <= margin) & (near != own[:, None]))
        out.append((row + s, near[row, rank], gap[row, rank].astype(np.float32)))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0, np.float32))


def _place(base: DataFrame, centres: np.ndarray, dim: int, probes: int, margin: float = np.inf) -> DataFrame:
    """Every vector at home in its cell, and those that ask once more for each cell they visit."""
    sent = base.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            at, x = unit_rows(b.column("v"), dim)
            ids = b.column("id").to_numpy(zero_copy_only=False)[at] if len(at) else np.empty(0, np.int64)
            asks = np.asarray(b.column("query"))[at] if len(at) else np.empty(0, bool)
            home = _nearest(x, model, 1)[:, 0]
            visitors = np.flatnonzero(asks)
            row, cell, gap = _visits(x[visitors], home[visitors], model, probes, margin)
            i = np.concatenate([np.arange(len(x)), visitors[row]])
            yield _placed(ids[i], np.concatenate([home, cell]), np.arange(len(i)) < len(x), asks[i], np.concatenate([np.zeros(len(x)), gap]), x[i])

    return base.mapInArrow(run, _PLACED)


def _placed(ids: np.ndarray, cell: np.ndarray, home: np.ndarray, query: np.ndarray, gap: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(ids, pa.int64()), pa.array(cell.astype(np.int64)), pa.array(home), pa.array(query), pa.array(gap.astype(np.float32)), _binary(x)]
    return pa.RecordBatch.from_arrays(columns, names=["id", "cell", "home", "query", "gap", "v"])


def _divided(placed: DataFrame, dim: int, margin: float, probes: int, copies: int | None, block: int, threshold: float = np.inf) -> tuple[DataFrame, DataFrame]:
    """(placed, cells that still hold more rows than two blocks): large cells divided until none can be divided further.

    A large cell is divided by centres of its own, fitted on a hash sample of its rows in one task; its rows are spread
    over as many tasks as their number needs, each with the few centres of that cell. A cell where more than `CROWDED`
    of the sampled pairs reach `threshold` is left whole: its pairs are results anyway, and parts would lose some.
    """
    for depth in range(DEPTH):
        placed = checkpointed(placed)
        sizes = placed.filter("home").groupBy("cell").agg(F.count("*").alias("rows"))
        large = checkpointed(sizes.filter(F.col("rows") > 2 * block).withColumn("parts", F.least(F.ceil(F.col("rows") * 2 / block), F.lit(DIVIDED)).cast("int")))
        if large.isEmpty():
            return placed, large
        share = F.least(F.lit(1.0), F.lit(float(FIT_EACH)) * F.col("parts") / F.col("rows"))
        unit = F.pmod(F.xxhash64("id", F.lit(depth)), F.lit(1 << 53)) / float(1 << 53)  # uniform in [0, 1)
        sample = placed.filter("home").join(large, "cell").filter(unit < share).select("cell", "parts", "v")

        def fit(t: pa.Table) -> pa.Table:
            x = _matrix(t.column("v"), dim)
            some = x[:512]
            if ((some @ some.T >= threshold).sum() - len(some)) > CROWDED * len(some) * (len(some) - 1):
                return pa.table({"cell": pa.array([], pa.int64()), "centres": pa.array([], pa.binary())})
            c = fit_centres(x, t.column("parts")[0].as_py())
            return pa.table({"cell": t.column("cell").slice(0, 1), "centres": pa.array([c.tobytes()], pa.binary())})

        centres = checkpointed(sample.groupBy("cell").applyInArrow(fit, "cell long, centres binary"))
        if centres.isEmpty():
            return placed, large
        tasks = F.ceil(F.col("rows") / DIVIDED_ROWS).cast("int")
        spread = centres.join(large.select("cell", tasks.alias("tasks")), "cell").select("cell", "centres", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
        inside = placed.join(large.join(centres.select("cell"), "cell", "left_semi").select("cell", tasks.alias("tasks")), "cell")
        inside = inside.withColumn("task", F.pmod(F.xxhash64("id"), F.col("tasks")).cast("int")).drop("tasks")

        def divide(rows: pa.Table, of: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return target.empty_table()
            c = np.frombuffer(of.column("centres")[0].as_py(), np.float32).reshape(-1, dim)
            x = _matrix(rows.column("v"), dim)
            ids, cell, home, query, gap = (rows.column(n).to_numpy() for n in ("id", "cell", "home", "query", "gap"))
            best = _nearest(x, c, 1)[:, 0]
            asks = np.flatnonzero(query)
            row, part, more = _visits(x[asks], best[asks], c, probes, margin)
            i = np.concatenate([np.arange(len(x)), asks[row]])
            under = (depth + 1) * LEVEL + cell[i] % LEVEL * DIVIDED + np.concatenate([best, part])
            stays = np.concatenate([home, np.zeros(len(row), bool)])
            return pa.Table.from_batches([_placed(ids[i], under, stays, query[i], np.concatenate([gap, gap[asks[row]] + more]), x[i])])

        target = pa.schema([("id", pa.int64()), ("cell", pa.int64()), ("home", pa.bool_()), ("query", pa.bool_()), ("gap", pa.float32()), ("v", pa.binary())])
        finer = inside.groupBy("cell", "task").cogroup(spread.groupBy("cell", "task")).applyInArrow(divide, _PLACED)
        placed = placed.join(large.join(centres, "cell", "left_semi").select("cell"), "cell", "left_anti").select(*finer.columns).unionAll(finer)
        if copies:
            order = Window.partitionBy("id").orderBy(F.col("home").desc(), "gap", "cell")
            placed = placed.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= copies).drop("n")
    placed = checkpointed(placed)
    sizes = placed.filter("home").groupBy("cell").agg(F.count("*").alias("rows"))
    return placed, checkpointed(sizes.filter(F.col("rows") > 2 * block))


def _blocks(placed: DataFrame, large: DataFrame | None, block: int) -> DataFrame:
    """`placed` with the block of each row: 0, or in a cell of several blocks a row of tiles for a home row and a column for a query."""
    placed = placed.drop("gap")
    if large is None:
        return placed.withColumn("block", F.lit(0))
    n = F.ceil(F.col("rows") / block).cast("int")
    some = placed.join(large.select("cell", n.alias("n")), "cell", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    mine, k = F.pmod(F.xxhash64("id"), F.col("n")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    homes = some.filter("home").select("*", k.alias("k")).withColumn("block", mine * F.col("n") + F.col("k"))
    homes = homes.withColumn("query", F.col("query") & (F.col("k") == mine))  # where both axes give one block, one row stands for both
    asks = some.filter("query").select("*", k.alias("k")).withColumn("block", F.col("k") * F.col("n") + mine)
    asks = asks.filter(~F.col("home") | (F.col("k") != mine)).withColumn("home", F.lit(False))
    return homes.unionAll(asks).drop("n", "k")


def _tiles(base: DataFrame, total: int, dim: int, probes: int | None, margin: float, exact: bool, k: int = 0, recall: float = 0.0, copies: int | None = COPIES,
           fit_rows: int = FIT_ROWS, block: int = BLOCK, threshold: float = np.inf) -> DataFrame:
    """The rows of every tile, grouped by `cell` and `block`."""
    if exact:
        placed = _place(base, np.zeros((1, dim), np.float32), dim, 1)
        whole = base.sparkSession.range(1).select(F.lit(0).cast("long").alias("cell"), F.lit(total).alias("rows"))
        return _blocks(placed, whole if total > block else None, block)
    centres, x = _fit(base, total, dim, fit_rows)
    placed = _place(base, centres, dim, probes or enough_probes(x, centres, k, recall), margin)
    # Cells grow as the square root of the table as long as the sample allows; then no cell need be counted or divided.
    share = np.bincount(_nearest(x, centres, 1)[:, 0], minlength=len(centres)) / max(len(x), 1)
    large = None
    if share.max(initial=0) * total > 2 * block:
        placed, large = _divided(placed, dim, margin, PROBES_BELOW if copies else PROBES_BELOW_NEAREST, copies, block, threshold)
        large = None if large.isEmpty() else large
    return _blocks(placed, large, block)


def _sides(t: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = t.column("id").to_numpy()
    x = _matrix(t.column("v"), dim)
    home, query = (np.asarray(t.column(c).combine_chunks()) for c in ("home", "query"))
    return ids[home], x[home], ids[query], x[query]


def _chunks(n: int, size: int = 1024) -> Iterator[slice]:
    for s in range(0, n, size):
        yield slice(s, s + size)


def similar_pairs(
    df: DataFrame, key: str, vector: str, threshold: float, dim: int = 64, probes: int = PROBES, margin: float = MARGIN,
    exact: bool = False, fit_rows: int = FIT_ROWS, block: int = BLOCK,
) -> DataFrame:
    """(key_a, key_b, similarity), key_a < key_b: pairs of different keys with cosine of at least `threshold`.

    Vectors that are null, of another dimension, all zero or not finite take no part. A repeated row
    counts once; repeated vectors under other keys are partners like any others. An empty table gives no
    row. Other columns are not read. `exact` compares all vectors with all, in tiles.
    """
    base, total, members = _collapsed(df, key, vector, dim, None)
    placed = _tiles(base, total, dim, probes, margin, exact, fit_rows=fit_rows, block=block, threshold=threshold)

    def tile(t: pa.Table) -> pa.Table:
        ida, a, idb, b = _sides(t, dim)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for r in _chunks(len(ida)):
            for s in _chunks(len(idb)):
                product, error = bounds(a[r], b[s])
                i, j = np.nonzero(product + error >= threshold)
                i, j = i + r.start, j + s.start
                differ = ida[i] != idb[j]
                i, j = i[differ], j[differ]
                exact = np.einsum("ij,ij->i", a[i].astype(float), b[j].astype(float)) if len(i) else np.empty(0)
                keep = exact >= threshold
                out.append((ida[i[keep]], idb[j[keep]], exact[keep]))
        x, y, c = (np.concatenate(v) if out else np.empty(0) for v in (zip(*out) if out else ((), (), ())))
        return pa.table({"a": pa.array(np.minimum(x, y), pa.int64()), "b": pa.array(np.maximum(x, y), pa.int64()), "c": pa.array(c, pa.float64())})

    found = placed.groupBy("cell", "block").applyInArrow(tile, "a long, b long, c double").groupBy("a", "b").agg(F.max("c").alias("c"))
    if members is not None:
        m = members.select("rep", "id")
        for side in ("a", "b"):
            found = found.join(m.withColumnsRenamed({"rep": side, "id": "of"}), side, "left").withColumn(side, F.coalesce("of", side)).drop("of")
        found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "c")
        if threshold <= 1:
            x, y = m.alias("x"), m.alias("y")
            own = x.join(y, (F.col("x.rep") == F.col("y.rep")) & (F.col("x.id") < F.col("y.id")))
            found = found.unionAll(own.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.lit(1.0).alias("c")))
        found = found.groupBy("a", "b").agg(F.max("c").alias("c"))
    return found.select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b"), F.col("c").alias("similarity"))


def nearest(df: DataFrame, key: str, vector: str, k: int, dim: int = 64, probes: int | None = None, query: str | None = None, recall: float = 0.95, exact: bool = False) -> DataFrame:
    """(key, neighbour, similarity, position): the k most similar other vectors of each query vector.

    `query` is an SQL condition on `key` that picks the query rows (all by default); they are compared
    with all rows of the cells they visit: as many as the sample needs for this recall, or `probes`; `exact`
    compares them with all rows. A neighbour that is stored several times under one key counts once; ties
    follow the neighbour's key. Rows without a usable vector neither ask nor answer.
    """
    base, total, members = _collapsed(df, key, vector, dim, query)
    placed = _tiles(base, total, dim, probes, np.inf, exact, k, recall, copies=None)

    def tile(t: pa.Table) -> pa.Table:
        ida, a, idb, b = _sides(t, dim)
        q: list[int] = []
        n: list[int] = []
        c: list[float] = []
        for s in _chunks(len(idb)):
            heaps: list[list[tuple[float, int]]] = [[] for _ in range(len(idb[s]))]
            for r in _chunks(len(ida)):
                product, error = bounds(b[s], a[r])
                upper, lower = product + error, product - error
                m = min(k + 1, upper.shape[1])  # the vector itself may be among them
                floor = -np.partition(-lower, m - 1, axis=1)[:, m - 1]
                for i in range(len(upper)):
                    j = np.flatnonzero(upper[i] >= floor[i])
                    exact = a[r][j].astype(float) @ b[s.start + i].astype(float)
                    heap = heaps[i]
                    for sim, other in zip(exact.tolist(), ida[r][j].tolist()):
                        if other == idb[s.start + i]:
                            continue
                        entry = (sim, -other)
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
            for i, heap in enumerate(heaps):
                for sim, other in heap:
                    q.append(int(idb[s.start + i]))
                    n.append(-other)
                    c.append(sim)
        return pa.table({"q": pa.array(q, pa.int64()), "n": pa.array(n, pa.int64()), "c": pa.array(c, pa.float64())})

    found = placed.groupBy("cell", "block").applyInArrow(tile, "q long, n long, c double").groupBy("q", "n").agg(F.max("c").alias("c"))
    if members is not None:
        # Of a class of equal neighbours no more than k + 1 can come out.
        few = members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("r") <= k + 1).select("rep", "id")
        asking = members.filter("query").select("rep", "id")
        own = asking.join(few.withColumnRenamed("id", "n"), "rep").select(F.col("id").alias("q"), "n", F.lit(1.0).alias("c"))
        found = found.join(few.withColumnsRenamed({"rep": "n", "id": "of"}), "n", "left").withColumn("n", F.coalesce("of", "n")).drop("of")
        found = found.join(asking.withColumnsRenamed({"rep": "q", "id": "of"}), "q", "left").withColumn("q", F.coalesce("of", "q")).drop("of")
        found = found.select("q", "n", "c").unionAll(own).filter("q <> n").groupBy("q", "n").agg(F.max("c").alias("c"))
    w = Window.partitionBy("q").orderBy(F.col("c").desc(), F.col("n"))
    return (
        found.withColumn("position", F.row_number().over(w))
        .filter(F.col("position") <= k)
        .select(F.col("q").alias(key), F.col("n").alias("neighbour"), F.col("c").alias("similarity"), "position")
    )
