"""Nearest neighbours over inverted lists with an adaptive scan of dimensions.

Vectors are rotated at random and read in blocks of columns. Within a probed list, after each block
a hypothesis test on the partial distance (Gao and Long, 2023) drops candidates that are too far;
the rest get their exact distance on the original vectors. A query visits its nearest list first; the
k-th distance found there is its bound in the other lists, and falls while a list is read. How many lists
a query probes comes from measured recall: a bounded sample of queries is compared with every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed


def _valid(column: str = "embedding"):
    e = F.col(column)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _centroids(sample: np.ndarray, n_lists: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means on the sample, begun from distinct rows."""
    rng = np.random.default_rng(seed)
    rows = np.unique(sample, axis=0)
    centers = rows[rng.permutation(len(rows))[:n_lists]]
    for _ in range(rounds):
        near = _nearest_lists(rows, centers, 1)[:, 0]
        counts = np.bincount(near, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, near, rows)
        held = counts > 0
        centers[held] = sums[held] / counts[held][:, None]
    return centers


def _nearest_lists(x: np.ndarray, centers: np.ndarray, k: int) -> np.ndarray:
    d = (centers * centers).sum(1)[None, :] - 2 * x @ centers.T
    k = min(k, len(centers))
    part = np.argpartition(d, k - 1, axis=1)[:, :k]
    return np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1)


def _merged(best_d: np.ndarray, best_i: np.ndarray, at: np.ndarray, ids: np.ndarray, far: np.ndarray) -> None:
    """Takes candidates (row of the tables, id, squared distance) into the k best of each row, in place; ties go to the smaller id, equal candidates count once."""
    n, k = best_d.shape
    at, ids, far = np.concatenate([np.repeat(np.arange(n), k), at]), np.concatenate([best_i.ravel(), ids]), np.concatenate([best_d.ravel(), far])
    order = np.lexsort((ids, far, at))
    at, ids, far = at[order], ids[order], far[order]
    again = np.zeros(len(at), bool)
    again[1:] = (at[1:] == at[:-1]) & (ids[1:] == ids[:-1]) & (far[1:] == far[:-1]) & np.isfinite(far[1:])
    at, ids, far = at[~again], ids[~again], far[~again]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    held = rank < k
    best_d.fill(np.inf)
    best_d[at[held], rank[held]], best_i[at[held], rank[held]] = far[held], ids[held]


_QUERIES, _ROWS, _PAIRS = 256, 2_048, 1 << 16  # of one step of a scan


def _scan(q: np.ndarray, q_ids: np.ndarray, bounds: np.ndarray, x: np.ndarray, x_ids: np.ndarray, rotation: np.ndarray, k: int, column_block: int, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, distance) of each query's k nearest rows of x other than itself, as far as they lie within its bound.

    Partial distances of a step are computed for all its pairs while more than a quarter of them
    are left, and for the pairs that are left afterwards.
    """
    dims = x.shape[1]
    rx, rq = x @ rotation, q @ rotation
    slack = 1e-9 * ((q * q).sum(1) + (x * x).sum(1).max())
    best_d, best_i = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    cuts = [(low, min(dims, low + column_block)) for low in range(0, dims, column_block)]
    for a in range(0, len(q), _QUERIES):
        own = slice(a, a + _QUERIES)
        bound = bounds[own] ** 2
        for b in range(0, len(x), _ROWS):
            part = slice(b, b + _ROWS)
            alive = x_ids[part][None, :] != q_ids[own][:, None]
            partial, step = np.zeros(alive.shape), 0
            while step < len(cuts):
                low, high = cuts[step]
                u, v = rq[own, low:high], rx[part, low:high]
                partial += (u * u).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * u @ v.T
                step += 1
                # "Within the bound" is rejected if the scaled partial distance lies epsilon / sqrt(high) beyond it.
                alive &= partial * (dims / high) <= (bound * (1 + epsilon / np.sqrt(high)) ** 2 + slack[own])[:, None]
                if alive.mean() < 0.25:
                    break
            if step == len(cuts):
                # No row beyond the step's own k-th distance can be among the k nearest.
                seen = np.where(alive, partial, np.inf)
                last = np.partition(seen, k - 1, axis=1)[:, k - 1] if seen.shape[1] > k else np.full(len(seen), np.inf)
                alive &= partial <= (np.minimum(bound, last) + slack[own])[:, None]
            i, j = np.nonzero(alive)
            left = partial[i, j]
            for at in range(0, len(i), _PAIRS):
                mine, row, seen = i[at : at + _PAIRS], j[at : at + _PAIRS] + b, left[at : at + _PAIRS]
                for low, high in cuts[step:]:
                    seen = seen + ((rx[row, low:high] - rq[mine + a, low:high]) ** 2).sum(1)
                    stay = seen * (dims / high) <= bound[mine] * (1 + (epsilon / np.sqrt(high) if high < dims else 0)) ** 2 + slack[mine + a]
                    mine, row, seen = mine[stay], row[stay], seen[stay]
                _merged(best_d[own], best_i[own], mine, x_ids[row], ((x[row] - q[mine + a]) ** 2).sum(1))
            bound = np.minimum(bound, best_d[own][:, -1])
    held = np.isfinite(best_d)
    return np.repeat(q_ids, k)[held.ravel()], best_i[held], np.sqrt(best_d[held])


def _needed_probes(placed: DataFrame, asked: DataFrame, centers: np.ndarray, k: int, recall: float, n_queries: int) -> int:
    """The fewest lists with which n_queries queries, the first by a hash of vec_id, find `recall` of their k nearest rows on average.

    Every row is compared with them; the driver gets k rows a query.
    """
    sample = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_queries).toPandas()
    if not len(sample):
        return 1
    ids, q = sample["vec_id"].to_numpy(), np.array(sample["embedding"].tolist(), np.float64)
    shared = asked.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        n = len(q)
        best_d, best_i, home = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, x_ids = _matrix(batch.column("embedding")), batch.column("vec_id").to_numpy()
            for b in range(0, len(x), _ROWS):
                part = slice(b, b + _ROWS)
                far = ((q * q).sum(1)[:, None] + (x[part] * x[part]).sum(1)[None, :] - 2 * q @ x[part].T).clip(0)
                i, j = np.nonzero((far <= best_d[:, -1:]) & (x_ids[part][None, :] != ids[:, None]))
                _merged(best_d, best_i, i, x_ids[part][j], far[i, j])
            best = np.unique(best_i)
            held = np.isin(x_ids, best)
            home |= zip(x_ids[held].tolist(), batch.column("list").to_numpy()[held].tolist(), strict=True)
        held = np.isfinite(best_d)
        found = best_i[held]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)[held.ravel()]), pa.array(found), pa.array([home[v] for v in found.tolist()], pa.int32()), pa.array(best_d[held])], names=["query_id", "vec_id", "list", "far"])

    best = Window.partitionBy("query_id").orderBy("far", "vec_id")
    near = placed.mapInArrow(run, "query_id long, vec_id long, list int, far double").distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).collect()
    if not near:
        return 1
    order = {i: np.argsort(row, kind="stable").tolist() for i, row in zip(ids.tolist(), (centers * centers).sum(1)[None, :] - 2 * q @ centers.T, strict=True)}
    at = np.array([order[r["query_id"]].index(r["list"]) for r in near])
    share = np.cumsum(np.bincount(at, minlength=len(centers))) / len(at)
    return int(np.searchsorted(share, recall)) + 1


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, n_lists: int | None = None, n_probe: int | None = None, recall: float = 0.96, recall_queries: int = 100,
    max_sample: int = 20_000, block_rows: int | None = None, query_rows: int = 10_000, column_block: int = 16, epsilon: float = 2.1, seed: int = 7,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of the k nearest found for every query.

    vectors and queries have vec_id and embedding. n_lists is the square root of the number of rows if
    not given, 1,024 at most; the lists are fitted on at most max_sample rows, the first by a
    hash of vec_id, and every row is placed in its list. n_probe is, if not given, the number of lists with
    which recall_queries queries reach `recall` against all rows. A query scans its nearest list first and
    then the others within the k-th distance found there. A list is read in blocks of about block_rows
    rows (by default a 200th of all rows, from 256 to 20,000) and query_rows queries, each a group of its own, so a
    list that holds a third of all rows is many tasks; queries travel to the blocks, and a row is repeated only once for query_rows queries. Ties go
    to the smaller vec_id; a query does not meet rows of its own vec_id. Rows that repeat vec_id
    and vector count once; rows that repeat a vec_id with another vector are candidates of their own, and
    as queries they share one answer, the k nearest to any of them. Vectors that are null, empty, zero, of
    another length than most, or hold null or non-finite components take no part; a query
    with none to meet gives no rows, nor does an empty table; other columns are ignored.
    """
    spark = vectors.sparkSession
    cast = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(_valid() & F.col("vec_id").isNotNull())
    usual = cast(vectors).groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if usual is None:
        return spark.createDataFrame([], schema)
    dims = usual["dims"]
    rows = cast(vectors).where(F.size("embedding") == dims)
    asked = cast(queries).where(F.size("embedding") == dims)
    if n_lists is None:
        n_lists = min(1_024, max(1, round(usual["count"] ** 0.5)))
    if block_rows is None:
        block_rows = min(20_000, max(256, usual["count"] // 200))
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_sample).toPandas()
    centers = _centroids(np.array(picked["embedding"].tolist(), np.float64), n_lists, seed)
    shared = spark.sparkContext.broadcast(centers)
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))[0]

    def place(probes: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    lists = _nearest_lists(_matrix(batch.column("embedding")), shared.value, probes)
                    own = np.repeat(np.arange(batch.num_rows), lists.shape[1])
                    visit = np.tile(np.arange(lists.shape[1], dtype=np.int32), batch.num_rows)
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(own)) for c in batch.columns), pa.array(lists.ravel().astype(np.int32)), pa.array(visit)], names=[*batch.schema.names, "list", "visit"])

        return run

    wide = lambda df: df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    kind = "vec_id long, embedding array<double>, list int, visit int"
    placed = checkpointed(wide(rows).mapInArrow(place(1), kind).drop("visit"))
    if n_probe is None:
        n_probe = _needed_probes(placed, wide(asked), centers, k, recall, recall_queries)
    probing = checkpointed(wide(asked).mapInArrow(place(n_probe), kind))

    def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        q, x, d = [], [], []
        if len(mine) and len(theirs):
            q, x, d = _scan(_matrix(theirs.column("embedding")), theirs.column("vec_id").to_numpy(), theirs.column("bound").to_numpy(), _matrix(mine.column("embedding")), mine.column("vec_id").to_numpy(), rotation, k, column_block, epsilon)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(x, pa.int64()), "score": pa.array(d, pa.float64())})

    counts = placed.groupBy("list").agg(F.count("*").alias("n"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def visited(probes: DataFrame) -> DataFrame:
        # Blocks of each list, from its size: at most one row a list.
        sizes = counts.join(probes.groupBy("list").agg(F.count("*").alias("m")), "list")
        blocks = F.broadcast(sizes.select("list", F.ceil(F.col("n") / block_rows).cast("int").alias("nb"), F.ceil(F.col("m") / query_rows).cast("int").alias("mb")))
        left = placed.join(blocks, "list").withColumn("x", F.pmod(F.xxhash64("vec_id"), F.col("nb")).cast("int")).select("list", "x", each("mb").alias("y"), "vec_id", "embedding")
        right = probes.join(blocks, "list").withColumn("y", F.pmod(F.xxhash64("vec_id"), F.col("mb")).cast("int")).select("list", each("nb").alias("x"), "y", "vec_id", "embedding", "bound")
        return checkpointed(left.groupBy("list", "x", "y").cogroup(right.groupBy("list", "x", "y")).applyInArrow(meet, "query_id long, vec_id long, score double"))

    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = lambda df: df.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    first = visited(probing.where("visit = 0").withColumn("bound", F.lit(float("inf"))))
    bounds = ranked(first).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    rest = probing.where("visit > 0").join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    found = first.union(visited(rest)) if n_probe > 1 else first
    return ranked(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
