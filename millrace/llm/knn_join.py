"""Exact top-k search as a Voronoi kNN join (Lu et al., 2012), by inner product of whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table
from .vectors import matrix, pack, pivots, sample, tiles, unpack, usable

SAMPLE = 1024  # vectors among which pivots are chosen


def _needed(spots: np.ndarray, data: dict, asks: dict, k: int) -> list[tuple[int, int]]:
    """Pairs (query cell, data cell) that may hold one of a query's k best, from the cells' counts and radii alone.

    For q within rho of u and x within r of p, q.x lies within rho|p| + r|u| + rho r of
    u.p. The cells with the highest lower bounds that hold k candidates give the score
    that each of the k best reaches; cells whose upper bound stays below it are not needed.
    """
    size = np.linalg.norm(spots, axis=1)
    cells = sorted(data)
    n, r = np.array([data[c][0] for c in cells]), np.array([data[c][1] for c in cells])
    out = []
    for i, (_, rho) in sorted(asks.items()):
        mid = spots[cells] @ spots[i]
        slack = (rho * size[cells] + r * size[i] + rho * r) * (1 + 1e-9) + 1e-6
        by = np.argsort(-(mid - slack), kind="stable")
        enough = np.searchsorted(np.cumsum(n[by]), k + 1)  # one more, as a query is no candidate of its own
        floor = (mid - slack)[by[enough]] if enough < len(by) else -math.inf
        out += [(int(i), int(cells[j])) for j in np.flatnonzero(mid + slack >= floor)]
    return out


def _best(q_ids, q, x_ids, x, k: int, exact: bool):
    """Rows (query, candidate, score) of each query's k highest scores, ties to smaller ids."""
    order = np.argsort(x_ids, kind="stable")
    x_ids, x = x_ids[order], x[order]
    kind = "f8" if exact else object
    q, x = q.astype("i8").astype(kind), x.astype("i8").astype(kind)
    for rows in tiles(len(q), 512):
        score = q[rows] @ x.T
        for one, s in zip(q_ids[rows], score, strict=True):
            s = np.array(s)
            at = np.flatnonzero(x_ids != one)
            s = s[at]
            if len(s) > k:
                least = np.partition(s.astype("f8") if exact else s, len(s) - k)[len(s) - k]
                keep = np.flatnonzero(s >= least)
                at, s = at[keep], s[keep]
            by = np.argsort(-s, kind="stable")[:k]  # ids ascend, so ties keep their order
            yield from zip([int(one)] * len(by), x_ids[at[by]].tolist(), [int(v) for v in s[by]], strict=True)


def knn_join(
    vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding",
    cell_rows: int = 16384, most_cells: int = 256, query_rows: int = 1024, block_rows: int = 16384,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, its k best of all other rows.

    A component x counts as floor(scale * x); the score is the inner product of these
    whole numbers. Pivots group queries and data; counts and radii of the groups bound
    every score between two groups (_needed); a group's rows are sent only to the query
    groups that may need them, in blocks of about ``block_rows`` rows against about
    ``query_rows`` queries, so no task holds a whole group however large it is. Each
    block yields its k best a query, and a window keeps the best k of those.

    Nulls: vectors that are null or hold a null or non-finite component, and rows without
    an id, take no part. A repeated id counts once, with its least vector. Vectors of
    unequal length compare as if the shorter ended in zeros; empty ones score 0. Ties go to
    the smaller id. Fewer than k other rows: all of them. An empty table gives no rows.
    Scores are exact up to 64 bits; if the largest component says that one might not fit,
    ArithmeticError is raised before any is computed.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col, nonzero=False)
    whole = lambda v: F.when(F.abs(v) < 2**52, F.floor(v).cast("double")).otherwise(v)  # noqa: E731  larger doubles are whole numbers
    rows = stash(rows.select("vec_id", F.transform("x", lambda v: whole(v * scale)).alias("x")), "knn-rows")
    n, width, top = rows.agg(F.count("*"), F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    width, top = max(1, width or 0), top or 0
    if width * top * top >= 2**63:
        raise ArithmeticError(f"{width} components of up to {top:g} may give scores that no 64-bit number holds")
    exact = width * top * top < 2**53  # then doubles hold every sum, and products of matrices are exact
    kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<i8"
    spots = pivots(sample(rows, SAMPLE, width), max(1, min(most_cells, math.ceil(n / cell_rows)))) if n else np.zeros((1, width))

    def settle(batches):
        square = (spots**2).sum(1)
        for b in batches:
            x = matrix(b.column("x"), width)
            if len(x):
                far = np.maximum(square - 2 * (x @ spots.T) + (x**2).sum(1)[:, None], 0)
                cell = far.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cell.astype("i4")), pa.array(np.sqrt(((x - spots[cell]) ** 2).sum(1))), pack(x.astype(kind))], ["vec_id", "cell", "far", "x"])

    placed = stash(rows.mapInArrow(settle, "vec_id long, cell int, far double, x binary"), "knn-cells")
    asking = F.col("vec_id") % every == 0
    told = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r"), F.count_if(asking).alias("q"), F.max(F.when(asking, F.col("far"))).alias("rho")).collect()
    asks = {t.cell: (t.q, t.rho) for t in told if t.q}
    data = {t.cell: (t.n, t.r) for t in told}
    pairs = _needed(spots, data, asks, k)
    held = {i: sum(data[j][0] for a, j in pairs if a == i) for i in asks}
    shape = [(i, max(1, math.ceil(asks[i][0] / query_rows)), max(1, math.ceil(held[i] / block_rows))) for i in asks]
    # at most most_cells squared pairs, whatever the input's size
    plan = F.broadcast(spark.createDataFrame([(i, j, *s[1:]) for i, j in pairs for s in shape if s[0] == i], "goal int, cell int, qs int, ds int"))
    own = F.broadcast(spark.createDataFrame(shape, "cell int, qs int, ds int"))
    part = lambda count: F.pmod(F.xxhash64("vec_id"), F.col(count)).cast("int")
    every_of = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    sent = placed.join(plan, "cell").withColumn("d", part("ds")).withColumn("q", every_of("qs")).select("goal", "q", "d", F.lit(False).alias("asks"), "vec_id", "x")
    asked = placed.where(asking).join(own, "cell").withColumn("q", part("qs")).withColumn("d", every_of("ds")).select(F.col("cell").alias("goal"), "q", "d", F.lit(True).alias("asks"), "vec_id", "x")

    def solve(group: pa.Table) -> pa.Table:
        is_q = group.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids = group.column("vec_id").to_numpy()
        x = unpack(group.column("x").to_pylist(), width, kind)
        found = list(_best(ids[is_q], x[is_q], ids[~is_q], x[~is_q], k, exact))
        return pa.table({c: pa.array([f[i] for f in found], pa.int64()) for i, c in enumerate(("query_id", "vec_id", "score"))})

    found = sent.union(asked).groupBy("goal", "q", "d").applyInArrow(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_join(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.x, d.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""
