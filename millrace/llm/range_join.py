"""Near copies among embeddings: an exact metric range join over pivots, then components of its links."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, stash, table
from .components import components
from .vectors import matrix, pack, pivots, sample, tiles, unpack, usable

TILE = 1024
SAMPLE = 1024  # vectors among which pivots are chosen and whose axes tell most pairs apart
AXES = 24


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first, so that no square leaves the range of doubles
    return x / np.sqrt((x * x).sum(1))[:, None]


def _axes(seen: np.ndarray) -> np.ndarray:
    """The AXES directions in which these vectors differ most, as columns; none where vectors hardly have more."""
    width = seen.shape[1]
    return np.linalg.svd(seen, full_matrices=True)[2][:AXES].T if width >= 2 * AXES else np.empty((width, 0))


def _short(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors along the axes and, in a further column, how long the rest of each is."""
    z = x @ axes
    return np.c_[z, np.sqrt(np.maximum(0, 1 - (z * z).sum(1)))].astype("f4")


def _linked(a: np.ndarray, b: np.ndarray, least: float, same: bool, axes: np.ndarray) -> tuple[list[tuple[slice, slice, np.ndarray]], int]:
    """Which rows of a and b have that cosine, tile by tile, as packed bits, and how many pairs were compared in full.

    A pair's cosine is at most its part along the axes and the product of what is left of
    both (Cauchy-Schwarz). Pairs below the least cosine by that are done; the 1e-4 is far beyond
    what single precision loses. The others, and tiles with many of them, are compared in full
    in double precision. Of a block with itself, tiles below the diagonal are left out.
    """
    out, full = [], 0
    short_a, short_b = _short(a, axes), _short(b, axes)
    for i in tiles(len(a), TILE):
        for j in tiles(len(b), TILE):
            if same and j.start < i.start:
                continue
            rows = None
            if axes.shape[1]:
                rows, cols = np.divmod(np.flatnonzero(short_a[i] @ short_b[j].T >= np.float32(least - 1e-4)), j.stop - j.start)
            if rows is None or len(rows) > (i.stop - i.start) * (j.stop - j.start) / 8:
                full += (i.stop - i.start) * (j.stop - j.start)
                hit = a[i] @ b[j].T >= least
            else:
                full += len(rows)
                hit = np.zeros((i.stop - i.start, j.stop - j.start), bool)
                if len(rows):
                    hit[rows, cols] = np.einsum("ij,ij->i", a[i][rows], b[j][cols]) >= least
            if same and i == j:
                np.fill_diagonal(hit, False)
            if hit.any():
                out.append((i, j, np.packbits(hit, axis=1)))
    return out, full


def _block(ids_a, a, count_a, ids_b, b, count_b, least: float, same: bool, axes: np.ndarray):
    """(id, links, root) of each row of the block pair that has a link in it; root: the smallest id linked to it within the pair.

    Roots settle by passing minima along links, on the bits of at most 16384 x 16384 pairs:
    a block of copies yields a row for each copy and not for each pair.
    """
    hits, _ = _linked(a, b, least, same, axes)
    if not hits:
        return [], [], []
    n_a, n_b = np.zeros(len(a), "i8"), np.zeros(len(b), "i8")
    root_a, root_b = ids_a.copy(), ids_b.copy()
    no = np.iinfo("i8").max
    for turn in range(len(a) + len(b)):
        before = root_a.sum() + root_b.sum()
        for i, j, bits in hits:
            hit = np.unpackbits(bits, axis=1, count=j.stop - j.start).astype(bool)
            if not turn:
                n_a[i] += hit @ count_b[j]
                if not (same and i == j):
                    n_b[j] += count_a[i] @ hit
            rows, cols = hit.any(1), hit.any(0)
            some = hit[np.ix_(rows, cols)]
            root_a[i][rows] = np.minimum(root_a[i][rows], np.where(some, root_b[j][cols], no).min(1))
            root_b[j][cols] = np.minimum(root_b[j][cols], np.where(some.T, root_a[i][rows], no).min(1))
        if same:
            root_a = root_b = np.minimum(root_a, root_b)
        if before == root_a.sum() + root_b.sum():
            break
    if same:
        n_a += n_b
        keep = n_a > 0
        return ids_a[keep], n_a[keep], root_a[keep]
    ka, kb = n_a > 0, n_b > 0
    return np.r_[ids_a[ka], ids_b[kb]], np.r_[n_a[ka], n_b[kb]], np.r_[root_a[ka], root_b[kb]]


def near_vectors(
    vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding",
    cell_rows: int = 16384, most_cells: int = 256, block_rows: int = 16384,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every id: the other vectors with at least that cosine, and the smallest id reachable.

    Equal vectors are first folded into one with a count. Pivots partition the rest by
    angle, which is a metric; a summary holds each cell's least and greatest angle to each
    pivot. A vector is sent to another cell only if, for every pivot, its angle lies within
    the range of that cell widened by the angle of the link: by the triangle inequality no
    other cell can hold a vector linked with it. Of two cells, the earlier gets the rows, so
    each pair meets once. Cells join on their own, in pairs of blocks of about ``block_rows``
    rows, and yield one row a vector, not a row a pair; the links of those rows then give
    components. A pair of blocks is the unit of work, so a cell with a third of all vectors
    spreads over many tasks. Within it, the few axes along which a sample of vectors differs
    most rule out most pairs without comparing them in full (_linked).

    Nulls: vectors that are null, all zero, empty or hold a null or non-finite component link
    with nothing; rows without an id are left out. A repeated id counts once, with its least
    usable vector. Vectors of unequal length compare as if the shorter ended in zeros. An
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id")).where("vec_id IS NOT NULL").distinct()
    kind_in = dict(vectors.dtypes)[vector_col]
    kind = "<f4" if kind_in == "array<float>" else "<f8"
    rows = stash(usable(vectors, id_col, vector_col, nonzero=True), "near-rows")
    folded = cut(rows.groupBy("x").agg(F.min("vec_id").alias("head"), F.count("*").alias("n")))
    n, width = folded.agg(F.count("*"), F.max(F.size("x"))).first()
    width = max(1, width or 0)
    heads = folded.select(F.col("head").alias("vec_id"), "n", "x")
    seen = _unit(sample(heads, SAMPLE, width)) if n else np.zeros((1, width))
    spots, axes = pivots(seen, max(1, min(most_cells, math.ceil(n / cell_rows)))), _axes(seen)
    reach = math.acos(min(1.0, cosine)) + 1e-6

    def settle(batches):
        for b in batches:
            x = matrix(b.column("x"), width)
            if len(x):
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("n"), pa.array(_angles(_unit(x), spots).argmin(1).astype("i4")), pack(x.astype(kind))], ["vec_id", "n", "cell", "x"])

    placed = stash(heads.mapInArrow(settle, "vec_id long, n long, cell int, x binary"), "near-cells")

    def ranges(batches):
        low, high = {}, {}
        for b in batches:
            at, cell = _angles(_unit(unpack(b.column("x").to_pylist(), width, kind).astype("f8")), spots), b.column("cell").to_numpy()
            for c in np.unique(cell):
                own = at[cell == c]
                low[c] = np.minimum(low.get(c, math.inf), own.min(0))
                high[c] = np.maximum(high.get(c, -math.inf), own.max(0))
        for c in low:
            yield pa.RecordBatch.from_arrays([pa.array([int(c)] * len(spots), pa.int32()), pa.array(range(len(spots)), pa.int32()), pa.array(low[c]), pa.array(high[c])], ["cell", "pivot", "low", "high"])

    # most_cells squared rows at most
    told = placed.select("cell", "x").mapInArrow(ranges, "cell int, pivot int, low double, high double").groupBy("cell", "pivot").agg(F.min("low"), F.max("high")).collect()
    low, high = np.full((len(spots), len(spots)), math.inf), np.full((len(spots), len(spots)), -math.inf)
    for c, p, a, z in told:
        low[c, p], high[c, p] = a - reach, z + reach

    def replicate(batches):
        for b in batches:
            home = b.column("cell").to_numpy()
            at = _angles(_unit(unpack(b.column("x").to_pylist(), width, kind).astype("f8")), spots)
            for c in range(len(spots)):
                go = np.flatnonzero((home > c) & (at >= low[c]).all(1) & (at <= high[c]).all(1))
                if len(go):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(go), c, "i4")), pa.array(np.full(len(go), False)), *(b.column(k).take(pa.array(go)) for k in ("vec_id", "n", "x"))], ["cell", "home", "vec_id", "n", "x"])

    guests = placed.mapInArrow(replicate, "cell int, home boolean, vec_id long, n long, x binary")
    met = stash(placed.select("cell", F.lit(True).alias("home"), "vec_id", "n", "x").unionByName(guests), "near-met")
    held = {r.cell: (r.a, r.b) for r in met.groupBy("cell").agg(F.count_if("home").alias("a"), F.count_if(~F.col("home")).alias("b")).collect()}
    blocks = [(c, max(1, math.ceil(a / block_rows)), math.ceil(b / block_rows)) for c, (a, b) in held.items()]
    plan = F.broadcast(spark.createDataFrame(blocks, "cell int, hs int, gs int"))  # most_cells rows at most
    own = F.pmod(F.xxhash64("vec_id"), F.when(F.col("home"), F.col("hs")).otherwise(F.col("gs"))).cast("int")
    # home block h meets the home blocks from h on and every guest block; kind 0: within one block, 1: two home blocks, 2: with guests
    pair = lambda i, j, kind, left: F.struct(i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"), F.lit(left).alias("a"))
    o, none = F.col("o"), F.array().cast("array<struct<i:int,j:int,kind:int,a:boolean>>")
    upto = lambda a, z, f: F.when(z >= a, F.transform(F.sequence(a, z), f)).otherwise(none)
    home = F.concat(
        F.array(pair(o, o, 0, True)),
        upto(o + 1, F.col("hs") - 1, lambda j: pair(o, j, 1, True)),
        upto(F.lit(0), o - 1, lambda i: pair(i, o, 1, False)),
        upto(F.lit(0), F.col("gs") - 1, lambda j: pair(o, j, 2, True)),
    )
    guest = upto(F.lit(0), F.col("hs") - 1, lambda i: pair(i, o, 2, False))
    sent = met.join(plan, "cell").withColumn("o", own).withColumn("to", F.explode(F.when(F.col("home"), home).otherwise(guest))).select("cell", "to.*", "vec_id", "n", "x")

    def solve(group: pa.Table) -> pa.Table:
        left = group.column("a").to_numpy(zero_copy_only=False).astype(bool)
        ids, n = group.column("vec_id").to_numpy(), group.column("n").to_numpy()
        x = _unit(unpack(group.column("x").to_pylist(), width, kind).astype("f8")) if len(ids) else np.empty((0, width))
        same = not group.column("kind")[0].as_py()
        right = left if same else ~left
        got = _block(ids[left], x[left], n[left], ids[right], x[right], n[right], cosine, same, axes)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("vec_id", "links", "root"), got, strict=True)})

    found = cut(sent.groupBy("cell", "i", "j", "kind").applyInArrow(solve, "vec_id long, links long, root long"))
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v")))
    of_head = folded.select("head", "n").join(links.withColumnRenamed("vec_id", "head"), "head", "left").join(parts.withColumnRenamed("node", "head"), "head", "left")
    of_head = of_head.select("head", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "head").alias("component_id"))
    member = rows.join(folded.where("n > 1").select("x", "head"), "x", "left").select("vec_id", F.coalesce("head", "vec_id").alias("head"))
    of_vec = member.join(of_head, "head").select("vec_id", "n_links", "component_id")
    out = every.join(of_vec, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
), u AS (
  SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda a: a * a))) AS size FROM v
  WHERE x IS NOT NULL AND len(list_filter(x, lambda a: a IS NULL OR NOT isfinite(a))) = 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.size > 0 AND b.size > 0
  WHERE list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) / (a.size * b.size) >= 0.9
), r AS (
  SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT v.vec_id, coalesce(max(n.n), 0) AS n_links, min(r.c) AS component_id, v.vec_id = min(r.c) AS kept
FROM v JOIN r ON r.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id GROUP BY v.vec_id
"""
