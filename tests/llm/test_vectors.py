import math

import numpy as np
import pytest

from millrace.llm.components import components, least_of
from millrace.llm.knn_join import OP10_SQL, _needed, knn_join, op10_voronoi_knn
from millrace.llm.range_join import OP4_SQL, _axes, _linked, near_vectors, op4_near_vectors


@pytest.mark.parametrize("query, sql", [(op4_near_vectors, OP4_SQL), (op10_voronoi_knn, OP10_SQL)])
def test_against_sql(query, sql, spark, duck, got, sf):
    assert got(query(spark, sf("sf0.001"))) == duck("sf0.001", sql)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS x", "2 AS cell", "3 AS n", "4 AS score")


def plain_near(rows, least):
    good = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            good[i] = min(good.get(i, v), v)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))  # noqa: B905, E731
    links = {i: {j for j in good if j != i and cos(good[i], good[j]) >= least} for i in good}
    out = {}
    for i in {r[0] for r in rows} - {None}:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(links.get(i, ())), min(seen), min(seen) == i)
    return out


def test_near_in_small_cells_and_blocks(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 8))
    rows = [(i, (centre[i % 6] + rng.normal(size=8) * (0.1 if i % 3 else 1)).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(40)]  # copies
    rows += [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [1.0, None] * 4), (304, [float("inf")] * 8), (305, []), (306, rows[1][1][:5]), (None, rows[0][1]), (7, rows[7][1])]
    want = plain_near(rows, 0.9)
    for cells, blocks in ((4096, 4096), (20, 8), (7, 3)):
        got = near_vectors(frame(spark, rows), 0.9, cell_rows=cells, block_rows=blocks).collect()
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want and len(got) == len(want)


def test_near_of_nothing(spark):
    assert near_vectors(frame(spark, [])).count() == 0
    assert [tuple(r) for r in near_vectors(frame(spark, [(1, None), (2, [0.0])])).orderBy("vec_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]


def plain_knn(rows, k, every, scale):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            good[i] = min(good.get(i, v), v)
    whole = {i: [math.floor(scale * c) for c in v] for i, v in good.items()}
    out = []
    for q in whole:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], x)), i) for i, x in whole.items() if i != q)[:k]  # noqa: B905
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_knn_in_small_cells_and_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, np.round(rng.normal(size=4), 1).tolist()) for i in range(120)]
    rows += [(200 + i, rows[5][1]) for i in range(60)]  # ties
    rows += [(300, None), (320, [float("nan")] * 4), (340, [1.0, None, 1.0, 1.0]), (360, [1.0, 2.0]), (380, []), (None, [1.0] * 4), (20, rows[20][1]), (400, [1e6, -1e6, 1e5, 3.0])]
    for scale in (64, 2**28):  # the second leaves the range in which doubles are exact
        want = plain_knn(rows, 7, 20, scale)
        for cells, queries, blocks in ((4096, 1024, 8192), (15, 2, 10)):
            got = knn_join(frame(spark, rows if scale == 64 else rows[:150]), 7, 20, scale, cell_rows=cells, query_rows=queries, block_rows=blocks)
            assert sorted(tuple(r) for r in got.collect()) == (want if scale == 64 else plain_knn(rows[:150], 7, 20, scale))


def test_scores_beyond_64_bits_are_an_error(spark):
    for large in (1e12, 1e18, 1e300, -1e300):
        with pytest.raises(ArithmeticError):
            knn_join(frame(spark, [(0, [large, 1.0]), (1, [0.5, large])]))
    big = 30_000_000.0  # beyond what doubles add up exactly
    rows = [(0, [big, 0.015625]), (1, [big, 0.03125]), (2, [big, 0.046875])]
    assert sorted(map(tuple, knn_join(frame(spark, rows)).collect())) == plain_knn(rows, 20, 20, 64)


def test_pairs_are_told_apart_along_few_axes():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 64))
    x[700:900] = x[:200] + rng.normal(size=(200, 64)) * 0.2
    x /= np.linalg.norm(x, axis=1)[:, None]
    axes = _axes(x[:300])
    want = x @ x.T >= 0.9
    np.fill_diagonal(want, False)
    hits, full = _linked(x, x, 0.9, True, axes)
    got = np.zeros_like(want)
    for i, j, bits in hits:
        got[i, j] = np.unpackbits(bits, axis=1, count=j.stop - j.start).astype(bool)
    assert want.sum() > 300 and (np.triu(got) == np.triu(want)).all() and full < 0.1 * len(x) ** 2 / 2
    assert _axes(rng.normal(size=(40, 8))).shape == (8, 0)


def test_knn_of_few(spark):
    assert knn_join(frame(spark, [])).count() == 0
    assert knn_join(frame(spark, [(0, [1.0])])).count() == 0
    assert [tuple(r) for r in knn_join(frame(spark, [(0, [1.0]), (1, [0.5])])).collect()] == [(0, 1, 1, 64 * 32)]


def test_bounds_leave_out_far_cells():
    spots = np.array([[100.0, 0], [0, 100.0], [-100.0, 0]])
    assert _needed(spots, {0: (50, 1.0), 1: (50, 1.0), 2: (50, 1.0)}, {0: (3, 1.0)}, 20) == [(0, 0)]
    assert len(_needed(spots, {0: (5, 1.0), 1: (50, 1.0), 2: (50, 1.0)}, {0: (3, 1.0)}, 20)) == 2


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3), (60, 0)] + [(200, 201 + i) for i in range(300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in [*range(51), 60]) and all(got[i] == 100 for i in (100, 101, 102)) and all(got[200 + i] == 200 for i in range(301))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_hub_is_split_where_it_meets_its_minimum(spark):
    """Found in the plan that ran: the components are the same with and without."""
    own = {"spark.sql.shuffle.partitions": "20", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k"}
    was = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        links = spark.range(0, 40000, 1, 40).selectExpr("if(id % 2 = 0, 7L, id) AS u", "id + 1 AS v")
        both = links.join(least_of(links), "u")
        got = {(r.u, r.v): r.m for r in both.collect()}
        plan = both._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == {(7 if i % 2 == 0 or i == 7 else i, i + 1): 1 if i % 2 == 0 or i == 7 else i + 1 for i in range(40000)}
    assert "SortMergeJoin(skew=true)" in plan
