import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from millrace import workload
from millrace.session import Engine


def same(a, b):
    assert a[0] == b[0] and len(a) == len(b)
    for x, y in zip(a[1:], b[1:], strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or isinstance(u, float) and math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-6), (x, y)


@pytest.mark.parametrize("name", sorted(workload.QUERIES))
def test_against_sql(name, spark, duck, got, sf):
    same(got(workload.QUERIES[name](spark, sf("sf0.001"))), duck("sf0.001", workload.SQL[name]))


def test_entry(spark):
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(workload.QUERIES) <= set(entry.queries())


def test_sorted(spark, sf):
    keys = [(r.o_orderstatus, r.o_orderkey) for r in workload.sort_multi_key(spark, sf("sf0.001")).collect()]
    assert keys == sorted(keys)
    rows = [tuple(r) for r in workload.sorted_table_scan(spark, sf("sf0.001")).select("o_orderstatus", "o_orderkey").collect()]
    assert rows == sorted(rows)


COLUMNS = {"p_partkey": st.integers(-2, 210).map(str), "p_size": st.integers(0, 51).map(str), "p_retailprice": st.floats(890, 1010).map(lambda x: f"{x:.2f}"), "p_brand": st.sampled_from(["'Brand#1'", "'Brand#13'", "'Brand#5'", "'b'"])}
PLAIN = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@st.composite
def conjuncts(draw):
    def one():
        c = draw(st.sampled_from(sorted(COLUMNS)))
        other = draw(st.sampled_from(["p_size", "p_partkey"])) if c in ("p_size", "p_partkey") and draw(st.booleans()) else draw(COLUMNS[c])
        sides = [c, other] if draw(st.booleans()) else [other, c]
        return f"{sides[0]} {draw(st.sampled_from('<>='))} {sides[1]}"

    return [[one() for _ in range(draw(st.integers(1, 3)))] for _ in range(draw(st.integers(1, 3)))]


@PLAIN
@given(conjuncts())
def test_any_predicate(spark, duck, sf, cnf):
    where = " AND ".join("(" + " OR ".join(g) + ")" for g in cnf)
    mine = sorted(r[0] for r in Engine(spark).view_parquet(sf("sf0.001"), ["part"]).sql(f"SELECT p.p_partkey FROM part AS p WHERE {where}").collect())
    assert mine == sorted(r[0] for r in duck("sf0.001", f"SELECT p_partkey FROM part WHERE {where}")[1:])


def trees():
    leaf = st.sampled_from(["p_size", "p_retailprice", "p_partkey", "2", "3.5"])
    return st.recursive(leaf, lambda t: st.tuples(t, st.sampled_from("+-*"), t), max_leaves=6)


@PLAIN
@given(trees())
def test_any_arithmetic(spark, duck, sf, tree):
    show = lambda t: t if isinstance(t, str) else f"({show(t[0])}) {t[1]} ({show(t[2])})" if not isinstance(t[0], str) else f"{t[0]} {t[1]} ({show(t[2])})"
    sql = lambda t: f"CAST({t} AS DOUBLE)" if isinstance(t, str) else f"({sql(t[0])} {t[1]} {sql(t[2])})"
    mine = Engine(spark).view_parquet(sf("sf0.001"), ["part"]).sql(f"SELECT SUM ({show(tree)}) FROM part AS p WHERE (p_partkey < 20)").first()[0]
    theirs = duck("sf0.001", f"SELECT sum({sql(tree)}) AS s FROM part WHERE p_partkey < 20")[1][0]
    assert math.isclose(mine, theirs, rel_tol=1e-9, abs_tol=1e-5)
