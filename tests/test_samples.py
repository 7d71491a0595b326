"""Predicates and queries like those that engines of this kind are shown with, as far as the tables have their columns."""

import pytest

from millrace.operators import relational as ops
from millrace.session import Engine

SCANS = {
    "region_by_name": ("region", "(r_name = 'EUROPE')"),
    "region_two_sides": ("region", "(r_name < 'MIDDLE EAST') AND (r_regionkey > 1)"),
    "nation_three": ("nation", "(n_regionkey = 3) AND (n_nationkey > 10) AND (n_name > 'JAPAN')"),
    "supplier_below": ("supplier", "(s_suppkey < 10)"),
    "supplier_double": ("supplier", "(s_nationkey = 18) AND (s_acctbal > 1000.0) AND (s_suppkey < 400)"),
    "customer_range": ("customer", "(c_nationkey = 23) AND (c_mktsegment = 'FURNITURE') AND (c_acctbal > 3023.99) AND (c_acctbal < 7110.83)"),
    "part_five": ("part", "(p_brand = 'Brand#13') AND (p_retailprice > 500.0) AND (p_retailprice < 930.0) AND (p_size > 28) AND (p_size < 1000000)"),
    "orders_urgent": ("orders", "(o_orderpriority = '1-URGENT') AND (o_orderstatus = 'O') AND (o_totalprice > 1015.68) AND (o_totalprice < 91051.89)"),
    "lineitem_dates": ("lineitem", "(l_shipdate > '1996-01-01') AND (l_shipdate < '1996-01-07') AND (l_discount > 0.01) AND (l_discount < 0.06) AND (l_quantity = 4.0)"),
    "lineitem_keys": ("lineitem", "(l_orderkey > 100) AND (l_orderkey < 1000) AND (l_partkey > 100) AND (l_partkey < 5000) AND (l_linestatus = 'F') AND (l_tax < 0.07)"),
    "lineitem_keys_or": ("lineitem", "(l_returnflag = 'R') AND (l_discount < 0.04 OR l_linestatus = 'F') AND (l_orderkey > 500) AND (l_orderkey < 600)"),
}


@pytest.mark.parametrize("name", SCANS)
def test_scans(name, spark, duck, got, sf):
    table, where = SCANS[name]
    key = {"region": "r_regionkey", "nation": "n_nationkey", "supplier": "s_suppkey", "customer": "c_custkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}[table]
    mine = got(ops.project(ops.select_file(spark, f"{sf('sf0.01')}/{table}.parquet", where), [key]))
    assert mine == duck("sf0.01", f"SELECT {key} FROM {table} WHERE {where}")


@pytest.mark.parametrize(
    "text, sql",
    [
        ("SELECT SUM (l.l_discount) FROM customer AS c, orders AS o, lineitem AS l WHERE (c.c_custkey = o.o_custkey) AND (o.o_orderkey = l.l_orderkey) AND (c.c_name = 'Customer#000000919') AND (l.l_quantity > 30) AND (l.l_discount < 0.03)", "SELECT round(coalesce(sum(l_discount), 0), 6) AS sum FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND c_name = 'Customer#000000919' AND l_quantity > 30 AND l_discount < 0.03"),
        ("SELECT l.l_orderkey FROM lineitem AS l WHERE (l.l_quantity > 30)", "SELECT l_orderkey FROM lineitem WHERE l_quantity > 30"),
        ("SELECT SUM (l.l_extendedprice * l.l_discount) FROM lineitem AS l WHERE (l.l_discount<0.07) AND (l.l_quantity < 24)", "SELECT round(sum(l_extendedprice * l_discount), 6) AS sum FROM lineitem WHERE l_discount < 0.07 AND l_quantity < 24"),
        ("SELECT DISTINCT c1.c_name, c1.c_acctbal FROM customer AS c1, customer AS c2 WHERE (c1.c_nationkey = c2.c_nationkey) AND (c1.c_name ='Customer#000000919')", "SELECT DISTINCT c1.c_name, c1.c_acctbal FROM customer c1, customer c2 WHERE c1.c_nationkey = c2.c_nationkey AND c1.c_name = 'Customer#000000919'"),
    ],
)
def test_queries(text, sql, spark, duck, got, sf):
    mine, theirs = got(Engine(spark).view_parquet(sf("sf0.01"), ["customer", "orders", "lineitem"]).sql(text)), duck("sf0.01", sql)
    assert mine[0] == theirs[0] and len(mine) == len(theirs)
    assert all(a == pytest.approx(b, rel=1e-9) for a, b in zip(mine[1:], theirs[1:], strict=True)) if "sum" in mine[0] else mine == theirs
