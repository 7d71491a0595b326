"""Registered queries over the relational operators, and SQL that says the same."""

from __future__ import annotations

import atexit
import contextlib
import logging
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EstimateError, MillraceError, UnsupportedFileType
from .events import log
from .operators import relational as ops
from .session import Engine, compose
from .sources.files import Files
from .sources.store import TableStore
from .sources.text import write_rows
from .stats import Statistics, tpch_statistics

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
DAY = "strftime({}, '%Y-%m-%d')"


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark).view_parquet(sf_dir, TABLES)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dialect(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query in the dialect; sums are rounded to cents, as engines add up in different orders."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = engine(spark, sf_dir).sql(text)
        return df.withColumn("sum", F.round("sum", 2)) if "sum" in df.columns else df

    return run


def _folder(spark: SparkSession) -> str:
    """A new folder for tables that a query writes: below the session's shared folder where it names one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.gettempdir()
    path = f"{shared}/millrace-tables-{uuid.uuid4().hex}"
    files = Files(spark)

    def clear() -> None:
        with contextlib.suppress(Exception):  # the JVM may have ended before this process does
            files.delete(path)

    atexit.register(clear)
    return path


NATION = [("n_nationkey", "Int"), ("n_name", "String"), ("n_regionkey", "Int")]


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation").select(*(c for c, _ in NATION))


def scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.select_file(spark, f"{sf_dir}/region.parquet")


def select_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = ops.select_file(spark, f"{sf_dir}/orders.parquet", "(o_orderstatus = 'O')")
    return ops.project(ops.select_pipe(some, "(o_totalprice > 400000.0)"), ["o_orderkey", "o_orderstatus", "o_totalprice"])


def sort_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sort(_read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "(o_orderstatus) AND (o_orderkey)")


def sort_default_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, "customer")
    return ops.sort(df, ops.default_order(df))


def heap_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = TableStore(spark, _folder(spark))
    store.create("nation", NATION)
    store.append("nation", _nation(spark, sf_dir).where("n_regionkey < 2"))
    store.append("nation", _nation(spark, sf_dir).where("n_regionkey >= 2"))
    return store.scan("nation")


def _sorted(spark: SparkSession, sf_dir: str) -> TableStore:
    store = TableStore(spark, _folder(spark))
    store.create("orders", [("o_orderkey", "Int"), ("o_orderstatus", "String"), ("o_totalprice", "Double")], "sorted", ["o_orderstatus", "o_orderkey"])
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    for k in (1, 0, 3, 2, 4):
        store.append("orders", rows.where(f"o_orderkey % 5 = {k}"))
    return store


def sorted_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(spark, sf_dir).scan("orders")


def sorted_table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    e.store = _sorted(spark, sf_dir)
    return e.sql("SELECT o.o_orderkey, o.o_orderstatus, o.o_totalprice FROM orders AS o WHERE (o.o_orderstatus = 'P') AND (o.o_totalprice > 1000.0)")


def _as_text(spark: SparkSession, sf_dir: str) -> str:
    path = f"{_folder(spark)}/nation.tbl"
    cells = [F.concat(F.col(c).cast("string"), F.lit("|")) for c, _ in NATION]
    _nation(spark, sf_dir).select(F.concat(*cells).alias("value")).write.text(path)
    return path


def load_tbl(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, _folder(spark))
    e.execute("CREATE TABLE nation (n_nationkey INTEGER, n_name STRING, n_regionkey INTEGER) AS HEAP")
    e.execute(f"INSERT '{_as_text(spark, sf_dir)}' INTO nation")
    return e.sql("SELECT n.n_nationkey, n.n_name, n.n_regionkey FROM nation AS n")


def ddl_create_heap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, _folder(spark))
    e.execute("CREATE TABLE t (b STRING, a INTEGER, c DOUBLE) AS HEAP")
    entry = e.store.entry("t")
    return spark.createDataFrame([(i, c, k, e.store.kind("t"), e.table("t").count()) for i, (c, k) in enumerate(entry.columns)], "position int, name string, type string, kind string, n_rows long")


def ddl_create_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, _folder(spark))
    e.execute("CREATE TABLE t (b STRING, a INTEGER) AS SORTED ON a, b")
    return spark.createDataFrame([(i, k, e.store.kind("t")) for i, k in enumerate(e.store.sort_keys("t"))], "position int, sort_key string, kind string")


def ddl_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, _folder(spark))
    e.execute("CREATE TABLE keep (a INTEGER) AS HEAP")
    e.execute("CREATE TABLE gone (a INTEGER) AS HEAP")
    e.execute("DROP TABLE gone")
    left = sorted(e.store.catalog)
    return spark.createDataFrame([(n, Files(spark).exists(f"{e.store.root}/{n}")) for n in left], "name string, stored boolean")


def writeout_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/out"
    write_rows(_read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def explain_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = engine(spark, sf_dir).explain("SELECT SUM (s.s_acctbal), n.n_name FROM supplier AS s, nation AS n WHERE (s.s_nationkey = n.n_nationkey) AND (s.s_acctbal > 100.0) GROUP BY n.n_name")
    return spark.createDataFrame(list(enumerate(text.splitlines())), "line int, text string")


def explain_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans with a sum, a filter above the scans, distinct rows, a lookup by sort keys, and rows written to a file."""
    e, lines = engine(spark, sf_dir), []
    e.store = TableStore(spark, _folder(spark))
    e.store.create("s", [("k", "Int"), ("v", "String")], "sorted", ["k", "v"])
    texts = (
        "SELECT SUM (r.r_regionkey) FROM region AS r WHERE (2 > 1)",
        "SELECT DISTINCT n.n_regionkey FROM nation AS n",
        "SELECT s.v FROM s AS s WHERE (s.k = 3)",
        "SELECT SUM DISTINCT (o.o_totalprice) FROM orders AS o, lineitem AS l WHERE (o.o_orderkey = l.l_orderkey) AND (o.o_orderkey < 3 OR l.l_orderkey = 7)",
    )
    for text in texts:
        lines += e.explain(text).splitlines()
    path = f"{_folder(spark)}/out"
    e.execute(f"SET OUTPUT '{path}'")
    said: list[str] = []
    e.execute("SELECT r.r_name FROM region AS r", said.append)
    lines += [x.replace(path, "out") for x in said[0].splitlines()]
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")


_MEASURED: dict[str, Statistics] = {}


def _measured(spark: SparkSession, sf_dir: str, exact: bool = False, **columns: list[str]) -> Statistics:
    """Statistics of some columns. Those that only order joins come from sketches and are kept: they are measured once a process."""
    key = f"{sf_dir} {sorted(columns.items())}"
    if exact or key not in _MEASURED:
        s = Statistics()
        for name, some in columns.items():
            s.from_dataframe(name, _read(spark, sf_dir, name), some, exact)
        if exact:
            return s
        _MEASURED[key] = s
    return _MEASURED[key].copy()


def stats_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _measured(spark, sf_dir, True, customer=["c_custkey", "c_nationkey", "c_mktsegment"])
    r = s.relations["customer"]
    return spark.createDataFrame([("customer", a, r.rows, d) for a, d in r.attributes.items()], "relation string, attribute string, n_rows long, n_distinct long")


def stats_estimate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _measured(spark, sf_dir, True, customer=["c_custkey"], orders=["o_custkey"])
    return spark.createDataFrame([(round(s.estimate("(c_custkey = o_custkey)", ["customer", "orders"]), 2),)], "estimate double")


def stats_estimate_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _measured(spark, sf_dir, True, lineitem=["l_returnflag", "l_discount", "l_linestatus"])
    return spark.createDataFrame([(round(s.estimate("(l_returnflag = 'R') AND (l_discount < 0.04 OR l_linestatus = 'F')", ["lineitem"]), 2),)], "estimate double")


#: Steps on the statistics of scale factor 1: relations under further names, joins taken as done, and the join to estimate.
ESTIMATES = {
    "join": ("", (), "(s_suppkey = ps_suppkey)", "supplier partsupp"),
    "join_then_filter": ("", (("(s_suppkey = ps_suppkey)", "supplier partsupp"),), "(s_suppkey > 1000)", "supplier partsupp"),
    "alternatives": ("", (), "(l_returnflag = 'R') AND (l_discount < 0.04 OR l_shipmode = 'MAIL')", "lineitem"),
    "three": ("", (("(c_custkey = o_custkey)", "orders customer"),), "(c_nationkey = n_nationkey)", "orders customer nation"),
    "copies": ("nation n1, nation n2, supplier s, customer c", (("(s.s_nationkey = n1.n_nationkey)", "s n1"), ("(c.c_nationkey = n2.n_nationkey)", "c n2")), "(n1.n_nationkey = n2.n_nationkey)", "c s n1 n2"),
    "five": ("part p, partsupp ps, supplier s, nation n, region r", (("(p.p_partkey=ps.ps_partkey) AND (p.p_size = 2)", "p ps"), ("(s.s_suppkey = ps.ps_suppkey)", "p ps s"), ("(s.s_nationkey = n.n_nationkey)", "p ps s n")), "(n.n_regionkey = r.r_regionkey) AND (r.r_name = 'AMERICA')", "p ps s n r"),
    "name": ("", (("(s_suppkey = ps_suppkey)", "partsupp supplier"),), "(s_nationkey = n_nationkey) AND (n_name = 'AMERICA')", "partsupp supplier nation"),
    "one_column": ("", (), "(p_partkey=ps_partkey) AND (p_size =3 OR p_size=6 OR p_size =19)", "part partsupp"),
    "inequality": ("", (), "(l_receiptdate >'1995-02-01' ) AND (l_orderkey = o_orderkey)", "orders lineitem"),
    "many_conjuncts": ("", (), "(l_partkey = p_partkey) AND (l_shipmode = 'AIR' OR l_shipmode = 'AIR REG') AND (p_container ='SM BOX' OR p_container = 'SM PACK')  AND (l_shipinstruct = 'DELIVER IN PERSON')", "part lineitem"),
}
#: What the estimator must say of these.
ESTIMATED = {"join": 800000, "join_then_filter": 266666.67, "alternatives": 857316.43, "three": 1500000, "copies": 60000000, "five": 3200, "name": 32000, "one_column": 48000, "inequality": 2000405, "many_conjuncts": 21432.91}


def stats_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates on the known cardinalities, after copies and applied joins, and the same after their text has been read back."""
    rows = []
    for name, (copies, applied, cnf, relations) in ESTIMATES.items():
        s = tpch_statistics()
        for pair in copies.split(", ") if copies else []:
            s.copy_rel(*pair.split())
        again = Statistics.loads(s.copy().dumps())
        for done, some in applied:
            s.apply(done, some.split())
            again.apply(done, some.split())
        rows.append((name, round(s.estimate(cnf, relations.split()), 2), round(again.estimate(cnf, relations.split()), 2)))
    return spark.createDataFrame(rows, "name string, estimate double, read_back double")


def screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What statements say on the screen: rows, a sum, how many there were, and nothing but plans when output is off."""
    e, said = engine(spark, sf_dir), []
    for text in ("SELECT r.r_regionkey, r.r_name FROM region AS r WHERE (r.r_regionkey = 2)", "SELECT SUM (n.n_nationkey) FROM nation AS n", "SET OUTPUT NONE", "SELECT n.n_name FROM nation AS n", "SET OUTPUT STDOUT", "SELECT n.n_name FROM nation AS n WHERE (n.n_nationkey > 99)"):
        e.execute(text, said.append)
    return spark.createDataFrame(list(enumerate(line for x in said for line in x.splitlines())), "line int, text string")


def session_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where rows go, as a later engine finds it."""
    path, rows = f"{_folder(spark)}/session", []
    for text in ("SET OUTPUT NONE", "SET OUTPUT 'file'", "SET OUTPUT STDOUT"):
        Engine(spark, session_file=path).execute(text)
        s = Engine(spark, session_file=path).session
        rows.append((text.replace("'", ""), s.output, s.execute))
    return spark.createDataFrame(rows, "statement string, output string, runs boolean")


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with statements, by class of error, and whether the log of events has each."""
    e, rows, kept = engine(spark, sf_dir), [], []
    e.store = TableStore(spark, _folder(spark))
    e.execute("CREATE TABLE t (a INTEGER) AS HEAP")
    handler = logging.Handler()
    handler.emit = lambda record: kept.append(record.getMessage())
    log.addHandler(handler)
    try:
        for text in REFUSED:
            try:
                e.execute(text, lambda x: None)
                rows.append((text, "none", False))
            except MillraceError as error:
                rows.append((text, type(error).__name__, bool(kept) and kept[-1].startswith(type(error).__name__)))
    finally:
        log.removeHandler(handler)
    for cnf, names in (("(r_name = n_name)", ["region"]), ("(nowhere = 1)", ["region"]), ("(r_name = 1)", ["nowhere"])):
        try:
            tpch_statistics().estimate(cnf, names)
            rows.append((cnf, "none", False))
        except EstimateError as error:
            rows.append((cnf, type(error).__name__, False))
    return spark.createDataFrame(rows, "statement string, error string, logged boolean")


REFUSED = {
    "CREATE TABLE t (a INTEGER) AS HEAP": "TableExists", "CREATE TABLE u (a INTEGER) AS SORTED ON b": "SortColumnsMismatch", "DROP TABLE u": "TableNotFound", "INSERT nowhere INTO t": "QuerySyntaxError",
    "SELECT x.a FROM u AS x": "TableNotFound", "SELECT t.b FROM t AS t": "ColumnNotFound", "SELECT r_name FROM region AS a, region AS b": "AmbiguousColumn", "SELECT t.a FROM t AS t WHERE (t.a < = 1)": "QuerySyntaxError",
    "SELECT t.a FROM t AS t GROUP BY t.a": "InvalidQuery", "SELECT SUM (r.r_name) FROM region AS r": "TypeMismatch",
}
_REFUSED_CNF = ("(r_name = n_name)", "(nowhere = 1)", "(r_name = 1)")


def composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows from text in memory: each nation written as a line and read again."""
    lines = [r[0] for r in _nation(spark, sf_dir).select(F.concat(*(F.concat(F.col(c).cast("string"), F.lit("|")) for c, _ in NATION))).collect()]  # 25 lines
    return compose(spark, lines, NATION)


def table_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heaps and sorted tables behind one interface, and the kind that is only declared."""
    store, rows = TableStore(spark, _folder(spark)), []
    for name, kind, keys in (("h", "heap", None), ("s", "sorted", ["v", "k"]), ("x", "tree", ["k"])):
        try:
            store.create(name, [("k", "Int"), ("v", "String")], kind, keys)
        except UnsupportedFileType as error:
            rows.append((name, type(error).__name__, "", 0))
            continue
        for _ in range(2):
            store.append(name, spark.createDataFrame([(3, "a"), (1, "b")], "k long, v string"))
        again = TableStore(spark, store.root)
        rows.append((name, again.kind(name), " ".join(again.sort_keys(name)), again.scan(name).count()))
    return spark.createDataFrame(rows, "name string, kind string, sort_keys string, n_rows long")


def cost_ordered_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join of five tables in the order that measured statistics give."""
    e = engine(spark, sf_dir)
    e.statistics = _measured(spark, sf_dir, region=["r_regionkey"], nation=["n_nationkey", "n_regionkey"], customer=["c_custkey", "c_nationkey"], orders=["o_orderkey", "o_custkey"], lineitem=["l_orderkey"])
    return e.sql("SELECT SUM (l.l_quantity), r.r_name FROM lineitem AS l, orders AS o, customer AS c, nation AS n, region AS r WHERE (l.l_orderkey = o.o_orderkey) AND (o.o_custkey = c.c_custkey) AND (c.c_nationkey = n.n_nationkey) AND (n.n_regionkey = r.r_regionkey) GROUP BY r.r_name").withColumn("sum", F.round("sum", 2))


#: name: (query in the dialect, SQL)
DIALECT = {
    "select_eq_string": ("SELECT r.r_regionkey, r.r_name FROM region AS r WHERE (r.r_name = 'EUROPE')", "SELECT r_regionkey, r_name FROM region WHERE r_name = 'EUROPE'"),
    "select_lt_gt": ("SELECT r_regionkey, r_name FROM region AS r WHERE (r_name < 'MIDDLE EAST') AND (r_regionkey > 1)", "SELECT r_regionkey, r_name FROM region WHERE r_name < 'MIDDLE EAST' AND r_regionkey > 1"),
    "project_double_range": ("SELECT p.p_retailprice, p.p_partkey, p.p_name FROM part AS p WHERE (p.p_retailprice > 931.01) AND (p.p_retailprice < 951.3)", "SELECT p_retailprice, p_partkey, p_name FROM part WHERE p_retailprice > 931.01 AND p_retailprice < 951.3"),
    "select_cnf_or": ("SELECT l.l_orderkey, l.l_linenumber, l.l_discount FROM lineitem AS l WHERE (l.l_returnflag = 'R') AND (l.l_discount < 0.04 OR l.l_linestatus = 'F')", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_returnflag = 'R' AND (l_discount < 0.04 OR l_linestatus = 'F')"),
    "select_col_vs_col": ("SELECT l.l_orderkey, l.l_linenumber, l.l_tax, l.l_discount FROM lineitem AS l WHERE (l.l_tax > l.l_discount)", "SELECT l_orderkey, l_linenumber, l_tax, l_discount FROM lineitem WHERE l_tax > l_discount"),
    "select_date_as_string": ("SELECT l.l_orderkey, l.l_shipdate FROM lineitem AS l WHERE (l.l_shipdate > '1996-01-01') AND (l.l_shipdate < '1996-01-07')", f"SELECT l_orderkey, {DAY.format('l_shipdate')} AS l_shipdate FROM lineitem WHERE {DAY.format('l_shipdate')} > '1996-01-01' AND {DAY.format('l_shipdate')} < '1996-01-07'"),
    "select_literal_first": ("SELECT s.s_suppkey, s.s_name FROM supplier AS s WHERE (10 > s.s_suppkey)", "SELECT s_suppkey, s_name FROM supplier WHERE 10 > s_suppkey"),
    "join_equi_2": ("SELECT c.c_name, o.o_orderkey, o.o_totalprice FROM customer AS c, orders AS o WHERE (c.c_custkey = o.o_custkey) AND (o.o_totalprice < 10000.0)", "SELECT c_name, o_orderkey, o_totalprice FROM customer, orders WHERE c_custkey = o_custkey AND o_totalprice < 10000.0"),
    "join_equi_3_sum": ("SELECT SUM (l.l_extendedprice) FROM part AS p, supplier AS s, lineitem AS l WHERE (p.p_partkey = l.l_partkey) AND (s.s_suppkey = l.l_suppkey) AND (s.s_acctbal > 2500.0)", "SELECT round(coalesce(sum(l_extendedprice), 0.0), 2) AS sum FROM part, supplier, lineitem WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND s_acctbal > 2500.0"),
    "join_multikey": ("SELECT SUM (a.l_quantity) FROM lineitem AS a, lineitem AS b WHERE (a.l_orderkey = b.l_orderkey) AND (a.l_linenumber = b.l_linenumber)", "SELECT round(sum(a.l_quantity), 2) AS sum FROM lineitem a, lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber"),
    "join_theta": ("SELECT a.s_suppkey, b.s_suppkey FROM supplier AS a, supplier AS b WHERE (a.s_acctbal < b.s_acctbal)", "SELECT a.s_suppkey AS a_s_suppkey, b.s_suppkey AS b_s_suppkey FROM supplier a, supplier b WHERE a.s_acctbal < b.s_acctbal"),
    "join_cross": ("SELECT n.n_name, r.r_name FROM nation AS n, region AS r", "SELECT n_name, r_name FROM nation, region"),
    "join_self_distinct": ("SELECT DISTINCT c1.c_name, c1.c_acctbal FROM customer AS c1, customer AS c2 WHERE (c1.c_nationkey = c2.c_nationkey) AND (c1.c_name = 'Customer#000000042')", "SELECT DISTINCT c1.c_name, c1.c_acctbal FROM customer c1, customer c2 WHERE c1.c_nationkey = c2.c_nationkey AND c1.c_name = 'Customer#000000042'"),
    "join_cross_table_or": ("SELECT l.l_orderkey, l.l_linenumber, o.o_totalprice FROM orders AS o, lineitem AS l WHERE (o.o_orderkey = l.l_orderkey) AND (l.l_orderkey < 100 OR o.o_totalprice < 5000.0)", "SELECT l_orderkey, l_linenumber, o_totalprice FROM orders, lineitem WHERE o_orderkey = l_orderkey AND (l_orderkey < 100 OR o_totalprice < 5000.0)"),
    "join_equi_residual": ("SELECT o.o_orderkey, l.l_linenumber FROM orders AS o, lineitem AS l WHERE (o.o_orderkey = l.l_orderkey) AND (l.l_extendedprice > o.o_totalprice)", "SELECT o_orderkey, l_linenumber FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_extendedprice > o_totalprice"),
    "join_5_distinct": ("SELECT DISTINCT c.c_name FROM lineitem AS l, orders AS o, customer AS c, nation AS n, region AS r WHERE (l.l_orderkey = o.o_orderkey) AND (o.o_custkey = c.c_custkey) AND (c.c_nationkey = n.n_nationkey) AND (n.n_regionkey = r.r_regionkey)", "SELECT DISTINCT c_name FROM lineitem, orders, customer, nation, region WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey"),
    "join_3_distinct": ("SELECT DISTINCT s.s_name FROM supplier AS s, part AS p, lineitem AS l WHERE (s.s_suppkey = l.l_suppkey) AND (p.p_partkey = l.l_partkey) AND (p.p_brand = 'Brand#4') AND (l.l_extendedprice < 35000.0)", "SELECT DISTINCT s_name FROM supplier, part, lineitem WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND p_brand = 'Brand#4' AND l_extendedprice < 35000.0"),
    "join_5_filter": ("SELECT l.l_discount FROM lineitem AS l, orders AS o, customer AS c, nation AS n, region AS r WHERE (l.l_orderkey = o.o_orderkey) AND (o.o_custkey = c.c_custkey) AND (c.c_nationkey = n.n_nationkey) AND (n.n_regionkey = r.r_regionkey) AND (r.r_regionkey = 1) AND (o.o_orderkey < 10000)", "SELECT l_discount FROM lineitem, orders, customer, nation, region WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_regionkey = 1 AND o_orderkey < 10000"),
    "sum_expr": ("SELECT SUM (s.s_acctbal + (s.s_acctbal * 1.05)) FROM supplier AS s", "SELECT round(sum(s_acctbal + s_acctbal * CAST(1.05 AS DOUBLE)), 2) AS sum FROM supplier"),
    "sum_int": ("SELECT SUM (p.p_size) FROM part AS p", "SELECT round(CAST(sum(p_size) AS DOUBLE), 2) AS sum FROM part"),
    "sum_rightassoc": ("SELECT SUM (10 - p.p_size - 2) FROM part AS p", "SELECT round(CAST(sum(10 - (p_size - 2)) AS DOUBLE), 2) AS sum FROM part"),
    "sum_int_div": ("SELECT SUM (p.p_size / 7) FROM part AS p", "SELECT round(CAST(sum(p_size // 7) AS DOUBLE), 2) AS sum FROM part"),
    "sum_dbl_div": ("SELECT SUM (l.l_extendedprice / l.l_quantity) FROM lineitem AS l", "SELECT round(sum(l_extendedprice / l_quantity), 2) AS sum FROM lineitem"),
    "sum_unary_minus": ("SELECT SUM (- p.p_size + 3) FROM part AS p", "SELECT round(CAST(sum(-(p_size + 3)) AS DOUBLE), 2) AS sum FROM part"),
    "sum_empty": ("SELECT SUM (s.s_acctbal) FROM supplier AS s WHERE (s.s_acctbal > 99999999.0)", "SELECT coalesce(sum(s_acctbal), 0.0) AS sum FROM supplier WHERE s_acctbal > 99999999.0"),
    "sum_distinct": ("SELECT SUM DISTINCT (l.l_discount) FROM lineitem AS l", "SELECT round(sum(DISTINCT l_discount), 2) AS sum FROM lineitem"),
    "group_by_1": ("SELECT SUM (l.l_quantity), s.s_nationkey FROM supplier AS s, lineitem AS l WHERE (s.s_suppkey = l.l_suppkey) GROUP BY s.s_nationkey", "SELECT round(sum(l_quantity), 2) AS sum, s_nationkey FROM supplier, lineitem WHERE s_suppkey = l_suppkey GROUP BY s_nationkey"),
    "group_by_3": ("SELECT SUM (l.l_extendedprice * (1 - l.l_discount)), l.l_orderkey, o.o_orderdate, o.o_orderpriority FROM customer AS c, orders AS o, lineitem AS l WHERE (c.c_mktsegment = 'BUILDING') AND (c.c_custkey = o.o_custkey) AND (l.l_orderkey = o.o_orderkey) AND (l_orderkey < 100 OR o_orderkey < 100) GROUP BY l_orderkey, o_orderdate, o_orderpriority", f"SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum, l_orderkey, {DAY.format('o_orderdate')} AS o_orderdate, o_orderpriority FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND (l_orderkey < 100 OR o_orderkey < 100) GROUP BY ALL"),
    "group_by_singletons": ("SELECT SUM (p.p_retailprice), p.p_partkey FROM part AS p GROUP BY p.p_partkey", "SELECT round(sum(p_retailprice), 2) AS sum, p_partkey FROM part GROUP BY p_partkey"),
    "group_by_name": ("SELECT SUM (c.c_acctbal), c.c_name FROM customer AS c, orders AS o WHERE (c.c_custkey = o.o_custkey) AND (o.o_totalprice < 10000.0) GROUP BY c.c_name", "SELECT round(sum(c_acctbal), 2) AS sum, c_name FROM customer, orders WHERE c_custkey = o_custkey AND o_totalprice < 10000.0 GROUP BY c_name"),
    "distinct_1": ("SELECT DISTINCT l.l_suppkey FROM lineitem AS l WHERE (l.l_extendedprice < 2000.0)", "SELECT DISTINCT l_suppkey FROM lineitem WHERE l_extendedprice < 2000.0"),
    "distinct_multi": ("SELECT DISTINCT l.l_returnflag, l.l_linestatus FROM lineitem AS l", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
}

_NATION_SQL = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"
_ORDERS_SQL = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"
_NODES = (
    "Sum: SUM r.r_regionkey", "  SelectPipe: (2 > 1)", "    SelectFile: region AS r",
    "Distinct", "  Project: n.n_regionkey", "    SelectFile: nation AS n",
    "Project: s.v", "  SortedLookup: s AS s; by k; (s.k = 3)",
    "Sum: SUM DISTINCT o.o_totalprice", "  Join: (o.o_orderkey = l.l_orderkey) AND (o.o_orderkey < 3 OR l.l_orderkey = 7)",
    "    SelectFile: orders AS o; (o.o_orderkey < 3 OR o.o_orderkey = 7)", "    SelectFile: lineitem AS l; (l.l_orderkey < 3 OR l.l_orderkey = 7)",
    "WriteOut: out", "  Project: r.r_name", "    SelectFile: region AS r",
)
OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "scan_all": (scan_all, "SELECT * FROM region"),
    "select_pipe": (select_pipe, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 400000.0"),
    "sort_multi_key": (sort_multi_key, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"),
    "sort_default_order": (sort_default_order, "SELECT * FROM customer"),
    "heap_roundtrip": (heap_roundtrip, _NATION_SQL),
    "sorted_table_scan": (sorted_table_scan, _ORDERS_SQL),
    "sorted_table_lookup": (sorted_table_lookup, f"SELECT * FROM ({_ORDERS_SQL}) WHERE o_orderstatus = 'P' AND o_totalprice > 1000.0"),
    "load_tbl": (load_tbl, _NATION_SQL),
    "ddl_create_heap": (ddl_create_heap, "SELECT * FROM (VALUES (CAST(0 AS INTEGER), 'b', 'String', 'heap', CAST(0 AS BIGINT)), (1, 'a', 'Int', 'heap', 0), (2, 'c', 'Double', 'heap', 0)) t(position, name, type, kind, n_rows)"),
    "ddl_create_sorted": (ddl_create_sorted, "SELECT * FROM (VALUES (CAST(0 AS INTEGER), 'a', 'sorted'), (1, 'b', 'sorted')) t(position, sort_key, kind)"),
    "ddl_drop": (ddl_drop, "SELECT 'keep' AS name, true AS stored"),
    "writeout_format": (writeout_format, "SELECT printf('s_suppkey: [%d], s_name: [%s], s_acctbal: [%.6f]', s_suppkey, s_name, s_acctbal) AS line FROM supplier"),
    "explain_plan": (explain_plan, "SELECT * FROM (VALUES (CAST(0 AS INTEGER), 'Project: sum, n.n_name'), (1, '  GroupBy: SUM s.s_acctbal; by n.n_name'), (2, '    Join: (s.s_nationkey = n.n_nationkey)'), (3, '      SelectFile: supplier AS s; (s.s_acctbal > 100.0)'), (4, '      SelectFile: nation AS n')) t(line, text)"),
    "explain_nodes": (explain_nodes, "SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS INTEGER), '{x}')" for i, x in enumerate(_NODES)) + ") t(line, text)"),
    "stats_known": (stats_known, "SELECT name, CAST(estimate AS DOUBLE) AS estimate, CAST(estimate AS DOUBLE) AS read_back FROM (VALUES " + ", ".join(f"('{n}', {x})" for n, x in ESTIMATED.items()) + ") t(name, estimate)"),
    "screen": (screen, """
WITH x AS (
  SELECT 0 AS step, 0 AS pos, 'Project: r.r_regionkey, r.r_name' AS text UNION ALL SELECT 0, 1, '  SelectFile: region AS r; (r.r_regionkey = 2)'
  UNION ALL SELECT 1, 0, printf('r_regionkey: [%d], r_name: [%s]', r_regionkey, r_name) FROM region WHERE r_regionkey = 2
  UNION ALL SELECT 2, 0, printf('%d rows', count(*)) FROM region WHERE r_regionkey = 2
  UNION ALL SELECT 3, 0, 'Sum: SUM n.n_nationkey' UNION ALL SELECT 3, 1, '  SelectFile: nation AS n'
  UNION ALL SELECT 4, 0, printf('sum: [%d]', CAST(sum(n_nationkey) AS BIGINT)) FROM nation UNION ALL SELECT 5, 0, '1 rows'
  UNION ALL SELECT 6, 0, 'Project: n.n_name' UNION ALL SELECT 6, 1, '  SelectFile: nation AS n'
  UNION ALL SELECT 7, 0, 'Project: n.n_name' UNION ALL SELECT 7, 1, '  SelectFile: nation AS n; (n.n_nationkey > 99)' UNION ALL SELECT 8, 0, '0 rows'
) SELECT CAST(row_number() OVER (ORDER BY step, pos) - 1 AS INTEGER) AS line, text FROM x"""),
    "session_kept": (session_kept, "SELECT * FROM (VALUES ('SET OUTPUT NONE', 'none', false), ('SET OUTPUT file', 'file', true), ('SET OUTPUT STDOUT', 'stdout', true)) t(statement, output, runs)"),
    "refusals": (refusals, "SELECT * FROM (VALUES " + ", ".join([f"('{x}', '{y}', true)" for x, y in REFUSED.items()] + [f"('{x}', 'EstimateError', false)" for x in _REFUSED_CNF]) + ") t(statement, error, logged)"),
    "composed": (composed, _NATION_SQL),
    "table_kinds": (table_kinds, "SELECT * FROM (VALUES ('h', 'heap', '', CAST(4 AS BIGINT)), ('s', 'sorted', 'v k', 4), ('x', 'UnsupportedFileType', '', 0)) t(name, kind, sort_keys, n_rows)"),
    "stats_table": (stats_table, "SELECT 'customer' AS relation, unnest(['c_custkey', 'c_nationkey', 'c_mktsegment']) AS attribute, count(*) AS n_rows, unnest([count(DISTINCT c_custkey), count(DISTINCT c_nationkey), count(DISTINCT c_mktsegment)]) AS n_distinct FROM customer"),
    "stats_estimate_join": (stats_estimate_join, "SELECT round(CAST((SELECT count(*) FROM customer) AS DOUBLE) * (SELECT count(*) FROM orders) / greatest((SELECT count(DISTINCT c_custkey) FROM customer), (SELECT count(DISTINCT o_custkey) FROM orders)), 2) AS estimate"),
    "stats_estimate_or": (stats_estimate_or, "SELECT round(count(*) / count(DISTINCT l_returnflag) * (1 - (1 - CAST(1 AS DOUBLE) / 3) * (1 - CAST(1 AS DOUBLE) / count(DISTINCT l_linestatus))), 2) AS estimate FROM lineitem"),
    "cost_ordered_join": (cost_ordered_join, "SELECT round(sum(l_quantity), 2) AS sum, r_name FROM lineitem, orders, customer, nation, region WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY r_name"),
}

QUERIES = {name: _dialect(text) for name, (text, _) in DIALECT.items()} | {name: f for name, (f, _) in OTHERS.items()}
SQL = {name: sql for name, (_, sql) in DIALECT.items()} | {name: sql for name, (_, sql) in OTHERS.items() if sql}
