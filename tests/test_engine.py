import pytest

from millrace import cli, events
from millrace.catalog import read_catalog, write_catalog
from millrace.errors import AmbiguousColumn, CatalogError, ColumnNotFound, InvalidQuery, LoadError, SortColumnsMismatch, TableExists, TableNotFound, TypeMismatch, UnsupportedFileType
from millrace.operators import relational as ops
from millrace.session import Engine, Session, compose
from millrace.sources.files import Files
from millrace.sources.text import read_delimited, show_rows, write_rows
from millrace.stats import Statistics


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.view("t", spark.createDataFrame([("a", 1, 1.5), ("a", 2, 2.5), ("b", 4, 0.5), ("c", 8, 1.0), ("c", 16, 8.0)], "g string, n int, d double"))
    e.view("u", spark.createDataFrame([("a", 10), ("b", 20), ("z", 30)], "g string, m int"))
    return e


def vals(df):
    return sorted(tuple(r) for r in df.collect())


def test_single_rows_make_groups(engine):
    assert vals(engine.sql("SELECT SUM (t.n), t.g FROM t AS t GROUP BY t.g")) == [(3.0, "a"), (4.0, "b"), (24.0, "c")]


def test_columns_come_as_asked(engine):
    df = engine.sql("SELECT x.d, x.g, x.n FROM t AS x WHERE (x.n = 4)")
    assert df.columns == ["d", "g", "n"] and vals(df) == [(0.5, "b", 4)]


def test_self_join_binds_each_side(engine):
    df = engine.sql("SELECT a.n, b.n FROM t AS a, t AS b WHERE (a.g = b.g) AND (a.n < b.n)")
    assert df.columns == ["a_n", "b_n"] and vals(df) == [(1, 2), (8, 16)]


def test_all_conjuncts_of_a_pair_apply(engine):
    assert vals(engine.sql("SELECT SUM (a.n) FROM t AS a, t AS b WHERE (a.g = b.g) AND (a.n = b.n)")) == [(31.0,)]


def test_or_across_tables_and_columns_of_one(engine):
    assert vals(engine.sql("SELECT t.n FROM t AS t, u AS u WHERE (t.g = u.g) AND (t.n < 2 OR u.m > 15)")) == [(1,), (4,)]
    assert vals(engine.sql("SELECT t.n FROM t AS t WHERE (t.n < t.d)")) == [(1,), (2,)]
    assert vals(engine.sql("SELECT t.n FROM t AS t WHERE (2 > 1) AND (t.n > 8)")) == [(16,)]
    assert vals(engine.sql("SELECT t.n FROM t AS t WHERE (1 > 2)")) == []


def test_sums(engine):
    one = lambda text: engine.sql(text).first()[0]
    assert one("SELECT SUM (t.n) FROM t AS t WHERE (t.n > 99)") == 0.0
    assert one("SELECT SUM DISTINCT (t.n / t.n) FROM t AS t") == 1.0
    assert one("SELECT SUM (t.n / 3) FROM t AS t") == 0 + 0 + 1 + 2 + 5
    assert one("SELECT SUM (- t.n / 3) FROM t AS t") == -8
    assert one("SELECT SUM (10 - t.n - 2) FROM t AS t") == sum(10 - (n - 2) for n in (1, 2, 4, 8, 16))
    assert vals(engine.sql("SELECT SUM (t.n), t.g FROM t AS t WHERE (t.n > 99) GROUP BY t.g")) == []
    assert vals(engine.sql("SELECT DISTINCT t.g FROM t AS t WHERE (t.n > 99)")) == []
    assert engine.sql("SELECT SUM (t.n) FROM t AS t").dtypes == [("sum", "double")]


@pytest.mark.parametrize(
    "text, error",
    [
        ("SELECT t.g FROM t AS t GROUP BY t.g", InvalidQuery),
        ("SELECT SUM (t.n), t.g FROM t AS t", InvalidQuery),
        ("SELECT SUM (t.n), t.d FROM t AS t GROUP BY t.g", InvalidQuery),
        ("SELECT t.g FROM t AS t, u AS t", InvalidQuery),
        ("SELECT t.q FROM t AS t", ColumnNotFound),
        ("SELECT x.g FROM t AS t", ColumnNotFound),
        ("SELECT g FROM t AS t, u AS u", AmbiguousColumn),
        ("SELECT t.g FROM t AS t WHERE (t.g = 1)", TypeMismatch),
        ("SELECT t.g FROM t AS t WHERE ('a' = 1.0)", TypeMismatch),
        ("SELECT SUM (t.g) FROM t AS t", TypeMismatch),
        ("SELECT w.g FROM w AS w", TableNotFound),
    ],
)
def test_refused(engine, text, error):
    with pytest.raises(error):
        engine.sql(text)


def test_strict_types(spark, engine):
    assert vals(engine.sql("SELECT t.n FROM t AS t WHERE (t.d > 7)")) == [(16,)]
    engine.strict = True
    with pytest.raises(TypeMismatch):
        engine.sql("SELECT t.n FROM t AS t WHERE (t.d > 7)")


def test_times_are_strings_of_days(spark, engine):
    engine.view("e", spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '1996-01-01 00:00:00'), (2, TIMESTAMP '1996-01-01 23:59:59'), (3, TIMESTAMP '1996-01-02 00:00:00') AS e(i, at)"))
    pick = lambda c: [r[0] for r in vals(engine.sql(f"SELECT e.i FROM e AS e WHERE ({c})"))]
    assert pick("e.at = '1996-01-01'") == [1, 2] and pick("e.at > '1996-01-01'") == [3] and pick("e.at < '1996-01-02'") == [1, 2]
    assert pick("'1996-01-01' < e.at") == [3] and pick("e.at > '1996-01'") == [1, 2, 3] and pick("e.at < '1996-02-31'") == [1, 2, 3]
    assert engine.sql("SELECT e.at FROM e AS e WHERE (e.i = 3)").first()[0] == "1996-01-02"


def test_joins_follow_statistics(spark, engine):
    for n, rows in (("a", 1000), ("b", 1000), ("c", 2)):
        engine.view(n, spark.range(5).selectExpr("CAST(id AS INT) AS k", f"CAST(id AS INT) AS {n}x"))
    text = "SELECT a.ax FROM a AS a, b AS b, c AS c WHERE (a.k = b.k) AND (b.bx = c.cx)"
    assert engine.explain(text).index("SelectFile: a") < engine.explain(text).index("SelectFile: c")
    engine.statistics = Statistics()
    for n, rows in (("a", 1000), ("b", 1000), ("c", 2)):
        engine.statistics.add_rel(n, rows)
        engine.statistics.add_att(n, "k", rows)
        engine.statistics.add_att(n, f"{n}x", rows)
    plan = engine.explain(text)
    assert plan.index("SelectFile: c") < plan.index("SelectFile: a")
    assert vals(engine.sql(text)) == [(i,) for i in range(5)]


def test_filters_reach_the_scan(spark, sf):
    e = Engine(spark).view_parquet(sf("sf0.001"), ["lineitem", "orders"])
    df = e.sql("SELECT l.l_orderkey FROM lineitem AS l WHERE (l.l_shipdate > '1996-01-01') AND (l.l_quantity < 3)")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_quantity" in plan and "l_comment" not in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_shipdate:timestamp" in plan


def test_tables(spark, engine):
    engine.execute("CREATE TABLE h (b STRING, a INTEGER, c DOUBLE) AS HEAP")
    assert engine.store.entry("h").columns == [("b", "String"), ("a", "Int"), ("c", "Double")]
    assert engine.table("h").count() == 0 and engine.sql("SELECT SUM (h.a) FROM h AS h").first()[0] == 0.0
    for text, error in (
        ("CREATE TABLE h (a INTEGER) AS HEAP", TableExists),
        ("CREATE TABLE s (a INTEGER) AS SORTED ON b", SortColumnsMismatch),
        ("DROP TABLE nowhere", TableNotFound),
        ("INSERT 'x' INTO nowhere", TableNotFound),
        ("INSERT '/nowhere/x' INTO h", LoadError),
    ):
        with pytest.raises(error):
            engine.execute(text)
    assert "s" not in engine.store.catalog
    with pytest.raises(UnsupportedFileType):
        engine.store.create("tree", [("a", "Int")], "tree")
    engine.execute("DROP TABLE h")
    assert engine.store.catalog == {} and not engine.store.files.exists(f"{engine.store.root}/h")


def test_sorted_tables_stay_sorted(spark, engine):
    engine.execute("CREATE TABLE s (k INTEGER, v STRING) AS SORTED ON k")
    for some in ([(5, "e"), (1, "a")], [(3, "c"), (1, "z")], [(4, "d")]):
        engine.store.append("s", spark.createDataFrame(some, "k int, v string"))
    assert [r.k for r in engine.store.scan("s").collect()] == [1, 1, 3, 4, 5]
    assert sorted(r.v for r in engine.store.lookup("s", k=1).collect()) == ["a", "z"]
    with pytest.raises(TypeMismatch):
        engine.store.append("s", spark.createDataFrame([(1,)], "k int"))


def test_sorted_runs_are_merged_by_size(spark, engine, monkeypatch):
    engine.execute("CREATE TABLE s (k INTEGER, d DOUBLE, v STRING) AS SORTED ON v, k")
    runs = lambda: engine.store._about("s")["runs"]
    want, written = [], 0
    for i in range(11):
        rows = [(10 * i + j, j / 2, chr(97 + (i + j) % 7)) for j in range(3)]
        want += rows
        engine.store.append("s", spark.createDataFrame(rows, "k long, d double, v string"))
        assert len(runs()) < 6 and sum(r["n"] for r in runs()) == len(want)
    got = [tuple(r) for r in engine.store.scan("s").collect()]
    assert got == sorted(want, key=lambda r: (r[2], r[0]))
    folders = [f for f in __import__("os").listdir(f"{engine.store.root}/s") if f.startswith("rows-")]
    assert sorted(folders) == sorted(r["rows"] for r in runs())
    engine.store.append("s", spark.createDataFrame([], "k long, d double, v string"))
    assert len(want) == engine.store.scan("s", ordered=False).count()
    # a lookup opens only runs that may hold the value
    opened = engine.store.lookup("s", v="c", k=20).inputFiles()
    assert vals(engine.store.lookup("s", v="c", k=20)) == [r for r in want if r[2] == "c" and r[0] == 20]
    assert len(opened) <= len(engine.store.scan("s", ordered=False).inputFiles()) and engine.store.lookup("s", v="zz").inputFiles() == []


def test_lookup_by_sort_keys_from_sql(spark, engine):
    engine.execute("CREATE TABLE s (k INTEGER, d DOUBLE, v STRING) AS SORTED ON v, k")
    engine.store.append("s", spark.createDataFrame([(i, i / 4, "abc"[i % 3]) for i in range(60)], "k long, d double, v string"))
    plan = lambda where: engine.explain(f"SELECT s.d FROM s AS s WHERE {where}")
    assert "SortedLookup: s AS s; by v, k;" in plan("(s.k = 4) AND ('b' = v)")
    assert "SortedLookup: s AS s; by v;" in plan("(s.v = 'b') AND (s.k > 4)")
    for where in ("(s.k = 4)", "(s.v < 'b')", "(s.v = 'b' OR s.k = 4)", "(s.v = s.v)"):
        assert "SelectFile" in plan(where)
    assert vals(engine.sql("SELECT s.d FROM s AS s WHERE (s.k = 4) AND ('b' = s.v)")) == [(1.0,)]
    assert vals(engine.sql("SELECT s.d FROM s AS s WHERE (s.k = 5) AND (s.v = 'b')")) == []
    assert vals(engine.sql("SELECT a.k, b.k FROM s AS a, s AS b WHERE (a.v = 'b') AND (a.k = b.k) AND (b.k < 5)")) == [(1, 1), (4, 4)]
    engine.execute("CREATE TABLE e (d DOUBLE) AS SORTED ON d")
    engine.store.append("e", spark.createDataFrame([(1.5,), (2.0,)], "d double"))
    assert vals(engine.sql("SELECT e.d FROM e AS e WHERE (e.d = 2)")) == [(2.0,)] and vals(engine.sql("SELECT e.d FROM e AS e WHERE (e.d = 1.5)")) == [(1.5,)]


def test_ints_are_64_bits_wide(spark, engine, tmp_path):
    (tmp_path / "big.tbl").write_text("3000000000|x|\n-9000000000000|y|\n")
    engine.execute("CREATE TABLE big (k INTEGER, v STRING) AS SORTED ON k")
    engine.execute(f"INSERT '{tmp_path}/big.tbl' INTO big")
    assert vals(engine.sql("SELECT big.k FROM big AS big WHERE (big.k > 2999999999)")) == [(3000000000,)]
    assert engine.store.entry("big").columns[0] == ("k", "Int")


def test_conjuncts_over_tables_filter_each_scan(spark, engine):
    plan = engine.explain("SELECT t.n FROM t AS t, u AS u WHERE (t.g = u.g) AND (t.g < 'b' OR u.g = 'z')")
    assert "SelectFile: t AS t; (t.g < 'b' OR t.g = 'z')" in plan and "SelectFile: u AS u; (u.g < 'b' OR u.g = 'z')" in plan
    assert vals(engine.sql("SELECT t.n FROM t AS t, u AS u WHERE (t.g = u.g) AND (t.g < 'b' OR u.g = 'z')")) == [(1,), (2,)]
    assert "SelectFile: u AS u\n" in engine.explain("SELECT t.n FROM t AS t, u AS u WHERE (t.g = u.g) AND (t.n < 2 OR u.m > 15)") + "\n"


def test_small_tables_join_first(spark, sf):
    e = Engine(spark).view_parquet(sf("sf0.001"), ["lineitem", "orders", "customer"])
    plan = e.explain("SELECT c.c_name FROM lineitem AS l, orders AS o, customer AS c WHERE (l.l_orderkey = o.o_orderkey) AND (o.o_custkey = c.c_custkey)")
    assert plan.index("SelectFile: customer") < plan.index("SelectFile: lineitem") and plan.index("SelectFile: orders") < plan.index("SelectFile: lineitem")


def test_events(spark, engine, tmp_path):
    handler = events.to_file(str(tmp_path / "errorlog.txt"))
    try:
        engine.execute("CREATE TABLE ev (a INTEGER) AS HEAP")
        with pytest.raises(TableNotFound):
            engine.execute("DROP TABLE nowhere")
    finally:
        events.log.removeHandler(handler)
        handler.close()
    text = (tmp_path / "errorlog.txt").read_text()
    assert "INFO statement: CREATE TABLE ev (a INTEGER) AS HEAP" in text and "INFO table ev created as heap" in text and "ERROR TableNotFound: nowhere" in text


def test_small_files_survive_a_crash(spark, tmp_path):
    files, path = Files(spark), str(tmp_path / "about")
    assert files.current(path) is None
    files.replace(path, "one")
    files.replace(path, "two")
    assert files.current(path) == "two" and not files.exists(f"{path}.new")
    files.write(f"{path}.new", "three")
    files.delete(path)  # as a process that died before it renamed the new file leaves it
    assert files.current(path) == "three"


def test_delimited_text(spark, tmp_path, engine):
    (tmp_path / "t.tbl").write_text("x|1|2.5|\n|-3||\né|7|1e2|\n")
    engine.execute("CREATE TABLE t2 (s STRING, i INTEGER, d DOUBLE) AS HEAP")
    engine.execute(f"INSERT '{tmp_path}/t.tbl' INTO t2")
    assert vals(engine.table("t2")) == [("", -3, 0.0), ("x", 1, 2.5), ("é", 7, 100.0)]
    schema = engine.store.entry("t2").schema
    for bad in ("x|1|2.5\n", "x|1|\n", "x|1|2.5|9|\n", "x|1a|2.5|\n"):
        (tmp_path / "bad.tbl").write_text(bad)
        with pytest.raises(Exception):  # noqa: B017  Spark's own
            read_delimited(spark, str(tmp_path / "bad.tbl"), schema).collect()
    (tmp_path / "odd.tbl").write_text("x| 12ab|3.5e1z|\ny|q|.5.|\n")
    assert vals(read_delimited(spark, str(tmp_path / "odd.tbl"), schema, lenient=True)) == [("x", 12, 35.0), ("y", 0, 0.5)]
    assert vals(compose(spark, ["a|1|2|"], [("s", "String"), ("i", "Int"), ("d", "Double")])) == [("a", 1, 2.0)]


def test_output(spark, engine, tmp_path, capsys):
    engine.session_file = str(tmp_path / "session")
    text = "SELECT t.g, t.d FROM t AS t WHERE (t.n > 4)"
    assert engine.execute(text) == 2
    shown = capsys.readouterr().out
    assert "Project: t.g, t.d\n  SelectFile: t AS t; (t.n > 4)" in shown and "g: [c], d: [8]" in shown and "2 rows" in shown
    engine.execute("SET OUTPUT NONE")
    assert engine.execute(text) is None and "g: [" not in capsys.readouterr().out
    engine.execute(f"SET OUTPUT '{tmp_path}/out'")
    assert engine.execute(text) == 2
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ["g: [c], d: [1.000000]", "g: [c], d: [8.000000]"]
    assert Engine(spark, session_file=engine.session_file).session.output == f"{tmp_path}/out"
    assert Session.loads(Session("none", False).dumps()) == Session("none", False)
    assert write_rows(spark.createDataFrame([], "a int"), f"{tmp_path}/none") == 0
    assert show_rows(spark.createDataFrame([(1, "x")], "a int, b string")).first()[0] == "a: [1], b: [x]"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "bad.tbl").write_text("1|\nx|\n")
    statements = ["CREATE TABLE t (a INTEGER) AS HEAP\n", "\n", f"INSERT '{tmp_path}/bad.tbl' INTO t\n", "\n", "SELECT t.a\n", "FROM t AS t\n", "\n", "DROP TABLE u\n"]
    assert cli.main(str(tmp_path), statements) == 1
    out = capsys.readouterr()
    assert "0 rows" in out.out and "TableNotFound" in out.err and "CAST_INVALID_INPUT" in out.err


def test_catalog_text():
    text = "BEGIN\nt\nt.tbl\na Int\nb String\nEND\n\nBEGIN\nu\nu.tbl\nc Double\nEND\n"
    assert read_catalog(write_catalog(read_catalog(text))) == read_catalog(text)
    for bad in ("BEGIN\nt\nf\na Long\nEND", "BEGIN\nt\nf\na Int", "t\nf\nEND"):
        with pytest.raises(CatalogError):
            read_catalog(bad)


def test_operators(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "B")], "k int, v string")
    right = spark.createDataFrame([(2, 5.0), (2, 9.0), (3, 1.0)], "j int, w double")
    assert ops.join(left, right, "(k = j) AND (w > 6.0)").count() == 2
    assert ops.join(left, right).count() == 9
    assert "SortMergeJoin" in ops.join(left, right, "(k = j)", hint="merge")._jdf.queryExecution().executedPlan().toString()
    assert ops.join(left, right, "(k < j)").count() == 5
    assert vals(ops.select_pipe(left, "(v < 'a')")) == [(2, "B")]  # capitals come first, as bytes do
    assert vals(ops.sum_(ops.join(left, right, "(k = j)"), "w * k")) == [(56.0,)]
    assert vals(ops.group_by(left, ["k"], "k", once=True)) == [(1.0, 1), (2.0, 2)]
    assert [r.v for r in ops.sort(left, "(v)").collect()] == ["B", "a", "b"]
    assert ops.default_order(spark.createDataFrame([("x", 1.0, 2)], "s string, d double, i int")) == ["i", "d", "s"]
    assert ops.distinct(ops.project(left, ["k"])).count() == 2
    for call in (lambda: ops.project(left, ["z"]), lambda: ops.sort(left, ["z"]), lambda: ops.group_by(left, ["z"], "k"), lambda: ops.select_pipe(left, "(z = 1)")):
        with pytest.raises(ColumnNotFound):
            call()
