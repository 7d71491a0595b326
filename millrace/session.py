"""Statements against stored tables and views: queries, definitions, loading, and where rows go."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .errors import InvalidQuery, MillraceError, TableNotFound
from .events import log
from .plans.planner import Node, plan
from .plans.syntax import CreateTable, DropTable, Insert, Select, SetOutput, parse
from .sources.files import Files
from .sources.store import TableStore
from .sources.text import write_rows
from .stats import Statistics
from .types import Kind, spark_type


def compose(spark: SparkSession, lines: Iterable[str], columns: list[tuple[str, str]], lenient: bool = False) -> DataFrame:
    """Rows from text in memory, whose fields each end in ``|``."""
    from .sources.text import split_rows

    schema = T.StructType([T.StructField(n, spark_type(Kind(k)), False) for n, k in columns])
    return split_rows(spark.createDataFrame([(x,) for x in lines], "value string"), schema, lenient)


@dataclass
class Session:
    """Where rows go: ``stdout``, ``none`` (plans only), or the folder of a text file."""

    output: str = "stdout"
    execute: bool = True
    show_plan: bool = True

    def dumps(self) -> str:
        return f"{int(self.show_plan)}\n{int(self.execute)}\n{'NONE' if self.output in ('stdout', 'none') else self.output}\n"

    @classmethod
    def loads(cls, text: str) -> Session:
        show, run, to = (text.splitlines() + ["1", "1", "NONE"])[:3]
        return cls(to if to != "NONE" else "stdout" if run.strip() == "1" else "none", run.strip() == "1", show.strip() == "1")


class Engine:
    """Runs statements. ``sql`` gives a SELECT's DataFrame; ``execute`` runs any statement and sends rows where the session says."""

    def __init__(self, spark: SparkSession, root: str | None = None, statistics: Statistics | None = None, strict_types: bool = False, session_file: str | None = None, lenient_load: bool = False):
        self.spark, self.statistics, self.strict, self.lenient = spark, statistics, strict_types, lenient_load
        self.store = TableStore(spark, root) if root else None
        self.views: dict[str, DataFrame] = {}
        self.files: dict[str, str] = {}
        self.session_file = session_file
        kept = Files(spark).current(session_file) if session_file else None
        self.session = Session() if kept is None else Session.loads(kept)

    def view(self, name: str, df: DataFrame) -> None:
        """Make a DataFrame a table of this engine."""
        self.views[name] = df

    def view_parquet(self, folder: str, names: Iterable[str]) -> Engine:
        """Make Parquet files tables of this engine; a file is opened when a query first names it."""
        for n in names:
            self.views.pop(n, None)
            self.files[n] = f"{folder}/{n}.parquet"
        return self

    def table(self, name: str) -> DataFrame:
        if name not in self.views and name in self.files:
            self.views[name] = self.spark.read.parquet(self.files[name])
        if name in self.views:
            return self.views[name]
        if self.store:
            return self.store.scan(name, ordered=False)
        raise TableNotFound(name)

    def _planned(self, q: Select) -> tuple[DataFrame, Node]:
        names = {name for name, _ in q.tables}
        keys = {n: self.store.sort_keys(n) for n in names if n not in self.views and n not in self.files} if self.store else {}
        return plan(q, {n: self.table(n) for n in names}, self.statistics, self.strict, keys, self.store.lookup if self.store else None)

    def _select(self, text: str) -> Select:
        q = parse(text)
        if not isinstance(q, Select):
            raise InvalidQuery("no SELECT")
        return q

    def sql(self, text: str) -> DataFrame:
        return self._planned(self._select(text))[0]

    def explain(self, text: str) -> str:
        """The plan of a SELECT, without running it."""
        return str(self._planned(self._select(text))[1])

    def _stored(self) -> TableStore:
        if not self.store:
            raise InvalidQuery("this engine has no folder for tables")
        return self.store

    def execute(self, text: str, say=print) -> int | None:
        """Run one statement. A SELECT returns how many rows it gave, or None if it only showed its plan."""
        log.info("statement: %s", " ".join(text.split()))
        try:
            return self._execute(text, say)
        except MillraceError as e:
            log.error("%s: %s", type(e).__name__, e)
            raise

    def _execute(self, text: str, say) -> int | None:
        match parse(text):
            case CreateTable(name, columns, keys):
                self._stored().create(name, columns, "heap" if keys is None else "sorted", keys)
            case Insert(file, name):
                self._stored().load(name, file, self.lenient)
            case DropTable(name):
                self._stored().drop(name)
            case SetOutput(target, file):
                self.session = Session(target, True, True) if file else Session("stdout") if target == "STDOUT" else Session("none", False)
                if self.session_file:
                    Files(self.spark).replace(self.session_file, self.session.dumps())
            case Select() as q:
                df, node = self._planned(q)
                if self.session.show_plan:
                    say(str(node if self.session.output in ("stdout", "none") else Node("WriteOut", [self.session.output], [node])))
                if not self.session.execute:
                    return None
                if self.session.output != "stdout":
                    return write_rows(df, self.session.output)
                return self._print(df, say)
        return None

    def _print(self, df: DataFrame, say) -> int:
        """Rows on the screen, a partition at a time; Doubles with six significant digits."""
        n = 0
        for row in df.toLocalIterator():
            say(", ".join(f"{c}: [{v:g}]" if isinstance(v, float) else f"{c}: [{v}]" for c, v in row.asDict().items()))
            n += 1
        say(f"{n} rows")
        return n
