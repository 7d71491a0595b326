"""Stored tables: heaps take rows as they come, sorted tables keep them in runs that are each in order. Both are Parquet."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..catalog import Entry, read_catalog, write_catalog
from ..errors import SortColumnsMismatch, TableExists, TableNotFound, TypeMismatch, UnsupportedFileType
from ..events import log
from .files import Files
from .text import read_delimited

TIER = 4  # runs of about one size that are merged into one


class TableStore:
    """Tables in a folder: a catalog and, for each table, its kind, its sort keys and its runs.

    A heap is one run to which files are added. A sorted table is a list of runs, each ordered and
    split by ranges of its keys; an append sorts only what it adds. When ``TIER`` runs of about one
    size have come together they are merged, so a row is written anew as often as the table
    has grown by that factor, and not at every append. Whatever replaces rows writes new
    folders first; then the small file that names the current ones is swapped, so a failed job
    leaves the table as it was.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self.files.make(self.root)

    @property
    def catalog(self) -> dict[str, Entry]:
        return read_catalog(self.files.current(f"{self.root}/catalog") or "")

    def _save(self, entries: dict[str, Entry]) -> None:
        self.files.replace(f"{self.root}/catalog", write_catalog(entries))

    def entry(self, name: str) -> Entry:
        entries = self.catalog
        if name not in entries:
            raise TableNotFound(name)
        return entries[name]

    def _about(self, name: str) -> dict:
        self.entry(name)
        return json.loads(self.files.current(f"{self.root}/{name}/about.json"))

    def kind(self, name: str) -> str:
        return self._about(name)["kind"]

    def sort_keys(self, name: str) -> list[str]:
        return self._about(name)["keys"]

    def create(self, name: str, columns: list[tuple[str, str]], kind: str = "heap", keys: list[str] | None = None) -> None:
        """Declare a table. Everything is checked before anything is written."""
        entries = self.catalog
        if name in entries:
            raise TableExists(name)
        if kind not in ("heap", "sorted"):
            raise UnsupportedFileType(kind)
        if kind == "sorted" and (not keys or set(keys) - {c for c, _ in columns}):
            raise SortColumnsMismatch(f"{keys} of {name}")
        entry, runs = Entry(name, name, columns), []
        if kind == "heap":
            runs = [{"rows": f"rows-{uuid.uuid4().hex}"}]
            self.spark.createDataFrame([], entry.schema).write.parquet(f"{self.root}/{name}/{runs[0]['rows']}")
        self.files.replace(f"{self.root}/{name}/about.json", json.dumps({"kind": kind, "keys": keys or [], "runs": runs}))
        self._save(entries | {name: entry})
        log.info("table %s created as %s", name, kind)

    def drop(self, name: str) -> None:
        entries = self.catalog
        if name not in entries:
            raise TableNotFound(name)
        del entries[name]
        self._save(entries)
        self.files.delete(f"{self.root}/{name}")
        log.info("table %s dropped", name)

    def _rows(self, name: str, runs: list[dict]) -> DataFrame:
        schema = self.entry(name).schema
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{r['rows']}") for r in runs]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def scan(self, name: str, ordered: bool = True) -> DataFrame:
        """A table's rows; of a sorted one in order, unless ``ordered`` is off (Spark promises no order over several files)."""
        about = self._about(name)
        rows = self._rows(name, about["runs"])
        return rows.sort(*about["keys"]) if about["keys"] and ordered else rows

    def lookup(self, name: str, **values) -> DataFrame:
        """Rows with these values. Runs of a sorted table whose range of the first key leaves a value out are not opened; within
        the others the scan skips what Parquet's statistics rule out, as rows with equal leading keys lie together."""
        about = self._about(name)
        runs, first = about["runs"], (about["keys"] or [None])[0]
        if first in values:
            runs = [r for r in runs if r["low"] is None or r["low"] <= values[first] <= r["high"]]
        rows = self._rows(name, runs)
        for c, v in values.items():
            rows = rows.where(F.col(c) == F.lit(v))
        return rows

    def _run(self, name: str, rows: DataFrame, keys: list[str]) -> dict:
        """Rows written in order as a new run, with their number and the range of their first key."""
        at, seen, first = f"rows-{uuid.uuid4().hex}", Observation(), F.col(keys[0])
        # above the sort, whose sampling reads what is below it once more
        rows.sort(*keys).observe(seen, F.count(F.lit(1)).alias("n"), F.min(first).alias("low"), F.max(first).alias("high")).write.parquet(f"{self.root}/{name}/{at}")
        got = seen.get
        return {"rows": at, "n": got["n"], "low": got["low"], "high": got["high"]}

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows: as new files of a heap, as a new run of a sorted table, which is merged with others of its size if there are enough."""
        entry, about = self.entry(name), self._about(name)
        if rows.columns != [c for c, _ in entry.columns]:
            raise TypeMismatch(f"{name} has columns {[c for c, _ in entry.columns]}, not {rows.columns}")
        rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in entry.schema))
        if about["kind"] == "heap":
            rows.write.mode("append").parquet(f"{self.root}/{name}/{about['runs'][0]['rows']}")
            return
        run = self._run(name, rows, about["keys"])
        runs, old = [*about["runs"], run] if run["n"] else about["runs"], [] if run["n"] else [run]
        size = lambda r: len(str(r["n"]))
        while len(same := [r for r in runs if size(r) <= size(runs[-1])] if runs else []) >= TIER:
            merged = self._run(name, self._rows(name, same), about["keys"])
            old += same
            runs = [r for r in runs if r not in same] + [merged]
        self.files.replace(f"{self.root}/{name}/about.json", json.dumps(about | {"runs": runs}))
        for r in old:
            self.files.delete(f"{self.root}/{name}/{r['rows']}")
        log.info("table %s has %d runs", name, len(runs))

    def load(self, name: str, file: str, lenient: bool = False) -> None:
        """Add the rows of a delimited text file."""
        self.append(name, read_delimited(self.spark, file, self.entry(name).schema, lenient))
