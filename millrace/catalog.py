"""Declared tables, kept as text: BEGIN, name, file, a line ``column Type`` each, END."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from .errors import CatalogError
from .types import Kind, spark_type


@dataclass
class Entry:
    name: str
    file: str
    columns: list[tuple[str, str]]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, spark_type(Kind(k)), False) for n, k in self.columns])


def read_catalog(text: str) -> dict[str, Entry]:
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    out, at = {}, 0
    while at < len(lines):
        try:
            end = lines.index("END", at)
        except ValueError:
            raise CatalogError("a table without END") from None
        if lines[at] != "BEGIN" or end < at + 3:
            raise CatalogError(f"BEGIN, a name and a file expected, not {lines[at]!r}")
        columns = []
        for line in lines[at + 3 : end]:
            name, _, kind = line.partition(" ")
            if kind.strip() not in (k.value for k in Kind):
                raise CatalogError(f"unknown type in {line!r}")
            columns.append((name, kind.strip()))
        entry = Entry(lines[at + 1], lines[at + 2], columns)
        out[entry.name] = entry
        at = end + 1
    return out


def write_catalog(entries: dict[str, Entry]) -> str:
    return "".join("\n".join(["BEGIN", e.name, e.file, *(f"{n} {k}" for n, k in e.columns), "END"]) + "\n\n" for e in entries.values())
