"""Statements from standard input, each ended by a blank line or the end: ``python -m millrace.cli FOLDER``."""

from __future__ import annotations

import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .errors import MillraceError
from .session import Engine


def statements(lines):
    held: list[str] = []
    for line in lines:
        if line.strip():
            held.append(line)
        elif held:
            yield "".join(held)
            held = []
    if held:
        yield "".join(held)


def main(folder: str, source=sys.stdin) -> int:
    engine, failed = Engine(SparkSession.builder.getOrCreate(), folder, session_file=f"{folder}/session"), 0
    for text in statements(source):
        try:
            engine.execute(text)
        except (MillraceError, PySparkException) as e:  # also what Spark finds wrong in rows
            print(f"{type(e).__name__}: {str(e)[:2000]}", file=sys.stderr)
            failed = 1
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1]))
