"""Delimited text in, and rows as text out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import LoadError
from ..types import Kind, kind_of


def _number(part: Column, kind: Kind, lenient: bool) -> Column:
    to = "bigint" if kind is Kind.INT else "double"
    if lenient:  # as much of the start as is a number, else 0
        rule = r"^\s*([+-]?\d+)" if kind is Kind.INT else r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
        part = F.regexp_extract(part, rule, 1)
    return F.when(F.trim(part) == "", F.lit(0).cast(to)).otherwise(part.cast(to))


def split_rows(lines: DataFrame, schema: T.StructType, lenient: bool = False) -> DataFrame:
    """Rows of lines (a column ``value``) whose fields each end in ``|``. There are no quotes, escapes or nulls.

    A line with another number of fields stops the job. An empty number is 0; other text
    that is no number stops the job, or counts as far as it is one if ``lenient``.
    """
    n = len(schema)
    parts = F.split("value", r"\|", -1)
    good = (F.size(parts) == n + 1) & (parts[n] == "")
    checked = lines.select(F.when(good, parts).otherwise(F.raise_error(F.concat(F.lit(f"a row needs {n} fields that end in |: "), F.substring("value", 1, 200))).cast("array<string>")).alias("parts"))
    out = []
    for i, f in enumerate(schema):
        kind, part = kind_of(f.dataType), F.col("parts")[i]
        out.append((part if kind is Kind.STRING else _number(part, kind, lenient)).alias(f.name))
    return checked.select(*out)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, lenient: bool = False) -> DataFrame:
    """A text file, or a folder of them, as rows (split_rows). A row cut off before its last ``|`` is an error."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise LoadError(path)
    return split_rows(spark.read.text(path), schema, lenient)


def show_rows(df: DataFrame) -> DataFrame:
    """Each row as one line, ``name: [value], name: [value]``; Doubles with six decimals."""
    parts = []
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), kind_of(f.dataType)
        shown = F.format_string("%f", c.cast("double")) if kind is Kind.DOUBLE else F.date_format(c, "yyyy-MM-dd") if not isinstance(f.dataType, T.StringType) and kind is Kind.STRING else c.cast("string")
        parts += [F.lit((", " if parts else "") + f"{f.name}: ["), F.coalesce(shown, F.lit("")), F.lit("]")]
    return df.select(F.concat(*parts).alias("value"))


def write_rows(df: DataFrame, path: str) -> int:
    """Write rows as text (show_rows), a file a task, and return how many; they are counted as they are written."""
    seen = Observation()
    show_rows(df).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").text(path)
    return seen.get["rows"]
