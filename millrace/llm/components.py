"""Connected components by alternating stars (Kiveris et al., 2014), on links of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def least_of(links: DataFrame) -> DataFrame:
    """(u, m): the smallest neighbour of each u.

    They are grouped by one more column, always 0, so that a join deals them by u once more:
    adaptive execution splits a hub's links only if both sides come straight from a shuffle.
    """
    return links.groupBy("u", F.expr("u % 1").alias("_millrace_zero")).agg(F.min("v").alias("m")).drop("_millrace_zero")


def components(links: DataFrame, rounds: int = 60, files: int | None = None) -> DataFrame:
    """(node, component) for every node of ``links`` (columns u, v: long); a component is named by its smallest node.

    Each round makes every node point to the smallest node it knows of, first for the
    larger neighbours, then for the smaller ones. Minima are gathered before rows are
    shuffled, and a hub's links meet its minimum in a plain sort-merge join, which
    adaptive execution can split. Only two numbers a round reach the driver.
    Loops and nulls are left out; repeated links count once. ``files`` bounds the files that a
    round writes, as for ``cut``.
    """
    e = cut(links.where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct(), files)
    seen = None
    for _ in range(rounds):
        mark = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        both = e.union(e.select("v", "u"))
        least = least_of(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(least_of(large), "u")
        e = cut(small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct(), files)
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
