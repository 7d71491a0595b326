"""Mixing sources to target weights by temperature, as whole blocks and one part block of each source."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import quoted, stash, table

UNIT = 1 << 40  # places of a permutation
RANGES = 256  # into which a range of places is cut at a time
FEW = 50_000  # documents that one task puts in order


def temper(measure: Callable[[float], tuple[float, float]], max_repeats: float | None = None, target_entropy: float | None = None) -> float:
    """The smallest exponent in [0, 1] by which no source is read more than ``max_repeats`` times, or the largest by which
    the weights have at least ``target_entropy`` nats; found by bisection, as both fall or rise steadily with the exponent.

    ``measure`` gives both for an exponent. 0 reads all sources alike, 1 leaves their shares. A
    target that 0 does not reach gives 0.
    """
    if (max_repeats is None) == (target_entropy is None):
        raise ValueError("either max_repeats or target_entropy")
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        repeats, entropy = measure(mid)
        up = repeats > max_repeats if max_repeats is not None else entropy >= target_entropy
        low, high = (mid, high) if up else (low, mid)
    return high if max_repeats is not None else low


def measured(sources: DataFrame, total: int, by_entropy: bool) -> Callable[[float], tuple[float, float]]:
    """For an exponent, how often the source read most is read if the one read least is read once, and the weights' entropy.

    ``sources`` has a number of tokens n each. Weights go as n to the exponent, so reads go as n to
    the exponent less one: the smallest and the largest source say all about them. Entropy
    takes sums over the sources, made by Spark: on the driver there are a few numbers.
    """
    few, many = sources.where("n > 0").agg(F.min("n"), F.max("n")).first()

    def measure(exponent: float) -> tuple[float, float]:
        repeats = (many / few) ** (1 - exponent)
        if not by_entropy:
            return repeats, 0.0
        share = F.col("n") / total
        z, y = sources.where("n > 0").agg(F.sum(F.pow(share, F.lit(exponent))), F.sum(F.pow(share, F.lit(exponent)) * F.log(share))).first()
        return repeats, math.log(z) - exponent * y / z

    return measure


def token_count(text):
    """A document's measure: its white-space characters and one, 0 for an empty or null text."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.translate(t, " \n\r\t\x0b\x0c", "")) + 1).cast("long")


def _with(df: DataFrame, plan: DataFrame, on: list[str], many: bool, most: int) -> DataFrame:
    """``df`` with what ``plan`` says of its source.

    The ``most`` sources with most tokens are broadcast. Where there are more, no other has a
    share over 1 / ``most``, and they meet their documents in a join.
    """
    if not many:
        return df.join(F.broadcast(plan), on)
    large, small = plan.where("_millrace_large").drop("_millrace_large"), plan.where("NOT _millrace_large").drop("_millrace_large")
    return df.join(F.broadcast(large), on).unionByName(df.join(small, on))


def mix(documents: DataFrame, max_repeats: float | None = None, target_entropy: float | None = None, seed: int = 11, most_sources: int = 10_000) -> DataFrame:
    """``documents``, each row as often as its source's budget reads it, with mix_tokens, mix_weight, mix_block and mix_place.

    A source's budget is its weight's part of the whole, which is as large as it takes for
    every source to be read at least once: no document is dropped. The budget is realised as
    blocks, each a permutation of the source's documents by a hash of the id and the block's
    number; the last block ends where the budget does. ``mix_place`` is from 0 to 1 and orders
    the whole: any stretch of it holds the sources in about their weights.

    Where the last block ends is found from token counts in 256 ranges of the hash, then in 256
    parts of that range, and so on until a range has so few documents that they can be put in
    order; so no source, however large, meets in a task. What is left to do for a row needs no
    other row: texts are not shuffled, but for those of sources beyond the ``most_sources`` largest,
    where there are so many. The driver holds a few numbers, whatever the number of sources.

    Nulls: a null source is a source of its own; a null text counts 0 tokens; sources
    without tokens are read once. Rows with equal doc_id and source share their places, and
    the last block takes all or none of them. Columns of the names given above are replaced.
    An empty table gives no rows.
    """
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    shown = lambda block: F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), source, F.lit(seed), block), F.lit(UNIT))
    narrow = stash(documents.select(F.col("doc_id"), F.col("source"), token_count(F.col("text").cast("string")).alias("mix_tokens")), "mix")
    sources = stash(narrow.groupBy(source.alias("_millrace_key")).agg(F.sum("mix_tokens").alias("n")), "mix-sources")
    number, total, largest = sources.agg(F.count("*"), F.sum("n"), F.max("n")).first()
    exponent = temper(measured(sources, total, target_entropy is not None), max_repeats, target_entropy) if total else temper(lambda e: (1.0, 0.0), max_repeats, target_entropy)

    raised = F.pow(F.col("n") / max(1, total or 1), F.lit(exponent))
    norm = sources.where("n > 0").agg(F.sum(raised)).first()[0] or 1.0
    plan = sources.withColumn("mix_weight", F.when(F.col("n") > 0, raised / norm).otherwise(0.0))
    plan = plan.withColumn("_millrace_often", F.when(F.col("n") > 0, F.pow(largest / F.col("n"), F.lit(1 - exponent))).otherwise(1.0))
    plan = plan.withColumn("_millrace_whole", F.floor(F.col("_millrace_often") + 1e-9).cast("int"))
    plan = plan.withColumn("rest", F.floor(F.greatest(F.lit(0.0), F.col("_millrace_often") - F.col("_millrace_whole")) * F.col("n")).cast("long"))
    many = number > most_sources
    if many:
        least = plan.orderBy(F.desc("n"), "_millrace_key").select("n", "_millrace_key").offset(most_sources - 1).first()
        plan = plan.withColumn("_millrace_large", (F.col("n") > least.n) | (F.col("n") == least.n) & (F.col("_millrace_key") <= least["_millrace_key"]))
    plan = stash(plan, "mix-plan")

    # ends: of the last block of each source, the range of places in which its budget ends, and the tokens before that range
    kept = [c for c in ("_millrace_key", "_millrace_whole", "rest", "_millrace_large") if c in plan.columns]
    last = _with(narrow.select(source.alias("_millrace_key"), "doc_id", "source", "mix_tokens"), plan.where("rest > 0").select(*kept), ["_millrace_key"], many, most_sources)
    last = stash(last.select("_millrace_key", "rest", shown(F.col("_millrace_whole")).alias("at"), "mix_tokens"), "mix-last")
    flags = [F.lit(True).alias("_millrace_large")] if not many else ["_millrace_large"]
    ends, width, within = plan.where("rest > 0").select("_millrace_key", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("before"), *flags), UNIT, last.count()
    while within > FEW and width > 1:
        met = _with(last, ends if many else ends.drop("_millrace_large"), ["_millrace_key"], many, most_sources).where(f"at >= low AND at < low + {width}")
        width = max(1, width // RANGES)
        sums = met.groupBy("_millrace_key", "rest", "before", F.expr(f"low + (at - low) div {width} * {width}").alias("low")).agg(F.sum("mix_tokens").alias("n"), F.count("*").alias("rows"))
        upto = F.col("before") + F.sum("n").over(Window.partitionBy("_millrace_key").orderBy("low"))  # RANGES rows
        found = sums.withColumn("upto", upto).where("upto > rest").groupBy("_millrace_key").agg(F.min_by(F.struct("low", (F.col("upto") - F.col("n")).alias("before"), "rows"), "low").alias("e")).select("_millrace_key", "e.*")
        ends = stash(found.join(plan.select("_millrace_key", *flags), "_millrace_key"), "mix-ends")
        within = ends.agg(F.coalesce(F.max("rows"), F.lit(0))).first()[0]
        ends = ends.drop("rows")
    met = _with(last, ends if many else ends.drop("_millrace_large"), ["_millrace_key"], many, most_sources).where(f"at >= low AND at < low + {width}")
    near = met.groupBy("_millrace_key", "at", "rest", "before").agg(F.sum("mix_tokens").alias("n"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("_millrace_key").orderBy("at"))
    stop = near.withColumn("upto", upto).where("upto > rest").groupBy("_millrace_key").agg(F.min("at").alias("stop"))

    told = plan.join(stop, "_millrace_key", "left").withColumn("_millrace_end", F.when(F.col("rest") > 0, F.coalesce("stop", F.lit(UNIT))).otherwise(F.lit(0)))
    told = stash(told.drop("n", "rest", "stop"), "mix-told")
    names = [c for c in documents.columns if c not in ("mix_tokens", "mix_weight", "mix_block", "mix_place")]
    rows = _with(documents.select(*(quoted(c) for c in names), source.alias("_millrace_key"), token_count(F.col("text").cast("string")).alias("mix_tokens")), told, ["_millrace_key"], many, most_sources)
    blocks = F.sequence(F.lit(0), F.col("_millrace_whole") - F.when(shown(F.col("_millrace_whole")) < F.col("_millrace_end"), 0).otherwise(1))
    rows = rows.withColumn("mix_block", F.explode(blocks))
    # the last block's places are dealt out over what is left of its budget
    part = F.when((F.col("mix_block") == F.col("_millrace_whole")) & (F.col("_millrace_end") > 0), F.col("_millrace_end")).otherwise(UNIT)
    length = F.when(F.col("mix_block") == F.col("_millrace_whole"), F.col("_millrace_often") - F.col("_millrace_whole")).otherwise(1.0)
    place = (F.col("mix_block") + shown(F.col("mix_block")) / part * length) / F.col("_millrace_often")
    return rows.withColumn("mix_place", place).select(*(quoted(c) for c in names), "mix_tokens", "mix_weight", "mix_block", "mix_place")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source at most twice."""
    return mix(table(spark, sf_dir, "documents"), max_repeats=2.0).select("doc_id", "source", "mix_tokens", "mix_weight", "mix_block", "mix_place")
