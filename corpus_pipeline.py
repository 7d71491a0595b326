"""A training corpus from ``documents``: quality, near copies, mixture, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import quoted, stash, table
from millrace.llm.minhash import drop_near_copies
from millrace.llm.mixing import mix
from millrace.llm.packing import default_tokenizer, pack
from millrace.llm.quality import learn, score


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more; it learns from labels outside the held-out third.

    A null or empty text is scored like any other. Rows that repeat are judged alike. Without
    labels all scores are 0.5 and all stay. An empty table gives no rows. Further columns, of
    any name, stay as they are; so they do in the next two stages.
    """
    machine = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, machine, "_millrace_score").where(F.col("_millrace_score") >= 0.5).select(*map(quoted, docs.columns))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id.

    Documents with 0.75 or more of their 5-word shingles in common are linked, and links add up
    to groups. Texts that are null, empty or blank are nobody's copies and stay, as do rows
    without an id. Rows that share an id share its fate. An empty table gives no rows.
    """
    return drop_near_copies(docs).select(*map(quoted, docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once or more, so that sources come near equal weights without any being read more than twice.

    A null source is a source of its own. Null and empty texts count 0 tokens and are read with
    their source; a source without tokens is read once. Rows with equal id and source are read
    as often as each other. An empty table gives no rows.
    """
    return mix(docs, max_repeats=2.0).select(*map(quoted, docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 1024 tokens.

    A null or empty text is the one token 2. Each row is packed, also where ids are null or
    repeat; pieces of one length may change places. An empty table gives no rows.
    """
    return pack(docs, default_tokenizer(), capacity=1024, end=2)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", dedup_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]
#: A model's scores and tokenizers are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
