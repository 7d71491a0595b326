import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TESTDATA = os.environ.get("MILLRACE_TESTDATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .config("spark.checkpoint.dir", str(shared))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """Runs SQL on a folder's tables and gives rows as sorted tuples of named columns."""
    import duckdb

    def run(sf: str, sql: str):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TESTDATA}/{sf}/{t}.parquet'")
        got = con.execute(sql)
        return rows([d[0] for d in got.description], got.fetchall())

    return run


def rows(names, values):
    """Rows in an order that does not depend on how they came, each with its columns by name."""
    at = sorted(range(len(names)), key=lambda i: names[i])
    return [tuple(sorted(names))] + sorted((tuple(r[i] for i in at) for r in values), key=repr)


@pytest.fixture(scope="session")
def got():
    return lambda df: rows(df.columns, [tuple(r) for r in df.collect()])


@pytest.fixture(scope="session")
def sf():
    return lambda name: f"{TESTDATA}/{name}"
