import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names operators use themselves."""

    def make(rows):
        rows = [(r[0], r[1], r[2] if len(r) > 2 else "s") for r in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        return df.selectExpr("doc_id", "text", "'en' AS lang", "source", "CAST(length(text) AS BIGINT) AS n_chars", "1 AS score", "2 AS component", "3 AS head", "4 AS n", "5 AS x", "6 AS shard", "7 AS label_id", "8 AS node")

    return make
