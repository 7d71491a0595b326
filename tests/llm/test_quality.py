import zlib

import numpy as np
import pytest

from millrace.llm.quality import STATS, WORDS, Machine, features, fit, learn, op9_quality, quality, score


def test_held_out_accuracy(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(sf("sf0.01") + "/labels.parquet").collect()}
    rows = op9_quality(spark, sf("sf0.01")).collect()
    assert len(rows) == spark.read.parquet(sf("sf0.01") + "/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == q for p, q, _ in held]) > 0.95
    good, bad = ([s for _, q, s in held if q == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_held_out_labels_change_nothing(spark, docs):
    rows = [(i, "good text of words here." if i % 2 else "BAD!! JUNK!! $$$ ###") for i in range(60)]
    labels = lambda flip: spark.createDataFrame([(i, int(i % 2 ^ (flip and zlib.crc32(str(i).encode()) % 3 == 1))) for i in range(60)], "doc_id long, quality int")
    a, b = ({r.doc_id: r.score for r in quality(docs(rows), labels(f)).collect()} for f in (False, True))
    assert a == b and all((s >= 0.5) == (i % 2) for i, s in a.items())


def test_labelled_documents_that_repeat(spark, docs):
    """Of rows that share an id one is learnt from, however many there are."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2, "doc_id long, quality int")
    rows = [(i, "good text of words here." if i % 2 else "BAD!! JUNK!! $$$ ###") for i in range(40)]
    once, often = learn(docs(rows), labels), learn(docs(rows + rows[:2] * 50), labels)
    assert once.bias == often.bias and (once.w == often.w).all() and (once.v == often.v).all()


def test_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (3, 7), (None, 1), (99, 0)], "doc_id long, quality int")
    rows = [(1, "fine words."), (2, None), (3, ""), (None, "x"), (4, "word " * 100_000), (1, "fine words.")]
    got = quality(docs(rows), labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    none = quality(docs(rows), labels.limit(0)).collect()
    assert all(r.score == pytest.approx(0.5) for r in none)
    assert quality(docs([]), labels).count() == 0
    df = docs(rows)
    assert score(df, learn(df, labels), "_s").columns == [*df.columns, "_s"] and score(df, learn(df, labels)).columns.count("score") == 1


def test_pairs_in_linear_time():
    rng = np.random.default_rng(0)
    wide = WORDS + len(STATS)
    m = Machine(0.3, rng.normal(size=wide), rng.normal(size=(wide, 3)) * 0.1, np.zeros(len(STATS)), np.ones(len(STATS)))
    x = features(["Some few words.", "other | THING 12", None])
    z = m.scaled(x)
    for row, s in zip(z, m.score(x), strict=True):
        at = np.flatnonzero(row)
        pairs = sum(m.v[i] @ m.v[j] * row[i] * row[j] for k, i in enumerate(at) for j in at[k + 1 :])
        assert s == pytest.approx(1 / (1 + np.exp(-(m.bias + row @ m.w + pairs))))


def test_fit_learns_a_pair():
    rng = np.random.default_rng(1)
    x = np.zeros((1500, WORDS + len(STATS)))
    x[:, :2] = rng.choice([-1.0, 1.0], (1500, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    assert ((fit(x, y, epochs=40).score(x) >= 0.5) == y).mean() > 0.98
