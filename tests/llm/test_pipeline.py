from collections import Counter

import numpy as np
import pytest
import test_minhash
import test_mixing
import test_packing
import tokenizers

import corpus_pipeline as cp
from millrace.llm.common import stash
from millrace.llm.minhash import near_documents
from millrace.llm.mixing import mix
from millrace.llm.packing import default_tokenizer
from millrace.llm.quality import features, learn, score


def test_stages(spark, sf):
    where = sf("sf0.001")
    docs = spark.read.parquet(where + "/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality classifier", "MinHash near-dedup", "mixing sources", "best-fit packing"]
    quality, dedup, mixing, packing = (f for _, f in cp.STAGES)
    good = quality(spark, docs, where)
    labels = spark.read.parquet(where + "/labels.parquet")
    kept = {r.doc_id for r in score(docs, learn(docs, labels)).collect() if r.score >= 0.5}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == kept and len(kept) < docs.count()
    once = dedup(spark, good, where)
    assert once.columns == docs.columns and {r.doc_id for r in once.collect()} == {r.doc_id for r in near_documents(good).collect() if r.kept}
    mixed = mixing(spark, once, where)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == {r.doc_id for r in once.collect()}
    rows = packing(spark, mixed, where).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in mixed.collect()} and sum(r.piece == 0 for r in rows) == mixed.count()
    assert sorted(map(str, cp.run(spark, where).select("doc_id", "piece", "ids_crc32").collect())) == sorted(f"Row(doc_id={r.doc_id}, piece={r.piece}, ids_crc32={r.ids_crc32})" for r in rows)


def test_against_plain_versions(spark, sf):
    """Each stage against a version without Spark: scores pair by pair, all pairs of shingle sets, scanned exponents, the tokenizer itself."""
    where = sf("sf0.001")
    docs = spark.read.parquet(where + "/documents.parquet")
    every = {r.doc_id: r for r in docs.collect()}
    quality, dedup, mixing, packing = (f for _, f in cp.STAGES)
    machine = learn(docs, spark.read.parquet(where + "/labels.parquet"))

    def plain_score(text):
        (x,) = machine.scaled(features([text]))
        at = np.flatnonzero(x)
        pairs = sum(machine.v[i] @ machine.v[j] * x[i] * x[j] for k, i in enumerate(at) for j in at[k + 1 :])
        return machine.bias + x @ machine.w + pairs

    good = stash(quality(spark, docs, where), "t")
    kept = {r.doc_id for r in good.collect()}
    some = sorted(every)[::10]
    assert {i for i in some if plain_score(every[i].text) >= 0} == kept & set(some)
    once = stash(dedup(spark, good, where), "t")
    told = test_minhash.plain([(i, every[i].text) for i in kept])
    assert {r.doc_id for r in once.collect()} == {i for i, x in told.items() if x[2]}
    mixed = mixing(spark, once, where).collect()
    rows = [(r.doc_id, r.text, r.source) for r in once.collect()]
    test_mixing.check(mix(once, max_repeats=2.0).collect(), rows, max_repeats=2.0)
    assert Counter(r.doc_id for r in mixed) == Counter(r.doc_id for r in mix(once, max_repeats=2.0).select("doc_id").collect())
    t = tokenizers.Tokenizer.from_file(default_tokenizer())
    ids = lambda texts: [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    packed = packing(spark, spark.createDataFrame(mixed, docs.schema), where).collect()
    assert test_packing.check(packed, [(r.doc_id, r.text) for r in mixed], ids) == test_packing.one_by_one([r.length for r in packed], 1024)


def test_names_with_signs_in_them(spark, sf):
    where = sf("sf0.001")
    docs = spark.read.parquet(where + "/documents.parquet").limit(60).selectExpr("CAST(doc_id AS INT) AS doc_id", "text", "source", "lang", "n_chars", "1 AS `a.b`", "2 AS `c``d`", "3 AS mix_block2")
    for _, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, where)
        assert got.columns == docs.columns and 0 < got.count()


def test_stages_of_nothing(spark, sf):
    where = sf("sf0.001")
    for _, stage in cp.STAGES:
        assert stage(spark, spark.read.parquet(where + "/documents.parquet").limit(0), where).count() == 0


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))


@pytest.mark.parametrize("missing", ["corpus_pipeline", "millrace.llm"])
def test_the_rest_stands_alone(missing):
    import subprocess
    import sys

    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; assert 'group_by_3' in e.queries() and 'pipeline' not in e.queries(); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=cp.__file__.rpartition("/")[0])
