import math
import random
from collections import defaultdict

import pytest

from millrace.llm import mixing
from millrace.llm.mixing import measured, mix, op1_mix_sources, temper


def count(text):
    return 0 if not text else sum(c in " \n\r\t\x0b\x0c" for c in text) + 1


def shares(tokens, exponent):
    """Weights as they are defined."""
    raised = {s: n**exponent if n else 0 for s, n in tokens.items()}
    return {s: r / (sum(raised.values()) or 1) for s, r in raised.items()}


def reads(tokens, w):
    """How often each source is read if none is read less than once: budgets in the weights' proportion, over the tokens."""
    whole = max((n / w[s] for s, n in tokens.items() if n), default=1)
    return {s: whole * w[s] / n if n else 1 for s, n in tokens.items()}


def entropy(w):
    return -sum(x * math.log(x) for x in w.values() if x)


def scan(tokens, good):
    """The exponent at which ``good`` turns, by trying a fine grid."""
    return next((k / 20000 for k in range(20001) if good(shares(tokens, k / 20000))), 1.0)


def sources(spark, tokens):
    return spark.createDataFrame(list(tokens.items()), "key string, n long")


def test_exponent_meets_the_target(spark):
    tokens = {"a": 10_000, "b": 500, "c": 40, "none": 0}
    find = lambda **target: temper(measured(sources(spark, tokens), sum(tokens.values()), "target_entropy" in target), **target)
    for most in (1.0, 1.5, 2.0, 7.0, 1e9):
        want = scan(tokens, lambda w: max(reads(tokens, w).values()) <= most + 1e-9)
        assert find(max_repeats=most) == pytest.approx(want, abs=1e-4)
    for target in (0.3, 0.9, 1.0, 99.0, 0.0):
        want = scan(tokens, lambda w: entropy(w) < target)
        assert find(target_entropy=target) == pytest.approx(want, abs=1e-4)
    for wrong in ({}, {"max_repeats": 2, "target_entropy": 1}):
        with pytest.raises(ValueError):
            temper(lambda e: (1.0, 1.0), **wrong)


def corpus():
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randint(1, 40))), "big") for i in range(900)]
    rows += [(1000 + i, "a b\nc" * rng.randint(1, 9), "mid") for i in range(150)]
    rows += [(2000 + i, "x y", "small") for i in range(20)]
    return rows


def check(got, rows, **target):
    """Weights and reads as scanning the exponents gives them; whole blocks, and of the last block the documents in the order
    of its places as long as they fit the budget."""
    tokens, size = defaultdict(int), {}
    for i, t, s in rows:
        tokens[s] += count(t)
        size[i] = count(t)
    if "max_repeats" in target:
        few, many = min(n for n in tokens.values() if n), max(tokens.values())
        exponent = max(0.0, 1 - math.log(target["max_repeats"]) / math.log(many / few)) if many > few else 0.0
    else:
        exponent = scan(tokens, lambda w: entropy(w) < target["target_entropy"])
    w = shares(tokens, exponent)
    often = reads(tokens, w)
    near = dict(rel=1e-9) if "max_repeats" in target else dict(rel=1e-3)
    for s in tokens:
        own = [r for r in got if r.source == s]
        by_block = defaultdict(list)
        for r in own:
            assert r.mix_tokens == size[r.doc_id] and r.mix_weight == pytest.approx(w[s], **near) and 0 <= r.mix_place < 1
            by_block[r.mix_block].append(r)
        whole = math.floor(often[s] + 1e-6)
        every = sorted(i for i, _, x in rows if x == s)
        for b in range(whole):
            assert sorted(r.doc_id for r in by_block[b]) == every
            assert all(b / often[s] * 0.99 <= r.mix_place <= (b + 1) / often[s] * 1.01 for r in by_block[b])
        last = sorted(by_block.get(whole, []), key=lambda r: r.mix_place)
        budget = (often[s] - whole) * tokens[s]
        used = sum(r.mix_tokens for r in last)
        assert used <= budget + 1 and len({r.doc_id for r in last}) == len(last)
        if len(last) < len(every) and budget >= 1:
            assert used > budget - max(size.values()) * (1 if "max_repeats" in target else 3) - 1  # the next document would not fit
        assert set(by_block) <= set(range(whole + 1))


@pytest.mark.parametrize("target", [{"max_repeats": 1.0}, {"max_repeats": 1.7}, {"max_repeats": 2.0}, {"max_repeats": 3.25}, {"target_entropy": 0.5}])
def test_budgets(docs, target):
    check(mix(docs(corpus()), **target).collect(), corpus(), **target)


def test_ranges_are_cut_again_and_again(docs, monkeypatch):
    """The end of a source's last block is the same however finely it is looked for, and with more sources than are broadcast."""
    rows = corpus()
    key = lambda got: sorted((r.doc_id, r.mix_block, r.mix_place, r.mix_weight) for r in got)
    want = key(mix(docs(rows), max_repeats=1.7).collect())
    monkeypatch.setattr(mixing, "FEW", 3)
    monkeypatch.setattr(mixing, "RANGES", 8)
    assert key(mix(docs(rows), max_repeats=1.7).collect()) == want
    monkeypatch.setattr(mixing, "FEW", 100)
    assert key(mix(docs(rows), max_repeats=1.7, most_sources=1).collect()) == want


def test_many_sources(docs):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 30), f"s{rng.randint(0, 40) ** 2 // 40}") for i in range(600)]
    for most in (7, 1000):
        check(mix(docs(rows), max_repeats=2.0, most_sources=most).collect(), rows, max_repeats=2.0)


def test_any_stretch_is_mixed(docs):
    rows = [(i, "a b c d", "x" if i % 10 else "y") for i in range(4000)]
    got = sorted(mix(docs(rows), max_repeats=3.0).collect(), key=lambda r: r.mix_place)
    share = lambda part: sum(r.source == "y" for r in part) / len(part)
    third = len(got) // 3
    assert all(abs(share(got[i : i + third]) - share(got)) < 0.05 for i in (0, third, 2 * third))


def test_odd_rows(docs):
    rows = [(1, None, None), (2, "", "e"), (3, "a b", "s"), (3, "a b", "s"), (None, "c", "s"), (4, "x " * 500, None), (5, "y", "null"), (6, "z", "=")]
    df = docs(rows).selectExpr("*", "1 AS mix_tokens", "2 AS mix_key", "3 AS mix_block", "4 AS often", "5 AS rest", "6 AS at", "7 AS low", "8 AS before")
    for most in (2, 100):
        got = mix(df, max_repeats=2.0, most_sources=most)
        assert got.columns == [c for c in df.columns if c not in ("mix_tokens", "mix_block")] + ["mix_tokens", "mix_weight", "mix_block", "mix_place"]
        first = [(r.doc_id, r.text, r.source) for r in got.collect() if r.mix_block == 0]
        assert sorted(first, key=str) == sorted(rows, key=str)
    for target in ({"max_repeats": 2.0}, {"target_entropy": 1.0}):
        assert mix(docs([]), **target).count() == 0
        assert mix(docs([(1, None), (2, "")]), **target).count() == 2


def test_query(spark, sf):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(sf("sf0.001") + "/documents.parquet").select("doc_id", "text", "source").collect()]
    got = op1_mix_sources(spark, sf("sf0.001")).collect()
    check(got, rows, max_repeats=2.0)
    assert {r.doc_id for r in got} == {i for i, _, _ in rows} and max(r.mix_block for r in got) <= 2
