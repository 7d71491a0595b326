import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import katz as module
from millrace.llm.katz import dump, katz, load, op7_katz


class Plain:
    """The model by dictionaries and recursion."""

    def __init__(self, rows, order):
        self.order, self.cache = order, {}
        low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        self.texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", low(t)) + ["</s>"]) for i, t in rows]
        self.counts = [defaultdict(Counter) for _ in range(order)]
        for i, words in self.texts:
            if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
                w = ["<s>"] * (order - 1) + words
                for j in range(order - 1, len(w)):
                    for m in range(order):
                        self.counts[m][tuple(w[j - m : j])][w[j]] += 1
        self.d = []
        for level in self.counts:
            n, k = Counter(c for f in level.values() for c in f.values()), 5
            try:
                rest = (k + 1) * n[k + 1] / n[1]
                d = [((r + 1) * n[r + 1] / n[r] / r - rest) / (1 - rest) for r in range(1, k + 1)]
                good = all(0 < x <= 1 for x in d) and d[0] < 1
            except ZeroDivisionError:
                good = False
            self.d.append(dict(zip(range(1, k + 1), d if good else [1 - 0.5 / r for r in range(1, k + 1)], strict=True)))

    def context(self, m, h):
        if (m, h) not in self.cache:
            f = self.counts[m].get(h)
            if f:
                size = sum(f.values())
                left = sum((1 - self.d[m].get(c, 1)) * c for c in f.values())
                size, left = (size, left) if left > 1e-9 else (size + 1, 1)
                below = 1 - sum(self.p(m - 1, h[1:], w) for w in f) if m else 1
                self.cache[m, h] = (f, size, left / size / below)
            else:
                self.cache[m, h] = None
        return self.cache[m, h]

    def p(self, m, h, w):
        c = self.context(m, h)
        below = lambda: self.p(m - 1, h[1:], w) if m else 1
        if c is None:
            return below()
        f, size, weight = c
        return self.d[m].get(f[w], 1) * f[w] / size if f[w] else weight * below()

    def rows(self):
        seen = self.counts[0][()]
        n, v = sum(seen.values()), len(seen)
        for i, words in self.texts:
            w = ["<s>"] * (self.order - 1) + words
            score = sum(math.log10(self.p(self.order - 1, tuple(w[j - self.order + 1 : j]), w[j])) for j in range(self.order - 1, len(w)))
            yield i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, len(words), sum(seen[x] > 0 for x in words), n, sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in words), score


def check(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[6], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[7] == pytest.approx(a[6] / a[2]) and a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order, tokens", [(1, 4_000_000), (2, 4_000_000), (2, 9000), (3, 9000)])
def test_against_recursion(spark, sf, order, tokens):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(sf("sf0.001") + "/documents.parquet").select("doc_id", "text").collect()]
    model = Plain(rows, order)
    check(katz(spark.read.parquet(sf("sf0.001") + "/documents.parquet").repartition(3), order, tokens).collect(), model.rows())
    words = [*model.counts[0][()], "never seen"]
    for h in list(model.counts[order - 1])[:20]:
        assert sum(model.p(order - 1, h, w) for w in words) == pytest.approx(1)


def test_query_beats_the_base(spark, sf):
    held = [r for r in op7_katz(spark, sf("sf0.001")).collect() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(docs):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b"), (3, "A b\x0bA\tb"), (3, "A b\x0bA\tb"), (4, "a " * 3000), (5, "É é"), (6, "new words only")]
    check(katz(docs(rows)).collect(), Plain(rows, 2).rows())
    assert katz(docs([])).count() == 0
    only = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = katz(docs([(only, "a b")])).collect()
    assert (r.held_out, r.train_tokens, r.n_known, r.score) == (True, 0, 0, 0.0) and r.base_score == 0.0


def test_blocks_come_back():
    arrays = [np.arange(9, dtype="u8") << np.uint64(40), np.array([0.5] * 7 + [0.25]), np.random.default_rng(0).normal(size=50), np.empty(0, "f8"), np.array([0, 1, 255]), np.array([True, False])]
    back = load(dump(*arrays))
    assert len(back) == len(arrays) and all(len(a) == len(b) and (a == b).all() for a, b in zip(arrays, back, strict=True))


@pytest.mark.parametrize("fan, depth", [(5, 1), (2, 3), (3, 2), (1, 1)])
def test_common_contexts_are_spread(docs, monkeypatch, fan, depth):
    monkeypatch.setattr(module, "Plan", lambda _f, _d, batches, _s, levels: plan_type(fan, depth, batches, 3, levels))
    monkeypatch.setattr(module, "BATCH", 60)
    rows = [(i, "the a the b the c " * 3 + f"w{i % 4} x{i}") for i in range(40)]
    check(katz(docs(rows), 3).collect(), Plain(rows, 3).rows())


@pytest.mark.parametrize("most_fan", [2, 4, 100])
def test_network_of_any_depth(spark, sf, most_fan):
    """Blocks go through nodes; with groups of batches above and ranges of buckets below, all counts stay whole."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(sf("sf0.001") + "/documents.parquet").select("doc_id", "text").collect()]
    model = Plain(rows, 2)
    check(katz(spark.read.parquet(sf("sf0.001") + "/documents.parquet").repartition(7), 2, 6000, most_fan).collect(), model.rows())


def test_blocks_grow_with_the_input():
    """Blocks sent a level: at most batches x FAN x steps, and not batches x buckets."""

    def blocks(buckets, batches):
        depth = 1
        while module.FAN**depth < buckets:
            depth += 1
        fan = math.ceil(buckets ** (1 / depth) - 1e-9)
        plan = plan_type(fan, depth, batches, 1, [])
        nodes, sent = {plan.home(b) + j for b in range(batches) for j in range(fan)}, batches * fan
        for step in range(1, depth):
            sent += len(nodes) * fan
            nodes = {plan.above(n, step)[0] + j for n in nodes for j in range(fan)}
        assert nodes == set(range(plan.buckets))
        assert sent <= 1.1 * batches * module.FAN * depth
        return sent

    assert blocks(67, 112) == 67 * 112
    assert blocks(40_000, 50_000) < 10 * blocks(4000, 5000)


plan_type = module.Plan
