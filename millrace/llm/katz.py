"""A Katz backoff language model: Good-Turing discounts, exact backoff weights, tables split by context."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, stash, table

CUTOFF = 5  # counts above it are not discounted
BATCH = 1_500_000  # tokens, unless one document has more
FAN = 128  # blocks that a batch or a node sends
START = 0  # the context of a text's first token; other contexts are n-grams' numbers, from 1
ALWAYS = np.iinfo("i8").max
_ONE = np.uint64(0x9E3779B97F4A7C15)
_SEEN: dict[bytes, int] = {}


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 or of doubles as one string: by the fewest bytes a number, plane by plane, under Zstandard.

    Doubles of few values are numbered.
    """
    pack, head, body = zstandard.ZstdCompressor(level=1), [], []

    def put(kind: bytes, a: np.ndarray) -> None:
        planes = np.ascontiguousarray(a).view("u1").reshape(-1, a.itemsize).T.tobytes() if a.size else b""
        body.append(pack.compress(planes) if a.size else b"")
        head.append(struct.pack("<cBII", kind, a.itemsize, len(a), len(body[-1])))

    for a in arrays:
        if a.dtype.kind == "f":
            values, at = np.unique(a, return_inverse=True)
            if len(values) < min(65536, len(a) / 2):
                put(b"v", values)
                a = at
            else:
                put(b"f", a)
                continue
        put(b"n", a.astype(np.min_scalar_type(a.max(initial=0))))
    return b"".join([struct.pack("<B", len(head)), *head, *body])


def load(raw: bytes) -> list[np.ndarray]:
    n, unpack, out, values = raw[0], zstandard.ZstdDecompressor(), [], None
    at = 1 + 10 * n
    for kind, width, length, size in struct.iter_unpack("<cBII", raw[1:at]):
        planes = np.frombuffer(unpack.decompress(raw[at : at + size]), "u1") if length else np.empty(0, "u1")
        a = np.ascontiguousarray(planes.reshape(width, length).T).view("f8" if kind != b"n" else f"u{width}").reshape(length)
        at += size
        if kind == b"v":
            values = a
            continue
        out.append(a if values is None else values[a])
        values = None
    return out


def tokens(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words, A-Z in lower case, and 1 for its end. ``bytes.split`` cuts at exactly the six characters of white space."""
    words = (text or "").encode().lower().split()
    seen = _SEEN
    try:
        ids = [seen[w] for w in words]
    except KeyError:
        if len(seen) > 250_000:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = max(16, xxhash.xxh3_64_intdigest(w))
        ids = [seen[w] for w in words]
    ids.append(1)
    return np.array(ids, "u8")


def learns(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 != 2


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole documents in batches: their tokens as places in the batch's vocabulary, a row a batch."""
    held, ids, size, nth, task = [], [], 0, 0, TaskContext.get().partitionId()

    def row() -> pa.RecordBatch:
        words, at, n = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        common = np.argsort(-n, kind="stable")  # small numbers for common words pack best
        rank = np.empty(len(words), "u4")
        rank[common] = np.arange(len(words), dtype="u4")
        raw = dump(words[common], rank[at], np.array(list(map(len, held)), "u4"), np.array([i or 0 for i in ids], "i8").view("u8"), np.array([i is None for i in ids], "u1"), np.array(list(map(learns, ids)), "u1"))
        return pa.RecordBatch.from_arrays([pa.array([task << 32 | nth], pa.int64()), pa.array([size], pa.int64()), pa.array([raw], pa.binary())], ["batch", "tokens", "raw"])

    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            held.append(tokens(text))
            ids.append(doc_id)
            size += len(held[-1])
            if size >= BATCH:
                yield row()
                held, ids, size, nth = [], [], 0, nth + 1
    if held:
        yield row()


@dataclass
class Plan:
    """What is the same for all tasks: buckets (``fan`` to the power ``depth`` of them), how many batches there are, the tokens
    a context may bring to one bucket, and of each level settled so far how many n-grams have count 1 to CUTOFF + 1, and in all."""

    fan: int
    depth: int
    batches: int
    share: int
    levels: list[np.ndarray]

    @property
    def buckets(self) -> int:
        return self.fan**self.depth

    def home(self, batch: int) -> int:
        """The node of the first step that a batch sends to, before its children's numbers are added."""
        groups = -(-self.batches // self.fan) if self.depth > 1 else 1
        return int(mixed(np.array([batch], "i8").view("u8"))[0]) % groups * self.fan

    def above(self, node: int, step: int) -> tuple[int, int]:
        """The first of the nodes that a node of a step sends to, and the first bucket below it: groups of batches grow as ranges of buckets shrink."""
        group, part = divmod(node, self.fan**step)
        group = group // self.fan if step + 1 < self.depth else 0
        return (group * self.fan**step + part) * self.fan, part * self.fan ** (self.depth - step)

    def discounts(self, level: int) -> np.ndarray:
        """Of counts 0 to CUTOFF: Katz's Good-Turing discounts, or 1 - 0.5 / r where counts of counts do not allow these."""
        n = self.levels[level].astype("f8")
        r = np.arange(1, CUTOFF + 1)
        with np.errstate(all="ignore"):
            rest = (CUTOFF + 1) * n[CUTOFF] / n[0]
            d = ((r + 1) * n[1 : CUTOFF + 1] / n[:CUTOFF] / r - rest) / (1 - rest)
        good = np.isfinite(d).all() and (d > 0).all() and (d < 1).all()
        return np.r_[1.0, d if good else 1 - 0.5 / r]


@dataclass
class Grams:
    """Distinct n-grams in order of context and word, as a batch asks for them or a node gathers them from several."""

    head: np.ndarray  # contexts by number, ascending
    wide: np.ndarray  # over how many buckets each is spread
    own: np.ndarray  # of each n-gram, its context's place in head
    vocab: np.ndarray  # words, ascending
    word: np.ndarray  # of each n-gram, its word's place in vocab
    p: np.ndarray  # probabilities of the level below: none at level 1, of words at level 2, of n-grams above
    n: np.ndarray  # how often learnt
    level: int  # from 0

    def parts(self, plan: Plan, low: int, span: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(child, n-grams, contexts) for each of ``fan`` ranges of ``span`` buckets from ``low`` on.

        An n-gram's bucket follows from its context; of a context that is spread over more, from its word too.
        Such a context is asked for wherever its buckets lie, with or without n-grams there.
        """
        of = np.uint64(plan.buckets)
        start = (mixed(self.head ^ _ONE) % of).astype("i8")
        bucket = start[self.own]
        far = np.flatnonzero(self.wide > 1)
        some = np.flatnonzero((self.wide > 1)[self.own])
        off = mixed(self.vocab)[self.word[some]] % self.wide[self.own[some]].astype("u8")
        bucket[some] = (bucket[some] + off.astype("i8")) % plan.buckets
        child = ((bucket - low) // span).astype("i2")
        order = np.argsort(child, kind="stable")
        ends, out = np.searchsorted(child[order], np.arange(plan.fan + 1)), []
        for j in range(plan.fan):
            grams, at = order[ends[j] : ends[j + 1]], low + j * span
            meets = ((at - start[far]) % plan.buckets < self.wide[far]) | ((start[far] - at) % plan.buckets < span)
            heads = np.union1d(self.own[grams], far[meets])
            if len(heads):
                out.append((j, grams, heads))
        return out

    def block(self, grams: np.ndarray, heads: np.ndarray) -> bytes:
        run = np.bincount(np.searchsorted(heads, self.own[grams]), minlength=len(heads))
        used, word = np.unique(self.word[grams], return_inverse=True)
        p = self.p[used if self.level == 1 else grams] if self.level else self.p
        return dump(np.diff(self.head[heads], prepend=np.uint64(0)), self.wide[heads], run, np.diff(self.vocab[used], prepend=np.uint64(0)), word, p, self.n[grams])

    def told(self, parts: list, replies: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Counts and numbers of the n-grams; of contexts whether a count of theirs is discounted, and sums, from all children."""
        n, number = np.zeros(len(self.own), "i8"), np.zeros(len(self.own), "u8")
        low, sums = np.zeros(len(self.head), bool), np.zeros((len(self.head), CUTOFF + 2))
        for j, grams, heads in parts:
            got = load(replies[j])
            n[grams] = got[0]
            if len(got[1]):
                number[grams] = got[1]
            low[heads] |= got[2].astype(bool)
            some = heads[_summed(np.searchsorted(heads, self.own[grams]), n[grams], self.wide[heads])]
            sums[some] += np.stack(got[3:], axis=1)
        return n, number, low, sums


def _summed(own: np.ndarray, n: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Which contexts need their sums: those with an n-gram never learnt, and those spread over buckets."""
    return (np.bincount(own[n == 0], minlength=len(wide)) > 0) | (wide > 1)


class Merged(Grams):
    """What a node gathers: the blocks of several senders as one, and each sender's places in it."""

    def __init__(self, raws: list[bytes], level: int):
        self.level, got = level, [load(r) for r in raws]
        put = lambda k: np.concatenate([g[k] for g in got])
        self.head, h_at = np.unique(np.concatenate([np.cumsum(g[0].astype("u8"), dtype="u8") for g in got]), return_inverse=True)
        self.vocab, v_at = np.unique(np.concatenate([np.cumsum(g[3].astype("u8"), dtype="u8") for g in got]), return_inverse=True)
        self.wide = np.ones(len(self.head), "i8")
        self.wide[h_at] = put(1)
        self.senders, keys, h, v = [], [], 0, 0
        for g in got:
            heads, words = h_at[h : h + len(g[0])], v_at[v : v + len(g[3])]
            own = np.repeat(np.arange(len(heads)), g[2])
            keys.append(heads[own] << 32 | words[g[4]])
            self.senders.append((heads, own))
            h, v = h + len(heads), v + len(words)
        key, first, self.of = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        self.own, self.word = key >> 32, key & 0xFFFFFFFF
        self.n = np.bincount(self.of, put(6), len(key)).astype("i8")
        p = put(5)
        self.p = p[first] if level > 1 else np.zeros(len(self.vocab))
        if level == 1:
            self.p[v_at] = p

    def replies(self, n: np.ndarray, number: np.ndarray, low: np.ndarray, sums: np.ndarray, last: bool) -> Iterator[bytes]:
        """For each sender, in order, what ``Grams.told`` reads. At the last level n-grams need no numbers."""
        at = 0
        for heads, own in self.senders:
            of = self.of[at : at + len(own)]
            need = _summed(own, n[of], self.wide[heads])
            own_sums = sums[heads[need]]
            yield dump(n[of], np.empty(0, "u8") if last else number[of], low[heads], *(own_sums[:, k].astype("i8" if k <= CUTOFF else "f8") for k in range(CUTOFF + 2)))
            at += len(own)

    def answer(self, bucket: int, buckets: int) -> tuple:
        """A bucket's own table: counts over all batches, n-grams numbered from the most frequent on, sums by context, counts of counts."""
        number = np.empty(len(self.n), "u8")
        number[np.argsort(-self.n, kind="stable")] = np.arange(len(self.n), dtype="u8") * np.uint64(buckets) + np.uint64(bucket + 1)
        seen = self.n > 0
        size = len(self.head)
        sums = [np.bincount(self.own, self.n, size), *(np.bincount(self.own[self.n == r], minlength=size) for r in range(1, CUTOFF + 1))]
        p = self.p if self.level > 1 else self.p[self.word]
        sums.append(np.bincount(self.own[seen], p[seen], size))
        sums = np.stack(sums, axis=1).astype("f8")
        tally = [int((self.n == r).sum()) for r in range(1, CUTOFF + 2)] + [int(seen.sum()), int(self.n.sum())]
        return (self.n, number, sums[:, 1 : CUTOFF + 1].sum(1) > 0, sums), tally


class Batch:
    """A batch's tokens, and their probabilities level by level."""

    def __init__(self, raw: bytes, plan: Plan):
        self.plan = plan
        words, at, length, doc_id, null, learn = load(raw)
        self.length, self.id, self.null, self.learn = length.astype("i8"), doc_id.astype("u8").view("i8"), null.astype(bool), learn.astype(bool)
        self.taught = np.repeat(self.learn, self.length)
        self.first = np.zeros(int(self.length.sum()), bool)
        self.first[np.cumsum(self.length) - self.length] = True
        self.level, self.at = 0, at.astype("i8")
        self.order = np.argsort(words)
        self.place = np.empty(len(words), "i8")
        self.place[self.order] = np.arange(len(words))
        self.asked, self.of = None, self.place[self.at]  # tokens asked for (None: all), and their n-grams
        every = np.zeros(len(words), "i8")
        self.grams = Grams(np.zeros(1, "u8"), np.full(1, max(2, plan.buckets), "i8"), every, words[self.order].astype("u8"), np.arange(len(words)), np.empty(0), np.bincount(self.of[self.taught], minlength=len(words)), 0)
        self.often = np.full(1, ALWAYS)
        self.parts = self.grams.parts(plan, 0, plan.buckets // plan.fan)

    def settle(self, replies: dict[int, bytes]) -> None:
        """Probabilities of this level from what the buckets hold."""
        grams, plan = self.grams, self.plan
        n, number, low, sums = grams.told(self.parts, replies)
        d = plan.discounts(self.level)
        total = np.where(grams.wide > 1, sums[:, 0], self.often)
        left = np.where(low, ((1 - d[1:]) * np.arange(1, CUTOFF + 1) * sums[:, 1 : CUTOFF + 1]).sum(1), 1)
        size = np.where(low, total, total + 1)  # where nothing is discounted, one count more makes room
        known = total > 0
        below = (grams.p[grams.word] if self.level == 1 else grams.p) if self.level else 1.0
        with np.errstate(all="ignore"):  # contexts whose n-grams were all learnt come without sums and need no weight
            weight = np.where(known, left / size / (1 - sums[:, CUTOFF + 1]), 1)
            p = np.where(n > 0, d[np.where(n <= CUTOFF, n, 0)] * n / size[grams.own], weight[grams.own] * below)
        if not self.level:
            self.c = n[self.of]
            ids = number[self.place]
            self.vocab = np.sort(ids)
            spot = np.argsort(np.argsort(ids))
            self.word = spot[self.at]
            self.word_p = np.empty(len(ids))
            self.word_p[spot] = p[self.place]
        if self.asked is None:
            self.p, self.n, self.number = p[self.of], n[self.of], number[self.of]
        else:
            # n-grams whose context was never learnt keep the probability of the level below, and start no context that was
            self.n, self.number = np.zeros(len(self.at), "i8"), np.zeros(len(self.at), "u8")
            self.p[self.asked], self.n[self.asked], self.number[self.asked] = p[self.of], n[self.of], number[self.of]

    def next(self) -> None:
        """The level above: a token's context is the n-gram of the token before it."""
        self.level += 1
        plan = self.plan
        context, often = np.r_[np.uint64(0), self.number[:-1]], np.r_[0, self.n[:-1]]
        context[self.first], often[self.first] = START, ALWAYS
        self.asked = np.flatnonzero(often > 0)
        head, h_at, own = np.unique(context[self.asked], return_index=True, return_inverse=True)
        self.often = often[self.asked][h_at]
        key, first, self.of = np.unique(own << 32 | self.word[self.asked], return_index=True, return_inverse=True)
        wide = np.where(self.often > plan.share, np.minimum(max(2, plan.buckets), -(-self.often // plan.share)), 1)
        p = self.word_p if self.level == 1 else self.p[self.asked][first]
        self.grams = Grams(head, wide, key >> 32, self.vocab, key & 0xFFFFFFFF, p, np.bincount(self.of[self.taught[self.asked]], minlength=len(key)), self.level)
        self.parts = self.grams.parts(plan, 0, plan.buckets // plan.fan)

    def asks(self) -> Iterator[tuple[int, bytes]]:
        for child, grams, heads in self.parts:
            yield child, self.grams.block(grams, heads)


def _upto(raw: bytes, plan: Plan, replies: pa.Table, level: int) -> Batch:
    """The batch with the probabilities of ``level``, found from those of the levels below."""
    told = {}
    for at, sender, r in zip(*(replies.column(c).to_pylist() for c in ("level", "sender", "raw")), strict=True):
        told.setdefault(at, {})[sender % plan.fan] = r
    batch = Batch(raw, plan)
    for k in range(level + 1):
        if k:
            batch.next()
        batch.settle(told.get(k, {}))
    return batch


_ASK, _TELL = "node long, sender long, raw binary", "level int, node long, sender long, raw binary, tally array<long>"


def _asks(rows: list[tuple]) -> pa.Table:
    node, sender, raw = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"node": pa.array(node, pa.int64()), "sender": pa.array(sender, pa.int64()), "raw": pa.array(raw, pa.binary())})


def _tells(rows: list[tuple]) -> pa.Table:
    kinds = (("level", pa.int32()), ("node", pa.int64()), ("sender", pa.int64()), ("raw", pa.binary()), ("tally", pa.list_(pa.int64())))
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds)})


def _dealt(df: DataFrame, key: str, groups: int) -> DataFrame:
    """Rows by key over twice as many partitions as there are keys, so that a task meets one or few, however many there are in all."""
    return df.repartition(max(1, 2 * groups), key)


def _exchange(asks: DataFrame, plan: Plan, level: int, last: bool, step: int = 1) -> DataFrame:
    """What the buckets answer to the senders of ``asks``; rows with a tally have counts of counts.

    With up to FAN buckets a sender's block goes to its bucket. With more, it goes to a node that
    serves a group of senders and a range of buckets; the node merges what its group asks for,
    sends a block to each of ``fan`` smaller ranges, and passes on what comes back. Groups grow
    as ranges shrink, so each node holds about as much as a batch, and each sends ``fan`` blocks
    whatever the input's size: blocks grow with the input, times the number of steps.
    """
    if step == plan.depth:

        def answer(key, rows):
            merged = Merged(rows.column("raw").to_pylist(), level)
            found, tally = merged.answer(key[0].as_py(), plan.buckets)
            out = [(level, to, key[0].as_py(), r, None) for to, r in zip(rows.column("sender").to_pylist(), merged.replies(*found, last), strict=True)]
            return _tells([*out, (level, None, key[0].as_py(), None, tally)])

        return stash(_dealt(asks, "node", plan.buckets).groupBy("node").applyInArrow(answer, _TELL), f"lm-level{level + 1}")
    held = stash(asks, "lm-asks")
    nodes = -(-plan.batches // plan.fan**step) * plan.fan**step

    def forward(key, rows):
        merged, node = Merged(rows.column("raw").to_pylist(), level), key[0].as_py()
        to, low = plan.above(node, step)
        return _asks([(to + j, node, merged.block(grams, heads)) for j, grams, heads in merged.parts(plan, low, plan.fan ** (plan.depth - step - 1))])

    told = _exchange(_dealt(held, "node", nodes).groupBy("node").applyInArrow(forward, _ASK), plan, level, last, step + 1)

    def back(key, rows, answers):
        if not rows.num_rows:
            return _tells([])
        merged, node = Merged(rows.column("raw").to_pylist(), level), key[0].as_py()
        _, low = plan.above(node, step)
        parts = merged.parts(plan, low, plan.fan ** (plan.depth - step - 1))
        found = merged.told(parts, {s % plan.fan: r for s, r in zip(answers.column("sender").to_pylist(), answers.column("raw").to_pylist(), strict=True)})
        return _tells([(level, to, node, r, None) for to, r in zip(rows.column("sender").to_pylist(), merged.replies(*found, last), strict=True)])

    passed = _dealt(held, "node", nodes).groupBy("node").cogroup(_dealt(told.where("tally IS NULL"), "node", nodes).groupBy("node")).applyInArrow(back, _TELL)
    return stash(passed.unionByName(told.where("tally IS NOT NULL")), "lm-passed")


def katz(documents: DataFrame, order: int = 2, bucket_tokens: int = 2_000_000, most_fan: int = FAN) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mean_score) of every document.

    ``mean_score`` is the score a token. A document's tokens are its words and END; START stands before them and is not counted.
    The model learns from documents whose crc32(doc_id as text) mod 7 is not 2. At level 1 the
    events are the words learnt and one for all others, which gets what discounts leave. At
    level m, an n-gram seen r times after a context of m - 1 tokens has d_r r / (tokens seen
    after it); any other has the probability of level m - 1 times the context's backoff weight,
    which is what discounts leave over 1 less the level-(m - 1) mass of the words seen there,
    summed over every one of them: each context's probabilities add up to 1. A context whose
    n-grams all have high counts would leave nothing; it gets one count more.

    Documents stay in batches of about ``BATCH`` tokens. Per level, a batch sends its distinct
    n-grams with their counts to the bucket that holds the context, as blocks and not as rows;
    the bucket's table adds up what all batches sent and answers each with counts and, where a
    context has n-grams that were never learnt, its sums, from which the batch finds the
    probabilities and goes on to the level above. Blocks go through a network (_exchange), so
    that their number grows with the input and not with batches times buckets. Buckets number
    their n-grams, the most frequent first, and these numbers are the contexts of the level
    above: n-grams are told apart exactly. A context with more than half a bucket's share of
    the tokens is spread over as many buckets as it has such shares, by its words; its sums add
    up. So a word that makes up a third of all text fills no task. The driver holds one row
    of counts of counts a level.

    Words are known by 64-bit hashes. Nulls: a null or empty text is END alone; a null doc_id
    counts as the empty text in the remainder. Repeated rows count each. Without any learnt
    token, probabilities are 1 for all that is not known. An empty table gives no rows.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    batches = stash(rows.mapInArrow(_gather, "batch long, tokens long, raw binary"), "lm-batches")
    total, number = batches.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    buckets, depth = max(1, math.ceil(total / bucket_tokens)), 1
    while most_fan**depth < buckets:
        depth += 1
    fan = max(1, math.ceil(buckets ** (1 / depth) - 1e-9))
    plan = Plan(fan, depth, number, max(20_000, total // (2 * fan**depth)), [])
    replies = None

    def first(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            for batch, raw in zip(p.column("batch").to_pylist(), p.column("raw").to_pylist(), strict=True):
                yield from _asks([(plan.home(batch) + child, batch, r) for child, r in Batch(raw, plan).asks()]).to_batches()

    def later(level: int):
        def ask(key, left, right):
            if not left.num_rows:
                return _asks([])
            batch = _upto(left.column("raw")[0].as_py(), plan, right, level - 1)
            batch.next()
            return _asks([(plan.home(key[0].as_py()) + child, key[0].as_py(), r) for child, r in batch.asks()])

        return ask

    def with_replies():
        told = replies.where("tally IS NULL").select(F.col("node").alias("batch"), "level", "sender", "raw")
        return _dealt(batches.select("batch", "raw"), "batch", number).groupBy("batch").cogroup(_dealt(told, "batch", number).groupBy("batch"))

    for level in range(order):
        asks = with_replies().applyInArrow(later(level), _ASK) if level else batches.select("batch", "raw").mapInArrow(first, _ASK)
        told = _exchange(asks, plan, level, level == order - 1)
        plan.levels.append(np.array(told.where("tally IS NOT NULL").agg(*(F.coalesce(F.sum(F.col("tally")[k]), F.lit(0)) for k in range(CUTOFF + 3))).first(), "i8"))
        replies = told if replies is None else replies.unionByName(told)
    learnt, kinds = int(plan.levels[0][-1]), int(plan.levels[0][-2])

    def score(key, left, right):
        names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "mean_score")
        if not left.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip(names, (pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 3), strict=True)})
        b = _upto(left.column("raw")[0].as_py(), plan, right, order - 1)
        at = np.cumsum(b.length) - b.length
        add = lambda x: np.add.reduceat(x, at)  # noqa: E731  every document has a token
        base, found = add(np.log10((b.c + 1) / (learnt + 1 * (kinds + 1)))), add(np.log10(b.p))
        return pa.table([pa.array(b.id, mask=b.null), pa.array(~b.learn), pa.array(b.length), pa.array(add((b.c > 0).astype("i8"))), pa.array(np.full(len(at), learnt)), pa.array(base), pa.array(found), pa.array(found / b.length)], list(names))

    return with_replies().applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mean_score double")


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz(table(spark, sf_dir, "documents"), order=2)
