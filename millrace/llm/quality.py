"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata of a text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import quoted, remainder, table

WORDS = 1024  # buckets for hashed words
STATS = ("upper", "digit", "mark", "stop", "bar", "space", "high", "control", "length", "words", "word_size", "distinct", "lines", "line_repeat", "long_word", "bang")
MARKS = np.frombuffer(b"!#$%&*+/<=>@\\^_`{}~|", "u1")


class _Buckets(dict):
    """The bucket of a word in lower case; so many words are kept."""

    def __missing__(self, word: str) -> int:
        n = zlib.crc32(word.lower().encode()) % WORDS
        if len(self) < 150_000:
            self[word] = n
        return n


_BUCKETS = _Buckets()


def features(texts: list[str | None]) -> np.ndarray:
    """A row for each text: word frequencies of unit length, then STATS. Null counts as empty."""
    texts = [t or "" for t in texts]
    out = np.zeros((len(texts), WORDS + len(STATS)))
    chars = np.zeros((len(texts), 256))
    for i, t in enumerate(texts):
        chars[i] = np.bincount(np.frombuffer(t.encode(), "u1"), minlength=256)
        words = t.split()
        n = len(words)
        if n:
            f = np.sqrt(np.bincount(np.fromiter(map(_BUCKETS.__getitem__, words), "i8", n), minlength=WORDS))
            out[i, :WORDS] = f / np.sqrt((f * f).sum())
        lines = [x for x in t.split("\n") if x.strip()]
        size = np.fromiter(map(len, words), "i8", n) if n else np.zeros(1, "i8")
        out[i, WORDS + 8 :] = (np.log1p(len(t)), np.log1p(n), size.mean(), len(set(words)) / max(1, n), len(lines) / max(1, n), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(size.max()), t.count("!!") / max(1, n))
    total = np.maximum(1, chars.sum(1))
    out[:, WORDS : WORDS + 8] = np.stack([
        chars[:, 65:91].sum(1) / np.maximum(1, chars[:, 65:91].sum(1) + chars[:, 97:123].sum(1)), chars[:, 48:58].sum(1) / total, chars[:, MARKS].sum(1) / total,
        (chars[:, 44] + chars[:, 46]) / total, chars[:, 124] / total, chars[:, 32] / total, chars[:, 128:].sum(1) / total, (chars[:, :32].sum(1) - chars[:, 10]) / total,
    ], axis=1)
    return out


@dataclass
class Machine:
    """bias + w.x + the sum over pairs of <v_i, v_j> x_i x_j, which is half of |sum v_i x_i|^2 - sum |v_i x_i|^2: linear in the number of features."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        x[:, WORDS:] = np.clip((x[:, WORDS:] - self.mean) / self.scale, -4, 4)
        return x

    def score(self, x: np.ndarray) -> np.ndarray:
        x = self.scaled(x)
        s = self.bias + x @ self.w + ((x @ self.v) ** 2 - (x * x) @ (self.v * self.v)).sum(1) / 2
        return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, factors: int = 8, epochs: int = 12, batch: int = 128, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Minimise the logistic loss by Adam. Without rows of both classes the machine gives the share of class 1, or 0.5 without rows."""
    rng = np.random.default_rng(seed)
    wide = WORDS + len(STATS)
    part = x[:, WORDS:] if len(x) else np.zeros((1, len(STATS)))
    share = y.mean() if len(y) else 0.5
    bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    m = Machine(bias, np.zeros(wide), np.zeros((wide, factors)), part.mean(0), part.std(0) + 1e-6)
    if not len(y) or not 0 < share < 1:
        return m
    m.v = rng.normal(0, 0.02, (wide, factors))
    x = m.scaled(x)
    values = [np.array([m.bias]), m.w, m.v]
    first, second, step = [np.zeros_like(p) for p in values], [np.zeros_like(p) for p in values], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            a, b = x[rows], y[rows]
            q = a @ values[2]
            s = values[0][0] + a @ values[1] + (q * q - (a * a) @ (values[2] * values[2])).sum(1) / 2
            g = (1 / (1 + np.exp(-np.clip(s, -500, 500))) - b) / len(rows)
            slope = [np.array([g.sum()]), a.T @ g + decay * values[1], a.T @ (g[:, None] * q) - ((a * a).T @ g)[:, None] * values[2] + decay * values[2]]
            step += 1
            for p, d, m1, m2 in zip(values, slope, first, second, strict=True):
                m1 += 0.1 * (d - m1)
                m2 += 0.001 * (d * d - m2)
                p -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    m.bias, m.w, m.v = float(values[0][0]), values[1], values[2]
    return m


def learn(documents: DataFrame, labels: DataFrame, most: int = 6000) -> Machine:
    """Fit on labelled documents outside the held-out third, those ``most`` whose ids have the smallest hashes.

    Only features reach the driver, ``most`` rows of them: of documents that share an id, those with the least features
    are learnt from, and a label that repeats counts once.
    """
    chosen = labels.where((remainder("doc_id", 3) != 1) & F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("label_quality")).distinct().orderBy(F.xxhash64("label_id"), "label_id", "label_quality").limit(most)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = features(b.column("text").to_pylist()).astype("<f4")
                yield pa.RecordBatch.from_arrays([b.column("label_id"), b.column("label_quality"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    # the right side has at most ``most`` rows of two numbers
    told = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id").cast("long") == F.col("label_id")).select("label_id", "label_quality", "text")
    once = told.mapInArrow(rows, "doc_id long, quality int, x binary").groupBy("doc_id", "quality").agg(F.min("x").alias("x"))
    got = sorted((r.doc_id, r.quality, bytes(r.x)) for r in once.collect())
    x = np.frombuffer(b"".join(g[2] for g in got), "<f4").reshape(-1, WORDS + len(STATS)).astype("f8")
    return fit(x, np.array([g[1] for g in got], "f8"))


def score(documents: DataFrame, machine: Machine, column: str = "score") -> DataFrame:
    """``documents`` with the machine's score of their whole texts in a further column, which replaces one of that name."""
    held = documents.sparkSession.sparkContext.broadcast(machine)  # WORDS + len(STATS) rows of 9 numbers
    names = [c for c in documents.columns if c != column]
    plain = documents.select(*(quoted(c).alias(f"_{i}") for i, c in enumerate(names)))  # names with dots do not reach Arrow
    fields = StructType([*plain.schema.fields, StructField("_score", DoubleType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held.value.score(features(part.column(names.index("text")).to_pylist())))], fields.names)

    return plain.mapInArrow(rows, fields).toDF(*names, column)


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Labels of documents whose crc32(doc_id as text) mod 3 is 1 are never learnt from. Inputs
    are the text's hashed words, the statistics of its structure and its length; lang, source,
    ids and labels are none. Nulls: a null text is an empty one, which is scored too; a null
    doc_id counts as the empty text in the remainder; labels that are neither 0 nor 1 are left
    out. Repeated rows are scored each. Without labels every score is 0.5. An empty table gives
    no rows.
    """
    scored = score(documents.select("doc_id", F.col("text").cast("string").alias("text")), learn(documents, labels))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
