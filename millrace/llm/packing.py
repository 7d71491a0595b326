"""Packing documents into sequences of a fixed number of tokens, by best fit decreasing."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

#: Fixed value: how byte-level BPE of this kind cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where a space next to other white space could join a cut that does not start at it.
UNSURE = re.compile(r"\s \s|\s \Z")
CACHED = 200_000


class Encoder:
    """Token ids, as little-endian unsigned 32-bit numbers, by the vocabulary of a tokenizer file.

    A cut may start at any space and none spans one, so a text's ids are those of its parts
    between spaces; parts recur and are kept, about ``CACHED`` of them at most. New parts are
    encoded in one go; an id that begins with a space begins a part. Texts with runs of
    white space, where that need not hold, are encoded whole. Texts are cut at the file's
    added tokens first, which get their own ids, as ``tokenizers`` does; without ``added``, as
    it does when told to encode special tokens, these are ordinary text. A file that asks for
    another way to cut texts, to change them or to merge is refused.
    """

    def __init__(self, path: str, added: bool = True):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, cut = file["model"], file.get("pre_tokenizer") or {}
        if file.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError(f"{path} does not cut texts as byte-level BPE of this kind does")
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path} does not merge as byte-level BPE of this kind does")
        vocabulary = model["vocab"]
        tokens = file.get("added_tokens") or [] if added else []
        if any(t.get(k) for t in tokens for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that depend on what is beside them are not supported")
        self.added = {t["content"]: t["id"].to_bytes(4, "little") for t in tokens}
        self.marks = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if tokens else None
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        byte = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(letters))}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if not re.fullmatch(r"<\|.*\|>", token)}
        self.encode = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.opens = np.zeros(max(ranks.values()) + 1, bool)
        self.opens[[i for token, i in ranks.items() if token[:1] == b" "]] = True
        self.seen: dict[str, bytes] = {}
        self.edgy: set[str] = set()

    def raw(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def cut(self, text: str) -> bytes:
        """The ids of a text that holds added tokens."""
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [self.raw(text[at : m.start()]), self.added[m[0]]]
            at = m.end()
        return b"".join([*out, self.raw(text[at:])])

    def learn(self, parts: set[str]) -> None:
        even = []
        for p in parts:
            if p and not p[0].isspace() and not p[-1].isspace():
                even.append(p)
            else:
                self.edgy.add(p)
                self.seen[p] = self.raw(" " + p)
        if even:
            ids = np.array(self.encode(" " + " ".join(even)), "<u4")
            at, raw = [*(4 * np.flatnonzero(self.opens[ids])).tolist(), 4 * len(ids)], ids.tobytes()
            self.seen.update(zip(even, map(raw.__getitem__, map(slice, at[:-1], at[1:])), strict=True))

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.seen) > CACHED:
            self.seen, self.edgy = {}, set()
        split = [t.split(" ") for t in texts]
        used = set().union(*(s[1:] for s in split))
        self.learn(used.difference(self.seen))
        seen, edgy = self.seen, self.edgy & used
        for text, (first, *parts) in zip(texts, split, strict=True):
            if self.marks and self.marks.search(text):
                yield self.cut(text)
            elif (edgy and not edgy.isdisjoint(parts) or first[-1:].isspace()) and UNSURE.search(text):
                yield self.raw(text)
            else:
                yield self.raw(first) + b"".join([seen[p] for p in parts])


@cache
def encoder(path: str, added: bool = True) -> Encoder:
    return Encoder(path, added)


class Tree:
    """A segment tree over remaining capacities: which of them have an open bin."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.full = [0] * (2 * self.size)

    def set(self, capacity: int, bins: int) -> None:
        at = self.size + capacity
        self.full[at] = int(bins > 0)
        while at > 1:
            at //= 2
            self.full[at] = self.full[2 * at] | self.full[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        """The least capacity of at least that length with an open bin."""
        at = self.size + length
        if self.full[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.full[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at + (not self.full[2 * at])
                return at - self.size
            at //= 2
        return None


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit decreasing of ``counts[length]`` pieces of each length: (length, first rank, first bin, pieces a bin, offset).

    The pieces of one length, in any order, take ranks from 0. Equal pieces go to equal bins
    alike, so bins with one history are kept as a run, and each step descends the tree for a
    whole run: the tightest open bin takes pieces until none fits, as it would one by one. The
    work and the answer depend on the number of lengths and not on that of pieces.
    """
    tree, open_bins, bins, out = Tree(capacity), {}, 0, []

    def put(room: int, run: tuple[int, int]) -> None:
        if room and run[1]:
            open_bins.setdefault(room, []).append(run)
            tree.set(room, 1)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                run = (bins, -(-left // each))
                bins += run[1]
            else:
                each, run = room // length, open_bins[room].pop()
                tree.set(room, len(open_bins[room]))
            whole = min(run[1], left // each)
            if whole:
                out.append((length, rank, run[0], each, capacity - room))
                put(room - each * length, (run[0], whole))
                rank, left = rank + whole * each, left - whole * each
            if left and whole < run[1]:
                out.append((length, rank, run[0] + whole, left, capacity - room))
                put(room - left * length, (run[0] + whole, 1))
                whole, left = whole + 1, 0
            put(room, (run[0] + whole, run[1] - whole))
    return out


def _pieces(texts: list[str | None], doc_ids: list, encode, end: int, capacity: int):
    for doc_id, ids in zip(doc_ids, encode([t or "" for t in texts]), strict=True):
        ids += end.to_bytes(4, "little")
        n = len(ids) // 4
        at = 0
        for piece in range(-(-n // capacity)):
            stop = n - (-(-n // capacity) - piece - 1) * capacity  # full pieces at the end, the first takes what is over
            yield doc_id, piece, at, stop - at, zlib.crc32(ids[4 * at : 4 * stop])
            at = stop


def pack(documents: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2, added: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    A document is its text's ids, with those of added tokens in it unless ``added`` is false, and ``end``; longer
    ones than ``capacity`` are cut so that only the first piece is shorter. Tokenizing leaves a row of numbers a piece, with its rank
    among its task's pieces of that length. The pieces of each length are counted, at most
    ``capacity`` numbers in all, best fit decreasing is solved on these counts, and each
    piece finds its place from its length and rank: counts before its task's, plus its rank
    there. So one packing covers all documents, while the driver holds the same whatever the
    input's size, and a length that a third of the pieces share is spread as the text is.

    Nulls: a null or empty text is the single id ``end``; doc_id may be null or repeat, and
    each row is packed. An empty table gives no rows.
    """
    spark = documents.sparkSession

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, count = encoder(tokenizer, added), TaskContext.get().partitionId(), np.zeros(capacity + 1, "i8")
        for b in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            rows = list(_pieces(b.column("text").to_pylist(), b.column("doc_id").to_pylist(), encode, end, capacity))
            if not rows:
                continue
            doc_id, piece, start, length, crc = zip(*rows, strict=True)
            size = np.array(length)
            order = np.argsort(size, kind="stable")
            ranks, (kinds, at, n) = np.empty(len(size), "i8"), np.unique(size[order], return_index=True, return_counts=True)
            ranks[order] = np.arange(len(size)) - np.repeat(at, n) + count[size[order]]
            count[kinds] += n
            yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(size), pa.int32()), pa.array(ranks)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stash(rows.mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"), "pieces")
    counted = pieces.groupBy("task", "length").count()
    before = counted.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("task")) - F.col("count")).drop("count")
    counts = {r.length: r["count"] for r in counted.groupBy("length").agg(F.sum("count").alias("count")).collect()}
    plan = np.array(best_fit(counts, capacity), "i8").reshape(-1, 5)
    by_place = np.lexsort((plan[:, 1], plan[:, 0]))
    plan = plan[by_place]
    keys = plan[:, 0] << 48 | plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("before").to_numpy() + b.column("nth").to_numpy()
            at = plan[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            nth = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(at[:, 2] + nth // at[:, 3]), pa.array(at[:, 4] + nth % at[:, 3] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return pieces.join(before, ["task", "length"]).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer(), capacity=1024, end=2)
