"""Near-duplicate documents by bottom-k sketches of one hash function, confirmed on whole shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, files_for, mixed, stash, table
from .components import components

WORDS = 5
K = 128  # values in a sketch
#: Of the k least values of a union, each is in both sets with chance J. At J = 0.75 fewer than 72 of 128 have a chance of about one in a million.
LEAST_SHARE = 0.5625
#: Sizes of documents fall into classes that each span this ratio; linked ones lie two classes apart at most.
CLASS = math.sqrt(4 / 3)
BITS = 1 << 23  # of the filter of candidates: 1 MB, whatever the input's size
_ONE = np.uint64(0x9E3779B97F4A7C15)
_SEEN: dict[bytes, int] = {}


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's 5-word shingles; fewer words make one shingle, none make none.

    ``bytes.lower`` and ``bytes.split`` are exactly A-Z and the six characters of white space.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, "u8")
    seen = _SEEN
    try:
        ids = [seen[w] for w in words]
    except KeyError:
        if len(seen) > 250_000:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh3_64_intdigest(w)
        ids = [seen[w] for w in words]
    ids = np.array(ids, "u8")
    n = min(WORDS, len(ids))
    h = np.full(len(ids) - n + 1, n, "u8")
    for j in range(n):
        h = h * _ONE + ids[j : len(ids) - n + 1 + j]
    return np.unique(mixed(h))


def needed(n: int, least_share: float = LEAST_SHARE) -> int:
    """How many values of a sketch a document of n shingles must share with another to be linked with it.

    Up to 3/4 K shingles, a partner's sketch is its whole set, and the number is exact.
    """
    return math.ceil(0.75 * n) if n <= 0.75 * K else max(1, int(least_share * min(n, K)))


def _sketches(batches: Iterator[pa.RecordBatch], least_share: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            sets = [shingles(t) for t in part.column("text").to_pylist()]
            low = [s[:K].view("i8") for s in sets]
            ends = np.cumsum([0, *map(len, low)]).astype("i4")
            values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(low) if low else np.empty(0, "i8")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(map(len, sets)), pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), values, pa.array([needed(len(s), least_share) for s in sets], pa.int32())], ["doc_id", "n", "whole", "low", "need"])


def alike(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, least_share: float = LEAST_SHARE) -> bool:
    """Whether the sketch of the union allows a similarity of 0.75. Sketches that are whole sets decide it."""
    union = np.union1d(a, b)
    both = np.intersect1d(a, b, assume_unique=True)
    if n_a <= K and n_b <= K:
        return 4 * len(both) >= 3 * len(union)
    union = union[:K]
    return int((both <= union[-1]).sum()) >= int(least_share * len(union))


def _estimate(batches: Iterator[pa.RecordBatch], least_share: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, z = (np.split(c.flatten().to_numpy().view("u8"), np.cumsum(np.diff(c.offsets.to_numpy()))[:-1]) if len(c) else [] for c in (b.column("low_a"), b.column("low_b")))
        keep = [alike(x, y, m, n, least_share) for x, y, m, n in zip(a, z, b.column("n_a").to_pylist(), b.column("n_b").to_pylist(), strict=True)]
        yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            sets = [shingles(t) for t in part.column("text").to_pylist()]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("doc_id").to_numpy(), list(map(len, sets)))), pa.array(np.concatenate(sets).view("i8"))], ["a", "s"])


def _common(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int]]:
    """Of each pair the sizes of both sets and of what they share. Pairs of one document come one after the other, and its set is made once."""
    ids, sets = [None, None], [None, None]
    for at in range(0, batch.num_rows, 200):
        part = batch.slice(at, 200)
        sides = [zip(part.column(side).to_pylist(), part.column(f"text_{side}").to_pylist(), strict=True) for side in "ab"]
        for pair in zip(*sides, strict=True):
            for k, (doc_id, text) in enumerate(pair):
                if doc_id != ids[k]:
                    ids[k], sets[k] = doc_id, shingles(text)
            yield len(sets[0]), len(sets[1]), len(np.intersect1d(*sets, assume_unique=True))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [100 * both >= 75 * (m + n - both) for m, n, both in _common(b)]
        yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array([both for _, _, both in _common(b)], pa.int64())], ["a", "hub", "inside"])


def _pairs(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs (a, b) with the columns of both documents."""
    of = lambda side: rows.select(*(F.col(c).alias(side if c == "doc_id" else f"{c}_{side}") for c in rows.columns))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", *(f"{c}_{x}" for c in rows.columns if c != "doc_id" for x in "ab"))


def _test(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, least_share: float) -> DataFrame:
    """Those of the pairs (a, b) that are linked: estimated on sketches first, then compared on whole texts."""
    near = _pairs(pairs, sketches).select("a", "b", "low_a", "low_b", "n_a", "n_b").mapInArrow(lambda batches: _estimate(batches, least_share), "a long, b long")
    return _pairs(near, texts).mapInArrow(_confirm, "a long, b long")


_PLACE = f"pmod(xxhash64(CAST(doc_id AS BIGINT)), {BITS})"


def bitmap(ids: DataFrame, files: int | None = None) -> DataFrame:
    """A set of doc_ids as bits of their hashes, in words of 64: BITS / 64 rows at most, however many ids."""
    words = ids.where("doc_id IS NOT NULL").groupBy(F.expr(f"{_PLACE} div 64").alias("_millrace_word")).agg(F.expr(f"bit_or(shiftleft(1L, CAST({_PLACE} % 64 AS INT)))").alias("_millrace_bits"))
    return F.broadcast(cut(words, files))


def marked(df: DataFrame, bits: DataFrame) -> DataFrame:
    """``df`` with _millrace_hit = 1 in rows whose doc_id may be in the set; 0 says that it is not."""
    met = df.join(bits, F.expr(f"{_PLACE} div 64 = _millrace_word"), "left")
    return met.withColumn("_millrace_hit", F.expr(f"coalesce(getbit(_millrace_bits, CAST({_PLACE} % 64 AS INT)), 0)")).drop("_millrace_word", "_millrace_bits")


def near_documents(documents: DataFrame, pivots: int = 1, least_share: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document: the smallest doc_id that links lead to.

    1. A document's sketch is the ``K`` least hashes of its shingles. Documents with one set
       are folded into their smallest id.
    2. Values that only one sketch holds link nothing. A document with fewer others than a
       link needs is done; of the others, a linked pair must share one of each's rarest
       (their number less what a link needs, and one). Only these make inverted lists.
    3. In a list, by classes of size, each document meets one pivot, so lists cost their length.
       The pivot is the document whose values are the most common: in a group of copies, what
       they are copies of. Of its pivots, a document tries the one it meets most often first; of
       the others, those to which no path leads then. Pivots that seem to have too little in
       common with it, by a guess from sketches, are left to step 4.
    4. What lists still hold several components is gone through. How much a document can have in
       common with any other is counted there on whole sets. Each document outside a list's
       largest component meets those of other components, as far as both counts and sizes allow a
       link. So documents that have just a passage in common do not meet, nor do copies that
       each went their own way. No list is cut short and no pair that may be linked is dropped.
    5. A pair is estimated by the sketch of its union and then confirmed on the whole sets of
       both texts.

    ``least_share`` is the part of a sketch that a linked pair must share for sets beyond the
    sketch. At the default a pair of similarity 0.75 is missed once in a million, and less
    above; 0 misses none that has a value in common, and looks at many more pairs.

    Hashes of 64 bits stand for shingles, and 128 bits for equal sets. The driver holds counts.
    Nulls: a null, empty or blank text has no shingles and is linked with nothing. A row with a
    null doc_id is linked with nothing, has no component and is not kept. Rows that share a
    doc_id share its links. An empty table gives no rows.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = stash(rows.mapInArrow(lambda batches: _sketches(batches, least_share), "doc_id long, n long, whole binary, low array<long>, need int"), "sketches")
    able = sketched.where("n > 0 AND doc_id IS NOT NULL")
    # most tables from here on have a few rows for each shingle at most: their files follow that, not the number of partitions
    files = files_for(sketched.sparkSession, sketched.agg(F.sum(F.col("n") + 1)).first()[0] or 0)
    folds = stash(able.groupBy("whole").agg(F.min("doc_id").alias("head"), F.count("*").alias("copies")).where("copies > 1").select("whole", "head"), "near", files)
    heads = able.join(folds.withColumnRenamed("head", "fold"), "whole", "left").where("fold IS NULL OR fold = doc_id").select("doc_id", "n", "low", "need")
    again = not able.groupBy("doc_id").count().where("count > 1").isEmpty()  # ids that repeat need more work
    once = lambda df: df.dropDuplicates(["doc_id"]) if again else df
    heads = stash(once(heads), "heads", files)

    posts = heads.select("doc_id", "need", "n", F.explode("low").alias("v"))
    often = stash(posts.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "near", files)
    own = Window.partitionBy("doc_id")
    shared = posts.join(often, "v").withColumn("c", F.count("*").over(own)).where("c >= need").withColumn("mid", F.sum(F.log("df")).over(own))
    shared = shared.withColumn("r", F.row_number().over(own.orderBy("df", "v"))).where("r <= c - need + 1")
    # a guess at the most that a document has in common with any other: what others' sketches hold too of the whole set, or of the sketch and 4.5 deviations
    # (of draws without return). No bound where a partner's set may exceed its sketch, n > 96; it only tells which pivots are tried before step 4
    spread = F.sqrt(F.col("c") * (K - F.col("c")) / K * (F.col("n") - K) / (F.col("n") - 1))
    most = F.when(F.col("n") <= K, F.col("c")).otherwise(F.least("n", F.ceil(F.col("n") * (F.col("c") + 4.5 * spread + 1) / K)))
    size = F.floor(F.log(F.col("n")) / math.log(CLASS)).cast("int")
    lists = stash(shared.select("v", "doc_id", "n", "mid", most.alias("u"), size.alias("size")), "lists", files)

    # candidates by a bitmap of fixed size; where it fills up, it only saves less
    bits = bitmap(lists.select("doc_id"), files)
    asked = lambda df: marked(df, bits).where("_millrace_hit = 1").drop("_millrace_hit")
    sketches = stash(asked(heads).select("doc_id", "n", "low"), "asked-sketches", files)
    texts = stash(once(asked(rows)), "asked-texts", files)

    parts = None

    def label(df: DataFrame, side: str) -> DataFrame:
        if parts is None:
            return df.withColumn(f"part_{side}", F.col(side))
        return df.join(parts.select(F.col("node").alias(side), F.col("component").alias(f"part_{side}")), side, "left").withColumn(f"part_{side}", F.coalesce(f"part_{side}", side))

    def settle(pairs: DataFrame) -> None:
        nonlocal parts
        found = stash(_test(pairs, sketches, texts, least_share), "near", files)
        if not found.isEmpty():
            fresh = found if parts is None else parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found)
            parts = components(fresh.select(F.col("a").alias("u"), F.col("b").alias("v")), files=files)

    may = "7 * least(u, u_b) >= 3 * (n + n_b) AND 4 * least(n, n_b) >= 3 * greatest(n, n_b)"  # whether two sizes allow a link
    if pivots:
        # the most central document of a list: its values are the most common
        pivot = lists.groupBy("v", "size").agg(F.max_by(F.struct(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("u").alias("u_b")), F.struct("mid", "doc_id")).alias("p"), F.count("*").alias("m"))
        pivot = stash(pivot.where("m > 1").select("v", "size", "p.*"), "near", files)
        met = lists.join(pivot, ["v", "size"]).where(f"doc_id <> b AND {may}").groupBy(F.col("doc_id").alias("a"), "b").agg(F.count("*").alias("w"))
        ranked = stash(met.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("w"), "b"))), "near", files)
        settle(ranked.where("r = 1").select("a", "b"))
        settle(label(label(ranked.where("r > 1"), "a"), "b").where("part_a <> part_b").select("a", "b"))
    # what is left: lists with several components. Of their documents, the most in common with any other is counted on whole sets.
    member = stash(label(lists.select("v", F.col("doc_id").alias("a"), "n"), "a"), "near", files)
    open_ = member.groupBy("v").agg(F.min("part_a").alias("x"), F.max("part_a").alias("y")).where("x < y").select("v")
    member = stash(member.join(stash(open_, "near", files), "v"), "near", files)
    left = stash(member.select(F.col("a").alias("doc_id")).distinct(), "near", files)
    whole = texts.join(left, "doc_id").mapInArrow(_spell, "a long, s long")
    common = whole.join(stash(whole.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "near", files), "s")
    mine = Window.partitionBy("a")
    common = common.withColumn("u", F.count("*").over(mine)).withColumn("mid", F.sum(F.log("df")).over(mine)).withColumn("r", F.row_number().over(mine.orderBy("df", "s")))
    common = common.join(stash(member.select("a", "n", "part_a").distinct(), "near", files), "a").where("7 * u >= 3 * (n + ceil(0.75 * n))").withColumnRenamed("s", "v")
    # of a pair, the larger document looks in the size classes of what it may be linked with; each brings the rarest of its
    # values, as many as must hold one that both have: the smaller shares 6/7 of its set at least, the larger what the class asks for
    class_of = lambda n: F.floor(F.log(n) / math.log(CLASS)).cast("int")
    low, high = F.ceil(0.75 * F.col("n")), F.least(F.col("n"), F.floor(F.col("u") * 7 / 3 - F.col("n")))
    least = F.greatest(low, F.floor(F.pow(F.lit(CLASS), F.col("size"))))
    looks = common.where(high >= low).withColumn("size", F.explode(F.sequence(class_of(low), class_of(high)))).where(F.col("r") <= F.col("u") - F.ceil((F.col("n") + least) * 3 / 7) + 1).withColumn("looks", F.lit(True))
    found = common.where("r <= u - ceil(n * 6 / 7) + 1").withColumn("size", class_of(F.col("n"))).withColumn("looks", F.lit(False))
    every = stash(looks.unionByName(found).drop("df", "r"), "near", files)
    kinds = every.groupBy("v", "size", "part_a").agg(F.count("*").alias("m")).groupBy("v", "size").agg(F.max_by("part_a", F.struct("m", "part_a")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1").select("v", "size", "main")
    # what two documents share lies within a third, the list's most central, or outside it; neither part exceeds what each has there
    every = stash(every.join(stash(kinds, "near", files), ["v", "size"]), "near", files)
    hubs = stash(every.groupBy("v", "size").agg(F.max_by("a", F.struct("mid", "a")).alias("hub")), "near", files)
    every = every.join(hubs, ["v", "size"])
    inside = stash(_pairs(every.where("a <> hub").select("a", F.col("hub").alias("b")).distinct(), texts).mapInArrow(_overlap, "a long, hub long, inside long"), "near", files)
    every = stash(every.join(inside, ["a", "hub"], "left").withColumn("inside", F.coalesce("inside", "n")).withColumn("outside", F.greatest(F.lit(0), F.col("u") - F.col("inside"))), "near", files)
    larger, minor = every.where("looks"), F.col("part_a") != F.col("main")
    other = every.where("NOT looks").select("v", "size", F.col("a").alias("b"), F.col("n").alias("n_b"), F.col("u").alias("u_b"), F.col("inside").alias("inside_b"), F.col("outside").alias("outside_b"), F.col("part_a").alias("part_b"), (F.col("part_a") != F.col("main")).alias("minor_b"))
    # two documents of the list's largest component have a path; each other pair has one outside it
    where = f"part_a <> part_b AND (n_b < n OR n_b = n AND b < a) AND {may} AND 7 * (least(inside, inside_b) + least(outside, outside_b)) >= 3 * (n + n_b)"
    pairs = larger.where(minor).join(other, ["v", "size"]).where(where).unionByName(larger.where(~minor).join(other.where("minor_b"), ["v", "size"]).where(where))
    settle(pairs.select("a", "b").distinct())

    out = sketched.select("doc_id", "n", "whole").join(folds, "whole", "left").withColumn("head", F.when(F.col("n") > 0, F.coalesce("head", "doc_id")).otherwise(F.col("doc_id")))
    if parts is not None:
        out = out.join(parts.withColumnRenamed("node", "head"), "head", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "head")))
    else:
        out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("head")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_near_copies(documents: DataFrame) -> DataFrame:
    """``documents`` without those that links lead from to a smaller doc_id.

    Texts whose id is in no removed id's place of a bitmap stay where they are; only the
    others, little more than those removed, are shuffled to be held against the removed ids.
    Ids may be whole numbers of any width. Rows without an id stay, as do those without a word;
    of rows that share an id, all stay or all go. An empty table gives no rows.
    """
    told = near_documents(documents)
    gone = cut(told.where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct())
    if gone.isEmpty():
        return documents
    met = marked(documents, bitmap(gone))
    maybe = met.where("_millrace_hit = 1").drop("_millrace_hit").join(gone.withColumnRenamed("doc_id", "_millrace_gone"), F.col("doc_id") == F.col("_millrace_gone"), "left_anti")
    return met.where("_millrace_hit = 0").drop("_millrace_hit").unionByName(maybe)


def op8_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : least(i + 4, len(w))], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (max(x.n) + max(y.n) - count(*))
), r AS (
  SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a
), c AS (
  SELECT a, min(c) AS c FROM r GROUP BY a
)
SELECT c.a AS doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, c.a = c.c AS kept
FROM c LEFT JOIN n ON n.doc_id = c.a
"""
