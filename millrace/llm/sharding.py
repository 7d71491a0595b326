"""Sharding by balanced label propagation: linked documents move together while shards keep equal numbers of rows."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, files_for, small, table

LEAST_SALTS, ROWS_A_SALT = 256, 20_000
ROWS_A_FILE = 100_000  # of narrow rows, at least
CHUNK = 64  # bucket sums that are added up together


def _salts(rows: int) -> int:
    return max(LEAST_SALTS, math.ceil(rows / ROWS_A_SALT))


def _running(df: DataFrame, by: list[str], amount: str, order: list[Column], bucket: Column, buckets: int, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows before, per value of ``by``: sums of buckets first, then within a bucket.

    ``bucket`` comes first in the order. No window holds more than a bucket's rows, or more than
    4 * CHUNK sums: where there are more buckets than that, their sums are added up in the same way.
    """
    df = df.withColumn("_b", bucket)
    sums = df.groupBy(*by, "_b").agg(F.sum(amount).alias("_n"))
    if buckets > 4 * CHUNK:
        before = _running(sums.withColumnRenamed("_b", "_low"), by, "_n", [F.col("_low")], F.floor(F.col("_low") / CHUNK), buckets // CHUNK + 1, "_sum").select(*by, F.col("_low").alias("_b"), F.col("_sum").alias("_before"))
    else:
        before = sums.withColumn("_before", F.sum("_n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    inner = F.sum(amount).over(Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = df.withColumn("_inner", inner).join(before, [*by, "_b"])
    return out.withColumn(name, F.coalesce("_before", F.lit(0)) + F.coalesce("_inner", F.lit(0))).drop("_b", "_inner", "_before")


def _largest_first(amount: str, salts: int) -> Column:
    """Buckets in the order of falling powers of 2, and within one of a hash of the group."""
    return ((F.lit(31) - F.least(F.lit(31), F.floor(F.log2(F.col(amount) + 1)))) * salts + F.pmod(F.xxhash64("g"), F.lit(salts))).cast("long")


def admitted(asked: dict[tuple[int, int], int], room: dict[int, int]) -> dict[tuple[int, int], int]:
    """How many of the members that ask to go from shard i to shard j may, so that none exceeds its quota; at most a number a pair of shards.

    Exchanges first, as they change no size; then what there is room for, where each that leaves makes room behind it.
    """
    given = {(i, j): min(n, asked.get((j, i), 0)) for (i, j), n in asked.items()}
    room, moved = dict(room), True
    while moved:
        moved = False
        for (i, j), n in sorted(asked.items(), key=lambda x: (-x[1], x[0])):
            more = min(n - given[i, j], room[j])
            if more > 0:
                given[i, j] += more
                room[j] -= more
                room[i] += more
                moved = True
    return given


def propagate(state: DataFrame, quota: list[int], salts: int, rounds: int, files: int | None = None) -> tuple[DataFrame, list[int]]:
    """The labels after so many rounds, and the number of cut links before the first and after each.

    ``state`` is (g, shard, n): how many members of a group carry a label. The members of a group
    are linked each with each, and so are alike but for their labels: counts say all there is
    to know of a link's two ends, a row for each group and label instead of a row a link.

    In a round each group looks where its members are now. The label that most of them carry is
    where the others ask to go; a group larger than a shard keeps as many labels as it fills, the
    most frequent first. Labels whose shard is full come last, as nobody gets in there, unless
    the group fills it alone.
    ``admitted`` says how many of those who ask may go from each shard to each other; those whose
    group holds most at the goal go first, and the others ask again in the next round, by where
    their neighbours are then. ``files`` bounds the files that a round writes, as for ``cut``.
    """
    spark, state = state.sparkSession, cut(state, files)
    links = lambda df: int(df.agg(F.coalesce(F.sum(F.col("n").cast("decimal(38,0)") * (F.col("n") - 1)), F.lit(0))).first()[0]) // 2
    every, kept = links(state.groupBy("g").agg(F.sum("n").alias("n"))), links(state)
    cuts = [every - kept]
    for _ in range(rounds if cuts[0] else 0):
        held = {r.shard: r.n for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row a shard
        room = {s: q - held.get(s, 0) for s, q in enumerate(quota)}
        full = F.col("shard").isin([s for s, n in room.items() if n <= 0])
        own = Window.partitionBy("g")  # at most a row a shard
        ranked = state.withColumn("q", F.array(*map(F.lit, quota))[F.col("shard")].cast("long")).withColumn("size", F.sum("n").over(own))
        ranked = ranked.withColumn("k", F.row_number().over(own.orderBy(full & (F.col("n") < F.col("q")), F.desc("n"), F.xxhash64("g", "shard"))))
        ranked = ranked.withColumn("want", F.greatest(F.lit(0), F.least("q", F.col("size") + F.col("q") - F.sum("q").over(own.orderBy("k")))))
        ranked = ranked.where("size > n").withColumn("over", F.greatest(F.lit(0), F.col("n") - F.col("want"))).withColumn("under", F.greatest(F.lit(0), F.col("want") - F.col("n")))
        upto = lambda c: F.sum(c).over(own.orderBy("k"))
        ranked = ranked.withColumn("over_to", upto("over")).withColumn("under_to", upto("under"))
        leave = ranked.where("over > 0").select("g", F.col("shard").alias("i"), "over", "over_to", F.col("n").alias("here"))
        enter = ranked.where("under > 0").select("g", F.col("shard").alias("j"), "under", "under_to", F.col("n").alias("there"))
        m = F.least("over_to", "under_to") - F.greatest(F.col("over_to") - F.col("over"), F.col("under_to") - F.col("under"))
        moves = cut(leave.join(enter, "g").withColumn("m", m).where("m > 0").select("g", "i", "j", "m", "here", "there"), files)
        asked = {(r.i, r.j): r.m for r in moves.groupBy("i", "j").agg(F.sum("m").alias("m")).collect()}  # a row a pair of shards
        may = admitted(asked, room)
        if not sum(may.values()):
            break
        if may != asked:
            allowed = F.broadcast(small(spark, [(i, j, n) for (i, j), n in may.items() if n], i=pa.int32(), j=pa.int32(), allowed=pa.int64()))  # a row a pair of shards
            moves = _running(moves, ["i", "j"], "m", [F.desc("there"), F.col("g")], _largest_first("there", salts), 32 * salts, "before").join(allowed, ["i", "j"]).withColumn("m", F.least("m", F.col("allowed") - F.col("before"))).where("m > 0 AND m > here - there")  # a part of a share that would leave more behind stays
        changed = state.unionByName(moves.select("g", F.col("i").alias("shard"), (-F.col("m")).alias("n"))).unionByName(moves.select("g", F.col("j").alias("shard"), F.col("m").alias("n")))
        changed = cut(changed.groupBy("g", "shard").agg(F.sum("n").alias("n")).where("n > 0"), files)
        now = every - links(changed)
        if now >= cuts[-1]:
            break
        state = changed
        cuts.append(now)
        if not now:
            break
    return state, cuts


def assign_shards(rows: DataFrame, shards: int, total: int, rounds: int = 8) -> DataFrame:
    """(g, lo, hi, shard, base): which shard takes members lo to hi - 1 of each group of ``rows`` (g, salt), and the slot of the first.

    Labels start from a hash of the document and spread among the members of groups (propagate).
    A group that fills whole shards starts with these for itself, as no exchange would bring the
    small groups in them to leave; there are no more such groups than shards.
    Documents without links, which cut nothing wherever they are, then fill what the quotas leave
    free, in the order of a hash. Quotas are whole: N over ``shards``, rounded up for the first N mod
    ``shards``, so counts differ by one at most, whatever the links.
    """
    spark, salts = rows.sparkSession, 8 * _salts(total)
    files = files_for(spark, total, least=ROWS_A_FILE)  # no table from here on has more rows than there are documents, whatever the number of partitions
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    spread = F.pmod(F.xxhash64("g"), F.lit(salts)).cast("int")
    start = rows.groupBy("g", F.pmod(F.xxhash64("salt", "g"), F.lit(shards)).cast("int").alias("shard")).agg(F.count("*").alias("n"))
    sized = cut(start.groupBy("g").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("held")), files)  # at most a number a shard
    least = max(2, total // shards)
    seeds, taken, at = [], set(), 0
    for r in sized.where(F.col("n") >= least).select("g", "n").orderBy(F.desc("n"), "g").limit(shards).collect():
        left = r.n
        while at < shards and left >= quota[at]:
            seeds.append((r.g, at, quota[at]))
            left, at = left - quota[at], at + 1
        if left < r.n:
            taken.add(bytes(r.g))
            if left:
                seeds.append((r.g, at % shards, left))
    state = sized.where("n > 1").select("g", F.explode("held").alias("shard", "n"))
    if taken:
        state = state.where(~F.col("g").isin(list(taken))).unionByName(small(spark, seeds, g=pa.binary(), shard=pa.int32(), n=pa.int64()))  # two rows a shard at most
    state, _ = propagate(_within(state, quota, salts, files), quota, salts, rounds, files)
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = state.withColumn("lo", ahead).select("g", "lo", (F.col("lo") + F.col("n")).alias("hi"), "shard")
    held = {r.shard: r.n for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row a shard
    gaps, at = [], 0
    for s, q in enumerate(quota):
        free = q - held.get(s, 0)
        if free:
            gaps.append((s, at, at + free))
        at += free
    if gaps:
        open_ = F.broadcast(small(spark, gaps, shard=pa.int32(), first=pa.int64(), stop=pa.int64()))  # a row a shard
        laid = _running(sized.where("n = 1").select("g", "n"), [], "n", [F.col("g")], spread, salts, "pos")
        fill = laid.join(open_, (F.col("first") <= F.col("pos")) & (F.col("pos") < F.col("stop"))).select("g", F.lit(0).cast("long").alias("lo"), F.lit(1).cast("long").alias("hi"), "shard")
        placed = placed.unionByName(fill)
    placed = cut(placed.withColumn("size", F.col("hi") - F.col("lo")), files)
    return _running(placed, ["shard"], "size", [F.col("g"), F.col("lo")], spread, salts, "base").select("g", "lo", "hi", "shard", "base")


def _within(state: DataFrame, quota: list[int], salts: int, files: int | None = None) -> DataFrame:
    """``state`` where no label has more members than its quota: of those over it the smallest shares get the labels that have room."""
    held = {r.shard: r.n for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row a shard
    over = {s: n - quota[s] for s, n in held.items() if n > quota[s]}
    if not over:
        return state
    spark, state, starts, at = state.sparkSession, cut(state, files), [], 0
    for s in sorted(over):
        starts.append((s, quota[s], at))
        at += over[s]
    gaps, to = [], 0
    for s, q in enumerate(quota):
        free = max(0, q - held.get(s, 0))
        if free:
            gaps.append((s, to, to + free))
            to += free
    full = F.broadcast(small(spark, starts, shard=pa.int32(), quota=pa.int64(), at=pa.int64()))  # a row a shard
    open_ = F.broadcast(small(spark, gaps, goal=pa.int32(), first=pa.int64(), stop=pa.int64()))  # a row a shard
    rows = _running(state.join(full, "shard"), ["shard"], "n", [F.desc("n"), F.col("g")], _largest_first("n", salts), 32 * salts, "before")
    rows = rows.withColumn("stay", F.greatest(F.lit(0), F.least("n", F.col("quota") - F.col("before")))).withColumn("pos", F.col("at") + F.greatest(F.lit(0), F.col("before") - F.col("quota")))
    sent = rows.where("stay < n").join(open_, (F.col("first") < F.col("pos") + F.col("n") - F.col("stay")) & (F.col("pos") < F.col("stop")))
    sent = sent.select("g", F.col("goal").alias("shard"), (F.least(F.col("pos") + F.col("n") - F.col("stay"), "stop") - F.greatest("pos", "first")).alias("n"))
    stay = rows.where("stay > 0").select("g", "shard", F.col("stay").alias("n"))
    rest = state.join(full.select("shard"), "shard", "left_anti").select("g", "shard", "n")
    return rest.unionByName(stay).unionByName(sent).groupBy("g", "shard").agg(F.sum("n").alias("n"))


def shard_documents(documents: DataFrame, shards: int = 40, rounds: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document, under the law ``rows``.

    Documents with equal texts are linked. Their links are kept within a shard as far as the
    quotas allow (propagate). A document's number within its group comes from a hash of its
    id and counts per hash, so a group with a third of all rows spreads over many tasks, and
    texts are read once and not shuffled. The range of that hash follows the number of rows.
    Size is the text's UTF-8 bytes and 16. The result has as few partitions as ``files_for`` says.

    Nulls: a null text has no bytes, and null texts form a group with empty ones; doc_id may
    be null or repeat, and each row gets a slot. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    total = documents.count()
    salt = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(_salts(total))).cast("int")
    rows = cut(documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("g")).withColumn("salt", salt), files_for(documents.sparkSession, total, ROWS_A_SALT))  # texts may be long: two a core at least
    plan = assign_shards(rows, shards, total, rounds)
    # members of a group are numbered by salt, then by id; ranges of numbers meet salts before rows meet either
    counts = rows.groupBy("g", "salt").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("g").orderBy("salt")) - F.col("n")  # a row a salt
    parts = counts.withColumn("ahead", ahead).join(plan, "g").where("lo < ahead + n AND ahead < hi")
    nth = F.row_number().over(Window.partitionBy("g", "salt").orderBy("doc_id")) - 1
    met = rows.withColumn("nth", nth).join(parts, ["g", "salt"]).where("ahead + nth >= lo AND ahead + nth < hi")
    slot = F.col("base") + F.col("ahead") + F.col("nth") - F.col("lo")
    return met.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard")).coalesce(files_for(documents.sparkSession, total, least=ROWS_A_FILE))


def op6_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=40)
