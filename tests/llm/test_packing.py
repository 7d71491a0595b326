import bisect
import json
import random
import zlib

import numpy as np
import pytest
import tokenizers

from millrace.llm.packing import Encoder, Tree, best_fit, default_tokenizer, op5_best_fit_packing, pack


@pytest.fixture(scope="module")
def plain_ids():
    t = tokenizers.Tokenizer.from_file(default_tokenizer())
    return lambda texts: [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


def check(rows, texts, plain_ids, capacity=1024):
    """Pieces are those of the texts' own ids, and sequences are filled without gaps."""
    want = {}
    for i, raw in zip([i for i, _ in texts], plain_ids([t or "" for _, t in texts]), strict=True):
        raw += b"\2\0\0\0"
        n = len(raw) // 4
        ends = [*range(n, 0, -capacity)][::-1]
        for piece, (a, z) in enumerate(zip([0, *ends], ends, strict=False)):
            want.setdefault((i, piece, a, z - a, zlib.crc32(raw[4 * a : 4 * z])), []).append(1)
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.piece, r.start, r.length, r.ids_crc32), []).append(1)
    assert got == want
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert all(x <= capacity for x in at.values())
    return len(at)


def one_by_one(lengths, capacity):
    room, bins = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(room, n)
        left = room.pop(i) - n if i < len(room) else capacity - n
        bins += i == len(room) and left == capacity - n and not (i < len(room))
        bisect.insort(room, left)
    return len(room)


def test_query(spark, sf, plain_ids):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(sf("sf0.001") + "/documents.parquet").select("doc_id", "text").collect()]
    rows = op5_best_fit_packing(spark, sf("sf0.001")).collect()
    assert check(rows, texts, plain_ids) == one_by_one([r.length for r in rows], 1024)


def test_odd_rows(spark, docs, plain_ids):
    texts = [(1, None), (2, ""), (3, "  a   b \n\n c "), (3, "  a   b \n\n c "), (None, "x"), (4, "word " * 3000), (5, "<|endoftext|>"), (6, "é" * 5000), (7, "\x00 \x85 　 　 \x1c x")]
    assert check(pack(docs(texts).repartition(3), default_tokenizer(), 64).collect(), texts, plain_ids, 64)
    assert pack(docs([]), default_tokenizer()).count() == 0


def test_ids_of_any_text(plain_ids):
    rng = random.Random(1)
    letters = ["a", "B", "é", "1", "²", "'s", "'", " ", "  ", "\n", "\t", " ", "　", ",", "_", "ß", "\x1c", "漢", "́", "😀", "-", "\r\n", "\x85"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(20000)]
    assert list(Encoder(default_tokenizer())(texts)) == plain_ids(texts)


def test_query_gives_added_tokens_their_ids(spark, docs, tmp_path, plain_ids):
    ids = plain_ids
    texts = ["hello <|endoftext|> x", "<|endoftext|>", "<|endoftext|><|endoftext|>", "a  <|endoftext|>\n\n b", "<|endoftext|", "x <|ENDOFTEXT|> y", "a<|endoftext|>b c", "<<|endoftext|>>"]
    assert ids(texts[:1]) == [np.array([31373, 220, 50256, 2124], "<u4").tobytes()]
    rows = list(enumerate(texts))
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    check(op5_best_fit_packing(spark, str(tmp_path)).collect(), rows, ids)
    t = tokenizers.Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = True
    assert list(Encoder(default_tokenizer(), added=False)(texts)) == [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": None}])
def test_files_of_another_kind_are_refused(tmp_path, change):
    (tmp_path / "t.json").write_text(json.dumps(json.loads(open(default_tokenizer()).read()) | change))
    with pytest.raises(ValueError):
        Encoder(str(tmp_path / "t.json"))


@pytest.mark.parametrize("seed", range(8))
def test_runs_pack_as_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 100, 1024])
    lengths = [min(capacity, max(1, int(rng.expovariate(1 / rng.uniform(1, capacity))))) for _ in range(rng.randint(0, 3000))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = best_fit(counts, capacity)
    bins, seen = {}, {n: 0 for n in counts}
    for i, (length, rank, first, each, offset) in enumerate(plan):
        assert rank == seen[length]
        last = i + 1 == len(plan) or plan[i + 1][0] != length
        stop = counts[length] if last else plan[i + 1][1]
        seen[length] = stop
        for k in range(stop - rank):
            bins.setdefault(first + k // each, []).append((offset + k % each * length, length))
    assert seen == counts
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(bins) == list(range(len(bins))) and len(bins) == one_by_one(lengths, capacity)


def test_plan_does_not_grow_with_pieces():
    few, many = ({n: 7 * k + 13 for n in range(1, 1025)} for k in (1, 1_000_000))
    assert len(best_fit(many, 1024)) < 20 * 1024 and len(best_fit(few, 1024)) < 20 * 1024


def test_tree():
    t = Tree(1024)
    for c in (3, 700, 1024):
        t.set(c, 1)
    assert [t.tightest(n) for n in (1, 3, 4, 700, 701, 1024)] == [3, 3, 700, 700, 1024, 1024]
    t.set(1024, 0)
    assert t.tightest(701) is None
