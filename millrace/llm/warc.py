"""WARC archives under Zstandard: a frame for each record, all by one dictionary that the archive's first frame carries."""

from __future__ import annotations

import hashlib
import re
import struct
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_path, stash, table

# Fixed values of the Zstandard and WARC formats.
FRAME_MAGIC = 0xFD2FB528
SKIPPABLE_FIRST, SKIPPABLE_LAST = 0x184D2A50, 0x184D2A5F
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An empty skippable frame, which stands between records: plain ASCII, so that Spark's text writer can end each row with it.
BETWEEN = "P*M\x18\x00\x00\x00\x00"

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
SAMPLES, DICTIONARY_BYTES = 200, 16384
#: An archive has at most so many pieces, each at least so large, and ends early where it outgrows their product.
PIECES, PIECE_BYTES = 256, 1 << 18


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    urn = lambda x: f"<urn:page:{'null' if x is None else x}>"
    revisit = refers_to is not None
    block = HTTP if revisit else HTTP + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        head += [("WARC-Refers-To", urn(refers_to)), ("WARC-Profile", PROFILE)]
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("X-Payload-Length", len(payload)), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in head)]) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:  # too little to train on: the records themselves serve
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:].rjust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _write(batches: Iterator[pa.RecordBatch], pieces: int, piece_bytes: int) -> Iterator[pa.RecordBatch]:
    """One task's archives, piece by piece. The writer begins a file after every ``pieces`` rows; an archive that ends before fills up with empty ones.

    Each archive has its own dictionary, which learns from its first records, SAMPLES at most.
    """

    def records():
        for b in batches:
            for page_id, url, html, digest, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "payload_digest", "refers_to")), strict=True):
                yield _record(page_id, url, (html or "").encode(), digest, refers_to)

    rows = lambda values: pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], ["value"])
    source, waiting, limit = records(), deque(), pieces * piece_bytes
    while True:
        size = sum(map(len, waiting))
        for r in source if len(waiting) < SAMPLES else ():
            waiting.append(r)
            size += len(r)
            if len(waiting) >= SAMPLES or size >= limit // 8:
                break
        if not waiting:
            return
        learnt = _dictionary(list(waiting))
        raw = learnt.as_bytes()
        pack = zstandard.ZstdCompressor(level=3, dict_data=learnt, write_content_size=True, write_checksum=True)
        held, size, whole, done = [struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw], 0, 0, 0
        for r in iter(lambda: waiting.popleft() if waiting else next(source, None), None):
            held.append(pack.compress(r))
            size += len(held[-1])
            if size >= piece_bytes:
                yield rows([BETWEEN.encode().join(held)])
                held, whole, size, done = [], whole + size, 0, done + 1
                if done == pieces or whole >= limit:
                    break
        else:
            if held:
                yield rows([BETWEEN.encode().join(held)])
            return
        if done < pieces:
            yield rows([b""] * (pieces - done))


def _frames(data: memoryview) -> Iterator[tuple[int, memoryview]]:
    """(magic, bytes) of each frame of an archive, found by the lengths that headers and blocks state."""
    at = 0
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError(f"archive ends inside a frame header at byte {at}")
        magic, length = struct.unpack_from("<II", data, at)
        if SKIPPABLE_FIRST <= magic <= SKIPPABLE_LAST:
            end = at + 8 + length
            if end <= len(data):
                yield magic, data[at + 8 : end]
        elif magic == FRAME_MAGIC:
            end, last = at + zstandard.frame_header_size(data[at : at + 18]), False
            while not last and end + 3 <= len(data):
                block = int.from_bytes(data[end : end + 3], "little")
                last, end = bool(block & 1), end + 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            end += 4 * (data[at + 4] >> 2 & 1)
            if last and end <= len(data):
                yield magic, data[at:end]
            else:
                end = len(data) + 1
        else:
            raise ValueError(f"no Zstandard frame at byte {at}")
        if end > len(data):
            raise ValueError(f"archive ends inside the frame at byte {at}")
        at = end


def parse_record(raw: bytes) -> dict:
    """The fields of one whole record; ValueError if a header, length or digest is wrong."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", first):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon or not name.strip():
            raise ValueError(f"bad header line {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"header {name} is missing")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length differs from the block")
    block = rest[:-4]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("block digest differs")
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha256:")
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    if kind == "revisit":
        if "warc-refers-to" not in fields:
            raise ValueError("a revisit refers to nothing")
        payload, size = None, int(fields.get("x-payload-length", 0))
    else:
        size = len(payload)
        if digest and digest != hashlib.sha256(payload).hexdigest():
            raise ValueError("payload digest differs")
        if int(fields.get("x-payload-length", size)) != size:
            raise ValueError("payload length differs")
    of = lambda urn: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", urn)) else None
    uri = fields.get("warc-target-uri")
    return {
        "page_id": of(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": of(fields.get("warc-refers-to", "")),
        "url": None if uri is None else uri.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), "payload": payload,
    }


SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name, content in zip(b.column("path"), b.column("content"), strict=True):
            data, unpack, out, size = memoryview(content.as_buffer()), None, [], 0
            for k, (magic, frame) in enumerate(_frames(data)):
                if magic == DICTIONARY_MAGIC:
                    if k:
                        raise ValueError(f"{name}: a dictionary after the first frame")
                    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(frame)))
                elif magic == FRAME_MAGIC:
                    unpack = unpack or zstandard.ZstdDecompressor()
                    out.append(parse_record(unpack.decompress(frame)))
                    size += len(out[-1]["payload"] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, _ARROW)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, _ARROW)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 100, pieces: int = PIECES, piece_bytes: int = PIECE_BYTES) -> None:
    """A record for each row of ``pages`` (page_id, url, html), as Zstandard archives in the folder ``path``.

    A task writes as many archives as it takes for each to have ``pieces`` times ``piece_bytes`` bytes
    (64 MB) and a record at most, so that reading one takes little memory whatever the input's size.

    Payloads of at least ``least_bytes`` that are equal, by SHA-256, are stored once: the
    smallest page_id has the response, the others revisit it. Which row revisits which is
    settled on ids and digests alone; the texts meet that by page_id, so a payload that many
    pages share makes no task large. Spark's own writer and committer put the archives into
    any file system that Spark reaches, and a lost executor costs only its task.

    Nulls: null html is an empty payload; a null url has no header; a row with a null
    page_id is a response. Rows that repeat the smallest page_id of their payload are
    responses too. An empty table makes no archive.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("payload_digest", F.sha2("html", 256))
    large = cut(rows.where(F.octet_length("html") >= least_bytes).select("page_id", "payload_digest"))
    first = cut(large.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"))
    again = large.join(first, "payload_digest").where("page_id > refers_to").distinct()
    told = rows.join(again, ["page_id", "payload_digest"], "left").select("page_id", "url", "html", "payload_digest", "refers_to")
    # the cast keeps the bytes as they are; the text writer copies them
    written = told.mapInArrow(lambda batches: _write(batches, pieces, piece_bytes), "value binary").select(F.col("value").cast("string").alias("value"))
    written.write.option("lineSep", BETWEEN).option("maxRecordsPerFile", pieces).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives in a folder: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    The dictionary comes from the leading skippable frame, where there is one; each further
    frame must hold exactly one record. Wrong headers, lengths, digests or frames raise ValueError.
    A revisit tells the length and digest of a payload that another record holds: ``wrong_revisits``
    compares them.
    """
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read, SCHEMA)


def wrong_revisits(records: DataFrame) -> DataFrame:
    """(refers_to, payload_digest, payload_bytes, n) of the revisits for which no response of that page_id has that digest and length.

    Revisits of one response are first added up, so one that a third of all records refer to is a row here.
    """
    claims = records.where("record_type = 'revisit'").groupBy("refers_to", "payload_digest", "payload_bytes").agg(F.count("*").alias("n"))
    held = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes")
    return claims.join(held, ["refers_to", "payload_digest", "payload_bytes"], "left_anti")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives written and read back; ValueError if a revisit tells something else than the response it refers to."""
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    records = stash(read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc-records")
    wrong = wrong_revisits(records).first()
    if wrong:
        raise ValueError(f"{wrong.n} revisits of page {wrong.refers_to} differ from it")
    return records


OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""
