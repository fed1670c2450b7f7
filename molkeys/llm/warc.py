"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle is a run of frames and, in a skippable frame at its end,
the seek table of their sizes, so any Zstandard reader reads a bundle whole and a seeking reader opens one frame. A
record identifier is mapped to (bundle, frame, offset of the frame, offset in the frame). Bundles are written by
Spark's own text writer, whose committer leaves out the output of lost or repeated tasks: one bundle is one value, and
the line separator is the four bytes that end a seek table.

Cases: null html is an empty payload; equal payloads of ``min_revisit`` bytes or more are stored once, by the row with the
largest page_id, and others revisit it (rows that share that page_id are all responses); smaller ones are all stored; an
empty table gives an archive without bundles; null or odd urls are percent-encoded into the header; further columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, text_of

#: Payload bytes of a frame and of a bundle before the next one begins.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 16 << 20
#: The seekable format: magic numbers of the skippable frame and of the seek table's end.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"


def with_revisits(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """(page_id, url, payload, payload_digest, payload_bytes, refers_to); refers_to is null but for revisits."""
    rows = pages.select("page_id", "url", F.encode(text_of("html"), "UTF-8").alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    large = rows.where(F.col("payload_bytes") >= min_revisit)
    stored = large.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisit = F.when(F.col("kept") != F.col("page_id"), F.col("kept"))
    paired = large.join(stored, ["payload_digest", "payload_bytes"], "left").withColumn("refers_to", revisit).drop("kept")
    small = rows.where(F.col("payload_bytes") < min_revisit).withColumn("refers_to", F.lit(None).cast("long"))
    return paired.unionByName(small)


def record_id(page_id) -> str:
    return f"<urn:page:{page_id}>"


def warc_record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record: an HTTP response with the payload, or a revisit that has the response's header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{sha1}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(frame: bytes):
    """(offset, header fields, HTTP header fields, payload) of each record of a frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in frame[at:end].decode().split("\r\n")[1:])
        block = frame[end + 4 : end + 4 + int(head["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
        yield at, head, fields, payload
        at = end + 4 + len(block) + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame at a bundle's end, from (compressed, plain) sizes, without its last four bytes."""
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IB", len(sizes), 0)
    return struct.pack("<II", SKIPPABLE, len(body) + 4) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed, plain size) of each frame, from the end of the bundle."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE or flags:
        raise ValueError("not a seekable bundle")
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", bundle[-9 - 8 * n : -9]):
        out.append((at, packed, plain))
        at += packed
    return out


def write_bundles(rows: DataFrame, path: str, level: int = 6) -> None:
    """Write the records of ``with_revisits`` as bundles under ``path``."""

    def bundles(batches):
        packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        frame, frame_bytes, frames, sizes, plain = [], 0, [], [], 0

        def close_frame():
            nonlocal frame, frame_bytes, plain
            if frame:
                data = b"".join(frame)
                frames.append(packer.compress(data))
                sizes.append((len(frames[-1]), len(data)))
                plain += len(data)
                frame, frame_bytes = [], 0

        def close_bundle():
            nonlocal frames, sizes, plain
            close_frame()
            data = b"".join([*frames, seek_table(sizes)])
            frames, sizes, plain = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["bundle"])

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() if i != 2 else c for i, c in enumerate(batch.columns))):
                frame.append(warc_record(page_id, url, payload.as_py(), digest, refers_to))
                frame_bytes += len(frame[-1])
                if frame_bytes >= FRAME_BYTES:
                    close_frame()
                if plain >= BUNDLE_BYTES:
                    yield close_bundle()
        if frame or frames:
            yield close_bundle()

    magic = struct.pack("<I", SEEKABLE).decode("latin-1")
    rows.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInArrow(bundles, "bundle binary").select(F.col("bundle").cast("string").alias("value")).write.options(lineSep=magic, encoding="ISO-8859-1", maxRecordsPerFile="1", compression="none").text(path)


RECORD = "page_id bigint, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, bundle string, frame int, frame_offset bigint, offset_in_frame bigint, payload binary"


def read_bundles(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """All records of the bundles under ``path`` with their places; payloads only if asked for.

    Digest and length are those of the payload that was read; a revisit has those of the response that it refers to, or null.
    """

    def number(urn: str | None):
        return None if urn is None or urn.endswith(":None>") else int(urn[len("<urn:page:") : -1])

    def records(batches):
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            for name, bundle in zip(batch.column(0).to_pylist(), batch.column(1)):
                bundle = bundle.as_py()
                for k, (at, packed, _) in enumerate(read_seek_table(bundle)):
                    out = []
                    for offset, head, http, payload in parse_records(opener.decompress(bundle[at : at + packed])):
                        claimed = base64.b32decode(head["WARC-Payload-Digest"][5:]).hex()
                        stored = head["WARC-Type"] == "response"
                        digest, size = (hashlib.sha1(payload).hexdigest(), len(payload)) if stored else (None, None)
                        out.append((number(head["WARC-Record-ID"]), head["WARC-Type"], digest, size, number(head.get("WARC-Refers-To")), name, k, at, offset, payload if payloads else None, claimed))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string()))], names=[*(x.split()[0] for x in RECORD.split(", ")), "claimed"])

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(path)
    every = files.where("length > 0").select("path", "content").mapInArrow(records, f"{RECORD}, claimed string")
    # rows that share a page_id may be responses of different payloads: the digest in the header tells them apart
    kept = every.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "claimed").agg(F.min(F.struct(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("n"))).alias("kept"))
    revisits = every.where("record_type <> 'response'").join(kept, ["refers_to", "claimed"], "left").withColumns({"payload_digest": F.col("kept.d"), "payload_bytes": F.col("kept.n")})
    names = [x.split()[0] for x in RECORD.split(", ")]
    return every.where("record_type = 'response'").select(*names).unionByName(revisits.select(*names))


def record_index(spark: SparkSession, path: str) -> DataFrame:
    """Record identifier to frame-relative place, from the archives themselves."""
    return read_bundles(spark, path).select("page_id", "bundle", "frame", "frame_offset", "offset_in_frame")


def archive(pages: DataFrame, path: str | None = None, min_revisit: int = 1000) -> str:
    path = path or scratch_path(pages.sparkSession, "warc")
    write_bundles(with_revisits(pages, min_revisit), path)
    return path
