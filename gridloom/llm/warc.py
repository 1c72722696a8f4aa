"""Dictionary-compressed WARC archives (.warc.zst), written and read by Spark.

An archive begins with a skippable frame that holds a Zstandard dictionary built
from the archive's own records; each record follows as a frame of its own,
compressed with that dictionary. Workers make frames and Spark's text writer
puts them into files, so archives reach any file system that Spark writes to,
under its commit protocol: a lost task leaves no half archive. What that writer
puts between lines is an empty skippable frame, which Zstandard readers pass over.

Payloads of at least ``SMALL`` bytes that occur again are stored once: the record
with the smallest id is the response, the others are revisit records of it.

Cases: a null payload is an empty one; rows with the same id and payload are all
responses if theirs is the smallest id; a null id is written as an empty one and
read as null; line breaks and blanks in a URL are percent-encoded; a null URL is
left out; archives too small for a dictionary have an empty dictionary frame. Ids are
whole numbers; those of another kind are written, but ``read`` stops at them. Very long
payloads are written and read whole, in an archive of their own if need be; columns
but id, URL and payload aren't written, whatever their names; an empty table gives
archives without records.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ready

SMALL = 100
#: The dictionary frame's magic number, and an empty skippable frame.
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:record:"


def record(identity: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit holds the response's headers alone."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{RECORD_ID}{'' if identity is None else identity}>", f"WARC-Date: {date}"]
    if url is not None:
        fields.append("WARC-Target-URI: " + re.sub(r"[\s\x00-\x1f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    fields.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        fields += [f"WARC-Refers-To: <{RECORD_ID}{refers_to}>", f"WARC-Profile: {IDENTICAL}"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of a record; field names in lower case."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    named = lambda lines: {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    fields = named(head.decode().split("\r\n")[1:])
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, named(http.decode().split("\r\n")[1:]), payload


def dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict | None:
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return None


def archives(records: Iterator[bytes], per_archive: int, sample_bytes: int, dictionary_bytes: int, level: int, archive_bytes: int = 1 << 28) -> Iterator[bytes]:
    """Frames of archives one after the other, each of a dictionary frame and ``per_archive`` - 1 others, the last perhaps of fewer.

    An archive whose records reach ``archive_bytes`` before compression gets no more of them;
    empty frames then fill up its number, as the number tells the writer where a file ends.
    Records are held back only until ``sample_bytes`` of them are there to build a dictionary from.
    """
    while True:
        held, size, count = [], 0, 0
        for raw in records:
            held.append(raw)
            size += len(raw)
            if size >= sample_bytes or len(held) == per_archive - 1:
                break
        if not held:
            return
        known = dictionary(held, dictionary_bytes)
        content = known.as_bytes() if known else b""
        yield struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content
        packer = zstandard.ZstdCompressor(level=level, dict_data=known) if known else zstandard.ZstdCompressor(level=level)
        for raw in held:
            yield packer.compress(raw)
        count = len(held)
        held = []
        while count < per_archive - 1 and size < archive_bytes and (raw := next(records, None)) is not None:
            yield packer.compress(raw)
            count += 1
            size += len(raw)
        if size >= archive_bytes:
            yield from repeat(b"", per_archive - 1 - count)


def frames(data: memoryview) -> Iterator[tuple[bool, memoryview]]:
    """(skippable, frame or its content) of each Zstandard frame: block headers tell where a frame ends."""
    at = 0
    while at < len(data):
        (magic,) = struct.unpack_from("<I", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            (size,) = struct.unpack_from("<I", data, at + 4)
            yield True, data[at + 8 : at + 8 + size]
            at += 8 + size
            continue
        end = at + zstandard.frame_header_size(data[at : at + 18])
        checksum = data[at + 4] & 4
        while True:
            head = int.from_bytes(data[end : end + 3], "little")
            end += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
            if head & 1:
                break
        end += 4 if checksum else 0
        yield False, data[at:end]
        at = end


def records_of(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, decompressed with the dictionary of its first frame."""
    unpacker = zstandard.ZstdDecompressor()
    for k, (skippable, frame) in enumerate(frames(memoryview(archive))):
        if skippable:
            if k == 0 and len(frame):
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(frame)))
            continue
        yield unpacker.decompress(frame)


def with_revisits(pages: DataFrame, identity: str, payload: str) -> DataFrame:
    """pages with ``_payload`` (bytes), ``_digest`` and ``refers_to``. Payloads are dealt by id, not by what they equal."""
    own = pages.withColumn("_payload", F.coalesce(F.col(payload).cast("binary"), F.lit(b""))).withColumn("_digest", F.sha2("_payload", 256))
    large = own.filter(F.octet_length("_payload") >= SMALL).select(identity, "_digest")
    again = large.groupBy("_digest").agg(F.min(identity).alias("refers_to"), F.max(identity).alias("_last")).filter("refers_to <> _last").drop("_last")
    revisits = large.join(again, "_digest").filter(F.col(identity) != F.col("refers_to")).distinct()
    return own.join(revisits, [identity, "_digest"], "left")


def write(pages: DataFrame, path: str, *, identity: str = "page_id", url: str = "url", payload: str = "html", per_archive: int = 8192,
          sample_bytes: int = 4 << 20, dictionary_bytes: int = 64 << 10, level: int = 3, archive_bytes: int = 1 << 28, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for each row of pages into archives below path."""
    ready(pages.sparkSession)
    rows = with_revisits(pages.select(identity, url, payload), identity, payload).select(identity, url, "_payload", "_digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = (record(*(v.as_py() for v in row), date) for batch in batches for row in zip(*batch.columns, strict=True))
        held: list[bytes] = []
        size = 0
        for frame in archives(raw, per_archive, sample_bytes, dictionary_bytes, level, archive_bytes):
            held.append(frame)
            size += len(frame)
            if size >= 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["frame"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["frame"])

    made = rows.mapInArrow(run, T.StructType([T.StructField("frame", T.BinaryType())]))
    made.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", per_archive).option("compression", "none").text(path)


def read(spark, path: str) -> DataFrame:
    """One row a record of the archives below path: ``record_id``, ``url``, ``record_type``, ``refers_to``, ``declared_digest``, ``payload_bytes`` and ``payload``.

    A revisit's payload is null, and its size and digest are those that it declares. An archive is read into memory whole: it has ``archive_bytes`` and one record at most.
    """
    ready(spark)
    schema = T.StructType([
        T.StructField("record_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
        T.StructField("declared_digest", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload", T.BinaryType()),
    ])

    def number(field: str | None) -> int | None:
        text = (field or "").removeprefix(f"<{RECORD_ID}").removesuffix(">")
        return int(text) if text else None

    def rows_of(archive: bytes) -> Iterator[dict]:
        for raw in records_of(archive):
            fields, http, payload = parse(raw)
            revisit, declared = fields["warc-type"] == "revisit", fields["warc-payload-digest"].removeprefix("sha256:")
            yield {
                "record_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "refers_to": number(fields.get("warc-refers-to")),
                "declared_digest": declared, "payload_digest": declared if revisit else hashlib.sha256(payload).hexdigest(),
                "payload_bytes": int(http["content-length"]) if revisit else len(payload), "payload": None if revisit else payload,
            }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([(f.name, {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in schema])
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for row in rows_of(content.as_py()):
                    held.append(row)
                    size += len(row["payload"] or b"")
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, arrow)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)
