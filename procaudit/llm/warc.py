"""WARC archives compressed record by record against a Zstandard dictionary.

Each task writes one archive: a leading skippable frame holds a dictionary built from the archive's first records,
and every record is a frame of its own, so a reader can start at any frame. There are as many archives as the payloads
need at ``ARCHIVE_BYTES`` each. They go through Spark's text sink as raw bytes; the separator that sink puts after each
row is an empty skippable frame, which decoders pass over.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: a skippable frame's magic numbers, for a dictionary and for the separator.
DICTIONARY_MAGIC = 0x184D2A5D
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
MIN_REVISIT_BYTES = 1000
DICTIONARY_BYTES = 32 * 1024
#: The dictionary is built from an archive's first records: so many bytes of them, at most so many of one.
SAMPLE_BYTES, SAMPLE_RECORD_BYTES = 2 * 1024 * 1024, 16 * 1024
#: Payload bytes of an archive, on average; a reader takes an archive whole.
ARCHIVE_BYTES = 128 << 20
#: The records of one payload go to so many parts.
SALTS = 16
LEVEL = 3


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): of equal payloads of ``min_bytes`` or more, all but the one with
    the largest id refer to it. Payloads move once, to as many partitions as they need; the rows of one digest are
    dealt to ``SALTS`` of them, and smaller payloads, whatever their digest, by their own id."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    groups = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    size = rows.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    parts = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // ARCHIVE_BYTES))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))
    rows = rows.withColumn("part", F.when(F.octet_length("payload") >= min_bytes, F.concat_ws("-", "digest", salt)).otherwise(F.concat_ws("-", "page_id", F.xxhash64("url"))))
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select(F.concat_ws("-", "digest", "salt").alias("part"), "keeper")
    found = rows.repartition(parts, "part").join(groups, "part", "left")
    return found.select("page_id", "url", "payload", "digest", F.when(F.coalesce(F.col("page_id") != F.col("keeper"), F.col("keeper").isNotNull()), F.col("keeper")).alias("refers_to"))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if refers_to is not None else http + payload
    target = "".join((url or "").split("\r")).replace("\n", "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    head += [f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained from the records, or, where they are too few to train on, their own bytes."""
    samples = [r[:SAMPLE_RECORD_BYTES] for r in records]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[bytes] = []
    size, compressor = 0, None

    def out(frames: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    def opened() -> list[bytes]:
        nonlocal compressor
        built = build_dictionary(held)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=built, write_checksum=True, write_content_size=True)
        body = built.as_bytes()
        return [struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body, *map(compressor.compress, held)]

    for batch in batches:
        frames = []
        for row in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
            record = record_bytes(*row)
            if compressor:
                frames.append(compressor.compress(record))
                continue
            held.append(record)
            size += len(record)
            if size >= SAMPLE_BYTES:
                frames += opened()
        if frames:
            yield out(frames)
    if held and not compressor:
        yield out(opened())


def write_archives(records: DataFrame, path: str) -> None:
    """One dictionary-compressed archive a partition, under ``path``."""
    frames = records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(_archive, "frame binary")
    frames.select(F.col("frame").cast("string")).write.option("lineSep", SEPARATOR).option("compression", "none").text(path)


def iterate_records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record of an archive; the payload of a revisit is empty."""
    at, decoder = 0, None
    view = memoryview(archive)
    while at < len(view):
        magic = struct.unpack_from("<I", view, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            n = struct.unpack_from("<I", view, at + 4)[0]
            if magic == DICTIONARY_MAGIC and decoder is None:
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[at + 8 : at + 8 + n])))
            at += 8 + n
            continue
        one = decoder.decompressobj()
        record = one.decompress(view[at:])
        at = len(view) - len(one.unused_data)
        head, _, block = record.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield headers, block[: int(headers["Content-Length"])].partition(b"\r\n\r\n")[2]


READ_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _reader(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for archive in batch.column(0):
                rows: list[tuple] = []
                size = 0
                for headers, payload in iterate_records(archive.as_buffer()):
                    number = lambda name, h=headers: int(h[name][10:-1]) if len(h.get(name, "")) > 11 else None  # noqa: E731  <urn:page:N>
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"record {headers['WARC-Record-ID']} does not match its digest")
                    rows.append((number("WARC-Record-ID"), headers["WARC-Target-URI"], kind, number("WARC-Refers-To"), int(headers["X-Payload-Length"]), digest, payload if with_payload and kind == "response" else None))
                    size += len(payload)
                    if len(rows) >= 4096 or with_payload and size >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return read


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per record of the archives under ``path``; payload digests of responses are checked."""
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    return content.mapInArrow(_reader(with_payload), READ_SCHEMA)


def archive_pages(pages: DataFrame, path: str, **columns) -> DataFrame:
    """Writes a WARC record per row of ``pages`` under ``path`` and returns what the archives hold.

    Defined cases: a null html is an empty payload, and a very long one a record like any other; payloads below ``MIN_REVISIT_BYTES`` are always responses;
    repeated rows are a record each, and rows that share the largest id of their payload are all responses; a null
    id ranks below every other and reads back as null; a null url reads back as the empty text; other columns are
    ignored; an empty table makes an archive folder without archives and gives no rows.
    """
    write_archives(with_revisits(pages, **columns), path)
    return read_archives(pages.sparkSession, path)
