"""WARC archives with a Zstandard dictionary of their own, written and read through Spark's file systems.

An archive is a skippable frame that holds the dictionary, then one Zstandard frame a record. Spark's text writer puts
the frames into files, so any store that Spark writes to will do and lost tasks leave nothing behind; what it puts
between two rows is an empty skippable frame, which every Zstandard reader passes over.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The skippable frame that announces a dictionary, an empty skippable frame, and a frame's magic number.
DICTIONARY_FRAME = b"\x5d\x2a\x4d\x18"
BETWEEN = "P*M\x18\x00\x00\x00\x00"
ZSTD_FRAME = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payload bytes of an archive, after which a task starts the next; a larger record has an archive of its own.
ARCHIVE_BYTES = 16 << 20
#: Bytes of an archive's first records that its dictionary is fitted on, and the dictionary's size at most.
SAMPLE_BYTES, DICTIONARY_BYTES = 2 << 20, 64 << 10


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def name_of(page: int | None) -> str:
    return f"<urn:x-page:{'null' if page is None else page}>"


def page_of(name: str | None) -> int | None:
    number = (name or "null").strip("<>").rpartition(":")[2]
    return None if number == "null" else int(number)


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A WARC record: a response with its payload, or a revisit with the response's headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name_of(page)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(0x21, 0x7F))).replace('%', ''))}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name_of(refers_to)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Fitted on an archive's first records; where they are too few for that, their last bytes as they are."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        raw = b"".join(samples)[-DICTIONARY_BYTES:]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def frames(records: list[bytes], more: Iterator[bytes]) -> Iterator[bytes]:
    """An archive's frames: the dictionary's, then one a record."""
    known = dictionary(records)
    packed = zstandard.ZstdCompressor(level=9).compress(known.as_bytes())
    yield DICTIONARY_FRAME + struct.pack("<I", len(packed)) + packed
    pack = zstandard.ZstdCompressor(level=6, dict_data=known)
    for r in records:
        yield pack.compress(r)
    for r in more:
        yield pack.compress(r)


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-cased name, block) of every record of an archive."""
    known, at = None, 0
    if archive[:4] == DICTIONARY_FRAME:
        size = struct.unpack("<I", archive[4:8])[0]
        known, at = archive[8 : 8 + size], 8 + size
        if known[:4] == ZSTD_FRAME:
            known = zstandard.ZstdDecompressor().decompress(known)
        known = zstandard.ZstdCompressionDict(known)
    unpack = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    stream = io.BufferedReader(unpack.stream_reader(io.BytesIO(memoryview(archive)[at:]), read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().partition(":")
            headers[k.lower()] = v.strip()
        yield headers, stream.read(int(headers["content-length"]))
        stream.read(4)


def _archives(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()

        def incoming() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                for page, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield len(html), record(page, url, html, refers_to, revisit, date)

        source, number = incoming(), 0
        ahead = next(source, None)
        while ahead is not None:
            taken, first = 0, []
            while ahead is not None and taken < SAMPLE_BYTES and (not first or taken + ahead[0] <= ARCHIVE_BYTES):
                taken += ahead[0]
                first.append(ahead[1])
                ahead = next(source, None)

            def rest() -> Iterator[bytes]:
                nonlocal ahead, taken
                while ahead is not None and taken + ahead[0] <= ARCHIVE_BYTES:
                    taken += ahead[0]
                    yield ahead[1]
                    ahead = next(source, None)

            held: list[bytes] = []
            for seq, frame in enumerate(frames(first, rest())):
                held.append(frame)
                if len(held) == 256:
                    yield _rows(task, number, seq, held)
                    held = []
            if held:
                yield _rows(task, number, seq, held)
            number += 1

    return run


def _rows(task: int, number: int, last: int, held: list[bytes]) -> pa.RecordBatch:
    n = len(held)
    return pa.RecordBatch.from_arrays(
        [pa.array([f"{task:06d}-{number:05d}"] * n), pa.array(range(last - n + 1, last + 1), pa.int64()), pa.array(held, pa.binary())],
        ["archive", "seq", "frame"],
    )


def resolve(pages: DataFrame, id_col: str, url_col: str, payload: Column, smallest: int = 0) -> DataFrame:
    """(page, url, payload, refers_to, revisit): of equal payloads of ``smallest`` bytes or more the largest id is kept.

    Equal payloads are found by length and SHA-256, in counts that are summed before they are shuffled; only digests
    that occur again are joined, so a payload that many pages share moves with the pages, whose large partitions Spark
    splits. Rows of the largest id are all responses, be it repeated; null ids revisit it, and where there is none are
    responses.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(payload.cast("binary"), F.lit(b"")).alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    again = (
        rows.where(F.length("payload") >= smallest)
        .groupBy("digest")
        .agg(F.max("page").alias("top"), F.count("*").alias("n"))
        .where("n > 1 and top is not null")
        .drop("n")
    )
    revisit = F.col("top").isNotNull() & ~F.col("page").eqNullSafe(F.col("top"))
    return rows.join(again, "digest", "left").select(
        "page", "url", "payload", F.when(revisit, F.col("top")).alias("refers_to"), revisit.alias("revisit")
    )


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    date: str = "1970-01-01T00:00:00Z",
    smallest: int = 0,
) -> None:
    """Writes a record for every row to archives below ``path``, each in a folder ``archive=...`` of its own.

    Null payloads are empty. Archives are bounded by ARCHIVE_BYTES, and each holds the dictionary it needs. An empty
    table writes none.
    """
    resolved = resolve(pages, id_col, url_col, F.col(html_col), smallest).select("page", "url", "payload", "refers_to", "revisit")
    out = resolved.mapInArrow(_archives(date), "archive string, seq long, frame binary")
    rows = out.sortWithinPartitions("archive", "seq").select(F.col("frame").cast("string").alias("value"), "archive")
    rows.write.partitionBy("archive").option("lineSep", BETWEEN).text(path)


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    names = ["page", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def batch_of(out: list[list]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        for archive in batch.column(0).to_pylist():
            out, held = [], 0
            for headers, block in records(archive):
                head, _, payload = block.partition(b"\r\n\r\n")
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                size = next(int(line[15:]) for line in head.split(b"\r\n") if line.startswith(b"Content-Length:"))
                revisit = headers["warc-type"] == "revisit"
                if not revisit and (len(payload) != size or sha1_base32(payload) != digest):
                    raise ValueError(f"record {headers['warc-record-id']} is damaged")
                url = headers.get("warc-target-uri")
                out.append((
                    page_of(headers["warc-record-id"]), None if url is None else unquote(url), size, digest, headers["warc-type"],
                    page_of(headers.get("warc-refers-to")), payload if with_payload and not revisit else None,
                ))
                held += len(payload) if with_payload else 100
                if held > 8 << 20:
                    yield batch_of(out)
                    out, held = [], 0
            yield batch_of(out)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """(page, url, payload_bytes, payload_digest, record_type, refers_to, payload) of all records below ``path``.

    Payload digests and lengths of responses are checked against what was read; revisits have those of their headers.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*")
    schema = (
        "page long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    )
    return files.load(path).select("content").mapInArrow(lambda batches: _read(batches, with_payload), schema)
