"""WARC archives compressed record by record with one Zstandard dictionary.

The dictionary is trained on a bounded sample of the records (about ``samples`` pages, by hash, of at most
``sample_bytes`` each); every file begins with it, in a skippable frame (magic 0x184D2A5D), and has each record in a frame of its own,
so that a record can be read with the dictionary and its offset alone.

Of pages with equal payloads, that with the largest page_id is a response record and the others are revisit records
that refer to it. Groups and revisits come from page_id and digest alone, which is what is shuffled for them; the
revisits are then joined to the pages by page_id and digest, so that no payload that many pages share is a hot key. Spark
sends the revisits to all tasks while they are few, and shuffles the pages once where they are not. Files are written
by tasks under names that are never used again, and only the files in the rows that a task has returned count: a task
that runs twice leaves a file that nobody reads.

A null html is an empty payload; null urls have no WARC-Target-URI. Rows that share payload and the largest page_id
are all responses; a null page_id is below all others. An empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.shared import new_path, open_fs, stored, table

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "file string, records long, bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record; ``refers_to`` is the page that has the payload, None for a response."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Target-URI": None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~"),
        "WARC-Date": date,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": REVISIT_PROFILE if revisit else None,
        "WARC-Refers-To": record_id(refers_to, digest) if revisit else None,
        "X-Page-ID": page_id,
        "X-Refers-To-Page-ID": refers_to,
        "X-Payload-Length": len(payload),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def info(date: str) -> bytes:
    block = b"software: ravelin\r\nformat: WARC File Format 1.1\r\n"
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, date)}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def trained(records: list[bytes], size: int) -> bytes:
    """A Zstandard dictionary of about ``size`` bytes; the last records themselves where there are too few to train on."""
    if len(records) >= 8:
        try:
            return zstandard.train_dictionary(size, records).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(records)[-size:] or info("")


class Files:
    """Writes records to files of about ``roll`` bytes each."""

    def __init__(self, folder: str, dictionary: bytes, level: int, roll: int, date: str):
        self.folder, self.dictionary, self.roll, self.date = folder, dictionary, roll, date
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary))
        self.out, self.done = None, []

    def add(self, rec: bytes) -> None:
        if self.out is None:
            fs, path = open_fs(self.folder)
            fs.create_dir(path, recursive=True)
            self.name, self.records, self.size = f"{self.folder}/{uuid.uuid4().hex}.warc.zst", 0, 0
            self.out = fs.open_output_stream(open_fs(self.name)[1])
            self._put(struct.pack("<II", SKIPPABLE, len(self.dictionary)) + self.dictionary)
            self._put(self.compressor.compress(info(self.date)))
        self._put(self.compressor.compress(rec))
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.records, self.size))
            self.out = None


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record of an archive, one at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive does not begin with a dictionary")
    dictionary = zstandard.ZstdCompressionDict(stream.read(size))
    plain = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(stream, read_across_frames=True), 1 << 16)
    while line := plain.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:40]!r}")
        head = {}
        while (line := plain.readline().strip()) != b"":
            name, _, value = line.decode().partition(": ")
            head[name] = value
        block = plain.read(int(head["Content-Length"]))
        plain.read(4)
        yield head, block


def with_referral(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, and response_id: the largest page_id with the same payload where this page is a revisit of it, else null."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    slim = rows.select("page_id", "digest")
    groups = stored(slim.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("response_id")).where("n > 1").drop("n"), "payloads")
    revisits = slim.join(groups, "digest").where(~F.col("page_id").eqNullSafe(F.col("response_id"))).distinct()
    r = stored(revisits.withColumnsRenamed({"page_id": "own_id", "digest": "own_digest"}), "revisits")
    same = F.col("page_id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest"))
    return rows.join(r, same, "left").select("page_id", "url", "payload", "response_id")


def write_archives(pages: DataFrame, *, samples: int = 500, sample_bytes: int = 1 << 16, dictionary_bytes: int = 1 << 16, level: int = 3, roll: int = 1 << 27, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes ``pages`` (page_id, url, html) and returns the files: file, records, bytes."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    share = samples * (1 << 20) // max(pages.count(), 1) + 1  # of 2**20 hash values
    few = pages.where(F.octet_length("html") <= sample_bytes).where(F.pmod(F.xxhash64("html", "page_id"), F.lit(1 << 20)) < share)
    few = few.select("page_id", "url", "html").limit(2 * samples).collect()
    payloads = [(r["html"] or "").encode() for r in few]
    dictionary = trained([record(r["page_id"], r["url"], p, base32_sha1(p), None, date) for r, p in zip(few, payloads, strict=True)], dictionary_bytes)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(folder, dictionary, level, roll, date)
        for b in batches:
            for page, url, payload, response in zip(*(b.column(n) for n in ("page_id", "url", "payload", "response_id")), strict=True):
                page, payload, response = page.as_py(), payload.as_py(), response.as_py()
                files.add(record(page, url.as_py(), payload, base32_sha1(payload), response, date))
        files.close()
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*files.done, strict=True) if files.done else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["file", "records", "bytes"])

    return stored(with_referral(pages).mapInArrow(of, MANIFEST), "manifest")


def read_archives(files: DataFrame, *, payloads: bool = True, batch: int = 500) -> DataFrame:
    """The records of the archives in ``files`` (file). A payload that does not have its digest fails the read."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for b in batches:
            for name in b.column("file").to_pylist():
                fs, path = open_fs(name)
                rows: list[tuple] = []
                with fs.open_input_stream(path) as stream:
                    for head, block in read_records(stream):
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        digest, payload = head["WARC-Payload-Digest"].removeprefix("sha1:"), None
                        if head["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if base32_sha1(payload) != digest or len(payload) != int(head["X-Payload-Length"]):
                                raise ValueError(f"{name}: the payload of {head['WARC-Record-ID']} is damaged")
                        number = lambda k, h=head: int(h[k]) if k in h else None
                        rows.append((number("X-Page-ID"), head.get("WARC-Target-URI"), number("X-Payload-Length"), digest, head["WARC-Type"], number("X-Refers-To-Page-ID"), payload if payloads else None))
                        if len(rows) >= batch:
                            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    spread = files.select("file").repartition(max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), "file")
    return spread.mapInArrow(of, RECORDS)


def op3_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every page, written and read back."""
    files = write_archives(table(spark, sf_dir, "pages"))
    return read_archives(files, payloads=False).drop("payload", "url")


OP3_SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS last FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM m
"""
