"""WARC archives, Zstandard-compressed with a dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary trained on the archive's first
records (at most SAMPLE_BYTES of them); then comes one frame per record. The reader loads the dictionary, decodes frame
by frame, and checks version line, header syntax, lengths, closing blank lines and digests; it raises on any fault. It also
reads archives from elsewhere (``found_archives``): without a dictionary, with other types of records, which it passes over
unless they are asked for, and with responses that lack a digest.

Records whose payloads are equal are one response (largest page_id) and revisits, whose block keeps the HTTP header,
with the length of the full payload. Archives go to the shared folder under names of their own; a rerun task writes
others, and readers open only those that the manifest names.

Defined results: null html is an empty payload; among null page_ids and others the largest id is the response, and
with only null ids all are responses; rows that repeat the response's id are responses too; null urls have no header.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import fresh_folder, materialize, qualified, workers_import

MAGIC, FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
ARCHIVE_BYTES = 64 << 20
DICTIONARY_BYTES = 16 << 10
SAMPLE_BYTES = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:pointloom:page:"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url: str | None, payload: bytes, kind: str, refers_to) -> bytes:
    name = lambda x: f"<{URN}{'none' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    head.append(f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes], what: str) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#$%&'*+\-.^_`|~0-9A-Za-z]+", name):
            raise ValueError(f"bad {what} header line {line[:80]!r}")
        out[name.decode().lower()] = value.strip().decode()
    return out


def _matches(digest: str, data: bytes) -> bool:
    """Whether data have a labelled digest, in base32 or hex; a digest of an unknown algorithm says nothing."""
    name, _, value = digest.partition(":")
    if name.lower().replace("-", "") not in hashlib.algorithms_available:
        return True
    raw = hashlib.new(name.lower().replace("-", ""), data)
    return value.lower() == raw.hexdigest() or value.upper().rstrip("=") == base64.b32encode(raw.digest()).decode().rstrip("=")


def parse_record(data: bytes) -> dict:
    """A checked record: record_id, page_id, url, payload (of responses), payload_bytes, payload_digest, record_type, refers_to.

    Other types of records (warcinfo, request, metadata, ...) have their block's length for payload_bytes. Digests are checked
    where there are some, and lengths of HTTP bodies where there is one and the body is neither encoded nor cut off.
    """
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not gap or first not in (b"WARC/1.1", b"WARC/1.0"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    h = _headers(lines, "WARC")
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in h:
            raise ValueError(f"record without {need}")
    name, kind, n = h["warc-record-id"], h["warc-type"], int(h["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"{name}: block of {len(rest) - 4} bytes, {n} announced")
    block = rest[:n]
    if not _matches(h.get("warc-block-digest", ""), block):
        raise ValueError(f"{name}: block differs from its digest")
    payload, size, digest = None, n, h.get("warc-payload-digest", "")
    if kind in ("response", "revisit"):
        payload, size = block, n
        if h.get("content-type", "application/http").startswith("application/http"):
            http, gap, payload = block.partition(b"\r\n\r\n")
            status, *lines = http.split(b"\r\n")
            if not gap or not status.startswith(b"HTTP/"):
                raise ValueError(f"{name}: no HTTP header")
            told = _headers(lines, "HTTP")
            size = int(told["content-length"]) if kind == "revisit" and "content-length" in told else len(payload)
            exact = "content-length" in told and "transfer-encoding" not in told and "warc-truncated" not in h
            if kind == "response" and exact and len(payload) != int(told["content-length"]):
                raise ValueError(f"{name}: payload differs from its length")
        if kind == "response" and "warc-truncated" not in h and not _matches(digest, payload):
            raise ValueError(f"{name}: payload differs from its digest")
        if kind == "revisit" and payload:
            raise ValueError(f"{name}: a revisit with a payload")
    digest = sha1_base32(payload) if kind == "response" else digest.removeprefix("sha1:") or None

    def ident(value: str | None) -> str | None:
        found = re.fullmatch(rf"<{URN}(.*)>", value or "")
        return found[1] if found and found[1] != "none" else None

    return {
        "record_id": name, "page_id": ident(name), "url": h.get("warc-target-uri"), "payload": payload if kind == "response" else None,
        "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": ident(h.get("warc-refers-to")),
    }


def train(samples: list[bytes]) -> bytes:
    """A dictionary for the samples; b'' when they are too few or too small for one."""
    if len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    def __init__(self, sink, samples: list[bytes]):
        words = train(samples)
        sink.write(struct.pack("<II", MAGIC, len(words)) + words)
        self.sink, self.size, self.records = sink, 8 + len(words), 0
        self.compress = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None).compress

    def add(self, record: bytes) -> None:
        frame = self.compress(record)
        self.sink.write(frame)
        self.size += len(frame)
        self.records += 1


def read_archive(source) -> Iterator[bytes]:
    """Records of an archive, one by one. source: a binary file object."""
    start = source.read(8)
    if len(start) < 8:
        raise ValueError("archive without a first frame")
    magic, size = struct.unpack("<II", start)
    words = b""
    if magic == MAGIC:
        start, words = b"", source.read(size)
        if len(words) != size:
            raise ValueError("the dictionary frame is cut short")
    elif start[:4] != FRAME:
        raise ValueError("the first frame is neither a dictionary nor a record")
    if words[:4] == FRAME:
        words = zstandard.ZstdDecompressor().decompress(words)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    rest = start
    while True:
        frame, parts = reader.decompressobj(), []
        if not rest and not (rest := source.read(1 << 18)):
            return
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            if not (rest := source.read(1 << 18)):
                raise ValueError("the last frame is cut short")
        yield b"".join(parts)


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write pages as archives below folder; returns the manifest (path, records, bytes)."""
    target = qualified(pages.sparkSession, folder)
    workers_import(pages.sparkSession)
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    rows = rows.withColumn("content", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    copies = rows.groupBy("content").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    copies = materialize(copies.select("content", "refers_to"), "payloads")
    rows = rows.join(copies, "content", "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(target)
        store.create_dir(base, recursive=True)
        writer = sink = temporary = None
        held: list[bytes] = []
        held_bytes = 0

        def opened() -> ArchiveWriter:
            nonlocal sink, temporary, held, held_bytes
            temporary = f"{base}/.{uuid.uuid4().hex}.tmp"
            sink = store.open_output_stream(temporary, compression=None)
            out = ArchiveWriter(sink, held)
            for record in held:
                out.add(record)
            held, held_bytes = [], 0
            return out

        def closed(out: ArchiveWriter) -> pa.RecordBatch:
            sink.close()
            path = f"{base}/{uuid.uuid4().hex}.warc.zst"
            store.move(temporary, path)
            place = f"{target.rstrip('/')}/{path.rsplit('/', 1)[1]}"
            return pa.RecordBatch.from_arrays([pa.array([place]), pa.array([out.records], pa.int64()), pa.array([out.size], pa.int64())], ["path", "records", "bytes"])

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to")]
            for i in range(batch.num_rows):
                ident, address, body, refers = (c[i].as_py() for c in columns)
                kind = "revisit" if refers is not None and refers != ident else "response"
                record = record_bytes(ident, address, body.encode(), kind, refers)
                if writer:
                    writer.add(record)
                    if writer.size > ARCHIVE_BYTES:
                        yield closed(writer)
                        writer = None
                    continue
                held.append(record)
                held_bytes += len(record)
                if held_bytes > SAMPLE_BYTES:
                    writer = opened()
        if held:
            writer = opened()
        if writer:
            yield closed(writer)

    return materialize(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, payload: bool = False, kinds: tuple[str, ...] = ("response", "revisit")) -> DataFrame:
    """Records, of the kinds asked for, of the archives that the manifest names; payload: with the bytes of responses.

    An archive that the manifest has a number of records for must have as many.
    """
    names = ["record_id", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payload]
    schema = "record_id string, page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * payload
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=False)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for path, records in zip(got.column("path").to_pylist(), got.column("records").to_pylist(), strict=True):
                seen, rows = 0, []
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_stream(place, compression=None) as source:
                    for data in read_archive(source):
                        row = parse_record(data)
                        seen += 1
                        if row["record_type"] in kinds:
                            rows.append(row)
                        if len(rows) == 256:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)
                if records is not None and seen != records:
                    raise ValueError(f"{path}: {seen} records, {records} were written")

    # a number of its own: adaptive execution would join the few small rows of a manifest into one task
    return manifest.select("path", "records").repartition(max(1, min(manifest.count(), 10_000))).mapInArrow(run, schema)


def found_archives(spark: SparkSession, path: str) -> DataFrame:
    """A manifest of archives from elsewhere: their paths, without numbers of records."""
    workers_import(spark)
    names = [(qualified(spark, r["path"]), None) for r in spark.read.format("binaryFile").load(path).select("path").collect()]  # names of files
    return spark.createDataFrame(names, "path string, records long")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages as archives in the shared folder and read them back: one row per page."""
    folder = fresh_folder(spark, "warc")
    kind = dict(pages.dtypes)["page_id"]
    out = read_archives(write_archives(pages, folder))
    return out.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))
