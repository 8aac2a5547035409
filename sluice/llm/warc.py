"""Zstandard WARC archives: writer and validating reader.

An archive is a skippable frame that holds the dictionary, then one Zstandard frame
per record. The reader loads the dictionary from the leading skippable frame, walks
the frames one at a time (memory is bounded by the largest record, not the archive),
and checks the version line, required headers, Content-Length, the record's end and
the SHA-1 of its payload.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Fixed values of the formats: the skippable frame's and the frame's magic numbers, base32 alphabet.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: bytes of first records an archive's dictionary is trained on, and the dictionary's size.
DICT_SAMPLE, DICT_SIZE = 1 << 20, 32 << 10
#: largest header block and record the reader accepts; longer ones are reported, not read.
MAX_RECORD = 1 << 30


class WarcError(ValueError):
    """A record or archive that breaks the format."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    http_headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def build_record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record. ``refers_to`` is None for a response, else the id a revisit points to.

    A revisit keeps the HTTP header block, whose Content-Length is the full payload's.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
    ]
    if url:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(raw: bytes, single: tuple[str, ...] | None = None) -> dict[str, str]:
    """Names in lower case and values. Only ``single`` names (None: but WARC-Concurrent-To, all)
    must not be given twice; the values of others are joined by line ends."""
    out: dict[str, str] = {}
    last = None
    for line in raw.split(b"\r\n"):
        text = line.decode("utf-8", "replace")
        if text[:1] in " \t" and last:
            out[last] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"malformed header line {text[:60]!r}")
        last = name.lower()
        if last in out:
            if last in single if single is not None else last != "warc-concurrent-to":
                raise WarcError(f"header {name} is given twice")
            out[last] += "\n" + value.strip()
        else:
            out[last] = value.strip()
    return out


def parse_record(data: bytes) -> Record:
    """Parse and validate one decoded record; raises WarcError."""
    if not data.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")):
        raise WarcError("no WARC version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError("header block has no end")
    headers = _fields(data[10:end])
    for name in REQUIRED:
        if not headers.get(name):
            raise WarcError(f"required header {name} is missing")
    length = headers["content-length"]
    if not length.isascii() or not length.isdigit():
        raise WarcError(f"Content-Length {length[:20]!r} is no number")
    start, n = end + 4, int(length)
    if len(data) != start + n + 4 or data[start + n :] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {n}, the block has {len(data) - start - 4} bytes or no end mark")
    rec = Record(headers, data[start : start + n])
    if headers["warc-type"] in ("response", "revisit"):
        at = rec.block.find(b"\r\n\r\n")
        if at < 0:
            raise WarcError("the block has no HTTP header end")
        rec.http_headers = _fields(rec.block[rec.block.find(b"\r\n") + 2 : at], single=("content-length",))
        rec.payload = rec.block[at + 4 :]
        stated = rec.http_headers.get("content-length", "")
        if headers["warc-type"] == "response":
            if stated and stated != str(len(rec.payload)):
                raise WarcError(f"payload has {len(rec.payload)} bytes, its header says {stated}")
            want = headers.get("warc-payload-digest")
            if want and want.lower().startswith("sha1:") and want[5:].upper() != payload_digest(rec.payload):
                raise WarcError("payload digest differs")
        elif "warc-refers-to" not in headers and "warc-payload-digest" not in headers:
            raise WarcError("a revisit names neither record nor digest")
    return rec


class ArchiveWriter:
    """Streams records to ``out``; the first ones are held back to train the dictionary."""

    def __init__(self, out, level: int = 3):
        self.out, self.level = out, level
        self.held: list[bytes] = []
        self.size = 0
        self.records = 0
        self.comp = None

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.comp is not None:
            self.out.write(self.comp.compress(record))
            return
        self.held.append(record)
        self.size += len(record)
        if self.size >= DICT_SAMPLE:
            self._start()

    def _start(self) -> None:
        raw = b""
        if self.size > 20 * DICT_SIZE and len(self.held) >= 16:
            try:
                # parts of records, so that many pages of one size class can be sampled
                parts = [r[i : i + 4096] for r in self.held for i in range(0, len(r), 4096)]
                raw = zstd.train_dictionary(DICT_SIZE, parts, k=256, d=8).as_bytes()
            except zstd.ZstdError:
                raw = b""
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(raw)) + raw)
        use = {"dict_data": zstd.ZstdCompressionDict(raw)} if raw else {}
        self.comp = zstd.ZstdCompressor(level=self.level, write_content_size=True, write_checksum=True, **use)
        for r in self.held:
            self.out.write(self.comp.compress(r))
        self.held = []

    def close(self) -> None:
        if self.comp is None:
            self._start()


def read_frames(src, chunk: int = 1 << 18) -> Iterator[bytes]:
    """Decoded records of an archive, one per frame. ``src.read(n)`` may give any size.

    An archive that starts with a record's frame has no dictionary.
    """
    head = src.read(8)
    while len(head) < 8 and (got := src.read(8 - len(head))):
        head += got
    plain = head.startswith(FRAME_MAGIC)
    if not plain and (len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIPPABLE_MAGIC):
        raise WarcError("neither a dictionary frame nor a record's leads")
    size = 0 if plain else struct.unpack("<I", head[4:])[0]
    raw = b""
    while len(raw) < size:
        got = src.read(size - len(raw))
        if not got:
            raise WarcError("the dictionary is cut off")
        raw += got
    if raw.startswith(FRAME_MAGIC):  # a dictionary may be stored compressed
        raw = zstd.ZstdDecompressor().decompress(raw)
    dec = zstd.ZstdDecompressor(**({"dict_data": zstd.ZstdCompressionDict(raw)} if raw else {}))
    rest = head if plain else b""
    while True:
        data = rest or src.read(chunk)
        if not data:
            return
        frame, parts, n = dec.decompressobj(), [], 0
        rest = b""
        while True:
            part = frame.decompress(data)
            parts.append(part)
            n += len(part)
            if n > MAX_RECORD:
                raise WarcError(f"a record has more than {MAX_RECORD} bytes")
            if frame.eof:
                rest = frame.unused_data
                break
            data = src.read(chunk)
            if not data:
                raise WarcError("the last frame is cut off")
        yield b"".join(parts)


def _local(path: str) -> str | None:
    for prefix in ("file://", "file:"):
        if path.startswith(prefix):
            return path[len(prefix) :]
    return path if "://" not in path else None


def _filesystem(path: str):
    """(file system, path in it) of a shared path, for workers."""
    from pyarrow import fs

    local = _local(path)
    return (fs.LocalFileSystem(), local) if local is not None else fs.FileSystem.from_uri(path)


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write (page_id, url, payload binary, payload_digest, refers_to) rows, an archive per task.

    Returns the manifest (path, records, bytes), itself stored in ``folder``. A task's
    archive has a name of its own attempt and is listed only when the attempt's
    manifest part is committed, so retries and speculation leave at most stray files.
    """

    def run(batches):
        system, base = None, None
        writer = out = path = None
        for b in batches:
            if b.num_rows and writer is None:
                system, base = _filesystem(folder)
                path = f"{uuid.uuid4().hex}.warc.zst"
                system.create_dir(base, recursive=True)
                out = system.open_output_stream(f"{base}/{path}", compression=None)
                writer = ArchiveWriter(out)
            for page, url, payload, digest, ref in zip(*(c.to_pylist() for c in b.columns)):
                writer.add(build_record(page, url, payload or b"", digest, ref, date))
        if writer is not None:
            writer.close()
            out.close()
            info = system.get_file_info(f"{base}/{path}")
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{path}", "records": writer.records, "bytes": info.size}])

    cols = records.select("page_id", "url", "payload", "payload_digest", "refers_to")
    manifest = cols.mapInArrow(run, "path string, records long, bytes long")
    manifest.write.parquet(f"{folder}/_manifest")
    return records.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/_manifest")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of the archives in ``manifest.path``; broken ones are rows with ``error``.

    One archive is read by one task, record by record. Columns: page_id, url,
    record_type, refers_to, payload_bytes (of the full payload, also for revisits),
    payload_digest, error, and payload if asked for.
    """
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, error string"
    schema += ", payload binary" if payloads else ""

    def page(urn: str | None):
        tail = (urn or "").strip("<>").rpartition(":")[2]
        return int(tail) if tail.lstrip("-").isdigit() else None

    def row(data: bytes) -> dict:
        try:
            rec = parse_record(data)
        except WarcError as e:
            return {"error": str(e)}
        h = rec.headers
        n = rec.http_headers.get("content-length", str(len(rec.payload)))
        out = {
            "page_id": page(h["warc-record-id"]), "url": h.get("warc-target-uri"), "record_type": h["warc-type"],
            "refers_to": page(h.get("warc-refers-to")), "payload_bytes": int(n),
            "payload_digest": h.get("warc-payload-digest", "")[5:],
        }
        return out | ({"payload": rec.payload} if payloads else {})

    def run(batches):
        target = None
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, size = [], 0
                try:
                    system, base = _filesystem(path)
                    with system.open_input_stream(base, compression=None) as src:
                        for data in read_frames(src):
                            rows.append(row(data))
                            size += len(data) if payloads else 256
                            if size > 8 << 20:
                                yield pa.RecordBatch.from_pylist(rows, schema=target)
                                rows, size = [], 0
                except (WarcError, zstd.ZstdError) as e:
                    rows.append({"error": f"{path}: {e}"})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=target)

    def typed(batches):
        fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("error", pa.string())]
        fields += [("payload", pa.binary())] if payloads else []
        want = pa.schema(fields)
        for b in run(batches):
            cols = [b.column(b.schema.names.index(f.name)).cast(f.type) if f.name in b.schema.names else pa.nulls(b.num_rows, f.type) for f in want]
            yield pa.RecordBatch.from_arrays(cols, schema=want)

    n = common.shuffle_partitions(manifest.sparkSession)
    return manifest.select("path").repartition(n, "path").mapInArrow(typed, schema)


def archive_pages(pages: DataFrame, min_revisit_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html), read the archives back.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes, those with the
    largest page_id are responses (a repeated row with the same id also is one) and
    the others revisit it. Null html is an empty payload; a null page_id never is the
    largest unless all are null, when all rows are responses. Other columns of
    ``pages`` are ignored. Raises on reading if a record fails validation.

    Plan: digests are reduced map-side to one row per payload; the join back carries
    ids only on its grouped side, and a hot payload's rows are split by AQE.
    """
    spark = pages.sparkSession
    folder = folder or common.fresh_path(spark, "warc")
    src = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )
    hexed = F.sha1("payload")
    slim = src.select("page_id", hexed.alias("h"), F.octet_length("payload").alias("n"))
    # more than one row per digest is rare: only those groups take part in the join back
    groups = slim.where(F.col("n") >= min_revisit_bytes).groupBy("h").agg(F.max("page_id").alias("top"), F.count("*").alias("c")).where("c > 1").select("h", "top")
    records = (
        src.withColumn("h", hexed)
        .join(groups, "h", "left")
        .select("page_id", "url", "payload", _base32("h").alias("payload_digest"), F.when(F.col("page_id").eqNullSafe(F.col("top")) | F.col("top").isNull(), F.lit(None)).otherwise(F.col("top")).cast("long").alias("refers_to"))
    )
    manifest = write_archives(records, folder)
    out = read_archives(manifest)
    checked = F.when(F.col("error").isNull(), F.col("payload_bytes")).otherwise(F.raise_error(F.concat(F.lit("invalid WARC record: "), "error")).cast("long"))
    return out.select("page_id", checked.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def _base32(hex_col: str):
    """Base32 of a 40-digit hex column: 8 groups of 20 bits, each four letters."""
    out = []
    for g in range(8):
        v = F.conv(F.substring(hex_col, g * 5 + 1, 5), 16, 10).cast("int")
        for s in (15, 10, 5, 0):
            out.append(F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*out)
