"""Legacy web archives (ARC) converted to WARC, written and read back (operator 4).

ARC files of both versions are parsed by their own rules: the first record
(``filedesc://``) names the version, whose record lines have five or ten
fields ending in the declared length; exactly that many bytes follow and a
line feed. Each record becomes a WARC record: an identifier derived from
its address, time and payload (so a repeated run names it alike), the time
as ISO 8601, the SHA-1 digests in base32, and the type: of records with
equal payloads the one with the largest id is a response, the others
revisit it.

Archives are written by Spark's text sink, one file per task; how many tasks
follows from the payloads' bytes, about FILE_BYTES each, so files stay far
below what the binary source can read however large the input is. They are
read back as binary files, unpacked as a stream, record by record by
``Content-Length``; a payload may hold anything that looks like a record.

Digests are compared before payloads move: which record answers for a
digest is an aggregation over (digest, id) combined on the map side, and
only the type and target join the payloads, by id and digest. A payload
that a third of all pages have is so spread over all tasks.

Cases: null html is an empty payload, null or blank address becomes
``urn:none``; white space in addresses is percent-encoded; null ids are
written without a number and never are the answering record unless all
are null; repeated rows give repeated records; with ``least`` bytes given,
smaller payloads are never revisits; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwise.llm.common import folder, save, ship, shuffle_width

LEAST_BYTES = 0
FILE_BYTES = 256 << 20  # of payloads in one archive
READ_BYTES = 8 << 20  # of payloads handed on at a time when reading
STARTED = "20200101000000"
_RECORD = "page_id long, url string, fetched string, mime string, payload binary, payload_digest string"


def _digest(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


# ---------------------------------------------------------------- ARC

def arc_file(version: int, rows) -> bytes:
    """An ARC file of version 1 or 2 from (id, address, payload) rows; the id stands in the host address field."""
    fields = {1: "URL IP-address Archive-date Content-type Archive-length",
              2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}[version]
    body = f"{version} 0 chartwise\n{fields}\n".encode()
    middle = {1: "", 2: " 200 - - 0 pages.arc"}[version]
    out = [f"filedesc://pages.arc 0.0.0.0 {STARTED} text/plain{middle} {len(body)}\n".encode(), body, b"\n"]
    for page, url, payload in rows:
        address = "".join(chr(b) if 0x20 < b < 0x7F else f"%{b:02X}" for b in (url or "").strip().encode())
        number = "-" if page is None else str(page)
        out += [f"{address or 'urn:none'} {number} {STARTED} text/html{middle} {len(payload)}\n".encode(), payload, b"\n"]
    return b"".join(out)


def parse_arc(raw: bytes):
    """(address, number, date, mime, payload) of every record but the file description."""
    at, version = 0, None
    while at < len(raw):
        end = raw.index(b"\n", at)
        line = raw[at:end].decode("utf-8", "replace").rstrip("\r")
        at = end + 1
        if not line:
            continue
        if version is None:
            if not line.startswith("filedesc://"):
                raise ValueError("an ARC file starts with its description")
            size = int(line.rsplit(" ", 1)[1])
            version = int(raw[at: at + size].split(b" ", 1)[0])
            if version not in (1, 2):
                raise ValueError(f"ARC version {version} is unknown")
            at += size
            continue
        part = line.split(" ")
        if len(part) != (5 if version == 1 else 10):
            raise ValueError(f"record line of version {version} has {len(part)} fields")
        size = int(part[-1])
        if at + size > len(raw):
            raise ValueError("a record ends after its file")
        yield part[0], part[1], part[2], part[3], raw[at: at + size]
        at += size


def to_arc(pages: DataFrame, rows_per_file: int = 500) -> DataFrame:
    """(archive binary): ARC files of both versions in turn, made batch by batch without a shuffle."""
    ship(pages.sparkSession)

    def run(batches):
        version = 1
        for batch in batches:
            for lo in range(0, batch.num_rows, rows_per_file):
                b = batch.slice(lo, rows_per_file)
                payload = [(x or "").encode() for x in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([arc_file(version, zip(b.column(0).to_pylist(), b.column(1).to_pylist(), payload, strict=True))], pa.binary())], names=["archive"])
                version = 3 - version

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "archive binary")


def arc_records(archives: DataFrame) -> DataFrame:
    """Parsed records of ARC files, with payload digest."""
    ship(archives.sparkSession)

    def run(batches):
        for batch in batches:
            for archive in batch.column(0):
                got = list(parse_arc(gzip.decompress(raw) if (raw := archive.as_py())[:2] == b"\x1f\x8b" else raw))
                yield pa.RecordBatch.from_arrays([
                    pa.array([None if r[1] == "-" else int(r[1]) for r in got], pa.int64()),
                    *(pa.array([r[k] for r in got], pa.string()) for k in (0, 2, 3)),
                    pa.array([r[4] for r in got], pa.binary()),
                    pa.array([_digest(r[4]) for r in got], pa.string())],
                    names=["page_id", "url", "fetched", "mime", "payload", "payload_digest"])

    return archives.mapInArrow(run, _RECORD)


# ---------------------------------------------------------------- WARC

def described(records: DataFrame) -> DataFrame:
    """(page_id, payload_digest, bytes) of every record, saved."""
    return save(records.select("page_id", "payload_digest", F.octet_length("payload").cast("long").alias("bytes")))


def answering(short: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, payload_digest, refers_to): the records of ``described`` that revisit another, and which; an id may stand on several payloads."""
    short = short.filter(F.col("bytes") >= least).select("page_id", "payload_digest")
    top = save(short.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1"))
    return short.join(top, "payload_digest").filter("page_id <> refers_to").select("page_id", "payload_digest", "refers_to").distinct()


def warc_text(records: DataFrame) -> DataFrame:
    """One string per record (header and payload), without the final line feed that the sink adds."""
    ship(records.sparkSession)

    def run(batches):
        for b in batches:
            out = []
            t = b.select(["page_id", "url", "fetched", "mime", "payload", "payload_digest", "refers_to"]).to_pydict()
            for page, url, day, mime, raw, digest, target in zip(*t.values(), strict=True):
                made = uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {day} {page} {digest}")
                date = f"{day[:4]}-{day[4:6]}-{day[6:8]}T{day[8:10]}:{day[10:12]}:{day[12:14]}Z"
                revisit = target is not None
                block = b"" if revisit else raw
                head = [
                    "WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{made}>",
                    f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}",
                    f"WARC-Block-Digest: sha1:{_digest(block)}", f"X-Page-ID: {'-' if page is None else page}", f"X-Payload-Length: {len(raw)}"]
                if revisit:
                    head += [f"X-Refers-To-Page: {target}", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
                head += [f"Content-Type: {mime}", f"Content-Length: {len(block)}"]
                out.append("\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return records.mapInArrow(run, "value binary").select(F.col("value").cast("string"))


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as gzip-compressed WARC files under ``path``."""
    warc_text(records).write.option("lineSep", "\n").option("compression", "gzip").text(path)


def read_warc(spark, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, record_id, payload) of WARC files."""
    ship(spark)

    def some(records):
        part, size = [], 0
        for r in records:
            part.append(r)
            size += len(r[1])
            if size > READ_BYTES or len(part) == 2000:
                yield part
                part, size = [], 0
        yield part

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                for part in some(parse_warc(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())))):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([None if h["x-page-id"] == "-" else int(h["x-page-id"]) for h, _ in part], pa.int64()),
                        pa.array([int(h["x-payload-length"]) for h, _ in part], pa.int64()),
                        pa.array([h["warc-payload-digest"].removeprefix("sha1:") for h, _ in part], pa.string()),
                        pa.array([h["warc-type"] for h, _ in part], pa.string()),
                        pa.array([int(h["x-refers-to-page"]) if "x-refers-to-page" in h else None for h, _ in part], pa.int64()),
                        pa.array([h["warc-target-uri"] for h, _ in part], pa.string()),
                        pa.array([h["warc-record-id"].strip("<>") for h, _ in part], pa.string()),
                        pa.array([p for _, p in part], pa.binary())],
                        names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "record_id", "payload"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, record_id string, payload binary")


def parse_warc(raw):
    """(header, block) of every record of WARC bytes or of a stream of them; checks the block digest and, for responses, the payload digest."""
    stream = io.BytesIO(raw) if isinstance(raw, bytes) else raw
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError("not at the start of a record")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, v = line.decode().split(":", 1)
            head[k.strip().lower()] = v.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if head["warc-block-digest"] != f"sha1:{_digest(block)}":
            raise ValueError("a block does not have its digest")
        if head["warc-type"] == "response" and head["warc-payload-digest"] != head["warc-block-digest"]:
            raise ValueError("a payload does not have its digest")
        yield head, block
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where it declares")


def convert(archives: DataFrame, path: str, least: int = LEAST_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """ARC files (a binary column) to WARC files of about ``file_bytes`` of payloads under ``path``."""
    records = arc_records(archives)
    short = described(records)
    total = short.agg(F.sum("bytes")).first()[0] or 0
    key = ["page_id", "payload_digest"]
    files = max(shuffle_width(archives.sparkSession), -(-total // file_bytes))
    typed = records.repartition(files, *key).join(answering(short, least), key, "left")
    write_warc(typed, path)


def round_trip(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Pages as ARC files, converted to WARC files in the shared folder, and those read back."""
    spark = pages.sparkSession
    path = folder(spark)
    convert(to_arc(pages), path, least)
    return read_warc(spark, path)
