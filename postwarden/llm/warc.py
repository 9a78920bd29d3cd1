"""Legacy ARC archives to WARC.

``read_arc`` parses the records of an ARC file of version 1 or 2: the version block names the version, each
record's header line has that version's fields, and exactly the declared number of bytes follows.
``to_warc`` gives such a record its WARC form: record id, time, type and digests are derived from the record.
``read_warc`` reads WARC records back by their declared lengths.

In Spark, pages become ARC archives (one per Arrow batch and version), which are converted in the same task
to WARC records; Spark's text writer stores them, compressed, in the shared folder, with its usual commit of
whole tasks, and ``archived`` reads the files back.  Which record holds a payload and which ones revisit it is
decided by the digest: the copies of a payload are never gathered, only their largest id is (combined before
the shuffle), and the payloads travel once, joined by their own id.

Null html is an empty payload.  Rows that repeat an id and payload get the same type.  A null id takes part
and counts as smaller than any other.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwarden.llm.common import batch
from postwarden.session import shared_dir

#: Fields of a record's header line by version of the archive.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORD_END = b"\r\n\r\n"
#: Each archive file is read whole by one task; this bounds its records.
RECORDS_PER_FILE = 5_000
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public namespace for URLs


def arc_head(name: str, version: int, date: str) -> bytes:
    """The version block that begins an archive."""
    body = f"{version} 0 postwarden\n{FIELDS[version]}\n\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain"
    line += f" {len(body)}" if version == 1 else f" 200 - - 0 {name} {len(body)}"
    return line.encode() + b"\n" + body


def arc_record(name: str, version: int, date: str, url: str | None, block: bytes, offset: int) -> bytes:
    line = f"{quote(url or '-', safe='/:?#[]@!$&()*+,;=%~')} 0.0.0.0 {date} text/html"
    line += f" {len(block)}" if version == 1 else f" 200 - - {offset} {name} {len(block)}"
    return line.encode() + b"\n" + block + b"\n"


def read_arc(archive: io.BufferedIOBase) -> Iterator[dict]:
    """The records of an archive after its version block: header fields by name, and "block"."""
    fields = None
    while line := archive.readline():
        if not line.strip():
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if fields is None:
            if not parts[0].startswith("filedesc://"):
                raise ValueError("an archive begins with its version block")
            body = archive.read(int(parts[-1]))
            version = int(body.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"unknown version {version}")
            fields = FIELDS[version].split(" ")
            continue
        if len(parts) != len(fields):
            raise ValueError(f"{len(parts)} fields where version {version} has {len(fields)}")
        record = dict(zip(fields, parts))
        size = int(record["Archive-length"])
        record["block"] = archive.read(size)
        if len(record["block"]) != size:
            raise ValueError("the archive ends inside a record")
        yield record


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page}/{digest}')}>"


def http_parts(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head with its blank line, fields by lower-case name, and body of an HTTP response."""
    head, mark, body = block.partition(RECORD_END)
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.decode("utf-8", "replace").partition(":")
        fields[k.strip().lower()] = v.strip()
    return head + mark, fields, body


def to_warc(record: dict, refers_to: str | None, page: str, revisit: bool) -> bytes:
    """One ARC record as a WARC record without its final blank lines."""
    head, _, body = http_parts(record["block"])
    date, digest = record["Archive-date"], base32_sha1(body)
    block = head if revisit else record["block"]
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page, digest)}",
        f"WARC-Date: {date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z",
        f"WARC-Target-URI: {record['URL']}", f"WARC-IP-Address: {record['IP-address']}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to or '', digest)}", f"WARC-Refers-To-Page: {refers_to or ''}",
        ]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + RECORD_END + block


def read_warc(archive: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields by lower-case name and block of each record."""
    while line := archive.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record begins with its version")
        fields = {}
        while (line := archive.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        size = int(fields["content-length"])
        block = archive.read(size)
        if len(block) != size:
            raise ValueError("the archive ends inside a record")
        yield fields, block


class _Inflated(io.RawIOBase):
    """Reads compressed bytes, one or more members, as a stream."""

    def __init__(self, data: bytes):
        self.data, self.at, self.inflate, self.left = data, 0, zlib.decompressobj(31), b""

    def readable(self):
        return True

    def readinto(self, space):
        while not self.left and self.at < len(self.data):
            chunk = self.data[self.at : self.at + (1 << 16)]
            self.at += len(chunk)
            self.left = self.inflate.decompress(chunk)
            if self.inflate.eof:
                self.at -= len(self.inflate.unused_data)
                self.inflate = zlib.decompressobj(31)
        n = min(len(space), len(self.left))
        space[:n], self.left = self.left[:n], self.left[n:]
        return n


def opened(data: bytes) -> io.BufferedReader:
    return io.BufferedReader(_Inflated(data) if data[:2] == b"\x1f\x8b" else io.BytesIO(data), 1 << 16)


def arc_archives(rows: Iterable[tuple], name: str, date: str) -> dict[int, tuple[bytes, list]]:
    """An archive of each version, and per record what the conversion needs besides it.

    Pages with an even id go to the version 1 archive, the others to the version 2 one.
    """
    made = {v: (bytearray(arc_head(name, v, date)), []) for v in FIELDS}
    for page, url, html, refers_to, revisit in rows:
        payload = (html or "").encode("utf-8", "surrogateescape")
        shown = "" if page is None else str(page)
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {shown}\r\nContent-Length: {len(payload)}\r\n\r\n"
        archive, extra = made[1 if (page or 0) % 2 == 0 else 2]
        archive += arc_record(name, 1 if archive is made[1][0] else 2, date, url, head.encode() + payload, len(archive))
        extra.append((shown, None if refers_to is None else str(refers_to), revisit))
    return {v: (bytes(a), extra) for v, (a, extra) in made.items()}


def convert(archive: bytes, extra: list) -> Iterator[bytes]:
    """WARC records of an ARC archive."""
    for record, (page, refers_to, revisit) in zip(read_arc(io.BytesIO(archive)), extra, strict=True):
        yield to_warc(record, refers_to, page, revisit)


def revisits(df: DataFrame, least_bytes: int) -> DataFrame:
    """Page, digest and the page to refer to, for each record that revisits another."""
    rows = df.select(
        "page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"),
        F.octet_length(F.coalesce("html", F.lit(""))).alias("size"),
    ).filter(F.col("size") >= least_bytes).drop("size")
    largest = rows.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies"))
    several = largest.filter("copies > 1").drop("copies")
    return rows.join(several, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()


def write_archives(df: DataFrame, path: str, least_bytes: int = 0, date: str = "20240101000000") -> None:
    """Writes the pages (page_id, url, html) as WARC archives."""
    pages = df.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    known = revisits(pages, least_bytes).select(
        F.col("page_id").alias("their_id"), F.col("digest").alias("their_digest"), "refers_to"
    )
    own = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    joined = pages.withColumn("digest", own).join(
        known, F.col("page_id").eqNullSafe(F.col("their_id")) & (F.col("digest") == F.col("their_digest")), "left"
    ).select("page_id", "url", "html", "refers_to", F.col("their_digest").isNotNull().alias("revisit"))
    schema = pa.schema([("record", pa.string())])

    def run(batches):
        for k, b in enumerate(batches):
            for at in range(0, b.num_rows, 512):
                rows = zip(*(c.to_pylist() for c in b.slice(at, 512).columns))
                for archive, extra in arc_archives(rows, f"part-{k}-{at}.arc", date).values():
                    if extra:
                        yield batch(schema, pa.array(convert(archive, extra), pa.binary()).cast(pa.string()))

    joined.mapInArrow(run, "record string").write.option("lineSep", RECORD_END.decode()).option(
        "compression", "gzip"
    ).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def read_archives(spark, path: str) -> DataFrame:
    """Page, payload size and digest, type and reference of every WARC record in a folder."""
    schema = pa.schema([
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()),
        ("refers_to_record", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()),
    ])

    def number(x):
        return int(x) if x else None

    def run(batches):
        for b in batches:
            for data in b.column(0):
                rows = []
                for fields, block in read_warc(opened(data.as_py())):
                    _, http, body = http_parts(block)
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    size = int(http["content-length"])
                    if kind == "response" and (len(body) != size or base32_sha1(body) != digest):
                        raise ValueError(f"damaged record {fields['warc-record-id']}")
                    rows.append((
                        number(http.get("x-page-id")), size, digest, kind, number(fields.get("warc-refers-to-page")),
                        fields["warc-record-id"], fields.get("warc-refers-to"), fields["warc-target-uri"], fields["warc-date"],
                    ))
                    if len(rows) == 4096:
                        yield batch(schema, *map(list, zip(*rows)))
                        rows = []
                if rows:
                    yield batch(schema, *map(list, zip(*rows)))

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(
        run,
        "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
        "record_id string, refers_to_record string, target_uri string, warc_date string",
    )


def archived(df: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back."""
    path = shared_dir(df.sparkSession, "warc")
    write_archives(df, path, least_bytes)
    return read_archives(df.sparkSession, path)
