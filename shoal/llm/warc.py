"""Legacy archives: ARC records parsed by version and written as WARC, and WARC read back."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from gzip import GzipFile
from io import BufferedReader, BytesIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm._base import materialise, partitions, shared_file, work_dir

# Fields of a record's header line by ARC version, and the formats of identifiers.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes after which a task begins another archive, and bytes read at once.
ARCHIVE_BYTES, READ_BYTES = 512 * 1024 * 1024, 64 * 1024
DATE = "19970101000000"


@dataclass
class ArcRecord:
    """``body`` is what the server sent: as a rule HTTP status line and headers, a blank line, and the payload."""

    url: str
    ip: str
    date: str
    mime: str
    status: str
    body: bytes

    def http(self) -> tuple[bytes, bytes]:
        """HTTP header with its blank line, and payload; a body without a header gets one."""
        if self.body.startswith(b"HTTP/"):
            ends = [(at, len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (at := self.body.find(mark)) >= 0]
            if ends:
                at, n = min(ends)
                return self.body[: at + n], self.body[at + n :]
        return http_header(self.status, self.mime, len(self.body)), self.body


def http_header(status: str, mime: str, length: int) -> bytes:
    return f"HTTP/1.1 {status} OK\r\nContent-Type: {mime}\r\nContent-Length: {length}\r\n\r\n".encode("utf-8", "surrogatepass")


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_arc(records: Iterable[ArcRecord], version: int, name: str = "pages.arc") -> bytes:
    """An ARC file: version block, then records of header line, declared length and body."""
    about = f"{version} 0 shoal\n{' '.join(ARC_FIELDS[version])}\n".encode()
    rest = "" if version == 1 else " 200 - - 0 " + name
    out = [f"filedesc://{name} 0.0.0.0 {DATE} text/plain{rest} {len(about)}\n".encode(), about, b"\n"]
    at = sum(map(len, out))
    for r in records:
        more = "" if version == 1 else f" {r.status} {payload_digest(r.body)} - {at} {name}"
        head = f"{r.url} {r.ip} {r.date} {r.mime}{more} {len(r.body)}\n".encode("utf-8", "surrogatepass")
        out += [head, r.body, b"\n"]
        at += len(head) + len(r.body) + 1
    return b"".join(out)


def read_arc(stream) -> Iterator[ArcRecord]:
    """Records of an ARC stream, gzipped (members one after the other) or not, without the version block.

    The version block's second line says which version it is, and that which fields a
    header line has; fields are counted from the right, so a URL may hold spaces.
    Bodies are as long as declared, whatever they hold. A line that doesn't fit or a
    body cut short raises ValueError.
    """
    stream = stream if hasattr(stream, "peek") else BufferedReader(stream)
    if stream.peek(2)[:2] == b"\x1f\x8b":
        stream = GzipFile(fileobj=stream)
    version = None
    while True:
        line = stream.readline()
        if not line:
            return
        if line.strip() == b"":
            continue
        text = line.rstrip(b"\r\n").decode("utf-8", "surrogatepass")
        if version is None:
            length = text.rsplit(" ", 1)[-1]
            about = stream.read(int(length)) if length.isdigit() else b""
            number = about.split(None, 1)[:1]
            version = int(number[0]) if number and number[0].isdigit() else 0
            if not text.startswith("filedesc://") or version not in ARC_FIELDS or len(about) < int(length):
                raise ValueError(f"not an ARC version block: {text[:80]}")
            continue
        names = ARC_FIELDS[version]
        parts = text.rsplit(" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"not an ARC version {version} header: {text[:80]}")
        head = dict(zip(names, parts))
        body = stream.read(int(head["Archive-length"]))
        if len(body) < int(head["Archive-length"]):
            raise ValueError(f"record cut short: {text[:80]}")
        yield ArcRecord(head["URL"], head["IP-address"], head["Archive-date"], head["Content-type"], head.get("Result-code") or _status(body), body)


def _status(body: bytes) -> str:
    """The status of the body's first line; version 1 has none in its header line."""
    parts = body[:64].split(None, 2)
    return parts[1].decode() if body.startswith(b"HTTP/") and len(parts) > 1 and parts[1].isdigit() else "200"


def record_id(url: str, digest: str, page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{digest}|{url}')}>"


def warc_date(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


@dataclass
class Response:
    """The record that a revisit refers to."""

    page_id: int
    url: str
    date: str


def _member(head: list[str], block: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def warc_info(name: str) -> bytes:
    """The record that an archive begins with."""
    block = b"software: shoal\r\nformat: WARC File Format 1.1\r\n"
    head = [
        "WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {warc_date(DATE)}", f"WARC-Filename: {name}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}",
    ]
    return _member(head, block)


def warc_record(r: ArcRecord, page_id, digest: str, refers_to: Response | None = None) -> bytes:
    """A gzip member: a response with its payload, or a revisit that names the response.

    X-Page-Id and X-Refers-To-Page are extension fields, for tables keyed by page.
    """
    http, payload = r.http()
    block = http if refers_to else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {record_id(r.url, digest, page_id)}", f"WARC-Date: {warc_date(r.date)}",
        f"WARC-Target-URI: {r.url}", f"WARC-IP-Address: {r.ip}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to:
        head += [
            f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to.url, digest, refers_to.page_id)}", f"WARC-Refers-To-Target-URI: {refers_to.url}",
            f"WARC-Refers-To-Date: {warc_date(refers_to.date)}", f"X-Refers-To-Page: {refers_to.page_id}",
        ]
    return _member(head, block)


def read_warc(stream) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC headers, HTTP headers, payload) of each gzip member; one record is in memory at a time.

    A warcinfo record has no HTTP headers; a revisit has an empty payload.
    """
    z, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(READ_BYTES)
        if not data:
            break
        parts.append(z.decompress(data))
        rest = z.unused_data
        if not z.eof:
            continue
        head, _, tail = b"".join(parts).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
        block = tail[: int(fields["Content-Length"])]
        if fields["WARC-Block-Digest"] != f"sha1:{payload_digest(block)}":
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
        if fields["WARC-Type"] == "warcinfo":
            yield fields, {}, block
        else:
            http, payload = ArcRecord("", "", "", "", "", block).http()
            lines = http.decode("utf-8", "replace").splitlines()[1:]
            yield fields, dict(line.split(": ", 1) for line in lines if ": " in line), payload
        z, parts = zlib.decompressobj(31), []
    if parts and any(parts):
        raise ValueError("archive cut short")


_RECORD = "page_id long, url string, ip string, date string, mime string, status string, body binary, digest string, size long"
_TYPES = [pa.int64(), *[pa.string()] * 5, pa.binary(), pa.string(), pa.int64()]


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(_TYPES)], names=[x.split()[0] for x in _RECORD.split(", ")])


def _row(page_id, r: ArcRecord) -> tuple:
    payload = r.http()[1]
    return (page_id, r.url, r.ip, r.date, r.mime, r.status, r.body, payload_digest(payload), len(payload))


def pages_as_arc(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Pages put into ARC archives (odd ids as version 1, others as version 2) and parsed from them: records with the payload's digest and size.

    Each body has an HTTP header of its own, as a crawler stores it. Null html is an
    empty payload, a null or empty url becomes ``-``, white space that can't stand in
    a header line becomes ``%0A`` and the like.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(b.column(0).cast(pa.int64()).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
            for version in (1, 2):
                part = [r for r in rows if (r[0] or 0) % 2 == version % 2]
                for at in range(0, len(part), 500):
                    some, put = part[at : at + 500], []
                    for _, url, html in some:
                        payload = (html or "").encode("utf-8", "surrogatepass")
                        put.append(ArcRecord((url or "-").replace("\n", "%0A").replace("\r", "%0D"), "0.0.0.0", date, "text/html", "200", http_header("200", "text/html", len(payload)) + payload))
                    yield _record_batch([_row(p[0], r) for p, r in zip(some, read_arc(BytesIO(write_arc(put, version))))])

    return pages.select("page_id", "url", "html").mapInArrow(run, _RECORD)


def arc_files(paths: DataFrame) -> DataFrame:
    """The records of ARC files (column ``path``, gzipped or not), in the form of ``pages_as_arc``, page_id null.

    A file is read by one task, a record at a time. Empty files and tables give nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, size = [], 0
                with shared_file(path, "rb") as stream:
                    for r in read_arc(stream):
                        rows.append(_row(None, r))
                        size += len(r.body)
                        if size >= 16_000_000:
                            yield _record_batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _record_batch(rows)

    return paths.where(F.col("path").isNotNull()).select("path").repartition(4 * partitions(paths.sparkSession)).mapInArrow(run, _RECORD)


def write_archives(records: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write records as WARC archives under ``folder``; gives (path, records).

    Of equal payloads of at least ``least_bytes`` that with the largest page_id is the
    response, the others revisit it. Archives of tasks that failed aren't listed.
    """
    records = materialise(records)  # parsed once; the digests are read without the bodies
    big = F.col("size") >= least_bytes
    # Counted before the shuffle, so that a payload on a third of all pages is one row a task.
    named = records.where(big).groupBy("digest").agg(F.max(F.struct("page_id", "url", "date")).alias("r"), F.count(F.lit(1)).alias("n"))
    # Only payloads that repeat are left. Written, so that the join can be a broadcast while they are few, else one that is split where a digest is hot.
    same = materialise(named.where("n > 1 AND r.page_id IS NOT NULL").select("digest", F.col("r.page_id").alias("kept"), F.col("r.url").alias("kept_url"), F.col("r.date").alias("kept_date")), narrow=True)
    again = big & F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    joined = records.join(same, "digest", "left").withColumn("again", again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, n, size, done = None, "", 0, 0, []
        for b in batches:
            for at in range(0, b.num_rows, 100):
                for r in b.slice(at, 100).to_pylist():
                    if out is None:
                        path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = shared_file(path, "wb")
                        out.write(warc_info(path.rpartition("/")[2]))
                    to = Response(r["kept"], r["kept_url"], r["kept_date"]) if r["again"] else None
                    data = warc_record(ArcRecord(r["url"], r["ip"], r["date"], r["mime"], r["status"], r["body"]), r["page_id"], r["digest"], to)
                    out.write(data)
                    n, size = n + 1, size + len(data)
                    if size >= ARCHIVE_BYTES:
                        out.close()
                        done.append((path, n))
                        out = None
        if out is not None:
            out.close()
            done.append((path, n))
        if done:
            yield pa.record_batch([pa.array([p for p, _ in done]), pa.array([k for _, k in done], type=pa.int64())], names=["path", "records"])

    return materialise(joined.mapInArrow(run, "path string, records long"), narrow=True)


def read_archives(paths: DataFrame) -> DataFrame:
    """What archives hold, a row per response or revisit.

    A response's digest and length are taken from its payload, which must have the
    declared digest. A revisit has no payload: its declared digest and length are
    given, and the record it refers to must be the one that its fields name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "record_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                with shared_file(path, "rb") as stream:
                    for head, _, payload in read_warc(stream):
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        digest, length, to = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"]), None
                        if head["WARC-Type"] == "revisit":
                            to = int(head["X-Refers-To-Page"])
                            if payload or head["WARC-Refers-To"] != record_id(head["WARC-Refers-To-Target-URI"], digest, to):
                                raise ValueError(f"damaged revisit {head['WARC-Record-ID']}")
                        elif (digest, length) != (payload_digest(payload), len(payload)):
                            raise ValueError(f"damaged payload {head['WARC-Record-ID']}")
                        page = head["X-Page-Id"]
                        rows.append((int(page) if page else None, head["WARC-Record-ID"], length, digest, head["WARC-Type"], to))
                        if len(rows) >= 10_000:
                            yield pa.record_batch([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)], names=names)
                            rows = []
                if rows:
                    yield pa.record_batch([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)], names=names)

    n = max(1, min(paths.count(), 4 * partitions(paths.sparkSession)))
    return paths.select("path").repartition(n).mapInArrow(run, "page_id long, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Pages through ARC to WARC archives in the shared folder, and read back: a row per row.

    Equal payloads: the largest page_id is the response; rows that repeat it are
    responses too; rows without page_id revisit it, and are responses if no row of
    that payload has an id. Texts of any length are one record each. Other columns are
    ignored; an empty table gives an empty result.
    """
    return read_archives(write_archives(pages_as_arc(pages), folder or work_dir(pages.sparkSession), least_bytes))
