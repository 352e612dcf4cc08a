"""ARC to WARC: parse legacy archives record by record and write equivalent WARC files.

An ARC file is a sequence of records, plain or in gzip members of one or more records each (a
member is held in memory whole).  The first holds the version block, whose header
line names the format version and whose last line names the fields of every record's header
line: version 1 has five fields, version 2 ten, and both end with the declared length of
what follows.  The converter trusts only that length, never the content, raises where anything
but newlines stands between records, and writes

* a ``warcinfo`` record for the version block,
* a ``response`` record for an HTTP response (``resource`` for anything else), or
* a ``revisit`` record, without payload, where an equal payload of at least
  ``min_revisit`` bytes has an earlier response,

with a name-based record id, the 14-digit ARC date as WARC-Date, and SHA-256 block and
payload digests.  ``write_arc`` makes such legacy archives from a table of pages, in either
version, so that a round trip covers every step.

Null html is an empty payload, null urls and ids are written as empty values, equal ids keep
a record each, an empty table writes no archive and other columns are ignored.  Files are
written under a temporary name and renamed, so a repeated task replaces its own file.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from functools import partial
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import scratch, stage, table
from .queries import register

# Header field names of the two ARC versions.
ARC_V1 = "URL IP-address Archive-date Content-type Archive-length"
ARC_V2 = ("URL IP-address Archive-date Content-type Result-code Checksum Location Offset "
          "Filename Archive-length")
ARC_FIELDS = {b"1": ARC_V1.split(), b"2": ARC_V2.split()}
GZIP = b"\x1f\x8b"
FILE_BYTES = 256 << 20  # an archive is closed once it is this large


# --- files ---------------------------------------------------------------------------------

class Archive:
    """A file of gzip members in any store pyarrow knows, visible only once complete."""

    def __init__(self, folder: str, name: str):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.path = f"{folder}/{name}"
        self.final, self.temp = f"{root}/{name}", f"{root}/.{name}-{uuid.uuid4().hex}"
        self.out, self.size = self.fs.open_output_stream(self.temp, compression=None), 0

    def member(self, data: bytes) -> tuple[int, int]:
        packed = gzip.compress(data, compresslevel=1, mtime=0)
        at, self.size = self.size, self.size + len(packed)
        self.out.write(packed)
        return at, len(packed)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.final)


class Members:
    """Reads records of archives; keeps the last file open and its last member's data."""

    def __init__(self):
        self.path, self.file, self.at, self.data = None, None, None, b""

    def read(self, path: str, at: int, length: int, inner: int, size: int) -> bytes:
        if path != self.path:
            fs, name = pafs.FileSystem.from_uri(path)
            self.path, self.file, self.at = path, fs.open_input_file(name), None
        if at != self.at:
            self.file.seek(at)
            data = self.file.read(length)
            self.at, self.data = at, gzip.decompress(data) if data[:2] == GZIP else data
        return self.data[inner:inner + size]


def each_member(path: str, chunk: int = 1 << 20):
    """(offset, compressed length, data) of every gzip member, front to back."""
    fs, inner = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(inner) as f:
        start = done = 0
        unzip, out, rest = zlib.decompressobj(31), [], b""
        while True:
            data = rest or f.read(chunk)
            if not data:
                if out or done > start:
                    raise ValueError(f"{path}: the member at {start} is cut off")
                return
            out.append(unzip.decompress(data))
            rest = unzip.unused_data
            done += len(data) - len(rest)
            if unzip.eof:
                yield start, done - start, b"".join(out)
                start, unzip, out = done, zlib.decompressobj(31), []


def record_length(line: bytes) -> int:
    last = line.rstrip(b"\r").rpartition(b" ")[2]
    if not last.isdigit():
        raise ValueError(f"no record header: {line[:80]!r}")
    return int(last)


def record_spans(data: bytes):
    """(offset, size) of the records in a member, by their declared lengths."""
    at = 0
    while True:
        while data[at:at + 1] == b"\n":
            at += 1
        if at == len(data):
            return
        end = data.find(b"\n", at)
        length = record_length(data[at:end if end >= 0 else len(data)])
        stop = end + 1 + length
        if end < 0 or stop > len(data):
            raise ValueError(f"declared length {length}, found {len(data) - end - 1 if end >= 0 else 0}")
        yield at, stop - at
        at = stop


def each_record(path: str, chunk: int = 1 << 16):
    """(offset and length in the file, offset and size in the member, data) of every record."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        plain = f.read(2) != GZIP
        at, size = 0, f.size()
        while plain and at < size:
            f.seek(at)
            head = f.read(chunk)
            blank = len(head) - len(head.lstrip(b"\n"))
            if blank:
                at += blank
                continue
            while b"\n" not in head:
                more = f.read(chunk)
                if not more:
                    raise ValueError(f"{path}: no record header at {at}")
                head += more
            line = head.partition(b"\n")[0]
            length = len(line) + 1 + record_length(line)
            f.seek(at)
            data = f.read(length)
            if len(data) != length:
                raise ValueError(f"{path}: declared length {length - len(line) - 1}, found {len(data) - len(line) - 1}")
            yield at, length, 0, length, data
            at += length
    if not plain:
        for at, length, data in each_member(path):
            for inner, n in record_spans(data):
                yield at, length, inner, n, data[inner:inner + n]


# --- ARC -----------------------------------------------------------------------------------

def version_block(name: str, version: int) -> bytes:
    body = f"{version} 0 archive-writer\n{ARC_V1 if version == 1 else ARC_V2}\n".encode()
    extra = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 19960101000000 text/plain {extra}{len(body)}\n".encode() + body + b"\n"


def arc_record(page_id, url: str | None, payload: bytes, version: int, name: str, offset: int) -> bytes:
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
            f"X-Page-Id: {'' if page_id is None else page_id}\r\n\r\n").encode() + payload
    # a header line is split at blanks, so no field may hold one
    url = quote(url or "-", safe="!#$%&'()*+,/:;=?@[]~")
    extra = "" if version == 1 else f"200 {hashlib.md5(http).hexdigest()} - {offset} {name} "
    return f"{url} 0.0.0.0 20000101000000 text/html {extra}{len(http)}\n".encode() + http + b"\n"


def write_arc(batches, folder: str):
    """One archive per task (more if large); a manifest row per archive.  Even tasks write
    version 1, odd ones version 2."""
    part = TaskContext.get().partitionId()
    version, n, arc = 1 + part % 2, 0, None
    for batch in batches:
        for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
            if arc is None:
                name = f"{part:06d}-{n:04d}.arc.gz"
                arc = Archive(folder, name)
                arc.member(version_block(name, version))
            arc.member(arc_record(page_id, url, (html or "").encode(), version, name, arc.size))
            if arc.size >= FILE_BYTES:
                arc.close()
                yield manifest([arc.path])
                arc, n = None, n + 1
    if arc is not None:
        arc.close()
        yield manifest([arc.path])


def manifest(paths: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])


def parse_arc(data: bytes, fields: list[str] | None):
    """(header dict, content, fields): ``fields`` is None for the version block, which
    brings the fields of the records after it."""
    line, _, rest = data.partition(b"\n")
    parts = line.rstrip(b"\r").decode("ascii", "replace").split(" ")
    length = int(parts[-1])
    content = rest[:length]
    if len(content) != length:
        raise ValueError(f"declared length {length}, found {len(content)}")
    if fields is None:
        first, names = content.split(b"\n")[:2]
        fields = ARC_FIELDS.get(first[:1]) or names.decode().split(" ")
        head = dict(zip(ARC_V1.split(), [*parts[:4], parts[-1]]))
    else:
        if len(parts) != len(fields):
            raise ValueError(f"header line has {len(parts)} fields, not {len(fields)}")
        head = dict(zip(fields, parts))
    return head, content, fields


def http_parts(content: bytes) -> tuple[bytes, bytes] | None:
    """Header block (with its empty line) and payload of an HTTP response, else None."""
    head, blank, payload = content.partition(b"\r\n\r\n")
    return (head + blank, payload) if blank and head.startswith(b"HTTP/") else None


def page_id_of(http_head: bytes) -> int | None:
    found = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", http_head)
    return int(found[1]) if found else None


INDEX = ("path string, at long, length long, inner long, size long, fields string, page_id long, payload_bytes long, "
         "payload_digest string")


def index_arc(batches):
    """A row per record of the archives named: where it is and what its payload is."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows, fields = [], None
            for at, length, inner, size, data in each_record(path):
                new = fields is None
                _, content, fields = parse_arc(data, fields)
                http = None if new else http_parts(content)
                payload = http[1] if http else content
                rows.append((path, at, length, inner, size, None if new else " ".join(fields),
                             page_id_of(http[0]) if http else None, len(payload),
                             hashlib.sha256(payload).hexdigest()))
                if len(rows) == 10_000:
                    yield index_batch(rows)
                    rows = []
            yield index_batch(rows)


def index_batch(rows) -> pa.RecordBatch:
    names = [f.split()[0] for f in INDEX.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * 4, pa.string(), pa.int64(), pa.int64(), pa.string()]
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)


# --- WARC ----------------------------------------------------------------------------------

def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def warc_date(arc_date: str) -> str:
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def convert(data: bytes, row: dict) -> bytes:
    """The WARC record of one ARC record; ``row`` is its index row with first_id."""
    fields = row["fields"].split(" ") if row["fields"] else None
    head, content, _ = parse_arc(data, fields)
    digest, page = row["payload_digest"], row["page_id"]
    headers = [("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", warc_date(head["Archive-date"]))]
    if fields is None:
        return warc_record([("WARC-Type", "warcinfo"), *headers,
                            ("Content-Type", "application/arc"), ("WARC-Filename", head["URL"][11:])], content)
    http = http_parts(content)
    headers += [("WARC-Target-URI", head["URL"]), ("WARC-IP-Address", head["IP-address"]),
                ("WARC-Payload-Digest", f"sha256:{digest}")]
    if http and row["first_id"] is not None and row["first_id"] != page:
        block = http[0]
        headers = [("WARC-Type", "revisit"), *headers,
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", record_id(row["first_id"], digest)),
                   ("X-Refers-To-Page-Id", str(row["first_id"]))]
    else:
        block = content
        headers = [("WARC-Type", "response" if http else "resource"), *headers]
    return warc_record([*headers, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
                        ("Content-Type", "application/http;msgtype=response" if http else head["Content-type"])],
                       block)


def write_warc(batches, folder: str):
    """Convert index rows, which come sorted by (path, at); one WARC per ARC."""
    source, warc = Members(), None
    for batch in batches:
        for row in batch.to_pylist():
            name = row["path"].rpartition("/")[2]
            name = name.replace(".arc.gz", ".warc.gz") if name.endswith(".arc.gz") else f"{name}.warc.gz"
            if warc is None or warc.path != f"{folder}/{name}":
                if warc is not None:
                    warc.close()
                    yield manifest([warc.path])
                warc = Archive(folder, name)
            warc.member(convert(source.read(*(row[c] for c in ("path", "at", "length", "inner", "size"))), row))
    if warc is not None:
        warc.close()
        yield manifest([warc.path])


def arc_to_warc(arcs: DataFrame, min_revisit: int = 100) -> DataFrame:
    """Convert the archives named in ``arcs`` (path); returns the WARC files (path)."""
    spark = arcs.sparkSession
    n = max(1, arcs.count())
    index = stage(arcs.repartition(n, "path").mapInArrow(index_arc, INDEX), "arc-index")
    # of equal payloads the smallest page id is the response; only groups of two or more matter
    shared = F.col("fields").isNotNull() & (F.col("payload_bytes") >= min_revisit)
    first = stage(index.filter(shared).groupBy("payload_digest")
                  .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
                  .filter("n > 1").drop("n")
                  .withColumn("revisitable", F.lit(True)), "arc-first")
    rows = index.withColumn("revisitable", shared).join(first, ["payload_digest", "revisitable"], "left")
    rows = rows.select("path", "at", "length", "inner", "size", "fields", "page_id", "payload_digest", "first_id")
    files = rows.repartition(n, "path").sortWithinPartitions("path", "at", "inner")
    return stage(files.mapInArrow(partial(write_warc, folder=scratch(spark, "warc")), "path string"), "warcs")


RECORDS = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long, url string, record_id string")


def read_warc(batches):
    """A row per response or revisit record, its digest checked against the payload."""
    names = [f.split()[0] for f in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows = []
            for _, _, data in each_member(path):
                head, _, rest = data.partition(b"\r\n\r\n")
                fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                block = rest[:int(fields["Content-Length"])]
                kind = fields["WARC-Type"]
                if kind not in ("response", "revisit"):
                    continue
                http, payload = http_parts(block)
                digest = fields["WARC-Payload-Digest"].partition(":")[2]
                if kind == "response":
                    size = len(payload)
                    if hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{path}: {fields['WARC-Record-ID']} has another payload")
                else:
                    size = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", http)[1])
                refers = fields.get("X-Refers-To-Page-Id")
                rows.append((page_id_of(http), size, digest, kind, int(refers) if refers else None,
                             fields["WARC-Target-URI"], fields["WARC-Record-ID"]))
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)


def read_warcs(warcs: DataFrame) -> DataFrame:
    return warcs.repartition(max(1, warcs.count()), "path").mapInArrow(read_warc, RECORDS)


def write_arcs(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html") -> DataFrame:
    """Legacy archives of a table of pages; returns their paths."""
    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col))
    return stage(rows.mapInArrow(partial(write_arc, folder=scratch(pages.sparkSession, "arc")),
                                 "path string"), "arcs")


@register("op1_arc_to_warc", """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f""")
def op1(spark, sf_dir):
    return read_warcs(arc_to_warc(write_arcs(table(spark, sf_dir, "pages")))).drop("url", "record_id")
