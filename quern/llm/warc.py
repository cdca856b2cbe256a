"""WARC archives, and the conversion of legacy ARC archives into them.

An ARC file begins with a version block (``filedesc://``) that names the version and the fields of the header lines that
follow; the length is always the last field. Version 1 has five fields, version 2 ten. The converter reads records by
their declared lengths and synthesises what a WARC record needs and ARC lacks: an identifier (a name-based UUID of
address, date and digest), an ISO timestamp, a type and payload and block digests.

Archives are files in a folder that all executors reach. Each task writes its own file under a temporary name and then
renames it, so a retried or doubled task leaves the same file once. Records are gzip members, as archives usually are.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Folder, drop_path, scratch_path

#: Payloads of at least this many bytes are de-duplicated.
REVISIT_BYTES = 1000
#: Bytes of records after which a task begins another file; a longer record has a file of its own.
FILE_BYTES = 64 << 20
LEVEL = 3
#: Field lines of the two ARC versions (fixed values of the format).
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_CRAWLED = "20240101000000"


def sha1_32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def digest_hex(digest: str) -> str:
    """Lower-case hex of a ``sha1:`` digest in base 32 or hex."""
    value = digest.rpartition(":")[2]
    return base64.b32decode(value).hex() if len(value) == 32 else value.lower()


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, size, content) of each gzip member of a stream, one in memory at a time."""
    z, out, at, begin, rest = zlib.decompressobj(31), [], 0, 0, b""
    while True:
        chunk = rest or stream.read(1 << 20)
        rest = b""
        if not chunk:
            if out or z.unconsumed_tail:
                raise ValueError(f"the archive ends within the record at {begin}")
            return
        out.append(z.decompress(chunk))
        rest = z.unused_data
        at += len(chunk) - len(rest)
        if z.eof:
            yield begin, at - begin, b"".join(out)
            z, out, begin = zlib.decompressobj(31), [], at


def _url_field(url: str | None, page_id: int | None) -> str:
    """The address as one header field: white space and control characters are percent-encoded; none is a urn."""
    if not url or not url.strip():
        return f"urn:page:{page_id if page_id is not None else 'unknown'}"
    return re.sub(r"[\x00-\x20\x7F\x85\xA0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 quern\n{ARC_FIELDS[version]}\n\n".encode()
    middle = " 200 - - 0 " + name if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {_CRAWLED} text/plain{middle} {len(body)}\n".encode() + body


def arc_record(version: int, name: str, offset: int, url: str, http: bytes, payload: bytes, mime: str = "text/html") -> bytes:
    block = http + payload
    middle = f" 200 {hashlib.md5(block).hexdigest()} - {offset} {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {_CRAWLED} {mime}{middle} {len(block)}\n".encode() + block + b"\n"


def http_head(page_id: int | None, length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\nContent-Length: {length}\r\n\r\n".encode()


class ArcReader:
    """Parses the records of one ARC archive; the version block sets the fields of the lines after it."""

    def __init__(self):
        self.fields = ARC_FIELDS[1].split()
        self.version = 1

    def parse(self, record: bytes) -> tuple[dict[str, str], bytes]:
        """Header fields by name, and the block of the declared length."""
        line, _, rest = record.lstrip(b"\r\n").partition(b"\n")
        text = line.rstrip(b"\r").decode("utf-8", "replace")
        if text.startswith("filedesc:"):
            values = text.split(" ")
            block = rest[: int(values[-1])]
            head = block.decode("utf-8", "replace").split("\n")
            self.version = int(head[0].split(" ")[0])
            if len(head) > 1 and head[1].strip():
                self.fields = head[1].split()
            else:
                self.fields = ARC_FIELDS[self.version].split()
            return {"URL": values[0], "Archive-date": values[2], "Content-type": values[3], "Archive-length": values[-1]}, block
        values = text.rsplit(" ", len(self.fields) - 1)  # old writers left spaces in addresses
        if len(values) != len(self.fields):
            raise ValueError(f"an ARC header line of version {self.version} has {len(values)} fields: {text[:200]}")
        head = dict(zip(self.fields, values, strict=True))
        length = int(head["Archive-length"])
        if length > len(rest):
            raise ValueError(f"a record declares {length} bytes and has {len(rest)}: {text[:200]}")
        return head, rest[:length]


def iso_date(date14: str) -> str:
    """WARC timestamp of an ARC date of 14 digits, or of its first 8, 10 or 12."""
    digits = re.sub(r"\D", "", date14)[:14]
    digits += "00000101000000"[len(digits) :]
    return datetime.strptime(digits, "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head and payload; a block that is no HTTP response is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    for mark in (b"\r\n\r\n", b"\n\n"):
        i = block.find(mark)
        if i >= 0:
            return block[: i + len(mark)], block[i + len(mark) :]
    return block, b""


def record_id(kind: str, uri: str, date: str, payload_digest: str | None, source: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {uri} {date} {payload_digest} {source}')}>"


def warc_record(kind: str, uri: str, date: str, mime: str, block: bytes, payload_digest: str | None, more: tuple[tuple[str, str], ...] = ()) -> bytes:
    name = record_id(kind, uri, date, payload_digest, dict(more).get("X-Source", ""))
    head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date)]
    if kind != "warcinfo":
        head.append(("WARC-Target-URI", uri))
    head += [("Content-Type", mime), ("WARC-Block-Digest", sha1_32(block))]
    if payload_digest:
        head.append(("WARC-Payload-Digest", payload_digest))
    head += [*more, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_warc(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:80]}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"a WARC record declares {n} bytes and has {len(rest) - 4}")
    block = rest[:n]
    if fields.get("WARC-Block-Digest", sha1_32(block)) != sha1_32(block):
        raise ValueError(f"the block digest of {fields.get('WARC-Record-ID')} differs")
    return fields, block


def source_of(file: str, offset: int) -> str:
    return f"{file}#{offset}"


def convert(head: dict[str, str], block: bytes, source: str, revisit: dict | None) -> bytes:
    """The WARC record of an ARC record at a place (file and offset). One that revisits another (its page_id, uri, source and
    digest) has the HTTP head alone as its block and names the other's record, address and date."""
    uri, date, mime = head["URL"], iso_date(head["Archive-date"]), head["Content-type"]
    more = (("WARC-IP-Address", head.get("IP-address", "0.0.0.0")), ("X-Source", source))
    if uri.startswith("filedesc:"):
        return warc_record("warcinfo", uri, date, "application/warc-fields", b"software: quern\r\nformat: WARC File Format 1.1\r\n", None)
    http, payload = split_http(block)
    digest = sha1_32(payload)
    if uri.startswith("dns:"):
        return warc_record("resource", uri, date, "text/dns", block, digest, more)
    if not http:
        return warc_record("resource", uri, date, mime, block, digest, more)
    kind = "application/http; msgtype=response"
    if revisit is None:
        return warc_record("response", uri, date, kind, block, digest, more)
    then = iso_date(_CRAWLED)
    more += (
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", record_id("response", revisit["uri"], then, digest, source_of(revisit["file"], revisit["at"]))),
        ("WARC-Refers-To-Target-URI", revisit["uri"]),
        ("WARC-Refers-To-Date", then),
        ("X-Refers-To-Page", str(revisit["page_id"])),
    )
    return warc_record("revisit", uri, date, kind, http, digest, more)


INDEX = "page_id long, file string, at long, digest string, bytes long, uri string"


def write_arc(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes every page as an ARC record, in archives of both versions by turns; rows of the index of what was written.

    A null html is an empty payload. Rows are a plan: they are written whenever it runs, and always to the same files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, part, k = Folder(folder), TaskContext.get().partitionId(), 0
        stream = temporary = name = None
        at = size = 0
        rows: list[tuple] = []
        schema = pa.schema([("page_id", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("digest", pa.string()), ("bytes", pa.int64()), ("uri", pa.string())])

        def close():
            if stream is not None:
                stream.close()
                out.settle(temporary, name)
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                rows.clear()

        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                if stream is None or size and size + len(payload) > file_bytes:
                    yield from close()
                    version, k = 1 + (part + k) % 2, k + 1
                    name = f"{part:06d}-{k:04d}.arc.gz"
                    temporary, stream = out.write(name)
                    head = _member(arc_version_block(version, name))
                    stream.write(head)
                    at, size = len(head), 0
                uri = _url_field(url, page_id)
                record = _member(arc_record(version, name, at, uri, http_head(page_id, len(payload)), payload))
                stream.write(record)
                rows.append((page_id, name, at, hashlib.sha1(payload).hexdigest(), len(payload), uri))
                at, size = at + len(record), size + len(payload)
        yield from close()

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, INDEX)


def revisits(index: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Rows (page_id, file, at, refers_to) of an index: of equal payloads of enough bytes, refers_to is the record (page_id,
    uri, file, at) of the largest page_id, and null for that page's own rows.

    Rows that repeat the largest id are all responses; a null id revisits the largest known one.
    """
    large = F.col("bytes") >= least_bytes
    record = F.max(F.struct("page_id", "uri", "file", "at"))
    first = index.where(large).groupBy("digest").agg(record.alias("__first"), F.count("*").alias("__n")).where("__n > 1 and __first.page_id is not null")
    joined = index.join(first, "digest", "left")
    other = large & F.col("__first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first.page_id"))
    return joined.select("page_id", "file", "at", F.when(other, F.col("__first")).alias("refers_to"))


def convert_archives(decided: DataFrame, arc_folder: str, warc_folder: str, files: int) -> DataFrame:
    """Converts each of the ARC files that decided (file, at, refers_to) names into a WARC file; rows (file).

    The rows are few bytes and the files many, so they are dealt to a task for every other file by number, not by size.
    """

    def run(key, table):
        name = key[0].as_py()
        refers = dict(zip(table["at"].to_pylist(), table["refers_to"].to_pylist(), strict=True))
        out_name = name.replace(".arc.gz", ".warc.gz")
        out, reader = Folder(warc_folder), ArcReader()
        temporary, sink = out.write(out_name)
        with sink, Folder(arc_folder).read(name) as source:
            for at, _, record in members(source):
                sink.write(_member(convert(*reader.parse(record), source_of(name, at), refers.get(at))))
        out.settle(temporary, out_name)
        return pa.table({"file": [out_name]})

    dealt = decided.select("file", "at", "refers_to").repartition(max(1, 2 * files), "file")
    return dealt.groupBy("file").applyInArrow(run, "file string")


RECORDS = T.StructType(
    [T.StructField(n, k) for n, k in (
        ("page_id", T.LongType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("record_type", T.StringType()),
        ("refers_to", T.LongType()), ("target_uri", T.StringType()), ("warc_date", T.StringType()), ("record_id", T.StringType()),
    )]
)


def read_warc(files: DataFrame, folder: str) -> DataFrame:
    """A row per response or revisit record of the archives that files (file) names; digests are checked while reading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Folder(folder)
        names = [f.name for f in RECORDS.fields]

        def flush(rows):
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with own.read(name) as source:
                    for _, _, record in members(source):
                        fields, block = parse_warc(record)
                        if fields["WARC-Type"] not in ("response", "revisit"):
                            continue
                        http, payload = split_http(block)
                        said = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:] if ": " in x)
                        digest, length = fields["WARC-Payload-Digest"], int(said["Content-Length"])
                        if fields["WARC-Type"] == "response" and (sha1_32(payload) != digest or len(payload) != length):
                            raise ValueError(f"the payload of {fields['WARC-Record-ID']} differs from its digest or length")
                        page, refers = said.get("X-Page-Id", "").strip(), fields.get("X-Refers-To-Page")
                        rows.append((int(page) if page else None, length, digest_hex(digest), fields["WARC-Type"], int(refers) if refers else None, fields["WARC-Target-URI"], fields["WARC-Date"], fields["WARC-Record-ID"]))
                        if len(rows) >= 5000:
                            yield flush(rows)
                            rows = []
                yield flush(rows)

    return files.select("file").mapInArrow(run, RECORDS)


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Writes pages (page_id, url, html) as ARC archives, converts them to WARC, and reads these: (records, WARC folder).

    Pages are never shuffled: only the index is, and each archive is converted by the task that gets its index rows. A
    payload of any length is one record, held by one task at a time. Repeated rows are separate records; an empty table
    gives no archive and no record; other columns are not read. The ARC archives and the index are dropped; the WARC
    archives are the result and stay, with the list of their names.
    """
    base = folder or scratch_path(spark, "warc")
    arc, warc = f"{base}/arc", f"{base}/warc"
    write_arc(pages, arc).write.parquet(f"{base}/index")
    index = spark.read.parquet(f"{base}/index")
    n = index.select("file").distinct().count()
    convert_archives(revisits(index), arc, warc, n).write.parquet(f"{base}/files")
    drop_path(spark, arc)
    drop_path(spark, f"{base}/index")
    return read_warc(spark.read.parquet(f"{base}/files").repartition(max(1, n), "file"), warc), warc
