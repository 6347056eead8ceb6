"""Legacy archives: ARC files of version 1 and 2, their conversion to WARC, and a WARC reader.

An ARC file opens with a ``filedesc:`` record that states the version and names the fields of each record's
header line; every record is one header line, as many bytes as its last field declares, and a line feed. The
parser reads by those declared lengths, never by searching for marks, so a payload may hold anything.
The converter synthesises what WARC adds: record identifiers (name-based, from the file's name and the
record's offset), ISO timestamps, record types, block and payload digests, and revisits of equal payloads.

Files are gzip text files that Spark writes and reads (any file system), parsed as streams: a task holds one
compressed file and one record. Payload bytes are never decoded on the way.

Defined cases: a null or empty URL is written as ``-`` and read back as null, blanks in one are percent-encoded;
null html is an empty payload; a null page_id stays null and revisits nothing; equal rows give equal records; an
empty table gives archives without records; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the two formats.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
PAGE_HEADER = b"X-Page-Id"


def write_arc(pages: DataFrame, path: str, captured: str = "20240101000000", ip: str = "0.0.0.0") -> None:
    """Write pages (page_id, url, html) as ARC files below ``path``, even parts as version 1, odd ones as version 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"part-{part:06d}.arc"
        block = f"{version} 0 emberline\n{FIELDS[version]}\n"
        blank = " 200 - - 0 " + name if version == 2 else ""
        head = f"filedesc://{name} {ip} {captured} text/plain{blank} {len(block)}\n".encode() + block.encode()
        at = len(head) + 1
        yield pa.RecordBatch.from_pydict({"record": pa.array([head], pa.binary())})
        for batch in batches:
            out = []
            for page, url, html in zip(*(batch.column(n).to_pylist() for n in ("page_id", "url", "html"))):
                payload = html or b""
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                http += b"" if page is None else PAGE_HEADER + b": %d\r\n" % page
                content = http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
                url = "".join("%%%02X" % ord(c) if c <= " " else c for c in url or "") or "-"
                fields = f" 200 {hashlib.sha1(payload).hexdigest()} - {at} {name}" if version == 2 else ""
                line = f"{url} {ip} {captured} text/html{fields} {len(content)}\n".encode()
                out.append(line + content)
                at += len(out[-1]) + 1
            yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})

    # one record may be large, and so may ten thousand: the writer takes them one by one as they come
    rows = pages.select("page_id", "url", F.col("html").cast("binary").alias("html"))
    rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value")).write.option(
        "lineSep", "\n"
    ).option("compression", "gzip").text(path)


class _Counted:
    """A gzip stream that knows how many plain bytes it has given out."""

    def __init__(self, content: bytes):
        self.file, self.at = gzip.GzipFile(fileobj=io.BytesIO(content)), 0

    def line(self) -> bytes:
        out = self.file.readline()
        self.at += len(out)
        return out

    def take(self, size: int) -> bytes:
        out = self.file.read(size)
        if len(out) != size:
            raise ValueError(f"{size} bytes declared, {len(out)} found before the archive's end")
        self.at += size
        return out


def _http(content: bytes) -> tuple[bytes, bytes, dict[bytes, bytes]]:
    """(head with its blank line, body, header fields in lower case); content that is no HTTP is all body."""
    if not content.startswith(b"HTTP/"):
        return b"", content, {}
    end = content.find(b"\r\n\r\n")
    head = content[: end + 4] if end >= 0 else content
    fields = dict(line.split(b":", 1) for line in head.split(b"\r\n")[1:] if b":" in line)
    return head, content[len(head) :], {k.strip().lower(): v.strip() for k, v in fields.items()}


def parse_arc(content: bytes) -> Iterator[dict]:
    """The records of one gzip ARC file, its ``filedesc:`` record left out; versions differ in the header line only."""
    stream = _Counted(content)
    names: list[str] = []
    file = ""
    while True:
        offset = stream.at
        line = stream.line()
        if not line:
            return
        if line == b"\n":
            continue
        fields = line.decode("utf-8", "surrogateescape").rstrip("\n").split(" ")
        block = stream.take(int(fields[-1]))
        if fields[0].startswith("filedesc:"):
            version, columns = int(block.split(b" ", 1)[0]), block.split(b"\n")[1].decode()
            if FIELDS.get(version) != columns:
                raise ValueError(f"ARC version {version} with fields {columns!r}")
            names, file = columns.split(" "), fields[0].removeprefix("filedesc://")
            continue
        if len(fields) != len(names):
            raise ValueError(f"{len(fields)} fields in a record, {len(names)} named by the file")
        row = dict(zip(names, fields))
        head, body, http = _http(block)
        page = http.get(PAGE_HEADER.lower())
        yield {
            "page_id": None if page is None else int(page),
            "record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{offset}')}>",
            "url": None if row["URL"] == "-" else row["URL"],
            "ip": row["IP-address"],
            "date": row["Archive-date"],
            "content_type": row["Content-type"],
            "head": head,
            "payload": body,
            "block_digest": base64.b32encode(hashlib.sha1(block).digest()).decode(),
            "head_digest": base64.b32encode(hashlib.sha1(head).digest()).decode(),
            "payload_digest": base64.b32encode(hashlib.sha1(body).digest()).decode(),
        }


ARC_SCHEMA = (
    "page_id bigint, record_id string, url string, ip string, date string, content_type string, head binary,"
    " payload binary, block_digest string, head_digest string, payload_digest string"
)
WARC_SCHEMA = (
    "page_id bigint, record_id string, record_type string, target_uri string, date string, payload_bytes bigint,"
    " payload_digest string, refers_to bigint, refers_to_record string, payload binary"
)
_TYPES = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _parsed(spark: SparkSession, path: str, parser, schema: str, wanted: list[str] | None = None, chunk: int = 8_000_000) -> DataFrame:
    """Rows of ``parser`` over the files below ``path``, in Arrow batches of about ``chunk`` payload bytes."""
    fields = [tuple(x.split()) for x in schema.split(",")]
    fields = [x for x in fields if wanted is None or x[0] in wanted]
    arrow = pa.schema([(name, _TYPES[kind]) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                held, size = [], 0
                for row in parser(content.as_py()):
                    held.append({n: row[n] for n in arrow.names})
                    size += 500 + len(row["payload"] or b"")
                    if size >= chunk:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in fields))


def read_arc(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    return _parsed(spark, path, parse_arc, ARC_SCHEMA, wanted)


def _iso(date: Column) -> Column:
    part = lambda at, size: F.substring(date, at, size)
    return F.concat(part(1, 4), F.lit("-"), part(5, 2), F.lit("-"), part(7, 2), F.lit("T"), part(9, 2), F.lit(":"), part(11, 2), F.lit(":"), part(13, 2), F.lit("Z"))


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 1000) -> None:
    """ARC files to WARC files. Of equal payloads of ``least_bytes`` and more, the largest page_id keeps the payload.

    The keepers are found from digests alone (reduced before the shuffle); their one row per repeated payload is
    then joined to the records, where adaptive execution splits a payload that many records share.
    """
    records = read_arc(spark, arc_path).withColumn("bytes", F.octet_length("payload"))
    large = F.col("bytes") >= least_bytes
    keepers = (
        read_arc(spark, arc_path, ["page_id", "record_id", "payload", "payload_digest"])
        .filter(F.octet_length("payload") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("keeper"), F.max_by("record_id", "page_id").alias("keeper_record"), F.count("*").alias("copies"))
        .filter("copies > 1 and keeper is not null")
        .select(F.col("payload_digest").alias("keeper_digest"), "keeper", "keeper_record")
    )
    joined = records.join(keepers, large & (F.col("payload_digest") == F.col("keeper_digest")), "left")
    revisit = F.coalesce(F.col("page_id") < F.col("keeper"), F.lit(False))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head, payload = F.col("head").cast("string"), F.col("payload").cast("string")
    size = F.octet_length("head") + F.when(revisit, 0).otherwise(F.col("bytes"))
    record = F.concat(
        F.lit("WARC/1.0\r\n"),
        field("WARC-Type", F.when(revisit, "revisit").when(F.octet_length("head") > 0, "response").otherwise("resource")),
        field("WARC-Record-ID", F.col("record_id")),
        field("WARC-Date", _iso(F.col("date"))),
        F.when(F.col("url").isNull(), "").otherwise(field("WARC-Target-URI", F.col("url"))),
        field("WARC-IP-Address", F.col("ip")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        field("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.when(revisit, F.col("head_digest")).otherwise(F.col("block_digest")))),
        F.when(
            revisit,
            F.concat(
                field("WARC-Profile", F.lit(PROFILE)),
                field("WARC-Refers-To", F.col("keeper_record")),
                field("X-Refers-To-Page", F.col("keeper").cast("string")),
            ),
        ).otherwise(""),
        F.when(F.octet_length("head") > 0, field("Content-Type", F.lit("application/http; msgtype=response"))).otherwise(field("Content-Type", F.col("content_type"))),
        field("Content-Length", size.cast("string")),
        F.lit("\r\n"),
        head,
        F.when(revisit, "").otherwise(payload),
    )
    joined.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(warc_path)


def parse_warc(content: bytes) -> Iterator[dict]:
    """The records of one gzip WARC file; digests of whole payloads are checked while reading."""
    stream = _Counted(content)
    while line := stream.line():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {stream.at - len(line)}")
        fields: dict[str, str] = {}
        while (line := stream.line()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "surrogateescape").rstrip("\r\n").partition(":")
            fields[name.strip().lower()] = value.strip()
        head, body, http = _http(stream.take(int(fields["content-length"])))
        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
        whole = fields["warc-type"] != "revisit"
        if whole and hashlib.sha1(body).hexdigest() != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
        page, refers = http.get(PAGE_HEADER.lower()), fields.get("x-refers-to-page")
        yield {
            "page_id": None if page is None else int(page),
            "record_id": fields["warc-record-id"],
            "record_type": fields["warc-type"],
            "target_uri": fields.get("warc-target-uri"),
            "date": fields["warc-date"],
            "payload_bytes": len(body) if whole else int(http[b"content-length"]),
            "payload_digest": digest,
            "refers_to": None if refers is None else int(refers),
            "refers_to_record": fields.get("warc-refers-to"),
            "payload": body if whole else None,
        }


def read_warc(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    return _parsed(spark, path, parse_warc, WARC_SCHEMA, wanted)
