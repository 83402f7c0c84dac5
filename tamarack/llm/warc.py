"""Operator 2: legacy ARC archives to WARC.

``write_arc`` stores pages as ARC files (version 1 or 2 by partition), ``read_arc`` parses
the version block, the header lines of that version and the declared lengths,
``to_warc`` synthesises identifiers, dates, types and digests and writes WARC 1.1 files,
``read_warc`` parses those. Archives go through Spark's text writer (gzip) and its
``binaryFile`` reader, so any store that Spark reaches will do.

Of records with equal payload digests, that with the largest page id is the response
(repeated rows of that id are all responses); the others are revisits of it. A group of
equal payloads may be any share of the rows: only (digest, largest id) is aggregated, and
records meet it in an equi-join that adaptive execution can split. Records without a page id (a foreign
archive, or a null id) count as smaller than any other and keep a null id.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, workspace

# Fixed values of the formats.
ARC_FIELDS = {
    1: ["url", "ip", "date", "content_type", "length"],
    2: ["url", "ip", "date", "content_type", "status", "checksum", "location", "offset", "filename", "length"],
}
ARC_TITLES = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
CRLF = "\r\n"
MISSING = "-"
PAGE_HEADER = "X-Page-Id"

ARC_SCHEMA = "url string, ip string, date string, content_type string, arc_version int, page_id long, head binary, payload binary, payload_digest string"
WARC_SCHEMA = "page_id long, record_id string, record_type string, target_uri string, date string, payload_bytes long, payload_digest string, refers_to long, refers_to_id string, digest_ok boolean"


def _digest(payload: bytes) -> str:
    return b32encode(hashlib.sha1(payload).digest()).decode()


def _plain_url(url: str | None) -> str:
    """A header line is split at spaces: white space and controls are percent-encoded."""
    return re.sub(r"[\s\x00-\x20\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or MISSING


def write_arc(pages: DataFrame, path: str, date: str = "20240101000000") -> None:
    """One ARC file a partition. The page id travels as a response header, since ARC has no place for one."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version = part % 2 + 1
        about = b"%d 0 tamarack\n%s\n" % (version, ARC_TITLES[version])
        rest = b"" if version == 1 else b" 200 - - 0 -"
        first = b"filedesc://part-%d.arc 0.0.0.0 %s text/plain%s %d\n%s" % (part, date.encode(), rest, len(about), about)
        yield pa.RecordBatch.from_pydict({"value": pa.array([first], pa.binary())})
        for batch in batches:
            out = []
            for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                own = "" if page is None else f"{PAGE_HEADER}: {page}{CRLF}"
                head = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}{own}{CRLF}".encode()
                body = b"" if html is None else html
                out.append(f"{_plain_url(url)} 0.0.0.0 {date} text/html{rest.decode()} {len(head) + len(body)}\n".encode() + head + body)
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})

    rows = pages.select("page_id", "url", F.col("html").cast("binary").alias("html")).mapInArrow(records, "value binary")
    rows.select(F.col("value").cast("string")).write.option("compression", "gzip").text(path)


def parse_arc(stream) -> Iterator[tuple[int, dict, bytes]]:
    """(version, header fields, content) of each record of an ARC file, the version block aside.
    A file that breaks off within a record raises ValueError."""
    line = stream.readline()
    if not line:
        return
    if not line.startswith(b"filedesc://"):
        raise ValueError(f"no ARC version block: {line[:80]!r}")
    block = stream.read(int(line.split(b" ")[-1]))
    version = int(block.split(b" ", 1)[0])
    if version not in ARC_FIELDS:
        raise ValueError(f"unknown ARC version {version}")
    fields = ARC_FIELDS[version]
    while line := stream.readline():
        if not line.strip():
            continue  # the blank line between records
        parts = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(fields) - 1)
        if len(parts) != len(fields):
            raise ValueError(f"ARC header line of version {version} has {len(parts)} fields: {line[:200]!r}")
        header = dict(zip(fields, parts, strict=True))
        content = stream.read(int(header["length"]))
        if len(content) != int(header["length"]):
            raise ValueError(f"ARC record is cut short: {line[:200]!r}")
        yield version, header, content


def _opened(content: bytes):
    return gzip.open(io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def _rows(parse, schema_names, types, most=8 << 20):
    """A mapInArrow function over binaryFile rows; ``parse`` gives tuples and their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                out, held = [], 0
                for row, size in parse(content.as_py()):
                    out.append(row)
                    held += size
                    if held > most or len(out) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=schema_names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=schema_names)

    return run


def _page_id(head: bytes) -> int | None:
    m = re.search(rb"(?mi)^" + PAGE_HEADER.encode() + rb": (-?\d+)\r?$", head)
    return int(m[1]) if m else None


def _arc_rows(content: bytes):
    for version, h, body in parse_arc(_opened(content)):
        head, payload = b"", body
        if body.startswith(b"HTTP/") and (cut := body.find(b"\r\n\r\n")) >= 0:
            head, payload = body[: cut + 4], body[cut + 4 :]
        url = None if h["url"] == MISSING else h["url"]
        yield (url, h["ip"], h["date"], h["content_type"], version, _page_id(head), head, payload, _digest(payload)), len(body)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    types = [pa.string()] * 4 + [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
    names = [c.split()[0] for c in ARC_SCHEMA.split(", ")]
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_rows(_arc_rows, names, types), ARC_SCHEMA)


def _record_id(page, digest, url):
    """A name-based UUID, the same whenever the archive is converted again."""
    h = F.md5(F.concat_ws("|", F.coalesce(page.cast("string"), url, F.lit(MISSING)), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def to_warc(arc: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = 5000) -> None:
    """Write the records of ``read_arc`` as WARC 1.1; payloads of under ``min_bytes`` bytes are never revisits."""
    long_enough = F.octet_length("payload") >= min_bytes
    most = arc.where(long_enough).groupBy("payload_digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("copies"))
    most = most.where("copies > 1").withColumnRenamed("payload_digest", "digest")
    both = arc.join(most, (F.col("payload_digest") == F.col("digest")) & long_enough, "left")
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    digest = F.col("payload_digest")
    content = F.when(revisit, F.col("head")).otherwise(F.concat("head", "payload"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))
    iso = F.regexp_replace("date", r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z")
    only = lambda value: F.when(revisit, value)
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("page_id"), digest, F.col("url"))),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", iso),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("WARC-Profile", only(F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Refers-To", only(_record_id(F.col("response_id"), digest, F.col("url")))),
        line("X-Refers-To-Page-Id", only(F.col("response_id"))),
        line("X-Payload-Length", F.octet_length("payload")),
        line("Content-Type", F.when(F.octet_length("head") > 0, F.lit("application/http; msgtype=response")).otherwise(F.col("content_type"))),
        line("Content-Length", F.octet_length(content)),
        F.lit(CRLF),
    )
    record = F.concat(F.encode(header, "UTF-8"), content)
    both.select(record.cast("string").alias("value")).write.options(compression="gzip", lineSep=CRLF * 2, maxRecordsPerFile=records_per_file).text(path)


def parse_warc(stream) -> Iterator[tuple[dict, bytes]]:
    """(named fields in lower case, content block) of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:80]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        n = int(fields["content-length"])
        content = stream.read(n)
        if len(content) != n:
            raise ValueError(f"WARC record is cut short: {fields.get('warc-record-id')}")
        yield fields, content


def _warc_rows(content: bytes):
    for f, block in parse_warc(_opened(content)):
        head, payload = b"", block
        if f.get("content-type", "").startswith("application/http") and (cut := block.find(b"\r\n\r\n")) >= 0:
            head, payload = block[: cut + 4], block[cut + 4 :]
        kind = f["warc-type"]
        told = f.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind == "revisit":  # the payload is elsewhere: its digest and length are declared
            size, digest, same = int(f["x-payload-length"]), told, True
        else:
            size, digest = len(payload), _digest(payload)
            same = digest == told
        refers = f.get("x-refers-to-page-id")
        yield (_page_id(head), f["warc-record-id"], kind, f.get("warc-target-uri"), f["warc-date"], size, digest, None if refers is None else int(refers), f.get("warc-refers-to"), same), 200


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
    names = [c.split()[0] for c in WARC_SCHEMA.split(", ")]
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_rows(_warc_rows, names, types), WARC_SCHEMA)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, out = workspace(spark, "arc"), workspace(spark, "warc")
    write_arc(read_table(spark, sf_dir, "pages"), arc)
    to_warc(read_arc(spark, arc), out)
    return read_warc(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "digest_ok")
