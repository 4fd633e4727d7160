"""Legacy ARC archives, their conversion to WARC, and reading WARC back.

An ARC file begins with a version block whose lines give the version and name the fields of all later header lines: five in version 1, ten in version 2. The
last field is the declared length of the record's body. The converter reads header lines by the names that the file itself declares and synthesises
what WARC asks for: a record id (from the archive's name, the record's place and its header line, so a task that runs again gives the same),
an ISO timestamp, a type, and a SHA-256 digest of the payload. Records of both kinds are gzip members of their own.

Payloads never leave the archives: deduplication works on digests, and each conversion task reads its ARC files itself.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codehist.llm.tables import new_folder, staged, table
from codehist.llm.token_files import put

#: Fixed values of the formats: names of the fields in the version block, by version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this size are always stored.
LEAST_REVISIT = 100
#: Payload bytes per archive before the next one begins.
FILE_BYTES = 16 << 20
NO_DATE = "19700101000000"


def arc_version_block(name: str, version: int, date: str = NO_DATE) -> bytes:
    body = f"{version} 0 codehist\n{ARC_FIELDS[version]}\n".encode()
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Archive-length": str(len(body))}
    return arc_header(values, version) + body + b"\n"


def arc_header(values: dict[str, str], version: int) -> bytes:
    return (" ".join(values.get(f) or "-" for f in ARC_FIELDS[version].split()) + "\n").encode()


def arc_record(url: str | None, page_id: int | None, payload: bytes, version: int, name: str, at: int, date: str = NO_DATE) -> bytes:
    """A captured page as an ARC record; the page's id is an HTTP header of its own, absent for a null id."""
    head = "HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    head += f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    body = f"{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    values = {
        "URL": quote(url or "about:blank", safe="!#$%&'()*+,/:;=?@[]~"), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html",
        "Result-code": "200", "Offset": str(at), "Filename": name, "Archive-length": str(len(body)),
    }
    return arc_header(values, version) + body + b"\n"


#: Bytes that are inflated at once; what lies behind a member is copied for each, so this is to be small.
SLICE = 1 << 14


def members(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of each gzip member; an archive that is not compressed is one member."""
    if content[:2] != b"\x1f\x8b":
        yield 0, content
        return
    at, view = 0, memoryview(content)
    while at < len(content):
        inflate, data, read = zlib.decompressobj(31), [], at
        while not inflate.eof:
            part = view[read : read + SLICE]
            if not len(part):
                raise ValueError(f"member at {at} is cut short")
            data.append(inflate.decompress(part))
            read += len(part)
        yield at, b"".join(data)
        at = read - len(inflate.unused_data)


def read_arc(content: bytes) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """Place, header values and body of each record after the version block. A body shorter than declared is an error."""
    fields: list[str] = []
    for member_at, data in members(content):
        at = 0
        while at < len(data):
            if data[at : at + 1] in (b"\n", b"\r"):
                at += 1
                continue
            stop = data.index(b"\n", at)
            line = data[at:stop].decode("utf-8", "replace").rstrip("\r")
            parts = line.split(" ")
            length = int(parts[-1])
            body = data[stop + 1 : stop + 1 + length]
            if len(body) != length:
                raise ValueError(f"record at {member_at}+{at}: {length} bytes declared, {len(body)} there")
            if line.startswith("filedesc:"):
                fields = body.decode("utf-8", "replace").split("\n")[1].split()
            else:
                if len(parts) != len(fields):
                    raise ValueError(f"record at {member_at}+{at}: {len(parts)} values for {len(fields)} fields")
                yield f"{member_at}+{at}", dict(zip(fields, parts, strict=True)), body
            at = stop + 1 + length


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head, with its empty line, and payload; a body that is no HTTP response is all payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    stop = body.find(b"\r\n\r\n")
    return (body[: stop + 4], body[stop + 4 :]) if stop >= 0 else (body, b"")


def http_number(head: bytes, name: bytes) -> int | None:
    found = re.search(rb"(?im)^" + name + rb":\s*(-?\d+)\s*$", head)
    return int(found[1]) if found else None


def record_id(archive: str, at: str, values: dict[str, str]) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join([archive, at, *values.values()]))}>"


def warc_date(arc_date: str) -> str:
    """ISO time of a 14-digit date; parts that are missing are taken as the first, as in a date of fewer digits."""
    d = (arc_date + NO_DATE[len(arc_date) :])[:14] if arc_date.isdigit() else NO_DATE
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def as_warc(archive: str, at: str, values: dict[str, str], body: bytes, digest: str, refers_to: str | None) -> bytes:
    """The WARC record of an ARC record. A revisit keeps the HTTP head, whose Content-Length tells the size of the payload it leaves out."""
    head, _ = split_http(body)
    headers = {
        "WARC-Record-ID": record_id(archive, at, values), "WARC-Date": warc_date(values["Archive-date"]), "WARC-Target-URI": values["URL"],
        "WARC-IP-Address": values["IP-address"], "WARC-Payload-Digest": f"sha256:{digest}",
    }
    if not head:
        return warc_record("resource", headers | {"Content-Type": values["Content-type"]}, body)
    headers["Content-Type"] = "application/http; msgtype=response"
    if refers_to is None:
        return warc_record("response", headers, body)
    return warc_record("revisit", headers | {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": refers_to}, head)


def read_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record."""
    for _, data in members(content):
        at = 0
        while at < len(data):
            stop = data.index(b"\r\n\r\n", at)
            version, *lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError(f"no WARC record at {at}")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            length = int(headers["content-length"])
            yield headers, data[stop + 4 : stop + 4 + length]
            at = stop + 4 + length + 4


def fetch(folder: str, name: str) -> bytes:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{path}/{name}", compression=None) as f:
        return f.read()


def write_arc_files(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages as ARC archives, those of even tasks in version 1 and of odd ones in version 2; one row per archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        version = 1 + part % 2
        held: list[bytes] = []
        size = done = records = 0

        def name() -> str:
            return f"part-{part:06d}-{k:06d}.arc.gz"

        def flush() -> pa.RecordBatch:
            put(folder, name(), b"".join(held))
            return pa.RecordBatch.from_arrays([pa.array([name()]), pa.array([records], pa.int64())], names=["file", "records"])

        for batch in batches:
            for url, page_id, html in zip(*(batch.column(c) for c in ("url", "page_id", "html")), strict=True):
                if not held:
                    held.append(gzip.compress(arc_version_block(name(), version), 1, mtime=0))
                    done = len(held[0])
                payload = (html.as_py() or "").encode("utf-8", "replace")
                record = gzip.compress(arc_record(url.as_py(), page_id.as_py(), payload, version, name(), done), 1, mtime=0)
                held.append(record)
                done, size, records = done + len(record), size + len(payload), records + 1
                if size >= file_bytes:
                    yield flush()
                    held, size, records, k = [], 0, 0, k + 1
        if held:
            yield flush()

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "file string, records long")


def scan_arc(files: DataFrame, folder: str) -> DataFrame:
    """Each record of the archives named in ``files``: its place, page, record id, and the digest and size of its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows = []
                for k, (at, values, body) in enumerate(read_arc(fetch(folder, file))):
                    head, payload = split_http(body)
                    rows.append((file, k, http_number(head, b"X-Page-Id"), record_id(file, at, values), hashlib.sha256(payload).hexdigest(), len(payload)))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "k", "page_id", "record", "digest", "bytes"])

    return files.select("file").mapInArrow(run, "file string, k long, page_id long, record string, digest string, bytes long")


def with_originals(records: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``refers_to``: null for the record that is stored, else its record id. Of equal payloads that of the smallest page_id is stored, a null one last; pages
    that share an id are told apart by their place."""
    order = F.struct(F.col("page_id").isNull(), "page_id", "file", "k", "record")
    first = records.where(F.col("bytes") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1")
    joined = records.join(first.select("digest", F.col("first.record").alias("stored")), "digest", "left")
    return joined.withColumn("refers_to", F.when((F.col("bytes") >= least) & (F.col("stored") != F.col("record")), F.col("stored")))


def by_file(rows: DataFrame) -> DataFrame:
    """Dealt by archive to a set number of tasks: what a task reads is the archive, so few and small rows must not be put together in one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")


def convert_arc_files(decided: DataFrame, arc_folder: str, warc_folder: str) -> DataFrame:
    """Write one WARC archive for each ARC archive. The records of one archive are few (``FILE_BYTES``), so they may meet in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, rows in zip(batch.column("file").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                by_place = {r["k"]: r for r in rows}
                name = re.sub(r"\.arc(\.gz)?$", ".warc.gz", file)
                info = warc_record("warcinfo", {"WARC-Record-ID": record_id(file, "info", {}), "WARC-Filename": name, "Content-Type": "application/warc-fields"}, b"conversion: arc\r\n")
                out = [gzip.compress(info, 1, mtime=0)]
                for k, (at, values, body) in enumerate(read_arc(fetch(arc_folder, file))):
                    out.append(gzip.compress(as_warc(file, at, values, body, by_place[k]["digest"], by_place[k]["refers_to"]), 1, mtime=0))
                put(warc_folder, name, b"".join(out))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(rows)], pa.int64())], names=["file", "records"])

    return by_file(decided).groupBy("file").agg(F.collect_list(F.struct("k", "digest", "refers_to")).alias("rows")).mapInArrow(run, "file string, records long")


def read_warc_files(spark: SparkSession, folder: str) -> DataFrame:
    """record, page_id, payload_bytes, payload_digest, record_type and refers_to (a record id) of all captures. A stored payload must have its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for headers, block in read_warc(content.as_py()):
                    if headers["warc-type"] == "warcinfo":
                        continue
                    head, payload = split_http(block)
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    size = http_number(head, b"Content-Length") if headers["warc-type"] == "revisit" else len(payload)
                    if headers["warc-type"] != "revisit" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{headers['warc-record-id']}: payload differs from its digest")
                    rows.append((headers["warc-record-id"], http_number(head, b"X-Page-Id"), size, digest, headers["warc-type"], headers.get("warc-refers-to")))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                if rows:
                    names = ["record", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")
    return files.mapInArrow(run, "record string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to string")


def pages_to_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Pages as ARC archives, those converted to WARC archives, below ``folder``; one row per WARC archive. No pages, no archives.

    Null html is an empty payload, a null url becomes about:blank, a null page_id is kept as null.
    """
    arcs = staged(write_arc_files(pages, f"{folder}/arc"))
    records = scan_arc(by_file(arcs), f"{folder}/arc")
    return staged(convert_arc_files(with_originals(staged(records)), f"{folder}/arc", f"{folder}/warc"))


def op7_arc_to_warc(spark, sf_dir) -> DataFrame:
    folder = new_folder(spark, "archives")
    written = pages_to_warc(table(spark, sf_dir, "pages"), folder)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    if written.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    records = staged(read_warc_files(spark, f"{folder}/warc"))
    stored = records.join(records.where("refers_to is not null").select(F.col("refers_to").alias("record")).distinct(), "record", "left_semi")
    ids = stored.select(F.col("record").alias("refers_to"), F.col("page_id").alias("original"))
    return records.join(ids, "refers_to", "left").select(*columns, F.col("original").alias("refers_to"))


OP7_SQL = """
with p as (select row_number() over (order by page_id) as r, page_id, coalesce(html, '') as t from pages),
d as (select *, cast(strlen(t) as bigint) as payload_bytes, sha256(t) as payload_digest from p),
f as (select *, first_value(page_id) over w as original, row_number() over w as place from d
      window w as (partition by payload_digest order by page_id nulls last, r))
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and place > 1 then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and place > 1 then original end as refers_to from f
"""
