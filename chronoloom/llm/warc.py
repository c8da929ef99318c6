"""Web archive files: written from pages, read back record by record, assembled into captures.

A capture is a request, a response or revisit, and a metadata record. The request and the metadata name the response
or revisit they belong to in WARC-Concurrent-To; assembly joins the records by that identifier, wherever they
lie, and gives one nested row for each capture. Records are compressed one by one, so that files can be cut anywhere between them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize, open_filesystem, publish

FILE_BYTES = 8 << 20
#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_FIELDS = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, "
    "content_type string, payload_digest string, payload_bytes bigint, fields map<string,string>, payload binary, payload_ok boolean"
)
DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*parts: object) -> str:
    """A stable identifier: a task that is run again writes the same bytes."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, '/'.join(map(str, parts)))}>"


def pack_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = b"".join(f"{name}: {value}\r\n".encode("utf-8", "surrogatepass") for name, value in headers)
    whole = VERSION + b"\r\n" + lines + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    return gzip.compress(whole, 5, mtime=0)


def _uri(url: str | None) -> str:
    """A url as a header value: line breaks and percent signs of the raw text are escaped and so survive."""
    return (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _plain(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def capture_records(row: int, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> Iterator[bytes]:
    """Request, response or revisit, and metadata of one page; ``row`` tells rows of one id and payload apart."""
    main = record_id(page_id, digest, row)
    shared = [("WARC-Target-URI", _uri(url)), ("WARC-Date", DATE)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    ask = b"GET / HTTP/1.1\r\nAccept: text/html\r\n\r\n"
    yield pack_record([("WARC-Type", "request"), ("WARC-Record-ID", record_id("request", page_id, digest, row)), ("WARC-Concurrent-To", main), *shared, ("Content-Type", "application/http; msgtype=request")], ask)
    kind, block, more = "response", http + payload, []
    if refers_to is not None:
        kind, block, more = "revisit", http, [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest, 0))]
    yield pack_record([("WARC-Type", kind), ("WARC-Record-ID", main), *more, *shared, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")], block)
    fields = f"pageId: {'' if page_id is None else page_id}\r\nhasUrl: {int(url is not None)}\r\n"
    if refers_to is not None:
        fields += f"refersToPage: {refers_to}\r\n"
    yield pack_record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", page_id, digest, row)), ("WARC-Concurrent-To", main), *shared, ("Content-Type", "application/warc-fields")], fields.encode())


def write_archives(
    pages: DataFrame,
    uri: str,
    *,
    min_bytes: int = 0,
    file_bytes: int = FILE_BYTES,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
) -> None:
    """Write a capture for each row of ``pages`` to gzip archives under ``uri``.

    :param min_bytes: of payloads of at least so many bytes that are equal, the one of the smallest page id is a
        response and the others are revisits of it; smaller payloads are all responses.
    :param file_bytes: a file ends with the capture that reaches this size.

    A null payload is empty. Rows that repeat the page id of a response are responses. A null page id gives a response
    that nothing revisits. An empty table gives no file. Payloads are shuffled once, by row; equal ones meet only
    as digests, so a payload of any number of copies is no burden. Every attempt of a task writes files of its own, in
    whatever order its rows come; the table ``files`` under ``uri``, which Spark commits once for each task, names those that count.
    """
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("sha", F.sha1("body")).withColumn("size", F.octet_length("body"))
    firsts = rows.where(f"size >= {min_bytes} and page_id is not null").groupBy("sha").agg(F.min("page_id").alias("first"))
    small = rows.where(f"size >= {min_bytes} and page_id is not null").select("page_id", "sha").distinct()
    revisits = small.join(firsts, "sha").where("page_id != first").groupBy(F.col("page_id").alias("k"))
    revisits = revisits.agg(F.map_from_entries(F.collect_list(F.struct("sha", "first"))).alias("firsts"))
    # Rows of one page id meet in a task, so that repeated ones can be told apart; the sort makes every attempt write the same.
    planned = rows.withColumn("k", F.coalesce("page_id", F.xxhash64("url", "sha"))).repartition("k").join(revisits, "k", "left")
    first = F.when(F.col("page_id").isNotNull(), F.expr("try_element_at(firsts, sha)"))
    planned = planned.select("k", "page_id", "url", "body", "sha", first.alias("first")).sortWithinPartitions("k", "page_id", "sha", "url").drop("k")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        place, number, held, size, seen = f"{task.partitionId():06d}-{task.taskAttemptId()}", 0, [], 0, {}
        names = []

        def close() -> None:
            nonlocal number, held, size
            names.append(f"{place}-{number:06d}.warc.gz")
            publish(f"{uri}/{names[-1]}", held)
            held, size, number = [], 0, number + 1

        for batch in batches:
            for page_id, url, body, sha, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                row = seen[page_id, digest] = seen.get((page_id, digest), -1) + 1
                if page_id is None:
                    row += task.partitionId() << 32
                for record in capture_records(row, page_id, url, body, digest, first):
                    held.append(record)
                    size += len(record)
                if size >= file_bytes:
                    close()
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["file"])

    planned.mapInArrow(write, "file string").write.parquet(f"{uri}/files")


def _headers(lines: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().decode("utf-8", "replace").lower(), value.strip().decode("utf-8", "surrogatepass"))
    return out


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an uncompressed stream."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        head = []
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            head.append(line)
        headers = _headers(b"".join(head))
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("the archive ends inside a record")
        yield headers, block


def record_row(headers: dict[str, str], block: bytes, keep_payload: bool) -> tuple:
    """The columns of ``RECORD_FIELDS``. Lengths of revisits are those of the payload that was left out."""
    kind, fields, payload, length = headers.get("warc-type", ""), {}, block, len(block)
    digest = headers.get("warc-payload-digest", "").rpartition(":")[2] or None
    fine = None
    if headers.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        fields = _headers(head)
        length = int(fields.get("content-length", len(payload)))
        if kind == "response":
            fine = base32_sha1(payload) == digest and len(payload) == length
            digest = base32_sha1(payload)
    elif headers.get("content-type", "").startswith("application/warc-fields"):
        fields = _headers(block)
    uri = headers.get("warc-target-uri")
    return (headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), None if uri is None else _plain(uri), headers.get("warc-date"), headers.get("content-type"), digest, length, list(fields.items()), payload if keep_payload and kind != "revisit" else None, fine)


def read_records(spark: SparkSession, uri: str, *, keep_payload: bool = True) -> DataFrame:
    """One row of ``RECORD_FIELDS`` for each record of the archives under ``uri``.

    :param keep_payload: false leaves ``payload`` null; lengths, digests and checks are still those of the payload.

    The archives are those that the table ``files`` there names, or all of ``*.warc`` and ``*.warc.gz`` where there is none.
    ``payload_ok`` tells of a response whether its payload has the stated digest and length. A file is read by one task, as a stream.
    """
    types = [f.split()[1] for f in RECORD_FIELDS.split(", ")]
    names = [f.split()[0] for f in RECORD_FIELDS.split(", ")]
    arrow = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string())}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = open_filesystem(uri)
        for name in (n for b in batches for n in b.column(0).to_pylist()):
            with filesystem.open_input_stream(f"{base}/{name}", compression=None) as raw:
                stream = gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else io.BufferedReader(raw)
                held, size = [], 0
                for headers, block in records(stream):
                    held.append(record_row(headers, block, keep_payload))
                    size += len(block)
                    if len(held) == 1000 or keep_payload and size >= FILE_BYTES:
                        yield _batch(held, names, types, arrow)
                        held, size = [], 0
                if held:
                    yield _batch(held, names, types, arrow)

    filesystem, base = open_filesystem(uri)
    if filesystem.get_file_info(f"{base}/files").type.name == "Directory":
        listed = spark.read.schema("file string").parquet(f"{uri}/files")
    else:
        found = filesystem.get_file_info(fs.FileSelector(base, allow_not_found=True))
        listed = spark.createDataFrame([(f.base_name,) for f in found if ".warc" in f.base_name], "file string")
    return listed.repartition(max(1, listed.count()), "file").mapInArrow(run, RECORD_FIELDS)


def _batch(rows: list[tuple], names: list[str], types: list[str], arrow: dict) -> pa.RecordBatch:
    columns = [pa.array(c, arrow[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def assemble(found: DataFrame) -> DataFrame:
    """(capture_id, request, response, metadata, extra): one nested row for each capture of :func:`read_records` rows.

    ``response`` is the response or revisit, ``request`` and ``metadata`` the records concurrent to it, null where there
    are none; of several the one of the smallest record id. ``extra`` counts further records of the capture.
    Records that name a capture without response still make a row. Records without an id are left out.
    """
    body = F.struct(*[c for c in found.columns])
    kinds = F.when(F.col("type").isin("response", "revisit"), F.lit("response")).otherwise(F.col("type"))
    keyed = found.where("record_id is not null").select(F.coalesce("concurrent_to", "record_id").alias("capture_id"), kinds.alias("kind"), "record_id", body.alias("record"))
    pick = lambda kind: F.min_by(F.when(F.col("kind") == kind, F.col("record")), F.when(F.col("kind") == kind, F.col("record_id")))
    held = F.sum(F.col("kind").isin("request", "response", "metadata").cast("int"))
    rows = keyed.groupBy("capture_id").agg(*[pick(k).alias(k) for k in ("request", "response", "metadata")], F.count("*").alias("n"), held.alias("held"))
    there = sum((F.col(k).isNotNull().cast("int") for k in ("request", "response", "metadata")), F.lit(0))
    return rows.select("capture_id", "request", "response", "metadata", (F.col("n") - there).alias("extra"))


def digest_captures(spark: SparkSession, uri: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), one row for each capture of the archives."""
    # Digests and lengths only, written once: the archives are parsed a single time.
    captures = assemble(materialize(read_records(spark, uri, keep_payload=False), "warc-records"))
    field = lambda name: F.expr(f"try_cast(metadata.fields['{name}'] as bigint)")
    return captures.where("response is not null").select(
        field("pageid").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        field("referstopage").alias("refers_to"),
    )
