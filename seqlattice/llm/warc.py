"""WARC archives: written with an index, read back by coalesced byte ranges."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlattice.session import checkpoint_folder, materialize

# Payloads of fewer bytes are always stored in full.
MIN_REVISIT = 100
# An archive file is closed after so many bytes.
FILE_BYTES = 256 << 20
# One read spans records at most GAP bytes apart, up to READ bytes.
GAP = 64 << 10
READ = 8 << 20
# Records of one file are read by tasks of this many bytes.
BLOCK = 32 << 20
SALTS = 64

INDEX = "page_id bigint, file string, offset bigint, length bigint, url string, digest string, record_type string, refers_to bigint, payload_bytes bigint"
RECORD = "page_id bigint, record_type string, refers_to bigint, target_uri string, payload_digest string, payload_bytes bigint, payload binary"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """The store and the path of a URI; a plain path is local."""
    if uri.startswith("file:"):
        uri = uri[5:]
        return fs.LocalFileSystem(), "/" + uri.lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member with a response record, or a revisit record if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if revisit:
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def decode_record(member: bytes) -> dict:
    """The fields of one gzip member; raises if a stored payload does not match its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(h.split(b":")[1]) for h in http.split(b"\r\n") if h.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda name: int(t) if (t := fields[name][len("<urn:page:") : -1]) else None
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"The payload of record {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": number("WARC-Record-ID"),
        "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To") if revisit else None,
        "target_uri": fields.get("WARC-Target-URI"),
        "payload_digest": digest,
        "payload_bytes": size,
        "payload": None if revisit else payload,
    }


def _revisits(rows: DataFrame, salts: int) -> DataFrame:
    """``rows`` (page_id, url, html, digest, size) with ``first``: the smallest page of the same payload, where it is another."""
    salt = F.pmod(F.xxhash64("page_id"), F.lit(salts)).alias("salt")
    sized = rows.filter(F.col("size") >= MIN_REVISIT).select("digest", "page_id", salt)
    partial = sized.groupBy("digest", "salt").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = partial.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n")).filter("n > 1")
    spread = shared.select("digest", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    return rows.withColumn("salt", salt).join(spread, ["digest", "salt"], "left").withColumn(
        "first", F.when((F.col("size") >= MIN_REVISIT) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    )


def write(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", payload: str = "html", salts: int = SALTS) -> DataFrame:
    """Write a record per row to archives in ``folder`` and return the index (``INDEX``), written as a table.

    Of rows with equal payloads of at least ``MIN_REVISIT`` bytes, those with the smallest page id are responses and
    the others revisits of it; all smaller payloads are responses. A null payload is empty; a null id
    never is the smallest and revisits like any other; a null url has no target. Repeated rows get a
    record each. Other columns are not read. Every record is a gzip member of its own.

    A file's name holds a fresh token for each attempt of a task, and the index lists the files of committed attempts
    only, so a lost or repeated task leaves an unlisted file and no wrong entry.
    """
    spark = pages.sparkSession
    folder = folder or f"{checkpoint_folder(spark)}/warc-{uuid.uuid4().hex}"
    text = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), text.alias("html"))
    rows = rows.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html").cast("long")})
    linked = _revisits(rows, salts).select("page_id", "url", "html", "digest", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            entries = []
            for page, address, html, digest, first in zip(*(batch.column(k) for k in range(5))):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                data = html.as_py().encode()
                member = encode_record(page.as_py(), address.as_py(), data, digest.as_py(), first.as_py())
                out.write(member)
                kind = "response" if first.as_py() is None else "revisit"
                entries.append((page.as_py(), f"{folder}/{name}", at, len(member), address.as_py(), digest.as_py(), kind, first.as_py(), len(data)))
                at += len(member)
            if entries:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*entries), _types(INDEX))], _names(INDEX))
        if out is not None:
            out.close()

    return materialize(linked.mapInArrow(run, INDEX))


def read(index: DataFrame) -> DataFrame:
    """The records (``RECORD``) that the rows of ``index`` name; filter the index first to read a selection.

    Entries are sorted by file and offset within blocks of ``BLOCK`` bytes; ranges that follow within ``GAP``
    bytes are fetched by one read of at most ``READ`` bytes or one record. Each record is checked against its digest.
    A revisit has no payload of its own.
    """
    wanted = index.select("file", "offset", "length")
    block = F.floor(F.col("offset") / BLOCK)
    sorted_ranges = wanted.repartition("file", block).sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            span: list[tuple[str, int, int]] = []
            for entry in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if span and (entry[0] != span[0][0] or entry[1] - span[-1][1] - span[-1][2] > GAP or entry[1] + entry[2] - span[0][1] > READ):
                    yield _fetch(span)
                    span = []
                span.append(entry)
            if span:
                yield _fetch(span)

    return sorted_ranges.mapInArrow(run, RECORD)


def _fetch(span: list[tuple[str, int, int]]) -> pa.RecordBatch:
    store, path = _open(span[0][0])
    low, high = span[0][1], span[-1][1] + span[-1][2]
    with store.open_input_file(path) as source:
        source.seek(low)
        data = source.read(high - low)
    found = [decode_record(data[at - low : at - low + n]) for _, at, n in span]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in zip(_names(RECORD), _types(RECORD))], _names(RECORD))


_ARROW = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _types(schema: str) -> list[pa.DataType]:
    return [_ARROW[f.split()[1]] for f in schema.split(", ")]
