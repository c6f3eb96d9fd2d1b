"""WARC archives: writing, and a normaliser of monolithic gzip files.

Archives are written as whole-file gzip streams (one member per file), as many crawlers leave them.
The normaliser inflates each stream once, writes every record again as a gzip member of its own, and
writes a sidecar index (offset, length, type, id and target of each record), by which records are
then read one at a time. Files go to the shared folder, under new names for each try of a task; only
the names that successful tasks return are read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from txnclean.llm.shared import new_path, table, written

#: A payload of fewer bytes is never a revisit.
LEAST_REVISIT = 100
#: An archive is closed after so many bytes of records.
ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 20
# fixed values of the format
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI as Spark writes it."""
    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _clean(value: str) -> str:
    """A header's value: control characters as %XX."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit of the page refers_to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
            ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        head.append(("WARC-Target-URI", _clean(url)))
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    head.append(("Content-Length", str(len(block))))
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in head), b"", block, b"", b""])


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in chunks."""
    z = zlib.decompressobj(31)
    while chunk := source.read(CHUNK):
        while chunk:
            data = z.decompress(chunk, CHUNK)
            if data:
                yield data
            if z.eof:
                chunk, z = z.unused_data, zlib.decompressobj(31)
            else:
                chunk = z.unconsumed_tail
    if data := z.flush():
        yield data


def headers_of(head: bytes) -> dict[str, str]:
    """Lower-case names and values of a record's or message's header lines."""
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
    return out


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of a stream; memory holds one record and a chunk."""
    buf = bytearray()

    def more() -> bool:
        data = next(chunks, None)
        if data is None:
            return False
        buf.extend(data)
        return True

    while True:
        while (end := buf.find(b"\r\n\r\n")) < 0:
            if not more():
                if buf.strip():
                    raise ValueError("the archive ends inside a record's header")
                return
        head = headers_of(bytes(buf[:end]))
        size = end + 4 + int(head["content-length"]) + 4
        while len(buf) < size:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield head, bytes(buf[:size])
        del buf[:size]


def _writer(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, z, name, size, n = None, None, None, 0, 0

        def close():
            out.write(z.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["path", "records"])

        for b in batches:
            cols = [b.column(i) for i in range(5)]
            for i in range(b.num_rows):
                page, url, html, digest, refers = (c[i].as_py() for c in cols)
                if out is None:
                    name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    system, path = _open(name)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out, z, size, n = system.open_output_stream(path, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                data = record(page, url, (html or "").encode(), digest, refers, date)
                out.write(z.compress(data))
                size, n = size + len(data), n + 1
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()
    return run


def write_archives(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(path, records) of monolithic archives with a record per row of page_id, url, html.

    Of rows with equal payloads of LEAST_REVISIT bytes or more those with the smallest page_id are
    responses and the others revisit it; all shorter ones are responses. A null html is an empty
    payload. A row without a page_id revisits if a row with one has its payload. A null url has no
    target header. Repeated rows each get a record. Other columns are ignored.
    """
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                       F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    small = src.where(F.octet_length("html") >= LEAST_REVISIT).select("page_id", "digest")
    first = small.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    later = (small.join(first, "digest").where("page_id is null or page_id > refers_to")
             .select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to").distinct())
    # rows meet by page, so that a payload that very many pages share is dealt out
    rows = src.join(later, src.page_id.eqNullSafe(later.p) & (src.digest == later.d), "left")
    folder = new_path(pages.sparkSession, "warc")
    return written(rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_writer(folder, date), "path string, records long"), "archives")


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name in b.column(0).to_pylist():
            new = f"{name.rpartition('/')[0]}/members-{uuid.uuid4().hex}.warc.gz"
            (source, path), (system, target) = _open(name), _open(new)
            lines, at = [], 0
            with source.open_input_stream(path, compression=None) as src, system.open_output_stream(target, compression=None) as out:
                for head, data in records(inflated(src)):
                    z = zlib.compressobj(4, zlib.DEFLATED, 31)
                    member = z.compress(data) + z.flush()
                    out.write(member)
                    lines.append(json.dumps({"offset": at, "length": len(member), "type": head["warc-type"], "id": head["warc-record-id"],
                                             "target": head.get("warc-target-uri")}))
                    at += len(member)
            with system.open_output_stream(f"{target}.index", compression=None) as out:
                out.write("".join(f"{x}\n" for x in lines).encode())
            yield pa.RecordBatch.from_arrays([pa.array([new]), pa.array([f"{new}.index"]), pa.array([len(lines)], pa.int64())], names=["path", "index", "records"])


def normalise_archives(archives: DataFrame) -> DataFrame:
    """(path, index, records): each monolithic gzip file (column path) as one member a record, with its index."""
    n = max(1, archives.count())
    return written(archives.select("path").repartition(n).mapInArrow(_normalise, "path string, index string, records long"), "members")


def _page(text: str | None) -> int | None:
    number = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "archive", "offset", "length"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    for b in batches:
        for name, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            (system, path), (index_system, index_path) = _open(name), _open(index)
            with index_system.open_input_stream(index_path, compression=None) as src:
                lines = [json.loads(x) for x in src.read().decode().splitlines()]
            rows = []
            with system.open_input_file(path) as file:
                for x in lines:
                    file.seek(x["offset"])
                    data = zlib.decompress(file.read(x["length"]), 31)
                    head_end = data.index(b"\r\n\r\n")
                    head, block = headers_of(data[:head_end]), data[head_end + 4:-4]
                    http_end = block.index(b"\r\n\r\n")
                    if head["warc-type"] == "revisit":
                        size, digest = int(headers_of(block[:http_end])["content-length"]), head["warc-payload-digest"].removeprefix("sha256:")
                    else:
                        payload = block[http_end + 4:]
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    rows.append((_page(head["warc-record-id"]), size, digest, head["warc-type"], _page(head.get("warc-refers-to")),
                                 head.get("warc-target-uri"), name, x["offset"], x["length"]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def read_records(members: DataFrame) -> DataFrame:
    """A row per record of normalised archives (columns path and index), read by its index line."""
    n = max(1, members.count())
    return members.select("path", "index").repartition(n).mapInArrow(
        _read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, offset long, length long")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(normalise_archives(write_archives(table(spark, sf_dir, "pages")))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
