"""WARC archives: writing, normalising whole-file gzip, reading by offset index.

``write_archives`` stores pages as response records in archives that are one
gzip stream each. ``normalise`` inflates such a stream once, in pieces, and
rewrites every record as a gzip member of its own with a sidecar index of
offsets; records whose payload another page holds become revisits on the way,
so payloads are never shuffled. ``read_archives`` fetches members by the index.

Files go to the folder that all executors share, under names that no two
attempts of a task share and that the written tables list: a task that runs again
writes further files, and only those of the attempt that counted are read; others
go with the folder. A null payload is empty; very long ones are read and written
in pieces, a record at a time. Of equal payloads of at least ``REVISIT_BYTES``
bytes the page with the largest page_id is the response; rows that repeat it are
responses as well, as are rows with a null page_id. An empty table gives no
archive and no row. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_path, slices

REVISIT_BYTES = 1000
#: Uncompressed bytes and records after which a new archive begins.
ROLL_BYTES, ROLL_RECORDS = 64 << 20, 50_000
CHUNK = 1 << 20
DATE = "2020-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _store(uri: str):
    """pyarrow's file system for a URI or path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else "file://" + uri)


def _record_id(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def _page_of(record_id: str | None) -> int | None:
    return int(record_id[len("<urn:page:") : -1]) if record_id and record_id.startswith("<urn:page:") and record_id[10:-1].lstrip("-").isdigit() else None


def _clean(url: str) -> str:
    """A URI that keeps to one header line: everything but printable ASCII is escaped."""
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def response(page_id: int | None, url: str | None, payload: bytes, digest: str) -> bytes:
    name = _record_id(page_id) if page_id is not None else f"<urn:sha1:{digest}>"
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", name), ("WARC-Date", DATE)] + ([("WARC-Target-URI", _clean(url))] if url else [])
    return record([*headers, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")], _HTTP + payload)


def revisit(headers: dict[str, str], block: bytes, refers_to: int) -> bytes:
    """The revisit record that stands for a response; the payload's size is kept in a header of our own."""
    cut = block.index(b"\r\n\r\n") + 4
    new = [("WARC-Type", "revisit"), ("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(refers_to)), ("X-Payload-Bytes", str(len(block) - cut))]
    return record(new + [(k, v) for k, v in headers.items() if k not in ("WARC-Type", "Content-Length")], block[:cut])


def _write(uri: str, parts: Iterator[bytes]) -> int:
    """Writes a file of a name that no other attempt has; gives the size."""
    store, path = _store(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    size = 0
    with store.open_output_stream(path, compression=None) as f:
        for part in parts:
            f.write(part)
            size += len(part)
    return size


def _unique(stem: str) -> str:
    return f"{stem}-{uuid.uuid4().hex[:12]}.warc.gz"


_META = "archive string, n int, page_id bigint, payload_bytes bigint, payload_digest string"


def write_archives(pages: DataFrame, root: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Archives of one gzip stream each, and a written table of their records: archive, n, page_id, payload_bytes, payload_digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, number = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        packed: list[bytes] = []
        gzip, size = zlib.compressobj(1, wbits=31), 0

        def close() -> pa.RecordBatch:
            name = _unique(f"{partition:07d}-{number:05d}")
            _write(f"{root}/whole/{name}", iter([*packed, gzip.flush()]))
            cols = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(range(len(rows)), pa.int32()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["archive", "n", "page_id", "payload_bytes", "payload_digest"])

        for batch in batches:
            for part in slices(batch, "html"):
                for page_id, url, html in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                    payload = (html or "").encode()
                    digest = hashlib.sha1(payload).hexdigest()
                    data = response(page_id, url, payload, digest)
                    packed.append(gzip.compress(data))
                    size += len(data)
                    rows.append((page_id, len(payload), digest))
                    if size >= roll_bytes or len(rows) >= ROLL_RECORDS:
                        yield close()
                        number += 1
                        rows, packed, gzip, size = [], [], zlib.compressobj(1, wbits=31), 0
        if rows:
            yield close()

    columns = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    return materialize(columns.mapInArrow(run, _META), "warc_records")


def inflate(uri: str) -> Iterator[bytes]:
    """A gzip file's content in pieces; further members follow the first. A file that breaks off is an error."""
    store, path = _store(uri)
    with store.open_input_stream(path, compression=None) as f:
        gzip = zlib.decompressobj(31)
        while data := f.read(CHUNK):
            while data:
                if gzip.eof:
                    gzip = zlib.decompressobj(31)
                yield gzip.decompress(data, 4 * CHUNK)
                data = gzip.unconsumed_tail or gzip.unused_data
        while not gzip.eof:  # output that the limit held back
            piece = gzip.decompress(b"", 4 * CHUNK)
            if not piece:
                raise EOFError(f"{uri} breaks off")
            yield piece


def parse_header(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return dict(x.split(": ", 1) for x in lines[1:])


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a stream; only the open record is held."""
    kept, seen = bytearray(), 0
    need = None
    for piece in pieces:
        kept += piece
        while True:
            if need is None:
                end = kept.find(b"\r\n\r\n", max(0, seen - 3))
                if end < 0:
                    seen = len(kept)
                    break
                headers = parse_header(bytes(kept[:end]))
                need = end + 4 + int(headers["Content-Length"]) + 4
                start = end + 4
            if len(kept) < need:
                break
            yield headers, bytes(kept[start : need - 4])
            del kept[:need]
            need, seen = None, 0
    if kept:
        raise EOFError("the last record breaks off")


def _member(data: bytes) -> bytes:
    gzip = zlib.compressobj(6, wbits=31)
    return gzip.compress(data) + gzip.flush()


def normalise_file(source: str, target: str, revisits: dict[int, int]) -> int:
    """Rewrites one archive; ``revisits`` maps record numbers to the page they refer to. Gives the number of records."""
    index: list[str] = []

    def members() -> Iterator[bytes]:
        at = 0
        for n, (headers, block) in enumerate(records(inflate(source))):
            data = revisit(headers, block, revisits[n]) if n in revisits else record([(k, v) for k, v in headers.items() if k != "Content-Length"], block)
            member = _member(data)
            index.append(f"{at}\t{len(member)}\t{headers['WARC-Record-ID']}\n")
            at += len(member)
            yield member

    _write(target, members())
    _write(f"{target}.idx", iter(["".join(index).encode()]))
    return len(index)


def revisits_of(meta: DataFrame) -> DataFrame:
    """(archive, n, refers_to) of the records whose payload another page stands for."""
    large = meta.where((F.col("payload_bytes") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
    keepers = large.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").select(F.col("payload_digest").alias("d"), "refers_to")
    return large.join(keepers, F.col("payload_digest") == F.col("d")).where("page_id <> refers_to").select("archive", "n", "refers_to")


def normalise(meta: DataFrame, root: str) -> DataFrame:
    """Every archive of ``meta`` with a member for each record and a sidecar index; a written table (archive, n_records) of the new ones."""
    lists = revisits_of(meta).groupBy("archive").agg(F.collect_list(F.struct("n", "refers_to")).alias("revisits"))  # ROLL_RECORDS at most
    archives = meta.select("archive").distinct().join(lists, "archive", "left")
    archives = archives.repartition(max(1, meta.agg(F.count_distinct("archive")).first()[0]), "archive")  # a row is a file's work

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for name, found in zip(batch.column("archive").to_pylist(), batch.column("revisits").to_pylist(), strict=True):
                own = _unique(name[: name.rindex("-")])
                done.append((own, normalise_file(f"{root}/whole/{name}", f"{root}/records/{own}", {x["n"]: x["refers_to"] for x in found or ()})))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], ["archive", "n_records"])

    return materialize(archives.mapInArrow(run, "archive string, n_records bigint"), "warc_archives")


_READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"


def read_archives(archives: DataFrame, root: str) -> DataFrame:
    """Every record of the archives, each fetched as its own member by the index. A payload that doesn't fit its digest is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                store, path = _store(f"{root}/records/{name}")
                with store.open_input_stream(f"{path}.idx", compression=None) as f:
                    index = [x.split("\t") for x in f.read().decode().splitlines()]
                rows = []
                with store.open_input_file(path) as f:
                    for at, length, _ in index:
                        data = zlib.decompress(f.read_at(int(length), int(at)), 31)
                        headers, block = next(records(iter([data])))
                        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"][len("sha1:") :]
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{name} at {at}: the payload doesn't fit its digest")
                        size = len(payload) if kind == "response" else int(headers["X-Payload-Bytes"])
                        rows.append((_page_of(headers["WARC-Record-ID"]), size, digest, kind, _page_of(headers.get("WARC-Refers-To")), headers.get("WARC-Target-URI")))
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    return archives.select("archive").mapInArrow(run, _READ)


def archive_pages(spark: SparkSession, pages: DataFrame, root: str | None = None) -> DataFrame:
    """Writes, normalises and reads back: a row for each page."""
    root = root or shared_path(spark, "warc")
    meta = write_archives(pages, root)
    archives = normalise(meta, root)
    return read_archives(archives.repartition(max(1, archives.count()), "archive"), root)
