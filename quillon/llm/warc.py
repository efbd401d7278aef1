"""A deterministic sharded WARC writer, and a reader.

Pages are placed in ranges of ids and sorted inside them; a range's records go to files that are
rolled by compressed size, each record a gzip member of its own.  Headers and digests are made
anew from the payload.  Of records with equal payloads the one with the smallest id is a response,
the others revisit it.  The same pages always give the same bytes: ids, dates and names depend on
the rows only.

A file is written under a temporary name and renamed when it is complete; which files belong to
an archive is told by its manifest, a table written after all of them.  A task that is run again
writes the same files over.

The folder may be any that pyarrow's file systems open; workers hold one record at a time.

Defined results: a null payload is an empty one; a null url is an empty one, line ends in urls
become spaces; rows without an id come first, are responses and read back without an id; rows
with equal id and payload are responses each; an empty table gives an archive without files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.bpe import chunks
from quillon.llm.common import IdRanges, stored

#: Compressed bytes after which a file is closed.
ROLL_BYTES = 16 << 20
#: Payloads of at least so many bytes can be revisited.
MIN_REVISIT_BYTES = 0
RANGE_ROWS = 2000
#: Every record's date: pages have none of their own.
DATE = "2024-01-01T00:00:00Z"
SOFTWARE = "quillon"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ':'.join(map(str, parts)))}>"


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha1:{digest32(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, home: int | None) -> bytes:
    """The WARC record of a page: a revisit of page ``home`` if that is given."""
    digest = digest32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Record-ID", record_id("page", page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if home is None:
        return _record("response", headers, http + payload)
    headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id("page", home, digest)), ("X-Refers-To-Page-ID", str(home))]
    return _record("revisit", headers, http)


def member(record: bytes) -> bytes:
    """A record as a gzip member without a time."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def records_of(stream, size: int = 1 << 20):
    """``(headers, block)`` of each record of a file of gzip members."""
    z, held, rest = zlib.decompressobj(31), [], b""
    while True:
        if not rest:
            rest = stream.read(size)
            if not rest:
                break
        held.append(z.decompress(rest))
        rest = b""
        if z.eof:
            rest = z.unused_data
            z = zlib.decompressobj(31)
            raw = b"".join(held)
            held = []
            head, _, body = raw.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield fields, body[: int(fields["Content-Length"])]
    if held and any(held):
        raise ValueError("a record is cut off")


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Files:
    """Rolled files of one range."""

    def __init__(self, root: str, shard: int, roll: int):
        self.fs, base = _filesystem(root)
        self.base, self.shard, self.roll = base.rstrip("/"), shard, roll
        self.n, self.out, self.done = 0, None, []

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"pages-{self.shard:06d}-{self.n:05d}.warc.gz"
            self.temporary = f"{self.base}/.{self.name}.{uuid.uuid4().hex}"
            self.fs.create_dir(self.base, recursive=True)
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
            self.size = self.records = 0
            self.sum = hashlib.sha256()
            info = f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\n".encode()
            self._put(_record("warcinfo", [("WARC-Record-ID", record_id("file", self.name)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))
        self._put(record)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def _put(self, record: bytes) -> None:
        raw = member(record)
        self.out.write(raw)
        self.sum.update(raw)
        self.size += len(raw)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.base}/{self.name}")
            self.done.append((self.name, self.records, self.size, self.sum.hexdigest()))
            self.out, self.n = None, self.n + 1


def write_archive(pages: DataFrame, root: str, roll: int = ROLL_BYTES, min_revisit: int = MIN_REVISIT_BYTES, rows_each: int = RANGE_ROWS) -> DataFrame:
    """Writes ``pages`` (``page_id``, ``url``, ``html``) to WARC files in ``root``.

    Returns the manifest: ``(file, records, bytes, sha256)``.  Payloads are shuffled once.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    marks = rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("size")).where(F.col("page_id").isNotNull() & (F.col("size") >= min_revisit))
    homes = marks.groupBy("digest", "size").agg(F.min("page_id").alias("home"), F.max("page_id").alias("far")).where("far > home").select("digest", "size", "home")
    refers = marks.join(homes, ["digest", "size"]).where("page_id > home").select("page_id", "digest", "home").distinct()
    # what a page refers to comes right before the page, so pages needn't be joined
    kinds = refers.select("page_id", F.lit(0).alias("kind"), "home", F.col("digest").alias("url"), F.lit("").alias("html")).unionByName(
        rows.select("page_id", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("home"), "url", "html")
    )
    ranges = IdRanges(rows.select("page_id"), "page_id", rows_each)
    placed = kinds.withColumn("shard", ranges.place(F.col("page_id"))).repartition(len(ranges.cuts) + 1, "shard").sortWithinPartitions("shard", "page_id", "kind", "url", "html")

    def run(batches):
        files, refer = None, {}

        def told():
            rows = files.done
            files.done = []
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "records", "bytes", "sha256"])

        at = None
        for batch in batches:
            for part in chunks(batch, "html"):
                for shard, page_id, kind, home, url, raw in zip(*(part.column(c).to_pylist() for c in ("shard", "page_id", "kind", "home", "url")), part.column("html").cast(pa.binary()).to_pylist(), strict=True):
                    if files is None or files.shard != shard:
                        if files is not None:
                            files.close()
                            yield told()
                        files = _Files(root, shard, roll)
                    if page_id != at:
                        at, refer = page_id, {}
                    if kind == 0:
                        refer[url] = home
                        continue
                    to = refer.get(hashlib.sha1(raw).hexdigest()) if refer else None
                    files.add(page_record(page_id, url, raw, to))
        if files is not None:
            files.close()
            yield told()

    written = placed.select("shard", "page_id", "kind", "home", "url", "html").mapInArrow(run, "file string, records long, bytes long, sha256 string")
    return stored(written, root, "manifest")


def read_archive(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to, html)`` of each page
    record of the manifest's files; digests are computed anew and must match.  ``html`` is null in
    revisits."""
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())]

    def run(batches):
        fs, base = _filesystem(root)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])

        for batch in batches:
            for name in batch.column("file").to_pylist():
                held, size = [], 0
                with fs.open_input_stream(f"{base.rstrip('/')}/{name}", compression=None) as stream:
                    for fields, block in records_of(stream):
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        if fields["WARC-Block-Digest"] != f"sha1:{digest32(block)}":
                            raise ValueError(f"{name}: a block doesn't match its digest")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        length = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
                        response = fields["WARC-Type"] == "response"
                        if response and (digest32(payload) != digest or len(payload) != length):
                            raise ValueError(f"{name}: a payload doesn't match its headers")
                        page, to = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
                        held.append((page and int(page), fields["WARC-Target-URI"], length, digest, fields["WARC-Type"], to and int(to), payload.decode() if response else None))
                        size += len(block)
                        if size >= 4 << 20:
                            yield batch_of(held)
                            held, size = [], 0
                if held:
                    yield batch_of(held)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
    # a number of its own, else small rows that stand for large files would be put together
    return manifest.select("file").repartition(max(1, manifest.count()), "file").mapInArrow(run, schema)
