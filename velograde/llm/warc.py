"""WARC archives: write, normalise, read back.

Archives from elsewhere are often one gzip stream over a whole file, in which no record
can be found without inflating all before it. The normaliser inflates such a stream once,
in pieces, rewrites every record as a gzip member of its own and writes a
sidecar index with the place of each member; it holds one record in memory. From then on any record is read alone.

Of pages with equal payloads of at least ``LEAST_BYTES`` bytes, the one with the smallest id is a
response record, the others are revisit records that refer to it and carry the
HTTP header (with the payload's length) and the payload's digest, not the payload.

Index lines: record id, offset, length, record type, payload digest, separated by blanks.

Defined cases: a null payload is empty; null ids come last in the choice of the response and are
a revisit, or a response if all ids of the group are null; rows with the smallest id are all responses; a
null URL has no target header, line breaks in URLs are percent-encoded; an empty table yields no files and no rows; a stream that ends
inside a record, or a payload that its digest does not fit, is an error; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velograde.llm.workdir import new_path, open_dir, rows_below, table
from velograde.shipping import ship

LEAST_BYTES = 100
DATE = "2000-01-01T00:00:00Z"
PIECE = 1 << 20
#: Groups of copies are broadcast below so many (about 100 bytes each); else payloads are shuffled to them.
BROADCAST_GROUPS = 100_000
URN = "urn:velograde:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, refers_to): which pages are revisits, and of what."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    digest = F.unhex(F.sha2("payload", 256))
    keyed = rows.withColumn("digest", F.when(F.octet_length("payload") >= LEAST_BYTES, digest))
    groups = keyed.where("digest is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    groups = table(groups, "warc-groups")
    if rows_below(groups, BROADCAST_GROUPS):
        groups = F.broadcast(groups)
    own = F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))
    return keyed.join(groups, "digest", "left").select("page_id", "url", "payload", F.when(own, F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record of a page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x)}


def inflate(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, in pieces."""
    stream, open_member = zlib.decompressobj(31), False
    while data := read(PIECE):
        while data:
            if piece := stream.decompress(data, PIECE):
                yield piece
            open_member = not stream.eof
            if stream.eof:
                data, stream = stream.unused_data, zlib.decompressobj(31)
            else:
                data = stream.unconsumed_tail
    if open_member:
        if piece := stream.flush():
            yield piece
        if not stream.eof:
            raise ValueError("the gzip stream is cut off")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an inflated archive: headers and all bytes, one at a time."""
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while fill(1):
        at = 0
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(held) - 3)
            if not fill(len(held) + 1):
                raise ValueError("the archive ends inside a header")
        fields = headers(bytes(held[:end]))
        size = end + 4 + int(fields["content-length"]) + 4
        if not fill(size):
            raise ValueError("the archive ends inside a record")
        yield fields, bytes(held[:size])
        del held[:size]


class _Files:
    """Output files of a task, written under a name of the attempt and then moved to their place."""

    def __init__(self, directory: str, *names: str):
        self.store, self.root = open_dir(directory)
        self.names, self.attempt = names, uuid.uuid4().hex[:8]

    def __enter__(self):
        self.out = [self.store.open_output_stream(f"{self.root}/{x}.{self.attempt}", compression=None) for x in self.names]
        return self.out

    def __exit__(self, kind, *_):
        for f in self.out:
            f.close()
        if kind is None:
            for x in self.names:
                self.store.move(f"{self.root}/{x}.{self.attempt}", f"{self.root}/{x}")


MANIFEST = "file string, records long"


def write_part(directory: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's pages as one archive in one gzip stream."""
    from pyspark import TaskContext

    name = f"part-{TaskContext.get().partitionId():06d}"
    first = next((b for b in batches if b.num_rows), None)
    if first is None:
        return
    n = 0
    with _Files(directory, f"{name}.warc.gz") as (out,):
        gz = zlib.compressobj(6, zlib.DEFLATED, 31)
        batch: pa.RecordBatch | None = first
        while batch is not None:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.write(gz.compress(record(*row)))
                n += 1
            batch = next(batches, None)
        out.write(gz.flush())
    yield pa.RecordBatch.from_pydict({"file": [name], "records": [n]})


def normalise_part(source: str, target: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rewrite each named archive with a member per record and a sidecar index."""
    for batch in batches:
        for name in batch.column(0).to_pylist():
            store, root = open_dir(source)
            n = at = 0
            with store.open_input_stream(f"{root}/{name}.warc.gz", compression=None) as f, _Files(target, f"{name}.warc.gz", f"{name}.idx") as (out, index):
                for fields, data in records(inflate(f.read)):
                    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = gz.compress(data) + gz.flush()
                    out.write(member)
                    index.write(f"{fields.get('warc-record-id', '-')} {at} {len(member)} {fields.get('warc-type', '-')} {fields.get('warc-payload-digest', '-')}\n".encode())
                    n, at = n + 1, at + len(member)
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [n]})


PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _page(urn: str | None) -> int | None:
    found = (urn or "").strip("<>").removeprefix(URN)
    return int(found) if found.lstrip("-").isdigit() else None


def parse(member: bytes) -> tuple[int | None, int, str, str, int | None]:
    """Of one member: page id, bytes and digest of the payload, record type and what it refers to."""
    data = zlib.decompress(member, 31)
    end = data.index(b"\r\n\r\n")
    fields = headers(data[:end])
    block = data[end + 4 : end + 4 + int(fields["content-length"])]
    http_end = block.index(b"\r\n\r\n")
    size, digest = int(headers(block[:http_end])["content-length"]), fields["warc-payload-digest"].removeprefix("sha256:")
    kind = fields["warc-type"]
    if kind == "response":
        payload = block[http_end + 4 :]
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"{fields.get('warc-record-id')}: the payload does not fit its length or digest")
    return _page(fields.get("warc-record-id")), size, digest, kind, _page(fields.get("warc-refers-to"))


def read_part(directory: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each named normalised archive, member by member through the index."""
    store, root = open_dir(directory)
    for batch in batches:
        for name in batch.column(0).to_pylist():
            with store.open_input_stream(f"{root}/{name}.idx") as f:
                lines = f.read().decode().splitlines()
            with store.open_input_file(f"{root}/{name}.warc.gz") as f:
                for first in range(0, len(lines), 4096):
                    rows = []
                    for line in lines[first : first + 4096]:
                        _, at, length, *_ = line.split(" ")
                        f.seek(int(at))
                        rows.append(parse(f.read(int(length))))
                    ids, sizes, digests, kinds, refers = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(kinds, pa.string()), pa.array(refers, pa.int64())], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def _made(spark, *directories: str) -> None:
    ship(spark)
    for d in directories:
        store, root = open_dir(d)
        store.create_dir(root, recursive=True)


def write(pages: DataFrame, directory: str, **names) -> DataFrame:
    """Write archives, one gzip stream each; returns the manifest (file, records)."""
    _made(pages.sparkSession, directory)
    return table(plan(pages, **names).mapInArrow(lambda b: write_part(directory, b), MANIFEST), "warc-manifest")


def each_alone(manifest: DataFrame) -> DataFrame:
    """(file) with one partition per file. The window without a key numbers the files: one row each."""
    files = manifest.select("file", (F.row_number().over(W.orderBy("file")) - 1).alias("nth"))
    return files.repartitionById(max(1, manifest.count()), "nth").select("file")


def normalise(manifest: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite the archives of a manifest; returns the manifest of the new ones."""
    _made(manifest.sparkSession, target)
    return table(each_alone(manifest).mapInArrow(lambda b: normalise_part(source, target, b), MANIFEST), "warc-normalised")


def read(manifest: DataFrame, directory: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record."""
    ship(manifest.sparkSession)
    return each_alone(manifest).mapInArrow(lambda b: read_part(directory, b), PAGES)


def round_trip(pages: DataFrame, **names) -> DataFrame:
    """Write, normalise and read back."""
    raw, clean = (new_path(pages.sparkSession, x) for x in ("warc-raw", "warc"))
    return read(normalise(write(pages, raw, **names), raw, clean), clean)
