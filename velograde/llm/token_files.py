"""Token ids in length-delimited binary records with a separate offset index.

A file ``part-NNNNN.tok`` holds one record per document::

    u64 payload length | u32 masked crc32 of these 8 bytes | payload | u32 masked crc32 of the payload

and a payload is ``i64 doc_id | u8 flags | u8 bytes per id | u32 number of ids |
ids`` (little-endian; flag 1: the id is null). Ids take two bytes where the
vocabulary allows. Beside it, ``part-NNNNN.idx`` has per record ``u64 offset | u64
record length | u32 number of ids``, so that any record is read by itself, in any order.
A checksum c is masked as rotate_right(c, 15) + 0xa282ead8, so that files of
checksums do not check out trivially.

Files are written by the tasks through pyarrow's file systems, under a name of
the attempt that is then moved to its place: a repeated task leaves whole files.

Encoding: byte-level BPE encodes the pieces of its pre-tokenizer independently, and no
piece spans a single blank between two non-blank characters (the blank begins the
next piece). Texts are therefore cut at such blanks, each distinct segment is
encoded once with the tokenizers library and kept in a bounded cache of the
worker (by its bytes, not by a hash), and documents are put together from the cached ids. White space of other kinds is
not cut at.

Records stand in the order asked for: ascending ids, or the order in which a table's own files hold its rows.

Defined cases: null texts are empty and yield the end id alone; null ids sort
first; rows with one id stand in the order of their texts' hashes, then of their texts (a hot id is so spread over tasks); repeated rows are records of
their own; an empty table yields no files and no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velograde.llm.segments import CACHE_BYTES, SegmentCache, flat
from velograde.llm.textbytes import Chunk, chunks
from velograde.llm.workdir import new_path, open_dir, table
from velograde.shipping import ship

END_ID = 2
HEAD = struct.Struct("<QI")
PAYLOAD = struct.Struct("<qBBI")
ENTRY = struct.Struct("<QQI")
ENTRY_TYPE = np.dtype([("offset", "<u8"), ("length", "<u8"), ("n", "<u4")])


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


class SegmentEncoder:
    """Encodes documents with a tokenizer of the tokenizers library, each distinct segment once."""

    def __init__(self, tokenizer_path: str, limit: int = CACHE_BYTES):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 65_536 else 4
        self.cache = SegmentCache(self._ids, limit)

    def _ids(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [x.decode("utf-8", "replace") for x in segments]
        return flat([x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def encode(self, chunk: Chunk, end_id: int) -> Iterator[np.ndarray]:
        """The ids of each document of a chunk, the end id last."""
        for ids in self.cache.encode(chunk, segment_starts(chunk)):
            yield np.append(ids, np.uint32(end_id))


def segment_starts(chunk: Chunk) -> np.ndarray:
    """Where the segments of a chunk begin: at its documents, at single blanks and around single line feeds.

    A cut needs a character on either side that surely is no white space: bytes
    that can belong to white space outside ASCII, and control characters, count as unsure.
    """
    data, n = chunk.data, len(chunk.data)
    starts = np.zeros(n + 1, bool)
    if n:
        plain = (data > 0x20) & (data != 0x7F)
        # The lead bytes of U+0085 and U+00A0 and of white space with three bytes.
        wide2, wide3 = data == 0xC2, (data == 0xE1) | (data == 0xE2) | (data == 0xE3)
        before = np.zeros(n, bool)
        before[1:] = plain[:-1]
        before[2:] &= ~wide2[:-2]
        before[3:] &= ~wide3[:-3]
        after = np.zeros(n, bool)
        after[:-1] = plain[1:] & ~wide2[1:] & ~wide3[1:]
        inner = np.ones(n + 1, bool)
        inner[chunk.bounds] = False  # the first byte of a document has none before it
        single = before & after & inner[:n] & inner[1:]
        feed = single & (data == 0x0A)
        starts[:n] = (single & (data == 0x20)) | feed
        starts[1:] |= feed
        filled = chunk.bounds[:-1][chunk.bounds[1:] > chunk.bounds[:-1]]
        starts[filled] = True
    return np.flatnonzero(starts[:n])


_encoders: dict[str, SegmentEncoder] = {}


def encoder(path: str) -> SegmentEncoder:
    """The encoder of this worker process: its cache outlives a task and is bounded."""
    if path not in _encoders:
        _encoders[path] = SegmentEncoder(path)
    return _encoders[path]


def record(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    payload = PAYLOAD.pack(doc_id or 0, doc_id is None, width, len(ids)) + ids.astype("<u2" if width == 2 else "<u4").tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def parse(data: bytes, at: int) -> tuple[int | None, np.ndarray, int]:
    """The record at an offset: its id, its token ids and where the next record begins; checks both sums."""
    length, check = HEAD.unpack_from(data, at)
    if masked(data[at : at + 8]) != check:
        raise ValueError(f"record at {at}: wrong checksum of the length")
    begin = at + HEAD.size
    payload = data[begin : begin + length]
    if len(payload) != length or struct.unpack_from("<I", data, begin + length)[0] != masked(payload):
        raise ValueError(f"record at {at}: wrong checksum of the payload")
    doc_id, null, width, n = PAYLOAD.unpack_from(payload)
    return (None if null else doc_id), np.frombuffer(payload, "<u2" if width == 2 else "<u4", n, PAYLOAD.size), begin + length + 4


MANIFEST = "part int, file string, records long, tokens long, bytes long"


def write_part(directory: str, tokenizer_path: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    encode = encoder(tokenizer_path)
    store, root = open_dir(directory)
    name, attempt = f"part-{part:06d}", uuid.uuid4().hex[:8]
    out = index = None
    at = records = tokens = 0
    try:
        for batch in batches:
            ids_of_rows = batch.column(0).to_pylist()
            for chunk in chunks(batch.column(1)):
                for d, ids in enumerate(encode.encode(chunk, end_id)):
                    if out is None:
                        out, index = (store.open_output_stream(f"{root}/{name}.{x}.{attempt}") for x in ("tok", "idx"))
                    data = record(ids_of_rows[chunk.first + d], ids, encode.width)
                    out.write(data)
                    index.write(ENTRY.pack(at, len(data), len(ids)))
                    at, records, tokens = at + len(data), records + 1, tokens + len(ids)
    finally:
        for f in (out, index):
            if f is not None:
                f.close()
    if out is not None:
        for x in ("tok", "idx"):
            store.move(f"{root}/{name}.{x}.{attempt}", f"{root}/{name}.{x}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "records": [records], "tokens": [tokens], "bytes": [at]})


def write(docs: DataFrame, directory: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, as_stored: bool = False) -> DataFrame:
    """Write the files in ascending id order, or with ``as_stored`` in the order of the table's own files; returns the manifest, one row per file."""
    ship(docs.sparkSession)
    store, root = open_dir(directory)
    store.create_dir(root, recursive=True)
    own = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    if as_stored:
        rows, order = stored(docs, own)
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    else:
        rows = docs.select(*own, F.xxhash64(text_col).alias("hash"))
        order = [F.col("doc_id").asc_nulls_first(), F.col("hash")]
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return table(rows.select("doc_id", "text").mapInArrow(lambda batches: write_part(directory, tokenizer_path, end_id, batches), MANIFEST), "token-manifest")


def stored(docs: DataFrame, columns: list[Column]) -> tuple[DataFrame, list[Column]]:
    """Columns of a table with those that give the order of its rows in its files: the number of the part, the row in it.

    What is no plain read of Parquet files is written first.
    """

    def placed(rows: DataFrame, *own: Column | str) -> DataFrame:
        of = rows.metadataColumn("_metadata")
        return rows.select(*own, F.regexp_extract(of["file_name"], r"part-(\d+)", 1).try_cast("long").alias("part"), of["file_name"].alias("file"), of["row_index"].alias("nth"))

    order = [F.col("part"), F.col("file"), F.col("nth")]
    try:
        return placed(docs, *columns), order
    except AnalysisException:
        return placed(table(docs.select(*columns), "token-input"), "doc_id", "text"), order


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_parts(directory: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, root = open_dir(directory)
    for batch in batches:
        for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with store.open_input_stream(f"{root}/{name}.idx") as f:
                entries = np.frombuffer(f.read(), ENTRY_TYPE)
            with store.open_input_file(f"{root}/{name}.tok") as f:
                for first in range(0, len(entries), 4096):
                    rows = []
                    for e in entries[first : first + 4096]:
                        f.seek(int(e["offset"]))
                        doc_id, ids, _ = parse(f.read(int(e["length"])), 0)
                        if len(ids) != e["n"]:
                            raise ValueError(f"{name}: index and record differ")
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read(manifest: DataFrame, directory: str) -> DataFrame:
    """Read the files back by their index: one row per record, with where its ids begin in the whole sequence.

    One task reads one file. The window without a key numbers the files and sums their totals: one row per file.
    """
    ship(manifest.sparkSession)
    order = W.orderBy("part")
    files = manifest.select("file", F.coalesce(F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"), (F.row_number().over(order) - 1).alias("nth"))
    spread = files.repartitionById(max(1, manifest.count()), "nth").select("file", "start")
    return spread.mapInArrow(lambda batches: read_parts(directory, batches), READ)


def write_and_read(docs: DataFrame, tokenizer_path: str, directory: str | None = None, **options) -> DataFrame:
    directory = directory or new_path(docs.sparkSession, "tokens")
    return read(write(docs, directory, tokenizer_path, **options), directory)
