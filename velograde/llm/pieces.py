"""Encoding and decoding with merge-type (BPE) SentencePiece models.

A text is normalised as the model asks (spaces become U+2581, one is put before
the text) and is a row of symbols, one per character. All adjacent pairs whose union is a
piece stand in an agenda ordered by the piece's score, then by place; the best pair is merged,
and the pairs that the merged symbol forms with its neighbours join the agenda. Pairs
one of whose symbols is gone are skipped. Symbols that are no pieces become byte pieces.
Long segments have an agenda each, a heap. Short ones take turns together: a round takes the best
entry of every segment's agenda, as one minimum over arrays.

A merge happens inside a piece of the vocabulary. So a text may be cut wherever no piece holds the two
characters on either side next to each other: merges left and right of the cut never meet. Texts are
cut before spaces that follow something else, and each distinct segment goes through the agenda once
(:mod:`~velograde.llm.segments`); before the cut is used, the vocabulary is searched
for pieces with a space after another character, and with one the whole text is one segment.

Each list of new segments is checked against the sentencepiece library in the Arrow batch it
comes from, and so is each whole text: the library decodes its ids, and must give the
text back. A difference ends the job.

Models of other types (unigram, word, char), with rules of normalisation of their own, user-defined or unused pieces,
or without byte pieces are refused with a ValueError.

Defined cases: null texts are empty and have the begin and end ids alone; ids may be
null, and repeated; repeated rows are rows of their own; an empty table yields no rows; other columns are not read.
A text of any length is encoded whole, in one task.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velograde.llm.segments import CACHE_BYTES, SegmentCache, flat
from velograde.llm.textbytes import Chunk, chunks
from velograde.shipping import ship

SPACE = "▁"
#: The types of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
#: Segments of more characters have a heap of their own.
SHORT = 48
NONE = np.int64(2**62)


class MergeModel:
    """A merge-type model: pieces with scores, and the agenda over a text's symbols."""

    def __init__(self, model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if model.trainer_spec.model_type != BPE:
            raise ValueError("not a merge-type model")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model's normalisation is not supported")
        if kinds & {USER_DEFINED, UNUSED} or BYTE not in kinds:
            raise ValueError("models with user-defined or unused pieces, or without byte pieces, are not supported")
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.prefix = norm.add_dummy_prefix
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        #: Piece: (score negated, id), for those that merges can give.
        self.pieces = {p.piece: (-p.score, i) for i, p in enumerate(model.pieces) if p.type == NORMAL}
        by_byte = {p.piece: i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.bytes = [by_byte[f"<0x{b:02X}>"] for b in range(256)]
        # For arrays: symbols are ids of pieces or, for characters that are none, their code points beyond these.
        size = len(model.pieces)
        number = {p: i for p, (_, i) in self.pieces.items()}
        of = lambda s: number[s] if s in number else size + ord(s) if len(s) == 1 else None
        self.size, self.of_character = size, np.arange(size, size + 0x110000, dtype=np.int64)
        for p, i in number.items():
            if len(p) == 1:
                self.of_character[ord(p)] = i
        splits = [(of(p[:k]), of(p[k:]), i) for p, i in number.items() for k in range(1, len(p))]
        pairs = np.array([((left << 32) | right, i) for left, right, i in splits if left is not None and right is not None], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.pairs, self.unions = pairs[:, 0].copy(), pairs[:, 1].copy()
        scores = np.array([-p.score for p in model.pieces])
        self.order = np.unique(scores, return_inverse=True)[1].astype(np.int64)
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.pieces)

    def symbols(self, text: str) -> list[str]:
        """The symbols of a normalised text when no pair is left to merge."""
        pieces = self.pieces
        # A merged symbol stands at its left end; the places of what it took in hold None.
        symbol: list[str | None] = list(text)
        n = len(symbol)
        agenda = []
        for i in range(n - 1):
            union = symbol[i] + symbol[i + 1]
            if (found := pieces.get(union)) is not None:
                agenda.append((found[0], i, union, i + 1))
        if not agenda:
            return symbol
        heapq.heapify(agenda)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while agenda:
            _, i, union, j = heapq.heappop(agenda)
            left, right = symbol[i], symbol[j]
            # Symbols only grow: the pair is as it was if it still spells the union.
            if left is None or right is None or after[i] != j or len(left) + len(right) != len(union):
                continue
            symbol[i], symbol[j] = union, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                wider = union + symbol[k]
                if (found := pieces.get(wider)) is not None:
                    heapq.heappush(agenda, (found[0], i, wider, k))
            if (h := before[i]) >= 0:
                wider = symbol[h] + union
                if (found := pieces.get(wider)) is not None:
                    heapq.heappush(agenda, (found[0], h, wider, i))
        return [s for s in symbol if s is not None]

    def ids(self, text: str) -> list[int]:
        """The ids of a normalised text."""
        out = []
        for s in self.symbols(text):
            found = self.pieces.get(s)
            if found is not None:
                out.append(found[1])
            else:
                out.extend(self.bytes[b] for b in s.encode())
        return out

    def agenda(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For adjacent symbols, the piece that they make and its place in the order of scores (``NONE`` without one)."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, key), max(0, len(self.pairs) - 1))
        found = self.pairs[at] == key if len(self.pairs) else np.zeros(len(key), bool)
        union = np.where(found, self.unions[at] if len(self.pairs) else 0, 0)
        return union, np.where(found, self.order[union], NONE)

    def rounds(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of short normalised texts, how many ids each has, and all ids in a row: all agendas at once."""
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        symbol = self.of_character[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
        owner = np.repeat(np.arange(len(texts)), length)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        n = len(symbol)
        union, order = np.zeros(n, np.int64), np.full(n, NONE)
        union[:-1], order[:-1] = self.agenda(symbol[:-1], symbol[1:])
        order[:-1][owner[1:] != owner[:-1]] = NONE
        while len(symbol):
            n = len(symbol)
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(starts, n))
            # The best score, and of its pairs the first.
            least = np.repeat(np.minimum.reduceat(order, starts), sizes)
            open_ = least < NONE
            at = np.flatnonzero(open_ & (order == least))
            at = at[np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])] if len(at) else at
            done.append((owner[~open_], symbol[~open_]))
            symbol[at] = union[at]
            stays = open_
            stays[at + 1] = False
            place = np.cumsum(stays) - 1
            at = place[at]
            symbol, owner, union, order = symbol[stays], owner[stays], union[stays], order[stays]
            # The merged symbol's pairs with its neighbours.
            for i in (at, at[at > 0] - 1):
                inside = i + 1 < len(symbol)
                j = i[inside]
                order[i] = NONE
                union[j], order[j] = self.agenda(symbol[j], symbol[j + 1])
                order[j[owner[j] != owner[j + 1]]] = NONE
        owners, symbols = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (owner, symbol)
        by = np.argsort(owners, kind="stable")
        owners, symbols = owners[by], symbols[by]
        odd = np.flatnonzero(symbols >= self.size)
        if len(odd):
            spelled = [[self.bytes[b] for b in chr(c).encode()] for c in (symbols[odd] - self.size).tolist()]
            counts, ids = flat(spelled)
            takes = np.ones(len(symbols), np.int64)
            takes[odd] = counts
            owners, symbols = np.repeat(owners, takes), np.repeat(symbols, takes)
            symbols[symbols >= self.size] = ids
        return np.bincount(owners, minlength=len(texts)), symbols.astype(np.uint32)


class PieceEncoder:
    """Encodes and decodes the documents of chunks, checked against the library."""

    def __init__(self, model_path: str, limit: int = CACHE_BYTES):
        self.model = MergeModel(model_path)
        self.cache = SegmentCache(self._segments, limit)

    def _segments(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new segments by their agendas, the same as the library's."""
        model = self.model
        texts = [s.decode().replace(" ", SPACE) for s in segments]
        short = np.array([len(t) <= SHORT for t in texts], bool)
        lists: list = [None] * len(texts)
        counts, ids = model.rounds([t for t in texts if len(t) <= SHORT])
        if not short.all():
            ends = np.cumsum(counts)
            for i, x, y in zip(np.flatnonzero(short).tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                lists[i] = ids[x:y].tolist()
            for i in np.flatnonzero(~short).tolist():
                lists[i] = model.ids(texts[i])
            counts, ids = flat(lists)
        # The library puts a space before a text. It is a piece of its own in front of a line feed, which is in no piece with another character.
        lead = model.library.encode("\n")
        their_counts, theirs = flat(model.library.encode(["\n" + t for t in texts]))
        own = np.ones(len(theirs), bool)
        first = np.cumsum(their_counts) - their_counts
        for k, i in enumerate(lead):
            if (theirs[first + k] != i).any():
                raise ValueError("the library does not keep a line feed apart")
            own[first + k] = False
        if not np.array_equal(their_counts - len(lead), counts) or not np.array_equal(theirs[own], ids):
            raise ValueError("ids of segments differ from those of the library")
        return counts, ids

    def starts(self, chunk: Chunk) -> np.ndarray:
        """Where segments begin: at documents, and at spaces after bytes that are no space and end no U+2581."""
        data, n = chunk.data, len(chunk.data)
        starts = np.zeros(n + 1, bool)
        starts[chunk.bounds] = True
        if n and self.model.cuts:
            starts[1:n] |= (data[1:] == 0x20) & (data[:-1] != 0x20) & (data[:-1] != 0x81)
        return np.flatnonzero(starts[:n])

    def prefixed(self, chunk: Chunk) -> Chunk:
        """The chunk with a space before each text that is not empty."""
        if not self.model.prefix:
            return chunk
        filled = chunk.bounds[1:] > chunk.bounds[:-1]
        data = np.insert(chunk.data, chunk.bounds[:-1][filled], np.uint8(0x20))
        return Chunk(data, chunk.bounds + np.concatenate([[0], np.cumsum(filled)]), chunk.first)

    def encode(self, chunk: Chunk) -> Iterator[tuple[np.ndarray, str]]:
        """The ids of each document with begin and end, and the text that the library's decoder makes of them."""
        model = self.model
        raw = chunk.data.tobytes()
        wide = self.prefixed(chunk)
        for d, ids in enumerate(self.cache.encode(wide, self.starts(wide))):
            ids = np.concatenate([[np.uint32(model.begin)], ids, [np.uint32(model.end)]]).astype("<u4")
            decoded = model.library.decode(ids.tolist())
            text = raw[chunk.bounds[d] : chunk.bounds[d + 1]].decode().replace(SPACE, " ")
            if decoded != text:
                raise ValueError(f"the decoded text differs from {text[:100]!r}")
            yield ids, decoded


_encoders: dict[str, PieceEncoder] = {}


def encoder(model_path: str) -> PieceEncoder:
    """The encoder of this worker process: its cache outlives a task and is bounded."""
    if model_path not in _encoders:
        _encoders[model_path] = PieceEncoder(model_path)
    return _encoders[model_path]


def encode_batches(model_path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode = encoder(model_path).encode
    for batch in batches:
        for chunk in chunks(batch.column(1)):
            lists, texts = [], []
            for ids, decoded in encode(chunk):
                lists.append(ids)
                texts.append(decoded)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(lists).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.docs), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])


def digest_batches(model_path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode = encoder(model_path).encode
    for batch in batches:
        for chunk in chunks(batch.column(1)):
            rows = [(len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()) for ids, decoded in encode(chunk)]
            n, of_ids, of_text = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.docs), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): each text's ids with begin and end, and the text they decode to. Narrow: no shuffle."""
    return _rows(docs, id_col, text_col).mapInArrow(lambda batches: encode_batches(model_path, batches), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of :func:`encode`, without its ids and texts leaving the task."""
    return _rows(docs, id_col, text_col).mapInArrow(lambda batches: digest_batches(model_path, batches), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
