"""Encoding of texts by segments that a tokenizer treats independently, each distinct segment once.

Segments of a chunk are brought together by hash and compared by bytes
(:func:`~velograde.llm.textbytes.classes`). A bounded cache of the worker keeps the segments' bytes and ids in flat arrays, found by
hash and again compared by bytes: no hash decides which ids a text gets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

from velograde.llm.textbytes import Chunk, classes, same_rows

#: Bytes of cached segments that a worker keeps; beyond, it starts anew.
CACHE_BYTES = 64_000_000
#: New segments are encoded in lists of so many.
PART = 20_000


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of lists, and their numbers in a row."""
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return counts, np.fromiter(chain.from_iterable(lists), np.uint32, int(counts.sum()))


class Rows:
    """Rows of different lengths in one growing array."""

    def __init__(self, kind: type):
        self.data, self.ends = np.zeros(8192, kind), np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.ends) - 1

    @property
    def nbytes(self) -> int:
        return int(self.ends[-1]) * self.data.itemsize + self.ends.nbytes

    def add(self, counts: np.ndarray, values: np.ndarray) -> None:
        ends = self.ends[-1] + np.cumsum(counts)
        used, total = int(self.ends[-1]), int(self.ends[-1]) + len(values)
        if len(self.data) < total:
            self.data = np.concatenate([self.data[:used], np.zeros(max(total - used, used // 2), self.data.dtype)])
        self.data[used:total] = values
        self.ends = np.concatenate([self.ends, ends])


class SegmentCache:
    """Ids of segments; ``encode`` gives those of a list of new ones: how many each has, and all of them in a row."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = CACHE_BYTES):
        self.encode_list, self.limit = encode, limit
        self.reset()

    def reset(self) -> None:
        # Hashes of the segments in ascending order, and the rows of each.
        self.known, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.texts, self.ids = Rows(np.uint8), Rows(np.uint32)

    def rows_of(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The rows of distinct segments; those not held are encoded."""
        if self.known.nbytes + self.row.nbytes + self.texts.nbytes + self.ids.nbytes > self.limit:
            self.reset()
        at = np.searchsorted(self.known, hashes)
        inside = np.flatnonzero(at < len(self.known))
        same_hash = inside[self.known[at[inside]] == hashes[inside]]
        rows = self.row[at[same_hash]]
        equal = same_rows(data, begin[same_hash], end[same_hash], self.texts.data, self.texts.ends[rows], self.texts.ends[rows + 1])
        out = np.full(len(hashes), -1, np.int64)
        out[same_hash[equal]] = rows[equal]
        new = np.flatnonzero(out < 0)
        out[new] = len(self.ids) + np.arange(len(new))
        raw = data.tobytes()
        for first in range(0, len(new), PART):
            part = [raw[x:y] for x, y in zip(begin[new[first : first + PART]].tolist(), end[new[first : first + PART]].tolist(), strict=True)]
            self.ids.add(*self.encode_list(part))
            joined = b"".join(part)
            self.texts.add(end[new[first : first + PART]] - begin[new[first : first + PART]], np.frombuffer(joined, np.uint8))
        # A segment that shares its hash with another one held is encoded each time: it can't be found.
        fresh = np.setdiff1d(new, same_hash, assume_unique=True)
        order = fresh[np.argsort(hashes[fresh], kind="stable")]
        self.known = np.insert(self.known, at[order], hashes[order])
        self.row = np.insert(self.row, at[order], out[order])
        return out

    def encode(self, chunk: Chunk, begin: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each document of a chunk, whose segments begin where ``begin`` says and tile it."""
        end = np.append(begin[1:], len(chunk.data))[: len(begin)]
        hashes = chunk.hasher()(begin, end)
        which, first = classes(chunk.data, begin, end, hashes)
        rows = self.rows_of(chunk.data, begin[first], end[first], hashes[first])[which]
        starts = self.ids.ends[rows]
        counts = self.ids.ends[rows + 1] - starts
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = self.ids.data[np.repeat(starts - ends[:-1], counts) + np.arange(int(ends[-1]))]
        of = ends[np.searchsorted(begin, chunk.bounds)]
        for d in range(chunk.docs):
            yield ids[of[d] : of[d + 1]]
