"""Vectorised work on the UTF-8 bytes of Arrow string columns.

Documents of an Arrow batch are cut into chunks of about a megabyte; in a chunk
all words are found and hashed with NumPy, without a Python object per word.
A slice's hash joins two polynomials of its bytes, each modulo a prime near 2**31
at a random point, and is then mixed; prefix sums give any slice of the text (word, prefix)
in constant time. Two different slices of n bytes agree for at most (n / 2**31)**2 of all
pairs of points, whatever their pattern. Where equal hashes decide about
results, :func:`classes` compares the bytes too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 1_000_000

_rng = np.random.Generator(np.random.PCG64(20240229))
#: Two primes below 2**31 and a random point for each.
_PRIMES = (2**31 - 1, 2**31 - 19)
_POINTS = tuple(int(x) for x in _rng.integers(2**29, 2**31 - 20, 2))
#: Bytes whose weighted sum stays below 2**62 without a modulus: 2**22 * 2**8 * 2**31 is 2**61.
_BLOCK = 1 << 22
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII letters and every byte of a non-ASCII character.
LETTER = np.zeros(256, bool)
LETTER[ord("A") : ord("Z") + 1] = LETTER[ord("a") : ord("z") + 1] = LETTER[128:] = True
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _powers_of(point: int, prime: int, n: int) -> np.ndarray:
    """point**k modulo the prime for k below n, by doubling."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(point, len(out), prime) % prime])
    return out[:n]


def _power_tables(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """point**k and point**-k modulo the lane's prime for k below n."""
    if lane not in _powers or len(_powers[lane][0]) < n:
        # As long as the chunks ask for, and doubled, so that longer ones seldom make them anew.
        size, prime, point = 1 << max(n - 1, 1 << 18).bit_length(), _PRIMES[lane], _POINTS[lane]
        _powers[lane] = _powers_of(point, prime, size), _powers_of(pow(point, -1, prime), prime, size)
    return _powers[lane]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


@dataclass
class Chunk:
    """Consecutive documents: ``data`` holds their bytes, ``bounds`` where each begins and ends."""

    data: np.ndarray
    bounds: np.ndarray
    first: int

    @property
    def docs(self) -> int:
        return len(self.bounds) - 1

    def hasher(self, lower: bool = False) -> "Hasher":
        return Hasher(LOWER[self.data] if lower else self.data)

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each maximal run of bytes with ``inside`` set; no run crosses documents."""
        n = len(self.data)
        edge = np.zeros(n + 1, bool)
        edge[self.bounds] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:n]
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(~BLANK[self.data])

    def owner_bounds(self, starts: np.ndarray) -> np.ndarray:
        """For sorted positions, where those of each document begin; one more entry than documents."""
        return np.searchsorted(starts, self.bounds)

    def code_points(self) -> np.ndarray:
        """At i the code points that begin before byte i; one more entry than bytes."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out


class Hasher:
    """Hashes of slices of one chunk's bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.lanes = []
        for lane, prime in enumerate(_PRIMES):
            power, inverse = _power_tables(lane, n + 1)
            sums = np.zeros(n + 1, np.int64)
            for at in range(0, n, _BLOCK):
                to = min(at + _BLOCK, n)
                weighted = power[at:to] * data[at:to]
                weighted += power[at:to]  # a byte counts as its value and one, so that zero bytes count
                np.cumsum(weighted, out=sums[at + 1 : to + 1])
                sums[at + 1 : to + 1] += sums[at]
                sums[to] %= prime
            self.lanes.append((sums, inverse, prime))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        one, two = ((sums[ends] - sums[starts]) % prime * inverse[starts] % prime for sums, inverse, prime in self.lanes)
        return mix(mix((one.astype(U) << U(31)) | two.astype(U)) + (ends - starts).astype(U) * U(0x9E3779B97F4A7C15))


def same_rows(a: np.ndarray, a_starts: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """For slices of two byte arrays, one by one, whether they are equal."""
    length = a_ends - a_starts
    equal = length == b_ends - b_starts
    asked = np.flatnonzero(equal & (length > 0))
    length = length[asked]
    total = np.cumsum(length)
    if len(asked):
        offset = np.arange(int(total[-1]), dtype=np.int32)
        of = lambda starts: offset + np.repeat((starts[asked] - (total - length)).astype(np.int32), length)
        differs = np.flatnonzero(a[of(a_starts)] != b[of(b_starts)])
        equal[asked[np.unique(np.searchsorted(total, differs, "right"))]] = False
    return equal


def classes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices by equal bytes: the class of each, and the first slice of each class.

    Hashes bring equal slices together; bytes are compared with those of the class's first, and slices that differ from it get classes of their own.
    """
    which, distinct = pd.factorize(hashes)
    first = np.zeros(len(distinct), np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    like = first[which]
    again = np.flatnonzero(like != np.arange(len(which)))
    odd = again[~same_rows(data, starts[again], ends[again], data, starts[like[again]], ends[like[again]])]
    if len(odd):
        own: dict[bytes, int] = {}
        found = list(first)
        for i in odd.tolist():
            key = data[starts[i] : ends[i]].tobytes()
            if key not in own:
                own[key] = len(found)
                found.append(i)
            which[i] = own[key]
        first = np.array(found, np.int64)
    return which, first


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The documents of a string column in chunks of about ``limit`` bytes; null counts as empty.

    A longer document is a chunk of its own: texts are never cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield Chunk(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to
