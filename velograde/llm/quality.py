"""Quality classifier: random Fourier features over document statistics.

The features approximate a Gaussian kernel. Ridge weights come from normal
equations that each partition sums over its labelled rows and Spark sums over
partitions (a matrix of fixed size, however many rows); isotonic regression on a
fold that the ridge fit has not seen turns raw scores into probabilities.
All labelled rows are used; texts are read once.

Defined cases: null texts are empty, empty texts have statistics of 0 and get a score like
any other; null ids are scored but match no label; repeated rows are scored each; rows of
``labels`` without a value are ignored; without usable labels every score is 0.5;
an empty table yields no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velograde.llm.textbytes import BLANK, Chunk, chunks, mix
from velograde.llm.workdir import table
from velograde.shipping import ship

#: Random features, width of the kernel in standard deviations of all statistics, ridge per row.
FEATURES, WIDTH, RIDGE = 256, 1.0, 1e-3
BINS = 1000
THRESHOLD = 0.7
#: Of ten hash classes of the training rows, those that calibrate.
CALIBRATION = (0, 1)


def _mask(*chars: str) -> np.ndarray:
    m = np.zeros(256, bool)
    m[[ord(c) for x in chars for c in x]] = True
    return m


_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_WIDE = np.arange(256) >= 128
_CONTINUED = (np.arange(256) & 0xC0) == 0x80
CLASSES = {
    "points": ~_CONTINUED,
    "upper": _UPPER,
    "lower": _LOWER,
    "wide": _WIDE & ~_CONTINUED,
    "digit": _mask("0123456789"),
    "blank": BLANK,
    "symbol": _mask("#$%&*@^~"),
    "loud": _mask("!?"),
    "bar": _mask("|<>{}[]\\/=_+"),
    "stop": _mask("."),
    "comma": _mask(",;:"),
    "quote": _mask("\"'()-"),
}


def _per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(keys: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """Distinct keys of each document."""
    seen = np.unique(mix(keys ^ mix(owner.astype(np.uint64))), return_index=True)[1]
    return np.bincount(owner[seen], minlength=docs)


def statistics(chunk: Chunk) -> np.ndarray:
    """One row of statistics per document."""
    data, bounds, docs = chunk.data, chunk.bounds, chunk.docs
    count = {k: _per_doc(m[data], bounds) for k, m in CLASSES.items()}
    starts, ends = chunk.words()
    of = chunk.owner_bounds(starts)
    words = np.diff(of)
    owner = np.repeat(np.arange(docs), words)
    hasher = chunk.hasher(lower=True)
    h = hasher(starts, ends)
    length = ends - starts
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    pair = h.copy()
    pair[1:] = mix(h[:-1]) * np.uint64(3) + h[1:]
    lines, line_ends = chunk.runs(data != 0x0A)
    line_of = np.diff(chunk.owner_bounds(lines))
    line_owner = np.repeat(np.arange(docs), line_of)
    capital = _UPPER[data[starts]] if len(starts) else np.zeros(0, bool)
    shout = np.zeros(len(starts), bool)
    long = length > 1
    shout[long] = capital[long] & _UPPER[data[starts[long] + 1]]
    odd = ~(_LOWER | _UPPER | _WIDE)[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    some = np.maximum(words, 1)
    points = np.maximum(count["points"], 1)
    mean = _per_doc(length, of) / some
    columns = [np.log1p(words), np.log1p(line_of), mean, np.sqrt(np.maximum(_per_doc(length**2, of) / some - mean**2, 0))]
    columns += [count[k] / points for k in CLASSES if k != "points"]
    columns += [_distinct(h, owner, docs) / some, _distinct(pair, owner, docs) / some, _distinct(hasher(lines, line_ends), line_owner, docs) / np.maximum(line_of, 1)]
    columns += [_per_doc(x, of) / some for x in (same, capital, shout, odd, length == 1, length > 16)]
    return np.column_stack(columns).astype(np.float32)


STATS = "doc_id long, stats array<float>"


def stats_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column(1)):
            x = statistics(chunk)
            flat = pa.array(x.reshape(-1), pa.float32())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.docs), lists], names=["doc_id", "stats"])


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


@dataclass
class Model:
    """Standardisation, random features, ridge weights and the calibration's steps."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None = None
    levels: np.ndarray | None = None

    def design(self, x: np.ndarray) -> np.ndarray:
        """Intercept, standardised statistics and random features."""
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        waves = np.sqrt(2 / self.omega.shape[1]) * np.cos(z @ self.omega + self.phase)
        return np.hstack([np.ones((len(x), 1)), z, waves])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.weights

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((self.raw(x) + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        at = (self.raw(x) + 0.5) / 2 * BINS - 0.5
        return np.interp(at, np.arange(BINS), self.levels)


def equations(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's sums: the upper triangle of the normal matrix, and at row -1 the right side."""
    m = len(model.mean) + model.omega.shape[1] + 1
    gram, right, rows = np.zeros((m, m)), np.zeros(m), 0
    for batch in batches:
        z = model.design(matrix(batch.column(0)))
        gram += z.T @ z
        right += z.T @ batch.column(1).to_numpy().astype(np.float64)
        rows += len(z)
    if rows:
        i, j = np.triu_indices(m)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i, np.full(m, -1)), pa.int32()), pa.array(np.append(j, np.arange(m)), pa.int32()), pa.array(np.append(gram[i, j], right))], names=["i", "j", "v"]
        )


def binned(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, good = np.zeros(BINS), np.zeros(BINS)
    for batch in batches:
        b = model.bins(matrix(batch.column(0)))
        n += np.bincount(b, minlength=BINS)
        good += np.bincount(b, batch.column(1).to_numpy().astype(np.float64), minlength=BINS)
    keep = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array(n[keep]), pa.array(good[keep])], names=["bin", "n", "good"])


def scored(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(matrix(batch.column(1))))], names=["doc_id", "score"])


def isotonic(n: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Non-decreasing levels for all bins by pooling adjacent violators; bins without rows are interpolated."""
    used = np.flatnonzero(n > 0)
    blocks: list[list[float]] = []  # weight, sum, bins
    for k in used:
        blocks.append([n[k], good[k], 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, s, c = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + s, blocks[-1][2] + c]
    level = np.concatenate([np.full(int(c), (s + 0.5) / (w + 1)) for w, s, c in blocks])
    return np.interp(np.arange(len(n)), used, np.maximum.accumulate(level))


def fit(stats: DataFrame, labels: DataFrame, seed: int = 7) -> Model | None:
    """Fit on all rows of ``labels`` (doc_id, label): none left out, none collected."""
    rows = labels.where("doc_id is not null and label is not null").join(stats, "doc_id").select("stats", F.col("label").cast("double").alias("label"), F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(10)).alias("fold"))
    rows = table(rows, "quality-train")
    width = 4 + len(CLASSES) - 1 + 3 + 6
    agg = [f(F.get("stats", F.lit(k))).alias(f"{name}{k}") for k in range(width) for name, f in (("m", F.avg), ("s", F.stddev_pop))]
    first = rows.agg(F.count(F.lit(1)).alias("n"), *agg).first()
    if not first["n"]:
        return None
    rng = np.random.default_rng(seed)
    scale = np.array([first[f"s{k}"] for k in range(width)])
    model = Model(np.array([first[f"m{k}"] for k in range(width)]), np.where(scale > 1e-9, scale, 1), rng.normal(size=(width, FEATURES)) / (WIDTH * np.sqrt(width)), rng.uniform(0, 2 * np.pi, FEATURES))
    learn = rows.where(~F.col("fold").isin(*CALIBRATION)).select("stats", "label")
    sums = learn.mapInArrow(lambda b: equations(model, b), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    m = width + FEATURES + 1
    gram, right = np.zeros((m, m)), np.zeros(m)
    of = sums["i"].to_numpy() >= 0
    i, j, v = (sums[c].to_numpy() for c in "ijv")
    gram[i[of], j[of]] = v[of]
    right[j[~of]] = v[~of]
    gram = np.triu(gram) + np.triu(gram, 1).T
    penalty = RIDGE * max(gram[0, 0], 1) * np.ones(m)
    penalty[0] = 1e-9
    model.weights = np.linalg.solve(gram + np.diag(penalty), right)
    held = rows.where(F.col("fold").isin(*CALIBRATION)).select("stats", "label")
    if held.isEmpty():
        held = learn
    counts = held.mapInArrow(lambda b: binned(model, b), "bin int, n double, good double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).toPandas()
    n, good = np.zeros(BINS), np.zeros(BINS)
    n[counts["bin"]], good[counts["bin"]] = counts["n"], counts["good"]
    model.levels = isotonic(n, good)
    return model


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(id_col.cast("string")) % folds


def filtered(model: Model, column: int, threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose text scores at least the threshold, as they are."""
    for batch in batches:
        for chunk in chunks(batch.column(column)):
            keep = model.score(statistics(chunk).astype(np.float64)) >= threshold
            yield batch.slice(chunk.first, chunk.docs).filter(pa.array(keep))


def accepted(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns; without usable labels all rows.

    Texts are read twice, to fit and to filter, and not shuffled.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = fit(table(rows.mapInArrow(stats_of, STATS), "quality-stats"), labels)
    if model is None:
        return docs
    column = docs.columns.index(text_col)
    return docs.mapInArrow(lambda b: filtered(model, column, threshold, b), docs.schema)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every document by a model fitted on ``labels`` (doc_id, label)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    stats = table(rows.mapInArrow(stats_of, STATS), "quality-stats")
    model = fit(stats, labels)
    if model is None:
        return stats.select("doc_id", F.lit(0.5).alias("score"))
    return stats.mapInArrow(lambda b: scored(model, b), "doc_id long, score double")


def training_labels(labels: DataFrame, column: str, folds: int, held: int) -> DataFrame:
    """(doc_id, label) of the rows that a model may learn from."""
    return labels.where(fold(F.col("doc_id"), folds) != held).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("label"))


def decide(scores: DataFrame, folds: int, held: int) -> DataFrame:
    out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    return scores.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *[c for c in scores.columns if c not in ("doc_id", "score")])
