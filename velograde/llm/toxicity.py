"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters in one of two states. Training tokens are labelled from
the documents' labels: a token of a toxic document is toxic if its word or one of its
prefixes is tied to toxic documents by their counts. The field (hashed features
of the word, its prefixes and its neighbours; transitions) is fitted on segments
by stochastic gradients of its log-likelihood. Forward-backward gives each token's
marginal; a document's score is a calibrated function of them, and runs of
likely tokens are its offending offsets.

The fit uses a bounded sample of labelled rows (``SAMPLE_TOXIC`` and
``SAMPLE_CLEAN`` rows, about, by a hash of the id); scoring covers all rows and whole texts.

Both ends of a text count as the clean state. With two states, the ratio of the
forward messages follows a fractional-linear recursion, whose steps compose: all
blocks of 64 tokens of a chunk are composed at once, the blocks of a document are
chained, and the messages inside the blocks follow. So a long document takes a few hundred
vector operations and not one per token.

Defined cases: a null or empty text, or one without letters, has no tokens and gets the score of
a document without toxic tokens; null ids are scored but match no label; repeated rows are scored each;
without toxic labels every score is 0; an empty table yields no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velograde.llm.textbytes import LETTER, Chunk, chunks, mix
from velograde.shipping import ship

U = np.uint64
#: Labelled rows of each kind that the fit reads, about.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1200, 2000
#: Lengths in bytes of the prefixes that are features.
PREFIXES = (4, 5, 6, 7)
BITS = 18
SEGMENT, BLOCK = 48, 64
#: The fit reads all segments of its sample that hold tied tokens, and of the others so many for each of these (or for each of so many, if there are fewer).
SAMPLE_PLAIN, PLAIN_LEAST = 3, 500
EPOCHS, RATE, DECAY = 12, 0.3, 1e-6
#: A feature labels tokens if so many toxic documents have it and such a share of its documents is toxic.
SEED_DOCS, SEED_SHARE = 5, 0.7
#: A token with this marginal belongs to a span.
SPAN = 0.5


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each token, where each document's tokens begin, and hashes [tokens, word and prefixes]."""
    starts, ends = chunk.runs(LETTER[chunk.data])
    of = chunk.owner_bounds(starts)
    h = chunk.hasher(lower=True)
    columns = [h(starts, ends)]
    for k in PREFIXES:
        columns.append(mix(h(starts, np.minimum(ends, starts + k)) + U(k)))
    return starts, ends, of, np.column_stack(columns) if len(starts) else np.zeros((0, 1 + len(PREFIXES)), U)


def slots(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Slots of the weight table: word, prefixes, the word before and the word after."""
    own = (hashes >> U(64 - BITS)).astype(np.int32)
    before = np.zeros(len(own), np.int32)
    after = np.zeros(len(own), np.int32)
    if len(own):
        side = lambda h, salt: (mix(h ^ U(salt)) >> U(64 - BITS)).astype(np.int32)
        before[1:] = side(hashes[:-1, 0], 0xB1)
        after[:-1] = side(hashes[1:, 0], 0xA7)
        inner = of[:-1][np.diff(of) > 0]
        before[inner] = 0
        after[np.append(inner[1:], len(own)) - 1] = 0
    return np.column_stack([own, before, after])


def ratios(g: np.ndarray, bounds: np.ndarray, t: np.ndarray) -> np.ndarray:
    """x[i] = g[i] * (t01 + t11 x[i-1]) / (t00 + t10 x[i-1]) in each sequence, from x = 0 before it."""
    counts = np.diff(bounds)
    blocks = -(-counts // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    place = np.arange(len(g)) + np.repeat(first[:-1] * BLOCK - bounds[:-1], counts)
    padded = np.ones(first[-1] * BLOCK)
    padded[place] = g
    rows = np.ascontiguousarray(padded.reshape(-1, BLOCK).T)
    (t00, t01), (t10, t11) = t
    many = len(counts) and blocks.max() > 1
    enter = np.zeros(first[-1])
    if many:
        a, b, c, d = np.ones(first[-1]), np.zeros(first[-1]), np.zeros(first[-1]), np.ones(first[-1])
        for row in rows:
            a, b, c, d = t00 * a + t10 * c, t00 * b + t10 * d, row * (t01 * a + t11 * c), row * (t01 * b + t11 * d)
            top = 1 / np.maximum(np.maximum(a, b), np.maximum(c, d))
            a, b, c, d = a * top, b * top, c * top, d * top
        order = np.argsort(-blocks, kind="stable")
        live = blocks[order]
        at, x = first[:-1][order], np.zeros(len(order))
        for k in range(int(live[0]) - 1):
            live_now = int(np.searchsorted(-live, -(k + 1), "left"))
            now = at[:live_now] + k
            x = np.minimum((c[now] + d[now] * x[:live_now]) / (a[now] + b[now] * x[:live_now]), 1e30)
            enter[now + 1] = x
    out = np.empty_like(rows)
    x = enter
    for k, row in enumerate(rows):
        x = np.minimum(row * (t01 + t11 * x) / (t00 + t10 * x), 1e30)
        out[k] = x
    return out.T.reshape(-1)[place]


def marginals(emission: np.ndarray, bounds: np.ndarray, log_t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chance of the toxic state of each token, and the forward and backward ratios."""
    g, t = np.exp(np.clip(emission, -30, 30)), np.exp(log_t)
    forward = ratios(g, bounds, t)
    back = ratios(g[::-1], len(g) - bounds[::-1], t.T)[::-1]
    q = forward * (back / g)
    return q / (1 + q), forward, back / g


@dataclass
class Field:
    """Weights of the toxic state, transitions (clean, toxic) to (clean, toxic), and the calibration."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS))
    bias: float = -4.0
    log_t: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: np.ndarray | None = None

    def emission(self, at: np.ndarray) -> np.ndarray:
        return self.weights[at].sum(1) + self.bias

    def tokens(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, of, hashes = features(chunk)
        return starts, ends, of, marginals(self.emission(slots(hashes, of)), of, self.log_t)[0]

    def score(self, summary: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary @ self.calibration, -30, 30)))


def summary(p: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Per document: intercept, logarithm of the expected toxic tokens, largest marginal, likely tokens up to 5."""
    docs = len(of) - 1
    owner = np.repeat(np.arange(docs), np.diff(of))
    mass = np.bincount(owner, p, docs)
    top = np.zeros(docs)
    np.maximum.at(top, owner[p > 0.01], p[p > 0.01])
    likely = np.bincount(owner[p >= SPAN], minlength=docs)
    return np.column_stack([np.ones(docs), np.log(mass + 0.01), top, np.minimum(likely, 5)])


def seeds(hashes: np.ndarray, of: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Whether each token has a feature that is tied to toxic documents, by counts of documents."""
    owner = np.repeat(np.arange(len(toxic)), np.diff(of))
    tied = np.zeros(len(owner), bool)
    for k in range(hashes.shape[1]):
        _, which = np.unique(hashes[:, k], return_inverse=True)
        pair = np.unique(which * len(toxic) + owner)
        feature, doc = pair // len(toxic), pair % len(toxic)
        bad = np.bincount(feature, toxic[doc])
        share = np.bincount(feature, toxic[doc] * weight[doc]) / np.bincount(feature, weight[doc])
        tied |= ((bad >= SEED_DOCS) & (share >= SEED_SHARE))[which]
    return tied


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray, seed: int = 1) -> Field:
    """Fit on whole texts; weight: how many rows each stands for."""
    parts = [features(c) for c in chunks(pa.array(texts, pa.large_string()))]
    hashes = np.concatenate([x[3] for x in parts])
    of = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[2]) for x in parts]))])
    owner = np.repeat(np.arange(len(toxic)), np.diff(of))
    tied = seeds(hashes, of, toxic, weight)
    at = slots(hashes, of)
    del hashes, parts
    label = tied & (toxic[owner] > 0)
    # Segments that hold tied tokens, of either kind of document, and a bounded sample of the others.
    length = np.diff(of)
    cuts = -(-length // SEGMENT)
    starts = np.repeat(of[:-1], cuts) + SEGMENT * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    stops = np.minimum(starts + SEGMENT, np.repeat(of[1:], cuts))
    sums = np.concatenate([[0], np.cumsum(tied)])
    hit = sums[stops] > sums[starts]
    rng = np.random.default_rng(seed)
    rest = np.flatnonzero(~hit)
    chosen = np.concatenate([np.flatnonzero(hit), rng.choice(rest, min(len(rest), SAMPLE_PLAIN * max(int(hit.sum()), PLAIN_LEAST)), replace=False)])
    model = Field()
    squares, t_squares, b_square = np.full(1 << BITS, 1e-6), np.full((2, 2), 1e-6), 1e-6
    for _ in range(EPOCHS):
        rng.shuffle(chosen)
        for part in np.array_split(chosen, max(1, len(chosen) // 1000)):
            n = stops[part] - starts[part]
            bounds = np.concatenate([[0], np.cumsum(n)])
            ids = np.arange(bounds[-1]) + np.repeat(starts[part] - bounds[:-1], n)
            x, y = at[ids], label[ids].astype(float)
            emission = model.emission(x)
            p, forward, back = marginals(emission, bounds, model.log_t)
            step = (p - y) / len(part)
            slope = np.bincount(x.reshape(-1), np.repeat(step, x.shape[1]), 1 << BITS) + DECAY * model.weights
            squares += slope**2
            model.weights -= RATE * slope / np.sqrt(squares)
            b_square += step.sum() ** 2
            model.bias -= RATE * step.sum() / np.sqrt(b_square)
            # Transitions: expected minus observed pairs of states, the clean ends left out.
            later = np.ones(len(ids), bool)
            later[bounds[:-1]] = False
            k = np.flatnonzero(later)
            g, t = np.exp(np.clip(emission, -30, 30)), np.exp(model.log_t)
            prev = np.stack([np.ones(len(k)), forward[k - 1]])
            this = np.stack([np.ones(len(k)), g[k] * back[k]])
            joint = prev[:, None] * t[:, :, None] * this[None]
            joint /= joint.sum((0, 1))
            seen = np.stack([1 - y, y])
            observed = seen[:, None, k - 1] * seen[None, :, k]
            t_slope = (joint - observed).sum(2) / len(part)
            t_squares += t_slope**2
            model.log_t = np.clip(model.log_t - 0.1 * RATE * t_slope / np.sqrt(t_squares), -3, 3)
    model.calibration = calibrate(summary(marginals(model.emission(at), of, model.log_t)[0], of), toxic, weight)
    return model


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps, with a small ridge."""
    w = np.zeros(x.shape[1])
    weight = weight / weight.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 0.1 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w - np.linalg.solve(curve, slope)
    return w


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and weights of the sample: about the bound of each kind, by a hash of the id."""
    labels = labels.where("doc_id is not null and label is not null").select("doc_id", (F.col("label") > 0).cast("int").alias("label"))
    count = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    share = {k: min(1.0, most / max(1, count.get(k, 0))) for k, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) / 1e6
    # The sample's size is a parameter, so it may be broadcast.
    some = labels.where(draw < F.when(F.col("label") == 1, share[1]).otherwise(share[0]))
    rows = docs.join(F.broadcast(some), "doc_id").orderBy("doc_id", "text").collect()
    toxic = np.array([r["label"] for r in rows], float)
    return [r["text"] or "" for r in rows], toxic, np.where(toxic > 0, 1 / share[1], 1 / share[0])


SCORED = "doc_id long, score double, spans array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def scored(model: Field, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column(1)):
            starts, ends, of, p = model.tokens(chunk)
            owner = np.repeat(np.arange(chunk.docs), np.diff(of))
            likely = np.flatnonzero(p >= SPAN)
            # Neighbouring likely tokens of one document are one span.
            new = np.ones(len(likely), bool)
            new[1:] = (np.diff(likely) > 1) | (np.diff(owner[likely]) > 0)
            begin = likely[new]
            end = likely[np.append(np.flatnonzero(new)[1:], len(likely)) - 1] if len(likely) else likely
            points = chunk.code_points()
            base = points[chunk.bounds[:-1]][owner[begin]]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[begin], minlength=chunk.docs))])
            spans = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(points[starts[begin]] - base, pa.int32()), pa.array(points[ends[end]] - base, pa.int32())], fields=list(_SPANS.value_type))
            )
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.docs), pa.array(model.score(summary(p, of))), spans], names=["doc_id", "score", "spans"])


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, spans) of every document; labels: (doc_id, label) to learn from."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts, toxic, weight = sample(rows, labels)
    if not toxic.any():
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    # The weight table has a fixed size.
    model = spark.sparkContext.broadcast(fit(texts, toxic, weight))
    return rows.mapInArrow(lambda b: scored(model.value, b), SCORED)
