"""Classifiers: the field's marginals by brute force, held-out accuracy, odd inputs."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from velograde.llm import quality, toxicity
from velograde.llm.textbytes import chunks

LABELS = "doc_id long, label int"
DOCS = "extra string, doc_id long, score double, text string"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    log_t = np.array([[0.4, -0.8], [-0.2, 0.6]])
    bounds = np.array([0, 5, 5, 6, 14])
    s = rng.normal(-0.5, 1.5, 14)
    p = toxicity.marginals(s, bounds, log_t)[0]
    for a, b in itertools.pairwise(bounds):
        total, hits = 0.0, np.zeros(b - a)
        for states in itertools.product((0, 1), repeat=int(b - a)):
            path = (0, *states, 0)
            w = np.exp(sum(log_t[x, y] for x, y in itertools.pairwise(path)) + sum(s[a + k] for k, y in enumerate(states) if y))
            total += w
            hits += w * np.array(states)
        if b > a:
            assert np.allclose(hits / total, p[a:b])


def test_long_sequences_do_not_depend_on_blocks():
    rng = np.random.default_rng(4)
    s, log_t = rng.normal(-1, 2, 1000), np.array([[0.3, -1.0], [-0.5, 0.8]])
    one = toxicity.marginals(s, np.array([0, 1000]), log_t)[0]
    block, toxicity.BLOCK = toxicity.BLOCK, 7
    try:
        assert np.allclose(one, toxicity.marginals(s, np.array([0, 1000]), log_t)[0])
    finally:
        toxicity.BLOCK = block


WORDS = ["river", "stone", "window", "garden", "letter", "morning", "paper", "silver", "table", "yellow"]


def corpus(n=400):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for k in range(n):
        words = list(rng.choice(WORDS, rng.integers(5, 60)))
        bad = k % 4 == 0
        if bad:
            words[int(rng.integers(len(words)))] = "scumbag" + "abc"[k % 3]
        rows.append(("x", k, 0.0, " ".join(words) + "."))
        labels.append((k, int(bad)))
    return rows, labels


def test_toxic_words_are_found_with_their_offsets(spark):
    rows, labels = corpus()
    odd = [("x", 1000, 0.0, None), ("x", 1001, 0.0, ""), ("x", None, 0.0, "a SCUMBAGA é scumbagb"), ("x", 1002, 0.0, "1234 --- !!"), ("x", 1003, 0.0, "river " * 30_000 + "scumbagc"), ("x", 1001, 0.0, "")]
    docs = spark.createDataFrame(rows + odd, DOCS)
    train = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 3 != 1]
    found = quality.decide(toxicity.score(docs, spark.createDataFrame(train, LABELS)), 3, 1).collect()
    assert len(found) == len(rows) + len(odd)
    held = [r for r in found if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1000]
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.97
    by = {r["doc_id"]: r for r in found}
    assert by[1000]["score"] == by[1001]["score"] == by[1002]["score"] < 0.3 and by[1000]["spans"] == []
    assert [(s["start"], s["end"]) for s in by[None]["spans"]] == [(2, 10), (13, 21)] and by[None]["predicted"] == 1
    assert [(s["start"], s["end"]) for s in by[1003]["spans"]] == [(180_000, 180_008)] and not by[None]["held_out"]


def test_toxicity_without_labels_or_documents(spark):
    empty = spark.createDataFrame([], LABELS)
    assert toxicity.score(spark.createDataFrame([("x", 1, 0.0, "a b")], DOCS), empty).first()["score"] == 0.0
    assert toxicity.score(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, 1)], LABELS)).count() == 0


def test_statistics_of_known_text():
    x = quality.statistics(next(chunks(pa.array(["AB ab\nab ab!", None, ""]))))
    assert x.shape[0] == 3 and np.isfinite(x).all() and not x[1:].any()
    assert x[0, 0] == pytest.approx(np.log1p(4)) and x[0, 1] == pytest.approx(np.log1p(2))


def test_isotonic_is_the_least_squares_fit():
    n, good = np.array([2.0, 0, 1, 4, 3, 1]), np.array([1.0, 0, 0, 4, 1, 1])
    level = quality.isotonic(n, good)
    assert (np.diff(level) >= 0).all()
    # Bins 0 and 2 pool, then 3 and 4 do.
    assert level[0] == level[2] == pytest.approx(1.5 / 4) and level[3] == level[4] == pytest.approx(5.5 / 8)


def test_quality_separates_junk_and_keeps_order(spark):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for k in range(600):
        words = list(rng.choice(WORDS, rng.integers(8, 50)))
        good = k % 5 != 0
        text = " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!$$" for w in words)
        rows.append(("x", k, 0.0, text))
        labels.append((k, int(good)))
    odd = [("x", 2000, 0.0, None), ("x", 2000, 0.0, None), ("x", 2001, 0.0, ""), ("x", None, 0.0, "Paper river stone.")]
    docs = spark.createDataFrame(rows + odd, DOCS)
    train = quality.training_labels(spark.createDataFrame([*labels, (None, 1)], "doc_id long, quality int"), "quality", 4, 2)
    found = quality.decide(quality.score(docs, train), 4, 2).collect()
    assert len(found) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"] and r["doc_id"] < 1000]
    assert len(held) > 100 and all((r["doc_id"] % 5 != 0) == (r["predicted"] == 1) for r in held)
    kept = quality.accepted(docs, train)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {k for k in range(600) if k % 5}


def test_quality_without_labels_or_documents(spark):
    none = spark.createDataFrame([], LABELS)
    docs = spark.createDataFrame([("x", 1, 0.0, "a b")], DOCS)
    assert quality.score(docs, none).first()["score"] == 0.5 and quality.accepted(docs, none).count() == 1
    assert quality.score(spark.createDataFrame([], DOCS), none).count() == 0
