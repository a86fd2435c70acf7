"""Collocations against counting by hand, across blocks, and with products beyond 64 bits."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from velograde.llm import collocations

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def by_hand(rows, least, percent, top):
    counts: dict[str, Counter] = {}
    for lang, text in rows:
        f = counts.setdefault(lang if lang is not None else "und", Counter())
        low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= percent * a for q, b in candidates.items()):
                continue
            s, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -s))
    return sorted(out)


def rows_of(rng, docs):
    words = ["the", "The", "of", "new", "york", "é", "É", "x\x00y", "日本", "a-b", "'s"]
    seps = [" ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b", " ", " ", " "]
    one = lambda: "".join(rng.choice(words[: rng.choice((3, 11))]) + rng.choice(seps) for _ in range(rng.randrange(40)))
    return [(rng.choice(["en", "en", "en", "de", None, "und", ""]), rng.choice([one(), one(), one(), "", None, " . "])) for _ in range(docs)]


@pytest.mark.parametrize(("seed", "block"), [(1, 4_000_000), (2, 300), (3, 300)])
def test_same_as_by_hand(spark, seed, block):
    rows = rows_of(random.Random(seed), 400)
    docs = spark.createDataFrame([(i, x, t, "c") for i, (x, t) in enumerate(rows)], "word long, lang string, text string, key string").repartition(3)
    for least, percent, top in ((3, 50, 2000), (10, 100, 7)):
        got = sorted(tuple(r[c] for c in COLUMNS) for r in collocations.phrases(docs, least, percent, top, block, 10 if seed == 3 else 1_000_000).collect())
        assert got == by_hand(rows, least, percent, top) and got


def test_empty_tables_and_rare_words(spark):
    docs = spark.createDataFrame([("en", "one two three"), ("de", None), (None, "")], "lang string, text string")
    assert collocations.phrases(docs.limit(0)).collect() == []
    assert collocations.phrases(docs).collect() == []


def test_a_repeated_word_is_counted_with_overlaps(spark):
    docs = spark.createDataFrame([("en", "ha " * 20_000)], "lang string, text string")
    got = [tuple(r[c] for c in COLUMNS) for r in collocations.phrases(docs).collect()]
    assert got == by_hand([("en", "ha " * 20_000)], 10, 50, 2000)


def test_scores_are_exact_beyond_64_bits(spark):
    cases = [(10**14 - 1, 10**14, 10**14 - 1), (999_999_999_999_999, 999_999_999_999_999, 999_999_999_999_999), (123_456_789_012, 987_654_321_098, 123_456_789_013), (10, 10, 10)]
    rows = spark.createDataFrame(cases, "a long, l long, r long")
    got = [r[0] for r in rows.select(collocations.score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [1_000_000 * a * a // (x * y) for a, x, y in cases]


def test_runs_over_batches_and_wide_ids():
    import numpy as np
    import pyarrow as pa

    ids = np.array([1, 1, 2, 2**40, 2**40, 2**40 + 1], np.int64)
    key = collocations.keys([ids, ids], 8)
    batches = [pa.RecordBatch.from_arrays([key.slice(i, 1), pa.array([2])], names=["key", "n"]) for i in range(6)]
    found = [(k.as_py(), f.as_py()) for b in collocations.summed(16, 4, iter(batches)) for k, f in zip(*b.columns, strict=True)]
    assert found == [(key[0].as_py(), 4), (key[3].as_py(), 4)]


def test_pairs_of_four_byte_ids_are_sorted_as_numbers():
    """Ids beyond 2**31 included, where packed numbers are negative; runs go on over batches."""
    import numpy as np
    import pyarrow as pa

    x, y = np.array([1, 1, 2**31, 2**31, 2**32 - 1]), np.array([2, 2, 7, 7, 2**32 - 1])
    key = collocations.packed(x, y)
    order = np.argsort(key.view(np.int64), kind="stable")
    batches = [pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)[i : i + 1]), pa.array([2])], names=["key", "n"]) for i in order]
    found = {(k.as_py(), f.as_py()) for b in collocations.summed_numbers(4, lambda k: collocations.keys(collocations.unpacked(k), 4), iter(batches)) for k, f in zip(*b.columns, strict=True)}
    want = collocations.keys([x, y], 4)
    assert found == {(want[0].as_py(), 4), (want[2].as_py(), 4)}
