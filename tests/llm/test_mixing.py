"""The mixture: targets by water filling, what is taken, positions by integration."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from velograde.llm import mixing

DOCS = "rank int, doc_id long, source string, text string, taken int"


def docs_of(spark, rows):
    return spark.createDataFrame([(1, i, s, t, 2) for i, s, t in rows], DOCS)


def filled(sizes, cap=3, weights=(5, 2, 1)):
    """Targets by sharing the excess again until none is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        share = left / sum(w[s] for s in open_)
        over = {s for s in open_ if target[s] + share * w[s] >= cap * sizes[s]}
        if not over:
            for s in open_:
                target[s] += share * w[s]
            break
        for s in over:
            left -= cap * sizes[s] - target[s]
            target[s] = cap * sizes[s]
        open_ -= over
    return target


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_what_is_taken(spark, seed):
    rng = random.Random(seed)
    sources = rng.sample(["a", "B", "é", "zz", "b", "", None], rng.randint(2, 7))
    rows = [(k, rng.choice(sources[: 1 + k % len(sources)]), " ".join(["w"] * rng.randint(1, 12))) for k in range(1200)]
    got = mixing.mix(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = filled(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        assert (r["position"] is None) == (r["taken"] == 0) and (r["position"] is None or 0 <= r["position"] <= 1)
        taken[r["source"]] += r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= 12, s
    again = mixing.mix(docs_of(spark, rows).repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"], r["position"]) for r in again if r["position"]) == sorted((r["doc_id"], r["taken"], r["position"]) for r in got if r["position"])


def test_positions_invert_the_integrated_schedule(spark):
    rows = [(s, k / 50) for s in (-0.9, -0.5, 0.0, 0.5, 0.9) for k in range(51)]
    got = spark.createDataFrame(rows, "slope double, share double").select("slope", "share", mixing.demand_inverse(F.col("share"), F.col("slope")).alias("t")).collect()
    for r in got:
        # Numerical integral of 1 + slope * (2t - 1) up to t.
        n = 4000
        total = sum(1 + r["slope"] * (2 * (k + 0.5) * r["t"] / n - 1) for k in range(n)) * r["t"] / n
        assert total == pytest.approx(r["share"], abs=1e-6)


def test_passes_follow_the_curriculum(spark):
    rng = random.Random(7)
    rows = [(k, rng.choice("ab"), "w " * rng.randint(1, 9)) for k in range(300)]
    mixed = {r["doc_id"]: r["repeats"] for r in mixing.mix(docs_of(spark, rows)).collect()}
    p = mixing.passes(docs_of(spark, rows))
    got = p.collect()
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)
    count = {}
    for r in got:
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    assert count == {k: n for k, n in mixed.items() if n}
    assert p.columns[:5] == ["rank", "doc_id", "source", "text", "taken"]


def test_large_documents_neither_block_nor_fill_a_source(spark):
    rows = [(k, "a", "w " * 40) for k in range(15)] + [(100, "c", "w " * 600)] + [(200 + k, "c", "w") for k in range(400)]
    of = [r for r in mixing.mix(docs_of(spark, rows), weights=(5.0, 0.8)).collect() if r["source"] == "c"]
    assert 0 < of[0]["target"] < 600 and abs(sum(r["taken"] for r in of) - of[0]["target"]) <= 1
    rows = [(k, "a", "w " * 300) for k in range(50)] + [(100 + k, "c", "w " * (20 + 7 * k)) for k in range(50)]
    of = [r for r in mixing.mix(docs_of(spark, rows), weights=(5.0, 0.2)).collect() if r["source"] == "c"]
    kept = [r["size"] for r in of if r["repeats"]]
    assert kept and min(kept) < max(r["size"] for r in of) / 2


def test_odd_tables(spark):
    rows = [(1, "a", None), (2, "a", ""), (None, "a", "one two"), (None, None, "x"), (3, None, " "), (4, "b", "w " * 40_000), (1, "a", "again and again"), (1, "a", "again and again")]
    got = mixing.mix(docs_of(spark, rows)).collect()
    assert len(got) == len(rows) and sum(r["size"] for r in got) == 40_000 + 2 + 1 + 6
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert [(r["target"], r["taken"]) for r in mixing.mix(docs_of(spark, [(1, "a", None), (2, "b", " ")])).collect()] == [(0.0, 0), (0.0, 0)]
