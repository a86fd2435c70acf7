"""Profiles with null and tied samples, lookups at all kinds of distances, smoothing over distance."""

from __future__ import annotations

import math
import random

import pytest

from velograde.operators import profiles, quality
from velograde.sources import writers

SCHEMA = "edge_id string, sample_idx int, x_m double, y_m double, elevation_m double, crs string, structure_status string, elevation_dataset string, step string, last int"
GOOD = ("EPSG:2154", "normal", "terrain model", "own", 7)


def samples(spark, rows):
    return spark.createDataFrame([(*r, *GOOD) if len(r) == 5 else (*r, *GOOD[-2:]) for r in rows], SCHEMA)


def test_reasons_for_nulls_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        ("ok", 0, 0.0, 0.0, 1.0), ("ok", 1, 10.0, 0.0, 1.5),
        ("crs", 0, 0.0, 0.0, 1.0, None, "normal", "terrain"), ("crs", 1, 10.0, 0.0, 1.0, "EPSG:2154", "normal", "terrain"),
        ("x", 0, 0.0, 0.0, 1.0), ("x", 1, None, 0.0, 1.0), ("x", 2, 20.0, 0.0, 1.0),
        ("y", 0, 0.0, 0.0, 1.0), ("y", 1, 10.0, inf, 1.0),
        ("z", 0, 0.0, 0.0, 1.0), ("z", 1, 10.0, 0.0, nan),
        ("tie", 0, 0.0, 0.0, 1.0), ("tie", 0, 10.0, 0.0, 1.0),
        ("noidx", None, 0.0, 0.0, 1.0), ("noidx", 1, 10.0, 0.0, 1.0),
        ("deck", 0, 0.0, 0.0, 1.0, "EPSG:2154", None, "terrain"), ("deck", 1, 10.0, 0.0, 1.0, "EPSG:2154", "normal", "other"),
        ("one", 0, 0.0, 0.0, 1.0), (None, 0, 0.0, 0.0, 1.0), (None, 1, 10.0, 0.0, 1.0),
    ]
    found = {r.edge_id: (r.reject_reason, r.segment) for r in profiles.rejects(samples(spark, rows)).collect()}
    assert found == {
        "ok": (None, None), None: (None, None), "crs": ("reference_system", None), "x": ("missing_coordinates", 0), "y": ("missing_coordinates", 0), "z": ("missing_elevation", 0),
        "tie": ("repeated_sample", 0), "noidx": ("repeated_sample", 0), "deck": ("terrain_on_structure", None), "one": ("too_few_samples", None),
    }
    assert {r.edge_id for r in profiles.accepted(samples(spark, rows)).collect()} == {"ok", None}
    assert profiles.rejects(samples(spark, rows).limit(0)).collect() == []


def test_columns_of_the_input_stay(spark):
    rows = samples(spark, [("a", 0, 0.0, 0.0, 1.0), ("a", 1, 3.0, 4.0, 1.5)])
    chained = profiles.with_chainage(rows)
    assert [(r.step, r.last, r.chainage_m) for r in chained.orderBy("sample_idx").collect()] == [("own", 7, 0.0), ("own", 7, 5.0)]
    assert {(r.step, r.last, r.chainage_m) for r in profiles.reverse(chained).collect()} == {("own", 7, 0.0), ("own", 7, 5.0)}
    numbered = rows.withColumnRenamed("step", "at").withColumnRenamed("last", "of")
    assert profiles.stride_sample(numbered, "edge_id", "sample_idx").columns == numbered.columns


def test_lookup_equals_the_condition(spark):
    rng = random.Random(3)
    lines = [(e, s, rng.choice([0.0, 1.0, 2.5, 7.0]), rng.random()) for e in "abc" for s in range(12)]
    asked = [(e, d) for e in "abcx" for d in [-1.0, 0.0, 1.0, 2.5, 3.5, 1e9, None, float("nan"), *[rng.uniform(0, 40) for _ in range(20)]]] + [("a", 1.0)]
    ends = {}
    for e, s, length, _ in lines:
        begin = ends[e][-1][1] if e in ends else 0.0
        ends.setdefault(e, []).append((begin, begin + length, s))
    for e in "abc":
        asked += [(e, b) for _, b, _ in ends[e]]
    want = sorted((e, d, s) for e, d in asked if d is not None for a, b, s in ends.get(e, []) if a <= d and (d < b or (s == 11 and d == b)))
    got = profiles.lookup(spark.createDataFrame(lines, "edge_id string, segment int, length_m double, grade_ratio double"), spark.createDataFrame(asked, "edge_id string, distance_m double"), "length_m")
    assert sorted((r.edge_id, r.distance_m, r.segment) for r in got.collect()) == want


def test_smoothing_over_distance(spark):
    rng = random.Random(4)
    rows = [("e", i, float(x), 0.0, z) for i, x in enumerate(sorted(rng.sample(range(500), 40))) for z in [rng.choice([None, float("nan"), *[rng.uniform(0, 9)] * 8])]]
    got = {r.sample_idx: r.smoothed_m for r in profiles.smoothed(samples(spark, rows), 33.0, "mean 33 m").collect()}
    start = rows[0][2]
    for i, (_, _, x, _, z) in enumerate(rows):
        known = z is not None and not math.isnan(z)
        near = [w for _, _, u, _, w in rows if abs((u - start) - (x - start)) <= 33.0 and w is not None and not math.isnan(w)]
        want = None if not known else z if i in (0, 39) else sum(near) / len(near)
        assert got[i] == (want if want is None else pytest.approx(want))
    with pytest.raises(ValueError):
        profiles.smoothed(samples(spark, rows), 0.0, "none")


def test_tables_of_what_is_missing_and_markdown(spark):
    table = quality.not_available(spark, {"b": "no source", "a": "out of scope"})
    assert [tuple(r) for r in table.orderBy("item").collect()] == [("a", "out of scope"), ("b", "no source")]
    assert writers.markdown(table.orderBy("item"), "Gaps") == "# Gaps\n\n| item | status |\n|---|---|\n| a | out of scope |\n| b | no source |\n"
    with pytest.raises(ValueError, match="more than 1 rows"):
        writers.markdown(table, "Gaps", 1)


def test_smoothing_sorts_an_edge_twice(spark):
    """Once in the order of samples and once in that of chainage."""
    samples = spark.createDataFrame([(1, k, 10.0 * k, 0.0, float(k)) for k in range(3)], "edge_id long, sample_idx int, x_m double, y_m double, elevation_m double")
    plan = profiles.smoothed(samples, 15.0, "s")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 2
