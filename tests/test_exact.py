"""The exact sum against rational arithmetic."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest

from velograde.functions.exact import exact_sum


def nearest(values):
    total = sum(map(Fraction, values))
    try:
        return total.numerator / total.denominator
    except OverflowError:
        return math.inf if total > 0 else -math.inf


def columns():
    rng = random.Random(7)
    yield [1e16, 1.0, -1e16]
    yield [1.0, 2.0**-53, 2.0**-106]
    yield [5e-324] * 3 + [2.2250738585072014e-308]
    yield [1.7976931348623157e308] * 2 + [-1.7976931348623157e308]
    yield [1.7976931348623157e308] * 2
    yield [0.1] * 10 + [-0.0]
    yield [0.0, -0.0]
    for _ in range(12):
        yield [rng.choice((-1, 1)) * math.ldexp(rng.random(), rng.randrange(-1070, 1020)) for _ in range(rng.randrange(1, 60))]
        yield [math.ldexp(rng.getrandbits(53), rng.choice((-31, -32, -33, 0, 31, 32, 33))) * rng.choice((-1, 1)) for _ in range(200)]


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_the_rounded_rational_sum(spark, parts):
    cases = list(columns())
    rows = [(k, x) for k, values in enumerate(cases) for x in values]
    random.Random(parts).shuffle(rows)
    got = {r.k: r.v for r in exact_sum(spark.createDataFrame(rows, "k int, v double").repartition(parts), ("k",), "v").collect()}
    assert got == {k: nearest(values) for k, values in enumerate(cases)}


def test_odd_values(spark):
    inf, nan = math.inf, math.nan
    rows = [("null", None), ("nan", nan), ("nan", 1.0), ("both", inf), ("both", -inf), ("up", inf), ("up", 1.0), ("down", -inf), (None, 2.0), (None, None)]
    got = {r.k: r.v for r in exact_sum(spark.createDataFrame(rows, "k string, v double"), ("k",), "v").collect()}
    assert got["null"] is None and math.isnan(got["nan"]) and math.isnan(got["both"]) and got["up"] == inf and got["down"] == -inf and got[None] == 2.0
    assert exact_sum(spark.createDataFrame([], "k string, v double"), ("k",), "v").collect() == []
    assert [r.v for r in exact_sum(spark.createDataFrame([], "v double"), (), "v").collect()] == [None]
