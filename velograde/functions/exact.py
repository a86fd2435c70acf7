"""A correctly rounded sum of doubles, whatever their order, partitions and magnitudes.

A double is a whole number of 53 bits times a power of two. Numbers of one range of 32 powers, scaled by one power of two, are whole numbers of at most 86 bits;
their high and low halves are summed as decimals, exactly and with map-side partial sums. A key has at most 67 ranges. Its few
sums are added as one integer and rounded once, half to even.

Capacity: 10**13 values of a range and key; beyond it the decimals overflow and the job fails (in ANSI mode).

Defined cases: nulls do not count, and without values the sum is null; NaN, or infinities of both signs, give NaN, infinities of one sign
that infinity; zeros of either sign count as 0.0; a sum beyond the largest double is infinite; an empty table has no keys.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velograde.shipping import ship
from velograde.sources.scratch import unused

#: Powers of two of a range, and bits below its least power that a double can have.
RANGE, BELOW = 32, 53


def rounded(parts: list[tuple[int, int, int]]) -> float:
    """The sum of (range, high, low): high * 2**32 + low, in units of 2**(32 * range - 53), as the nearest double."""
    if not parts:
        return 0.0
    least = min(r for r, _, _ in parts)
    total = sum(((high << 32) + low) << (RANGE * (r - least)) for r, high, low in parts)
    power = RANGE * least - BELOW
    try:
        # Both divisions of integers are rounded correctly.
        return float(total << power) if power >= 0 else total / (1 << -power)
    except OverflowError:
        return float("inf") if total > 0 else float("-inf")


def exact_sum(rows: DataFrame, keys: tuple[str, ...], value: str, name: str | None = None) -> DataFrame:
    """(keys, name): the sum of a column per key (with no keys one row, also for an empty table), as if added without any rounding and then rounded once."""
    ship(rows.sparkSession)
    name = name or value
    x = F.col("x")
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    whole = rows.select(*keys, F.col(value).cast("double").alias(unused("x", list(keys))))
    if whole.columns[-1] != "x":
        raise ValueError("a key may not be named x")
    usual = x.isNotNull() & ~odd & (x != 0.0)
    # The range may be one too high or low where log2 is rounded: any choice near it is exact.
    bin_ = F.when(usual, F.floor(F.log2(F.abs(x)) / RANGE)).cast("int")
    power = F.lit(BELOW) - F.col("range") * RANGE
    half = F.floor(power / 2)
    scaled = x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)
    high = F.floor(F.col("scaled") / 2.0**32)
    part = whole.withColumn("range", bin_).withColumn("scaled", F.when(usual, scaled)).withColumn("high", high)
    low = (F.col("scaled") - F.col("high").cast("double") * 2.0**32).cast("long")
    wide = lambda c: F.sum(c.cast("decimal(20,0)"))
    flags = {"n": F.count("x"), "nan": F.count_if(F.isnan(x)), "up": F.count_if(x == float("inf")), "down": F.count_if(x == float("-inf"))}
    binned = part.groupBy(*keys, "range").agg(wide(F.col("high")).alias("high"), wide(low).alias("low"), *[c.alias(k) for k, c in flags.items()])
    parts = F.collect_list(F.when(F.col("range").isNotNull(), F.struct("range", F.col("high").cast("string").alias("high"), F.col("low").cast("string").alias("low"))))
    each = binned.groupBy(*keys).agg(parts.alias("parts"), *[F.sum(k).alias(k) for k in flags])

    @F.pandas_udf("double")
    def total(column: pd.Series) -> pd.Series:
        return column.map(lambda found: rounded([(p["range"], int(p["high"]), int(p["low"])) for p in found]))

    up, down = F.col("up") > 0, F.col("down") > 0
    result = F.when(F.col("n") > 0, F.when((F.col("nan") > 0) | (up & down), float("nan")).when(up, float("inf")).when(down, float("-inf")).otherwise(total("parts")))
    return each.select(*keys, result.alias(name))
