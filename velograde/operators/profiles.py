"""Road profiles from sampled edges: windows over an edge's samples in order.

Long form throughout: (edge_id, sample_idx, ...) in, (edge_id, segment, ...)
out. Everything of an edge is in one partition after one shuffle on ``edge_id``;
operators on the same key reuse it.

Defined cases: samples of one edge and index stand in the order of x, y and elevation, and :func:`rejects` names the edge
(``repeated_sample``), as it does for a missing index; samples of null edge ids are one edge; a null or non-finite coordinate gives null or
non-finite measures, and a reason; empty tables give empty tables; columns that an operator adds for itself take free names, and other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velograde.functions.physics import finite
from velograde.sources.scratch import unused

#: A segment must be longer than this; larger jumps and grades are refused.
LEAST_DX_M, MAX_JUMP_M, MAX_GRADE = 1e-9, 20.0, 0.5
CRS = "EPSG:2154"


def _ordered():
    return W.partitionBy("edge_id").orderBy("sample_idx", "x_m", "y_m", "elevation_m")


def with_chainage(samples: DataFrame) -> DataFrame:
    """Add ``chainage_m``: the running planar distance along the edge."""
    w = _ordered()
    step = F.coalesce(F.hypot(F.col("x_m") - F.lag("x_m").over(w), F.col("y_m") - F.lag("y_m").over(w)), F.lit(0.0))
    own = unused("step", samples.columns)
    return samples.withColumn(own, step).withColumn("chainage_m", F.sum(own).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop(own)


def segments(samples: DataFrame) -> DataFrame:
    """(edge_id, segment, horizontal_length_m, dz_m, grade_ratio, angle_rad, travelled_length_m) of consecutive samples.

    No guard is applied; a segment without length or elevation has null measures.
    """
    return _pairs(samples).drop("repeated")


def _pairs(samples: DataFrame) -> DataFrame:
    """The segments, with ``repeated``: whether the samples at its ends have one index, or one has none."""
    w = _ordered()
    ahead = lambda c: F.lead(c).over(w)
    pair = samples.select(
        "edge_id",
        (F.row_number().over(w) - 1).alias("segment"),
        F.hypot(ahead("x_m") - F.col("x_m"), ahead("y_m") - F.col("y_m")).alias("horizontal_length_m"),
        (ahead("elevation_m") - F.col("elevation_m")).alias("dz_m"),
        F.coalesce(ahead("sample_idx") == F.col("sample_idx"), F.lit(True)).alias("repeated"),
        ahead(F.lit(1)).alias("next"),
    ).where("next is not null")
    grade = F.when(F.col("horizontal_length_m") > LEAST_DX_M, F.col("dz_m") / F.col("horizontal_length_m"))
    pair = pair.withColumn("grade_ratio", grade)
    return pair.select("edge_id", "segment", "horizontal_length_m", "dz_m", "grade_ratio", F.atan("grade_ratio").alias("angle_rad"), F.hypot("horizontal_length_m", "dz_m").alias("travelled_length_m"), "repeated")


def segment_error(max_grade: float = MAX_GRADE, max_jump_m: float = MAX_JUMP_M) -> Column:
    """Why a segment is refused, null if it is not."""
    dx, dz = F.col("horizontal_length_m"), F.col("dz_m")
    return (
        F.when(~finite(dx), "missing_coordinates")
        .when(~finite(dz), "missing_elevation")
        .when(dx <= LEAST_DX_M, "duplicate_point")
        .when(F.abs(dz) > max_jump_m, "elevation_jump")
        .when(F.abs(F.col("grade_ratio")) > max_grade, "extreme_grade")
    )


def rejects(samples: DataFrame, max_grade: float = MAX_GRADE, max_jump_m: float = MAX_JUMP_M) -> DataFrame:
    """(edge_id, reject_reason, segment): one row per edge; null reason for edges that hold.

    The edge's own rules come first (reference system, structure, number of samples), then the first refused segment. A rule on the
    edge holds for all its samples: one with another reference system, or none, refuses the edge.
    """
    off = (F.coalesce("structure_status", F.lit("unknown")) != "normal") & F.coalesce(F.col("elevation_dataset").startswith("terrain"), F.lit(False))
    edge = samples.groupBy("edge_id").agg(F.count_if(~F.col("crs").eqNullSafe(CRS)).alias("foreign"), F.count_if(off).alias("off"), F.count(F.lit(1)).alias("n"))
    error = F.when(F.col("repeated"), "repeated_sample").otherwise(segment_error(max_grade, max_jump_m))
    first = _pairs(samples).withColumn("error", error).where("error is not null")
    first = first.groupBy("edge_id").agg(F.min(F.struct("segment", "error")).alias("bad")).withColumnRenamed("edge_id", "of")
    own = F.when(F.col("foreign") > 0, "reference_system").when(F.col("off") > 0, "terrain_on_structure").when(F.col("n") < 2, "too_few_samples")
    joined = edge.join(first, F.col("edge_id").eqNullSafe(F.col("of")), "left")
    return joined.select("edge_id", F.coalesce(own, F.col("bad.error")).alias("reject_reason"), F.when(own.isNull(), F.col("bad.segment")).alias("segment"))


def accepted(samples: DataFrame, **limits) -> DataFrame:
    """The segments of edges that no rule refuses."""
    good = rejects(samples, **limits).where("reject_reason is null").select(F.col("edge_id").alias("of"))
    return segments(samples).join(good, F.col("edge_id").eqNullSafe(F.col("of")), "left_semi")


def strict(samples: DataFrame, **limits) -> DataFrame:
    """The segments; a refused edge fails the job."""
    checked = segments(samples).join(rejects(samples, **limits).select("edge_id", "reject_reason"), "edge_id")
    ok = F.when(F.col("reject_reason").isNotNull(), F.raise_error(F.concat(F.lit("edge "), F.col("edge_id").cast("string"), F.lit(": "), F.col("reject_reason")))).otherwise(F.lit(True))
    return checked.where(ok).drop("reject_reason")


def packed(found: DataFrame, length: str = "travelled_length_m") -> DataFrame:
    """(edge_id, profile): the segments of each edge in order, as one array. An edge is bounded by its geometry."""
    rows = F.array_sort(F.collect_list(F.struct("segment", F.col(length).alias("length_m"), "grade_ratio")))
    return found.groupBy("edge_id").agg(rows.alias("p")).select("edge_id", F.transform("p", lambda s: F.struct(s["length_m"].alias("length_m"), s["grade_ratio"].alias("grade_ratio"))).alias("profile"))


def with_ends(found: DataFrame, length: str = "travelled_length_m") -> DataFrame:
    """Add ``start_m`` and ``end_m``: the running distance along the edge; the last end is its length."""
    w = W.partitionBy("edge_id").orderBy("segment")
    end = F.sum(length).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return found.withColumn("end_m", end).withColumn("start_m", F.coalesce(F.lag("end_m").over(w), F.lit(0.0)))


def lookup(found: DataFrame, asked: DataFrame, length: str = "travelled_length_m") -> DataFrame:
    """(edge_id, distance_m, segment, grade_ratio): the segment at a distance.

    A boundary belongs to the next segment, the end to the last one; distances off the edge have no
    row, nor have null ones. As of: segments' beginnings and distances stand in one order, and each distance takes the last segment before it, so rows
    are read once whatever an edge holds of both.
    """
    w = W.partitionBy("edge_id")
    spans = with_ends(found, length).withColumn("last", F.max("segment").over(w) == F.col("segment"))
    span = F.struct("segment", "grade_ratio", "end_m", "last").alias("span")
    rows = spans.select("edge_id", F.col("start_m").alias("distance_m"), span, F.lit(False).alias("asked"))
    rows = rows.unionByName(asked.select("edge_id", "distance_m").where("distance_m is not null").withColumn("asked", F.lit(True)), allowMissingColumns=True)
    order = w.orderBy("distance_m", "asked", "span.segment").rowsBetween(W.unboundedPreceding, W.currentRow)
    at = rows.withColumn("at", F.last("span", ignorenulls=True).over(order)).where("asked")
    inside = (F.col("distance_m") < F.col("at.end_m")) | (F.col("at.last") & (F.col("distance_m") == F.col("at.end_m")))
    return at.where(inside).select("edge_id", "distance_m", "at.segment", "at.grade_ratio")


def smoothed(samples: DataFrame, half_window_m: float, scenario: str) -> DataFrame:
    """(edge_id, sample_idx, chainage_m, elevation_m, smoothed_m, scenario): the mean elevation of all samples within a distance along the edge.

    The scenario names the smoothing; the raw profile stays beside it. An edge's ends keep their elevation, so that edges still meet.
    Null and non-finite elevations do not count, and have none smoothed; a sample without a place along the edge keeps its own.
    """
    if not half_window_m > 0:
        raise ValueError("the window must be positive")
    known = F.when(finite(F.col("elevation_m")), F.col("elevation_m"))
    rows = with_chainage(samples.select("edge_id", "sample_idx", "x_m", "y_m", "elevation_m")).withColumn("known", known)
    # Windows in the order of samples come first, together: the edge is sorted once for them and once for the mean.
    w = _ordered()
    rows = rows.withColumn("inner", F.lag(F.lit(1)).over(w).isNotNull() & F.lead(F.lit(1)).over(w).isNotNull())
    mean = F.expr(f"avg(known) over (partition by edge_id order by chainage_m range between {half_window_m!r}D preceding and {half_window_m!r}D following)")
    inner = F.col("inner") & finite(F.col("chainage_m"))
    value = F.when(F.col("known").isNotNull(), F.when(inner, mean).otherwise(F.col("known")))
    return rows.select("edge_id", "sample_idx", "chainage_m", "elevation_m", value.alias("smoothed_m"), F.lit(scenario).alias("scenario"))


def reverse(samples: DataFrame) -> DataFrame:
    """Edges in the other direction: samples turned round, chainage from the other end, id marked."""
    last = F.max(F.struct("sample_idx", "chainage_m")).over(W.partitionBy("edge_id"))
    own = unused("last", samples.columns)
    columns = {"chainage_m": F.col(own)["chainage_m"] - F.col("chainage_m"), "sample_idx": F.col(own)["sample_idx"] - F.col("sample_idx"), "edge_id": F.concat(F.col("edge_id").cast("string"), F.lit(":reverse"))}
    return samples.withColumn(own, last).withColumns(columns).drop(own)


def points(found: DataFrame, length: str = "travelled_length_m") -> DataFrame:
    """(edge_id, segment, distance_km, elevation_m): running kilometres and relative elevation at segment ends, length taken as horizontal."""
    w = W.partitionBy("edge_id").orderBy("segment").rowsBetween(W.unboundedPreceding, W.currentRow)
    return found.select("edge_id", "segment", (F.sum(length).over(w) / 1000.0).alias("distance_km"), F.sum(F.col(length) * F.col("grade_ratio")).over(w).alias("elevation_m"))


def statistics(found: DataFrame, keys: tuple[str, ...] = ("edge_id",)) -> DataFrame:
    """Per profile: lengths, climb and descent, grade range and exact quantiles, number of anomalous grades.

    Exact percentiles hold an edge's grades in one task: bounded by its geometry.
    """
    dz, g = F.col("dz_m"), F.col("grade_ratio")
    return found.groupBy(*keys).agg(
        F.sum("horizontal_length_m").alias("horizontal_length_m"),
        F.sum("travelled_length_m").alias("travelled_length_m"),
        F.sum(dz).alias("elevation_change_m"),
        F.sum(F.greatest(F.lit(0.0), dz)).alias("ascent_m"),
        (-F.sum(F.least(F.lit(0.0), dz))).alias("descent_m"),
        F.min(g).alias("min_grade"),
        F.max(g).alias("max_grade"),
        F.percentile(g, F.lit(0.05)).alias("grade_q05"),
        F.percentile(g, F.lit(0.5)).alias("grade_median"),
        F.percentile(g, F.lit(0.95)).alias("grade_q95"),
        F.count_if(F.abs(g) > MAX_GRADE).alias("anomaly_count"),
    )


def stride_sample(trace: DataFrame, key: str, order: str, most: int = 2000) -> DataFrame:
    """Every n-th row of each series, about ``most`` of them, and the last: for charts."""
    w = W.partitionBy(key)
    at, n = unused("at", trace.columns), unused("of", trace.columns)
    numbered = trace.withColumns({at: F.row_number().over(w.orderBy(order)) - 1, n: F.count(F.lit(1)).over(w)})
    stride = F.greatest(F.lit(1).cast("long"), F.call_function("div", F.col(n), F.lit(most)))
    return numbered.where((F.pmod(F.col(at), stride) == 0) | (F.col(at) == F.col(n) - 1)).drop(at, n)
