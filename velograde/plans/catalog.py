"""Every registered query of the road-profile engine, with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velograde.functions import classify, exact, physics
from velograde.functions.geometry import lambert93
from velograde.operators import edges, profiles, quality, reports, simulate
from velograde.plans import derive, oracle, route_queries
from velograde.sources import readers

read = derive.read


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.segments(derive.samples(spark, sf_dir))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.profile_lines(spark, sf_dir)


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.packed(_lines(spark, sf_dir), "length_m")


def profile_segments(spark, sf_dir):
    """Consecutive samples as segments."""
    s = _segments(spark, sf_dir)
    return s.withColumns({c: F.round(c, 9) for c in ("angle_rad", "travelled_length_m")})


def chainage(spark, sf_dir):
    """Running planar distance of the samples."""
    return profiles.with_chainage(derive.samples(spark, sf_dir)).select("edge_id", "sample_idx", "chainage_m")


def edge_reverse(spark, sf_dir):
    """Edges in the other direction."""
    return profiles.reverse(profiles.with_chainage(derive.samples(spark, sf_dir))).select("edge_id", "sample_idx", "x_m", "y_m", "elevation_m", "chainage_m")


def profile_points(spark, sf_dir):
    """Running kilometres and relative elevation."""
    return profiles.points(_lines(spark, sf_dir), "length_m")


def segment_ends(spark, sf_dir):
    """Where segments begin and end along their edge."""
    return profiles.with_ends(_lines(spark, sf_dir), "length_m").select("edge_id", "segment", "start_m", "end_m")


def segment_lookup(spark, sf_dir):
    """The segment at every 25 m of each edge, the beginning included."""
    lines = _lines(spark, sf_dir)
    total = lines.groupBy("edge_id").agg(F.sum("length_m").alias("total"))
    asked = total.select("edge_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("total") / 25).cast("int"))).alias("k")).select("edge_id", (F.col("k") * 25.0).alias("distance_m"))
    return profiles.lookup(lines, asked, "length_m")


def acceleration_grid(spark, sf_dir):
    """Acceleration of each line's grade at five speeds under three winds."""
    lines = _lines(spark, sf_dir)
    winds = physics.scenarios(spark, *[physics.Scenario(f"wind{w:g}", along_route_wind_m_s=w) for w in (-3.0, 0.0, 3.0)])
    speeds = spark.createDataFrame([(v,) for v in (0.0, 1.0, 4.0, 8.0, 16.0)], "speed_m_s double")
    rows = lines.select("grade_ratio").distinct().crossJoin(F.broadcast(winds)).crossJoin(F.broadcast(speeds))
    return rows.select("scenario_id", "grade_ratio", "speed_m_s", physics.acceleration_m_s2(F.col("speed_m_s"), F.col("grade_ratio")).alias("acceleration_m_s2"))


def projected_points(spark, sf_dir):
    """Polyline points in metres."""
    pts = derive.polylines(spark, sf_dir).select("edge_id", F.posexplode("geometry").alias("i", "p"))
    q = lambert93(F.col("p.lon"), F.col("p.lat"))
    return pts.withColumn("q", q).select("edge_id", "i", F.round("q.x", 3).alias("x_m"), F.round("q.y", 3).alias("y_m"))


def densified(spark, sf_dir):
    """Polylines with a point every 25 m at most."""
    d = edges.densify(derive.polylines(spark, sf_dir), 25.0)
    return d.select("edge_id", "idx", *[F.round(c, n).alias(c) for c, n in (("lon", 8), ("lat", 8), ("x_m", 2), ("y_m", 2), ("chainage_m", 2))])


def spacing_comparison(spark, sf_dir):
    """Points and length of each polyline at four spacings."""
    both = edges.at_spacings(derive.polylines(spark, sf_dir))
    d = edges.densify(both, F.col("spacing_m"))
    return d.groupBy("edge_id", "spacing_m").agg(F.count(F.lit(1)).alias("points"), F.round(F.max("chainage_m"), 2).alias("length_m"))


def elevation_requests(spark, sf_dir):
    """Batches of 200 points of the polylines at 10 m, as they would be requested."""
    d = edges.densify(derive.polylines(spark, sf_dir), 10.0)
    return edges.elevation_batches(d).select("edge_id", "batch", "points")


def way_classes(spark, sf_dir):
    """Access, structure and directions of each way."""
    tags = F.col("tags")
    return derive.ways(spark, sf_dir).select(F.col("id").alias("way_id"), classify.access(tags).alias("access_status"), classify.structure(tags).alias("structure_status"), F.array_join(classify.directions(tags), ",").alias("directions"))


def directed_edges(spark, sf_dir):
    """Ways as directed edges."""
    d = edges.directed(derive.ways(spark, sf_dir))
    tags = F.array_join(F.transform(edges.sorted_tags(), lambda t: F.concat_ws("=", t["key"], t["value"])), ";")
    return d.select("edge_id", "way_id", "direction", "access_status", "structure_status", tags.alias("tags"), F.col("geometry")[0]["lon"].alias("first_lon"))


def selected_edges(spark, sf_dir):
    """The first four usable edges in input order."""
    return edges.select(edges.directed(derive.ways(spark, sf_dir)), 4, low_m=10.0).select("edge_id", "way_id", F.round("length_m", 2).alias("length_m"))


def structure_review(spark, sf_dir):
    """Edges off the ground with their tags as JSON."""
    return quality.structure_review(edges.directed(derive.ways(spark, sf_dir)))


def _edge_rows(spark, sf_dir):
    return derive.samples(spark, sf_dir).groupBy("edge_id").agg(F.first("access_status").alias("access_status"), F.first("structure_status").alias("structure_status"))


def edge_quality(spark, sf_dir):
    """Access, structure, simulability and flags of each edge."""
    return quality.edge_quality(_edge_rows(spark, sf_dir))


def uncertain_edges(spark, sf_dir):
    """Edges whose roadway elevation is unknown."""
    return quality.uncertain_edges(_edge_rows(spark, sf_dir))


def validation_rejects(spark, sf_dir):
    """Why edges are refused."""
    return profiles.rejects(derive.samples(spark, sf_dir, flawed=True)).where("reject_reason is not null")


def accepted_segments(spark, sf_dir):
    """Segments of the edges that are not refused, counted."""
    return profiles.accepted(derive.samples(spark, sf_dir, flawed=True)).groupBy("edge_id").agg(F.count(F.lit(1)).alias("segments"), F.round(F.sum("travelled_length_m"), 6).alias("length_m"))


def profile_statistics(spark, sf_dir):
    """Lengths, climb, grade range and quantiles of each profile."""
    s = profiles.statistics(_segments(spark, sf_dir).where("dz_m is not null"))
    return s.select("edge_id", "anomaly_count", "min_grade", "max_grade", *[F.round(c, 6).alias(c) for c in ("horizontal_length_m", "travelled_length_m", "elevation_change_m", "ascent_m", "descent_m", "grade_q05", "grade_median", "grade_q95")])


def distinct_profiles(spark, sf_dir):
    """Distinct profiles by value, with how many edges have each."""
    p = _profiles(spark, sf_dir)
    key = F.array_join(F.transform("profile", lambda s: F.concat_ws(":", F.format_string("%.2f", s["length_m"]), F.format_string("%.2f", s["grade_ratio"] + 0.0))), ";")
    return p.groupBy(F.sha2(key, 256).alias("profile_sha256")).agg(F.count(F.lit(1)).alias("edges"), F.min("edge_id").alias("first_edge"))


def bounding_box(spark, sf_dir):
    """The box around all samples."""
    s = derive.samples(spark, sf_dir)
    return s.agg(F.min("x_m").alias("min_x"), F.max("x_m").alias("max_x"), F.min("y_m").alias("min_y"), F.max("y_m").alias("max_y"), F.min("elevation_m").alias("min_z"), F.max("elevation_m").alias("max_z"))


def stride_sample(spark, sf_dir):
    """Each edge's samples thinned to about three, the last one kept."""
    return profiles.stride_sample(derive.samples(spark, sf_dir), "edge_id", "sample_idx", 3).select("edge_id", "sample_idx", "x_m")


def manifest_check(spark, sf_dir):
    """Digests of documents against a manifest with gaps and wrong entries."""
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("filename"), "doc_id", F.sha2("text", 256).alias("digest"))
    wrong = F.sha2(F.lit("wrong"), 256)
    listed = docs.select("filename", F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 7 == 0, wrong).otherwise(F.col("digest")).alias("sha256"))
    held = docs.where("doc_id % 11 <> 0").select("filename", F.col("digest").alias("actual"))
    return readers.verify(listed, held)


def unit_conversions(spark, sf_dir):
    """Kilometres, kilometres per hour and percentages of the lines."""
    lines = _lines(spark, sf_dir)
    g = F.col("grade_ratio")
    return lines.select("edge_id", "segment", physics.km(F.col("length_m")).alias("length_km"), physics.km_h(F.col("length_m") / 10.0).alias("speed_km_h"), physics.percent(g).alias("grade_percent"), physics.grade_percent_to_ratio(physics.percent(g)).alias("grade_back"), F.round(physics.grade_ratio_to_angle_rad(g), 9).alias("angle_rad"))


def _summary(spark, sf_dir, scenarios):
    s = simulate.simulate(simulate.with_scenarios(_profiles(spark, sf_dir), scenarios))
    return s


ROUNDED = ("elapsed_time_s", "distance_m", "final_speed_m_s", "moving_time_s", "first_below_threshold_time_s", "first_zero_speed_time_s", "qualified_stop_time_s", "stationary_time_s")


def simulate_summary(spark, sf_dir):
    """Every edge coasted under the default scenario with a coarse step."""
    s = _summary(spark, sf_dir, derive.coarse(spark))
    return s.select("run_id", "completed_route", "stop_reason", *[F.round(c, 6).alias(c) for c in ROUNDED])


def stop_reason_counts(spark, sf_dir):
    """How runs end."""
    return _summary(spark, sf_dir, derive.coarse(spark)).groupBy("stop_reason").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("elapsed_time_s"), 4).alias("mean_time_s"))


def sensitivity_grid(spark, sf_dir):
    """Every edge under 12 scenarios, summed up per scenario."""
    s = _summary(spark, sf_dir, derive.grid(spark)).withColumn("scenario_id", F.element_at(F.split("run_id", "/"), 2))
    return s.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("runs"), F.count_if("completed_route").alias("completed"), F.round(F.avg("elapsed_time_s"), 6).alias("mean_time_s"))


def rotation_effect(spark, sf_dir):
    """The time that rotating mass adds on each edge."""
    both = physics.scenarios(spark, physics.Scenario("on"), physics.Scenario("off", rotating_equivalent_mass_kg=0.0))
    s = _summary(spark, sf_dir, both).select(F.split("run_id", "/").alias("r"), "elapsed_time_s").select(F.col("r")[0].cast("long").alias("edge_id"), F.col("r")[1].alias("scenario_id"), "elapsed_time_s")
    at = lambda name: F.max(F.when(F.col("scenario_id") == name, F.col("elapsed_time_s")))
    return s.groupBy("edge_id").agg(F.round(at("on") - at("off"), 6).alias("added_s"))


def simulate_trace(spark, sf_dir):
    """All points of the runs under the coarse scenario."""
    s = simulate.simulate(simulate.with_scenarios(_profiles(spark, sf_dir), derive.coarse(spark)), "trace")
    return s.select("run_id", "step", *[F.round(c, 6).alias(c) for c in ("time_s", "distance_m", "speed_m_s")])


def scenario_rejects(spark, sf_dir):
    """Why runs are refused, under a good scenario and seven wrong ones, one of them for each kind of rule."""
    return simulate.rejects(simulate.with_scenarios(_profiles(spark, sf_dir), derive.refused(spark)))


def elevation_profiles(spark, sf_dir):
    """Points of the polylines at 10 m with elevations from the answers to their requests; some answers are too long."""
    points = edges.densify(derive.polylines(spark, sf_dir), 10.0)
    batches = edges.elevation_batches(points)
    last = F.col("points") - F.when(F.col("edge_id") % 13 == 5, 0).otherwise(1)
    values = F.transform(F.sequence(F.lit(0), last), lambda i: 100.0 + (F.col("batch") * 200 + i) % 7)
    answers = batches.withColumn("elevations", readers.decode_elevations(F.to_json(F.struct(values.alias("elevations"))), F.col("points")))
    return edges.with_elevations(points, answers).select("edge_id", "idx", "elevation_m")


def chosen_edges(spark, sf_dir):
    """Directed edges, marked where they are among the selected ones."""
    directed = edges.directed(derive.ways(spark, sf_dir))
    return edges.marked(directed.select("edge_id", "way_id"), edges.select(directed, 4, low_m=10.0))


def new_files(spark, sf_dir):
    """Documents as files that a run added to those that were held."""
    after = read(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("filename"), "doc_id")
    return readers.new_files(after.where("doc_id % 3 <> 0"), after).select("filename")


def _live(spark, sf_dir):
    """The first eight usable edges, and their points at four spacings with elevations that fall along the edge."""
    chosen = edges.select(edges.directed(derive.ways(spark, sf_dir)), 8)
    last = F.col("points") - 1
    values = F.transform(F.sequence(F.lit(0), last), lambda i: 1000.0 - (F.col("batch") * 200 + i) * F.col("spacing_m") * 0.03 + ((F.col("batch") * 200 + i) % 3) * 0.05)
    points = reports.live_points(chosen, lambda asked: asked.withColumn("elevations", readers.decode_elevations(F.to_json(F.struct(values.alias("elevations"))), F.col("points"))))
    return chosen, points


def live_profiles(spark, sf_dir):
    """Points of live profiles as they are written."""
    rows = reports.profile_table(_live(spark, sf_dir)[1], "2026-01-01")
    return rows.select("edge_id", "spacing_m", "idx", "source", "retrieved_at", *[F.round(c, n).alias(c) for c, n in (("chainage_m", 2), ("longitude", 8), ("latitude", 8), ("x_epsg2154_m", 2), ("y_epsg2154_m", 2), ("elevation_rge_alti_m", 6))])


def sampling_comparison(spark, sf_dir):
    """Statistics and a run of the profiles of chosen edges at four spacings."""
    chosen, points = _live(spark, sf_dir)
    rows = reports.sampling_comparison(points, chosen, "2026-01-01")
    return rows.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


def profile_simulations(spark, sf_dir):
    """Times of the default run on each edge that holds, with a coarse step."""
    samples = derive.samples(spark, sf_dir)
    rows = reports.profile_simulations(samples, physics.Scenario("coarse", time_step_s=0.5, max_time_s=120.0))
    return rows.select("edge_id", "stop_reason", *[F.round(c, 6).alias(c) for c in reports.TIMES])


def graph_quality(spark, sf_dir):
    """Directed edges as a report."""
    return reports.graph_quality(edges.directed(derive.ways(spark, sf_dir)))


def structure_decisions(spark, sf_dir):
    """Edges off the ground as a report."""
    return reports.structure_decisions(edges.directed(derive.ways(spark, sf_dir)))


def extraction_counts(spark, sf_dir):
    """The counts of a summary; every seventh event stands for a restriction."""
    directed = edges.directed(derive.ways(spark, sf_dir))
    relations = derive.ways(spark, sf_dir).where("id % 7 = 0").agg(F.count(F.lit(1)).alias("relations"))
    return reports.extraction_counts(directed, edges.select(directed, 8), relations)


def scenario_groups(spark, sf_dir):
    """Scenarios of the grid by mass, in the order of the first of each."""
    runs = derive.grid(spark).select("rider_mass_kg", "rolling_resistance_coefficient", "along_route_wind_m_s")
    pos = F.when(F.col("rider_mass_kg") == 75, 0).when(F.col("rider_mass_kg") == 60, 10).otherwise(20) + F.when(F.col("along_route_wind_m_s") > 0, 1).otherwise(0) + F.when(F.col("rolling_resistance_coefficient") > 0.005, 2).otherwise(0)
    grouped = reports.by_scenario(runs.select(F.format_string("m%.0f", "rider_mass_kg").alias("scenario"), pos.alias("pos"), F.col("along_route_wind_m_s").alias("wind")))
    return grouped.select("scenario", "first", F.array_join(F.transform("runs", lambda r: F.format_string("%d:%.0f", r["pos"], r["wind"])), ";").alias("runs"))


def smoothed_profiles(spark, sf_dir):
    """Elevations and their means over 61.7 m either way along the edge."""
    rows = profiles.smoothed(derive.samples(spark, sf_dir), 61.7, "mean 61.7 m")
    return rows.select("edge_id", "sample_idx", "scenario", *[F.round(c, 6).alias(c) for c in ("chainage_m", "elevation_m", "smoothed_m")])


def exact_totals(spark, sf_dir):
    """Sums per day and flag of numbers of very different size, most of which cancel."""
    line = read(spark, sf_dir, "lineitem")
    large = F.pow(F.lit(2.0), (40 + F.col("l_orderkey") % 20).cast("double")) * F.col("l_linenumber")
    values = F.array(F.round(F.col("l_extendedprice") * 100) / F.lit(1048576.0), large, -large)
    rows = line.select("l_returnflag", F.col("l_shipdate").cast("date").cast("string").alias("day"), F.explode(values).alias("total"))
    return exact.exact_sum(rows, ("l_returnflag", "day"), "total")


def quality_rollup(spark, sf_dir):
    """Directed edges and their lengths by road class, structure and access, with all totals."""
    directed = edges.directed(derive.ways(spark, sf_dir))
    rows = directed.select(F.try_element_at("tags", F.lit("highway")).alias("highway"), F.col("structure_status").alias("structure"), F.col("access_status").alias("access"), "structure_status", (F.col("way_id") % 97 + 100).alias("dm"))
    return quality.rollup(rows, ("highway", "structure", "access"), "dm").withColumnRenamed("length", "length_dm")


def _wide(query):
    """The query with its integers as 64-bit ones, as DuckDB has them."""

    def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.select(*[F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])

    wide.__name__, wide.__doc__ = query.__name__, query.__doc__
    return wide


QUERIES = {
    f.__name__: _wide(f)
    for f in (
        profile_segments, chainage, edge_reverse, profile_points, segment_ends, segment_lookup, acceleration_grid, projected_points, densified, spacing_comparison,
        elevation_requests, way_classes, directed_edges, selected_edges, structure_review, edge_quality, uncertain_edges, validation_rejects, accepted_segments, profile_statistics,
        distinct_profiles, bounding_box, stride_sample, manifest_check, unit_conversions, simulate_summary, stop_reason_counts, sensitivity_grid, rotation_effect, simulate_trace,
        scenario_rejects, elevation_profiles, chosen_edges, new_files, live_profiles, sampling_comparison, profile_simulations, graph_quality, structure_decisions, extraction_counts, scenario_groups,
        smoothed_profiles, exact_totals, quality_rollup,
    )
} | {name: _wide(f) for name, f in route_queries.QUERIES.items()}
ORACLE_SQL: dict[str, str] = oracle.SQL | route_queries.SQL
