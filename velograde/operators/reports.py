"""Report tables of profile runs and of live reconstructions.

Each is a plan over the operators' outputs; nothing is collected but the one-row
summary of an extraction. Defined cases: empty inputs give empty tables (and a summary of zeros);
null measures stay null; edges that cannot be simulated keep their statistics, with null times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velograde.functions.physics import Scenario, scenarios
from velograde.operators import edges, profiles, simulate
from velograde.sources import writers

#: Columns of the reports.
TIMES = ("elapsed_time_s", "moving_time_s", "first_below_threshold_time_s", "first_zero_speed_time_s", "qualified_stop_time_s", "stationary_time_s")
BENCHMARK = ("scenario", "variant", "time_step_s", "rotating_equivalent_mass_kg", "elapsed_time_s", "distance_m", "final_speed_m_s", "completed_route", "stop_reason")
#: Limits of live profiles, whose points are closer than those of frozen edges.
LIVE_LIMITS = {"max_grade": 1.0, "max_jump_m": 100.0}
#: What a review of structures says.
REVIEW_STATUS, REVIEW_DECISION = "catalogue discovered; compact object match pending", "review_required"


def benchmark(runs: DataFrame) -> DataFrame:
    """The nine columns of a benchmark of runs (run_id, pos, scenario, variant, profile, parameters), in the order of ``pos``, three values at 9 decimals."""
    done = simulate.simulate(runs).select("run_id", "elapsed_time_s", "distance_m", "final_speed_m_s", "completed_route", "stop_reason")
    rows = runs.select("run_id", "pos", "scenario", "variant", "time_step_s", "rotating_equivalent_mass_kg").join(done, "run_id")
    return writers.fixed(rows.orderBy("pos").select(*BENCHMARK), ["elapsed_time_s", "distance_m", "final_speed_m_s"])


def by_scenario(runs: DataFrame) -> DataFrame:
    """(scenario, first, runs): runs (pos, scenario, ...) grouped by scenario, groups in the order of their first run, members in theirs.

    A group is the variants of one scenario: parameters, a few rows by design.
    """
    member = F.struct("pos", *[c for c in runs.columns if c not in ("pos", "scenario")])
    grouped = runs.groupBy("scenario").agg(F.min("pos").alias("first"), F.array_sort(F.collect_list(member)).alias("runs"))
    return grouped.orderBy("first")


def pick(runs: DataFrame, condition) -> DataFrame:
    """The first run, by ``pos``, of which the condition holds; none is an error of the job."""
    best = runs.where(condition).agg(F.min_by(F.struct(*runs.columns), "pos").alias("x"))
    found = F.when(F.col("x").isNull(), F.raise_error(F.lit("no such run"))).otherwise(F.col("x"))
    return best.select(found.alias("x")).select("x.*")


def profile_simulations(samples: DataFrame, scenario: Scenario = Scenario()) -> DataFrame:  # noqa: B008
    """(edge_id, times, stop_reason) of the edges off no structure, under one scenario; refused edges have no row."""
    usable = profiles.accepted(samples.where("structure_status = 'normal'"))
    runs = simulate.with_scenarios(profiles.packed(usable), scenarios(samples.sparkSession, scenario))
    done = simulate.simulate(runs)
    return runs.select("run_id", "edge_id").join(done, "run_id").select("edge_id", *TIMES, "stop_reason")


def live_points(chosen: DataFrame, answers, spacings=edges.SPACINGS_M) -> DataFrame:
    """Points of chosen edges at each spacing with elevations; ``answers`` gives the answers to a table of requests."""
    points = edges.densify(edges.at_spacings(chosen, spacings), F.col("spacing_m"))
    return edges.with_elevations(points, answers(edges.elevation_batches(points)))


def profile_table(points: DataFrame, retrieved_at: str, source: str = "live") -> DataFrame:
    """Points of live profiles under the columns of their files, to be written by edge and spacing."""
    return points.select(
        "edge_id", "spacing_m", "idx", F.lit(source).alias("source"), F.lit(retrieved_at).alias("retrieved_at"), "chainage_m", F.col("lon").alias("longitude"), F.col("lat").alias("latitude"),
        F.col("x_m").alias("x_epsg2154_m"), F.col("y_m").alias("y_epsg2154_m"), F.col("elevation_m").alias("elevation_rge_alti_m"),
    )


def write_profiles(points: DataFrame, path: str, retrieved_at: str) -> None:
    """A folder of CSV files per edge and spacing, the points of each in one file and in order."""
    rows = profile_table(points, retrieved_at).repartition("edge_id", "spacing_m").sortWithinPartitions("edge_id", "spacing_m", "idx")
    writers.csv(rows.drop("idx"), path, single=False, partition_by=("edge_id", "spacing_m"))


def sampling_comparison(points: DataFrame, chosen: DataFrame, retrieved_at: str, source: str = "live", scenario: Scenario = Scenario()) -> DataFrame:  # noqa: B008
    """Per chosen edge (edge_id, way_id, tags, ...) and spacing: statistics of the profile, times of a run on it, road class and surface.

    Edges of which a profile is refused have no row for it. Edge and spacing are one key from here on: one shuffle for segments and statistics.
    """
    key = F.concat_ws("@", "edge_id", F.format_string("%.3f", "spacing_m"))
    own = points.select(key.alias("key"), "edge_id", "spacing_m").distinct()
    as_samples = points.select(key.alias("edge_id"), F.col("idx").alias("sample_idx"), "x_m", "y_m", "elevation_m", F.lit(profiles.CRS).alias("crs"), F.lit("normal").alias("structure_status"), F.lit("terrain model").alias("elevation_dataset"))
    found = profiles.accepted(as_samples, **LIVE_LIMITS)
    stats = profiles.statistics(found).withColumnRenamed("edge_id", "key")
    runs = simulate.with_scenarios(profiles.packed(found), scenarios(points.sparkSession, scenario))
    times = runs.select("run_id", F.col("edge_id").alias("key")).join(simulate.simulate(runs), "run_id").select("key", *TIMES, "stop_reason")
    tag = lambda name: F.coalesce(F.try_element_at("tags", F.lit(name)), F.lit("")).alias(name)
    about = chosen.select("edge_id", F.col("way_id").alias("osm_way_id"), tag("highway"), tag("surface"))
    rows = own.join(stats, "key").join(times, "key", "left").join(about, "edge_id")
    return rows.select(
        F.lit(source).alias("source"), F.lit(retrieved_at).alias("retrieved_at"), "osm_way_id", "edge_id", "spacing_m", "horizontal_length_m", "travelled_length_m", F.col("elevation_change_m").alias("net_dz_m"), "ascent_m", "descent_m",
        F.col("min_grade").alias("min_grade_ratio"), F.col("grade_q05").alias("q05_grade_ratio"), F.col("grade_median").alias("median_grade_ratio"), F.col("grade_q95").alias("q95_grade_ratio"), F.col("max_grade").alias("max_grade_ratio"),
        "anomaly_count", "elapsed_time_s", "moving_time_s", "stationary_time_s", "first_below_threshold_time_s", "first_zero_speed_time_s", "qualified_stop_time_s", "stop_reason", "highway", "surface",
    )


def graph_quality(directed: DataFrame, source: str = "live") -> DataFrame:
    """Source, way, direction, access and structure of each directed edge."""
    return directed.select(F.lit(source).alias("source"), "edge_id", F.col("way_id").alias("osm_way_id"), "direction", F.col("access_status").alias("access"), F.col("structure_status").alias("structure"))


def tag_text() -> "F.Column":
    """Tags as JSON in the order of keys, a blank after commas and colons, ASCII only where the tags are."""
    quoted = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"^\[(.*)\]$", 1)
    return F.concat(F.lit("{"), F.array_join(F.transform(edges.sorted_tags(), lambda t: F.concat(quoted(t["key"]), F.lit(": "), quoted(t["value"]))), ", "), F.lit("}"))


def structure_decisions(directed: DataFrame, source: str = "live") -> DataFrame:
    """Edges off the ground, each to be reviewed, with their tags."""
    off = directed.where("structure_status <> 'normal'")
    return off.select(F.lit(source).alias("source"), F.col("way_id").alias("osm_way_id"), F.col("structure_status").alias("structure"), tag_text().alias("osm_tags"), F.lit(REVIEW_STATUS).alias("bd_topo_status"), F.lit(REVIEW_DECISION).alias("decision"))


def extraction_counts(directed: DataFrame, chosen: DataFrame, restrictions: DataFrame) -> DataFrame:
    """One row: directed_edges, selected_profile_edges, restriction_relations (of a table with their number)."""
    one = directed.agg(F.count(F.lit(1)).alias("directed_edges"))
    # Three tables of one row each.
    return one.crossJoin(chosen.agg(F.count(F.lit(1)).alias("selected_profile_edges"))).crossJoin(restrictions.select(F.col("relations").alias("restriction_relations")))


def extraction_summary(counts: DataFrame, about: dict) -> dict:
    """The summary of an extraction: what is known of the request and its answer, and the counts; for canonical JSON."""
    return {**about, **counts.first().asDict()}


def with_fixture(manifest: dict, held: DataFrame, path: str) -> dict:
    """A manifest with the path, size and digest of the file that stands for its downloads, by name among those that are held."""
    row = held.where(F.col("filename") == path.rsplit("/", 1)[-1]).first()
    if row is None:
        raise FileNotFoundError(path)
    return {**manifest, "fixture": {"path": path, "bytes": row["bytes"], "sha256": row["actual"]}}


def data_manifest(about: dict, summary: dict, files: DataFrame, limitations: list[str], most: int = 100_000) -> dict:
    """What a reconstruction read and made, with the new files (filename, bytes, actual) by name; more than ``most`` are an error, not a cut."""
    rows = files.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} files")
    listed = [{"name": r["filename"], "bytes": r["bytes"], "sha256": r["actual"]} for r in sorted(rows, key=lambda r: r["filename"])]
    return {**about, "osm": summary, "altimetry_cache_files": listed, "limitations": limitations}


def write_text(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file through Spark's file systems."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(data)
    finally:
        out.close()


def write_live(spark: SparkSession, folder: str, points: DataFrame, chosen: DataFrame, directed: DataFrame, restrictions: DataFrame, retrieved_at: str, about: dict, new_files: DataFrame, limitations: list[str]) -> None:
    """All reports of a reconstruction in one folder, published all or none; the comparison under both of its names."""

    def write(staged: str) -> None:
        write_profiles(points, f"{staged}/profiles", retrieved_at)
        compared = sampling_comparison(points, chosen, retrieved_at).orderBy("edge_id", "spacing_m")
        # Written once and copied: both files have the same bytes.
        writers.csv(compared, f"{staged}/sampling_comparison.csv", crlf=True)
        writers.copy(spark, f"{staged}/sampling_comparison.csv", f"{staged}/profile_simulations.csv")
        writers.csv(graph_quality(directed.orderBy("pos")), f"{staged}/graph_quality.csv")
        writers.csv(structure_decisions(directed.orderBy("pos")), f"{staged}/structure_review.csv")
        summary = extraction_summary(extraction_counts(directed, chosen, restrictions), {"source": "live", "retrieved_at": retrieved_at, **about})
        write_text(spark, f"{staged}/osm_extraction_summary.json", writers.canonical_json(summary))
        manifest = data_manifest({"source": "live", "retrieved_at": retrieved_at}, summary, new_files, limitations)
        write_text(spark, f"{staged}/data_manifest.json", writers.canonical_json(manifest))

    writers.publish(spark, folder, write)
