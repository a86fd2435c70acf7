"""Report tables: published figures end to end, fixed columns, files and digests."""

from __future__ import annotations

import csv
import json

import pytest
from pyspark.sql import functions as F

from velograde.functions.physics import PARAMETERS, Scenario
from velograde.operators import edges, profiles, reports
from velograde.sources import readers

#: Two frozen edges off no structure and one on a bridge, and the published run and segments of the first two.
FROZEN = {
    "oisans-normal-01": ("normal", "admissible", [[925000, 6450000, 1320], [925080, 6450030, 1312], [925160, 6450090, 1301], [925230, 6450180, 1294]]),
    "oisans-hairpin-02": ("normal", "review", [[925300, 6450200, 1405], [925340, 6450250, 1398], [925300, 6450300, 1390], [925245, 6450340, 1383]]),
    "oisans-bridge-review": ("bridge", "review", [[925500, 6450400, None], [925560, 6450440, None]]),
}
PUBLISHED_TIMES = {"oisans-normal-01": 27.459025157665906, "oisans-hairpin-02": 18.51648009564549}
PUBLISHED_SEGMENTS = [
    ("oisans-hairpin-02", 0, 64.03124237432849, -7.0, -0.10932163332202424, -0.10888922088042906, 64.41273166075166),
    ("oisans-hairpin-02", 1, 64.03124237432849, -8.0, -0.12493900951088485, -0.1242949419221493, 64.52906321960671),
    ("oisans-hairpin-02", 2, 68.00735254367721, -7.0, -0.1029300470931331, -0.10256883972843996, 68.36665854054884),
    ("oisans-normal-01", 0, 85.44003745317531, -8.0, -0.09363291775690445, -0.09336071773077506, 85.81375181169973),
    ("oisans-normal-01", 1, 100.0, -11.0, -0.11, -0.10955952677394434, 100.60318086422517),
    ("oisans-normal-01", 2, 114.0175425099138, -7.0, -0.061394061351492044, -0.06131709920115789, 114.23221962301179),
]
CROSSED = [(500.0, -0.04), (15.0, 0.025), (800.0, -0.012)]


@pytest.fixture
def frozen(tmp_path):
    listed = [{"id": k, "name": k, "structure": s, "access": a, "samples": p} for k, (s, a, p) in FROZEN.items()]
    path = tmp_path / "edges.json"
    path.write_text(json.dumps({"fixture_status": "x", "crs": "EPSG:2154", "geometry_source": "g", "elevation_source": "e", "edges": listed}))
    return path


def test_published_runs_and_segments(spark, frozen):
    samples = readers.edge_samples(spark, str(frozen))
    found = {r["edge_id"]: r for r in reports.profile_simulations(samples).collect()}
    assert set(found) == set(PUBLISHED_TIMES)
    for name, seconds in PUBLISHED_TIMES.items():
        r = found[name]
        assert r["elapsed_time_s"] == pytest.approx(seconds, abs=1e-6) and r["moving_time_s"] == pytest.approx(seconds, abs=1e-6)
        assert (r["first_below_threshold_time_s"], r["first_zero_speed_time_s"], r["qualified_stop_time_s"], r["stationary_time_s"], r["stop_reason"]) == (None, None, None, 0.0, "route_end")
    segments = [tuple(r) for r in profiles.accepted(samples.where("structure_status = 'normal'")).orderBy("edge_id", "segment").select("edge_id", "segment", "horizontal_length_m", "dz_m", "grade_ratio", "angle_rad", "travelled_length_m").collect()]
    assert [s[:2] for s in segments] == [s[:2] for s in PUBLISHED_SEGMENTS]
    for got, want in zip(segments, PUBLISHED_SEGMENTS, strict=True):
        assert got[2:] == pytest.approx(want[2:], rel=1e-12)
    assert reports.profile_simulations(samples.limit(0)).collect() == []


def bench_runs(spark):
    rows = []
    for pos, (scenario, variant, step, mass) in enumerate([("flat", "reference", 0.05, 1.5), ("crossed", "reference", 0.05, 1.5), ("crossed", "no_rotation", 0.05, 0.0), ("flat", "coarse", 0.2, 1.5)]):
        s = Scenario(scenario, time_step_s=step, rotating_equivalent_mass_kg=mass)
        rows.append((f"{scenario}/{variant}", pos, scenario, variant, [(10000.0, 0.0)] if scenario == "flat" else CROSSED, *[getattr(s, n) for n in PARAMETERS]))
    return spark.createDataFrame(rows, "run_id string, pos int, scenario string, variant string, profile array<struct<length_m:double,grade_ratio:double>>, " + ", ".join(f"{n} double" for n in PARAMETERS))


def test_benchmark_table(spark):
    table = reports.benchmark(bench_runs(spark))
    assert tuple(table.columns) == reports.BENCHMARK
    first, second, third, _ = table.collect()
    assert tuple(first) == ("flat", "reference", 0.05, 1.5, "52.312649121", "100.706193596", "0.183805138", False, "speed_threshold")
    assert (second["elapsed_time_s"], second["distance_m"], third["elapsed_time_s"]) == ("235.829360854", "1315.000000000", "236.222016635")
    assert reports.benchmark(bench_runs(spark).limit(0)).collect() == []


def test_groups_keep_the_order_of_runs(spark):
    runs = bench_runs(spark).select("scenario", "pos", "variant")
    found = [(r["scenario"], [x["variant"] for x in r["runs"]]) for r in reports.by_scenario(runs).collect()]
    assert found == [("flat", ["reference", "coarse"]), ("crossed", ["reference", "no_rotation"])]
    picked = reports.pick(runs, F.col("scenario") == "crossed").first()
    assert (picked["pos"], picked["variant"]) == (1, "reference")
    with pytest.raises(Exception, match="no such run"):
        reports.pick(runs, F.col("scenario") == "none").collect()


def test_manifest_with_fixture(spark, frozen):
    held = readers.held_files(spark, str(frozen.parent))
    found = reports.with_fixture({"study_area": "s"}, held, "fixtures/edges.json")
    assert found["study_area"] == "s" and found["fixture"]["bytes"] == frozen.stat().st_size and len(found["fixture"]["sha256"]) == 64
    with pytest.raises(FileNotFoundError):
        reports.with_fixture({}, held, "fixtures/none.json")


def test_live_reports(spark, tmp_path):
    geometry = "array<struct<lon:double,lat:double>>"
    shape = [(6.1, 45.1), (6.101, 45.101)]
    rows = [(0, "way", 1, {"highway": "residential", "surface": "asphalt"}, shape), (1, "way", 2, {"highway": "residential", "name": 'say "é"'}, shape), (2, "way", 3, {"highway": "residential", "bridge": "yes", "a": 'say "x"'}, shape)]
    ways = spark.createDataFrame(rows, f"pos long, type string, id long, tags map<string,string>, geometry {geometry}")
    directed = edges.directed(ways)
    chosen = edges.select(directed, 4)
    # The second way's answers are missing, so its profiles are refused.
    values = F.when(~F.col("edge_id").contains("-2-"), F.transform(F.sequence(F.lit(0), F.col("points") - 1), lambda i: 500.0 - i * F.col("spacing_m") * 0.05))
    points = reports.live_points(chosen, lambda asked: asked.withColumn("elevations", values))
    compared = reports.sampling_comparison(points, chosen, "t").orderBy("spacing_m").collect()
    assert [(r["osm_way_id"], r["spacing_m"], r["highway"], r["surface"], r["stop_reason"]) for r in compared] == [(1, s, "residential", "asphalt", "route_end") for s in edges.SPACINGS_M]
    assert all(r["net_dz_m"] == pytest.approx(-r["descent_m"]) and r["ascent_m"] == 0 for r in compared)
    cached = tmp_path / "cache"
    cached.mkdir()
    (cached / "b.json").write_text("1")
    (cached / "a.json").write_text("22")
    relations = spark.createDataFrame([(3,)], "relations long")
    out = tmp_path / "out" / "live"
    reports.write_live(spark, str(out), points, chosen, directed, relations, "t", {"endpoint": "e"}, readers.held_files(spark, str(cached)), ["none"])
    text = lambda name: next((out / name).glob("*.csv")).read_bytes()
    assert text("sampling_comparison.csv") == text("profile_simulations.csv") and text("sampling_comparison.csv").count(b"\r\n") == 5
    summary = json.loads((out / "osm_extraction_summary.json").read_bytes())
    assert summary == {"source": "live", "retrieved_at": "t", "endpoint": "e", "directed_edges": 6, "selected_profile_edges": 2, "restriction_relations": 3}
    manifest = json.loads((out / "data_manifest.json").read_bytes())
    assert [f["name"] for f in manifest["altimetry_cache_files"]] == ["a.json", "b.json"] and manifest["osm"] == summary
    assert text("graph_quality.csv").splitlines()[:2] == [b"source,edge_id,osm_way_id,direction,access,structure", b"live,osm-way-1-forward,1,forward,admissible,normal"]
    review = list(csv.DictReader(text("structure_review.csv").decode().splitlines()))
    assert [json.loads(r["osm_tags"]) for r in review] == [{"highway": "residential", "bridge": "yes", "a": 'say "x"'}] * 2
    profile = next((out / "profiles").glob("edge_id=osm-way-1-forward/spacing_m=25.0/*.csv")).read_text().splitlines()
    assert profile[0] == "source,retrieved_at,chainage_m,longitude,latitude,x_epsg2154_m,y_epsg2154_m,elevation_rge_alti_m" and profile[1].startswith("live,t,0.0,6.1,45.1,")
    assert [float(x.split(",")[2]) for x in profile[1:]] == sorted(float(x.split(",")[2]) for x in profile[1:])


def test_empty_reconstruction(spark):
    none = spark.createDataFrame([], "pos long, type string, id long, tags map<string,string>, geometry array<struct<lon:double,lat:double>>")
    directed = edges.directed(none)
    chosen = edges.select(directed, 4, least=0)
    points = reports.live_points(chosen, lambda asked: asked.withColumn("elevations", F.lit(None).cast("array<double>")))
    assert reports.sampling_comparison(points, chosen, "t").collect() == [] and reports.graph_quality(directed).collect() == [] and reports.structure_decisions(directed).collect() == []
    counts = reports.extraction_counts(directed, chosen, spark.createDataFrame([(0,)], "relations long"))
    assert reports.extraction_summary(counts, {"source": "live"}) == {"source": "live", "directed_edges": 0, "selected_profile_edges": 0, "restriction_relations": 0}
