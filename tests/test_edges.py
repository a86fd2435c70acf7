"""Geometry contract, classification, densification, readers and writers."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from velograde.functions import classify
from velograde.functions.geometry import lambert93
from velograde.operators import edges, profiles, quality
from velograde.sources import readers, writers

SAMPLE = "edge_id string, sample_idx int, x_m double, y_m double, elevation_m double, crs string, structure_status string, access_status string, elevation_dataset string"


def sampled(spark, **named):
    """Edges by name: (points, options)."""
    rows = []
    for name, (points, options) in named.items():
        o = {"crs": "EPSG:2154", "structure": "normal", "dataset": "terrain model"} | options
        rows += [(name, k, *map(lambda v: None if v is None else float(v), p), o["crs"], o["structure"], "admissible", o["dataset"]) for k, p in enumerate(points)]
    return spark.createDataFrame(rows, SAMPLE)


def test_segments_of_known_edges(spark):
    s = profiles.segments(sampled(spark, e=([(0, 0, 100), (100, 0, 90), (130, 40, 95)], {}))).orderBy("segment").collect()
    assert (s[0]["horizontal_length_m"], s[0]["dz_m"], s[0]["grade_ratio"]) == (100.0, -10.0, -0.1)
    assert s[0]["travelled_length_m"] == pytest.approx(100.4987562112089, rel=1e-12)
    assert (s[1]["horizontal_length_m"], s[1]["dz_m"], s[1]["grade_ratio"]) == (50.0, 5.0, 0.1)


def test_reject_reasons_in_order(spark):
    cases = sampled(
        spark,
        good=([(0, 0, 1), (10, 0, 2)], {}),
        crs=([(0, 0, None), (10, 0, 2)], {"crs": "EPSG:4326"}),
        bridge=([(0, 0, 1), (10, 0, 2)], {"structure": "bridge"}),
        one=([(0, 0, 1)], {}),
        null=([(0, 0, 1), (10, 0, None)], {"structure": "tunnel", "dataset": "unknown"}),
        twice=([(0, 0, 1), (0, 0, 1)], {}),
        jump=([(0, 0, 0), (200, 0, 50)], {}),
        steep=([(0, 0, 0), (10, 0, 6)], {}),
        half=([(0, 0, 0), (10, 0, 5)], {}),
    )
    found = {r["edge_id"]: r["reject_reason"] for r in profiles.rejects(cases).collect()}
    assert found == {
        "good": None, "crs": "reference_system", "bridge": "terrain_on_structure", "one": "too_few_samples", "null": "missing_elevation",
        "twice": "duplicate_point", "jump": "elevation_jump", "steep": "extreme_grade", "half": None,
    }
    with pytest.raises(Exception, match="edge steep: extreme_grade"):
        profiles.strict(cases.where("edge_id = 'steep'")).collect()


def test_reverse_and_lookup(spark):
    s = profiles.with_chainage(sampled(spark, e=([(0, 0, 0), (30, 40, 1), (60, 80, 3)], {})))
    back = {r["sample_idx"]: (r["edge_id"], r["x_m"], r["chainage_m"]) for r in profiles.reverse(s).collect()}
    assert back == {0: ("e:reverse", 60.0, 0.0), 1: ("e:reverse", 30.0, 50.0), 2: ("e:reverse", 0.0, 100.0)}
    lines = spark.createDataFrame([("e", 0, 50.0, 0.1), ("e", 1, 50.0, 0.2)], "edge_id string, segment int, length_m double, grade_ratio double")
    asked = spark.createDataFrame([("e", d) for d in (0.0, 49.9, 50.0, 100.0, 100.1)], "edge_id string, distance_m double")
    assert {r["distance_m"]: r["segment"] for r in profiles.lookup(lines, asked, "length_m").collect()} == {0.0: 0, 49.9: 0, 50.0: 1, 100.0: 1}


def test_projection_of_a_known_point(spark):
    q = spark.range(1).select(lambert93(F.lit(2.2945), F.lit(48.8584)).alias("q"), lambert93(F.lit(0.0), F.lit(90.0)).alias("bad")).first()
    assert q["q"]["x"] == pytest.approx(648237.3, abs=2) and q["q"]["y"] == pytest.approx(6862271.7, abs=2)
    assert q["bad"] is None


ACCESS = [
    ({"highway": "track"}, "review"), ({"highway": "track", "bicycle": "yes"}, "admissible"), ({"highway": "residential", "bicycle": "no"}, "prohibited"), ({"highway": "path", "access": "private"}, "prohibited"),
    ({"highway": "motorway", "bicycle": "yes"}, "prohibited"), ({"highway": "trunk"}, "review"), ({"highway": "service", "vehicle": "no"}, "prohibited"), ({"highway": "service", "vehicle": "no", "bicycle": "permissive"}, "admissible"), ({}, "review"),
]
STRUCTURE = [({"bridge": "yes", "layer": "1"}, "bridge"), ({"tunnel": "yes"}, "tunnel"), ({"layer": "-1"}, "stacked"), ({}, "normal"), ({"covered": "yes"}, "tunnel"), ({"layer": "+0"}, "normal"), ({"bridge": "no"}, "normal")]
ONEWAY = [({"oneway": "yes"}, ["forward"]), ({"oneway": "-1"}, ["reverse"]), ({"oneway": "yes", "oneway:bicycle": "no"}, ["forward", "reverse"]), ({}, ["forward", "reverse"]), ({"oneway": "true"}, ["forward"]), ({"oneway": "reversible"}, ["forward", "reverse"])]


@pytest.mark.parametrize(("rule", "cases"), [(classify.access, ACCESS), (classify.structure, STRUCTURE), (classify.directions, ONEWAY)])
def test_classification(spark, rule, cases):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, tags map<string,string>")
    assert [r["v"] for r in rows.select("k", rule(F.col("tags")).alias("v")).orderBy("k").collect()] == [v for _, v in cases]


def test_ways_from_file_to_selected_edges(spark, tmp_path):
    line = [{"lon": 6.1, "lat": 45.1}, {"lon": 6.102, "lat": 45.1}]
    elements = [
        {"type": "way", "id": 7, "tags": {"highway": "residential", "oneway": "yes"}, "geometry": line},
        {"type": "way", "id": 8, "tags": {"highway": "track", "bicycle": "yes", "oneway": "yes", "oneway:bicycle": "no"}, "geometry": line},
        {"type": "way", "id": 9, "tags": {"name": "x"}, "geometry": line},
        {"type": "way", "id": 10, "tags": {"highway": "service"}, "geometry": line[:1]},
        {"type": "relation", "id": 11},
        {"type": "way", "id": 12, "tags": {"highway": "service", "layer": "2"}, "geometry": line},
    ]
    path = tmp_path / "ways.json"
    path.write_text(json.dumps({"elements": elements}))
    d = edges.directed(readers.ways(spark, str(path)))
    assert [r["edge_id"] for r in d.orderBy("pos").collect()] == ["osm-way-7-forward", "osm-way-8-forward", "osm-way-8-reverse", "osm-way-12-forward", "osm-way-12-reverse"]
    back = d.where("edge_id = 'osm-way-8-reverse'").first()
    assert back["geometry"][0]["lon"] == 6.102
    assert [r["way_id"] for r in edges.select(d, 4).collect()] == [7, 8] and [r["way_id"] for r in edges.select(d, 1).collect()] == [7]
    assert readers.restrictions(spark, str(path)).first()["relations"] == 1
    assert [r["tags"] for r in quality.structure_review(d).collect()] == ['{"highway":"service","layer":"2"}'] * 2


def test_densify(spark):
    e = spark.createDataFrame([("e", [(6.1, 45.1), (6.101, 45.1), (6.101, 45.1), (6.101, 45.1005)])], "edge_id string, geometry array<struct<lon:double,lat:double>>")
    p = edges.densify(e, 10.0).orderBy("idx").collect()
    assert p[0]["chainage_m"] == 0.0 and p[-1]["lat"] == 45.1005
    gaps = [b["chainage_m"] - a["chainage_m"] for a, b in zip(p, p[1:])]
    assert 0 < min(gaps) and max(gaps) <= 10.0 + 1e-9
    assert sum(r["points"] for r in edges.elevation_batches(edges.densify(e, 0.5), 200).collect()) == edges.densify(e, 0.5).count()


def test_elevation_responses(spark):
    cases = [('{"elevations":[100,{"z":101.5}]}', 2, [100.0, 101.5]), ('{"elevations":[100]}', 2, None), ('{"elevations":[],"elevation":[3.5]}', 1, [3.5]), ('{"elevations":["x"]}', 1, None), ("{}", 1, None)]
    rows = spark.createDataFrame([(k, *c[:2]) for k, c in enumerate(cases)], "k int, body string, n int")
    found = rows.select("k", readers.decode_elevations(F.col("body"), F.col("n")).alias("v")).orderBy("k").collect()
    assert [r["v"] for r in found] == [c[2] for c in cases]


def test_edge_file_manifest_and_reports(spark, tmp_path):
    source = {
        "fixture_status": "test", "crs": "EPSG:2154", "geometry_source": "g", "elevation_source": "z",
        "edges": [
            {"id": "a", "name": "A", "structure": "normal", "access": "admissible", "samples": [[0, 0, 100], [30, 40, 95]]},
            {"id": "b", "name": "B", "structure": "bridge", "access": "review", "samples": [[0, 0, None], [3, 4, None]]},
        ],
    }
    folder = tmp_path / "files"
    folder.mkdir()
    path = folder / "edges.json"
    path.write_text(json.dumps(source))
    s = readers.edge_samples(spark, str(path))
    got = {(r["edge_id"], r["sample_idx"]): r for r in s.collect()}
    assert got["a", 1]["chainage_m"] == 50.0 and got["b", 0]["elevation_m"] is None
    assert got["b", 0]["quality_flags"] == ["roadway_elevation_unknown"] and got["a", 0]["source_sha256"] == hashlib.sha256(path.read_bytes()).hexdigest()
    listing = tmp_path / "manifest.json"
    listing.write_text(json.dumps({"files": [{"id": "1", "filename": "edges.json", "sha256": None}, {"id": "2", "filename": "gone.tif", "sha256": "00"}]}))
    status = readers.verify(readers.manifest(spark, str(listing)), readers.held_files(spark, str(folder)))
    assert {r["filename"]: r["status"] for r in status.collect()} == {"edges.json": "OK", "gone.tif": "MISSING"}
    report = quality.edge_quality(s.dropDuplicates(["edge_id"])).orderBy("edge_id")
    out = str(tmp_path / "out" / "quality")
    writers.publish(spark, out, lambda d: writers.csv(report, d, crlf=True))
    text = next((tmp_path / "out" / "quality").glob("*.csv")).read_bytes()
    assert text == b"edge_id,access,structure,simulable,quality_flags\r\na,admissible,normal,True,\r\nb,review,bridge,False,roadway_elevation_unknown\r\n"
    with pytest.raises(ValueError):
        writers.publish(spark, out, lambda d: (_ for _ in ()).throw(ValueError()))
    assert [x.name for x in (tmp_path / "out").iterdir()] == ["quality"]
    assert writers.canonical_json({"b": 1, "a": "é"}) == b'{"a":"\\u00e9","b":1}\n'
    assert writers.fixed(spark.range(1).select(F.lit(1234.5).alias("v")), ["v"]).first()["v"] == "1234.500000000"


def test_too_few_edges(spark):
    none = spark.createDataFrame([], "edge_id string, way_id long, pos long, direction string, structure_status string, access_status string, geometry array<struct<lon:double,lat:double>>")
    assert edges.select(none, 4, least=0).collect() == []
    with pytest.raises(Exception, match="fewer than 2 usable edges"):
        edges.select(none, 4).collect()


def test_elevations_of_answers(spark):
    points = spark.createDataFrame([("a", 10.0, i) for i in range(5)] + [("b", 10.0, 0)], "edge_id string, spacing_m double, idx int")
    answers = spark.createDataFrame([("a", 10.0, 0, [1.0, 2.0]), ("a", 10.0, 1, None), ("a", 10.0, 2, [5.0])], "edge_id string, spacing_m double, batch int, elevations array<double>")
    found = edges.with_elevations(points, answers, 2).orderBy("edge_id", "idx").collect()
    assert [(r["edge_id"], r["idx"], r["elevation_m"]) for r in found] == [("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, None), ("a", 3, None), ("a", 4, 5.0), ("b", 0, None)]
    assert edges.with_elevations(points.limit(0), answers).collect() == []


def test_marked_edges_and_new_files(spark):
    all_edges = spark.createDataFrame([("a",), ("b",), (None,)], "edge_id string")
    found = edges.marked(all_edges, spark.createDataFrame([("b",), ("b",), (None,)], "edge_id string")).collect()
    assert {(r["edge_id"], r["chosen"]) for r in found} == {("a", False), ("b", True), (None, False)} and len(found) == 3
    files = spark.createDataFrame([("x",), ("y",)], "filename string")
    assert [r["filename"] for r in readers.new_files(files.where("filename = 'x'"), files).collect()] == ["y"] and readers.new_files(files, files).collect() == []


def test_edge_files_keep_their_own_digest(spark, tmp_path):
    for name in ("one", "two"):
        edge = {"id": name, "name": name, "structure": "normal", "access": "admissible", "samples": [[0.0, 0.0, 1.0], [3.0, 4.0, 2.0]]}
        (tmp_path / f"{name}.json").write_text(json.dumps({"crs": "EPSG:2154", "geometry_source": "s", "elevation_source": "e", "edges": [edge]}))
    found = {(r["edge_id"], r["source_sha256"]) for r in readers.edge_samples(spark, str(tmp_path)).collect()}
    assert found == {(n, hashlib.sha256((tmp_path / f"{n}.json").read_bytes()).hexdigest()) for n in ("one", "two")}


def test_densify_shuffles_edges_not_points(spark):
    """One exchange, before the points are made; totals by edge and spacing need none of their own."""
    lines = spark.createDataFrame([(1, [(6.1, 45.1), (6.102, 45.1), (6.102, 45.1), (6.103, 45.101)]), (2, [(6.1, 45.1)])], "edge_id long, geometry array<struct<lon: double, lat: double>>")
    found = edges.densify(edges.at_spacings(lines), F.col("spacing_m")).groupBy("edge_id", "spacing_m").agg(F.max("idx").alias("last"), F.max("chainage_m").alias("m"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    rows = {(r.edge_id, r.spacing_m): r for r in found.collect()}
    assert rows[2, 2.0].last == 0 and rows[2, 2.0].m == 0.0
    assert rows[1, 2.0].last > rows[1, 25.0].last > 2 and abs(rows[1, 2.0].m - rows[1, 25.0].m) < 1e-6
