"""DuckDB equivalents of the registered queries, on the same derivations."""

from __future__ import annotations

import math

from velograde.functions.classify import GRANTED, GROUND_LAYERS, MOTORWAYS, ONEWAY_FORWARD, OPEN_ROADS, REFUSED
from velograde.functions.geometry import C, E, EASTING, N, NORTHING, ORIGIN

ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"

LINES = f"""lines AS (
  SELECT l_orderkey AS edge_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) - 1 AS segment,
         10.0 + l_quantity AS length_m, (l_tax + 0.0) - (l_discount + 0.0) AS grade_ratio
  FROM lineitem)"""

STRUCTURE = "CASE edge_id % 10 WHEN 0 THEN 'bridge' WHEN 1 THEN 'tunnel' WHEN 2 THEN 'stacked' ELSE 'normal' END"
ACCESS = "CASE edge_id % 3 WHEN 0 THEN 'admissible' WHEN 1 THEN 'review' ELSE 'prohibited' END"

RAW = f"""{LINES}, raw AS (
  SELECT edge_id, segment AS sample_idx,
         sum(length_m) OVER w AS x_m, sum((length_m - 10.0) * 0.5) OVER w AS y_m, sum(length_m * grade_ratio) OVER w AS z,
         {STRUCTURE} AS structure_status, {ACCESS} AS access_status
  FROM lines WINDOW w AS (PARTITION BY edge_id ORDER BY segment ROWS UNBOUNDED PRECEDING))"""

SAMPLES = f"""{RAW}, samples AS (
  SELECT edge_id, sample_idx, x_m, y_m, CASE WHEN structure_status = 'normal' THEN z END AS elevation_m, access_status, structure_status FROM raw)"""

FLAWED = f"""{RAW}, samples AS (
  SELECT edge_id, sample_idx, CASE WHEN edge_id % 29 = 8 AND sample_idx = 1 THEN NULL WHEN edge_id % 19 = 6 AND sample_idx > 0 THEN 0.0 ELSE x_m END AS x_m,
         CASE WHEN edge_id % 31 = 9 AND sample_idx = 1 THEN 'nan'::DOUBLE WHEN edge_id % 19 = 6 AND sample_idx > 0 THEN 0.0 ELSE y_m END AS y_m,
         CASE WHEN edge_id % 11 = 3 AND sample_idx = 1 THEN NULL WHEN edge_id % 13 = 4 AND sample_idx = 2 THEN z + 50.0 WHEN edge_id % 17 = 5 AND sample_idx = 1 THEN z + 15.0 ELSE z END AS elevation_m,
         CASE WHEN edge_id % 23 = 7 THEN 'EPSG:4326' WHEN edge_id % 37 = 10 AND sample_idx = 1 THEN NULL ELSE 'EPSG:2154' END AS crs, structure_status, CASE WHEN edge_id % 2 = 0 THEN 'terrain model' ELSE 'unknown' END AS dataset
  FROM raw)"""

SEGMENTS = """pairs AS (
  SELECT edge_id, sample_idx AS segment, lead(x_m) OVER w - x_m AS sx, lead(y_m) OVER w - y_m AS sy, lead(elevation_m) OVER w - elevation_m AS dz_m, lead(sample_idx) OVER w AS nxt
  FROM samples WINDOW w AS (PARTITION BY edge_id ORDER BY sample_idx)),
segs AS (
  SELECT edge_id, segment, horizontal_length_m, dz_m, CASE WHEN horizontal_length_m > 1e-9 THEN dz_m / horizontal_length_m END AS grade_ratio, sqrt(horizontal_length_m * horizontal_length_m + dz_m * dz_m) AS travelled_length_m
  FROM (SELECT *, sqrt(sx * sx + sy * sy) AS horizontal_length_m FROM pairs WHERE nxt IS NOT NULL))"""

REJECTS = """bad AS (
  SELECT edge_id, segment, CASE WHEN horizontal_length_m IS NULL OR NOT isfinite(horizontal_length_m) THEN 'missing_coordinates' WHEN dz_m IS NULL THEN 'missing_elevation' WHEN horizontal_length_m <= 1e-9 THEN 'duplicate_point' WHEN abs(dz_m) > 20 THEN 'elevation_jump' WHEN abs(grade_ratio) > 0.5 THEN 'extreme_grade' END AS error FROM segs),
firsts AS (SELECT edge_id, min(segment) AS segment, arg_min(error, segment) AS error FROM bad WHERE error IS NOT NULL GROUP BY edge_id),
own AS (
  SELECT edge_id, CASE WHEN bool_or(crs IS DISTINCT FROM 'EPSG:2154') THEN 'reference_system' WHEN bool_or(structure_status <> 'normal' AND dataset LIKE 'terrain%') THEN 'terrain_on_structure' WHEN count(*) < 2 THEN 'too_few_samples' END AS error
  FROM samples GROUP BY edge_id),
rejects AS (
  SELECT edge_id, coalesce(own.error, firsts.error) AS reject_reason, CASE WHEN own.error IS NULL THEN firsts.segment END AS segment
  FROM own LEFT JOIN firsts USING (edge_id))"""


def _in(column: str, values) -> str:
    return f"coalesce({column} IN ({', '.join(repr(v) for v in values)}), false)"


WAYS = f"""ways AS (
  SELECT event_id AS way_id, CASE event_type WHEN 'view' THEN 'residential' WHEN 'click' THEN 'track' WHEN 'purchase' THEN 'secondary' WHEN 'signup' THEN 'path' WHEN 'error' THEN 'motorway' END AS highway,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
tagged AS (
  SELECT way_id, highway, CASE WHEN k & 1 > 0 THEN 'yes' END AS oneway, CASE WHEN k & 2 > 0 THEN 'no' END AS oneway_bicycle, CASE WHEN k & 4 > 0 THEN 'yes' END AS bridge,
         CASE WHEN k & 8 > 0 THEN 'private' END AS access, CASE WHEN k & 16 > 0 THEN 'yes' END AS bicycle, CASE WHEN k & 32 > 0 THEN '1' END AS layer FROM ways),
classed AS (
  SELECT *, CASE WHEN {_in('bicycle', REFUSED)} THEN 'prohibited' WHEN {_in('access', REFUSED)} AND NOT {_in('bicycle', GRANTED)} THEN 'prohibited'
                 WHEN {_in('highway', MOTORWAYS)} THEN 'prohibited' WHEN {_in('bicycle', GRANTED)} OR {_in('highway', OPEN_ROADS)} THEN 'admissible' ELSE 'review' END AS access_status,
         CASE WHEN coalesce(bridge, 'no') <> 'no' THEN 'bridge' WHEN NOT {_in("coalesce(layer, '0')", GROUND_LAYERS)} THEN 'stacked' ELSE 'normal' END AS structure_status,
         CASE WHEN coalesce(oneway_bicycle, '') = 'no' THEN ['forward', 'reverse'] WHEN {_in('oneway', ONEWAY_FORWARD)} THEN ['forward'] ELSE ['forward', 'reverse'] END AS directions
  FROM tagged)"""

#: Key and value of the tags in the order of keys.
TAGS = [("access", "access"), ("bicycle", "bicycle"), ("bridge", "bridge"), ("highway", "highway"), ("layer", "layer"), ("oneway", "oneway"), ("oneway:bicycle", "oneway_bicycle")]
TAG_TEXT = "concat_ws(';', " + ", ".join(f"'{k}=' || {c}" for k, c in TAGS) + ")"
TAG_JSON = "'{' || concat_ws(',', " + ", ".join(f"""'"{k}":"' || {c} || '"'""" for k, c in TAGS) + ") || '}'"


def _project(lon: str, lat: str) -> tuple[str, str]:
    s = f"({E!r} * sin(radians({lat})))"
    iso = f"ln(tan({math.pi / 4!r}::DOUBLE + radians({lat}) / 2) * pow((1 - {s}) / (1 + {s}), {E / 2!r}::DOUBLE))"
    radius, angle = f"({C!r}::DOUBLE * exp(-{N!r}::DOUBLE * {iso}))", f"({N!r}::DOUBLE * (radians({lon}) - {ORIGIN!r}::DOUBLE))"
    return f"{EASTING!r}::DOUBLE + {radius} * sin({angle})", f"{NORTHING!r}::DOUBLE - {radius} * cos({angle})"


def _points(source: str) -> str:
    x, y = _project("lon", "lat")
    return f"pts AS (SELECT edge_id, i, lon, lat, {x} AS x, {y} AS y FROM ({source}))"


POLYLINES = _points("SELECT vec_id AS edge_id, i, 6.1::DOUBLE + 0.01::DOUBLE * embedding[2 * i + 1]::DOUBLE AS lon, 45.1::DOUBLE + 0.01::DOUBLE * embedding[2 * i + 2]::DOUBLE AS lat FROM embeddings, range(32) AS r(i)")


def _densify(spacing: str, spacings: str = "SELECT 0 AS unused") -> str:
    return f"""nexts AS (
  SELECT *, lead(lon) OVER w AS nlon, lead(lat) OVER w AS nlat, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM pts WINDOW w AS (PARTITION BY edge_id ORDER BY i)),
reach AS (SELECT *, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS reach FROM nexts CROSS JOIN ({spacings})),
cuts AS (
  SELECT *, UNNEST(range(1, pieces + 1)) AS k FROM (SELECT *, CAST(greatest(1, ceil(reach / {spacing})) AS INTEGER) AS pieces FROM reach WHERE reach > 1e-9)),
dense AS (
  SELECT edge_id, {spacing} AS spacing_m, -1 AS i, 0 AS k, lon, lat, x AS x_m, y AS y_m FROM reach WHERE i = 0
  UNION ALL
  SELECT edge_id, {spacing}, i, k, lon + k / pieces * (nlon - lon), lat + k / pieces * (nlat - lat), x + k / pieces * (nx - x), y + k / pieces * (ny - y) FROM cuts),
steps AS (
  SELECT *, row_number() OVER w - 1 AS idx, coalesce(sqrt((x_m - lag(x_m) OVER w) ** 2 + (y_m - lag(y_m) OVER w) ** 2), 0) AS step FROM dense WINDOW w AS (PARTITION BY edge_id, spacing_m ORDER BY i, k)),
densified AS (SELECT *, sum(step) OVER (PARTITION BY edge_id, spacing_m ORDER BY idx ROWS UNBOUNDED PRECEDING) AS chainage_m FROM steps)"""


def _simulation(dt: float, longest: float, lines: str = LINES) -> str:
    """The event-split fold as a recursion of one substep per level, over all edges; default scenario."""
    eps, stop, dwell, v0 = "1e-12::DOUBLE", "0.3::DOUBLE", "2.0::DOUBLE", f"{15 / 3.6!r}::DOUBLE"
    return f"""{lines},
prof AS (
  SELECT edge_id, list(end_m ORDER BY segment) AS ends, list(grade_ratio ORDER BY segment) AS grades, max(end_m) AS len, count(*) AS n
  FROM (SELECT *, sum(length_m) OVER (PARTITION BY edge_id ORDER BY segment ROWS UNBOUNDED PRECEDING) AS end_m FROM lines) GROUP BY edge_id),
sim AS (
  SELECT edge_id, 0::BIGINT AS step, true AS moved, 0.0::DOUBLE AS t, 0.0::DOUBLE AS d, {v0} AS v, 0.0::DOUBLE AS below, 0.0::DOUBLE AS rest, '' AS reason, 0.0::DOUBLE AS still, NULL::DOUBLE AS fb, NULL::DOUBLE AS fz FROM prof
  UNION ALL
  SELECT edge_id, CASE WHEN state = '' THEN step + 1 ELSE step END, state = '',
         CASE WHEN state = '' THEN t + h ELSE t END,
         CASE WHEN state = 'route_end' THEN len WHEN state <> '' THEN d WHEN arrived THEN len WHEN stuck THEN e + 1e-10 ELSE d1 END,
         CASE WHEN state = '' THEN v1 ELSE v END,
         CASE WHEN state <> '' THEN below WHEN v <= {stop} AND v1 <= {stop} THEN below + h WHEN v > {stop} AND v1 < {stop} THEN within WHEN v1 > {stop} THEN 0.0 ELSE below END,
         CASE WHEN state = '' THEN rest1 - h ELSE rest1 END,
         CASE WHEN state <> '' THEN state WHEN ended THEN 'speed_threshold' WHEN arrived THEN 'route_end' ELSE '' END,
         still + CASE WHEN state = '' AND v <= {eps} AND v1 <= {eps} THEN h ELSE 0.0 END,
         CASE WHEN state = '' AND fb IS NULL AND v > {stop} AND v1 <= {stop} THEN t + least(h, cross_t) ELSE fb END,
         CASE WHEN state = '' AND fz IS NULL AND v1 <= {eps} THEN t + h ELSE fz END
  FROM (SELECT *, hit AND h <= {eps} AS stuck, hit AND h <= {eps} AND e >= len - {eps} AS arrived,
               CASE WHEN hit THEN e ELSE least(len, greatest(d, d + v * h + 0.5 * a * h * h)) END AS d1
  FROM (SELECT * EXCLUDE (hit), hit AND NOT ended AS hit, CASE WHEN NOT ended AND NOT hit AND h = zero THEN 0.0 ELSE greatest(0.0, v + a * h) END AS v1
  FROM (SELECT * EXCLUDE (h), CASE WHEN NOT ended THEN h WHEN v <= {stop} THEN greatest(0.0, {dwell} - below) ELSE cross_t + greatest(0.0, {dwell} - below) END AS h
  FROM (SELECT *, within > 0 AND below + within >= {dwell} - {eps} AS ended
  FROM (SELECT *, CASE WHEN v <= {stop} AND vh <= {stop} THEN h WHEN v > {stop} AND vh < {stop} THEN h - cross_t WHEN v < {stop} AND vh > {stop} THEN cross_t ELSE 0.0 END AS within
  FROM (SELECT *, CASE WHEN a <> 0 THEN ({stop} - v) / a END AS cross_t, greatest(0.0, v + a * h) AS vh
  FROM (SELECT *, reach <= h0 + {eps} AS hit, CASE WHEN reach <= h0 + {eps} THEN greatest(0.0, reach) ELSE h0 END AS h
  FROM (SELECT *, CASE WHEN gap <= {eps} THEN 0.0 WHEN abs(a) < 1e-15::DOUBLE THEN CASE WHEN v > 0 THEN gap / v ELSE 'inf'::DOUBLE END WHEN sq < 0 THEN 'inf'::DOUBLE
                       WHEN v + sqrt(greatest(0.0, sq)) > 0 THEN 2.0 * gap / (v + sqrt(greatest(0.0, sq))) ELSE 'inf'::DOUBLE END AS reach, least(rest1, zero) AS h0
  FROM (SELECT *, e - d AS gap, v * v + 2.0 * a * (e - d) AS sq, CASE WHEN a < 0 AND v > 0 THEN -v / a ELSE 'inf'::DOUBLE END AS zero
  FROM (SELECT *, CASE WHEN v <= {eps} AND a0 < 0 THEN 0.0 ELSE a0 END AS a
  FROM (SELECT *, (-(90.0::DOUBLE * 9.80665::DOUBLE) * (g / sqrt(1.0 + g * g)) - 0.006::DOUBLE * (90.0::DOUBLE * 9.80665::DOUBLE) * (1.0 / sqrt(1.0 + g * g)) - 0.5 * 1.225::DOUBLE * 0.55::DOUBLE * v * abs(v)) / 91.5::DOUBLE AS a0
  FROM (SELECT *, ends[i] AS e, grades[i] AS g
  FROM (SELECT s.*, p.ends, p.grades, p.len, least(p.n, 1 + len(list_filter(p.ends, lambda x: x <= s.d))) AS i,
               CASE WHEN rest <= {eps} AND t >= {longest!r}::DOUBLE - {eps} THEN 'max_time' WHEN d >= p.len - {eps} THEN 'route_end' ELSE '' END AS state,
               CASE WHEN rest <= {eps} THEN least({dt!r}::DOUBLE, {longest!r}::DOUBLE - t) ELSE rest END AS rest1
        FROM sim AS s JOIN prof AS p USING (edge_id) WHERE s.reason = ''))))))))))))))"""


SIMULATED = _simulation(0.5, 120.0)

SQL = {
    "profile_segments": f"WITH {SAMPLES}, {SEGMENTS} SELECT edge_id, segment, horizontal_length_m, dz_m, grade_ratio, round(atan(grade_ratio), 9) AS angle_rad, round(travelled_length_m, 9) AS travelled_length_m FROM segs",
    "chainage": f"""WITH {SAMPLES}, steps AS (
  SELECT edge_id, sample_idx, coalesce(sqrt((x_m - lag(x_m) OVER w) * (x_m - lag(x_m) OVER w) + (y_m - lag(y_m) OVER w) * (y_m - lag(y_m) OVER w)), 0) AS step FROM samples WINDOW w AS (PARTITION BY edge_id ORDER BY sample_idx))
SELECT edge_id, sample_idx, sum(step) OVER (PARTITION BY edge_id ORDER BY sample_idx ROWS UNBOUNDED PRECEDING) AS chainage_m FROM steps""",
    "edge_reverse": f"""WITH {SAMPLES}, steps AS (
  SELECT *, coalesce(sqrt((x_m - lag(x_m) OVER w) * (x_m - lag(x_m) OVER w) + (y_m - lag(y_m) OVER w) * (y_m - lag(y_m) OVER w)), 0) AS step FROM samples WINDOW w AS (PARTITION BY edge_id ORDER BY sample_idx)),
run AS (SELECT *, sum(step) OVER (PARTITION BY edge_id ORDER BY sample_idx ROWS UNBOUNDED PRECEDING) AS c FROM steps)
SELECT edge_id || ':reverse' AS edge_id, max(sample_idx) OVER e - sample_idx AS sample_idx, x_m, y_m, elevation_m, last_value(c) OVER (PARTITION BY edge_id ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - c AS chainage_m
FROM run WINDOW e AS (PARTITION BY edge_id)""",
    "profile_points": f"WITH {LINES} SELECT edge_id, segment, sum(length_m) OVER w / 1000.0 AS distance_km, sum(length_m * grade_ratio) OVER w AS elevation_m FROM lines WINDOW w AS (PARTITION BY edge_id ORDER BY segment ROWS UNBOUNDED PRECEDING)",
    "segment_ends": f"WITH {LINES}, e AS (SELECT edge_id, segment, sum(length_m) OVER (PARTITION BY edge_id ORDER BY segment ROWS UNBOUNDED PRECEDING) AS end_m FROM lines) SELECT edge_id, segment, coalesce(lag(end_m) OVER (PARTITION BY edge_id ORDER BY segment), 0.0) AS start_m, end_m FROM e",
    "segment_lookup": f"""WITH {LINES}, e AS (SELECT *, sum(length_m) OVER (PARTITION BY edge_id ORDER BY segment ROWS UNBOUNDED PRECEDING) AS end_m, segment = max(segment) OVER (PARTITION BY edge_id) AS final FROM lines),
s AS (SELECT *, coalesce(lag(end_m) OVER (PARTITION BY edge_id ORDER BY segment), 0.0) AS start_m FROM e),
a AS (SELECT edge_id, UNNEST(range(0, CAST(floor(total / 25) AS INTEGER) + 1)) * 25.0::DOUBLE AS distance_m FROM (SELECT edge_id, sum(length_m) AS total FROM lines GROUP BY edge_id))
SELECT edge_id, distance_m, segment, grade_ratio FROM a JOIN s USING (edge_id) WHERE distance_m >= start_m AND (distance_m < end_m OR (final AND distance_m = end_m))""",
    "acceleration_grid": f"""WITH {LINES}, g AS (SELECT DISTINCT grade_ratio, sqrt(1.0 + grade_ratio * grade_ratio) AS hyp FROM lines),
w AS (SELECT * FROM (VALUES ('wind-3', -3.0::DOUBLE), ('wind0', 0.0::DOUBLE), ('wind3', 3.0::DOUBLE)) AS t(scenario_id, wind)), v AS (SELECT UNNEST([0.0, 1.0, 4.0, 8.0, 16.0]::DOUBLE[]) AS speed_m_s)
SELECT scenario_id, grade_ratio, speed_m_s, (-(90.0::DOUBLE * 9.80665::DOUBLE) * (grade_ratio / hyp) - 0.006::DOUBLE * (90.0::DOUBLE * 9.80665::DOUBLE) * (1.0 / hyp) - 0.5 * 1.225::DOUBLE * 0.55::DOUBLE * (speed_m_s - wind) * abs(speed_m_s - wind)) / 91.5::DOUBLE AS acceleration_m_s2 FROM g, w, v""",
    "projected_points": f"WITH {POLYLINES} SELECT edge_id, i, round(x, 3) AS x_m, round(y, 3) AS y_m FROM pts",
    "densified": f"WITH {POLYLINES}, {_densify('25.0::DOUBLE')} SELECT edge_id, idx, round(lon, 8) AS lon, round(lat, 8) AS lat, round(x_m, 2) AS x_m, round(y_m, 2) AS y_m, round(chainage_m, 2) AS chainage_m FROM densified",
    "spacing_comparison": f"WITH {POLYLINES}, {_densify('spacing', 'SELECT UNNEST([2.0, 5.0, 10.0, 25.0]::DOUBLE[]) AS spacing')} SELECT edge_id, spacing_m, count(*) AS points, round(max(chainage_m), 2) AS length_m FROM densified GROUP BY edge_id, spacing_m",
    "elevation_requests": f"WITH {POLYLINES}, {_densify('10.0::DOUBLE')} SELECT edge_id, CAST(idx // 200 AS BIGINT) AS batch, count(*) AS points FROM densified GROUP BY 1, 2",
    "way_classes": f"WITH {WAYS} SELECT way_id, access_status, structure_status, array_to_string(directions, ',') AS directions FROM classed",
    "directed_edges": f"""WITH {WAYS}, d AS (SELECT *, UNNEST(directions) AS direction FROM classed WHERE highway IS NOT NULL)
SELECT 'osm-way-' || way_id || '-' || direction AS edge_id, way_id, direction, access_status, structure_status, {TAG_TEXT} AS tags,
       6.1::DOUBLE + 0.0001::DOUBLE * (way_id % 97 + 7 * CASE WHEN direction = 'reverse' THEN 2 ELSE 0 END) AS first_lon FROM d""",
    "selected_edges": f"""WITH {WAYS}, {_points("SELECT way_id AS edge_id, i, 6.1::DOUBLE + 0.0001::DOUBLE * (way_id % 97 + 7 * i) AS lon, 45.1::DOUBLE + 0.0001::DOUBLE * (way_id % 89 + 5 * i) AS lat FROM classed, range(3) AS r(i) WHERE list_contains(directions, 'forward') AND highway IS NOT NULL AND structure_status = 'normal' AND access_status = 'admissible'")}, {_densify('25.0::DOUBLE')},
l AS (SELECT edge_id AS way_id, max(chainage_m) AS m FROM densified GROUP BY 1)
SELECT 'osm-way-' || way_id || '-forward' AS edge_id, way_id, round(m, 2) AS length_m FROM l WHERE m BETWEEN 10 AND 2000 ORDER BY way_id LIMIT 4""",
    "structure_review": f"""WITH {WAYS}, d AS (SELECT *, UNNEST(directions) AS direction FROM classed WHERE highway IS NOT NULL)
SELECT 'osm-way-' || way_id || '-' || direction AS edge_id, structure_status AS structure, access_status AS access, {TAG_JSON} AS tags FROM d WHERE structure_status <> 'normal'""",
    "edge_quality": f"WITH {SAMPLES} SELECT DISTINCT edge_id, access_status AS access, structure_status AS structure, structure_status = 'normal' AS simulable, CASE WHEN structure_status <> 'normal' THEN 'roadway_elevation_unknown' ELSE '' END AS quality_flags FROM samples",
    "uncertain_edges": f"WITH {SAMPLES} SELECT DISTINCT edge_id, structure_status AS structure, 'roadway elevation unavailable; terrain DEM forbidden' AS reason FROM samples WHERE structure_status <> 'normal'",
    "validation_rejects": f"WITH {FLAWED}, {SEGMENTS}, {REJECTS} SELECT edge_id, reject_reason, segment FROM rejects WHERE reject_reason IS NOT NULL",
    "accepted_segments": f"WITH {FLAWED}, {SEGMENTS}, {REJECTS} SELECT edge_id, count(*) AS segments, round(sum(travelled_length_m), 6) AS length_m FROM segs JOIN rejects USING (edge_id) WHERE reject_reason IS NULL GROUP BY edge_id",
    "profile_statistics": f"""WITH {SAMPLES}, {SEGMENTS}
SELECT edge_id, count(*) FILTER (abs(grade_ratio) > 0.5) AS anomaly_count, min(grade_ratio) AS min_grade, max(grade_ratio) AS max_grade, round(sum(horizontal_length_m), 6) AS horizontal_length_m, round(sum(travelled_length_m), 6) AS travelled_length_m,
       round(sum(dz_m), 6) AS elevation_change_m, round(sum(greatest(0.0, dz_m)), 6) AS ascent_m, round(-sum(least(0.0, dz_m)), 6) AS descent_m,
       round(quantile_cont(grade_ratio, 0.05), 6) AS grade_q05, round(quantile_cont(grade_ratio, 0.5), 6) AS grade_median, round(quantile_cont(grade_ratio, 0.95), 6) AS grade_q95
FROM segs WHERE dz_m IS NOT NULL GROUP BY edge_id""",
    "distinct_profiles": f"""WITH {LINES}, p AS (SELECT edge_id, string_agg(printf('%.2f', length_m::DOUBLE) || ':' || printf('%.2f', (grade_ratio + 0.0)::DOUBLE), ';' ORDER BY segment) AS k FROM lines GROUP BY edge_id)
SELECT sha256(k) AS profile_sha256, count(*) AS edges, min(edge_id) AS first_edge FROM p GROUP BY k""",
    "bounding_box": f"WITH {SAMPLES} SELECT min(x_m) AS min_x, max(x_m) AS max_x, min(y_m) AS min_y, max(y_m) AS max_y, min(elevation_m) AS min_z, max(elevation_m) AS max_z FROM samples",
    "stride_sample": f"WITH {SAMPLES}, n AS (SELECT *, count(*) OVER (PARTITION BY edge_id) AS n FROM samples) SELECT edge_id, sample_idx, x_m FROM n WHERE sample_idx % greatest(1, n // 3) = 0 OR sample_idx = n - 1",
    "manifest_check": """WITH d AS (SELECT 'doc-' || doc_id AS filename, doc_id, sha256(text) AS digest FROM documents),
l AS (SELECT filename, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN sha256('wrong') ELSE digest END AS sha256 FROM d), h AS (SELECT filename, digest AS actual FROM d WHERE doc_id % 11 <> 0)
SELECT filename, sha256, actual, CASE WHEN actual IS NULL THEN 'MISSING' WHEN sha256 IS NOT NULL AND sha256 <> actual THEN 'MISMATCH' ELSE 'OK' END AS status FROM l LEFT JOIN h USING (filename)""",
    "unit_conversions": f"WITH {LINES} SELECT edge_id, segment, length_m / 1000.0 AS length_km, length_m / 10.0 * 3.6 AS speed_km_h, grade_ratio * 100.0 AS grade_percent, grade_ratio * 100.0 / 100.0 AS grade_back, round(atan(grade_ratio), 9) AS angle_rad FROM lines",
    "simulate_summary": f"""WITH RECURSIVE {SIMULATED}
SELECT edge_id || '/coarse' AS run_id, reason = 'route_end' AS completed_route, reason AS stop_reason, round(t, 6) AS elapsed_time_s, round(d, 6) AS distance_m, round(v, 6) AS final_speed_m_s, round(t - still, 6) AS moving_time_s,
       round(fb, 6) AS first_below_threshold_time_s, round(fz, 6) AS first_zero_speed_time_s, round(CASE WHEN reason = 'speed_threshold' THEN t END, 6) AS qualified_stop_time_s, round(still, 6) AS stationary_time_s
FROM sim WHERE reason <> ''""",
    "stop_reason_counts": f"WITH RECURSIVE {SIMULATED} SELECT reason AS stop_reason, count(*) AS runs, round(avg(t), 4) AS mean_time_s FROM sim WHERE reason <> '' GROUP BY reason",
    "simulate_trace": f"WITH RECURSIVE {SIMULATED} SELECT edge_id || '/coarse' AS run_id, step, round(t, 6) AS time_s, round(d, 6) AS distance_m, round(v, 6) AS speed_m_s FROM sim WHERE moved",
}

NAN, INF = "'nan'::DOUBLE", "'infinity'::DOUBLE"
SQL["scenario_rejects"] = f"""WITH {LINES}, given(scenario_id, mass, crr, wind, dt, dwell, longest) AS (
  VALUES ('good', 75.0::DOUBLE, 0.006::DOUBLE, 0.0::DOUBLE, 0.05::DOUBLE, 2.0::DOUBLE, 21600.0::DOUBLE), ('nan', 75.0, 0.006, {NAN}, 0.05, 2.0, 21600.0), ('endless', 75.0, 0.006, 0.0, 0.05, 2.0, {INF}), ('light', 0.0, 0.006, 0.0, 0.05, 2.0, 21600.0),
         ('held', 75.0, 0.006, 0.0, 0.0, 2.0, 21600.0), ('back', 75.0, 0.006, 0.0, -1.0, 2.0, 21600.0), ('dwell', 75.0, 0.006, 0.0, 0.05, -1.0, 21600.0), ('rough', 75.0, 0.1, 0.0, 0.05, 2.0, 21600.0)),
why AS (
  SELECT scenario_id, CASE WHEN isnan(wind) OR isinf(wind) THEN 'along_route_wind_m_s must be finite' WHEN isnan(longest) OR isinf(longest) THEN 'max_time_s must be finite' WHEN mass <= 0 THEN 'rider_mass_kg must be positive'
                           WHEN dt <= 0 THEN 'time_step_s must be positive' WHEN dwell < 0 THEN 'stop_dwell_s cannot be negative' WHEN crr < 0 OR crr >= 0.1 THEN 'rolling_resistance_coefficient must be within [0, 0.1)' END AS reject_reason
  FROM given)
SELECT edge_id || '/' || scenario_id AS run_id, reject_reason FROM (SELECT DISTINCT edge_id FROM lines) CROSS JOIN why WHERE reject_reason IS NOT NULL"""
SQL["elevation_profiles"] = f"""WITH {POLYLINES}, {_densify("10.0::DOUBLE")}
SELECT edge_id, idx, CASE WHEN edge_id % 13 <> 5 THEN 100.0::DOUBLE + idx % 7 END AS elevation_m FROM densified"""
SQL["chosen_edges"] = f"""SELECT edge_id, way_id, edge_id IN (SELECT edge_id FROM ({SQL["selected_edges"]})) AS chosen FROM ({SQL["directed_edges"]})"""
SQL["new_files"] = "SELECT 'doc-' || doc_id AS filename FROM documents WHERE doc_id % 3 = 0"

USABLE = _points("SELECT way_id AS edge_id, i, 6.1::DOUBLE + 0.0001::DOUBLE * (way_id % 97 + 7 * i) AS lon, 45.1::DOUBLE + 0.0001::DOUBLE * (way_id % 89 + 5 * i) AS lat FROM classed, range(3) AS r(i) WHERE list_contains(directions, 'forward') AND highway IS NOT NULL AND structure_status = 'normal' AND access_status = 'admissible'")
LIVE = f"""{WAYS}, {USABLE.replace("pts AS", "all_pts AS")},
reached AS (SELECT edge_id, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS m FROM all_pts WINDOW w AS (PARTITION BY edge_id ORDER BY i)),
picked AS (SELECT edge_id FROM reached GROUP BY edge_id HAVING sum(m) BETWEEN 80 AND 2000 ORDER BY edge_id LIMIT 8),
pts AS (SELECT * FROM all_pts SEMI JOIN picked USING (edge_id)),
{_densify("spacing", "SELECT UNNEST([2.0, 5.0, 10.0, 25.0]::DOUBLE[]) AS spacing")},
live AS (SELECT *, 1000.0::DOUBLE - idx * spacing_m * 0.03::DOUBLE + (idx % 3) * 0.05::DOUBLE AS z FROM densified)"""
SQL["live_profiles"] = f"""WITH {LIVE}
SELECT 'osm-way-' || edge_id || '-forward' AS edge_id, spacing_m, idx, 'live' AS source, '2026-01-01' AS retrieved_at, round(chainage_m, 2) AS chainage_m, round(lon, 8) AS longitude, round(lat, 8) AS latitude,
       round(x_m, 2) AS x_epsg2154_m, round(y_m, 2) AS y_epsg2154_m, round(z, 6) AS elevation_rge_alti_m FROM live"""
LIVE_LINES = f"""{LIVE},
live_pairs AS (SELECT edge_id, spacing_m, idx, sqrt((lead(x_m) OVER w - x_m) ** 2 + (lead(y_m) OVER w - y_m) ** 2) AS horizontal, lead(z) OVER w - z AS dz FROM live WINDOW w AS (PARTITION BY edge_id, spacing_m ORDER BY idx)),
live_segs AS (SELECT *, dz / horizontal AS grade, sqrt(horizontal * horizontal + dz * dz) AS travelled FROM live_pairs WHERE dz IS NOT NULL),
lines AS (SELECT edge_id || '@' || spacing_m AS edge_id, idx AS segment, travelled AS length_m, grade AS grade_ratio FROM live_segs)"""
TIMES = """round(t, 6) AS elapsed_time_s, round(t - still, 6) AS moving_time_s, round(still, 6) AS stationary_time_s, round(fb, 6) AS first_below_threshold_time_s, round(fz, 6) AS first_zero_speed_time_s,
       round(CASE WHEN reason = 'speed_threshold' THEN t END, 6) AS qualified_stop_time_s, reason AS stop_reason"""
SQL["sampling_comparison"] = f"""WITH RECURSIVE {_simulation(0.05, 21600.0, LIVE_LINES)},
stats AS (
  SELECT edge_id AS way, spacing_m, sum(horizontal) AS h, sum(travelled) AS l, sum(dz) AS net, sum(greatest(0.0, dz)) AS up, -sum(least(0.0, dz)) AS down, min(grade) AS least_grade, max(grade) AS most_grade,
         quantile_cont(grade, 0.05) AS q05, quantile_cont(grade, 0.5) AS q50, quantile_cont(grade, 0.95) AS q95, count(*) FILTER (abs(grade) > 0.5) AS anomaly_count
  FROM live_segs GROUP BY 1, 2)
SELECT 'live' AS source, '2026-01-01' AS retrieved_at, way AS osm_way_id, 'osm-way-' || way || '-forward' AS edge_id, spacing_m, round(h, 6) AS horizontal_length_m, round(l, 6) AS travelled_length_m, round(net, 6) AS net_dz_m, round(up, 6) AS ascent_m, round(down, 6) AS descent_m,
       round(least_grade, 6) AS min_grade_ratio, round(q05, 6) AS q05_grade_ratio, round(q50, 6) AS median_grade_ratio, round(q95, 6) AS q95_grade_ratio, round(most_grade, 6) AS max_grade_ratio, anomaly_count, {TIMES}, highway, '' AS surface
FROM stats JOIN sim ON sim.edge_id = way || '@' || spacing_m AND reason <> '' JOIN classed ON classed.way_id = way"""
SQL["profile_simulations"] = f"""WITH RECURSIVE {_simulation(0.5, 120.0, f"{FLAWED.split(', samples AS')[0]}, samples AS (SELECT edge_id, sample_idx, x_m, y_m, z AS elevation_m, 'EPSG:2154' AS crs, structure_status, 'terrain model' AS dataset FROM raw WHERE structure_status = 'normal'), {SEGMENTS}, {REJECTS}").replace("FROM lines) GROUP BY edge_id),", "FROM (SELECT edge_id, segment, travelled_length_m AS length_m, grade_ratio FROM segs SEMI JOIN (SELECT edge_id FROM rejects WHERE reject_reason IS NULL) USING (edge_id))) GROUP BY edge_id),", 1)}
SELECT edge_id, {TIMES} FROM sim WHERE reason <> ''"""
SQL["graph_quality"] = f"""SELECT 'live' AS source, edge_id, way_id AS osm_way_id, direction, access_status AS access, structure_status AS structure FROM ({SQL["directed_edges"]})"""
SPACED_JSON = "'{' || concat_ws(', ', " + ", ".join(f"""'"{k}": "' || {c} || '"'""" for k, c in TAGS) + ") || '}'"
SQL["structure_decisions"] = f"""WITH {WAYS}, d AS (SELECT *, UNNEST(directions) AS direction FROM classed WHERE highway IS NOT NULL)
SELECT 'live' AS source, way_id AS osm_way_id, structure_status AS structure, {SPACED_JSON} AS osm_tags, 'catalogue discovered; compact object match pending' AS bd_topo_status, 'review_required' AS decision FROM d WHERE structure_status <> 'normal'"""
SQL["extraction_counts"] = f"""WITH {LIVE} SELECT (SELECT sum(len(directions))::BIGINT FROM classed WHERE highway IS NOT NULL) AS directed_edges, (SELECT count(*) FROM picked) AS selected_profile_edges, (SELECT count(*) FROM ways WHERE way_id % 7 = 0) AS restriction_relations"""
SQL["scenario_groups"] = """WITH g AS (
  SELECT m, w, CASE m WHEN 75 THEN 0 WHEN 60 THEN 10 ELSE 20 END + CASE WHEN w > 0 THEN 1 ELSE 0 END + CASE WHEN c > 0.005 THEN 2 ELSE 0 END AS pos
  FROM (VALUES (60), (75), (90)) AS a(m), (VALUES (0.004), (0.006)) AS b(c), (VALUES (-2), (2)) AS d(w))
SELECT 'm' || m AS scenario, min(pos)::BIGINT AS first, string_agg(pos || ':' || w, ';' ORDER BY pos) AS runs FROM g GROUP BY m"""
SQL["smoothed_profiles"] = f"""WITH {SAMPLES},
d AS (SELECT *, coalesce(sqrt((x_m - lag(x_m) OVER w) ** 2 + (y_m - lag(y_m) OVER w) ** 2), 0.0) AS step FROM samples WINDOW w AS (PARTITION BY edge_id ORDER BY sample_idx)),
c AS (SELECT *, sum(step) OVER (PARTITION BY edge_id ORDER BY sample_idx ROWS UNBOUNDED PRECEDING) AS chainage_m, row_number() OVER (PARTITION BY edge_id ORDER BY sample_idx) AS nth, count(*) OVER (PARTITION BY edge_id) AS n FROM d),
m AS (SELECT *, avg(elevation_m) OVER (PARTITION BY edge_id ORDER BY chainage_m RANGE BETWEEN 61.7::DOUBLE PRECEDING AND 61.7::DOUBLE FOLLOWING) AS mean FROM c)
SELECT edge_id, sample_idx, round(chainage_m, 6) AS chainage_m, round(elevation_m, 6) AS elevation_m,
       round(CASE WHEN elevation_m IS NULL OR nth = 1 OR nth = n THEN elevation_m ELSE mean END, 6) AS smoothed_m, 'mean 61.7 m' AS scenario FROM m"""
# The large numbers cancel: what is left is the sum of the prices in cents over a power of two.
SQL["exact_totals"] = """SELECT l_returnflag, l_shipdate::DATE::VARCHAR AS day, sum(round(l_extendedprice * 100)::HUGEINT)::DOUBLE / 1048576.0::DOUBLE AS total FROM lineitem GROUP BY ALL"""
SQL["quality_rollup"] = f"""WITH {WAYS}, e AS (SELECT *, UNNEST(directions) AS direction, (way_id % 97 + 100)::BIGINT AS decimetres FROM classed WHERE highway IS NOT NULL)
SELECT highway, structure_status AS structure, access_status AS access, grouping(highway, structure_status, access_status)::BIGINT AS level, count(*) AS edges, sum(decimetres)::BIGINT AS length_dm,
       count(*) FILTER (structure_status <> 'normal') AS uncertain
FROM e GROUP BY CUBE (highway, structure_status, access_status)"""
