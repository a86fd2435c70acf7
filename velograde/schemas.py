"""Schemas of the sources: all explicit, none inferred."""

from __future__ import annotations

from pyspark.sql import types as T

PROVENANCE = T.StructType([T.StructField(n, T.StringType()) for n in ("producer", "dataset", "version", "retrieval_date", "source_url", "original_crs", "original_units", "sha256")])

EDGE_FILE = "fixture_status string, crs string, geometry_source string, elevation_source string, edges array<struct<id:string,name:string,structure:string,access:string,samples:array<array<double>>>>"
WAY_FILE = "elements array<struct<type:string,id:bigint,tags:map<string,string>,geometry:array<struct<lon:double,lat:double>>>>"
MANIFEST_FILE = "study_area string, bbox_wgs84 array<double>, target_crs string, generated_at_utc string, network_required_for_refresh boolean, files array<struct<id:string,filename:string,url:string,version:string,sha256:string>>"

SAMPLES = "edge_id string, sample_idx int, x_m double, y_m double, elevation_m double, chainage_m double, crs string, access_status string, structure_status string, elevation_dataset string, quality_flags array<string>"
PROFILE = "array<struct<length_m:double,grade_ratio:double>>"

ACCESS = ("admissible", "prohibited", "review")
STRUCTURE = ("normal", "bridge", "tunnel", "stacked")
STOP_REASONS = ("route_end", "speed_threshold", "max_time")
