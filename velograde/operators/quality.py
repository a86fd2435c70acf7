"""Quality reports on edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Fixed value: why an edge off the ground has no elevation.
UNCERTAIN = "roadway elevation unavailable; terrain DEM forbidden"


def quality_flags(structure: Column) -> Column:
    return F.when(structure != "normal", F.array(F.lit("roadway_elevation_unknown"))).otherwise(F.array().cast("array<string>"))


def simulable(structure: Column) -> Column:
    """Whether an edge may be simulated: by its structure alone."""
    return structure == "normal"


def elevation_dataset(structure: Column) -> Column:
    return F.when(structure == "normal", "terrain fixture").otherwise("unknown roadway elevation")


def edge_quality(edges: DataFrame) -> DataFrame:
    """(edge_id, access, structure, simulable, quality_flags) of edges (edge_id, access_status, structure_status)."""
    s = F.col("structure_status")
    return edges.select("edge_id", F.col("access_status").alias("access"), s.alias("structure"), simulable(s).alias("simulable"), F.array_join(quality_flags(s), ";").alias("quality_flags"))


def uncertain_edges(edges: DataFrame) -> DataFrame:
    """Edges that need another source of elevation."""
    return edges.where("structure_status <> 'normal'").select("edge_id", F.col("structure_status").alias("structure"), F.lit(UNCERTAIN).alias("reason"))


def structure_review(edges: DataFrame) -> DataFrame:
    """Edges off the ground with their tags as JSON in the order of keys."""
    tags = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("tags"))))
    return edges.where("structure_status <> 'normal'").select("edge_id", F.col("structure_status").alias("structure"), F.col("access_status").alias("access"), tags.alias("tags"))


def not_available(spark, reasons: dict[str, str]) -> DataFrame:
    """A table that says why something was not made."""
    return spark.createDataFrame(sorted(reasons.items()), "item string, status string")


def rollup(edges: DataFrame, classes: tuple[str, ...], length: str) -> DataFrame:
    """Numbers, lengths and uncertain edges (structure_status not normal) for each combination of classes and all their totals.

    One expanded plan: each row is aggregated before the shuffle, once per grouping set. ``level`` has a bit per class, set where the row is a
    total over it; so a null class and a total differ.
    """
    off = F.count_if(F.coalesce("structure_status", F.lit("unknown")) != "normal")
    return edges.cube(*classes).agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("edges"), F.sum(length).alias("length"), off.alias("uncertain"))
