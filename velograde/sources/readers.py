"""Readers of edge, way, elevation and manifest files: explicit schemas, exploded into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velograde.operators.profiles import with_chainage
from velograde.operators.quality import elevation_dataset, quality_flags
from velograde.schemas import EDGE_FILE, MANIFEST_FILE, WAY_FILE


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def edge_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples of the edges of files, with chainage, elevation dataset, flags and the digest of the own file."""
    files = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("source_sha256"), F.from_json(F.col("content").cast("string"), EDGE_FILE).alias("f"))
    edges = files.select("source_sha256", "f.crs", "f.geometry_source", "f.elevation_source", F.posexplode("f.edges").alias("pos", "e"))
    rows = edges.select("source_sha256", "crs", "geometry_source", "elevation_source", "pos", "e.id", "e.name", "e.structure", "e.access", F.posexplode("e.samples").alias("sample_idx", "p"))
    s = F.col("structure")
    rows = rows.select(
        F.col("id").alias("edge_id"), "pos", "sample_idx", "source_sha256", F.get("p", F.lit(0)).alias("x_m"), F.get("p", F.lit(1)).alias("y_m"), F.get("p", F.lit(2)).alias("elevation_m"),
        "crs", F.col("access").alias("access_status"), s.alias("structure_status"), elevation_dataset(s).alias("elevation_dataset"), quality_flags(s).alias("quality_flags"), "geometry_source", "elevation_source",
    )
    return with_chainage(rows)


def ways(spark: SparkSession, path: str) -> DataFrame:
    """(pos, type, id, tags, geometry) of the elements of a map extract."""
    return _json(spark, path, WAY_FILE).select(F.posexplode("elements").alias("pos", "w")).select("pos", "w.type", "w.id", "w.tags", "w.geometry")


def restrictions(spark: SparkSession, path: str) -> DataFrame:
    """How many restriction relations a map extract holds."""
    return _json(spark, path, WAY_FILE).select(F.explode("elements").alias("w")).where("w.type = 'relation'").agg(F.count(F.lit(1)).alias("relations"))


def decode_elevations(response: Column, expected: Column) -> Column:
    """The elevations of a response, an array of doubles; null if their number or a value is wrong.

    The list is under ``elevations``, or under ``elevation`` if that is missing or empty; an item is a number or has ``z``.
    """
    first = F.from_json(F.get_json_object(response, "$.elevations"), "array<string>")
    other = F.from_json(F.get_json_object(response, "$.elevation"), "array<string>")
    items = F.when(F.coalesce(F.size(first), F.lit(0)) > 0, first).otherwise(other)
    values = F.transform(items, lambda x: F.coalesce(x.try_cast("double"), F.get_json_object(x, "$.z").try_cast("double")))
    good = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when((F.size(values) == expected) & F.coalesce(good, F.lit(False)), values)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(id, filename, url, version, sha256) of the files of a manifest."""
    return _json(spark, path, MANIFEST_FILE).select(F.explode("files").alias("f")).select("f.*")


def verify(listed: DataFrame, held: DataFrame) -> DataFrame:
    """Compare listed files (filename, sha256 or null) with held ones (filename, actual): OK, MISSING or MISMATCH."""
    joined = listed.join(held, "filename", "left")
    status = F.when(F.col("actual").isNull(), "MISSING").when(F.col("sha256").isNotNull() & (F.lower("sha256") != F.col("actual")), "MISMATCH").otherwise("OK")
    return joined.select("filename", "sha256", "actual", status.alias("status"))


def new_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """The files (filename, ...) that are held after a run and were not before."""
    return after.join(before, "filename", "left_anti")


def held_files(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, bytes, actual) of the files of a folder."""
    return spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("actual"))
