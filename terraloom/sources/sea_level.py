"""Sea-level-rise files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import projection as p
from ..functions.text import file_stem
from . import tables


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All region files of a folder in one frame, with the file stem as ``region``."""
    return spark.read.csv(path, header=True, schema=schema).withColumn("region", file_stem(F.col("_metadata.file_path")))


def with_points(rows: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Projected coordinates and a point geometry in place of longitude and latitude."""
    x, y = p.to_projected(F.col(lon), F.col(lat))
    return rows.withColumn("x", x).withColumn("y", y).drop(lon, lat).withColumn("geometry", g.point_geometry("x", "y"))


def split_measurement(rows: DataFrame, column: str = "measurementname") -> DataFrame:
    """Scenario, confidence level, land movement and percentile out of one composite name."""
    name = F.col(column)
    percentile = F.coalesce(
        F.nullif(F.regexp_extract(name, r"(?i)\bp([0-9]+)\b", 1), F.lit("")),
        F.nullif(F.regexp_extract(name, r"(?i)([0-9]+)(?:th|st|nd|rd)?\s*percentile", 1), F.lit("")),
    )
    return rows.select(
        *(c for c in rows.columns if c != column),
        F.nullif(F.upper(F.regexp_extract(name, r"(?i)(SSP[0-9]-[0-9](?:\.[0-9])?)", 1)), F.lit("")).alias("ssp_scenario"),
        F.nullif(F.lower(F.regexp_extract(name, r"(?i)\b(low|medium)\b", 1)), F.lit("")).alias("confidence_level"),
        name.rlike(r"(?i)\bVLM\b").alias("add_vlm"),
        percentile.cast("int").alias("percentile"),
    )


def store(rows: DataFrame, table: str) -> None:
    tables.replace(rows, table)
