"""Rainfall site lists and design-rainfall text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions.text import file_stem
from ..operators.rainfall import DURATIONS
from . import tables

# Table per kind of rainfall data, and block categories.
DEPTH_TABLE, INTENSITY_TABLE = "rainfall_depth", "rainfall_intensity"
HISTORICAL, HISTORICAL_ERROR, PROJECTION = "hist", "hist_stderr", "proj"
ROW_SCHEMA = ", ".join(["ari double", "aep double", *(f"`{d}` double" for d in DURATIONS)])


def table_for(intensity: bool) -> str:
    return INTENSITY_TABLE if intensity else DEPTH_TABLE


def site_points(sites: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Site list with a point geometry last."""
    return sites.withColumn("geometry", g.point_geometry(x, y))


def read_sites(spark: SparkSession, path: str, table: str) -> None:
    """Replace the site table from a JSON-lines list."""
    tables.replace(site_points(spark.read.json(path)), table)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per site file: ``site_id`` (the file stem) and its text."""
    return spark.read.text(path, wholetext=True).select(file_stem(F.col("_metadata.file_path")).alias("site_id"), F.col("value").alias("content"))


def _lines(files: DataFrame) -> DataFrame:
    lines = files.select("site_id", F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "line"))
    before = Window.partitionBy("site_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    header = F.col("line").contains("::")
    return (
        lines.withColumn("is_header", header)
        .withColumn("block_no", F.sum(F.when(header, 1).otherwise(0)).over(before))
        .withColumn("header", F.last(F.when(header, F.col("line")), ignorenulls=True).over(before))
        .withColumn("header_line", F.last(F.when(header, F.col("line_no")), ignorenulls=True).over(before))
        .filter("block_no > 0")
    )


def _described() -> list[Column]:
    header = F.lower("header")
    rcp = F.regexp_extract(header, r"rcp\s*([0-9]+(?:\.[0-9]+)?)", 1)
    period = F.regexp_extract(header, r"([0-9]{4}-[0-9]{4})", 1)
    category = (
        F.when(rcp != "", PROJECTION).when(header.contains("standard error"), HISTORICAL_ERROR).otherwise(HISTORICAL)
    )
    return [
        F.when(rcp != "", rcp.cast("double")).alias("rcp"),
        F.when(period != "", period).alias("time_period"),
        category.alias("category"),
    ]


def block_structure(files: DataFrame) -> DataFrame:
    """Blocks of every site file: ``site_id, block_no, skip_rows, rcp, time_period, category``.

    ``skip_rows`` is the number of lines before the block's column names.
    """
    heads = _lines(files).filter("is_header")
    return heads.select("site_id", F.col("block_no").cast("int").alias("block_no"), (F.col("line_no") + 1).alias("skip_rows"), *_described())


def tabular(files: DataFrame) -> DataFrame:
    """All data rows of all files with their block's scenario: ``ari, aep`` and one column per duration."""
    rows = _lines(files).filter((F.col("line_no") > F.col("header_line") + 1) & F.col("line").rlike(r"^\s*[0-9.]+\s*,"))
    parsed = F.from_csv("line", ROW_SCHEMA)
    return rows.select("site_id", *_described(), parsed.alias("_r")).select("site_id", "category", "rcp", "time_period", "_r.*")


def unseen_sites(rows: DataFrame, stored: DataFrame) -> DataFrame:
    return tables.unseen(rows, stored.select("site_id").distinct(), ["site_id"])


def store(spark: SparkSession, files: DataFrame, intensity: bool = False) -> None:
    """Append the files of sites that are not stored yet to the table of their kind."""
    table = table_for(intensity)
    rows = tabular(files)
    if tables.exists(spark, table):
        tables.append(unseen_sites(rows, spark.table(table)), table)
    else:
        tables.replace(rows, table, partition_by=["category"])
