"""GeoJSON files and folders of static layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CrsError
from ..functions import geometry as g
from ..functions.text import file_name, file_stem, file_suffix, parse_epsg
from . import tables

# Suffixes per route.
VECTOR_SUFFIXES = (".geojson", ".shp", ".geodb")
RASTER_SUFFIXES = (".tif", ".tiff", ".geotiff")
STYLE_SUFFIXES = (".sld",)
EXTRUDED_FOLDER = "3d"
LOADED_SUFFIX = ".geojson"


def parse_collections(documents: DataFrame, properties: str, json_column: str = "value") -> DataFrame:
    """Feature collections (one JSON text per row) to feature rows with ``srid`` and a geometry struct.

    ``properties`` is the DDL of the feature properties. Other columns of ``documents`` are kept. A collection
    without a CRS is geographic (RFC 7946).
    """
    schema = (
        "struct<crs:struct<properties:struct<name:string>>,"
        f"features:array<struct<properties:struct<{properties}>,geometry:string>>>"
    )
    kept = [c for c in documents.columns if c != json_column]
    parsed = documents.select(*kept, F.from_json(F.col(json_column), schema).alias("_d"))
    name = F.coalesce("_d.crs.properties.name", F.lit("EPSG:4326"))
    rows = parsed.select(*kept, parse_epsg(name).alias("srid"), F.explode("_d.features").alias("_f"))
    return rows.select(*kept, "srid", "_f.properties.*", g.from_geojson("_f.geometry").alias("geometry"))


def require_epsg(features: DataFrame) -> DataFrame:
    """Fail when a feature's CRS is not an EPSG code."""
    if not features.filter("srid IS NULL").isEmpty():
        raise CrsError("the CRS of a vector file is not defined by an EPSG code")
    return features


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON files; property types are inferred, a named CRS must be an EPSG code or CRS84."""
    inferred = spark.read.option("multiLine", True).json(path).schema
    properties = inferred["features"].dataType.elementType["properties"].dataType
    ddl = properties.simpleString()[len("struct<") : -1]
    return require_epsg(parse_collections(spark.read.text(path, wholetext=True), ddl))


def load_file(spark: SparkSession, path: str) -> str:
    """Replace the table named after the file's stem with its features."""
    table = spark.range(1).select(file_stem(F.lit(path)).alias("stem")).first()["stem"]
    tables.replace(tables.normalise_columns(read_geojson(spark, path)), table)
    return table


def routed(files: DataFrame, path_column: str = "path") -> DataFrame:
    """Route, target name and workspace of each file by its suffix and folder; other files are left out."""
    path = F.col(path_column)
    suffix = F.lower(file_suffix(path))
    route = (
        F.when(suffix.isin(*VECTOR_SUFFIXES), "vector").when(suffix.isin(*RASTER_SUFFIXES), "raster").when(suffix.isin(*STYLE_SUFFIXES), "style")
    )
    folder = F.regexp_extract(path, r"([^/\\]+)[/\\][^/\\]*$", 1)
    workspace = F.when(folder == EXTRUDED_FOLDER, "extruded_layers").otherwise("static_files")
    return files.select(
        path.alias("path"), route.alias("route"), file_name(path).alias("file_name"), file_stem(path).alias("table_name"), workspace.alias("workspace")
    ).filter("route IS NOT NULL")


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """Files of a folder and of its extruded subfolder, not of any other, without reading their content."""
    root = tables.qualified(spark, directory)
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory).select("path", "length")
    return found.filter(parent.isin(root, f"{root}/{EXTRUDED_FOLDER}"))


def load_directory(spark: SparkSession, directory: str) -> DataFrame:
    """Load every GeoJSON file of a folder as a table and return the routed listing.

    A missing folder gives an empty listing. ``reason`` says why a listed file was not loaded.
    """
    if not tables.path_exists(spark, directory):
        return spark.createDataFrame([], "path string, route string, file_name string, table_name string, workspace string, reason string")
    reason = (
        F.when(F.col("route") != "vector", F.concat("route", F.lit(" files are left to the caller")))
        .when(F.lower(file_suffix(F.col("path"))) != LOADED_SUFFIX, F.lit("no reader for this vector format"))
    )
    listing = routed(list_files(spark, directory)).withColumn("reason", reason)
    for row in listing.filter("reason IS NULL").select("path").toLocalIterator():
        load_file(spark, row["path"])
    return listing
