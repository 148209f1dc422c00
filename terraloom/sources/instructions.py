"""The layer registry: instruction files, their rules, and the layers to load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InstructionError
from ..functions.text import blank_to_null, strip
from ..session import cut_lineage
from . import tables

FIELDS = ("data_provider", "layer_id", "table_name", "unique_column_name", "coverage_area", "url")
ENTRY_TYPE = (
    "map<string,struct<data_provider:string,layer_id:int,table_name:string,unique_column_name:string,"
    "coverage_area:string,url:string>>"
)
# The country whose layers are loaded once, and the known feature providers.
COUNTRY = "New Zealand"
PROVIDERS = ("StatsNZ", "LINZ", "MFE")


def parse_instructions(documents: DataFrame, json_column: str = "value", order_column: str | None = None) -> DataFrame:
    """Instruction documents (JSON object of objects) to rows ``section`` + fields, duplicates removed.

    Rows equal in everything but the section keep the first by document order and position.
    """
    order = F.col(order_column) if order_column else F.lit(0)
    entries = documents.select(
        order.alias("_doc"),
        F.posexplode(F.map_entries(F.from_json(F.col(json_column), ENTRY_TYPE))).alias("_pos", "_entry"),
    ).select("_doc", "_pos", F.col("_entry.key").alias("section"), *(F.col(f"_entry.value.{f}").alias(f) for f in FIELDS))
    stripped = entries.withColumn("url", strip(F.col("url")))
    return tables.first_per_key(stripped, FIELDS, ["_doc", "_pos"]).select("section", *FIELDS)


def read_instructions(spark: SparkSession, path: str | None) -> DataFrame:
    """Read and check one instruction file; no path, or one that does not exist, gives the typed empty frame."""
    if path is None or not tables.path_exists(spark, path):
        fields = ", ".join(f"{f} {'int' if f == 'layer_id' else 'string'}" for f in FIELDS)
        return spark.createDataFrame([], f"section string, {fields}")
    found = cut_lineage(parse_instructions(spark.read.text(path, wholetext=True)))
    require_valid(found)
    return found


def violations(instructions: DataFrame) -> DataFrame:
    """Instructions that set both or neither of the two optional fields; blank counts as missing."""
    unique = blank_to_null(F.col("unique_column_name")).isNotNull()
    area = blank_to_null(F.col("coverage_area")).isNotNull()
    problem = (
        F.when(unique & area, F.lit("both coverage_area and unique_column_name are set"))
        .when(~unique & ~area, F.lit("neither coverage_area nor unique_column_name is set"))
    )
    return instructions.withColumn("problem", problem).filter("problem IS NOT NULL")


def never_loaded(registry: DataFrame) -> DataFrame:
    """Registry rows that no layer selector picks: a coverage area other than the country."""
    return registry.filter((F.col("coverage_area") != COUNTRY) & F.col("unique_column_name").isNull())


def require_valid(instructions: DataFrame) -> None:
    first = violations(instructions).select("section", "problem").take(1)
    if first:
        raise InstructionError(f"{first[0]['section']}: {first[0]['problem']}")


def registry_keys(registry: DataFrame) -> DataFrame:
    return registry.select("data_provider", "layer_id")


def new_records(instructions: DataFrame, existing: DataFrame) -> DataFrame:
    """Instructions whose (provider, layer) is not registered, without the section and with the URL last."""
    return tables.unseen(instructions, existing, ["data_provider", "layer_id"]).select(*FIELDS)


def upserted(registry: DataFrame, instructions: DataFrame) -> DataFrame:
    """The registry with the new instructions appended under fresh ids."""
    fresh = tables.with_new_ids(
        new_records(instructions, registry_keys(registry)), registry, "unique_id", ["data_provider", "layer_id", "table_name", "url"]
    )
    return registry.unionByName(fresh.select(registry.columns))


def store_instructions(spark: SparkSession, table: str, path: str | None) -> None:
    """Create the registry if absent and append the records it lacks."""
    tables.create_if_absent(spark, table, tables.REGISTRY_SCHEMA)
    registry = spark.table(table)
    fresh = new_records(read_instructions(spark, path), registry_keys(registry))
    tables.append(tables.with_new_ids(fresh, registry, "unique_id", ["data_provider", "layer_id", "table_name", "url"]), table)


def country_layers(registry: DataFrame) -> DataFrame:
    """Layers loaded once for the whole country."""
    return registry.filter((F.col("coverage_area") == COUNTRY) & F.col("unique_column_name").isNull()).drop("unique_id")


def area_layers(registry: DataFrame) -> DataFrame:
    """Layers fetched per area of interest."""
    elsewhere = (F.col("coverage_area") != COUNTRY) | F.col("coverage_area").isNull()
    return registry.filter(F.col("unique_column_name").isNotNull() & elsewhere).drop("unique_id")


def layer_info(registry: DataFrame, *more: str) -> DataFrame:
    return registry.select("data_provider", "layer_id", "table_name", "unique_column_name", *more)
