"""Views over stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def building_status_for(buildings: DataFrame, status: DataFrame, scenario: int) -> DataFrame:
    """Buildings with their flood status in one scenario."""
    return buildings.sparkSession.sql(
        """SELECT b.*, s.is_flooded, s.flood_model_id FROM {buildings} b
           JOIN {status} s ON s.building_outline_id = b.building_outline_id
           WHERE s.flood_model_id = :scenario""",
        args={"scenario": scenario},
        buildings=buildings,
        status=status,
    )


def create_building_view(spark: SparkSession, view: str, buildings_table: str, status_table: str) -> None:
    """Session view of all statuses; filter it by ``flood_model_id`` (the partition column) when reading."""
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY VIEW {view} AS
            SELECT b.*, s.is_flooded, s.flood_model_id FROM {buildings_table} b
            JOIN {status_table} s ON s.building_outline_id = b.building_outline_id"""
    )
