"""Incremental layer ingestion for areas of interest.

Order matters and is kept: features first, the coverage log last. A run that dies in between leaves rows
without a log entry, and the next run skips them by id.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..errors import NothingUncoveredError
from ..functions import geometry as g
from ..operators.overlay import uncovered_area
from ..operators.spatial_join import semi_join
from ..session import cut_lineage
from ..sources import instructions, tables, vector_files

log = logging.getLogger(__name__)

# A fetcher gets a registry row and the rectangles to fetch (None: everything) and returns features with a
# geometry struct; ``features.fetcher`` makes one that asks for the pages that meet the rectangles.
Fetch = Callable[[Row, DataFrame | None], DataFrame]


@dataclass(frozen=True)
class Store:
    """Names of the metadata tables of one deployment."""

    spark: SparkSession
    registry: str = "geospatial_layers"
    coverage_log: str = "user_log_information"
    cell_size: float = 10_000.0

    def prepare(self) -> None:
        tables.create_if_absent(self.spark, self.registry, tables.REGISTRY_SCHEMA)
        tables.create_if_absent(self.spark, self.coverage_log, tables.COVERAGE_LOG_SCHEMA)


def load_country_layers(store: Store, fetch: Fetch) -> list[str]:
    """Load each country-wide layer whose table does not exist yet; returns the tables written."""
    written = []
    for layer in instructions.layer_info(instructions.country_layers(store.spark.table(store.registry)), "url").collect():
        if tables.exists(store.spark, layer["table_name"]):
            log.info("%s is already loaded", layer["table_name"])
            continue
        tables.replace(tables.normalise_columns(fetch(layer, None)), layer["table_name"])
        written.append(layer["table_name"])
    return written


def area_to_fetch(store: Store, areas: DataFrame, table_name: str) -> DataFrame:
    """Rectangles of ``areas(aoi_id, xmin..ymax)`` that were never fetched for this table."""
    requests = areas.select("aoi_id", F.lit(table_name).alias("table_name"), *g.BOX)
    pieces = cut_lineage(uncovered_area(requests, store.spark.table(store.coverage_log), store.cell_size))
    if pieces.isEmpty():
        raise NothingUncoveredError(f"{table_name}: the requested areas are already covered")
    return pieces.select("aoi_id", *g.BOX)


def features_in(features: DataFrame, pieces: DataFrame, key: str, cell_size: float) -> DataFrame:
    """Features that meet any of the rectangles."""
    boxed = features.select("*", *(F.col(f"geometry.{s}").alias(f"_f_{s}") for s in g.BOX))
    shaped = pieces.select(*(F.col(s).alias(f"_p_{s}") for s in g.BOX), g.box_geometry(*g.BOX).alias("_piece"))
    kept = semi_join(
        boxed,
        shaped,
        [key],
        cell_size,
        left_box=[f"_f_{s}" for s in g.BOX],
        right_box=[f"_p_{s}" for s in g.BOX],
        left_columns=["geometry"],
        refine=g.intersects("geometry", "_piece"),
    )
    return kept.drop(*(f"_f_{s}" for s in g.BOX))


def load_layer(store: Store, layer: Row, areas: DataFrame, fetch: Fetch) -> None:
    """First load (replace) or append of unseen features of one layer."""
    table, key = layer["table_name"], layer["unique_column_name"].lower()
    pieces = area_to_fetch(store, areas, table)
    fetched = tables.normalise_columns(fetch(layer, pieces))
    if key not in fetched.columns:
        raise ValueError(f"{table}: the fetched features have no column {key}")
    found = tables.first_per_key(features_in(fetched, pieces, key, store.cell_size), [key], ["geometry.xmin", "geometry.ymin"])
    found = cut_lineage(found)
    if found.isEmpty():
        log.info("the areas hold no %s features", table)
        return
    if not tables.exists(store.spark, table):
        tables.replace(found, table)
        return
    stored = features_in(store.spark.table(table), pieces, key, store.cell_size)
    tables.append(tables.unseen(found, stored, [key]), table)


def load_area_layers(store: Store, areas: DataFrame, fetch: Fetch) -> None:
    for layer in instructions.layer_info(instructions.area_layers(store.spark.table(store.registry)), "url").collect():
        try:
            load_layer(store, layer, areas, fetch)
        except NothingUncoveredError as done:
            log.info(done)


def coverage_rows(registry: DataFrame, areas: DataFrame) -> DataFrame:
    """One log row per area, listing all area-fetched tables whether or not a fetch returned rows."""
    names = [r["table_name"] for r in instructions.area_layers(registry).select("table_name").distinct().collect()]
    listed = F.array(*(F.lit(n) for n in sorted(names))).cast("array<string>")
    return areas.select(
        *(F.col(s).cast("double").alias(s) for s in g.BOX),
        listed.alias("source_table_list"),
        F.current_timestamp().alias("created_at"),
    )


def log_coverage(store: Store, areas: DataFrame, once: bool = False) -> None:
    """Append the areas' rows. ``once``: an area's id is kept with its row, and an id that the log has is not logged again."""
    if once:
        logged = store.spark.table(store.coverage_log)
        if "request_id" in logged.columns:
            areas = areas.join(logged.select(F.col("request_id").alias("aoi_id")), "aoi_id", "left_anti")
    rows = coverage_rows(store.spark.table(store.registry), areas)
    if once:
        rows = areas.select(F.col("aoi_id").alias("request_id"), *g.BOX).join(rows.dropDuplicates(list(g.BOX)), list(g.BOX))
    numbered = tables.with_new_ids(rows, store.spark.table(store.coverage_log), "unique_id", list(g.BOX))
    tables.append(numbered, store.coverage_log)


def ingest(store: Store, areas: DataFrame, fetch: Fetch, instruction_file: str | None = None, static_directory: str | None = None, once: bool = False) -> None:
    """The whole load: registry, country layers, area layers, static files, coverage log."""
    store.prepare()
    instructions.store_instructions(store.spark, store.registry, instruction_file)
    load_country_layers(store, fetch)
    load_area_layers(store, areas, fetch)
    if static_directory is not None:
        vector_files.load_directory(store.spark, static_directory)
    log_coverage(store, areas, once)
