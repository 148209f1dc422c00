"""Layer catalogue: layer extents and the nested catalogue document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import projection as p
from ..functions.text import title_from_name

# Workspaces in catalogue order and the catalogue's texts.
WORKSPACES = ("static_files", "input_layers", "extruded_layers")
EXTRUDED = "extruded_layers"
VECTOR_DESCRIPTION = "Geospatial layers fetched through the backend."
MAX_FEATURES = 60000
HEIGHT_PROPERTY = "Ext_height"
# Extent used for a layer without geometry, in the working CRS.
DEFAULT_EXTENT = (1571436.0, 5194710.0, 1577066.0, 5197969.0)


def layer_extents(layers: DataFrame, geom: str = "geometry", keys: tuple[str, ...] = ("layer_name",)) -> DataFrame:
    """Native and geographic bounding box per layer.

    The geographic box is that of the reprojected geometries, not of the reprojected box. A layer without
    any geometry gets the default extent.
    """
    moved = p.transform_geometry(geom, p.WORKING_SRID, p.GEOGRAPHIC_SRID)
    boxed = layers.select(*keys, F.col(geom).alias("_g"), F.when(F.col(geom).isNotNull(), moved).alias("_m"))
    agg = [
        fn(f"{col}.{side}").alias(f"{prefix}{side}")
        for prefix, col in (("", "_g"), ("geo_", "_m"))
        for fn, side in zip((F.min, F.min, F.max, F.max), g.BOX, strict=True)
    ]
    extents = boxed.groupBy(*keys).agg(*agg)
    xmin, ymin, xmax, ymax = (F.lit(v) for v in DEFAULT_EXTENT)
    default_geo = p.transform_geometry(g.box_geometry(xmin, ymin, xmax, ymax), p.WORKING_SRID, p.GEOGRAPHIC_SRID)
    filled = [F.coalesce(F.col(s), F.lit(v)).alias(s) for s, v in zip(g.BOX, DEFAULT_EXTENT, strict=True)]
    filled += [F.coalesce(F.col(f"geo_{s}"), default_geo[s]).alias(f"geo_{s}") for s in g.BOX]
    return extents.select(*keys, *filled)


def _item(base_url: Column) -> Column:
    workspace_url = F.concat(base_url, F.lit("/"), F.col("workspace"))
    is_vector = F.col("kind") == "vector"
    return F.struct(
        F.when(is_vector, "wfs").otherwise("wms").alias("type"),
        F.col("layer_name").alias("name"),
        F.when(is_vector, VECTOR_DESCRIPTION).alias("description"),
        F.concat(workspace_url, F.when(is_vector, "/ows").otherwise("/wms")).alias("url"),
        F.when(is_vector, F.concat_ws(":", "workspace", "layer_name")).alias("typeNames"),
        F.when(is_vector, F.lit(MAX_FEATURES)).alias("maxFeatures"),
        F.when(is_vector & (F.col("workspace") == EXTRUDED), F.lit(HEIGHT_PROPERTY)).alias("heightProperty"),
        F.when(~is_vector, F.col("layer_name")).alias("layers"),
        F.when(~is_vector, F.col("layer_name")).alias("styles"),
    )


def catalog_items(layers: DataFrame, base_url: str) -> DataFrame:
    """One row per layer ``(workspace, kind, layer_name)`` with its catalogue item struct."""
    return layers.select("workspace", "kind", "layer_name", _item(F.lit(base_url)).alias("item"))


def workspace_layers(workspaces: DataFrame, layers: DataFrame, kind: str) -> DataFrame:
    """Sorted layer names of one kind per workspace; an empty list where there are none."""
    names = layers.filter(F.col("kind") == kind).groupBy("workspace").agg(F.sort_array(F.collect_list("layer_name")).alias("layers"))
    return workspaces.join(names, "workspace", "left").select(
        "workspace", F.coalesce("layers", F.array().cast("array<string>")).alias("layers")
    )


def catalog_groups(layers: DataFrame, base_url: str, workspaces: DataFrame | None = None) -> DataFrame:
    """One catalogue group document per workspace: vectors before rasters, by name.

    Every workspace has its group, by default the catalogue's own; one without layers has no members. A group is
    one document, so all layers of a workspace meet in one row: use :func:`catalog_items` for the items as rows.
    """
    if workspaces is None:
        workspaces = layers.sparkSession.createDataFrame([(w,) for w in WORKSPACES], "workspace string")
    rank = F.when(F.col("kind") == "vector", 0).otherwise(1)
    entry = F.struct(rank.alias("rank"), F.col("layer_name").alias("name"), F.col("item").alias("item"))
    members = F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["item"])
    group = F.struct(
        F.lit("group").alias("type"),
        title_from_name(F.col("workspace")).alias("name"),
        F.coalesce("members", F.array()).alias("members"),
        F.lit(True).alias("isOpen"),
    )
    own = catalog_items(layers, base_url).groupBy("workspace").agg(members.alias("members"))
    return workspaces.select("workspace").join(own, "workspace", "left").select("workspace", F.to_json(group).alias("catalog_group"))


def catalog_document(groups: DataFrame) -> DataFrame:
    """The whole catalogue as one JSON text in workspace order; one entry per workspace reaches the task."""
    order = F.array_position(F.array(*(F.lit(w) for w in WORKSPACES)), F.col("workspace"))
    items = F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), "workspace", "catalog_group"))), lambda e: e["catalog_group"])
    return groups.agg(F.concat(F.lit('{"catalog":['), F.array_join(items, ","), F.lit("]}")).alias("catalog"))


def scenario_items(model_ids: DataFrame, base_url: str) -> DataFrame:
    """Catalogue items of a scenario: its building status view and its depth raster."""
    ows = F.lit(f"{base_url}/ows")
    buildings = F.struct(
        F.lit("wfs").alias("type"),
        F.format_string("Building flood status %d", "flood_model_id").alias("name"),
        ows.alias("url"),
        F.lit("building_flood_status").alias("typeNames"),
        F.concat(F.lit("scenario:"), F.col("flood_model_id").cast("string")).alias("viewParams"),
        F.lit(MAX_FEATURES).alias("maxFeatures"),
    )
    depth = F.struct(
        F.lit("wms").alias("type"),
        F.format_string("Flood depth %d", "flood_model_id").alias("name"),
        F.lit(f"{base_url}/wms").alias("url"),
        F.format_string("output_%d", "flood_model_id").alias("layers"),
        F.lit("depth").alias("styles"),
    )
    both = F.array(
        F.struct(F.lit("building_status").alias("item_kind"), F.to_json(buildings).alias("item")),
        F.struct(F.lit("flood_depth").alias("item_kind"), F.to_json(depth).alias("item")),
    )
    return model_ids.select("flood_model_id", F.explode(both).alias("_i")).select("flood_model_id", "_i.*")
