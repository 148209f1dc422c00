"""River network as node and edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import geometry as g
from ..functions import pairs
from ..session import cut_lineage
from ..sources import tables
from .components import connected_components, reachable
from .spatial_join import _dealt, _gridded, intersecting_pairs

# Exclusion causes stored with removed reaches.
CAUSE_CATCHMENT = "not inside one sea-draining catchment"
CAUSE_DIRECTION = "no edge direction"
CAUSE_UNCONNECTED = "unconnected to the end nodes of its catchment"


def tag_catchments(reaches: DataFrame, catchments: DataFrame, catchment_id: str, cell_size: float) -> DataFrame:
    """Catchment that fully contains each reach (the smallest id), or the exclusion cause.

    A catchment containing a reach contains its first point, so each reach probes one grid cell. Reaches and catchments of a
    cell are tested a block of pairs at a time (:mod:`..functions.pairs`).
    """

    def ends(geom: str) -> Column:
        return F.flatten(F.transform(g.segments(geom), lambda s: F.array(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])))

    first = g.first_point("geometry")
    points = F.flatten(F.transform(F.flatten(F.flatten("geometry.parts")), lambda p: F.array(p["x"], p["y"])))
    box = [F.col(f"geometry.{s}").alias(f"_{s}") for s in g.BOX]
    probes = reaches.select("objectid", ends("geometry").alias("_inner"), points.alias("_points"), *box, first["x"].alias("_px"), first["y"].alias("_py"))
    boxed = catchments.select(catchment_id, ends("geometry").alias("_edges"), *box)
    lhs, rhs, on = _gridded(probes, boxed, cell_size, ("_px", "_py", "_px", "_py"), [f"_{s}" for s in g.BOX], ())
    # Empty lists, not null ones: Arrow's writer goes over all nulls of a list column again with every row.
    none = F.array().cast("array<double>")
    lists, kinds = ("_edges", "_inner", "_points"), {"objectid": reaches.schema["objectid"].dataType, catchment_id: catchments.schema[catchment_id].dataType}

    def rows(df: DataFrame, is_line: bool) -> DataFrame:
        own = {c: F.coalesce(c, none) if c in df.columns else none for c in lists}
        own |= {c: F.col(c) if c in df.columns else F.lit(None).cast(kind) for c, kind in (kinds | {"_px": "double", "_py": "double"}).items()}
        return df.select(*on, F.lit(is_line).alias("_line"), *(f"_{s}" for s in g.BOX), *(value.alias(c) for c, value in own.items()))

    celled = _dealt(rows(lhs, True).unionByName(rows(rhs, False)), on).sortWithinPartitions(*on, "_line")
    held = celled.mapInArrow(pairs.containing(tuple(kinds)), StructType([StructField(c, kind) for c, kind in kinds.items()]))
    tagged = held.groupBy("objectid").agg(F.min(catchment_id).alias(catchment_id))
    return reaches.select("objectid").join(tagged.hint("merge"), "objectid", "left").withColumn(
        "exclusion_cause", F.when(F.col(catchment_id).isNull(), F.lit(CAUSE_CATCHMENT))
    )


def reach_ends(reaches: DataFrame, geom: str = "geometry") -> DataFrame:
    """Add the first and last point of every reach as ``first_x, first_y, last_x, last_y``."""
    first, last = g.first_point(geom), g.last_point(geom)
    return reaches.select(
        "*", first["x"].alias("first_x"), first["y"].alias("first_y"), last["x"].alias("last_x"), last["y"].alias("last_y")
    )


def unique_nodes(ends: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Distinct end points with consecutive integer ids: ``node_id, x, y``, and the columns ``within`` that part them."""
    ends_of = F.array(*(F.struct(F.col(f"{end}_x").alias("x"), F.col(f"{end}_y").alias("y")) for end in ("first", "last")))
    points = ends.select(*within, F.explode(ends_of).alias("p")).select(*within, "p.x", "p.y").distinct()
    none = points.select(F.lit(0).cast("bigint").alias("node_id")).limit(0)
    return tables.with_new_ids(points, none, "node_id", [*within, "x", "y"]).select("node_id", *within, "x", "y")


def intersection_type(area: Sequence[Column]) -> Column:
    """Whether both, one or none of the ends of an edge lie in the rectangle: inside, crossing or outside."""
    xmin, ymin, xmax, ymax = area

    def inside(prefix: str) -> Column:
        return F.col(f"{prefix}_x").between(xmin, xmax) & F.col(f"{prefix}_y").between(ymin, ymax)

    return (
        F.when(inside("first") & inside("last"), "inside")
        .when(inside("first") | inside("last"), "crossing")
        .otherwise("outside")
    )


def edges_between(ends: DataFrame, nodes: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Reaches as edges ``src -> dst`` in digitised direction."""
    source = nodes.select(*within, F.col("node_id").alias("src"), F.col("x").alias("first_x"), F.col("y").alias("first_y"))
    target = nodes.select(*within, F.col("node_id").alias("dst"), F.col("x").alias("last_x"), F.col("y").alias("last_y"))
    # Here and below by shuffle: tables read back are small files of very many rows, which a broadcast would pass through the driver.
    return ends.join(source.hint("merge"), [*within, "first_x", "first_y"]).join(target.hint("merge"), [*within, "last_x", "last_y"])


def prepared_edges(ends: DataFrame, nodes: DataFrame, area: tuple[float, float, float, float]) -> DataFrame:
    """Edges ``src -> dst`` with the intersection type of their ends and one area."""
    return edges_between(ends, nodes).withColumn("intersection_type", intersection_type([F.lit(float(v)) for v in area]))


def absent_edges(prepared: DataFrame, present: DataFrame) -> DataFrame:
    """Prepared edges not in the network yet."""
    return prepared.join(present.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def with_absent_edges(prepared: DataFrame, present: DataFrame) -> DataFrame:
    missing = absent_edges(prepared, present)
    return present.unionByName(missing.select(present.columns))


def edge_directions(edges: DataFrame, outlets: DataFrame) -> DataFrame:
    """Add ``edge_direction``: ``to`` when the digitised line runs toward the outlet, ``from`` when it runs away.

    The measure is the number of reaches between a node and the nearest outlet; equal or unknown depths
    leave the direction null.
    """
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    depth = reachable(both, outlets.select("id"))
    start = depth.select(F.col("id").alias("src"), F.col("depth").alias("src_depth"))
    end = depth.select(F.col("id").alias("dst"), F.col("depth").alias("dst_depth"))
    return (
        edges.join(start.hint("merge"), "src", "left")
        .join(end.hint("merge"), "dst", "left")
        .withColumn(
            "edge_direction",
            F.when(F.col("src_depth") > F.col("dst_depth"), "to").when(F.col("src_depth") < F.col("dst_depth"), "from"),
        )
    )


def connected_to_outlets(edges: DataFrame, outlets: DataFrame, catchment: str | None = None) -> DataFrame:
    """Add ``connected``: whether an edge's component holds an outlet of its own catchment."""
    scope = F.col(catchment) if catchment else F.lit(0)

    def node(column: str):
        return F.struct(scope.alias("c"), F.col(column).alias("n"))

    scoped = edges.withColumn("_src", node("src")).withColumn("_dst", node("dst"))
    parts = cut_lineage(connected_components(scoped.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))))
    ends = outlets.select(node("id").alias("id"))
    good = parts.join(ends, "id", "left_semi").select("component").distinct().withColumn("connected", F.lit(True))
    tagged = scoped.join(parts.withColumnRenamed("id", "_src"), "_src", "left").join(good, "component", "left")
    return tagged.withColumn("connected", F.coalesce("connected", F.lit(False))).drop("component", "_src", "_dst")


def build_network(
    reaches: DataFrame, outlets_at: DataFrame, area: tuple[float, float, float, float]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, kept edges with direction, and excluded reaches with their cause.

    ``outlets_at(x, y)`` are the end nodes of the sea-draining catchments.
    """
    ends = reach_ends(reaches)
    nodes = cut_lineage(unique_nodes(ends))
    edges = cut_lineage(prepared_edges(ends, nodes, area).drop("geometry"))
    outlets = nodes.join(outlets_at.select("x", "y").distinct(), ["x", "y"], "left_semi").select(F.col("node_id").alias("id"))
    connected = connected_to_outlets(edges, outlets)
    directed = cut_lineage(edge_directions(connected, outlets))
    cause = F.when(~F.col("connected"), CAUSE_UNCONNECTED).when(F.col("edge_direction").isNull(), CAUSE_DIRECTION)
    judged = directed.withColumn("exclusion_cause", cause)
    kept = judged.filter("exclusion_cause IS NULL").select("objectid", "src", "dst", "intersection_type", "edge_direction")
    return nodes, kept, judged.filter("exclusion_cause IS NOT NULL").select("objectid", "exclusion_cause")


# ---------------------------------------------------------------- networks of many areas


def _outlines(catchments: DataFrame, catchment_id: str) -> DataFrame:
    return catchments.select(catchment_id, F.col("geometry").alias("_outline"), *(F.col(f"geometry.{s}").alias(f"_b_{s}") for s in g.BOX))


def catchments_of_areas(areas: DataFrame, catchments: DataFrame, catchment_id: str, cell_size: float) -> DataFrame:
    """Catchments that meet each area, with the area's box: ``aoi_id, xmin .. ymax`` and the catchment."""
    boxes = areas.select("aoi_id", *(F.col(s).cast("double").alias(s) for s in g.BOX))
    pairs = intersecting_pairs(
        _outlines(catchments, catchment_id),
        boxes,
        cell_size,
        left_box=[f"_b_{s}" for s in g.BOX],
        refine=g.intersects("_outline", g.box_geometry(*g.BOX)),
    )
    return pairs.select("aoi_id", *g.BOX, catchment_id)


def directed_edges(
    tagged: DataFrame, end_nodes: DataFrame, catchment_id: str
) -> tuple[DataFrame, DataFrame]:
    """Nodes, and reaches with their direction or exclusion cause, of all catchments in one keyed graph.

    ``tagged`` are reaches with their catchment. A point that ends reaches of two catchments is a node of each, so no
    path leaves a catchment. One search from all ``end_nodes`` (the catchment, ``x, y``) gives depths, and with them
    also what is connected.
    """
    within = [catchment_id]
    ends = cut_lineage(reach_ends(tagged).select("objectid", catchment_id, "first_x", "first_y", "last_x", "last_y"))
    nodes = cut_lineage(unique_nodes(ends, within))
    edges = cut_lineage(edges_between(ends, nodes, within))
    outlets = nodes.join(end_nodes.select(catchment_id, "x", "y").distinct(), [catchment_id, "x", "y"], "left_semi")
    directed = edge_directions(edges, outlets.select(F.col("node_id").alias("id")))
    cause = F.when(F.col("src_depth").isNull(), CAUSE_UNCONNECTED).when(F.col("edge_direction").isNull(), CAUSE_DIRECTION)
    return nodes, cut_lineage(directed.drop("dst_depth").withColumn("exclusion_cause", cause).drop("src_depth"))


def build_networks(
    areas: DataFrame, reaches: DataFrame, catchments: DataFrame, end_nodes: DataFrame, catchment_id: str, cell_size: float
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Networks of many areas at once: nodes, kept edges and excluded reaches, each with its ``aoi_id``.

    An area's network is that of all catchments that meet it (``end_nodes`` are their mouths: catchment, ``x, y``).
    Depths, directions and causes do not depend on the area, so the graph is searched once per catchment, however many
    areas share it, and areas meet its rows in one join at the end. A reach inside no catchment is excluded from the
    networks of all areas of the catchments it meets; one that meets no catchment is in none. A reach without a
    geometry counts as the latter. Columns other than ``objectid`` and ``geometry`` of the reaches are not carried.
    """
    scope = cut_lineage(catchments_of_areas(areas, catchments, catchment_id, cell_size))
    wanted = scope.select(catchment_id).distinct()
    lines = reaches.select("objectid", "geometry").filter("geometry IS NOT NULL")
    tags = cut_lineage(tag_catchments(lines, catchments, catchment_id, cell_size))
    held = tags.filter("exclusion_cause IS NULL").select("objectid", catchment_id).join(wanted.hint("merge"), catchment_id, "left_semi")
    nodes, judged = directed_edges(lines.join(held.hint("merge"), "objectid"), end_nodes, catchment_id)

    stray = lines.join(tags.filter("exclusion_cause IS NOT NULL").select("objectid").hint("merge"), "objectid", "left_semi")
    stray = stray.select("objectid", F.col("geometry").alias("_line"), *(F.col(f"geometry.{s}").alias(f"_l_{s}") for s in g.BOX))
    met = intersecting_pairs(
        stray,
        _outlines(catchments.join(wanted, catchment_id, "left_semi"), catchment_id),
        cell_size,
        left_box=[f"_l_{s}" for s in g.BOX],
        right_box=[f"_b_{s}" for s in g.BOX],
        refine=g.intersects("_line", "_outline"),
    ).select("objectid", catchment_id)
    # A reach may meet several catchments of an area.
    outside = met.join(scope.select("aoi_id", catchment_id).hint("merge"), catchment_id).select("aoi_id", "objectid").distinct()

    of_areas = judged.join(scope.hint("merge"), catchment_id)
    kept = of_areas.filter("exclusion_cause IS NULL").select(
        "aoi_id", "objectid", catchment_id, "src", "dst", intersection_type([F.col(s) for s in g.BOX]).alias("intersection_type"), "edge_direction"
    )
    excluded = of_areas.filter("exclusion_cause IS NOT NULL").select("aoi_id", "objectid", "exclusion_cause")
    excluded = excluded.unionByName(outside.withColumn("exclusion_cause", F.lit(CAUSE_CATCHMENT)))
    return nodes.join(scope.select("aoi_id", catchment_id).hint("merge"), catchment_id).select("aoi_id", "node_id", catchment_id, "x", "y"), kept, excluded


def downstream_lines(reaches: DataFrame, kept: DataFrame) -> DataFrame:
    """``objectid, geometry`` of the reaches of kept edges, once each, drawn the way the water flows."""
    directions = kept.select("objectid", "edge_direction").distinct()
    turned = F.when(F.col("edge_direction") == "from", g.reversed_line("geometry")).otherwise(F.col("geometry"))
    return reaches.select("objectid", "geometry").join(directions.hint("merge"), "objectid").select("objectid", turned.alias("geometry"))


# ---------------------------------------------------------------- stored networks


def output_metadata(networks: DataFrame, root: str, area: tuple[float, float, float, float]) -> DataFrame:
    """Metadata row of the next network: id, the paths of its tables and its area."""
    row = tables.next_id(networks, "rec_network_id")
    base = F.concat(F.lit(f"{root}/network_"), F.col("rec_network_id").cast("string"))
    return row.select(
        "rec_network_id",
        F.concat(base, F.lit("/nodes")).alias("network_path"),
        F.concat(base, F.lit("/edges")).alias("network_data_path"),
        F.current_timestamp().alias("created_at"),
        *(F.lit(float(v)).alias(s) for v, s in zip(area, g.BOX, strict=True)),
    )


def existing_network(requests: DataFrame, networks: DataFrame, cell_size: float) -> DataFrame:
    """Per requested area the stored network whose area contains it (the newest), or null."""
    wanted = requests.select("aoi_id", *(F.col(s).alias(f"want_{s}") for s in g.BOX))
    hits = intersecting_pairs(
        wanted,
        networks.select("rec_network_id", *g.BOX),
        cell_size,
        left_box=("want_xmin", "want_ymin", "want_xmin", "want_ymin"),
        refine=g.box_contains([F.col(s) for s in g.BOX], [F.col(f"want_{s}") for s in g.BOX]),
    )
    best = hits.groupBy("aoi_id").agg(F.max("rec_network_id").alias("rec_network_id"))
    return requests.select("aoi_id").join(best, "aoi_id", "left")


def exclusion_rows(excluded: DataFrame, reaches: DataFrame, network_id: int) -> DataFrame:
    return excluded.join(reaches.select("objectid", g.to_wkt("geometry").alias("wkt")), "objectid").select(
        F.lit(network_id).cast("bigint").alias("rec_network_id"), "objectid", "exclusion_cause", "wkt"
    )


def store_network(
    spark: SparkSession, metadata: DataFrame, nodes: DataFrame, edges: DataFrame, exclusions: DataFrame, table: str, exclusion_table: str
) -> int:
    """Write the network's tables first and its metadata row last, so a crash leaves no half-known network."""
    row = metadata.first()
    nodes.write.mode("overwrite").parquet(row["network_path"])
    edges.write.mode("overwrite").parquet(row["network_data_path"])
    tables.create_if_absent(spark, exclusion_table, tables.NETWORK_EXCLUSION_SCHEMA)
    tables.append(exclusions, exclusion_table)
    tables.create_if_absent(spark, table, tables.RIVER_NETWORK_SCHEMA)
    tables.append(spark.createDataFrame([row], metadata.schema), table)
    return row["rec_network_id"]


def _write_run(df: DataFrame, path: str) -> None:
    """The networks of one run as files of many networks, each in few of them; a repeated run replaces its folder."""
    df.hint("rebalance", "rec_network_id").sortWithinPartitions("rec_network_id", "objectid" if "objectid" in df.columns else "node_id").write.mode("overwrite").parquet(path)


def networks_of_areas(
    spark: SparkSession,
    areas: DataFrame,
    reaches: DataFrame,
    catchments: DataFrame,
    end_nodes: DataFrame,
    catchment_id: str,
    cell_size: float,
    root: str,
    table: str,
    exclusion_table: str,
) -> DataFrame:
    """``aoi_id, rec_network_id`` of every area; networks are built and stored for areas that no stored one contains.

    All new networks are built by one keyed graph. Nodes and edges go to ``root`` in a folder per run, named by its first
    network (a folder and a file per network would be all the work where areas are many), with ``rec_network_id`` as a
    column that the files are sorted by; excluded reaches go to their table. The metadata rows come last, so networks of a
    run that died are unknown, and the next run takes the same ids, replaces the run's folder and adds only exclusions not
    stored yet. Areas of one call do not share a network even where one contains another.
    """
    tables.create_if_absent(spark, table, tables.RIVER_NETWORK_SCHEMA)
    tables.create_if_absent(spark, exclusion_table, tables.NETWORK_EXCLUSION_SCHEMA)
    known = existing_network(areas, spark.table(table), cell_size)
    missing = cut_lineage(areas.select("aoi_id", *(F.col(s).cast("double").alias(s) for s in g.BOX)).join(known.filter("rec_network_id IS NULL"), "aoi_id", "left_semi"))
    if not missing.isEmpty():
        numbered = cut_lineage(tables.with_new_ids(missing, spark.table(table), "rec_network_id", ["aoi_id"]))
        ids = numbered.select("aoi_id", "rec_network_id")
        nodes, edges, excluded = build_networks(missing, reaches, catchments, end_nodes, catchment_id, cell_size)
        first = numbered.agg(F.min("rec_network_id")).first()[0]

        def folder(kind: str) -> str:
            return f"{root}/{kind}/first_network={first}"

        _write_run(nodes.join(ids, "aoi_id").drop("aoi_id"), folder("nodes"))
        _write_run(edges.join(ids, "aoi_id").drop("aoi_id"), folder("edges"))
        rows = excluded.join(ids, "aoi_id").join(reaches.select("objectid", g.to_wkt("geometry").alias("wkt")), "objectid")
        rows = rows.select("rec_network_id", "objectid", "exclusion_cause", "wkt")
        stored = spark.table(exclusion_table)
        tables.append(cut_lineage(tables.unseen(rows, stored, ["rec_network_id", "objectid"])), exclusion_table)
        metadata = numbered.select(
            "rec_network_id",
            F.lit(folder("nodes")).alias("network_path"),
            F.lit(folder("edges")).alias("network_data_path"),
            F.current_timestamp().alias("created_at"),
            *g.BOX,
        )
        tables.append(metadata, table)
    return existing_network(areas, spark.table(table), cell_size)
