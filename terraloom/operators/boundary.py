"""The rectangle's boundary: sides, crossings of lines, inflow points, tide query locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from ..errors import NoRiverDataError, NoTideDataError
from ..functions import crossing
from ..functions import facing as facing_sides
from ..functions import geometry as g
from ..session import cut_lineage
from .spatial_join import _dealt, _gridded, closest_within, intersecting_pairs, semi_join

# Side labels.
SIDES = ("bottom", "right", "top", "left")


def sides(areas: DataFrame) -> DataFrame:
    """The four sides of each area: ``aoi_id, position, x0, y0, x1, y1`` (left to right, bottom to top)."""
    ends = {
        "bottom": ("xmin", "ymin", "xmax", "ymin"),
        "right": ("xmax", "ymin", "xmax", "ymax"),
        "top": ("xmin", "ymax", "xmax", "ymax"),
        "left": ("xmin", "ymin", "xmin", "ymax"),
    }
    rows = F.array(
        *(
            F.struct(F.lit(name).alias("position"), *(F.col(c).cast("double").alias(a) for c, a in zip(cols, ("x0", "y0", "x1", "y1"), strict=True)))
            for name, cols in ends.items()
        )
    )
    return areas.select("aoi_id", F.explode(rows).alias("_s")).select("aoi_id", "_s.*")


def require_sides(boundary: DataFrame) -> DataFrame:
    """Fail when a boundary line has no known side label."""
    unknown = boundary.filter(F.col("position").isNull() | ~F.col("position").isin(*SIDES)).select("aoi_id").take(1)
    if unknown:
        raise ValueError(f"a boundary line of area {unknown[0]['aoi_id']} has no position")
    return boundary


def side_centroids(boundary: DataFrame) -> DataFrame:
    """Midpoint of every boundary segment."""
    return boundary.select(
        "aoi_id", "position", ((F.col("x0") + F.col("x1")) / 2.0).alias("x"), ((F.col("y0") + F.col("y1")) / 2.0).alias("y")
    )


def nearest_side(x: Column, y: Column) -> Column:
    """Label of the side of ``xmin..ymax`` closest to a point; ties in the order bottom, right, top, left."""
    gaps = {
        "bottom": F.abs(y - F.col("ymin")),
        "right": F.abs(F.col("xmax") - x),
        "top": F.abs(F.col("ymax") - y),
        "left": F.abs(x - F.col("xmin")),
    }
    least = F.least(*gaps.values())
    label = F.lit(None).cast("string")
    for name in reversed(SIDES):
        label = F.when(gaps[name] == least, F.lit(name)).otherwise(label)
    return label


def with_own_boxes(areas: DataFrame) -> DataFrame:
    """Each area with ``own_boxes``, the boxes known under its id, for pieces to carry."""
    boxes = areas.groupBy("aoi_id").agg(F.collect_list(F.struct(*g.BOX)).alias("own_boxes"))
    return areas.join(boxes, "aoi_id")


def uncovered_positions(areas: DataFrame, pieces: DataFrame) -> DataFrame:
    """Centroid of each uncovered piece ``(aoi_id, x0, y0, x1, y1)`` with the side it faces.

    Very many pieces may carry ``own_boxes`` (:func:`with_own_boxes`), so that they need not be dealt to their areas.
    """
    x, y = (F.col("x0") + F.col("x1")) / 2.0, (F.col("y0") + F.col("y1")) / 2.0
    if "own_boxes" in pieces.columns:
        placed = pieces.select("aoi_id", *("x0", "y0", "x1", "y1"), F.inline("own_boxes"))
    else:
        placed = pieces.join(areas.select("aoi_id", *g.BOX), "aoi_id")
    return placed.select("aoi_id", x.alias("x"), y.alias("y"), nearest_side(x, y).alias("position"))


# ---------------------------------------------------------------- line crossings


def crossings(
    lines: DataFrame, areas: DataFrame, cell_size: float, line_id: str = "objectid", geom: str = "geometry", numbered: bool = False
) -> DataFrame:
    """Points where lines cross area boundaries: ``aoi_id, line_id, x, y, distance`` along the line, and ``starts_inside``.

    Lines are measured once and go with their segments through the grid, to a cell's areas (:mod:`..functions.crossing`), so
    that the pairs, of which there may be very many more than lines, are made and solved a block at a time and never dealt
    anew; a line whose box lies strictly inside an area cannot cross its boundary.
    Only segments whose box meets the area's and does not lie strictly inside are solved, each side in closed form. A
    crossing at a shared vertex or corner is reported once. ``starts_inside``: the line's first node lies strictly
    inside the area. ``numbered`` adds ``crossing_no, crossing_count, last_distance`` along the line, if no id names two
    lines or two areas: then all crossings of an id pair are at hand where they are found.
    """
    box = [f"_line_{side}" for side in g.BOX]
    measured = F.struct(*(F.col(f"{geom}.{side}").alias(name) for side, name in zip(g.BOX, box, strict=True)))
    # The numbers of a segment one after the other, as they go to Python.
    numbers = F.flatten(
        F.transform(g.measured_segments(geom), lambda s: F.array(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"], s["length"], s["before"]))
    )
    shape = F.struct(numbers.alias("_segments"), g.first_point(geom).alias("_begin"))
    same_id = lines.filter(F.col(line_id).isNotNull()).groupBy(line_id).agg(F.collect_list(measured).alias("_b"), F.collect_list(shape).alias("_s"))
    # Written once, as the grid join reads the boxes twice. Lines of one id count with each other's boxes.
    known = cut_lineage(same_id.select(line_id, F.size("_b").alias("_n"), "_s", F.inline("_b")).select(line_id, "_n", *box, F.inline("_s")))
    alone = numbered and known.filter("_n > 1").isEmpty() and areas.groupBy("aoi_id").count().filter("count > 1").isEmpty()
    return _solved_pairs(known, areas, cell_size, line_id, box, alone)


def _solved_pairs(known: DataFrame, areas: DataFrame, cell_size: float, line_id: str, box: list[str], numbered: bool) -> DataFrame:
    """Lines and areas dealt by their cells, in each the areas first, and solved there."""
    lhs, rhs, on = _gridded(known, areas.select("aoi_id", *g.BOX), cell_size, box, g.BOX, ())
    types = {"aoi_id": areas.schema["aoi_id"].dataType, line_id: known.schema[line_id].dataType}

    def rows(df: DataFrame, prefix: str, is_line: bool) -> DataFrame:
        # Empty, not null: Arrow's writer goes over all nulls of a list column again with every row.
        segments = F.coalesce("_segments", F.array().cast("array<double>")) if is_line else F.array().cast("array<double>")
        own = {line_id: F.col(line_id)} if is_line else {"aoi_id": F.col("aoi_id")}
        own["_segments"] = segments
        own |= {f"_begin_{axis}": F.col(f"_begin.{axis}") for axis in "xy"} if is_line else {}
        others = types | {"_segments": "array<double>", "_begin_x": "double", "_begin_y": "double"}
        return df.select(
            *on,
            F.lit(is_line).alias("_line"),
            *(F.col(f"{prefix}{side}").alias(f"_{side}") for side in g.BOX),
            *(F.col(f"{prefix}first_{axis}").alias(f"_first_{axis}") for axis in "xy"),
            *(own.get(name, F.lit(None).cast(kind)).alias(name) for name, kind in others.items()),
        )

    celled = _dealt(rows(lhs, "_l", True).unionByName(rows(rhs, "_r", False)), on).sortWithinPartitions(*on, "_line")
    fields = [StructField(name, kind) for name, kind in types.items()]
    fields += StructType.fromDDL("x double, y double, distance double, starts_inside boolean").fields
    if numbered:
        fields += StructType.fromDDL("crossing_no int, crossing_count bigint, last_distance double").fields
    return celled.mapInArrow(crossing.solved(("aoi_id", line_id), numbered), StructType(fields))


def crossing_distances(points: DataFrame, line_id: str = "objectid") -> DataFrame:
    """``first_distance`` and ``last_distance`` of each line's crossings of each area."""
    if "last_distance" in points.columns:
        return points.filter("crossing_no = 1").select("aoi_id", line_id, F.col("distance").alias("first_distance"), "last_distance")
    return points.groupBy("aoi_id", line_id).agg(F.min("distance").alias("first_distance"), F.max("distance").alias("last_distance"))


def require_crossings(points: DataFrame) -> DataFrame:
    if points.isEmpty():
        raise NoRiverDataError("no river reach crosses the boundary of an area of interest")
    return points


def classify_crossings(points: DataFrame, line_id: str = "objectid") -> DataFrame:
    """Number crossings along each line and label them ``inflow`` or ``outflow``.

    Lines point downstream. If the first node lies strictly inside the area the first crossing leaves it,
    otherwise it enters; the rest alternate.
    """
    line = ["aoi_id", line_id]
    known = "last_distance" in points.columns
    ordered = points if known else points.withColumn("crossing_no", F.row_number().over(Window.partitionBy(*line).orderBy("distance", "x", "y"))).withColumn(
        "crossing_count", F.count("*").over(Window.partitionBy(*line))
    )
    enters = (F.col("crossing_no") % 2 == 1) != F.col("starts_inside")
    return ordered.select(
        *line, "x", "y", "distance", "crossing_no", "crossing_count", F.when(enters, "inflow").otherwise("outflow").alias("flow"),
        *(["last_distance"] if known else []),
    )


def first_inflow_index(classified: DataFrame, line_id: str = "objectid") -> DataFrame:
    """Zero-based position of the first inflow among each line's crossings."""
    entering = classified.filter("flow = 'inflow'")
    if "last_distance" in classified.columns:
        # Numbered where they were found: inflows alternate, so the first is the first or second crossing.
        return entering.filter("crossing_no <= 2").select("aoi_id", line_id, (F.col("crossing_no") - 1).cast("int").alias("first_inflow_index"))
    return entering.groupBy("aoi_id", line_id).agg(
        (F.min("crossing_no") - 1).cast("int").alias("first_inflow_index")
    )


def single_inflows(classified: DataFrame) -> DataFrame:
    return classified.filter("crossing_count = 1 AND flow = 'inflow'")


def multi_inflows(classified: DataFrame) -> DataFrame:
    return classified.filter("crossing_count > 1 AND flow = 'inflow'")


def inflows(classified: DataFrame) -> DataFrame:
    return classified.filter("flow = 'inflow'")


def entry_points(areas: DataFrame, lines: DataFrame, kept: DataFrame, cell_size: float) -> DataFrame:
    """Where each kept reach of an area first flows into it: ``aoi_id, objectid, ex, ey``.

    ``lines`` are drawn downstream and ``kept(aoi_id, objectid)`` are the reaches of each area's own network. Water that
    leaves an area and comes back along one reach enters once, so its flow is not counted twice.
    """
    # By shuffle: reaches of all areas are a small file, whose rows as a broadcast would fill the driver.
    own = crossings(lines, areas, cell_size).join(kept.select("aoi_id", "objectid").hint("merge"), ["aoi_id", "objectid"], "left_semi")
    entering = inflows(classify_crossings(own))
    first = entering.groupBy("aoi_id", "objectid").agg(F.min_by(F.struct("x", "y"), "crossing_no").alias("_p"))
    return first.select("aoi_id", "objectid", F.col("_p.x").alias("ex"), F.col("_p.y").alias("ey"))


def aligned_entries(entries: DataFrame, areas: DataFrame, waterways: DataFrame, distance: float, cell_size: float) -> DataFrame:
    """Entry points with the mapped waterway that crosses the same area's boundary nearest to them; those with none
    within ``distance`` go. Ties go to the smaller ``osm_id``."""
    mapped = crossings(waterways, areas, cell_size, "osm_id").select("aoi_id", "osm_id", F.col("x").alias("wx"), F.col("y").alias("wy"))
    # Written once, as the grid join reads its boxes twice.
    found = closest_within(
        cut_lineage(entries), cut_lineage(mapped), distance, ["aoi_id", "objectid"], "osm_id",
        left_box=("ex", "ey", "ex", "ey"), right_box=("wx", "wy", "wx", "wy"), keys=["aoi_id"],
    )
    return found.select("aoi_id", "objectid", "ex", "ey", "osm_id")


# ---------------------------------------------------------------- tide locations


SEGMENT_BOX = ("sx0", "sy0", "sx1", "sy1")


def _celled_coast(areas: DataFrame, coast: DataFrame, distance: float, cell_size: float, geom: str = "geometry") -> DataFrame:
    """Coast segments and areas whose box, grown by ``distance``, may meet theirs, sorted by cell, in each the areas first."""
    segs = coast.select(F.explode(g.segments(geom)).alias("s")).select(
        F.col("s.a").alias("sa"),
        F.col("s.b").alias("sb"),
        F.least("s.a.x", "s.b.x").alias("sx0"),
        F.least("s.a.y", "s.b.y").alias("sy0"),
        F.greatest("s.a.x", "s.b.x").alias("sx1"),
        F.greatest("s.a.y", "s.b.y").alias("sy1"),
    )
    wide = [f"_w_{s}" for s in g.BOX]
    grown = areas.select("aoi_id", *g.BOX, *(c.alias(w) for c, w in zip(g.grow([F.col(s) for s in g.BOX], distance), wide, strict=True)))
    lhs, rhs, on = _gridded(segs, grown, cell_size, SEGMENT_BOX, wide, ())

    def rows(df: DataFrame, prefix: str, is_line: bool) -> DataFrame:
        own = ("sa.x", "sa.y", "sb.x", "sb.y") if is_line else g.BOX
        kept = ((c, F.lit(None).cast(areas.schema[c].dataType) if is_line else F.col(c)) for c in ("aoi_id", *g.BOX))
        return df.select(
            *on,
            F.lit(is_line).alias("_line"),
            *(value.alias(c) for c, value in kept),
            *(F.col(c).cast("double").alias(n) for c, n in zip(own, facing_sides.OWN, strict=True)),
            *(F.col(f"{prefix}{side}").alias(f"_{side}") for side in g.BOX),
            *(F.col(f"{prefix}first_{axis}").alias(f"_first_{axis}") for axis in "xy"),
        )

    return _dealt(rows(lhs, "_l", True).unionByName(rows(rhs, "_r", False)), on).sortWithinPartitions(*on, "_line")


def coastline_near(areas: DataFrame, coast: DataFrame, distance: float, cell_size: float, geom: str = "geometry") -> DataFrame:
    """Coast segments within ``distance`` of an area: ``aoi_id``, segment ends and squared distance."""
    celled = _celled_coast(areas, coast, distance, cell_size, geom)
    kept = areas.select("aoi_id", *g.BOX).schema.fields
    schema = StructType([*kept, *StructType.fromDDL("ax double, ay double, bx double, by double, dist_sq double").fields])
    near = celled.mapInArrow(facing_sides.near(distance, ("aoi_id", *g.BOX)), schema)
    return near.select("aoi_id", g.point("ax", "ay").alias("sa"), g.point("bx", "by").alias("sb"), "dist_sq", *g.BOX)


def tide_query_locations(
    areas: DataFrame, coast: DataFrame, distance: float = 1000.0, cell_size: float | None = None, strict: bool = False
) -> DataFrame:
    """Midpoints of the sides that face the coast: ``aoi_id, position, x, y``.

    For every coast segment near an area, the side nearest to the segment's midpoint faces it. Areas without
    coast have no rows; with ``strict`` an overall empty result is an error.
    """
    # Of very many segments near a side one tells.
    celled = _celled_coast(areas, coast, distance, cell_size or max(distance * 4.0, 1.0))
    schema = StructType([StructField("aoi_id", areas.schema["aoi_id"].dataType), StructField("position", StringType())])
    facing = celled.mapInArrow(facing_sides.sides(distance, SIDES), schema).distinct()
    located = side_centroids(sides(areas)).join(facing, ["aoi_id", "position"], "left_semi")
    if strict and located.isEmpty():
        raise NoTideDataError("no coastline lies near the areas of interest")
    return located


def regions_of(areas: DataFrame, regions: DataFrame, region_id: str, cell_size: float, geom: str = "geometry") -> DataFrame:
    """Region polygons that meet any area."""
    boxed = regions.select("*", *(F.col(f"{geom}.{s}").alias(f"_b_{s}") for s in g.BOX))
    shaped = areas.select("aoi_id", *g.BOX, g.box_geometry(*g.BOX).alias("_area"))
    kept = semi_join(
        boxed,
        shaped,
        [region_id],
        cell_size,
        left_box=[f"_b_{s}" for s in g.BOX],
        left_columns=[geom],
        refine=g.intersects(geom, "_area"),
    )
    return kept.drop(*(f"_b_{s}" for s in g.BOX))
