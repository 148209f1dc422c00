"""Spatial joins as equi-joins on grid cells of many widths.

Every box has a level by its own size, at whose cells it covers two each way at most; boxes of different levels
meet one below the higher one, where the larger box covers five each way at most. So a country and a house make a few rows each, candidates are no farther apart than the
larger box is wide, and crowded places need no special care: boxes that share a small cell do lie close together.
Spark partitions the work by cell and never forms a cross product. A pair that shares several cells is reported
only in the cell holding the lower-left corner of the boxes' intersection (Dittrich and Seeger 2000), so no
``distinct`` is needed. Where a coarse cell holds very many small boxes, AQE's skew join splits them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..session import cut_lineage

#: A level's cells are so many times as wide as those of the level below; ``cell_size`` is the width at level 0.
LEVEL_FACTOR = 4.0
LOWEST_LEVEL, HIGHEST_LEVEL = -10, 14
MAX_HALVINGS = 14
POINTS_PER_CELL = 16

Box = Sequence[str]


def _box(df: DataFrame, prefix: str, box: Box) -> DataFrame:
    names = [f"{prefix}{side}" for side in g.BOX]
    return df.select("*", *(F.col(c).cast("double").alias(n) for c, n in zip(box, names, strict=True)))


def _width(level: Column, size: float) -> Column:
    return F.lit(size) * F.pow(F.lit(LEVEL_FACTOR), level)


def _own_level(prefix: str, size: float) -> Column:
    """The lowest level whose cells are as wide as the box, so that it covers two cells each way at most."""
    x0, y0, x1, y1 = (F.col(f"{prefix}{side}") for side in g.BOX)
    extent = F.greatest(x1 - x0, y1 - y0, F.lit(size * LEVEL_FACTOR**LOWEST_LEVEL))
    level = F.ceil(F.log(extent / size) / math.log(LEVEL_FACTOR)).cast("int")
    return F.least(F.greatest(level, F.lit(LOWEST_LEVEL)), F.lit(HIGHEST_LEVEL))


def _at_cells(df: DataFrame, targets: Column, prefix: str, size: float) -> DataFrame:
    """One row per target ``(_part, _level)`` and cell that the box covers there; ``{prefix}first_x`` and ``_y`` tell
    whether the cell is the leftmost and the lowest one of the box."""
    placed = df.withColumn("_t", F.explode(targets)).select("*", "_t._part", "_t._level").drop("_t", "_own", "_others")

    def index(side: str) -> Column:
        return F.floor(F.col(f"{prefix}{side}") / _width(F.col("_level"), size))

    firsts = placed.withColumn("_fx", index("xmin")).withColumn("_fy", index("ymin"))
    celled = firsts.withColumn("_cx", F.explode(F.sequence("_fx", index("xmax")))).withColumn("_cy", F.explode(F.sequence("_fy", index("ymax"))))
    return celled.withColumn(f"{prefix}first_x", F.col("_cx") == F.col("_fx")).withColumn(f"{prefix}first_y", F.col("_cy") == F.col("_fy")).drop("_fx", "_fy")


def _gridded(
    left: DataFrame, right: DataFrame, cell_size: float, left_box: Box, right_box: Box, keys: Sequence[str]
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with their cells, and the columns to join on.

    Part 0 joins boxes of one level. Boxes of different levels meet one level below the higher one, so that the larger
    box covers five cells each way at most and the smaller one two: part 1 has the larger boxes on the right, part 2 on
    the left. Boxes are placed only where the other side has boxes to meet, by its levels: a list of at most 25 numbers.
    """
    lhs = _box(left, "_l", left_box).withColumn("_own", _own_level("_l", cell_size))
    rhs = _box(right, "_r", right_box).withColumn("_own", _own_level("_r", cell_size))
    # Scalar subqueries of one short list each.
    left_levels, right_levels = (side.agg(F.collect_set("_own")).scalar() for side in (lhs, rhs))

    def targets(part: int, at: Column) -> Column:
        return F.transform(at, lambda level: F.struct(F.lit(part).alias("_part"), level.alias("_level")))

    own, none = F.col("_own"), F.array().cast("array<int>")
    same = F.when(F.array_contains("_others", own), F.array(own)).otherwise(none)
    raised = F.transform(F.filter("_others", lambda level: level > own), lambda level: level - 1)
    lowered = F.when(F.exists("_others", lambda level: level < own), F.array(own - 1)).otherwise(none)
    lhs, rhs = lhs.withColumn("_others", right_levels), rhs.withColumn("_others", left_levels)
    lhs = _at_cells(lhs, F.concat(targets(0, same), targets(1, raised), targets(2, lowered)), "_l", cell_size)
    rhs = _at_cells(rhs, F.concat(targets(0, same), targets(1, lowered), targets(2, raised)), "_r", cell_size)
    return lhs, rhs, [*keys, "_part", "_level", "_cx", "_cy"]


def _boxes_meet() -> Column:
    left = [F.col(f"_l{s}") for s in g.BOX]
    right = [F.col(f"_r{s}") for s in g.BOX]
    return g.boxes_intersect(left, right)


def intersecting_pairs(
    left: DataFrame,
    right: DataFrame,
    cell_size: float,
    left_box: Box = g.BOX,
    right_box: Box = g.BOX,
    keys: Sequence[str] = (),
    refine: Column | None = None,
) -> DataFrame:
    """Every pair whose closed boxes meet, once, with the columns of both sides.

    ``keys`` are equality columns common to both sides; other column names must be distinct.
    ``refine`` may use columns of both sides for an exact test.
    """
    lhs, rhs, on = _gridded(left, right, cell_size, left_box, right_box, keys)
    return _met_pairs(lhs, rhs, on, keys, refine, left_box, right_box)


def _dealt(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows dealt by their cells to as many tasks as the session asks for, and no fewer than four a core.

    A small file's boxes become few bytes of cells and very many pairs: by their bytes AQE would merge them into a task or
    two, which then makes all pairs alone. A number of partitions that is asked for stays as it is.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *on)


def _met_pairs(
    lhs: DataFrame, rhs: DataFrame, on: list[str], keys: Sequence[str], refine: Column | None, left_box: Box, right_box: Box
) -> DataFrame:
    """Pairs of the sides of :func:`_gridded`, each in the one cell that holds the lower-left corner of its intersection:
    there each axis begins for one of its boxes.

    Boxes are shuffled once, as the columns they come from, and made numbers again where they meet.
    """
    lhs, rhs = lhs.drop(*(f"_l{side}" for side in g.BOX)), rhs.drop(*(f"_r{side}" for side in g.BOX))
    owner = (F.col("_lfirst_x") | F.col("_rfirst_x")) & (F.col("_lfirst_y") | F.col("_rfirst_y"))
    # Always by shuffle: a small file's rows become many cells, and to broadcast them would leave few tasks for all pairs.
    pairs = _dealt(lhs, on).join(_dealt(rhs, on).hint("merge"), on)
    pairs = _box(_box(pairs, "_l", left_box), "_r", right_box).filter(_boxes_meet() & owner)
    if refine is not None:
        pairs = pairs.filter(refine)
    helpers = [f"{p}{s}" for p in ("_l", "_r") for s in (*g.BOX, "first_x", "first_y")]
    return pairs.drop(*helpers, *(c for c in on if c not in keys))


def matching_ids(
    left: DataFrame,
    right: DataFrame,
    left_id: Sequence[str],
    cell_size: float,
    left_box: Box = g.BOX,
    right_box: Box = g.BOX,
    keys: Sequence[str] = (),
    refine: Column | None = None,
) -> DataFrame:
    """Distinct ids of left rows with at least one partner; stops at the first partner per cell."""
    lhs, rhs, on = _gridded(left, right, cell_size, left_box, right_box, keys)
    condition = _boxes_meet() if refine is None else _boxes_meet() & refine
    for column in on:
        condition = condition & (F.col(column) == F.col(f"_other_{column}"))
    others = _dealt(rhs.withColumnsRenamed({column: f"_other_{column}" for column in on}), [f"_other_{column}" for column in on])
    # By shuffle, as in :func:`_met_pairs`.
    return _dealt(lhs, on).join(others.hint("merge"), condition, "left_semi").select(*left_id).distinct()


def semi_join(
    left: DataFrame, right: DataFrame, left_id: Sequence[str], cell_size: float, how: str = "left_semi", **options
) -> DataFrame:
    """Left rows with a partner (``left_semi``) or without one (``left_anti``).

    Ids and boxes of the left side, and the columns that ``refine`` needs, travel through the grid join; the full
    rows are joined back by id.
    """
    keys = options.get("keys", ())
    box = options.get("left_box", g.BOX)
    needed = options.pop("left_columns", [])
    slim = left.select(*dict.fromkeys([*left_id, *keys, *box, *needed]))
    return left.join(matching_ids(slim, right, left_id, cell_size, **options), list(left_id), how)


def flag_join(left: DataFrame, right: DataFrame, left_id: Sequence[str], cell_size: float, flag: str, **options) -> DataFrame:
    """Every left row, with ``flag`` true where it has a partner."""
    keys = options.get("keys", ())
    box = options.get("left_box", g.BOX)
    needed = options.pop("left_columns", [])
    slim = left.select(*dict.fromkeys([*left_id, *keys, *box, *needed]))
    hits = matching_ids(slim, right, left_id, cell_size, **options).withColumn(flag, F.lit(True))
    return left.join(hits, list(left_id), "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def within_distance(
    left: DataFrame,
    right: DataFrame,
    distance: float,
    left_box: Box = g.BOX,
    right_box: Box = g.BOX,
    keys: Sequence[str] = (),
    cell_size: float | None = None,
    **options,
) -> DataFrame:
    """Pairs whose boxes lie within ``distance``, with the squared distance as ``dist_sq``.

    For points and rectangles this is the exact distance join; for other shapes pass ``refine``.
    """
    side = [f"_grown_{s}" for s in g.BOX]
    grown = right.select("*", *(c.alias(n) for c, n in zip(g.grow([F.col(c) for c in right_box], distance), side, strict=True)))
    pairs = intersecting_pairs(
        left, grown, cell_size or max(distance * 2.0, 1.0), left_box=left_box, right_box=side, keys=keys, **options
    )
    dist_sq = g.box_distance_sq([F.col(c) for c in left_box], [F.col(c) for c in right_box])
    return pairs.withColumn("dist_sq", dist_sq).filter(F.col("dist_sq") <= distance * distance).drop(*side)


def closest_within(
    left: DataFrame, right: DataFrame, distance: float, left_id: Sequence[str], right_id: str, **options
) -> DataFrame:
    """The nearest partner within ``distance`` of each left row; ties go to the smaller id."""
    pairs = within_distance(left, right, distance, **options)
    payload = F.struct(*(F.col(c) for c in pairs.columns))
    best = pairs.groupBy(*left_id).agg(F.min_by(payload, F.struct("dist_sq", right_id)).alias("_best"))
    return best.select("_best.*")


def _around() -> Column:
    return F.explode(F.array(*(F.lit(i) for i in (-1, 0, 1))))


class Pyramid:
    """Grids of doubling cell size over a set of points, answering how far a probe must look.

    ``keys`` are equality columns (for example a raster id) that probe and point must share. Points at equal
    coordinates collapse to the smallest id.
    """

    def __init__(self, probes: DataFrame, points: DataFrame, point_id: str, keys: Sequence[str] = ()):
        """``probes`` and ``points`` have columns ``x, y`` (and ``keys``).

        The distinct points are written once; all statistics and candidates come from that table.
        """
        self.keys = list(keys)
        self.point_id = point_id
        self.points = cut_lineage(
            points.groupBy(*self.keys, F.col("x").cast("double").alias("_rx"), F.col("y").cast("double").alias("_ry")).agg(
                F.min(point_id).alias(point_id)
            )
        )
        self.size, self.levels = _pyramid_shape(probes, self.points.withColumnsRenamed({"_rx": "x", "_ry": "y"}), self.keys)

    def cell(self, value: Column, level: Column) -> Column:
        return F.floor(value / (F.lit(self.size) * F.pow(F.lit(2.0), level))).cast("long")

    def tall_points(self) -> DataFrame:
        """Every point once per level, with its cell there."""
        tall = self.points.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(self.levels + 2))))
        return tall.select(
            "*", self.cell(F.col("_rx"), F.col("_k")).alias("_cx"), self.cell(F.col("_ry"), F.col("_k")).alias("_cy")
        )

    def block_counts(self) -> DataFrame:
        """Number of points in the 3x3 block around each cell that has any, per level."""
        return (
            self.tall_points()
            .groupBy(*self.keys, "_k", "_cx", "_cy")
            .agg(F.count("*").alias("_n"))
            .withColumn("_dx", _around())
            .withColumn("_dy", _around())
            .groupBy(*self.keys, "_k", (F.col("_cx") + F.col("_dx")).alias("_cx"), (F.col("_cy") + F.col("_dy")).alias("_cy"))
            .agg(F.sum("_n").alias("_n"))
        )

    def with_level(self, probes: DataFrame, at_least: int) -> DataFrame:
        """Add ``_k``: the smallest level at which the 3x3 block around the probe holds ``at_least`` points.

        Probes in one finest cell share the search, so crowded cells cost one lookup. Probes whose widest
        block holds fewer points get the top level.
        """
        based = probes.withColumn("_bx", self.cell(F.col("x"), F.lit(0))).withColumn("_by", self.cell(F.col("y"), F.lit(0)))
        found = (
            based.select(*self.keys, "_bx", "_by")
            .distinct()
            .withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(self.levels))))
            .withColumn("_cx", F.floor(F.col("_bx") / F.pow(F.lit(2.0), F.col("_k"))).cast("long"))
            .withColumn("_cy", F.floor(F.col("_by") / F.pow(F.lit(2.0), F.col("_k"))).cast("long"))
            .join(self.block_counts().filter(F.col("_n") >= at_least), [*self.keys, "_k", "_cx", "_cy"], "left_semi")
            .groupBy(*self.keys, "_bx", "_by")
            .agg(F.min("_k").alias("_k"))
        )
        joined = based.join(found, [*self.keys, "_bx", "_by"], "left")
        return joined.withColumn("_k", F.coalesce("_k", F.lit(self.levels))).drop("_bx", "_by")

    def block_candidates(self, probes: DataFrame) -> DataFrame:
        """Every probe paired with the points in the 3x3 block around it at its own level ``_k``."""
        around = (
            probes.withColumn("_dx", _around())
            .withColumn("_dy", _around())
            .withColumn("_cx", self.cell(F.col("x"), F.col("_k")) + F.col("_dx"))
            .withColumn("_cy", self.cell(F.col("y"), F.col("_k")) + F.col("_dy"))
        )
        dx, dy = F.col("x") - F.col("_rx"), F.col("y") - F.col("_ry")
        return (
            # By shuffle: Spark takes the points for as few as before they are listed per level.
            around.join(self.tall_points().hint("merge"), [*self.keys, "_k", "_cx", "_cy"])
            .drop("_dx", "_dy", "_cx", "_cy")
            .withColumn("dist_sq", dx * dx + dy * dy)
        )


def nearest(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    left_xy: tuple[str, str] = ("x", "y"),
    right_xy: tuple[str, str] = ("x", "y"),
    keys: Sequence[str] = (),
) -> DataFrame:
    """Exact nearest right point of each left point: ``keys, left_id, right_id, dist_sq``; ties to the smaller id.

    At the smallest pyramid level whose 3x3 block around the left point holds a right point, the nearest one
    is no farther than the block's diagonal span, which one 3x3 block two levels up always covers; only those
    candidates are compared, and their minimum is taken before the shuffle.
    """
    probes = left.select(*keys, left_id, *(F.col(c).cast("double").alias(n) for c, n in zip(left_xy, "xy", strict=True)))
    points = right.select(*keys, right_id, *(F.col(c).cast("double").alias(n) for c, n in zip(right_xy, "xy", strict=True)))
    probes = cut_lineage(probes)
    pyramid = Pyramid(probes, points, right_id, keys)
    wide = pyramid.with_level(probes, 1).withColumn("_k", F.col("_k") + 2)
    best = F.min_by(F.struct(right_id, "dist_sq"), F.struct("dist_sq", right_id))
    return (
        pyramid.block_candidates(wide)
        .groupBy(*keys, left_id)
        .agg(best.alias("_best"))
        .select(*keys, left_id, f"_best.{right_id}", "_best.dist_sq")
    )


def _pyramid_shape(probes: DataFrame, points: DataFrame, keys: Sequence[str]) -> tuple[float, int]:
    """Finest cell size (about one point per cell and key) and the doublings needed to span everything.

    Two aggregate rows reach the driver.
    """

    def ends(df: DataFrame) -> DataFrame:
        groups = F.approx_count_distinct(F.struct(*keys)) if keys else F.lit(1)
        return df.agg(
            F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"),
            F.count("*").alias("n"), F.max(groups).alias("groups") if not keys else groups.alias("groups"),
        )

    rows = ends(points).withColumn("side", F.lit(0)).unionByName(ends(probes).withColumn("side", F.lit(1))).collect()
    own, asked = sorted(rows, key=lambda r: r["side"])
    if not own["n"] or not asked["n"]:
        return 1.0, 0
    span = max(max(own["x1"], asked["x1"]) - min(own["x0"], asked["x0"]), max(own["y1"], asked["y1"]) - min(own["y0"], asked["y0"]), 1e-9)
    spread = max(own["x1"] - own["x0"], own["y1"] - own["y0"], span * 1e-6)
    size = float(spread) / math.sqrt(max(1.0, own["n"] / max(1, own["groups"])))
    size /= 2.0 ** _extra_halvings(points, keys, size)
    return size, max(0, math.ceil(math.log2(float(span) / size)))


def _extra_halvings(points: DataFrame, keys: Sequence[str], size: float) -> int:
    """How often to halve the cells until even the densest holds few of the (distinct) points.

    Points are counted once in the finest cells and the counts rolled up, so clusters meet no single task;
    one row per level reaches the driver.
    """
    step = size / 2.0**MAX_HALVINGS
    fullest = (
        points.groupBy(*keys, F.floor(F.col("x") / step).alias("_cx"), F.floor(F.col("y") / step).alias("_cy"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(MAX_HALVINGS))))
        .withColumn("_wide", F.pow(F.lit(2.0), MAX_HALVINGS - F.col("_level")))
        .groupBy(*keys, "_level", F.floor(F.col("_cx") / F.col("_wide")).alias("_cx"), F.floor(F.col("_cy") / F.col("_wide")).alias("_cy"))
        .agg(F.sum("_n").alias("_n"))
        .groupBy("_level")
        .agg(F.max("_n").alias("_n"))
    )
    fitting = [r["_level"] for r in fullest.collect() if r["_n"] <= POINTS_PER_CELL]
    return min(fitting, default=MAX_HALVINGS)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
