"""Crossings of long lines with area boundaries, against plain Python."""

import math
import random

from pyspark.sql import functions as F

from terraloom.functions import crossing
from terraloom.functions import geometry as g
from terraloom.operators import boundary

AREAS = [(1, 0.0, 0.0, 100.0, 60.0), (2, 20.0, 10.0, 40.0, 30.0), (3, -500.0, -500.0, 900.0, 900.0), (4, 50.0, 0.0, 60.0, 700.0)]


def expected(lines):
    out = {}
    for line, points in lines:
        for area, x0, y0, x1, y1 in AREAS:
            before = 0.0
            for (ax, ay), (bx, by) in zip(points, points[1:]):  # noqa: B905
                length = math.hypot(bx - ax, by - ay)
                hits = []
                if by != ay:
                    hits += [((y - ay) / (by - ay), None, y) for y in (y0, y1)]
                if bx != ax:
                    hits += [((x - ax) / (bx - ax), x, None) for x in (x0, x1)]
                for t, x, y in hits:
                    x, y = ax + t * (bx - ax) if x is None else x, ay + t * (by - ay) if y is None else y
                    if 0 <= t <= 1 and x0 <= x <= x1 and y0 <= y <= y1:
                        key = area, line, round(x, 6), round(y, 6)
                        out[key] = min(out.get(key, math.inf), before + t * length)
                before += length
    return {k: round(v, 5) for k, v in out.items()}


def line_frame(spark, lines):
    rows = spark.createDataFrame([(k, [list(p) for p in points]) for k, points in lines], "objectid long, points array<array<double>>")
    return rows.select("objectid", g.line_geometry(F.transform("points", lambda p: g.point(p[0], p[1]))).alias("geometry"))


def test_crossings(spark):
    rng = random.Random(2)
    lines = []
    for k in range(60):
        x, y, points = rng.uniform(-50, 150), rng.uniform(-50, 100), []
        for _ in range(rng.choice([2, 3, 9, 70, 600])):
            points.append((float(round(x)), float(round(y))) if k % 2 else (x, y))
            x, y = x + rng.uniform(-15, 15), y + rng.uniform(-15, 15)
        lines.append((k, points))
    lines += [(90, [(30.0, 20.0), (31.0, 20.5)]), (91, [(0.0, 0.0), (100.0, 0.0)]), (92, [(5.0, 5.0), (5.0, 5.0)]), (93, [(-10.0, 0.0), (0.0, 0.0), (-10.0, 10.0)])]
    areas = spark.createDataFrame(AREAS, "aoi_id long, xmin double, ymin double, xmax double, ymax double")
    found = boundary.crossings(line_frame(spark, lines), areas, 50.0).collect()
    assert {(r.aoi_id, r.objectid, round(r.x, 6), round(r.y, 6)): round(r.distance, 5) for r in found} == expected(lines)
    inside = {(r.aoi_id, r.objectid): r.starts_inside for r in found}
    starts, boxes = {k: p[0] for k, p in lines}, {a[0]: a[1:] for a in AREAS}
    for (area, line), value in inside.items():
        (x, y), (x0, y0, x1, y1) = starts[line], boxes[area]
        assert value == (x0 < x < x1 and y0 < y < y1)


def test_running_totals(spark):
    rng = random.Random(7)
    rows = [(n, [rng.uniform(0, 9) for _ in range(n)]) for n in (0, 1, 2, 7, 8, 9, 63, 64, 65, 511, 513, 5000)]
    frame = spark.createDataFrame(rows, "n long, v array<double>")
    for r in frame.select("v", g.running_totals(F.col("v")).alias("t")).collect():
        total, want = 0.0, []
        for v in r.v:
            total += v
            want.append(total)
        assert len(r.t) == len(want) and all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(r.t, want, strict=True))


def zigzags(spark, ids):
    """Lines in and out of the first two areas."""
    return line_frame(spark, [(k, [(-5.0, 5.0 + i), (50.0, 20.0 + i), (105.0, 30.0 + i), (70.0, 15.5 + i)]) for i, k in enumerate(ids)])


def test_numbered_where_found(spark):
    """Crossings are numbered as by windows over all of them, and no pair is dealt anew for it."""
    areas = spark.createDataFrame(AREAS, "aoi_id long, xmin double, ymin double, xmax double, ymax double")
    lines = zigzags(spark, range(9))
    plain, numbered = boundary.crossings(lines, areas, 50.0), boundary.crossings(lines, areas, 50.0, numbered=True)
    flows = boundary.classify_crossings(numbered)
    old = boundary.classify_crossings(plain)
    for mine, theirs in (
        (flows.drop("last_distance"), old),
        (boundary.first_inflow_index(flows), boundary.first_inflow_index(old)),
        (boundary.crossing_distances(numbered), boundary.crossing_distances(plain)),
    ):
        assert sorted(map(tuple, mine.select(*theirs.columns).collect())) == sorted(map(tuple, theirs.collect()))
    plan = boundary.first_inflow_index(flows)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(aoi_id" not in plan and "hashpartitioning(objectid" not in plan


def test_ids_that_repeat_are_numbered_together(spark):
    areas = spark.createDataFrame(AREAS, "aoi_id long, xmin double, ymin double, xmax double, ymax double")
    points = boundary.crossings(zigzags(spark, [1, 1, 2]), areas, 50.0, numbered=True)
    assert "last_distance" not in points.columns
    counts = {(r.aoi_id, r.objectid): r.crossing_count for r in boundary.classify_crossings(points).collect()}
    assert counts[2, 1] > counts[2, 2] > 0


def test_pieces_with_boxes_meet_no_areas_again(spark):
    areas = spark.createDataFrame([*AREAS, AREAS[0]], "aoi_id long, xmin double, ymin double, xmax double, ymax double")
    pieces = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 4.0), (2, 30.0, 10.0, 40.0, 30.0)], "aoi_id long, x0 double, y0 double, x1 double, y1 double")
    boxes = boundary.with_own_boxes(areas).select("aoi_id", "own_boxes").dropDuplicates(["aoi_id"])
    carried = boundary.uncovered_positions(areas, pieces.join(boxes, "aoi_id"))
    joined = boundary.uncovered_positions(areas, pieces)
    assert sorted(map(tuple, carried.collect())) == sorted(map(tuple, joined.collect())) == [(1, 5.0, 2.0, "bottom")] * 2 + [(2, 35.0, 20.0, "right")]


def test_pairs_are_solved_in_blocks(spark, monkeypatch):
    """Whatever the size of the blocks and batches, crossings are the same; no pair is a row of a join."""
    rng = random.Random(5)
    lines = [(k, [(rng.uniform(-50, 150), rng.uniform(-50, 100)) for _ in range(rng.choice([2, 3, 40]))]) for k in range(40)]
    frame = line_frame(spark, lines).unionByName(line_frame(spark, [(78, [(1.0, 1.0)])]))
    areas = spark.createDataFrame([*AREAS, (None, 20.0, 10.0, 40.0, 30.0)], "aoi_id long, xmin double, ymin double, xmax double, ymax double")
    points = boundary.crossings(frame, areas, 50.0, numbered=True)
    plan = points._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "SortMergeJoin" not in plan
    whole = sorted(map(str, points.collect()))
    assert {(r.aoi_id, r.objectid, round(r.x, 6), round(r.y, 6)) for r in points.filter("aoi_id IS NOT NULL").collect()} == set(expected(lines))
    assert points.filter("aoi_id IS NULL").count() == points.filter("aoi_id = 2").count() > 0
    monkeypatch.setattr(crossing, "PAIRS", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(str, boundary.crossings(frame, areas, 50.0, numbered=True).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_distance_that_is_not_known(spark):
    """Behind a vertex without a place distances are null, and come first."""
    frame = spark.sql("SELECT 1L AS objectid, array(array(-10.0D, 5.0D), array(10.0D, 5.0D), array(NULL, 5.0D), array(50.0D, 50.0D), array(50.0D, 90.0D)) AS p")
    frame = frame.select("objectid", g.line_geometry(F.transform("p", lambda p: g.point(p[0], p[1]))).alias("geometry"))
    areas = spark.createDataFrame(AREAS[:1], "aoi_id long, xmin double, ymin double, xmax double, ymax double")
    rows = boundary.crossings(frame, areas, 50.0, numbered=True).orderBy("crossing_no").collect()
    assert [(r.x, r.y, r.distance, r.crossing_no, r.crossing_count, r.last_distance) for r in rows] == [(50.0, 60.0, None, 1, 2, 10.0), (0.0, 5.0, 10.0, 2, 2, 10.0)]


def test_rounding_by_the_nearest_number(spark):
    from terraloom.workload.shapes import rounded

    rng = random.Random(3)
    values = [rng.uniform(-6e6, 6e6) for _ in range(2000)] + [k / 2 / 10**4 + d for k in range(-20, 20) for d in (0.0, 1e-12, -1e-12)]
    values += [float("nan"), float("inf"), -0.0, -0.00001, 1e300, 1.00005, 2.675, 5100000.00005, None]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for r in frame.select("v", rounded("v", 4).alias("a"), F.round("v", 4).alias("b")).collect():
        assert str(r.a) == str(r.b), r
