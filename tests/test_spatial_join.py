"""Grid joins against brute force, with a third of all rows in one spot."""

import random

import pytest
from pyspark.sql import functions as F

from terraloom.operators import spatial_join as sj


def boxes(seed, n, size, clumped=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if clumped and i % 3 == 0:
            x, y = 500 + rng.random() * 2, 500 + rng.random() * 2
        else:
            x, y = rng.uniform(-200, 1000), rng.uniform(-200, 1000)
        w, h = rng.random() * size, rng.random() * size
        rows.append((i, x, y, x + w, y + h))
    return rows


def frame(spark, rows, name, prefix=""):
    return spark.createDataFrame(rows, ", ".join([f"{name} int", *(f"{prefix}{s} double" for s in ("xmin", "ymin", "xmax", "ymax"))]))


RIGHT_BOX = [f"r_{s}" for s in ("xmin", "ymin", "xmax", "ymax")]


def meets(a, b):
    return a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]


@pytest.mark.parametrize("cell", [0.5, 37.0, 400.0, 1e6])
def test_pairs_equal_brute_force(spark, cell):
    left, right = boxes(1, 200, 30), boxes(2, 150, 60)
    want = sorted((a[0], b[0]) for a in left for b in right if meets(a, b))
    got = sj.intersecting_pairs(frame(spark, left, "lid"), frame(spark, right, "rid", "r_"), cell, right_box=RIGHT_BOX)
    assert sorted((r["lid"], r["rid"]) for r in got.select("lid", "rid").collect()) == want


def test_crowded_cells_and_one_huge_box(spark):
    """20,000 places of several houses each and a country: a few rows per box, few candidates beyond the pairs."""
    houses = spark.range(80_000).select(
        F.col("id").alias("lid"), (F.col("id") % 200 * 100 + F.floor(F.col("id") / 20_000) * 3).cast("double").alias("xmin"), (F.floor(F.col("id") / 200) % 100 * 100.0).alias("ymin")
    ).select("*", (F.col("xmin") + 8).alias("xmax"), (F.col("ymin") + 8).alias("ymax"))
    country = spark.createDataFrame([(-1, -1e6, -1e6, 3e6, 2e6)], "lid long, xmin double, ymin double, xmax double, ymax double")
    left = houses.union(country)
    right = left.withColumnsRenamed({"lid": "rid", **{s: f"r_{s}" for s in ("xmin", "ymin", "xmax", "ymax")}})
    lhs, rhs, on = sj._gridded(left, right, 10_000.0, ("xmin", "ymin", "xmax", "ymax"), RIGHT_BOX, [])
    assert lhs.count() < 5 * left.count() and rhs.count() < 5 * left.count()
    candidates = lhs.join(rhs, on).count()
    pairs = sj.intersecting_pairs(left, right, 10_000.0, right_box=RIGHT_BOX)
    found = pairs.count()
    # each house meets the other three of its place and itself (8 m wide, 3 m apart: all but the farthest), the country all
    assert found == sum(1 for a in range(4) for b in range(4) if abs(a - b) * 3 <= 8) * 20_000 + 2 * 80_000 + 1
    assert candidates < 8 * found
    assert pairs.select("lid", "rid").distinct().count() == found


def test_semi_anti_and_flag(spark):
    left, right = boxes(3, 200, 20), boxes(4, 20, 40, clumped=False)
    hit = {a[0] for a in left if any(meets(a, b) for b in right)}
    l, r = frame(spark, left, "lid"), frame(spark, right, "rid", "r_")
    semi = sj.semi_join(l, r, ["lid"], 50.0, right_box=RIGHT_BOX)
    anti = sj.semi_join(l, r, ["lid"], 50.0, how="left_anti", right_box=RIGHT_BOX)
    flag = sj.flag_join(l, r, ["lid"], 50.0, "hit", right_box=RIGHT_BOX)
    assert {x["lid"] for x in semi.collect()} == hit and semi.count() == len(hit)
    assert {x["lid"] for x in anti.collect()} == {a[0] for a in left} - hit
    assert {x["lid"]: x["hit"] for x in flag.collect()} == {a[0]: a[0] in hit for a in left}


def test_equality_keys_restrict_pairs(spark):
    left, right = boxes(5, 60, 100), boxes(6, 60, 100)
    l = frame(spark, left, "lid").withColumn("k", F.col("lid") % 3)
    r = frame(spark, right, "rid", "r_").withColumn("k", F.col("rid") % 3)
    want = sorted((a[0], b[0]) for a in left for b in right if meets(a, b) and a[0] % 3 == b[0] % 3)
    got = sj.intersecting_pairs(l, r, 80.0, right_box=RIGHT_BOX, keys=["k"])
    assert sorted((x["lid"], x["rid"]) for x in got.collect()) == want


def test_within_distance_equals_brute_force(spark):
    left, right = boxes(7, 120, 0), boxes(8, 120, 0)
    want = sorted((a[0], b[0]) for a in left for b in right if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 40.0**2)
    got = sj.within_distance(frame(spark, left, "lid"), frame(spark, right, "rid", "r_"), 40.0, right_box=RIGHT_BOX)
    assert sorted((x["lid"], x["rid"]) for x in got.collect()) == want


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_nearest_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    points = [(i, 500 + rng.random() if i % 3 == 0 else rng.uniform(0, 1000), 500 + rng.random() if i % 3 == 0 else rng.uniform(0, 1000)) for i in range(150)]
    points += [(1000 + i, *points[i][1:]) for i in range(10)]  # copies: the smaller id wins
    probes = [(i, rng.uniform(-3000, 4000), rng.uniform(-3000, 4000)) for i in range(80)]
    got = sj.nearest(
        spark.createDataFrame(probes, "pid int, x double, y double"), spark.createDataFrame(points, "sid int, x double, y double"), "pid", "sid"
    )
    want = {p[0]: min(((p[1] - s[1]) ** 2 + (p[2] - s[2]) ** 2, s[0]) for s in points)[1] for p in probes}
    assert {r["pid"]: r["sid"] for r in got.collect()} == want


def test_nearest_of_one_point_and_of_none(spark):
    probes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e6, 5.0)], "pid int, x double, y double")
    one = spark.createDataFrame([(7, 3.0, 4.0)], "sid int, x double, y double")
    assert {r["pid"]: r["sid"] for r in sj.nearest(probes, one, "pid", "sid").collect()} == {1: 7, 2: 7}
    assert sj.nearest(probes, one.filter("sid < 0"), "pid", "sid").count() == 0


def test_no_cross_product_in_the_plan(spark):
    left, right = frame(spark, boxes(1, 50, 5), "lid"), frame(spark, boxes(2, 50, 5), "rid", "r_")
    pairs = sj.intersecting_pairs(left, right, 50.0, right_box=RIGHT_BOX)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_box_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "boxes")
    frame(spark, boxes(1, 50, 5), "lid").write.parquet(path)
    plan = spark.read.parquet(path).filter("xmin <= 10 AND xmax >= 0").select("lid")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(xmin,10.0)" in plan
    assert "ReadSchema: struct<lid:int,xmin:double,xmax:double>" in plan
