import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.operators import rainfall, river_flow, series, tide


def breakpoints(spark, fn, xs=(0, 10, 30, 60, 120, 240)):
    return spark.createDataFrame([(1, x, float(fn(x))) for x in xs], "site_id int, mins bigint, depth double")


@pytest.mark.parametrize("method, degree", [("linear", 1), ("slinear", 1), ("quadratic", 2), ("cubic", 3)])
def test_splines_reproduce_polynomials(spark, method, degree):
    def poly(x):
        return sum(((-1) ** k) * (x / 50) ** k for k in range(degree + 1))

    got = series.resample(breakpoints(spark, poly), ["site_id"], "mins", "depth", 7, method).orderBy("mins").collect()
    assert [r["mins"] for r in got] == list(range(0, 241, 7))
    assert np.allclose([r["depth"] for r in got], [poly(r["mins"]) for r in got])


def test_splines_pass_through_breakpoints(spark):
    df = breakpoints(spark, lambda x: (x * 7919) % 13)
    for method in ("quadratic", "cubic"):
        got = {r["mins"]: r["depth"] for r in series.resample(df, ["site_id"], "mins", "depth", 10, method).collect()}
        for row in df.collect():
            assert got[row["mins"]] == pytest.approx(row["depth"])


def test_step_methods(spark):
    df = breakpoints(spark, lambda x: x, xs=(0, 10))

    def at_five(method):
        return {r["mins"]: r["depth"] for r in series.resample(df, ["site_id"], "mins", "depth", 5, method).collect()}[5]

    assert [at_five(m) for m in ("previous", "zero", "next", "nearest", "nearest-up")] == [0.0, 0.0, 10.0, 0.0, 10.0]


def test_resample_errors(spark):
    df = breakpoints(spark, lambda x: x)
    with pytest.raises(ValueError):
        series.resample(df, ["site_id"], "mins", "depth", 10, "spline")
    with pytest.raises(ValueError):
        series.resample(df, ["site_id"], "mins", "depth", 0)
    with pytest.raises(ValueError):
        rainfall.interpolated(df, 10_000)


@pytest.mark.parametrize("method", [rainfall.ALT_BLOCK, rainfall.CHICAGO])
def test_hyetographs_keep_the_storm_depth(spark, method):
    depths = breakpoints(spark, lambda x: x**0.5, xs=(10, 30, 60, 120, 240))
    steps = rainfall.storm_increments(rainfall.increments(rainfall.interpolated(depths, 10)), 120, 10)
    blocks = rainfall.transformed(steps, 120, 100, 10, method)
    assert blocks.agg(F.sum("depth")).first()[0] == pytest.approx(120**0.5)
    row = blocks.agg(F.min("minutes").alias("a"), F.max("minutes").alias("b"), F.count("*").alias("n"), F.countDistinct("minutes").alias("d")).first()
    assert row["n"] == row["d"] and row["a"] > 40 and row["b"] <= 160
    assert blocks.orderBy(F.desc("depth"), F.abs(F.col("minutes") - 100)).first()["minutes"] in (100.0, 105.0)


def test_storm_errors(spark):
    steps = breakpoints(spark, lambda x: x)
    with pytest.raises(ValueError):
        rainfall.storm_increments(steps, 5, 10)
    with pytest.raises(ValueError):
        rainfall.transformed(steps, 120, 50, 10, rainfall.ALT_BLOCK)
    with pytest.raises(ValueError):
        rainfall.transformed(steps, 120, 100, 10, "other")
    with pytest.raises(ValueError):
        rainfall.filter_duration(steps, "7h")
    with pytest.raises(ValueError):
        rainfall.filter_scenario(steps, 50.0, rcp=2.6)


def test_flow_errors(spark):
    flows = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 9.0)], "objectid int, x double, y double, flow_maf double, flow_50_y double")
    for options in ({"maf": True, "ari": 50}, {"maf": False}, {"maf": False, "ari": 7}, {"bound": "best"}):
        with pytest.raises(ValueError):
            river_flow.scenario(flows, **options)
    with pytest.raises(ValueError):
        river_flow.hydrograph(flows, 200, 90)
    peak = river_flow.hydrograph(flows, 200, 100, maf=False, ari=50).orderBy("seconds").collect()
    assert [(r["seconds"], r["flow"]) for r in peak] == [(0.0, 0.0), (6000.0, 9.0), (12000.0, 0.0)]


def test_tide_errors(spark):
    level = spark.createDataFrame([("left", 0, 1.0)], "position string, epoch bigint, level double")
    rise = spark.createDataFrame([("left", 2050, 0.5)], "position string, year int, rise double")
    with pytest.raises(ValueError):
        tide.add_sea_level(level, rise, 2051, strict=True)
    assert tide.add_sea_level(level, rise, 2050, strict=True).first()["level"] == 1.5
    with pytest.raises(ValueError):
        tide.event_window(level, 120, 50, 10)
    slr = spark.createDataFrame([("low", "SSP1-2.6", True, 50)], "confidence_level string, ssp_scenario string, add_vlm boolean, percentile int")
    with pytest.raises(ValueError):
        tide.scenario(slr, "medium", "SSP1-2.6", True, 50, strict=True)


def test_highest_tide_per_period(spark):
    rows = [("left", h * 3600, float((h * 7) % 11)) for h in range(72)]
    got = tide.highest_per_period(spark.createDataFrame(rows, "position string, epoch bigint, level double"), 1).orderBy("period").collect()
    assert len(got) == 3 and all(r["level"] == 10.0 for r in got)


def test_mean_rainfall_of_blocks(spark, monkeypatch):
    """Sums over the sites of an area, whatever the blocks: repeated and unknown rows count as in a join; no series is broadcast."""
    from terraloom.functions import weighted

    rain = [(s, 60.0 * t, float(s * t)) for s in range(12) for t in range(5)]
    rain += [(3, 0.0, 7.0), (4, 999.0, None), (5, 30.0, 2.0), (5, None, 8.0), (None, 0.0, 1.0), (6, 0.0, None)]
    shares = [(a, s, (a + s) / 10.0) for a in range(5) for s in range(14) if (a + s) % 3] + [(None, 2, 0.5), (2, 2, 0.25), (2, None, 1.0), (9, 77, 1.0), (1, 7, None), (8, 4, None)]
    storms = spark.createDataFrame(rain, "site_id long, seconds double, intensity double")
    cover = spark.createDataFrame(shares, "aoi_id long, site_id long, site_share double")
    want = {}
    for a, s, share in shares:
        for site, t, value in rain:
            if s is not None and s == site:
                total = want.setdefault((a, t), None)
                if share is not None and value is not None:
                    want[a, t] = (total or 0.0) + share * value
    for values in (weighted.VALUES, 12):
        monkeypatch.setattr(weighted, "VALUES", values)
        mean = rainfall.mean_rainfall(storms, cover)
        assert "Broadcast" not in mean._jdf.queryExecution().executedPlan().toString()
        found = {(r.aoi_id, r.seconds): r.intensity for r in mean.collect()}
        assert found.keys() == want.keys()
        assert all(found[k] == v if v is None else abs(found[k] - v) < 1e-9 for k, v in want.items())


def test_series_of_the_rain_cube_are_shuffled(spark):
    cells = spark.createDataFrame([(1, 0, 0), (1, 0, 1)], "raster_id int, cx long, cy long")
    storms = spark.createDataFrame([(s, 60.0 * t, float(s + t)) for s in range(3) for t in range(3)], "site_id long, seconds double, intensity double")
    sites = spark.createDataFrame([(1, 0, 0, 2), (1, 0, 1, 0)], "raster_id int, cx long, cy long, site_id long")
    cube = rainfall.rain_cube(cells, storms, sites)
    plan = cube._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [site_id" in plan
    assert cube.count() == 6
