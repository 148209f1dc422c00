"""Rainfall, sea level, tide and river-flow series, and their files."""

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import overlay, rainfall, river_flow, tide
from ..operators import spatial_join as sj
from ..sources import forcing, rainfall_text, sea_level
from . import fixtures  # noqa: F401
from .registry import query, scratch
from .shapes import CLIPPED, areas, squares

STORM, PEAK, STEP = 1440, 1000, 10


# ---------------------------------------------------------------- duration tables


@query(
    "p6_duration_rows",
    "SELECT site_id, ari, rcp, time_period, depth FROM fx_rain_scenario WHERE duration_mins = 360",
)
def p6(fx):
    return rainfall.filter_duration(fx("fx_rain_scenario"), "6h").select("site_id", "ari", F.col("rcp").cast("double").alias("rcp"), "time_period", "depth")


@query(
    "p7_scenario_rows",
    """SELECT 'hist' AS scenario, site_id, duration_mins, depth FROM fx_rain_scenario WHERE rcp IS NULL AND time_period IS NULL AND ari = 50
       UNION ALL SELECT 'proj', site_id, duration_mins, depth FROM fx_rain_scenario WHERE rcp = 2.5 AND time_period = '2031-2050' AND ari = 50""",
)
def p7(fx):
    rain, sites = fx("fx_rain_scenario"), fx("fx_site")
    past = rainfall.scenario_for_sites(rain, sites, 50.0).withColumn("scenario", F.lit("hist"))
    future = rainfall.scenario_for_sites(rain, sites, 50.0, 2.5, "2031-2050").withColumn("scenario", F.lit("proj"))
    return past.unionByName(future).select("scenario", "site_id", "duration_mins", "depth")


def wide_rain(fx):
    by_mins = zip(rainfall.DURATIONS, (10, 20, 30, 60, 120, 360, 720, 1440, 2880, 4320, 5760, 7200), strict=True)
    return fx("fx_rain").groupBy("site_id").agg(*(F.max(F.when(F.col("mins") == m, F.col("depth"))).alias(d) for d, m in by_mins))


@query("w1_long_durations", "SELECT site_id, mins, depth FROM fx_rain")
def w1(fx):
    return rainfall.long_durations(wide_rain(fx))


BRACKETS = """rain0 AS (SELECT site_id, mins, depth FROM fx_rain UNION ALL SELECT DISTINCT site_id, 0, 0.0 FROM fx_rain),
brackets AS (SELECT site_id, mins AS x0, depth AS y0, lead(mins) OVER w AS x1, lead(depth) OVER w AS y1 FROM rain0
  WINDOW w AS (PARTITION BY site_id ORDER BY mins)),
grid AS (SELECT b.*, g.x FROM brackets b JOIN (SELECT unnest(generate_series(0, 7200, 10)) AS x) g
  ON g.x >= b.x0 AND (g.x < b.x1 OR (b.x1 IS NULL AND g.x = b.x0)))"""
VALUE = {
    "linear": "y0 + (y1 - y0) * (x - x0) / (x1 - x0)",
    "slinear": "y0 + (y1 - y0) * (x - x0) / (x1 - x0)",
    "previous": "y0",
    "zero": "y0",
    "next": "y1",
    "nearest": "CASE WHEN (x - x0) * 2 <= x1 - x0 THEN y0 ELSE y1 END",
    "nearest-up": "CASE WHEN (x - x0) * 2 < x1 - x0 THEN y0 ELSE y1 END",
}


def value_at(method):
    return f"CASE WHEN x1 IS NULL OR x = x0 THEN y0 ELSE {VALUE[method]} END"


def register_interpolation(method, alias):
    @query(f"w2_interpolated_{alias}", f"WITH {BRACKETS} SELECT site_id, x AS mins, round({value_at(method)}, 6) AS depth FROM grid")
    def w2(fx):
        return rainfall.interpolated(fx("fx_rain"), STEP, method).withColumn("depth", F.round("depth", 6))


for _method in VALUE:
    register_interpolation(_method, _method.replace("-", "_"))


# A spline reproduces polynomials of its own degree, whatever the breakpoints: depths per site that follow one.
# Exact values may end in a 5 behind the last digit kept; a shift keeps rounding away from it.
BESIDE_HALVES = 1.234567e-8
POLYNOMIAL = {"quadratic": "(10 + site_id % 17) * {x} * (2.0 - {x})", "cubic": "(10 + site_id % 17) * {x} * ({x} * {x} - 2.5 * {x} + 2.0)"}


def register_spline(method):
    depth = POLYNOMIAL[method]

    @query(
        f"w2_interpolated_{method}",
        f"""SELECT site_id, g.x AS mins, round({depth.format(x="(g.x / 7200.0)")} + {BESIDE_HALVES}, 6) AS depth
            FROM (SELECT DISTINCT site_id FROM fx_rain) s, (SELECT unnest(generate_series(0, 7200, 10)) AS x) g""",
    )
    def w2(fx):
        shaped = fx("fx_rain").withColumn("depth", F.expr(depth.format(x="(cast(mins as double) / 7200.0)")))
        return rainfall.interpolated(shaped, STEP, method).withColumn("depth", F.round(F.col("depth") + BESIDE_HALVES, 6))


for _method in POLYNOMIAL:
    register_spline(_method)


INCREMENTS = f"""{BRACKETS}, cumulative AS (SELECT site_id, x AS mins, {value_at('linear')} AS depth FROM grid),
steps AS (SELECT site_id, mins, depth - lag(depth) OVER (PARTITION BY site_id ORDER BY mins) AS depth FROM cumulative),
storm AS (SELECT * FROM steps WHERE mins > 0 AND mins <= {STORM})"""


@query("w3_increments", f"WITH {INCREMENTS} SELECT site_id, mins, round(depth, 6) AS depth FROM steps WHERE mins > 0")
def w3(fx):
    return rainfall.increments(rainfall.interpolated(fx("fx_rain"), STEP)).withColumn("depth", F.round("depth", 6))


def storm(fx):
    return rainfall.storm_increments(rainfall.increments(rainfall.interpolated(fx("fx_rain"), STEP)), STORM, STEP)


@query("w4_storm_increments", f"WITH {INCREMENTS} SELECT site_id, mins, round(depth, 6) AS depth FROM storm")
def w4(fx):
    return storm(fx).withColumn("depth", F.round("depth", 6))


ALTERNATING = f"""{INCREMENTS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY depth DESC, mins) AS rk FROM storm),
blocks AS (SELECT site_id, ({PEAK} + {STEP} * CASE WHEN rk % 2 = 0 THEN rk // 2 ELSE -(rk // 2) END)::DOUBLE AS minutes, depth FROM ranked)"""
MIRRORED = f"""{INCREMENTS}, blocks AS (SELECT site_id, {PEAK} + mins / 2 AS minutes, depth / 2 AS depth FROM storm
UNION ALL SELECT site_id, {PEAK} - (mins - {STEP}) / 2, depth / 2 FROM storm)"""


@query("w5_alternating_blocks", f"WITH {ALTERNATING} SELECT site_id, minutes, round(depth, 6) AS depth FROM blocks")
def w5(fx):
    return rainfall.transformed(storm(fx), STORM, PEAK, STEP, rainfall.ALT_BLOCK).select("site_id", "minutes", F.round("depth", 6).alias("depth"))


@query("w6_mirrored_blocks", f"WITH {MIRRORED} SELECT site_id, minutes, round(depth, 6) AS depth FROM blocks")
def w6(fx):
    return rainfall.transformed(storm(fx), STORM, PEAK, STEP, rainfall.CHICAGO).select("site_id", "minutes", F.round("depth", 6).alias("depth"))


@query(
    "w7_time_columns",
    f"WITH {MIRRORED} SELECT site_id, minutes, minutes * 60 AS seconds, round(minutes / 60, 6) AS hours FROM blocks",
)
def w7(fx):
    return rainfall.chicago(storm(fx), STORM, PEAK, STEP).select("site_id", "minutes", "seconds", F.round("hours", 6).alias("hours"))


@query("w8_intensity", f"WITH {MIRRORED} SELECT site_id, minutes, round(depth * 60 / {STEP / 2}, 6) AS intensity FROM blocks")
def w8(fx):
    blocks = rainfall.chicago(storm(fx), STORM, PEAK, STEP)
    return rainfall.intensity(blocks, STEP, rainfall.CHICAGO).select("site_id", "minutes", F.round("intensity", 6).alias("intensity"))


def hyetographs(fx):
    return rainfall.hyetograph(rainfall.long_durations(wide_rain(fx)), STORM, PEAK, STEP)


@query("w9_hyetographs", f"WITH {ALTERNATING} SELECT site_id, minutes * 60 AS seconds, round(depth * 60 / {STEP}, 6) AS intensity FROM blocks")
def w9(fx):
    return hyetographs(fx).select("site_id", "seconds", F.round("intensity", 6).alias("intensity"))


@query("w10_wide_and_long", f"WITH {ALTERNATING} SELECT site_id, minutes * 60 AS seconds, round(depth * 60 / {STEP}, 6) AS intensity FROM blocks")
def w10(fx):
    storms = hyetographs(fx).withColumn("intensity", F.round("intensity", 6))
    places = rainfall.wide_columns(fx("fx_site"))
    wide = rainfall.wide_from_long(storms, places, "intensity")
    return rainfall.long_from_wide(wide, places, "intensity").select("site_id", "seconds", "intensity")


MEAN = f"""{CLIPPED}, {ALTERNATING}, mean AS (SELECT aoi_id, minutes * 60 AS seconds, sum(depth * 60 / {STEP} * ((x1 - x0) * (y1 - y0) / whole)) AS intensity
  FROM blocks b JOIN c ON c.site_id = b.site_id GROUP BY aoi_id, minutes)"""


def mean_rain(fx):
    cover = overlay.site_coverage(overlay.clipped_sites(areas(fx), squares(fx), 10_000.0))
    return rainfall.mean_rainfall(hyetographs(fx), cover)


@query("a5_mean_rainfall", f"{MEAN} SELECT aoi_id, seconds, round(intensity, 6) AS intensity FROM mean")
def a5(fx):
    return mean_rain(fx).withColumn("intensity", F.round("intensity", 6))


@query("snk6_uniform_rain_files", f"{MEAN} SELECT aoi_id, seconds, round(intensity, 6) AS intensity FROM mean")
def snk6(fx):
    path = scratch(fx, "rain")
    forcing.write_uniform_rain(mean_rain(fx), path)
    return forcing.read_series(fx.spark, path, "aoi_id", "bigint", "intensity").withColumn("intensity", F.round("intensity", 6))


def cell_sites(fx):
    centres = fx("fx_cell").select("raster_id", F.struct("raster_id", "cx", "cy").alias("cell"), "x", "y").distinct()
    local = fx("fx_site").select("site_id", (1500000 + F.col("x") % 5000).alias("x"), (5100000 + F.col("y") % 4000).alias("y"))
    return sj.nearest(centres, local, "cell", "site_id").select("cell.*", "site_id")


CUBE = f"""WITH centres AS (SELECT DISTINCT raster_id, cx, cy, x, y FROM fx_cell), local AS (SELECT site_id, 1500000 + x % 5000 AS x, 5100000 + y % 4000 AS y FROM fx_site),
owner AS (SELECT c.raster_id, c.cx, c.cy, arg_min(s.site_id, ((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y), s.site_id)) AS site_id
  FROM centres c CROSS JOIN local s GROUP BY c.raster_id, c.cx, c.cy), {ALTERNATING},
cube AS (SELECT raster_id, cx, cy, minutes * 60 AS seconds, depth * 60 / {STEP} AS intensity FROM owner o JOIN blocks b ON b.site_id = o.site_id)"""
CUBE_SUM = "SELECT raster_id, seconds, count(*) AS cells, round(sum(intensity), 3) AS total, min(cx) AS first_cx, max(cy) AS last_cy FROM cube GROUP BY raster_id, seconds"


def cube_summary(cube):
    return cube.groupBy("raster_id", "seconds").agg(
        F.count("*").alias("cells"), F.round(F.sum("intensity"), 3).alias("total"), F.min("cx").alias("first_cx"), F.max("cy").alias("last_cy")
    )


@query("j12_rain_cube", f"{CUBE} {CUBE_SUM}")
def j12(fx):
    return cube_summary(rainfall.rain_cube(fx("fx_cell"), hyetographs(fx), cell_sites(fx)))


@query("snk7_rain_cube_files", f"{CUBE} {CUBE_SUM}")
def snk7(fx):
    path = scratch(fx, "cube")
    forcing.write_varying_rain(rainfall.rain_cube(fx("fx_cell"), hyetographs(fx), cell_sites(fx)), path)
    back = fx.spark.read.parquet(path).withColumn("seconds", F.col("seconds").cast("double"))
    return cube_summary(back)


# ---------------------------------------------------------------- rainfall text

HEADS = (
    ("Rainfall depths (mm) :: Historical Data", None, None, "hist", 0),
    ("Depth standard error (mm) :: Historical Data", None, None, "hist_stderr", 1),
    ("Rainfall depths (mm) :: RCP4.5 for the period 2031-2050", 4.5, "2031-2050", "proj", 2),
    ("Rainfall depths (mm) :: RCP8.5 for the period 2081-2100", 8.5, "2081-2100", "proj", 3),
)


def site_files(fx):
    """One text per site with a preamble and four blocks of two return periods."""
    names = "ARI,AEP," + ",".join(rainfall.DURATIONS)

    def row(ari, shift):
        cells = [((10 + F.col("s_suppkey") % 17) * k + ari + shift).cast("string") for k in range(1, 13)]
        return F.concat_ws(",", F.lit(str(ari)), F.lit("0.5"), *cells)

    blocks = [part for head, _, _, _, shift in HEADS for part in (F.lit(head), F.lit(names), row(2, shift), row(50, shift), F.lit(""))]
    content = F.concat_ws("\n", F.lit("Site details"), F.col("s_name"), F.lit(""), *blocks)
    return fx("supplier").select(F.col("s_suppkey").cast("string").alias("site_id"), content.alias("content"))


def head_rows():
    return ", ".join(
        f"({i + 1}, {3 + 5 * i + 1}, {'NULL' if rcp is None else rcp}::DOUBLE, {'NULL' if period is None else repr(period)}, '{kind}', {shift})"
        for i, (_, rcp, period, kind, shift) in enumerate(HEADS)
    )


HEAD_TABLE = f"(VALUES {head_rows()}) h(block_no, skip_rows, rcp, time_period, category, shift)"


@query(
    "src10_rainfall_blocks",
    f"SELECT CAST(s_suppkey AS VARCHAR) AS site_id, block_no, skip_rows, rcp, time_period, category FROM supplier CROSS JOIN {HEAD_TABLE}",
)
def src10(fx):
    return rainfall_text.block_structure(site_files(fx))


TEXT_ROWS = f"""SELECT CAST(s_suppkey AS VARCHAR) AS site_id, category, rcp, time_period, ari::DOUBLE AS ari,
  ((10 + s_suppkey % 17) + ari + shift)::DOUBLE AS first_depth, ((10 + s_suppkey % 17) * 12 + ari + shift)::DOUBLE AS last_depth
  FROM supplier CROSS JOIN {HEAD_TABLE} CROSS JOIN (SELECT unnest([2, 50]) AS ari) a"""


def text_rows(fx):
    return rainfall_text.tabular(site_files(fx)).select(
        "site_id", "category", "rcp", "time_period", "ari", F.col("10m").alias("first_depth"), F.col("120h").alias("last_depth")
    )


@query("src11_rainfall_rows", TEXT_ROWS)
def src11(fx):
    return text_rows(fx)


@query("src12_unseen_rain_sites", f"SELECT * FROM ({TEXT_ROWS}) t WHERE site_id NOT IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation)")
def src12(fx):
    stored = fx("nation").select(F.col("n_nationkey").cast("string").alias("site_id"))
    return rainfall_text.unseen_sites(text_rows(fx), stored)


@query("src9_site_points", "SELECT site_id, x AS xmin, y AS ymax, 'POINT (' || x || ' ' || y || ')' AS wkt FROM fx_site")
def src9(fx):
    points = rainfall_text.site_points(fx("fx_site"))
    return points.select(
        "site_id", F.col("geometry.xmin").cast("long").alias("xmin"), F.col("geometry.ymax").cast("long").alias("ymax"), g.to_wkt("geometry").alias("wkt")
    )


# ---------------------------------------------------------------- sea level and tide


@query(
    "a7_parameter_domain",
    """SELECT confidence_level, min(year) AS min_year, max(year) AS max_year, string_agg(DISTINCT ssp_scenario, ',' ORDER BY ssp_scenario) AS ssp_scenarios,
              string_agg(DISTINCT percentile, ',' ORDER BY percentile) AS percentiles FROM fx_slr GROUP BY confidence_level""",
)
def a7(fx):
    domain = tide.parameter_domain(fx("fx_slr"))
    return domain.select(
        "confidence_level", "min_year", "max_year",
        F.array_join("ssp_scenarios", ",").alias("ssp_scenarios"), F.array_join(F.col("percentiles").cast("array<string>"), ",").alias("percentiles"),
    )


@query(
    "v2_validated_scenarios",
    """WITH d AS (SELECT confidence_level, min(year) AS lo, max(year) AS hi, list(DISTINCT ssp_scenario) AS ssps, list(DISTINCT percentile) AS pcts
                  FROM fx_slr GROUP BY confidence_level),
       r AS (SELECT request_id, CASE WHEN lo IS NULL THEN 'unknown confidence level'
         WHEN NOT list_contains(ssps, ssp_scenario) THEN 'scenario not available for this confidence level'
         WHEN NOT list_contains(pcts, percentile) THEN 'percentile not available for this confidence level'
         WHEN year < lo OR year > hi THEN 'year out of range' END AS invalid_reason
         FROM fx_slr_request q LEFT JOIN d ON d.confidence_level = q.confidence_level)
       SELECT request_id, invalid_reason IS NULL AS is_valid, invalid_reason FROM r""",
)
def v2(fx):
    checked = tide.validated(fx("fx_slr_request"), tide.parameter_domain(fx("fx_slr")))
    return checked.select("request_id", "is_valid", "invalid_reason")


@query(
    "p8_sea_level_scenario",
    """SELECT point_id, year, rise FROM fx_slr WHERE confidence_level = 'medium' AND ssp_scenario = 'SSP2-4.5' AND add_vlm AND percentile = 50""",
)
def p8(fx):
    return tide.scenario(fx("fx_slr"), "medium", "SSP2-4.5", True, 50).select("point_id", "year", "rise")


@query(
    "src13_sea_level_points",
    "SELECT point_id, year, rise, add_vlm, 'POINT (' || x || ' ' || y || ')' AS wkt FROM fx_slr",
)
def src13(fx):
    """Projected points survive the round trip through geographic coordinates, to the metre."""
    from ..functions.projection import to_geographic

    lon, lat = to_geographic(F.col("x"), F.col("y"))
    rows = fx("fx_slr").select("point_id", "year", "rise", "add_vlm", lon.alias("lon"), lat.alias("lat"))
    placed = sea_level.with_points(rows)
    wkt = g.to_wkt(g.point_geometry(F.round("x"), F.round("y")))
    return placed.select("point_id", "year", "rise", "add_vlm", wkt.alias("wkt"))


@query("src14_measurement_parts", "SELECT point_id, year, ssp_scenario, confidence_level, add_vlm, percentile FROM fx_slr")
def src14(fx):
    name = F.concat(
        "ssp_scenario", F.when(F.col("add_vlm"), " + VLM").otherwise(""), F.lit(" ("), "confidence_level", F.lit(" confidence) p"), F.col("percentile").cast("string")
    )
    rows = fx("fx_slr").select("point_id", "year", name.alias("measurementname"))
    return sea_level.split_measurement(rows)


@query(
    "w12_yearly_sea_level",
    """WITH b AS (SELECT *, lead(year) OVER w AS y1, lead(rise) OVER w AS r1 FROM fx_slr
                  WINDOW w AS (PARTITION BY point_id, confidence_level, ssp_scenario, add_vlm, percentile ORDER BY year))
       SELECT point_id, confidence_level, ssp_scenario, add_vlm, percentile, g.y AS year, round(CASE WHEN y1 IS NULL OR g.y = year THEN rise::DOUBLE
         ELSE rise + (r1 - rise)::DOUBLE * (g.y - year) / (y1 - year) END, 6) AS rise
       FROM b JOIN (SELECT unnest(generate_series(2000, 2300)) AS y) g ON g.y >= year AND (g.y < y1 OR (y1 IS NULL AND g.y = year))""",
)
def w12(fx):
    keys = ["point_id", *tide.SCENARIO]
    return tide.by_year(fx("fx_slr"), keys).withColumn("rise", F.round("rise", 6))


@query(
    "j8_closest_sea_level",
    """WITH p AS (SELECT DISTINCT point_id, x, y FROM fx_slr),
       n AS (SELECT a.aoi_id, arg_min(point_id, ((a.xmin - x) * (a.xmin - x) + (a.ymin - y) * (a.ymin - y), point_id)) AS point_id FROM fx_aoi a CROSS JOIN p GROUP BY a.aoi_id)
       SELECT aoi_id AS location_id, n.point_id, year, confidence_level, ssp_scenario, add_vlm, percentile, rise FROM n JOIN fx_slr s ON s.point_id = n.point_id""",
)
def j8_sea_level(fx):
    places = fx("fx_aoi").select(F.col("aoi_id").alias("location_id"), F.col("xmin").alias("x"), F.col("ymin").alias("y"))
    found = tide.closest_sea_level(places, fx("fx_slr"))
    return found.select("location_id", "point_id", "year", "confidence_level", "ssp_scenario", "add_vlm", "percentile", "rise")


BUCKETS = "buckets AS (SELECT position, epoch // 1800 * 1800 AS epoch, avg(level) AS level FROM fx_tide GROUP BY ALL)"
SUMMED = f"{BUCKETS}, summed AS (SELECT b.position, epoch, level + rise AS level FROM buckets b JOIN fx_rise r ON r.position = b.position AND r.year = 2045)"


def summed(fx):
    return tide.add_sea_level(tide.bucketed(fx("fx_tide"), 30), fx("fx_rise"), 2045)


@query("j13_tide_plus_sea_level", f"WITH {SUMMED} SELECT position, epoch, round(level, 6) AS level FROM summed")
def j13(fx):
    return summed(fx).select("position", "epoch", F.round("level", 6).alias("level"))


EVENT = f"""WITH {SUMMED}, peak AS (SELECT position, arg_max(epoch, (level, -epoch)) AS p FROM summed GROUP BY position),
event AS (SELECT s.position, (epoch - p + 2000 * 60)::BIGINT AS seconds, level FROM summed s JOIN peak ON peak.position = s.position
  WHERE abs(epoch - p) <= 2880 * 30)"""


@query("w14_tide_event", f"{EVENT} SELECT position, seconds, round(level, 6) AS level FROM event")
def w14(fx):
    return tide.event_window(summed(fx), 2880, 2000, 30).select("position", "seconds", F.round("level", 6).alias("level"))


@query("snk9_water_level_files", f"{EVENT} SELECT position, seconds::DOUBLE AS seconds, round(level, 6) AS level FROM event")
def snk9(fx):
    path = scratch(fx, "level")
    forcing.write_water_level(tide.event_window(summed(fx), 2880, 2000, 30), path)
    return forcing.read_series(fx.spark, path, "position", "string", "level").withColumn("level", F.round("level", 6))


# ---------------------------------------------------------------- river flow


def inflows(fx):
    flow = F.col("f").cast("double")
    bounds = [(f"H_C18_{ari}_Y{suffix}", flow * ari + shift) for ari in river_flow.RETURN_PERIODS for suffix, shift in (("_lower", -1), ("", 0), ("_upper", 1))]
    return fx("fx_inflow").select("objectid", "x", "y", "note", flow.alias("H_C18_MAF"), *(value.alias(name) for name, value in bounds))


ALL_FLOWS = ", ".join(
    f"(f * {ari} + {shift})::DOUBLE AS flow_{ari}_y{suffix}" for ari in river_flow.RETURN_PERIODS for suffix, shift in (("_lower", -1), ("", 0), ("_upper", 1))
)


@query("p10_cleaned_inflows", f"SELECT objectid, x, y, f::DOUBLE AS flow_maf, {ALL_FLOWS} FROM fx_inflow")
def p10(fx):
    return river_flow.cleaned(inflows(fx))


@query("p9_return_periods", "SELECT DISTINCT ari FROM fx_inflow CROSS JOIN (SELECT unnest([5, 10, 20, 50, 100, 1000]) AS ari) a")
def p9(fx):
    return river_flow.valid_aris(river_flow.cleaned(inflows(fx)))


@query(
    "p11_flow_scenarios",
    "SELECT 'maf' AS scenario, objectid, f::DOUBLE AS flow FROM fx_inflow UNION ALL SELECT '50 upper', objectid, (f * 50 + 1)::DOUBLE FROM fx_inflow",
)
def p11(fx):
    flows = river_flow.cleaned(inflows(fx))
    annual = river_flow.scenario(flows).withColumn("scenario", F.lit("maf"))
    rare = river_flow.scenario(flows, maf=False, ari=50, bound=river_flow.UPPER).withColumn("scenario", F.lit("50 upper"))
    return annual.unionByName(rare).select("scenario", "objectid", "flow")


HYDROGRAPH = """hydro AS (SELECT objectid, x, y, m * 60.0::DOUBLE AS seconds, CASE WHEN m = 1600 THEN (f * 100)::DOUBLE ELSE 0 END AS flow
  FROM fx_inflow CROSS JOIN (SELECT unnest([160, 1600, 3040]) AS m) t)"""


def hydrographs(fx):
    return river_flow.hydrograph(river_flow.cleaned(inflows(fx)), 2880, 1600, maf=False, ari=100)


@query("w11_hydrographs", f"WITH {HYDROGRAPH} SELECT objectid, x, y, seconds, flow FROM hydro")
def w11(fx):
    return hydrographs(fx).select("objectid", "x", "y", "seconds", "flow")


@query("snk8_river_files", f"WITH {HYDROGRAPH} SELECT objectid, seconds, flow FROM hydro")
def snk8(fx):
    path = scratch(fx, "river")
    forcing.write_batch(hydrographs(fx), path, ["objectid"], "flow")
    return forcing.read_batch(fx.spark, path, "flow")


@query("snk8_river_manifest", f"WITH {HYDROGRAPH} SELECT objectid, count(*) AS steps, min(seconds) AS first_seconds, max(seconds) AS last_seconds FROM hydro GROUP BY objectid")
def snk8_manifest(fx):
    """The manifest of the written series; a series over several files has a row for each."""
    path = scratch(fx, "river")
    forcing.write_batch(hydrographs(fx), path, ["objectid"], "flow")
    rows = fx.spark.read.parquet(f"{path}/manifest").groupBy("objectid")
    return rows.agg(F.sum("steps").alias("steps"), F.min("first_seconds").alias("first_seconds"), F.max("last_seconds").alias("last_seconds"))
