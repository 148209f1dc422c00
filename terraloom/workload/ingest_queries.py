"""Connectors, files, table writes, the ingestion jobs and the request stream."""

from pyspark.sql import functions as F

from ..functions import geometry as g

from ..operators import boundary
from ..plans import ingest, scenario
from ..sources import features, tables, vector_files, waterways
from ..streaming import requests as stream
from . import fixtures  # noqa: F401
from .registry import query, scratch, scratch_database
from .network_queries import RIVER_INPUTS, river_inputs
from .series_queries import ALTERNATING, PEAK, STEP, STORM, inflows
from .shapes import COAST, FACING, coast, inverse_sql

TILE = 10_000


def box_json(x0, y0, x1, y1):
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    texts = [F.concat(F.lit("["), F.col(x).cast("string"), F.lit(","), F.col(y).cast("string"), F.lit("]")) for x, y in corners]
    return F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.concat_ws(",", *texts), F.lit("]]}"))


def feature_json(properties, shape):
    return F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*properties)), F.lit(',"geometry":'), shape, F.lit("}"))


def serve_pages(rows, fields, folder):
    """Lay out page documents of ``feature`` and box as the service would answer them, a tile of the ground per page."""
    tile = [F.floor(F.col(side) / TILE).cast("long") for side in ("xmin", "ymin")]
    features.store_pages(rows.withColumn("page", tile[0] * 1_000_000 + tile[1]), folder, fields)


ASSET_FIELDS = [{"name": "Asset_ID", "type": "esriFieldTypeOID"}, {"name": "Label", "type": "esriFieldTypeString"}]


def asset_pages(fx, folder):
    properties = (F.col("asset_id").alias("Asset_ID"), F.concat(F.lit("a"), F.col("asset_id").cast("string")).alias("Label"))
    rows = fx("fx_asset").select(*g.BOX, feature_json(properties, box_json("xmin", "ymin", "xmax", "ymax")).alias("feature"))
    serve_pages(rows, ASSET_FIELDS, folder)


@query(
    "src2_page_plan",
    """SELECT p_partkey, g.o AS result_offset FROM (SELECT p_partkey, 10 + p_partkey % 7 AS max_count, p_size * 11 AS total_count FROM part) p,
       LATERAL (SELECT unnest(generate_series(0, total_count - 1, max_count)) AS o) g""",
)
def src2(fx):
    layers = fx("part").select("p_partkey", (10 + F.col("p_partkey") % 7).alias("max_count"), (F.col("p_size") * 11).cast("bigint").alias("total_count"))
    return features.counted_pages(layers).select("p_partkey", "result_offset")


ASSET_ROWS = "SELECT asset_id, 'a' || asset_id AS label, xmin, ymin, xmax, ymax FROM fx_asset"


@query("src4_paged_features", ASSET_ROWS)
def src4(fx):
    folder = scratch(fx, "layer")
    asset_pages(fx, folder)
    found = features.fetch_features(fx.spark, path=folder, transport="files")
    return found.select("asset_id", "label", *(F.col(f"geometry.{s}").cast("long").alias(s) for s in g.BOX))


@query("src3_pushed_down_pages", f"{ASSET_ROWS} WHERE xmax >= 1520000 AND xmin <= 1540000 AND ymax >= 5110000 AND ymin <= 5150000")
def src3(fx):
    """A box condition on the layer: only pages that meet it are planned."""
    folder = scratch(fx, "layer")
    asset_pages(fx, folder)
    found = features.read_pages(fx.spark, path=folder, transport="files", box_columns="true")
    found = found.filter("xmax >= 1520000.0 AND xmin <= 1540000.0 AND ymax >= 5110000.0 AND ymin <= 5150000.0")
    return found.select(F.col("Asset_ID").alias("asset_id"), F.col("Label").alias("label"), *(F.col(s).cast("long").alias(s) for s in g.BOX))


@query("src5_provider_features", ASSET_ROWS)
def src5(fx):
    folder = scratch(fx, "wfs")
    asset_pages(fx, f"{folder}/LINZ/layer-101")
    found = features.fetch_features(fx.spark, path=folder, transport="files", protocol="wfs", provider="LINZ", layer_id="101")
    return found.select("asset_id", "label", *(F.col(f"geometry.{s}").cast("long").alias(s) for s in g.BOX))


@query("src16_reach_pages", "SELECT objectid, 'LINESTRING (' || ax || ' ' || ay || ', ' || bx || ' ' || b_y || ')' AS wkt FROM fx_line")
def src16(fx):
    """Reach records come from the backup when the primary layer is not there."""
    folder = scratch(fx, "reaches")
    xy = [F.concat(F.lit("["), F.col(x).cast("string"), F.lit(","), F.col(y).cast("string"), F.lit("]")) for x, y in (("ax", "ay"), ("bx", "b_y"))]
    shape = F.concat(F.lit('{"type":"LineString","coordinates":['), F.concat_ws(",", *xy), F.lit("]}"))
    sides = [f(x, y).alias(side) for side, f, x, y in zip(g.BOX, (F.least, F.least, F.greatest, F.greatest), ("ax", "ay") * 2, ("bx", "b_y") * 2, strict=True)]
    rows = fx("fx_line").select(*sides, feature_json((F.col("objectid").alias("OBJECTID"),), shape).alias("feature"))
    serve_pages(rows, [{"name": "OBJECTID", "type": "esriFieldTypeOID"}], folder)
    found = features.fetch_with_backup(fx.spark, {"path": f"{folder}/absent", "transport": "files"}, {"path": folder, "transport": "files"})
    return found.select("objectid", g.to_wkt("geometry").alias("wkt"))


def collections(fx):
    feature = feature_json((F.col("asset_id").alias("asset_id"),), box_json("xmin", "ymin", "xmax", "ymax"))
    head = F.lit('{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:EPSG::2193"}},"features":[')
    return fx("fx_asset").select("asset_id", F.concat(head, feature, F.lit("]}")).alias("value")).drop("asset_id")


@query("src6_geojson_features", "SELECT asset_id, 2193 AS srid, xmin, ymin, xmax, ymax FROM fx_asset")
def src6(fx):
    rows = vector_files.parse_collections(collections(fx), "asset_id bigint")
    return vector_files.require_epsg(rows).select("asset_id", "srid", *(F.col(f"geometry.{s}").cast("long").alias(s) for s in g.BOX))


ROUTES = """CASE p_size % 5 WHEN 0 THEN '.geojson' WHEN 1 THEN '.TIF' WHEN 2 THEN '.sld' WHEN 3 THEN '.txt' ELSE '.geodb' END AS suffix,
  CASE WHEN p_partkey % 3 = 0 THEN '3d/' ELSE '' END AS folder"""


@query(
    "src7_routed_files",
    f"""WITH t AS (SELECT p_partkey, p_name, {ROUTES} FROM part)
        SELECT '/geo/' || folder || p_name || p_partkey || suffix AS path, CASE suffix WHEN '.TIF' THEN 'raster' WHEN '.sld' THEN 'style' ELSE 'vector' END AS route,
               p_name || p_partkey AS table_name, CASE WHEN folder = '3d/' THEN 'extruded_layers' ELSE 'static_files' END AS workspace FROM t WHERE suffix <> '.txt'""",
)
def src7(fx):
    part = fx("part").select("p_partkey", "p_name", *(F.expr(e) for e in ROUTES.split(",\n  ")))
    path = F.concat(F.lit("/geo/"), "folder", "p_name", F.col("p_partkey").cast("string"), "suffix")
    return vector_files.routed(part.select(path.alias("path"))).select("path", "route", "table_name", "workspace")


@query(
    "v3_missing_epsg",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 2000 + c_nationkey WHEN 1 THEN 4326 WHEN 2 THEN 4326 END AS srid FROM customer""",
)
def v3(fx):
    code = (2000 + F.col("c_nationkey")).cast("string")
    name = (
        F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("urn:ogc:def:crs:EPSG::"), code))
        .when(F.col("c_custkey") % 4 == 1, "EPSG:4326")
        .when(F.col("c_custkey") % 4 == 2, "urn:ogc:def:crs:OGC:1.3:CRS84")
        .otherwise("urn:ogc:def:crs:OGC:1.3:CRS27")
    )
    from ..functions.text import parse_epsg

    return fx("customer").select("c_custkey", parse_epsg(name).alias("srid"))


@query(
    "src15_waterways_in_areas",
    """SELECT a.aoi_id, w.osm_id, w.waterway FROM fx_aoi a JOIN fx_waterway w ON w.waterway IN ('river', 'stream')
       AND w.x0 <= a.xmax AND w.x1 >= a.xmin AND w.y0 <= a.ymax AND w.y1 >= a.ymin""",
)
def src15(fx):
    shape = g.line_geometry(F.array(g.point("x0", "y0"), g.point("x1", "y1")))
    rows = fx("fx_waterway").select("osm_id", "waterway", shape.alias("geometry"))
    return waterways.waterways_in(fx("fx_aoi"), rows, 10_000.0).select("aoi_id", "osm_id", "waterway")


# ---------------------------------------------------------------- tables


@query("snk1_replaced_table", "SELECT asset_id, xmin FROM fx_asset")
def snk1(fx):
    table = f"{scratch_database(fx)}.layer"
    tables.replace(fx("fx_site"), table)
    tables.replace(fx("fx_asset"), table)
    return tables.read(fx.spark, table).select("asset_id", "xmin")


@query(
    "snk2_appended_unseen",
    "SELECT s_suppkey AS id, NULL AS note FROM supplier UNION ALL SELECT o_custkey, min(o_orderpriority) FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY o_custkey",
)
def snk2(fx):
    table = f"{scratch_database(fx)}.layer"
    tables.replace(fx("supplier").select(F.col("s_suppkey").alias("id")), table)
    rows = fx("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderpriority").alias("note"))
    for _ in range(2):
        tables.append(tables.unseen(rows, fx.spark.table(table), ["id"]), table)
    return tables.read(fx.spark, table).select("id", "note")


@query(
    "snk3_coverage_rows",
    """WITH l AS (SELECT string_agg(DISTINCT table_name, ',' ORDER BY table_name) AS source_table_list FROM fx_registry
                  WHERE unique_column_name IS NOT NULL AND (coverage_area <> 'New Zealand' OR coverage_area IS NULL))
       SELECT source_table_list, xmin::DOUBLE AS xmin, ymin::DOUBLE AS ymin, xmax::DOUBLE AS xmax, ymax::DOUBLE AS ymax FROM fx_aoi CROSS JOIN l""",
)
def snk3(fx):
    rows = ingest.coverage_rows(fx("fx_registry"), fx("fx_aoi"))
    return rows.select(F.array_join("source_table_list", ",").alias("source_table_list"), *g.BOX)


@query("snk5_created_tables", "SELECT DISTINCT lower(n_name) AS table_name, true AS present FROM nation UNION ALL SELECT 'absent', false")
def snk5(fx):
    database = scratch_database(fx)
    names = [r[0] for r in fx("nation").select(F.lower("n_name")).distinct().collect()]
    for name in names:
        for _ in range(2):
            tables.create_if_absent(fx.spark, f"{database}.{name}", tables.BUILDING_STATUS_SCHEMA, ["flood_model_id"])
    listed = fx("nation").select(F.lower("n_name").alias("table_name")).distinct()
    made = F.col("table_name").isin(*(n for n in names if tables.exists(fx.spark, f"{database}.{n}")))
    absent = fx("nation").agg(F.lit("absent").alias("table_name"), F.lit(tables.exists(fx.spark, f"{database}.absent")).alias("present"))
    return listed.withColumn("present", made).unionByName(absent)


def asset_store(fx):
    """A deployment whose registry holds one layer per area and one for the country."""
    database = scratch_database(fx)
    store = ingest.Store(fx.spark, f"{database}.geospatial_layers", f"{database}.user_log_information")
    store.prepare()
    entries = [(1, "assets", "asset_id", None), (2, "parcels", None, "New Zealand")]
    structs = [
        F.struct(
            F.lit(number).alias("layer_id"),
            F.lit(f"{database}.{name}").alias("table_name"),
            F.lit(key).cast("string").alias("unique_column_name"),
            F.lit(area).cast("string").alias("coverage_area"),
        )
        for number, name, key, area in entries
    ]
    layers = fx.spark.range(1).select(F.explode(F.array(*structs)).alias("l"))
    rows = layers.select(F.col("l.layer_id").cast("bigint").alias("unique_id"), F.lit("LINZ").alias("data_provider"), "l.*", F.lit("https://example.org").alias("url"))
    tables.append(rows, store.registry)

    folder = scratch(fx, "layers")
    asset_pages(fx, f"{folder}/LINZ/layer-1")
    paged = features.fetcher(fx.spark, path=folder, transport="files")

    def fetch(layer, pieces):
        if layer["layer_id"] == 2:
            x, y = F.col("gx") * 100, F.col("gy") * 100
            return fx("fx_parcel").select("parcel_id", g.geometry("POLYGON", F.array(F.array(g.box_ring(x, y, x + 100, y + 100)))).alias("geometry"))
        return paged(layer, pieces)

    return store, database, fetch


MET = "EXISTS (SELECT 1 FROM fx_aoi a WHERE s.xmin <= a.xmax AND s.xmax >= a.xmin AND s.ymin <= a.ymax AND s.ymax >= a.ymin)"


@query("c1_country_layers", "SELECT parcel_id FROM fx_parcel")
def c1(fx):
    store, database, fetch = asset_store(fx)
    ingest.load_country_layers(store, fetch)
    ingest.load_country_layers(store, fetch)
    return fx.spark.table(f"{database}.parcels").select("parcel_id")


@query("c2_area_layers", f"SELECT asset_id, xmin, ymin FROM fx_asset s WHERE {MET}")
def c2(fx):
    """Areas arrive in two overlapping batches; the second adds only features of uncovered ground, from pages that meet it."""
    store, database, fetch = asset_store(fx)
    half = F.col("xmax") - F.col("xmin") < 10_000
    for batch in (fx("fx_aoi").filter(half), fx("fx_aoi")):
        ingest.load_area_layers(store, batch, fetch)
        ingest.log_coverage(store, batch)
    stored = fx.spark.table(f"{database}.assets")
    return stored.select("asset_id", F.col("geometry.xmin").cast("long").alias("xmin"), F.col("geometry.ymin").cast("long").alias("ymin"))


@query(
    "c3_full_ingestion",
    f"""SELECT 'asset' AS kind, asset_id AS id FROM fx_asset s WHERE {MET} UNION ALL SELECT 'parcel', parcel_id FROM fx_parcel
        UNION ALL SELECT 'log', row_number() OVER (ORDER BY aoi_id, again) FROM fx_aoi CROSS JOIN (SELECT unnest([0, 1]) AS again) t""",
)
def c3(fx):
    """The same areas twice: no feature twice, the log keeps both requests under consecutive ids."""
    store, database, fetch = asset_store(fx)
    for _ in range(2):
        ingest.ingest(store, fx("fx_aoi"), fetch)
    read = fx.spark.table
    return (
        read(f"{database}.assets").select(F.lit("asset").alias("kind"), F.col("asset_id").alias("id"))
        .unionByName(read(f"{database}.parcels").select(F.lit("parcel").alias("kind"), F.col("parcel_id").alias("id")))
        .unionByName(read(store.coverage_log).select(F.lit("log").alias("kind"), F.col("unique_id").alias("id")))
    )


@query(
    "c4_scenario_forcing",
    f"""WITH {COAST}, facing AS (SELECT DISTINCT aoi_id, {FACING} AS position FROM near),
       buckets AS (SELECT position, epoch // 600 * 600 AS epoch, avg(level) AS level FROM fx_tide GROUP BY ALL),
       peak AS (SELECT position, arg_max(epoch, (level, -epoch)) AS p FROM buckets GROUP BY position),
       event AS (SELECT b.position FROM buckets b JOIN peak ON peak.position = b.position WHERE abs(epoch - p) <= 2880 * 30)
       SELECT 'rain' AS forcing, count(DISTINCT a.aoi_id) * 288 AS n FROM fx_aoi a JOIN fx_site s ON s.x BETWEEN a.xmin AND a.xmax AND s.y BETWEEN a.ymin AND a.ymax
       UNION ALL SELECT 'river', count(*) * 3 FROM fx_inflow
       UNION ALL SELECT 'water_level', count(*) FROM facing f JOIN event e ON e.position = f.position""",
)
def c4(fx):
    """Row counts of the three forcing sets of every area."""
    options = scenario.Options()
    rain = scenario.rain_forcing(fx("fx_aoi"), fx("fx_site"), fx("fx_rain"), options, 10_000.0)
    river = scenario.river_forcing(inflows(fx), options)
    sea = water_level(fx, options)
    counted = [df.agg(F.lit(name).alias("forcing"), F.count("*").alias("n")) for name, df in (("rain", rain), ("river", river), ("water_level", sea))]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def water_level(fx, options):
    levels = fx("fx_tide").withColumnRenamed("position", "series_id")
    return scenario.tide_forcing(fx("fx_aoi"), coast(fx), levels, lambda places: F.col("position"), fx("fx_slr"), options, 1000.0)


@query(
    "c4_written_forcing",
    f"""{RIVER_INPUTS}, {COAST}, facing AS (SELECT DISTINCT aoi_id, {FACING} AS position FROM near),
      places AS (SELECT f.*, (x0 + x1) / 2.0 AS x, (y0 + y1) / 2.0 AS y FROM facing f JOIN sides s ON s.aoi_id = f.aoi_id AND s.position = f.position),
      future AS (SELECT * FROM fx_slr WHERE confidence_level = 'medium' AND ssp_scenario = 'SSP2-4.5' AND NOT add_vlm AND percentile = 50 AND year = 2050),
      risen AS (SELECT aoi_id, position, arg_min(rise, ((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y), point_id)) AS rise FROM places p CROSS JOIN future s GROUP BY ALL),
      buckets AS (SELECT position, epoch // 600 * 600 AS epoch, avg(level) AS level FROM fx_tide GROUP BY ALL),
      peak AS (SELECT position, arg_max(epoch, (level, -epoch)) AS p FROM buckets GROUP BY position),
      event AS (SELECT b.position, epoch - p + {PEAK} * 60 AS seconds, level FROM buckets b JOIN peak ON peak.position = b.position WHERE abs(epoch - p) <= {STORM} * 30),
      {ALTERNATING}, storms AS (SELECT minutes * 60 AS seconds, depth * 60 / {STEP} / (10 + site_id % 17) AS intensity FROM blocks
        WHERE site_id = (SELECT min(site_id) FROM fx_rain))
      SELECT 'rain' AS forcing, aoi_id, NULL AS series, seconds::DOUBLE AS seconds, round(intensity, 6) AS value FROM storms
        CROSS JOIN (SELECT DISTINCT aoi_id FROM fx_aoi a JOIN fx_site s ON s.x BETWEEN a.xmin AND a.xmax AND s.y BETWEEN a.ymin AND a.ymax)
      UNION ALL SELECT 'water_level', aoi_id, r.position, seconds::DOUBLE, round(level + rise, 6) FROM risen r JOIN event e ON e.position = r.position
      UNION ALL SELECT 'river', aoi_id, objectid::VARCHAR, m * 60.0::DOUBLE, CASE WHEN m = {PEAK} THEN (f * 100)::DOUBLE ELSE 0 END
        FROM inputs i JOIN fx_inflow q USING (objectid) CROSS JOIN (SELECT unnest([{PEAK} - {STORM} // 2, {PEAK}, {PEAK} + {STORM} // 2]) AS m) t""",
)
def c4_written(fx):
    """All forcing sets of all areas, written and read back. Every site has the same rain, so its mean is known whatever the shares."""
    options = scenario.Options(storm_length=STORM, time_to_peak=PEAK, increment=STEP, maf=False, ari=100)
    depths = fx("fx_rain").withColumn("depth", F.col("depth") / (10 + F.col("site_id") % 17))
    rain = scenario.rain_forcing(fx("fx_aoi"), fx("fx_site"), depths, options, 10_000.0)
    river = scenario.area_river_forcing(river_inputs(fx), inflows(fx), options)
    root = scratch(fx, "forcing")
    scenario.write_forcing(rain, water_level(fx, options), river, root)

    def back(name, series):
        value = F.round(scenario.FORCING_SETS[name][1], 6).alias("value")
        return scenario.read_forcing(fx.spark, root, name).select(F.lit(name).alias("forcing"), "aoi_id", series.cast("string").alias("series"), "seconds", value)

    return back("rain", F.lit(None)).unionByName(back("water_level", F.col("position"))).unionByName(back("river", F.col("objectid")))


@query(
    "st1_request_stream",
    f"""WITH src AS (SELECT aoi_id, xmin AS x, ymin AS y FROM fx_aoi), {inverse_sql('x', 'y')}
        SELECT aoi_id AS request_id, count(*) OVER () AS logged FROM moved""",
)
def st1(fx):
    """Requests stream in as files, some twice; each is handled once and logged once."""
    store, database, fetch = asset_store(fx)
    from ..functions.projection import to_geographic

    lon0, lat0 = to_geographic(F.col("xmin"), F.col("ymin"))
    lon1, lat1 = to_geographic(F.col("xmax"), F.col("ymax"))
    located = fx("fx_aoi").select(F.col("aoi_id").alias("request_id"), lon0.alias("a"), lat0.alias("b"), lon1.alias("c"), lat1.alias("d"))
    corners = [("a", "b"), ("c", "b"), ("c", "d"), ("a", "d"), ("a", "b")]
    texts = [F.concat(F.col(x).cast("string"), F.lit(" "), F.col(y).cast("string")) for x, y in corners]
    asked = located.select("request_id", F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *texts), F.lit("))")).alias("wkt"))
    folder = scratch(fx, "requests")
    asked.coalesce(1).write.mode("append").json(folder)
    asked.coalesce(1).write.mode("append").json(folder)
    running = stream.start(
        stream.request_stream(fx.spark, folder, max_files=1), store, fetch, scratch(fx, "stream"), f"{database}.handled"
    )
    running.awaitTermination()
    logged = fx.spark.table(store.coverage_log).count()
    return fx.spark.table(f"{database}.handled").select("request_id", F.lit(logged).cast("bigint").alias("logged"))


