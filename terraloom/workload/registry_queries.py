"""Layer registry, incremental ingestion, cache, catalogue and text functions."""

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text
from ..operators import cache, catalog
from ..operators import spatial_join as sj
from ..sources import instructions as ins
from ..sources import tables
from . import fixtures  # noqa: F401
from .registry import query, scratch_database

FIELDS = ", ".join(ins.FIELDS)
BASE_URL = "https://maps.example.org"


def instruction_documents(fx):
    """One JSON document per customer with two sections, as an instruction file would hold them."""
    body = F.to_json(F.struct("data_provider", "layer_id", "table_name", "unique_column_name", "coverage_area", F.concat(F.lit("  "), "url", F.lit(" \n")).alias("url")))
    section = F.concat(F.lit('"s'), F.col("pos").cast("string"), F.lit('":'), body)
    by_part = [F.max(F.when(F.col("part") == i, section)) for i in (0, 1)]
    return fx("fx_instruction").groupBy("doc").agg(
        F.concat(F.lit("{"), by_part[0], F.lit(","), by_part[1], F.lit("}")).alias("value")
    )


FIRSTS = f"""firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {FIELDS} ORDER BY pos) AS rn
             FROM fx_instruction) WHERE rn = 1)"""


@query("src1_instruction_registry", f"WITH {FIRSTS} SELECT 's' || pos AS section, {FIELDS} FROM firsts")
def src1(fx):
    return ins.parse_instructions(instruction_documents(fx), order_column="doc")


@query(
    "v1_instruction_violations",
    """WITH t AS (SELECT 's' || pos AS section, coalesce(trim(unique_column_name), '') <> '' AS u,
                         coalesce(trim(coverage_area), '') <> '' AS a FROM fx_instruction)
       SELECT section, CASE WHEN u THEN 'both coverage_area and unique_column_name are set'
                            ELSE 'neither coverage_area nor unique_column_name is set' END AS problem
       FROM t WHERE u = a""",
)
def v1(fx):
    rows = fx("fx_instruction").withColumn("section", F.concat(F.lit("s"), F.col("pos").cast("string")))
    return ins.violations(rows).select("section", "problem")


@query("v1_never_loaded_layers", "SELECT unique_id FROM fx_registry WHERE coverage_area <> 'New Zealand' AND unique_column_name IS NULL")
def v1_never(fx):
    return ins.never_loaded(fx("fx_registry")).select("unique_id")


NEW = f"""{FIRSTS}, fresh AS (SELECT {FIELDS} FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM fx_registry r
          WHERE r.data_provider IS NOT DISTINCT FROM f.data_provider AND r.layer_id = f.layer_id))"""


@query("j1_new_registry_records", f"WITH {NEW} SELECT {FIELDS} FROM fresh")
def j1(fx):
    rows = ins.parse_instructions(instruction_documents(fx), order_column="doc")
    return ins.new_records(rows, ins.registry_keys(fx("fx_registry")))


@query(
    "j2_registry_upsert",
    f"""WITH {NEW}, merged AS (SELECT {FIELDS} FROM fx_registry UNION ALL SELECT * FROM fresh)
        SELECT *, (SELECT max(unique_id) FROM fx_registry)::BIGINT + (SELECT count(*) FROM fresh) AS highest_id FROM merged""",
)
def j2(fx):
    rows = ins.parse_instructions(instruction_documents(fx), order_column="doc")
    merged = ins.upserted(fx("fx_registry"), rows)
    highest = merged.agg(F.max("unique_id")).first()[0]
    return merged.select(*ins.FIELDS, F.lit(highest).alias("highest_id"))


@query("p1_country_layers", f"SELECT {FIELDS} FROM fx_registry WHERE coverage_area = 'New Zealand' AND unique_column_name IS NULL")
def p1(fx):
    return ins.country_layers(fx("fx_registry")).select(*ins.FIELDS)


@query(
    "p2_area_layers",
    f"""SELECT {FIELDS} FROM fx_registry WHERE unique_column_name IS NOT NULL
        AND (coverage_area <> 'New Zealand' OR coverage_area IS NULL)""",
)
def p2(fx):
    return ins.area_layers(fx("fx_registry")).select(*ins.FIELDS)


@query("p3_layer_info", "SELECT data_provider, layer_id, table_name, unique_column_name FROM fx_registry")
def p3(fx):
    return ins.layer_info(fx("fx_registry"))


@query("p5_registry_keys", "SELECT data_provider, layer_id FROM fx_registry")
def p5(fx):
    return ins.registry_keys(fx("fx_registry"))


@query("p4_normalised_columns", "SELECT p_partkey AS p_partkey, p_name AS p_name, 'p' || p_size AS geometry FROM part")
def p4(fx):
    part = fx("part").select(F.concat(F.lit("p"), F.col("p_size").cast("string")).alias("Geometry"), F.col("p_partkey").alias("P_PartKey"), F.col("p_name").alias("P_NAME"))
    return tables.normalise_columns(part)


FETCHED = """fetched AS (SELECT a.aoi_id, s.asset_id FROM fx_aoi a JOIN fx_asset s ON s.xmin <= a.xmax
             AND s.xmax >= a.xmin AND s.ymin <= a.ymax AND s.ymax >= a.ymin),
  stored AS (SELECT a.aoi_id, c.id AS asset_id FROM fx_aoi a JOIN (SELECT c_custkey AS id,
             1500000 + (c_custkey * 31337) % 100000 AS x, 5100000 + (c_custkey * 15485863) % 100000 AS y FROM customer) c
             ON c.x BETWEEN a.xmin AND a.xmax AND c.y BETWEEN a.ymin AND a.ymax)"""


def stored_points(fx):
    key = F.col("c_custkey")
    return fx("customer").select(
        key.alias("asset_id"),
        (1500000 + (key * 31337) % 100000).alias("px"),
        (5100000 + (key * 15485863) % 100000).alias("py"),
    )


def areas_of(fx):
    return fx("fx_aoi").select("aoi_id", *(F.col(s).alias(f"a_{s}") for s in g.BOX))


AREA_BOX = [f"a_{s}" for s in g.BOX]


@query("j3_unseen_features", f"WITH {FETCHED} SELECT aoi_id, asset_id FROM fetched EXCEPT SELECT aoi_id, asset_id FROM stored")
def j3(fx):
    """Fetched features of each area whose id is not stored inside that area yet."""
    fetched = sj.intersecting_pairs(fx("fx_asset"), areas_of(fx), 10_000.0, right_box=AREA_BOX).select("aoi_id", "asset_id")
    stored = sj.intersecting_pairs(stored_points(fx), areas_of(fx), 10_000.0, left_box=("px", "py", "px", "py"), right_box=AREA_BOX)
    return tables.unseen(fetched.distinct(), stored.select("aoi_id", "asset_id"), ["aoi_id", "asset_id"])


@query("a1_distinct_ids_in_area", f"WITH {FETCHED} SELECT DISTINCT asset_id FROM fetched")
def a1(fx):
    return sj.matching_ids(fx("fx_asset"), areas_of(fx), ["asset_id"], 10_000.0, right_box=AREA_BOX)


@query(
    "a2_first_of_duplicates",
    """SELECT min(doc * 2 + part) AS pos, data_provider, layer_id, table_name, url FROM fx_instruction
       GROUP BY data_provider, layer_id, table_name, url""",
)
def a2(fx):
    rows = fx("fx_instruction").select("pos", "data_provider", "layer_id", "table_name", "url")
    return tables.first_per_key(rows, ["data_provider", "layer_id", "table_name", "url"], ["pos"])


@query(
    "t2_first_match",
    """SELECT c_nationkey AS nation, arg_min(c_custkey, (c_acctbal, c_custkey)) AS first_customer FROM customer GROUP BY c_nationkey""",
)
def t2(fx):
    rows = fx("customer").select(F.col("c_nationkey").alias("nation"), "c_acctbal", F.col("c_custkey").alias("first_customer"))
    return tables.first_per_key(rows, ["nation"], ["c_acctbal", "first_customer"]).select("nation", "first_customer")


@query(
    "t3_union_of_pages",
    """SELECT s_suppkey AS id, s_name AS name, CAST(NULL AS BIGINT) AS size FROM supplier
       UNION ALL SELECT p_partkey, p_name, p_size FROM part
       UNION ALL SELECT c_custkey, NULL, NULL FROM customer""",
)
def t3(fx):
    return tables.union_pages(
        [
            fx("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
            fx("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("bigint").alias("size")),
            fx("customer").select(F.col("c_custkey").alias("id")),
        ]
    )


@query("t4_id_difference", "SELECT o_custkey AS id FROM orders EXCEPT SELECT s_suppkey FROM supplier")
def t4(fx):
    wanted = fx("orders").select(F.col("o_custkey").alias("id")).distinct()
    return tables.unseen(wanted, fx("supplier").select(F.col("s_suppkey").alias("id")), ["id"])


@query(
    "a6_next_id",
    "SELECT c_nationkey AS nation, max(c_custkey) + 1 AS next_id FROM customer GROUP BY c_nationkey UNION ALL SELECT -1, max(c_custkey) + 1 FROM customer",
)
def a6(fx):
    rows = fx("customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("next_id"))
    per = rows.groupBy("nation").agg((F.coalesce(F.max("next_id"), F.lit(0)) + 1).alias("next_id"))
    return per.unionByName(tables.next_id(rows, "next_id").select(F.lit(-1).alias("nation"), "next_id"))


# ---------------------------------------------------------------- text


@query("f1_lower_names", "SELECT c_custkey, lower(c_name) AS name, lower(c_mktsegment) AS segment FROM customer")
def f1(fx):
    return fx("customer").select("c_custkey", F.lower("c_name").alias("name"), F.lower("c_mktsegment").alias("segment"))


@query("f2_stripped_text", r"SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents")
def f2(fx):
    return fx("documents").select("doc_id", text.strip(F.col("text")).alias("text"))


@query(
    "f3_group_titles",
    """SELECT layer_name, workspace, CASE workspace WHEN 'static_files' THEN 'Static Files' WHEN 'input_layers' THEN 'Input Layers'
       ELSE 'Extruded Layers' END AS title FROM fx_layer""",
)
def f3(fx):
    return fx("fx_layer").select("layer_name", "workspace", text.title_from_name(F.col("workspace")).alias("title"))


@query(
    "f4_file_parts",
    r"""WITH t AS (SELECT page_id, regexp_extract(url, '([^/\\]*)$', 1) AS n FROM pages)
        SELECT page_id, n AS file_name, regexp_extract(n, '^(.+?)(?:\.[^.]*)?$', 1) AS stem,
               CASE WHEN regexp_matches(n, '^.+\.[^.]+$') THEN regexp_extract(n, '(\.[^.]+)$', 1) ELSE '' END AS suffix FROM t""",
)
def f4(fx):
    url = F.col("url")
    return fx("pages").select(
        "page_id", text.file_name(url).alias("file_name"), text.file_stem(url).alias("stem"), text.file_suffix(url).alias("suffix")
    )


@query(
    "f5_canonical_json",
    """SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"type":"' || event_type || '"}' AS options_key FROM events""",
)
def f5(fx):
    document = F.concat(F.lit('{ "type" : "'), "event_type", F.lit('",  "k": '), F.get_json_object("props", "$.k"), F.lit(".0}"))
    return fx("events").select("event_id", text.canonical_json(document).alias("options_key"))


@query("f6_array_membership", "SELECT unique_id FROM fx_log WHERE table_a = 'building' OR table_b = 'building'")
def f6(fx):
    from .areas import coverage_log

    return coverage_log(fx).filter(F.array_contains("source_table_list", "building")).select("unique_id")


@query(
    "f8_duration_minutes",
    """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size * 60 ELSE p_size END AS minutes FROM part""",
)
def f8(fx):
    label = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, "h").otherwise("m"))
    return fx("part").select("p_partkey", text.duration_minutes(label).alias("minutes"))


# ---------------------------------------------------------------- cache and catalogue


def cache_rows(fx):
    first = F.concat(F.lit('{"year": '), F.col("year").cast("string"), F.lit(', "confidence": "'), "confidence", F.lit('"}'))
    second = F.concat(F.lit('{"confidence":"'), "confidence", F.lit('","year":'), F.col("year").cast("string"), F.lit("}"))
    return first, second


@query(
    "j7_cache_lookup",
    """SELECT q.request_id, arg_max(c.flood_model_id, (c.created_rank, c.unique_id)) AS flood_model_id
       FROM fx_cache_request q LEFT JOIN fx_cache c ON c.year = q.year AND c.confidence = q.confidence
            AND c.xmin <= q.xmin AND c.ymin <= q.ymin AND q.xmax <= c.xmax AND q.ymax <= c.ymax
       GROUP BY q.request_id""",
)
def j7(fx):
    first, second = cache_rows(fx)
    held = fx("fx_cache").withColumn("scenario_options", F.when(F.col("unique_id") % 2 == 0, first).otherwise(second))
    held = held.withColumnRenamed("created_rank", "created_at")
    asked = fx("fx_cache_request").withColumn("scenario_options", first)
    return cache.lookup(asked, held, 20_000.0)


@query(
    "snk4_cache_entries",
    """SELECT flood_model_id, '{"confidence":"' || confidence || '","year":' || year || '}' AS options_key,
         xmin::DOUBLE AS xmin, ymin::DOUBLE AS ymin, xmax::DOUBLE AS xmax, ymax::DOUBLE AS ymax, true AS is_dated,
         count(*) OVER () AS distinct_ids, 1 AS least_id, count(*) OVER () AS greatest_id FROM fx_cache""",
)
def snk4(fx):
    """Entries stored in the cache table, as read back from it."""
    first, _ = cache_rows(fx)
    table = f"{scratch_database(fx)}.cache"
    results = fx("fx_cache").withColumn("scenario_options", first).select("flood_model_id", "scenario_options", *g.BOX)
    cache.store(fx.spark, results, table)
    stored = fx.spark.table(table)
    ids = stored.agg(F.count_distinct("unique_id").alias("distinct_ids"), F.min("unique_id").alias("least_id"), F.max("unique_id").alias("greatest_id"))
    return stored.select("flood_model_id", "options_key", *g.BOX, F.col("created_at").isNotNull().alias("is_dated")).join(F.broadcast(ids))


@query(
    "j7_stored_cache_lookup",
    """SELECT q.request_id, count(c.flood_model_id) > 0 AS is_held
       FROM fx_cache_request q LEFT JOIN fx_cache c ON c.year = q.year AND c.confidence = q.confidence
            AND c.xmin <= q.xmin AND c.ymin <= q.ymin AND q.xmax <= c.xmax AND q.ymax <= c.ymax
       GROUP BY q.request_id""",
)
def j7_stored(fx):
    """Whether j7 over the stored cache finds a model; entries stored at one time win by ids that storing gives."""
    first, second = cache_rows(fx)
    table = f"{scratch_database(fx)}.cache"
    held = fx("fx_cache").withColumn("scenario_options", F.when(F.col("unique_id") % 2 == 0, first).otherwise(second))
    cache.store(fx.spark, held.select("flood_model_id", "scenario_options", *g.BOX), table)
    found = cache.lookup_table(fx.spark, fx("fx_cache_request").withColumn("scenario_options", first), table, 20_000.0)
    return found.select("request_id", F.col("flood_model_id").isNotNull().alias("is_held"))


VECTOR_JSON = (
    """'{"type":"wfs","name":"' || layer_name || '","description":"Geospatial layers fetched through the backend.","url":"https://maps.example.org/' || workspace"""
    """ || '/ows","typeNames":"' || workspace || ':' || layer_name || '","maxFeatures":60000'"""
    """ || CASE WHEN workspace = 'extruded_layers' THEN ',"heightProperty":"Ext_height"}' ELSE '}' END"""
)
RASTER_JSON = (
    """'{"type":"wms","name":"' || layer_name || '","url":"https://maps.example.org/' || workspace || '/wms","layers":"' || layer_name"""
    """ || '","styles":"' || layer_name || '"}'"""
)


@query(
    "snk12_layer_catalog",
    f"""WITH items AS (SELECT workspace, layer_name, kind, CASE WHEN kind = 'vector' THEN {VECTOR_JSON} ELSE {RASTER_JSON} END AS item FROM fx_layer)
    SELECT workspace, '{{"type":"group","name":"' || CASE workspace WHEN 'static_files' THEN 'Static Files' WHEN 'input_layers' THEN 'Input Layers' ELSE 'Extruded Layers' END
      || '","members":[' || string_agg(item, ',' ORDER BY CASE WHEN kind = 'vector' THEN 0 ELSE 1 END, layer_name) || '],"isOpen":true}}' AS catalog_group
    FROM items GROUP BY workspace""",
)
def snk12(fx):
    return catalog.catalog_groups(fx("fx_layer"), BASE_URL)


@query(
    "snk13_scenario_items",
    """SELECT DISTINCT flood_model_id, 'building_status' AS item_kind, '{"type":"wfs","name":"Building flood status ' || flood_model_id || '","url":"https://maps.example.org/ows","typeNames":"building_flood_status","viewParams":"scenario:' || flood_model_id || '","maxFeatures":60000}' AS item FROM fx_cache
       UNION SELECT DISTINCT flood_model_id, 'flood_depth', '{"type":"wms","name":"Flood depth ' || flood_model_id || '","url":"https://maps.example.org/wms","layers":"output_' || flood_model_id || '","styles":"depth"}' FROM fx_cache""",
)
def snk13(fx):
    return catalog.scenario_items(fx("fx_cache").select("flood_model_id").distinct(), BASE_URL)


@query(
    "snk14_workspace_layers",
    """SELECT w.workspace, k.kind, coalesce(string_agg(l.layer_name, ',' ORDER BY l.layer_name), '') AS layers
       FROM fx_workspace w CROSS JOIN (SELECT unnest(['vector', 'raster']) AS kind) k
       LEFT JOIN fx_nation_layer l ON l.workspace = w.workspace AND l.kind = k.kind GROUP BY w.workspace, k.kind""",
)
def snk14(fx):
    """All layers of both kinds; a workspace's list is one row by the catalogue's format."""
    kinds = [
        catalog.workspace_layers(fx("fx_workspace").select("workspace"), fx("fx_nation_layer"), kind).withColumn("kind", F.lit(kind))
        for kind in ("vector", "raster")
    ]
    return kinds[0].unionByName(kinds[1]).select("workspace", "kind", F.array_join("layers", ",").alias("layers"))
