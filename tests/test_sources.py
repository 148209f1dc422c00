import json

import pytest
from pyspark.sql import functions as F

from terraloom.errors import CrsError, InstructionError, SourceError
from terraloom.functions import geometry as g
from terraloom.plans import ingest
from terraloom.sources import features, instructions, rainfall_text, tables, vector_files

ENTRY = {"data_provider": "LINZ", "layer_id": 101, "table_name": "roads", "unique_column_name": "road_id", "url": " https://example.org/1\n"}


def write_json(path, document):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(document), encoding="utf-8")
    return str(path)


def test_instruction_file(spark, tmp_path):
    path = write_json(tmp_path / "i.json", {"a": ENTRY, "b": {**ENTRY, "url": "https://example.org/1"}, "c": {**ENTRY, "layer_id": 102}})
    rows = instructions.read_instructions(spark, path).orderBy("section").collect()
    assert [(r["section"], r["layer_id"], r["url"]) for r in rows] == [("a", 101, "https://example.org/1"), ("c", 102, "https://example.org/1")]
    empty = instructions.read_instructions(spark, None)
    assert empty.count() == 0 and empty.columns == ["section", *instructions.FIELDS]


@pytest.mark.parametrize("change", [{"coverage_area": "New Zealand"}, {"unique_column_name": " "}])
def test_instruction_rules(spark, tmp_path, change):
    with pytest.raises(InstructionError):
        instructions.read_instructions(spark, write_json(tmp_path / "i.json", {"a": {**ENTRY, **change}}))


def test_storing_instructions_twice_adds_nothing(spark, tmp_path):
    path = write_json(tmp_path / "i.json", {"a": ENTRY, "c": {**ENTRY, "layer_id": 102}})
    for _ in range(2):
        instructions.store_instructions(spark, "registry_twice", path)
    rows = spark.table("registry_twice").collect()
    assert sorted(r["unique_id"] for r in rows) == [1, 2]


def layer(folder, total=5, size=2, **changes):
    write_json(folder / "layer.json", {"maxRecordCount": size, "fields": [{"name": "ID", "type": "esriFieldTypeOID"}, {"name": "Name", "type": "esriFieldTypeString"}]})
    write_json(folder / "count.json", {"count": total})
    for offset in range(0, total, size):
        page = [
            {"properties": {"ID": i, "Name": f"n{i}"}, "geometry": {"type": "Point", "coordinates": [i, i * 2]} if i else None} for i in range(offset, min(offset + size, total))
        ]
        write_json(folder / f"page_{offset}.json", {"features": page})
    for name, document in changes.items():
        write_json(folder / f"{name}.json", document)
    return str(folder)


def test_paged_features(spark, tmp_path):
    found = features.fetch_features(spark, path=layer(tmp_path / "l"), transport="files")
    assert found.columns == ["id", "name", "geometry"]
    assert found.rdd.getNumPartitions() == 3
    rows = {r["id"]: r["geometry"] for r in found.collect()}
    assert len(rows) == 5 and rows[0] is None and rows[3]["ymin"] == 6.0


def test_missing_count_and_broken_page_fail(spark, tmp_path):
    with pytest.raises(Exception, match="record counts"):
        features.fetch_features(spark, path=layer(tmp_path / "a", count={"error": "no"}), transport="files").count()
    with pytest.raises(Exception, match="no feature list"):
        features.fetch_features(spark, path=layer(tmp_path / "b", page_2={"error": "busy"}), transport="files").count()


def test_page_parameters():
    with pytest.raises(ValueError):
        features.page_params(10, 20, features.selection("0,0,1,1", 2193), 4326)
    with pytest.raises(SourceError):
        features.page_params(0, 20, features.selection(None, None))
    plain = features.page_params(10, 25, features.selection(None, None), order_by="OBJECTID")
    assert all(p["orderByFields"] == "OBJECTID" for p in plain)
    assert [p["resultOffset"] for p in plain] == [0, 10, 20] and plain[0]["outSR"] == 2193
    boxed = features.page_params(10, 5, features.selection("0,0,1,1", 4326))[0]
    assert (boxed["inSR"], boxed["outSR"], boxed["spatialRel"]) == (4326, 4326, "esriSpatialRelContains")
    assert features.page_params(10, 0, features.selection(None, None)) == []


def stored_layer(spark, folder, n=100):
    """Points on a grid of ten by ten, a page per column."""
    rows = spark.range(n).select((F.col("id") % 10).cast("double").alias("x"), F.floor(F.col("id") / 10).cast("double").alias("y"), "id")
    shape = F.format_string('{"type":"Feature","properties":{"ID":%d},"geometry":{"type":"Point","coordinates":[%.1f,%.1f]}}', "id", "x", "y")
    boxed = rows.select(shape.alias("feature"), F.col("x").cast("long").alias("page"), *(F.col(c).alias(s) for c, s in zip("xyxy", g.BOX, strict=True)))
    features.store_pages(boxed, folder, [{"name": "ID", "type": "esriFieldTypeOID"}])
    return folder


def break_pages(folder, offsets):
    """Pages that must not be fetched answer with an error."""
    import pathlib
    import shutil

    for offset in offsets:
        page = pathlib.Path(folder, f"document=page_{offset}.json")
        shutil.rmtree(page)
        page.mkdir()
        (page / "part-0.txt").write_text('{"error": "not to be fetched"}')


def test_box_conditions_reach_the_pages(spark, tmp_path):
    folder = stored_layer(spark, str(tmp_path / "layer"))
    break_pages(folder, [0, 1, 5, 6, 7, 8, 9])
    found = features.read_pages(spark, path=folder, transport="files", box_columns="true")
    met = found.filter("xmax >= 2.0 AND xmin <= 4.5 AND ymax > 3.0 AND ymin <= 6.0")
    assert met.rdd.getNumPartitions() == 3
    assert sorted(r.ID for r in met.collect()) == [10 * y + x for y in (4, 5, 6) for x in (2, 3, 4)]
    with pytest.raises(Exception, match="not to be fetched"):
        found.filter("xmax >= 2.0 AND xmin <= 4.5").count()  # no box: all pages


def test_pages_of_rectangles(spark, tmp_path):
    """Only pages that meet a rectangle are fetched, and each once."""
    folder = stored_layer(spark, str(tmp_path / "layer"))
    break_pages(folder, [0, 3, 4, 5, 8, 9])
    pieces = spark.createDataFrame([(0.5, 0.0, 2.0, 3.0), (1.5, 1.0, 2.5, 9.0), (6.0, 0.0, 7.0, 0.0), (50.0, 50.0, 60.0, 60.0)], list(g.BOX))
    found = features.fetch_in(pieces, 10.0, path=folder, transport="files")
    assert found.columns == ["id", "geometry"]
    assert sorted(r.id for r in found.collect()) == sorted(10 * y + x for y in range(10) for x in (1, 2, 6, 7))
    assert features.fetch_in(pieces.limit(0), 10.0, path=folder, transport="files").count() == 0


def test_service_pages_are_planned_by_tasks(spark, monkeypatch):
    """The plan of a service: each rectangle's count, pages by offset, all features that meet it."""
    asked = []

    def answer(url, params, retries, delay):
        asked.append((url, dict(params), retries))
        return {"count": 5} if "returnCountOnly" in params else {"maxRecordCount": 2, "objectIdField": "ID", "fields": []}

    monkeypatch.setattr(features, "_fetch", answer)
    plan = features._planned({"path": "https://example.org/0", "retries": "3", "area_srid": "2193"})
    import pyarrow as pa

    batches = list(plan([pa.RecordBatch.from_pydict({s: [v] for s, v in zip(g.BOX, (1.0, 2.0, 3.0, 4.0), strict=True)})]))
    params = [json.loads(p) for b in batches for p in b.column("params").to_pylist()]
    assert [p["resultOffset"] for p in params] == [0, 2, 4]
    assert {(p["geometry"], p["spatialRel"], p["orderByFields"]) for p in params} == {("1.0,2.0,3.0,4.0", "esriSpatialRelIntersects", "ID")}
    assert all(r == 3 for _, _, r in asked)


def test_fetcher_follows_the_registry(spark, tmp_path):
    stored_layer(spark, str(tmp_path / "LINZ" / "layer-7"))
    fetch = features.fetcher(spark, 10.0, path=str(tmp_path), transport="files")
    layer_row = {"data_provider": "LINZ", "layer_id": 7, "url": "https://example.org"}
    assert fetch(layer_row, None).count() == 100
    one = spark.createDataFrame([(2.0, 2.0, 2.0, 2.0)], list(g.BOX))
    assert sorted(r.id for r in fetch(layer_row, one).collect()) == [10 * y + 2 for y in range(10)]


def test_unknown_provider(spark, tmp_path):
    with pytest.raises(Exception, match="unsupported data provider"):
        features.fetch_features(spark, path=str(tmp_path), transport="files", protocol="wfs", provider="Nobody", layer_id="1")


def test_backup_source(spark, tmp_path):
    found = features.fetch_with_backup(spark, {"path": str(tmp_path / "gone"), "transport": "files"}, {"path": layer(tmp_path / "l"), "transport": "files"})
    assert found.count() == 5


def collection(name="EPSG:2193"):
    point = {"type": "Feature", "properties": {"Ext_height": 3.5, "Kind": "x"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}
    return {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": name}}, "features": [point, point]}


def test_directory_of_static_files(spark, tmp_path):
    write_json(tmp_path / "geo" / "towers.geojson", collection())
    write_json(tmp_path / "geo" / "3d" / "blocks.geojson", collection())
    (tmp_path / "geo" / "notes.txt").write_text("no layer")
    (tmp_path / "geo" / "depth.tif").write_bytes(b"II")
    listing = {r["table_name"]: (r["route"], r["workspace"]) for r in vector_files.load_directory(spark, str(tmp_path / "geo")).collect()}
    assert listing == {"towers": ("vector", "static_files"), "blocks": ("vector", "extruded_layers"), "depth": ("raster", "static_files")}
    stored = spark.table("blocks")
    assert stored.columns == ["srid", "ext_height", "kind", "geometry"] and stored.count() == 2
    assert vector_files.load_directory(spark, str(tmp_path / "missing")).count() == 0


def test_vector_file_without_epsg(spark, tmp_path):
    with pytest.raises(CrsError):
        vector_files.read_geojson(spark, write_json(tmp_path / "x.geojson", collection("local grid")))


def test_rainfall_files(spark, tmp_path):
    names = "ARI,AEP," + ",".join(rainfall_text.DURATIONS)
    values = ",".join(str(v) for v in range(1, 13))
    text = "\r\n".join(["Site", "", "Depths :: Historical Data", names, f"2,0.5,{values}", "", "Depths :: RCP4.5 for the period 2031-2050", names, f"50,0.02,{values}"])
    (tmp_path / "A101.csv").write_text(text)
    files = rainfall_text.read_files(spark, str(tmp_path))
    blocks = rainfall_text.block_structure(files).orderBy("block_no").collect()
    assert [(r["site_id"], r["skip_rows"], r["rcp"], r["time_period"], r["category"]) for r in blocks] == [("A101", 3, None, None, "hist"), ("A101", 7, 4.5, "2031-2050", "proj")]
    for _ in range(2):
        rainfall_text.store(spark, files)
    stored = spark.table(rainfall_text.DEPTH_TABLE)
    assert stored.count() == 2 and stored.agg(F.sum("120h")).first()[0] == 24.0


def test_column_names_that_clash(spark):
    with pytest.raises(ValueError):
        tables.normalise_columns(spark.createDataFrame([(1, 2)], "id int, x int").toDF("A", "a"))


def test_new_ids_are_consecutive(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 100003).alias("v"))
    stored = spark.createDataFrame([(41,)], "unique_id bigint")
    ids = tables.with_new_ids(rows, stored, "unique_id", ["v"]).agg(F.min("unique_id"), F.max("unique_id"), F.countDistinct("unique_id")).first()
    assert tuple(ids) == (42, 5041, 5000)


def test_ingestion_skips_covered_ground(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS covered")
    store = ingest.Store(spark, "covered.registry", "covered.log", cell_size=10.0)
    store.prepare()
    tables.append(
        spark.createDataFrame([(1, "LINZ", 1, "covered.roads", "Road_ID", None, "u")], "unique_id bigint, data_provider string, layer_id int, table_name string, unique_column_name string, coverage_area string, url string"),
        store.registry,
    )
    asked = []

    def fetch(layer, pieces):
        asked.append(sorted(tuple(r) for r in pieces.select(*g.BOX).collect()))
        points = spark.range(100).select(F.col("id").alias("Road_ID"), g.point_geometry(F.col("id") % 10 + 0.5, F.floor(F.col("id") / 10) + 0.5).alias("geometry"))
        return points

    def area(*box):
        return spark.createDataFrame([(1, *map(float, box))], "aoi_id int, xmin double, ymin double, xmax double, ymax double")

    for box in ((0, 0, 5, 10), (0, 0, 7, 10), (1, 1, 6, 9)):
        ingest.ingest(store, area(*box), fetch)
    assert asked == [[(0.0, 0.0, 5.0, 10.0)], [(5.0, 0.0, 7.0, 10.0)]]
    assert spark.table("covered.roads").count() == 70
    assert sorted(r["unique_id"] for r in spark.table("covered.log").collect()) == [1, 2, 3]
    with pytest.raises(ingest.NothingUncoveredError):
        ingest.area_to_fetch(store, area(2, 2, 3, 3), "covered.roads")
