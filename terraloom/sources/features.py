"""Paged vector sources as a Spark data source: one page is one partition, read by executors.

``format("feature_pages")`` serves two public protocols. ``protocol=layer`` is a feature layer queried by
offset; ``protocol=wfs`` a Web Feature Service queried by start index. ``transport=http`` fetches over the
network, ``transport=files`` reads the same documents from a shared folder (``layer.json``, ``count.json``,
``page_<offset>.json``, each a file or a folder of a text writer's parts), as :func:`store_pages` lays them out, with
``pages``, a table of the pages' extents.

With ``box_columns`` a feature also has the sides of its box, and conditions on all four of them are pushed down: only
pages of features that meet that box are planned. :func:`fetch_in` does the same for any number of rectangles at once:
tasks plan the pages of each, and every page that meets one is fetched once.
"""

from __future__ import annotations

import json
import os
import sys
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..errors import SourceError
from ..functions import geometry as g
from ..operators.spatial_join import semi_join
from ..session import cut_lineage
from . import tables

# Workers unpickle the reader without importing this package, so it need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(sys.modules[SourceError.__module__])

# Service hosts, geometry columns and field types of the public services.
WFS_HOSTS = {"StatsNZ": "datafinder.stats.govt.nz", "LINZ": "data.linz.govt.nz", "MFE": "data.mfe.govt.nz"}
WFS_PAGE = 10_000
#: Features of a stored page at most.
PAGE_FEATURES = 10_000
DEFAULT_SRID = 2193
FIELD_TYPES = {
    "esriFieldTypeOID": LongType(),
    "esriFieldTypeInteger": LongType(),
    "esriFieldTypeSmallInteger": IntegerType(),
    "esriFieldTypeDouble": DoubleType(),
    "esriFieldTypeSingle": DoubleType(),
    "integer": LongType(),
    "int": LongType(),
    "double": DoubleType(),
    "float": DoubleType(),
}


ARROW_TYPES = {"LongType": pa.int64(), "IntegerType": pa.int32(), "DoubleType": pa.float64(), "StringType": pa.string()}
#: Extents of stored pages beside their documents.
INDEX = "pages"


class PagePartition(InputPartition):
    def __init__(self, offset: int, params: dict):
        super().__init__(offset)
        self.offset = offset
        self.params = params


def selection(bbox: str | None, area_srid: int | None, meeting: bool = False) -> dict:
    """Which features are meant: all, those inside an envelope, or those ``meeting`` it. Counting and paging use the same."""
    # Parameters of the query protocol.
    if not bbox:
        return {"where": "1=1"}
    return {
        "where": "1=1",
        "geometry": bbox,
        "geometryType": "esriGeometryEnvelope",
        "inSR": area_srid or DEFAULT_SRID,
        "spatialRel": "esriSpatialRelIntersects" if meeting else "esriSpatialRelContains",
    }


def page_params(size: int, total: int, chosen: dict, output_srid: int | None = None, order_by: str | None = None) -> list[dict]:
    """Query parameters of every page of a selection, in the order of ``order_by`` so that pages neither repeat nor lose rows.

    An area fixes the output CRS, so giving both is an error.
    """
    if size <= 0:
        raise SourceError("the layer reports no page size")
    if "inSR" in chosen and output_srid is not None:
        raise ValueError("output_srid must not be given together with an area")
    each = chosen | {"outFields": "*", "f": "geojson", "outSR": chosen.get("inSR", output_srid or DEFAULT_SRID)}
    if order_by:
        each["orderByFields"] = order_by
    return [each | {"resultOffset": offset} for offset in range(0, total, size)]


def _fetch(url: str, params: dict, retries: int, delay: float) -> dict:
    """One JSON document; waits ``delay`` times the number of the try between tries."""
    target = f"{url}?{urllib.parse.urlencode(params)}"
    for attempt in range(1, retries + 2):
        try:
            with urllib.request.urlopen(target, timeout=120) as response:
                return json.load(response)
        except OSError as error:
            if attempt > retries:
                raise SourceError(f"could not fetch {url}") from error
            time.sleep(delay * attempt)
    raise AssertionError("unreachable")


class FeaturePages(DataSource):
    """Options: ``path``, ``protocol``, ``transport``, ``bbox``, ``meeting``, ``area_srid``, ``output_srid``, ``provider``, ``layer_id``, ``key``,
    ``retries``, ``delay``, ``box_columns``."""

    @classmethod
    def name(cls) -> str:
        return "feature_pages"

    def schema(self) -> StructType:
        """Fields the layer declares, all names as served, and the geometry as GeoJSON text."""
        meta = self._service().metadata()
        fields = [StructField(f["name"], FIELD_TYPES.get(f.get("type", ""), StringType())) for f in meta.get("fields", []) if f.get("type") != "esriFieldTypeGeometry"]
        box = [StructField(side, DoubleType()) for side in g.BOX] if self.options.get("box_columns") == "true" else []
        return StructType([*fields, *box, StructField("geometry", StringType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(self._service(), schema)

    def _service(self) -> Service:
        return Service(dict(self.options))


class Service:
    """Where the documents of one layer come from."""

    def __init__(self, options: dict):
        self.options = options
        self.wfs = options.get("protocol", "layer") == "wfs"
        self.files = options.get("transport", "http") == "files"
        self.retries = int(options.get("retries", "0"))
        self.delay = float(options.get("delay", "0"))
        if self.wfs and options.get("provider") not in WFS_HOSTS:
            raise ValueError(f"unsupported data provider: {options.get('provider')}")
        if self.wfs and not self.files:
            key = options.get("key", "")
            self.url = f"https://{WFS_HOSTS[options['provider']]}/services;key={key}/wfs"
        elif self.wfs:
            self.url = os.path.join(options["path"], options["provider"], f"layer-{options['layer_id']}")
        else:
            self.url = options["path"]

    def document(self, name: str, suffix: str, params: dict) -> dict:
        if self.files:
            try:
                return json.loads(_text_of(self.url, name))
            except OSError as error:
                raise SourceError(f"could not read {name} of {self.url}") from error
        return _fetch(self.url + suffix, params, self.retries, self.delay)

    def metadata(self) -> dict:
        if self.wfs and not self.files:
            described = self.document("", "", self._wfs("DescribeFeatureType", outputFormat="application/json"))
            kinds = described["featureTypes"][0]["properties"]
            return {"fields": [{"name": p["name"], "type": p.get("localType", "")} for p in kinds if not p.get("type", "").startswith("gml:")]}
        return self.document("layer.json", "", {"f": "json"})

    def stored_pages(self, bbox: str | None) -> list[PagePartition] | None:
        """Pages of a stored layer, those that meet the box if there is one; None without an index of them."""
        store, root = pa.fs.FileSystem.from_uri(self.url)
        if store.get_file_info(f"{root}/{INDEX}").type != pa.fs.FileType.Directory:
            return None
        index = pa.dataset.dataset(f"{root}/{INDEX}", filesystem=store, format="parquet")
        x0, y0, x1, y1 = map(float, bbox.split(",")) if bbox else (None,) * 4
        met = (pa.dataset.field("xmin") <= x1) & (pa.dataset.field("xmax") >= x0) & (pa.dataset.field("ymin") <= y1) & (pa.dataset.field("ymax") >= y0) if bbox else None
        return [PagePartition(o, {}) for o in index.to_table(columns=["offset"], filter=met).column("offset").to_pylist()]

    def _wfs(self, request: str, **more) -> dict:
        base = {"service": "WFS", "version": "2.0.0", "request": request, "typeNames": f"layer-{self.options['layer_id']}"}
        return base | more

    def pages(self) -> list[PagePartition]:
        bbox = self.options.get("bbox")
        srid = self.options.get("output_srid")
        stored = self.stored_pages(bbox) if self.files else None
        if stored is not None:
            return stored
        if self.wfs:
            code = int(srid or self.options.get("area_srid") or DEFAULT_SRID)
            box = {"bbox": f"{bbox},EPSG:{self.options.get('area_srid', code)}"} if bbox else {}
            hits = self.document("count.json", "", self._wfs("GetFeature", resultType="hits", outputFormat="application/json", **box))
            total = hits.get("numberMatched", hits.get("count"))
            size = int(self.metadata().get("maxRecordCount", WFS_PAGE)) if self.files else WFS_PAGE
            common = self._wfs("GetFeature", outputFormat="application/json", srsName=f"EPSG:{code}", count=size, **box)
            params = [common | {"startIndex": i, "resultOffset": i} for i in range(0, _known(total), size)]
        else:
            layer = self.metadata()
            area_srid = self.options.get("area_srid")
            chosen = selection(bbox, area_srid and int(area_srid), self.options.get("meeting") == "true")
            counted = self.document("count.json", "/query", chosen | {"f": "json", "returnCountOnly": "true"})
            size, total = _known(layer.get("maxRecordCount")), _known(counted.get("count"))
            params = page_params(size, total, chosen, srid and int(srid), _id_field(layer))
        return [PagePartition(p["resultOffset"], p) for p in params]

    def page(self, partition: PagePartition) -> dict:
        params = partition.params
        if self.wfs:
            params = {k: v for k, v in params.items() if k != "resultOffset"}
        return self.document(f"page_{partition.offset}.json", "" if self.wfs else "/query", params)


def _id_field(layer: dict) -> str | None:
    """The layer's id field, by which pages can be ordered."""
    named = [f["name"] for f in layer.get("fields", []) if f.get("type") == "esriFieldTypeOID"]
    return layer.get("objectIdField") or (named[0] if named else None)


def _known(count: object) -> int:
    if count is None:
        raise SourceError("failed to get the feature layer record counts")
    return int(count)


def _text_of(folder: str, name: str) -> bytes:
    """A document as one file, or as the part of a folder that Spark's text writer made."""
    store, root = pa.fs.FileSystem.from_uri(folder)
    for path in (f"{root}/{name}", f"{root}/document={name}"):
        kind = store.get_file_info(path).type
        if kind == pa.fs.FileType.File:
            with store.open_input_stream(path) as stream:
                return stream.readall()
        if kind == pa.fs.FileType.Directory:
            found = store.get_file_info(pa.fs.FileSelector(path))
            parts = sorted(f.path for f in found if f.base_name.startswith("part-"))
            return b"".join(store.open_input_stream(p).readall() for p in parts)
    raise FileNotFoundError(f"{folder}/{name}")


def page_batch(page: dict, offset: int, columns: list[tuple[str, str]]) -> pa.RecordBatch:
    """The rows of one page; an answer without features fails the job rather than losing a page."""
    if "features" not in page:
        raise SourceError(f"page at offset {offset} holds no feature list: {str(page)[:200]}")
    served = page["features"]
    convert = {"LongType": int, "IntegerType": int, "DoubleType": float, "StringType": lambda v: v if isinstance(v, str) else json.dumps(v)}
    boxes = [_box_of(f.get("geometry")) for f in served] if any(name in g.BOX for name, _ in columns) else []
    arrays = []
    for name, kind in columns:
        if name == "geometry":
            values = [None if f.get("geometry") is None else json.dumps(f["geometry"]) for f in served]
        elif boxes and name in g.BOX:
            values = [box and box[g.BOX.index(name)] for box in boxes]
        else:
            values = [(f.get("properties") or {}).get(name) for f in served]
            values = [None if v is None else convert[kind](v) for v in values]
        arrays.append(pa.array(values, ARROW_TYPES[kind]))
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in columns])


def _box_of(shape: dict | None) -> tuple[float, float, float, float] | None:
    points, waiting = [], [shape["coordinates"]] if shape else []
    while waiting:
        part = waiting.pop()
        if part and isinstance(part[0], (int, float)):
            points.append(part)
        else:
            waiting.extend(part)
    if not points:
        return None
    xs, ys = [float(p[0]) for p in points], [float(p[1]) for p in points]
    return min(xs), min(ys), max(xs), max(ys)


def _columns(schema: StructType) -> list[tuple[str, str]]:
    return [(f.name, type(f.dataType).__name__) for f in schema.fields]


class PageReader(DataSourceReader):
    def __init__(self, service: Service, schema: StructType):
        self.service = service
        self.columns = _columns(schema)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """A lower bound of the upper sides and an upper bound of the lower sides, all four, are a box that features
        have to meet; the service is asked for those alone. Spark still applies all conditions."""
        if self.service.options.get("box_columns") == "true":
            bounds = dict.fromkeys(g.BOX)
            for f in filters:
                side = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
                if side in ("xmax", "ymax") and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    low = side.replace("max", "min")
                    bounds[low] = f.value if bounds[low] is None else max(bounds[low], f.value)
                elif side in ("xmin", "ymin") and isinstance(f, (LessThan, LessThanOrEqual)):
                    high = side.replace("min", "max")
                    bounds[high] = f.value if bounds[high] is None else min(bounds[high], f.value)
            if None not in bounds.values() and "bbox" not in self.service.options:
                self.service.options |= {"bbox": box_option(tuple(bounds[side] for side in g.BOX)), "meeting": "true"}
        return filters

    def partitions(self) -> list[PagePartition]:
        return self.service.pages()

    def read(self, partition: PagePartition) -> Iterator[pa.RecordBatch]:
        yield page_batch(self.service.page(partition), partition.offset, self.columns)


def fetch_features(spark: SparkSession, **options: str) -> DataFrame:
    """Features of one layer: lower-case names, geometry struct last."""
    return _shaped(read_pages(spark, **options))


def read_pages(spark: SparkSession, **options: str) -> DataFrame:
    """The layer as served. With ``box_columns=true`` conditions on the sides of features' boxes reach the service."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeaturePages)
    return spark.read.format("feature_pages").options(**options).load()


def _shaped(raw: DataFrame) -> DataFrame:
    return tables.normalise_columns(raw).withColumn("geometry", g.from_geojson("geometry"))


def fetch_in(pieces: DataFrame, cell_size: float = 10_000.0, **options: str) -> DataFrame:
    """Features of the pages that meet any of the rectangles ``pieces(xmin..ymax)``; of a stored layer those are looked
    up in its index by a spatial join, of a service tasks ask for the count of every rectangle. Each page is fetched
    once, a request of its own; a feature that several rectangles' answers hold comes as often."""
    spark, service = pieces.sparkSession, Service(dict(options))
    columns = _columns(schema := FeaturePages(dict(options)).schema())
    boxes = pieces.select(*(F.col(side).cast("double").alias(side) for side in g.BOX)).distinct()
    if service.files:
        index = spark.read.parquet(f"{service.url}/{INDEX}")
        asked = [f"_p_{side}" for side in g.BOX]
        met = semi_join(index, boxes.toDF(*asked), ["offset"], cell_size, right_box=asked)
        pages = met.select("offset", F.lit("{}").alias("params"))
    else:
        pages = boxes.mapInArrow(_planned(dict(options)), "offset long, params string").distinct()

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for offset, params in zip(batch.column("offset").to_pylist(), batch.column("params").to_pylist(), strict=True):
                yield page_batch(service.page(PagePartition(offset, json.loads(params))), offset, columns)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _shaped(pages.repartition(tasks, "offset", "params").mapInArrow(fetch, schema))


def _planned(options: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for box in zip(*(batch.column(side).to_pylist() for side in g.BOX), strict=True):
                pages = Service(options | {"bbox": box_option(box), "meeting": "true"}).pages()
                params = [json.dumps(p.params, sort_keys=True) for p in pages]
                yield pa.RecordBatch.from_arrays([pa.array([p.offset for p in pages], pa.int64()), pa.array(params, pa.string())], names=["offset", "params"])

    return run


def fetcher(spark: SparkSession, cell_size: float = 10_000.0, **common: str) -> Callable[[Row, DataFrame | None], DataFrame]:
    """What the ingestion jobs call for a layer of the registry: whole without rectangles, else the pages that meet
    them. Layers of a known provider are asked by WFS, others as feature layers at their URL."""

    def fetch(layer: Row, pieces: DataFrame | None) -> DataFrame:
        own = {"path": layer["url"]} | common
        if layer["data_provider"] in WFS_HOSTS:
            own |= {"protocol": "wfs", "provider": layer["data_provider"], "layer_id": str(layer["layer_id"])}
        return fetch_features(spark, **own) if pieces is None else fetch_in(pieces, cell_size, **own)

    return fetch


def store_pages(features: DataFrame, folder: str, fields: list[dict], page_size: int = PAGE_FEATURES) -> None:
    """A layer's documents in a shared folder, by Spark's own writers: ``features`` has the GeoJSON text ``feature``, the
    number ``page`` of its page and its box. ``fields`` are the layer's, as its description has them.

    A reader holds a page whole, so a page of more than ``page_size`` features becomes several.
    """
    spark = features.sparkSession
    pages = _bounded_pages(features, page_size).groupBy("offset").agg(
        *(F.min(side).alias(side) for side in g.BOX[:2]), *(F.max(side).alias(side) for side in g.BOX[2:]), F.count(F.lit(1)).alias("n"),
        F.concat(F.lit('{"features":['), F.concat_ws(",", F.collect_list("feature")), F.lit("]}")).alias("value"),
    )
    named = pages.select(F.format_string("page_%d.json", "offset").alias("document"), "value")
    named.write.mode("overwrite").partitionBy("document").text(folder)
    pages.drop("value").write.mode("overwrite").parquet(f"{folder}/{INDEX}")
    counted = spark.read.parquet(f"{folder}/{INDEX}").agg(F.to_json(F.struct(F.coalesce(F.sum("n"), F.lit(0)).alias("count"))).alias("value"))
    counted.coalesce(1).write.mode("overwrite").text(f"{folder}/count.json")
    described = json.dumps({"maxRecordCount": 1, "fields": fields})
    spark.range(1).select(F.lit(described).alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/layer.json")


def _bounded_pages(features: DataFrame, page_size: int) -> DataFrame:
    """Features with the ``offset`` of their document: their page's number, or one above all pages for the further parts
    of a crowded page. Such a page is dealt by hash to twice the parts it needs, so that no task numbers all of it; what
    is still above the size, as equal features are, is cut by number."""
    numbered = features.withColumn("page", F.col("page").cast("long"))
    counts = cut_lineage(numbered.groupBy("page").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("page", "_of"))
    parts = F.when(F.col("_n") > page_size, F.ceil(2 * F.col("_n") / page_size)).otherwise(F.lit(1))
    dealt = numbered.join(counts, F.col("page").eqNullSafe(F.col("_of"))).withColumn("_part", F.pmod(F.xxhash64("feature"), parts)).drop("_of", "_n")
    place = F.row_number().over(Window.partitionBy("page", "_part").orderBy("feature", *g.BOX)) - 1
    cut = cut_lineage(dealt.withColumn("_cut", F.floor(place / page_size)))
    further = cut.filter("_part > 0 OR _cut > 0").select("page", "_part", "_cut").distinct()
    offsets = cut_lineage(tables.with_new_ids(further, counts, "_of", ["page", "_part", "_cut"]))
    same = F.lit(True)
    for column in ("page", "_part", "_cut"):
        same = same & F.col(column).eqNullSafe(F.col(f"_at_{column}"))
    joined = cut.join(offsets.toDF("_at_page", "_at__part", "_at__cut", "_at"), same, "left")
    return joined.select("feature", *g.BOX, F.coalesce("_at", "page").alias("offset"))


def fetch_with_backup(spark: SparkSession, primary: dict[str, str], backup: dict[str, str]) -> DataFrame:
    """The primary layer, or the backup when the primary cannot be described or planned.

    Page failures inside a running job still fail that job; retries are a source option.
    """
    try:
        Service(dict(primary)).pages()
    except SourceError:
        return fetch_features(spark, **backup)
    return fetch_features(spark, **primary)


def box_option(area: tuple[float, float, float, float]) -> str:
    return ",".join(repr(float(v)) for v in area)


def counted_pages(total: DataFrame, max_count: str = "max_count", total_count: str = "total_count") -> DataFrame:
    """Page plan as rows: one ``result_offset`` per page of every layer in the frame."""
    last = F.col(total_count) - 1
    planned = total.filter(F.col(total_count) > 0)
    return planned.withColumn("result_offset", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.col(max_count).cast("long"))))
