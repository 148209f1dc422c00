"""Continuous area requests: every micro-batch ingests what its areas still lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import geometry as g
from ..functions import projection as p
from ..plans.ingest import Fetch, Store, ingest
from ..session import cut_lineage
from ..sources import tables

REQUEST_SCHEMA = "request_id bigint, wkt string"
HANDLED_SCHEMA = "request_id bigint, batch_id bigint"


def request_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Requests arriving as JSON files."""
    reader = spark.readStream.schema(REQUEST_SCHEMA)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def areas_of(requests: DataFrame) -> DataFrame:
    """Working-CRS rectangles of geographic WKT requests."""
    boxed = requests.select(F.col("request_id").alias("aoi_id"), p.wkt_to_working_box("wkt").alias("_b"))
    return boxed.select("aoi_id", *(F.col(f"_b.{s}").alias(s) for s in g.BOX)).filter("xmin IS NOT NULL")


def handle_batch(store: Store, fetch: Fetch, handled_table: str, batch: DataFrame, batch_id: int) -> None:
    """Ingest the requests not handled before, then record them.

    A replayed batch finds its requests recorded and adds nothing. If the job dies before recording, the
    ingestion itself skips the features it already has, and the coverage log the requests it already has.
    """
    spark = store.spark
    tables.create_if_absent(spark, handled_table, HANDLED_SCHEMA)
    fresh = tables.unseen(tables.first_per_key(batch, ["request_id"], ["wkt"]), spark.table(handled_table), ["request_id"])
    # A batch belongs to a session of its own, whose table cache is not ours; go on in the store's session.
    fresh = cut_lineage(fresh, spark)
    if fresh.isEmpty():
        return
    ingest(store, areas_of(fresh), fetch, once=True)
    tables.append(fresh.select("request_id", F.lit(batch_id).cast("bigint").alias("batch_id")), handled_table)


def start(requests: DataFrame, store: Store, fetch: Fetch, checkpoint: str, handled_table: str = "handled_requests") -> StreamingQuery:
    """Run over everything available and stop; schedule it, or change the trigger, to run on."""
    return (
        requests.writeStream.foreachBatch(lambda batch, batch_id: handle_batch(store, fetch, handled_table, batch, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
