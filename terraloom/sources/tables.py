"""Catalogue tables: existence, replace, append of unseen rows, stable new ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ID_BUCKETS = 1024

# Metadata table layouts.
REGISTRY_SCHEMA = (
    "unique_id bigint, data_provider string, layer_id int, table_name string, unique_column_name string, "
    "coverage_area string, url string"
)
COVERAGE_LOG_SCHEMA = (
    "unique_id bigint, source_table_list array<string>, created_at timestamp, xmin double, ymin double, "
    "xmax double, ymax double"
)
RESULT_CACHE_SCHEMA = (
    "unique_id bigint, flood_model_id bigint, scenario_options string, options_key string, created_at timestamp, "
    "xmin double, ymin double, xmax double, ymax double"
)
MODEL_OUTPUT_SCHEMA = "unique_id bigint, file_name string, file_path string, created_at timestamp, xmin double, ymin double, xmax double, ymax double"
BUILDING_STATUS_SCHEMA = "unique_id bigint, building_outline_id bigint, is_flooded boolean, flood_model_id bigint"
RIVER_NETWORK_SCHEMA = (
    "rec_network_id bigint, network_path string, network_data_path string, created_at timestamp, xmin double, "
    "ymin double, xmax double, ymax double"
)
NETWORK_EXCLUSION_SCHEMA = "rec_network_id bigint, objectid bigint, exclusion_cause string, wkt string"


def exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def create_if_absent(spark: SparkSession, table: str, schema: str, partition_by: Sequence[str] = ()) -> None:
    partition = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({schema}) USING parquet{partition}")


def read(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int, partitions: int, **properties: str) -> DataFrame:
    """Parallel read of an external table, one range of ``partition_column`` per task."""
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=properties)


def replace(df: DataFrame, table: str, partition_by: Sequence[str] = ()) -> None:
    df.write.format("parquet").mode("overwrite").partitionBy(*partition_by).saveAsTable(table)


def append(df: DataFrame, table: str) -> None:
    """Append by column name; columns new to the table are added to it first, absent ones become null."""
    spark = df.sparkSession
    known = {f.name.lower() for f in spark.table(table).schema}
    fresh = [f for f in df.schema if f.name.lower() not in known]
    if fresh:
        added = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fresh)
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({added})")
    target = spark.table(table).schema
    have = {c.lower(): c for c in df.columns}
    columns = [
        F.col(f"`{have[f.name.lower()]}`").cast(f.dataType).alias(f.name)
        if f.name.lower() in have
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in target
    ]
    df.select(*columns).write.mode("append").insertInto(table)


def next_id(table: DataFrame, id_column: str) -> DataFrame:
    """One row: the id after the largest in use; the first id is 1."""
    return table.agg((F.coalesce(F.max(id_column), F.lit(0)) + 1).cast("bigint").alias(id_column))


def with_new_ids(rows: DataFrame, table: DataFrame, id_column: str, order: Sequence[str]) -> DataFrame:
    """Number ``rows`` after the ids already in ``table``, without one global sort.

    Rows are spread over a fixed number of buckets by the hash of ``order``; a running total over the
    per-bucket counts gives each bucket its first id. The bucket table has at most ``ID_BUCKETS`` rows, so
    its window and its broadcast are bounded. The largest id in use is read when this is called.
    """
    start = table.agg(F.coalesce(F.max(id_column), F.lit(0))).first()[0]
    bucketed = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(ID_BUCKETS)))
    counts = bucketed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + start).alias("_base"))
    within = Window.partitionBy("_bucket").orderBy(*order)
    numbered = bucketed.join(F.broadcast(offsets), "_bucket").withColumn(
        id_column, (F.col("_base") + F.row_number().over(within)).cast("bigint")
    )
    return numbered.drop("_bucket", "_base")


def unseen(rows: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not stored yet; null keys match null keys."""
    known = stored.select(*(F.col(k).alias(f"_known_{k}") for k in keys))
    same: Column = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_known_{key}"))
    return rows.join(known, same, "left_anti")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep one row per distinct ``keys`` (nulls are equal): the first by ``order``.

    The choice is made by an aggregate, so copies are dropped before the shuffle.
    """
    payload = F.struct(*(F.col(c) for c in df.columns))
    picked = df.groupBy(*keys).agg(F.min_by(payload, F.struct(*order)).alias("_row"))
    return picked.select("_row.*")


def union_pages(pages: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column missing from a page is null there."""
    first, *rest = pages
    for page in rest:
        first = first.unionByName(page, allowMissingColumns=True)
    return first


def normalise_columns(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Lower-case all names and put the geometry last; names equal but for case are an error."""
    names = [c.lower() for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"column names differ only in case: {', '.join(clashes)}")
    lowered = df.toDF(*names)
    if geometry not in names:
        return lowered
    return lowered.select(*(f"`{n}`" for n in names if n != geometry), geometry)


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def path_exists(spark: SparkSession, path: str) -> bool:
    system, hadoop = _path(spark, path)
    return system.exists(hadoop)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark reports it for files, with its file system."""
    system, hadoop = _path(spark, path)
    return system.makeQualified(hadoop).toString()
