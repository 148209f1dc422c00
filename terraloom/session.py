"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that hold from a laptop to a large cluster. The number of shuffle partitions is left to the
# cluster: AQE coalesces a generous setting down to what the data needs.
SPARK_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    # Of a repeated JSON key the last value counts, as in the usual databases.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

#: Spark's setting by which a query's shuffle files are removed when the query ends.
RELEASE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(app_name: str = "terraloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; ``conf`` keys use ``__`` for ``.``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SPARK_DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; a cluster without the setting is an error,
    because a machine-local folder would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    local = tempfile.mkdtemp(prefix="terraloom-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of every query executed go when that query ends, not when the driver collects garbage.

    For jobs of many written tables: each is read from its files, so no shuffle is needed twice. A frame that is executed
    twice computes its shuffles twice.
    """
    before = spark.conf.get(RELEASE_SHUFFLES)
    spark.conf.set(RELEASE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(RELEASE_SHUFFLES, before)


def cut_lineage(df: DataFrame, spark: SparkSession | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back, in ``spark`` or the frame's own session.

    Unlike ``checkpoint()`` this computes the plan once, keeps the data columnar and gives the next round
    true sizes, and it survives the loss of executors. ``compression`` is the session's unless named.
    """
    spark = spark or df.sparkSession
    path = f"{scratch_root(spark)}/terraloom-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path, compression=compression)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._scratch_path = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`cut_lineage` once all that was computed from them is written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
