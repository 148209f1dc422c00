"""Contiguous shards of near-equal bytes.

Documents are dealt to ranges of ``doc_id`` and their sizes added up per range. A prefix sum over the ranges'
totals and one within each range give every document its first byte in the whole corpus; equal targets cut that
line into shards. Only DataFrame functions are used.

Defined results: a null text has no bytes, and every document counts one byte more than its text; null ids come
first; rows with equal ids follow each other in the order in which they are read; an empty table has no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraloom.session import cut_lineage


def ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with the number of their range, ``_range``, in ``order``; stored, so a range keeps its rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))


def offset_in_order(ranges: DataFrame, order: list[str], **amounts: Column) -> DataFrame:
    """Adds, for each name, the sum of its amount over all rows before; ``ranges`` as :func:`ranged` gives them.

    One row per range passes through a window over all ranges; the rows themselves only through windows within theirs.
    """
    totals = ranges.groupBy("_range").agg(*(F.sum(a).alias(f"_{n}") for n, a in amounts.items()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select("_range", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_first_{n}") for n in amounts))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.select("*", *(F.coalesce(F.sum(a).over(within), F.lit(0)).alias(f"_in_{n}") for n, a in amounts.items()))
    return placed.join(F.broadcast(firsts), "_range").select(*ranges.columns, *((F.col(f"_in_{n}") + F.col(f"_first_{n}")).alias(n) for n in amounts))


def sharded(docs: DataFrame, shards: int) -> DataFrame:
    """``doc_id, size, text_crc32, start, shard, slot`` of every document; slots are gapless within a shard."""
    text = F.col("text").cast("string")
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_read"),
    )
    order = ["doc_id", "_read"]
    placed = offset_in_order(ranged(slim, order), order, start=F.col("size"), _row=F.lit(1).cast("long"))
    total = F.broadcast(slim.agg(F.sum("size").alias("_total")))
    # The shard in whose stretch the document's middle lies, in whole numbers: halves of bytes.
    middle = (2 * F.col("start") + F.col("size")).cast("decimal(38,0)") * shards
    cut = placed.join(total).withColumn("shard", F.expr("0").cast("int") + (middle / (2 * F.col("_total"))).cast("int"))
    firsts = cut.groupBy("shard").agg(F.min("_row").alias("_shard_first"))
    return cut.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "start", "shard", (F.col("_row") - F.col("_shard_first")).alias("slot")
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str) -> None:
    """Writes ``docs`` with their ``shard`` and ``slot`` as one folder per shard, in slot order; ids must be unique."""
    placed = docs.join(assigned.select("doc_id", "shard", "slot"), "doc_id")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_documents(spark: SparkSession, path: str, shard: int) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("shard") == shard)
