"""Contiguous shards of near-equal byte size from global prefix sums.

Rows are put in order of ``doc_id`` (nulls first), then size, then text CRC. The order is cut into
range partitions; each partition's row count and bytes are summed, and a running sum over those few
totals gives every partition its global offset. Rows add their running sum within the partition.
Only (doc_id, size, crc) moves: texts never leave the scan. As a last tie-breaker, the row's
place in the input lets range partitioning split runs of equal rows.

Edge cases: a null text has no bytes (size 1, CRC 0); an empty table gives no rows; repeated rows
each get a slot of their own; further input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumine.llm.scratch import staged

#: Range partitions a shuffle partition is divided into, so that hashing them again stays even.
BLOCKS_PER_PARTITION = 4


def sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )


def byte_shards(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, start, shard, slot) for every row of ``docs``.

    ``start`` is the exclusive prefix sum of sizes. A row belongs to the shard its middle byte falls
    in, so a shard misses its equal target by half a row at either end at most. ``slot`` counts
    0, 1, 2, ... within a shard in the global order.
    """
    spark = docs.sparkSession
    n = BLOCKS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "size", "text_crc32", "place"]
    rows = staged(
        sized(docs)
        .withColumn("place", F.monotonically_increasing_id())
        .repartitionByRange(n, *order)
        .withColumn("block", F.spark_partition_id()),
        "shard-rows",
    )
    # one row a block: at most n rows meet in the single window below
    totals = rows.groupBy("block").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "block",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("total"),
    )
    here = Window.partitionBy("block").orderBy(*order)
    placed = rows.join(F.broadcast(offsets), "block").select(
        "doc_id",
        "size",
        "text_crc32",
        "total",
        (F.col("bytes_before") + F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"),
        (F.col("rows_before") + F.row_number().over(here) - 1).alias("place"),
    )
    cut = staged(placed.withColumn("shard", F.expr(f"int(({n_shards} * (2 * start + size)) div (2 * total))")), "shard-cuts")
    firsts = cut.groupBy("shard").agg(F.min("place").alias("first"))  # n_shards rows
    return cut.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "start", "shard", (F.col("place") - F.col("first")).alias("slot")
    )
