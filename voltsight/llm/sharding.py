"""Contiguous byte-balanced shards from global prefix sums.

Rows are range-partitioned by id; each partition's total of bytes and rows is
aggregated, a prefix sum over these few totals gives each partition its global
offset, and an in-partition running sum completes the global prefix of every
row.  A row goes to the shard that holds the middle of its byte range when the
whole range is cut at equal targets, so no shard is off its target by more than
one document.  Rows that repeat an id are spread by their position, so a hot id
doesn't have to fit in one partition.  The law is ``bytes``: shards are
contiguous in id order, equal texts are not held together.

Defined results: a null text counts 1 byte (the separator) and has a null
checksum; null ids come first; repeated rows are dealt out one after another;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialised

SHARDS = 16


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32``: UTF-8 bytes plus one, unsigned checksum."""
    return docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1).alias("size"),
                       F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def balanced_shards(docs: DataFrame, shards: int = SHARDS, partitions: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, start`` (``start``: bytes of all
    earlier rows, ``slot``: row number in the shard from 0)."""
    order = ["doc_id", "text_crc32", "size", "seq"]
    rows = sizes(docs).withColumn("seq", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    slim = materialised(ranged.withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = slim.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    offsets = totals.select("part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("byte0"),
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row0"),
                            F.sum("b").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("part").orderBy(*order)
    prefix = slim.withColumns({"sofar": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
                               "nth": F.row_number().over(inside)})
    # one row of offsets per partition: as many rows as there are tasks
    placed = prefix.join(F.broadcast(offsets), "part").select(
        "doc_id", "size", "text_crc32", (F.col("byte0") + F.col("sofar") - F.col("size")).alias("start"),
        (F.col("row0") + F.col("nth") - 1).alias("row"), "total")
    shard = F.expr(f"CAST(((2 * start + size) * {shards}) DIV (2 * total) AS INT)")
    placed = placed.withColumn("shard", F.least(shard, F.lit(shards - 1)))
    first = placed.groupBy("shard").agg(F.min("row").alias("row0"))
    # at most `shards` rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("row0")).alias("slot"), "start")
