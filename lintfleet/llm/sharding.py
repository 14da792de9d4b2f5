"""Balanced shards: global byte prefix sums from per-partition totals, cut at equal targets.

Documents are put in one global order by range partitions. Each partition's total goes into a small table with one row
per partition, whose running sum says how many bytes lie before the partition; a running sum inside it does the rest.
A document goes to the shard in whose equal share of all bytes its middle byte falls, so shards are contiguous in the
order and differ by no more than the size of one document. The order is (hash of the text, id): equal texts are
neighbours and share a shard unless a cut falls between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintfleet.session import materialize


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size (UTF-8 bytes + 1), text_crc32, shard, slot (place in its shard, from 0).

    A null text has no bytes. Null ids and repeated rows are rows like any other, with places of their own. An empty
    table gives an empty result; with fewer rows than shards some shards are empty. Other columns are not read.
    Only ids, sizes and hashes are shuffled, never texts.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.md5(text.cast("binary")).alias("_order"),
        F.monotonically_increasing_id().alias("_row"),  # parts a third of all rows even where id and text repeat
    )
    order = ["_order", "doc_id", "_row"]
    # written, so that partition numbers and row numbers stay what they are if a task is run again
    rows = materialize(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "shards")

    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    totals = rows.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    totals = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_all"),
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.select(
        "*", F.sum("size").over(inside).alias("_bytes_to"), F.row_number().over(inside).cast("long").alias("_rank")
    ).join(F.broadcast(totals), "_part")
    # the doubled middle of a document's bytes against the doubled total: whole numbers only
    middle = 2 * (F.col("_bytes_before") + F.col("_bytes_to")) - F.col("size")
    placed = placed.select(
        "doc_id", "size", "text_crc32", (F.col("_rows_before") + F.col("_rank") - 1).alias("_rank"),
        F.least(F.floor(middle * shards / (2 * F.col("_all"))), F.lit(shards - 1)).cast("int").alias("shard"),
    )
    first = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).alias("slot")
    )
