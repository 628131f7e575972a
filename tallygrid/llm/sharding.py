"""Contiguous shards of equal bytes, from per-partition totals and global prefix sums.

The rows are put in one global order, cut into range partitions; each
partition's total of bytes and rows is summed first, a running sum over those
few totals says what lies before each partition, and a window inside the
partition says what lies before each row.  A row goes to the shard in whose
equal share of all bytes its middle byte falls.  Only DataFrame functions are
used, and nothing but the partition totals is ever gathered.

The order is by the MD5 of the text, then ``doc_id``: equal texts are
neighbours and mostly share a shard, and shards are mixed in topic.  Range
partitioning on both columns cuts even a group of copies that holds a third of
all rows.

Defined results: a null text has no bytes; a null ``doc_id`` sorts first;
repeated rows are separate rows, whose order among themselves doesn't matter; a
text longer than a shard's share fills several shards' worth alone; an empty table gives no rows; with fewer rows
than shards some shards are empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

N_SHARDS = 40
ROW_OVERHEAD = 16


def byte_shards(df: DataFrame, size: str, order: list[str], n_shards: int) -> DataFrame:
    """Adds shard and slot (gapless from 0 in each shard, in the order given) to narrow rows with a positive ``size``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Range bounds come from a sample, so the dealt rows are fixed by a checkpoint before they are counted and numbered.
    dealt = checkpointed(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_part").agg(F.sum(size).alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    whole = Window.partitionBy(F.lit(0))
    totals = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(whole).alias("_all"),
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.join(totals, "_part").select(
        *df.columns,
        (F.col("_bytes_before") + F.sum(size).over(inside) - F.col(size)).alias("_start"),
        (F.col("_rows_before") + F.row_number().over(inside) - 1).alias("_index"),
        "_all",
    )
    middle = F.col("_start").cast("decimal(38,0)") * 2 + F.col(size)
    shard = F.floor(middle * n_shards / (F.col("_all").cast("decimal(38,0)") * 2))
    placed = placed.withColumn("shard", F.least(shard, F.lit(n_shards - 1)).cast("int")).drop("_all", "_start")
    firsts = placed.groupBy("shard").agg(F.min("_index").alias("_first"))  # as many rows as shards
    return placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("_index") - F.col("_first")).drop("_index", "_first")


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("_digest"),
    )
    out = byte_shards(narrow, "size", ["_digest", "doc_id"], n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
