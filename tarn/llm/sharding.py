"""Contiguous shards of nearly equal bytes, by global prefix sums.

Rows are dealt by ranges of the order column; the totals of these partitions,
summed up, give each partition's place in the whole, and a running sum within
the partition gives each row's.  The whole is cut at equal targets.  No window
spans more than one range partition, and only one number per partition (and per
shard) is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .names import free_name


def byte_shards(rows: DataFrame, shards: int, order: str, size: str = "size", partitions: int | None = None) -> DataFrame:
    """``rows`` with ``shard`` (0 .. shards - 1) and ``slot`` (gapless from 0 in each shard).

    A row belongs to the shard in which its middle byte lies, so a shard's bytes
    miss the target by one row's size at most, and shards are contiguous in
    ``order``.  Ties in ``order`` are broken by size and then by the rows' places
    in the input; a null order comes first.  Sizes must be positive; null counts
    as 0.  With fewer rows than shards some shards stay empty, an empty table
    gives an empty result.  The new columns are the last two; where ``rows`` has
    such columns, they have underscores before their names.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    spark = rows.sparkSession
    names = [free_name(rows, "shard"), free_name(rows, "slot")]
    given = rows.columns
    rows = rows.toDF(*[f"c{i}" for i in range(len(given))])
    lower = [c.lower() for c in given]
    order, size = (f"c{lower.index(c.lower())}" for c in (order, size))
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = rows.withColumn("_shard_size", F.coalesce(F.col(size), F.lit(0)).cast("long")).withColumn("_shard_tie", F.monotonically_increasing_id())
    keys = [F.col(order).asc_nulls_first(), F.col("_shard_size").asc(), F.col("_shard_tie").asc()]
    ranged = sized.repartitionByRange(partitions, *keys).withColumn("_shard_part", F.spark_partition_id())
    ranged = written(ranged, "ranged")

    # one row for each partition
    totals = ranged.groupBy("_shard_part").agg(F.sum("_shard_size").alias("b"), F.count("*").alias("n"))
    before = Window.orderBy("_shard_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = totals.select(
        "_shard_part",
        F.coalesce(F.sum("b").over(before), zero).alias("_shard_b0"),
        F.coalesce(F.sum("n").over(before), zero).alias("_shard_n0"),
        F.sum("b").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_shard_all"),
    )
    within = Window.partitionBy("_shard_part").orderBy(*keys)
    placed = (
        ranged.withColumn("_shard_sum", F.sum("_shard_size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_shard_row", F.row_number().over(within))
        .join(F.broadcast(totals), "_shard_part")
    )
    # twice the middle byte, so that all stays in integers
    middle = 2 * (F.col("_shard_b0") + F.col("_shard_sum")) - F.col("_shard_size")
    shard = F.expr(f"cast(_shard_middle * {shards} div greatest(2 * _shard_all, 1) as int)")
    placed = placed.withColumn("_shard_middle", middle.cast("decimal(38,0)")).withColumn("shard", F.least(shard, F.lit(shards - 1)))
    placed = placed.withColumn("_shard_at", F.col("_shard_n0") + F.col("_shard_row") - 1)
    first = placed.groupBy("shard").agg(F.min("_shard_at").alias("_shard_first"))
    out = placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("_shard_at") - F.col("_shard_first"))
    return out.select(*rows.columns, "shard", "slot").toDF(*given, *names)


def document_sizes(docs: DataFrame, overhead: int = 16) -> DataFrame:
    """doc_id, size (bytes of the text in UTF-8 and ``overhead``), text_crc32 (0 for null, as for empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
