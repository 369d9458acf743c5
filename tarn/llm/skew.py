"""Joins with keys that hold a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of more than 1 / SHARE of the rows is split.  At most SHARE keys are, which bounds what is broadcast.
SHARE = 512


def dealt_join(rows: DataFrame, keyed: DataFrame, on: list[str], n: str, spread: list[str], total: int, how: str = "inner") -> DataFrame:
    """Join of ``rows`` with ``keyed``, which has one row per key and in ``n`` how many of the ``total`` rows have it.

    A key of more than ``total / SHARE`` rows is dealt into cells by the hash of
    the columns ``spread``; its row of ``keyed`` is repeated for each cell.  Rows
    with a null key match nothing and are spread as well.
    """
    limit = max(1, total // SHARE)
    keyed = keyed.withColumn("_cells", F.ceil(F.col(n) / limit).cast("int"))
    hot = keyed.where("_cells > 1").select(*on, F.col("_cells").alias("_among"))
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in on])
    among = F.when(null, F.lit(SHARE)).otherwise(F.coalesce("_among", F.lit(1)))
    cell = F.pmod(F.xxhash64(*spread), among).cast("int")
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("_cell", cell).drop("_among")
    keyed = keyed.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1))).drop("_cells")
    return dealt.join(keyed, [*on, "_cell"], how).drop("_cell")
