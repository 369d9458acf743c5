"""Weighted order statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relations import HOT_ROWS, c, hot_buckets, prefix_sums, project_count
from ..sources.scratch import written


def histogram(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """Total weight of each different value."""
    return project_count(df, [value], weight, "weight")


def weighted_quickselect(df: DataFrame, value: str, weight: str, k: int, descending: bool = False) -> DataFrame:
    """The value at rank k (from 0) when each counts ``weight`` times, and the weight before it; no row if out of range."""
    sums = prefix_sums(histogram(df, value, weight), [], [(value, -1 if descending else 1)], "weight")
    return sums.where((F.col("__start") <= k) & (F.col("__end") > k)).select(c(value), F.col("__start").alias("weight_before"), "weight")


def weighted_median(df: DataFrame, value: str, weight: str, by: Sequence[str] = (), hot_rows: int = HOT_ROWS) -> DataFrame:
    """The value at rank ``total div 2``, of all rows or per group; groups of more than ``hot_rows`` values are split among tasks."""
    grouped, hot = project_count(df, [*by, value], weight, "weight"), None
    if by:
        grouped = written(grouped, "grouped")
        hot = hot_buckets(grouped, by, hot_rows, "weight")
    sums = prefix_sums(grouped, list(by), [(value, 1)], "weight", hot)
    return sums.where("__start <= __bucket div 2 and __end > __bucket div 2").select(*map(c, by), c(value).alias("median"))
