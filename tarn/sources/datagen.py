"""Synthetic relations: different tuples with independently drawn columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def domain_size(n: int, domain: str = "large") -> int:
    """``large``: as many values as rows.  ``small``: their square root, rounded down after adding 1."""
    if domain not in ("large", "small"):
        raise ValueError("domain is large or small")
    return max(1, n if domain == "large" else int(math.sqrt(n) + 1))


def _draw(kind: str, param: float | None, size: int, seed: int) -> Column:
    if kind == "uniform":
        return F.floor(F.rand(seed) * size).cast("long")
    if kind == "normal":  # centred, sigma = size / param
        return F.floor(F.randn(seed) * (size / (param or 6.0)) + size / 2).cast("long")
    if kind == "zipf":
        # inverse of the cumulated power law x ** -param on [1, size]
        a = 1.0 if param is None else float(param)
        u = F.rand(seed)
        x = F.exp(u * math.log(size + 1)) if abs(a - 1) < 1e-9 else F.pow(1 + u * ((size + 1.0) ** (1 - a) - 1), F.lit(1 / (1 - a)))
        return (F.floor(x) - 1).cast("long")
    raise ValueError(f"no distribution {kind}")


def generate(spark: SparkSession, columns: Sequence[str], n: int, domain: str = "large", distribution: str = "uniform", param: float | None = None, seed: int = 42, rounds: int = 8) -> DataFrame:
    """``n`` different tuples of integers in [0, size).

    Draws outside the domain are dropped.  Each round draws twice what is still
    wanted; if after ``rounds`` the domain has not given n tuples, as when it
    has fewer, an error is raised.
    """
    size = domain_size(n, domain)
    if size ** len(columns) < n:
        raise ValueError("the domain has fewer tuples than wanted")
    drawn = None
    for r in range(rounds):
        more = spark.range(0, n * 2, numPartitions=max(1, min(200, n // 50_000 + 1))).select(*[_draw(distribution, param, size, seed * 1009 + r * 101 + i).alias(c) for i, c in enumerate(columns)])
        for c in columns:
            more = more.where((F.col(f"`{c}`") >= 0) & (F.col(f"`{c}`") < size))
        drawn = more.distinct() if drawn is None else drawn.unionByName(more).distinct()
        if drawn.count() >= n:
            # a fixed choice among the drawn, in an order unrelated to their values
            place = F.xxhash64(*[F.col(f"`{c}`") for c in columns], F.lit(seed))
            return drawn.orderBy(place, *[F.col(f"`{c}`") for c in columns]).limit(n)
    raise ValueError(f"{n} different tuples were not reached")


