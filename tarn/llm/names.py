"""Column names that cannot clash with those of the caller's table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``docs`` is called so (in any case)."""
    have = {c.lower() for c in docs.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def col(name: str) -> Column:
    """A column of just this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns_of(docs: DataFrame) -> list[Column]:
    return [col(c) for c in docs.columns]


def at(docs: DataFrame, name: str) -> int:
    """The place of a column, whose name may differ in case."""
    return [c.lower() for c in docs.columns].index(name.lower())


def map_rows(docs: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], name: str, kind: str) -> DataFrame:
    """``docs`` with a last column that ``run`` adds to its batches; there, columns are known by their places."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, f"{kinds}, added {kind}").toDF(*docs.columns, name)
