"""Materialise, sort and skip: the plain way, and the fallback for intractable queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.hypergraph import classify
from ..plans.spec import CQ
from .access import LayeredIndex
from .relations import block_join, c, instances, lex_columns, prefix_sums, spread_for, sum_scale, weighted_sum


def answers(cq: CQ, tables: Mapping[str, DataFrame], semantics: str = "set", blocks: bool = False) -> DataFrame:
    """All answers.  Atoms are joined in the given order, connected ones first.

    Answers over all variables differ as soon as each relation's rows do, so then
    the relations are made distinct and not the join.  With ``blocks``, for answers
    that are to be stored, the last join is made in blocks (:func:`block_join`).
    """
    parts = instances(cq, tables)
    if semantics == "set" and cq.full:
        parts = [df.distinct() for df in parts]
    rest = list(zip(cq.atoms, parts))
    first, out = rest.pop(0)
    have = set(first.variables)
    while rest:
        at = next((i for i, (a, _) in enumerate(rest) if have & set(a.variables)), 0)
        a, df = rest.pop(at)
        on = [v for v in dict.fromkeys(a.variables) if v in have]
        if blocks and on and not rest:
            out = block_join(out, df, on)
            break
        out, df = spread_for(out, df)
        out = out.join(df, on) if on else out.crossJoin(df)
        have |= set(a.variables)
    out = out.select(*map(c, cq.free))
    return out.distinct() if semantics == "set" and not cq.full else out


def full_order(cq: CQ, order: Sequence[tuple[str, int]] | None = None) -> list[tuple[str, int]]:
    """The order, then the other free variables by name."""
    order = list(order or cq.lex)
    have = {v for v, _ in order}
    return order + [(v, 1) for v in sorted(set(cq.free) - have)]


def _ordered(cq: CQ, tables: Mapping[str, DataFrame], semantics: str, order: Sequence[tuple[str, int]] | None) -> tuple[DataFrame, list[tuple[str, int]]]:
    """All answers, and their order; a sum to order by is in ``__v``."""
    rows, order = answers(cq, tables, semantics), full_order(cq, order)
    if not cq.sums:
        return rows, order
    scale = sum_scale({f.name: f.dataType for f in rows.schema}, cq.sums)
    return rows.withColumn("__v", weighted_sum(cq.sums, scale)), [("__v", 1), *order]


def ranked(cq: CQ, tables: Mapping[str, DataFrame], semantics: str = "set", order: Sequence[tuple[str, int]] | None = None) -> DataFrame:
    """All answers with their rank ``k``.

    Where the order can be indexed, ranks are added up from the layers' prefix
    sums and nothing is sorted after the join.  Otherwise answers are dealt by
    ranges of the order, so no task sees all of them.
    """
    whole = replace(cq, lex=tuple(full_order(cq, order)))
    if not cq.sums and "k" not in cq.free and classify(whole).direct_access:
        return LayeredIndex(whole, tables, semantics).answers().select(*map(c, cq.free), F.col("k").cast("long").alias("k"))
    rows, order = _ordered(cq, tables, semantics, order)
    placed = prefix_sums(rows.withColumn("__one", F.lit(1).cast("long")), [], order, "__one")
    return placed.select(*map(c, cq.free), F.col("__start").cast("long").alias("k"))


def kth(cq: CQ, tables: Mapping[str, DataFrame], k: int, semantics: str = "set", order: Sequence[tuple[str, int]] | None = None) -> DataFrame:
    """The answer of rank k, or no row."""
    rows, order = _ordered(cq, tables, semantics, order)
    return rows.orderBy(*lex_columns(order)).offset(k).limit(1).select(*map(c, cq.free))
