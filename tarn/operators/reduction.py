"""Elimination of existential variables and of contained atoms."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.hypergraph import connex
from ..plans.jointree import join_tree
from ..plans.spec import CQ, NotTractable
from .relations import BIG, M, c, instances, project_count, project_distinct, semi_join, times


@dataclass
class Part:
    """A relation over free variables, with the multiplicity of each tuple."""

    variables: tuple[str, ...]
    df: DataFrame


def _combine(target: DataFrame, source: DataFrame, on: list[str], bag: bool, big: bool) -> DataFrame:
    return times(target, source, on, M, M, big) if bag else semi_join(target, source, on)


def _fold(parts: list[Part], bag: bool, big: bool) -> list[Part]:
    """Every part whose variables lie within another's is folded into it."""
    out: list[Part] = []
    for p in sorted(parts, key=lambda p: -len(set(p.variables))):
        host = next((q for q in out if set(p.variables) <= set(q.variables)), None)
        if host is None:
            out.append(p)
        else:
            host.df = _combine(host.df, p.df, list(p.variables), bag, big)
    return out


def reduce_query(cq: CQ, tables: Mapping[str, DataFrame], semantics: str = "set", big: bool = False) -> list[Part]:
    """An equivalent full acyclic query over the free variables.

    ``semantics``: "set" counts each different answer once; "bag" counts it as
    often as the join with its duplicates makes it.  Each atom is first reduced
    to different tuples with multiplicities.  Along a join tree rooted at the
    free variables every atom is then reduced by those below it; what hangs
    directly below the root is projected to free variables.  Parts without free
    variables become an existence test (set) or a factor (bag).
    """
    if semantics not in ("set", "bag"):
        raise ValueError("semantics must be set or bag")
    if not connex(cq.edges, cq.free):
        raise NotTractable("the query is not free-connex")
    bag = semantics == "bag"
    parts = []
    for a, df in zip(cq.atoms, instances(cq, tables)):
        variables = tuple(dict.fromkeys(a.variables))
        counted = project_count(df, variables) if bag else project_distinct(df, variables).withColumn(M, F.lit(1).cast("long"))
        parts.append(Part(variables, counted.withColumn(M, c(M).cast(BIG if big else "long"))))
    parts = _fold(parts, bag, big)
    if not cq.full:
        parts = _project(parts, frozenset(cq.free), bag, big)
    return parts


def _project(parts: list[Part], free: frozenset[str], bag: bool, big: bool) -> list[Part]:
    edges = [frozenset(p.variables) for p in parts]
    root = len(edges)
    tree = join_tree([*edges, free], root)
    if tree is None:
        raise NotTractable("the query is not free-connex")
    out: list[Part] = []
    scalars: list[DataFrame] = []
    for n in tree.order[:-1]:
        above = tree.parent[n]
        if above != root:
            on = [v for v in parts[n].variables if v in edges[above]]
            parts[above].df = _combine(parts[above].df, parts[n].df, on, bag, big)
            continue
        kept = tuple(v for v in parts[n].variables if v in free)
        if kept:
            df = project_count(parts[n].df, kept, M, M) if bag else project_distinct(parts[n].df, kept).withColumn(M, F.lit(1).cast(BIG if big else "long"))
            out.append(Part(kept, df))
        else:
            scalars.append(parts[n].df)
    for s in scalars:
        out[0].df = _combine(out[0].df, s, [], bag, big)
    return _fold(out, bag, big)


def reduced_edges(cq: CQ) -> list[frozenset[str]]:
    """The hyperedges over free variables that ``reduce_query`` leaves, without touching data."""
    edges: list[frozenset[str]] = []
    for e in sorted(cq.edges, key=len, reverse=True):
        if not any(e <= f for f in edges):
            edges.append(e)
    if not cq.full:
        tree = join_tree([*edges, frozenset(cq.free)], len(edges))
        if tree is None:
            raise NotTractable("the query is not free-connex")
        projected = [edges[n] & set(cq.free) for n in tree.order[:-1] if tree.parent[n] == len(edges)]
        edges = []
        for e in sorted(projected, key=len, reverse=True):
            if e and not any(e <= f for f in edges):
                edges.append(e)
    return edges
