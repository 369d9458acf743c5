"""Lexicographic selection: single answers by rank, also in orders with disruptive trios."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.medians import histogram
from ..plans.hypergraph import classify
from ..plans.jointree import Tree, join_tree
from ..plans.spec import CQ, NotTractable
from .baseline import full_order
from .reduction import Part, reduce_query
from .relations import M, W, c, prefix_sums, times


def counted(parts: list[Part], tree: Tree, big: bool = False) -> DataFrame:
    """The root's tuples with the number of answers each is part of, ``__w``; counts travel up the tree."""
    tables = {n: parts[n].df.withColumn(W, c(M)) for n in tree.order}
    for n in tree.order[:-1]:
        above = tree.parent[n]
        on = [v for v in parts[n].variables if v in parts[above].variables]
        tables[above] = times(tables[above], tables[n], on, W, W, big)
    return tables[tree.root]


class Selection:
    """The k-th answer, one aggregate job per variable; input is never joined or changed.

    Unordered free variables are ordered by name after the others.
    """

    def __init__(self, cq: CQ, tables: Mapping[str, DataFrame], semantics: str = "set", big: bool = False, persist: bool = False) -> None:
        if not classify(cq).selection:
            raise NotTractable("the query is not free-connex")
        self.cq, self.big = cq, big
        self.order = full_order(cq)
        self.parts = reduce_query(cq, tables, semantics, big)
        if persist:
            for p in self.parts:
                p.df = p.df.persist(StorageLevel.MEMORY_AND_DISK)
        self.tree = join_tree([frozenset(p.variables) for p in self.parts])

    def _root(self, variable: str) -> Tree:
        return self.tree.rerooted(min(i for i, p in enumerate(self.parts) if variable in p.variables))

    def count_per_value(self, variable: str) -> DataFrame:
        """Answers per value of a free variable: ``value``, ``n``."""
        return counted(self.parts, self._root(variable), self.big).groupBy(c(variable).alias("value")).agg(F.sum(W).alias("n"))

    def select_k(self, k: int) -> dict[str, object]:
        """The answer of rank k; IndexError if there is none."""
        found = self.select_many([k])
        if not found:
            raise IndexError(f"no answer of rank {k}")
        return found[k]

    def select_many(self, ks: Iterable[int]) -> dict[int, dict[str, object]]:
        """The answers of several ranks; none for those out of range.  Ranks that agree on values share their jobs."""
        wanted = [(k, k) for k in dict.fromkeys(ks) if k >= 0]
        return dict(self._descend(self.parts, {}, wanted)) if wanted else {}

    def _descend(self, parts: list[Part], found: dict[str, object], ks: list[tuple[int, int]]) -> Iterator[tuple[int, dict[str, object]]]:
        """Answers of the ranks ``ks``, each with its rank among those that have the values ``found``."""
        rest = [(v, d) for v, d in self.order if v not in found]
        if not rest:
            yield from ((k, {v: found[v] for v in self.cq.free}) for k, _ in ks)
            return
        v, d = rest[0]
        root = counted(parts, self._root(v), self.big)
        sums = prefix_sums(histogram(root.select(c(v), W), v, W), [], [(v, d)], "weight")
        among = sums.sparkSession.createDataFrame([(r,) for _, r in ks], "__r long")
        got = sums.join(F.broadcast(among), (F.col("__start") <= F.col("__r")) & (F.col("__end") > F.col("__r")), "left_semi")
        for row in got.select(c(v).alias("value"), "__start", "__end").collect():
            own = [(k, r - int(row["__start"])) for k, r in ks if row["__start"] <= r < row["__end"]]
            here = [Part(p.variables, p.df.where(c(v).eqNullSafe(F.lit(row.value))) if v in p.variables else p.df) for p in parts]
            yield from self._descend(here, {**found, v: row.value}, own)
