"""Lexicographic direct access through layers of counts and prefix sums."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.hypergraph import classify, complete_order
from ..plans.jointree import layers
from ..plans.spec import CQ, NotTractable
from .reduction import reduce_query, reduced_edges
from ..sources.scratch import written
from .relations import BIG, HOT_ROWS, M, W, c, hot_buckets, prefix_sums, same_join, spread_for, times

#: The ranks of a layer without a prefix, and of a hot bucket, are dealt into cells, so that ranks meet few rows in an
#: equi-join: so many cells at least, and one for so many rows.
CELLS, CELL_ROWS = 1024, 64


def _beside(df: DataFrame, wide: DataFrame, on: Sequence[str]) -> DataFrame:
    """``df`` with the total and cell width of its rows' buckets: one row for all, or null for those not in ``wide``."""
    if not on:
        return df.crossJoin(F.broadcast(wide))
    wide = wide.withColumnsRenamed({v: f"__h{i}" for i, v in enumerate(on)})
    same = reduce(lambda a, b: a & b, [c(v).eqNullSafe(F.col(f"__h{i}")) for i, v in enumerate(on)])
    return df.join(wide, same, "left").drop(*[f"__h{i}" for i in range(len(on))])


class LayeredIndex:
    """Answers of a query in lexicographic order, by rank.

    Building costs one aggregate and one window per variable and never joins the
    relations; buckets of more than ``hot_rows`` rows are split among tasks.  A batch of ranks costs one join per variable, whatever its size.
    ``big`` counts in decimal(38,0) where there may be 2**63 answers.  The order
    actually used, completed to all free variables, is ``order``.
    """

    def __init__(self, cq: CQ, tables: Mapping[str, DataFrame], semantics: str = "set", big: bool = False, persist: bool = False, hot_rows: int = HOT_ROWS) -> None:
        self.classification = classify(cq)
        if not self.classification.direct_access:
            raise NotTractable(f"no direct access: {self.classification}")
        if "k" in cq.free:
            raise ValueError("k names the rank; rename the variable")
        edges = reduced_edges(cq)
        self.cq, self.semantics, self.kind = cq, semantics, BIG if big else "long"
        self.order = complete_order(edges, cq)
        parts = reduce_query(cq, tables, semantics, big)
        self.layers = layers([frozenset(p.variables) for p in parts], self.order)
        self.tables: list[DataFrame] = [None] * len(self.layers)
        self.plain: list[DataFrame] = [None] * len(self.layers)  # the layers without prefix sums
        self.hot: list[DataFrame | None] = [None] * len(self.layers)
        for i in reversed(range(len(self.layers))):
            layer = self.layers[i]
            own = (*layer.prefix, layer.variable)
            if layer.edge in layer.ends:
                rows = parts[layer.edge].df
            else:
                rows = parts[layer.edge].df.select(*map(c, own)).distinct().withColumn(M, F.lit(1).cast(self.kind))
            for n in layer.ends:
                if n != layer.edge:
                    rows = times(rows, parts[n].df, list(parts[n].variables), M, M, big)
            rows = rows.withColumn(W, c(M))
            for j, child in enumerate(self.layers):
                if child.parent == i:
                    rows = times(rows, self.tables[j], list(child.prefix), W, W, big)
            # what a row multiplies into the factor: its multiplicity and the weights of the buckets that it opens
            rows = rows.select(*map(c, own), W)
            if layer.prefix:
                rows = written(rows, "layer")
                self.hot[i] = hot_buckets(rows, layer.prefix, hot_rows)
            self.plain[i] = rows
            rows = prefix_sums(rows, layer.prefix, [(layer.variable, layer.direction)], hot=self.hot[i])
            self.tables[i] = rows.persist(StorageLevel.MEMORY_AND_DISK) if persist else rows

    def unpersist(self) -> None:
        for t in self.tables:
            t.unpersist()

    def totals(self) -> DataFrame:
        """One row: the number of answers, ``n``."""
        out = None
        for layer, t in zip(self.layers, self.tables):
            if layer.parent is None:
                one = t.agg(F.coalesce(F.sum(W), F.lit(0)).cast(self.kind).alias("__t"))
                out = one.select(F.col("__t").alias("n")) if out is None else out.crossJoin(F.broadcast(one)).select((F.col("n") * F.col("__t")).cast(self.kind).alias("n"))
        return out

    def count(self) -> int:
        """The number of answers; the join is not made."""
        return int(self.totals().first()[0])

    def access_many(self, ranks: DataFrame | Iterable[int]) -> DataFrame:
        """k and the free variables, for every different rank ``k`` (from 0) that has an answer.

        ``ranks`` is a table with a column k, or numbers.  Ranks out of range, and
        null, give no row.
        """
        spark = self.tables[0].sparkSession
        if not isinstance(ranks, DataFrame):
            ranks = spark.createDataFrame([(int(k),) for k in ranks], "k long")
        kind = self.kind
        state = ranks.select(F.col("k").cast(kind).alias("k")).where("k >= 0").distinct()
        # __r: residual rank.  __f: product of the weights of open buckets and of multiplicities.
        state = state.crossJoin(F.broadcast(self.totals())).where("k < n").select("k", F.col("k").alias("__r"), F.col("n").alias("__f"))
        div = (lambda x, y: f"cast(({x} - {x} % {y}) / {y} as {BIG})") if kind == BIG else (lambda x, y: f"({x} div {y})")
        for layer, table, hot in zip(self.layers, self.tables, self.hot):
            row = [F.col(x).cast(kind).alias(x) for x in ("__start", "__end", "__bucket")]
            table = table.select(*map(c, (*layer.prefix, layer.variable)), c(W).cast(kind).alias("__rw"), *row)
            if layer.prefix and hot is None:
                state = same_join(state, table, layer.prefix)
            else:
                # deal the bucket's ranks into cells of equal width; all other buckets are one cell each
                wide = table.agg(F.max("__end").alias("__total"), F.count("*").alias("__n")) if hot is None else hot
                cells = F.greatest(F.lit(CELLS), F.expr(f"__n div {CELL_ROWS}")).cast(kind)
                wide = wide.withColumn("__total", F.col("__total").cast(kind)).withColumn("__n", cells)
                wide = wide.withColumn("__width", F.expr(f"cast({div('__total', '__n')} + 1 as {kind})")).drop("__n")
                table, state = _beside(table, wide, layer.prefix), _beside(state, wide, layer.prefix)
                cell = lambda x: f"coalesce(cast({div(x, '__width')} as bigint), -1)"
                table = table.withColumn("__cell", F.explode(F.expr(f"sequence({cell('__start')}, {cell('(__end - 1)')})"))).drop("__total", "__width")
                state = state.withColumn("__i", F.expr(div("__r", div("__f", "__total"))))
                state = same_join(state.withColumn("__cell", F.expr(cell("__i"))).drop("__total", "__width", "__i"), table, [*layer.prefix, "__cell"]).drop("__cell")
            state = state.withColumn("__f", F.expr(div("__f", "__bucket"))).withColumn("__i", F.expr(div("__r", "__f")))
            state = state.where("__i >= __start and __i < __end")
            # the row's weight stands for its multiplicity and the buckets it opens
            state = state.withColumn("__r", F.expr(f"cast(__r - __start * __f as {kind})")).withColumn("__f", F.expr(f"cast(__f * __rw as {kind})"))
            state = state.drop("__start", "__end", "__bucket", "__rw", "__i")
        return state.select("k", *map(c, self.cq.free))

    def answers(self) -> DataFrame:
        """k and the free variables of every answer: what ``access_many`` gives for all ranks.

        From layer to layer each open bucket's rows are joined and their prefix
        sums added up, so no rank is looked up and the answers are not sorted.
        """
        kind = self.kind
        div = (lambda x, y: f"cast(({x} - {x} % {y}) / {y} as {BIG})") if kind == BIG else (lambda x, y: f"({x} div {y})")
        state = self.totals().select(F.lit(0).cast(kind).alias("k"), F.col("n").alias("__f")).where("n > 0")
        for layer, table, plain in zip(self.layers, self.tables, self.plain):
            row = [F.col(x).cast(kind).alias(x) for x in ("__start", "__bucket")]
            table = table.select(*map(c, (*layer.prefix, layer.variable)), c(W).cast(kind).alias("__rw"), *row)
            if layer.prefix:
                state = same_join(*spread_for(state, table, plain), layer.prefix)
            elif layer is self.layers[0]:  # the state is one row
                state = table.crossJoin(F.broadcast(state))
            else:
                left, right = spread_for(state, table, plain)
                state = left.crossJoin(right)
            state = state.withColumn("__f", F.expr(div("__f", "__bucket")))
            state = state.withColumn("k", F.expr(f"cast(k + __start * __f as {kind})")).withColumn("__f", F.expr(f"cast(__f * __rw as {kind})"))
            state = state.drop("__start", "__bucket", "__rw")
        if self.semantics == "bag":  # what is left is how often the answer occurs
            again = F.explode(F.expr("sequence(0L, cast(__f as bigint) - 1)"))
            state = state.withColumn("__i", again).withColumn("k", F.expr(f"cast(k + __i as {kind})"))
        return state.select("k", *map(c, self.cq.free))

    def access(self, k: int) -> dict[str, object]:
        """The answer of rank k; IndexError if there is none."""
        got = self.access_many([k]).first()
        if got is None:
            raise IndexError(f"no answer of rank {k}")
        return {v: got[v] for v in self.cq.free}

    def top(self, n: int) -> DataFrame:
        """The first n answers with their ranks; ranks are generated on the executors."""
        return self.access_many(self.tables[0].sparkSession.range(n).withColumnRenamed("id", "k"))

    def explain(self) -> str:
        return "\n".join(f"{i}: {layer.variable}{'+' if layer.direction > 0 else '-'} within ({', '.join(layer.prefix)})" for i, layer in enumerate(self.layers))
