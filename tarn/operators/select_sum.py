"""Selection by a weighted sum of variables on two adjacent atoms.

The sum is split into a part x of one atom and a part y of the other.  How many
answers have x + y < p is counted for a batch of pivots p at once and without a
join: within a join key the values x and p - y are sorted together, and a
running sum of the first atom's weights is read off at the second's rows; a key
of very many values is dealt by ranges to several tasks.  A few rounds of
counting narrow the sums of the wanted ranks down, until an interval holds few
answers or one sum.  Only the answers in it are then joined, by key and band of
the sum, and ordered.  Decimals count as integers of their smallest unit.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from decimal import ROUND_FLOOR, Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.hypergraph import acyclic, sum_pair
from ..plans.jointree import join_tree
from ..plans.spec import CQ, NotTractable
from .baseline import full_order
from ..sources.scratch import written
from .reduction import Part, reduce_query
from .relations import BIG, HOT_ROWS, M, W, c, hot_buckets, prefix_sums, sum_scale, times, weighted_sum

#: Pivots of one counting round.
PIVOTS = 32


class SumSelection:
    """Answers of a full acyclic query by ascending sum; ties are broken by ``lex``, then by the other variables' names.

    Join keys of more than ``hot_rows`` different parts of the sum are split among tasks.
    """

    def __init__(self, cq: CQ, tables: Mapping[str, DataFrame], semantics: str = "set", big: bool = False, hot_rows: int = HOT_ROWS) -> None:
        if not cq.sums:
            raise ValueError("the query has no sum_order")
        if not (cq.full and acyclic(cq.edges)):
            raise NotTractable("selection by sum needs a full acyclic query")
        self.cq, self.big, self.hot_rows = cq, big, hot_rows
        self.parts = reduce_query(cq, tables, semantics, big)
        reduced = CQ.of([(str(i), p.variables) for i, p in enumerate(self.parts)], cq.free, None, dict(cq.sums))
        pair = sum_pair(reduced)
        if pair is None:
            raise NotTractable("the sum's variables lie on more than two adjacent atoms")
        self.scale = sum_scale({f.name: f.dataType for p in self.parts for f in p.df.schema}, cq.sums)
        self.pair = pair
        edges = [frozenset(p.variables) for p in self.parts]
        self.mine = [(v, k) for v, k in cq.sums if v in edges[pair[0]]]
        self.rest = [(v, k) for v, k in cq.sums if v not in edges[pair[0]]]
        self.key = sorted(edges[pair[0]] & edges[pair[1]]) if pair[0] != pair[1] else []
        left, right = self._two_sided(pair)
        kind = BIG if big else "long"
        # the different parts of the sum under each key, once for all rounds
        self.left, self.right = (written(df.groupBy(*map(c, self.key), "__v").agg(F.sum(W).cast(kind).alias(W)), "side") for df in (left, right))

    def _two_sided(self, pair: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
        """Both atoms' key, part of the sum ``__v`` and weight ``__w``; other atoms are folded into the weights."""
        a, b = pair
        edges = [frozenset(p.variables) for p in self.parts]
        tables = [p.df.withColumn(W, c(M)) for p in self.parts]
        if a == b:
            tree = join_tree(edges).rerooted(a)
            for n in tree.order[:-1]:
                on = [v for v in self.parts[n].variables if v in edges[tree.parent[n]]]
                tables[tree.parent[n]] = times(tables[tree.parent[n]], tables[n], on, W, W, self.big)
            one = tables[a].sparkSession.range(1).select(F.lit(0).cast("long").alias("__v"), F.lit(1).cast("long").alias(W))
            return tables[a].select(weighted_sum(self.cq.sums, self.scale).alias("__v"), W), one
        # a tree in which the pair is one node
        merged = [e for i, e in enumerate(edges) if i not in pair] + [edges[a] | edges[b]]
        numbers = [i for i in range(len(edges)) if i not in pair]
        tree = join_tree(merged, len(numbers))
        for n in tree.order[:-1]:
            above = tree.parent[n]
            own = numbers[n]
            if above == len(numbers):
                on = merged[n] & merged[above]
                to = next((i for i in pair if on <= edges[i]), None)
                if to is None:
                    raise NotTractable("an atom hangs on both sides of the sum")
            else:
                to, on = numbers[above], merged[n] & merged[above]
            tables[to] = times(tables[to], tables[own], sorted(on), W, W, self.big)
        return tuple(tables[i].select(*map(c, self.key), weighted_sum(own, self.scale).alias("__v"), W) for i, own in ((a, self.mine), (b, self.rest)))

    @cached_property
    def hot(self) -> DataFrame | None:
        """The hot join keys (without join columns, one row); None if there are none."""
        values = [df.select(*map(c, self.key), "__v") for df in (self.left, self.right)]
        values = values[0].unionByName(values[1]).distinct().withColumn("__one", F.lit(1))
        found = hot_buckets(values, self.key, self.hot_rows, "__one")
        return found if found is None else found.select(*map(c, self.key))

    def _units(self, value: int | Decimal) -> int:
        """A sum in smallest units."""
        return int(Decimal(value).scaleb(self.scale).to_integral_value(ROUND_FLOOR))

    def _value(self, units: Column) -> Column:
        """A sum as it is, of smallest units."""
        return (units.cast("decimal(38,0)") / F.lit(10**self.scale).cast("decimal(38,0)")).cast(f"decimal(38,{self.scale})") if self.scale else units

    def count_below(self, pivots: Sequence[int | Decimal]) -> DataFrame:
        """For every pivot p: the answers of a sum ``lt`` (less than p) and ``le`` (at most p).

        With decimals, pivots beyond the sums' digits are taken down to them.
        """
        found = self._counts([self._units(p) for p in pivots])
        return found.withColumn("pivot", self._value(F.col("pivot")))

    def _counts(self, pivots: Sequence[int]) -> DataFrame:
        spark = self.left.sparkSession
        ps = spark.createDataFrame([(int(p),) for p in dict.fromkeys(pivots)], "__p long")
        zero = F.lit(0).cast(BIG if self.big else "long")
        left = self.left.withColumn("__l", c(W)).withColumn("__s", zero).drop(W)
        right = self.right.withColumn("__s", c(W)).withColumn("__l", zero).drop(W)
        left, right = left.crossJoin(F.broadcast(ps)), right.crossJoin(F.broadcast(ps)).withColumn("__v", F.col("__p") - F.col("__v"))
        rows = left.unionByName(right).groupBy("__p", *map(c, self.key), "__v").agg(F.sum("__l").alias("__l"), F.sum("__s").alias("__s"))
        hot = None
        if self.hot is not None:
            hot, rows = self.hot.crossJoin(F.broadcast(ps)), written(rows, "pivots")
        rows = prefix_sums(rows, ["__p", *self.key], [("__v", 1)], "__l", hot)
        kind = BIG if self.big else "long"
        found = rows.groupBy("__p").agg(F.sum(F.col("__s") * F.col("__start")).cast(kind).alias("lt"), F.sum(F.col("__s") * F.col("__end")).cast(kind).alias("le"))
        return ps.join(found, "__p", "left").select(F.col("__p").alias("pivot"), F.coalesce("lt", zero).alias("lt"), F.coalesce("le", zero).alias("le"))

    def bounds(self) -> tuple[int, int] | None:
        """Bounds of all sums, in smallest units; None if a side is empty."""
        ends = [df.agg(F.min("__v").alias("a"), F.max("__v").alias("b")).first() for df in (self.left, self.right)]
        if any(e.a is None for e in ends):
            return None
        return ends[0].a + ends[1].a, ends[0].b + ends[1].b

    def _between(self, low: int, high: int) -> DataFrame:
        """All different answers with a sum of ``low`` to ``high`` units, their sum ``__v`` and multiplicity.

        The two atoms of the sum are joined by key and by bands of the sum as wide
        as the interval, so that hardly more is joined than is wanted.
        """
        a, b = self.pair
        have = set(self.parts[a].variables)
        out = self.parts[a].df.withColumn("__v", weighted_sum(self.mine, self.scale))
        rest = [p for i, p in enumerate(self.parts) if i not in self.pair]
        kind = BIG if self.big else "long"
        if a != b:
            width = max(1, high - low + 1)
            band = lambda v: F.expr(f"({v} - pmod({v}, {width}L)) div {width}L")
            out = out.withColumn("__u", F.lit(low) - F.col("__v")).withColumn("__t", F.lit(low + width - 1) - F.col("__v"))
            out = out.withColumn("__band", F.explode(F.array_distinct(F.array(band("__u"), band("__t"))))).drop("__u", "__t")
            other = self.parts[b].df.withColumnRenamed(M, "__m2").withColumn("__y", weighted_sum(self.rest, self.scale)).withColumn("__band", band("__y"))
            out = out.join(other, [*self.key, "__band"]).withColumn("__v", F.col("__v") + F.col("__y")).withColumn(M, (c(M) * F.col("__m2")).cast(kind)).drop("__m2", "__y", "__band")
            have |= set(self.parts[b].variables)
        out = out.where((F.col("__v") >= low) & (F.col("__v") <= high))
        while rest:
            p = next((q for q in rest if have & set(q.variables)), rest[0])
            rest.remove(p)
            on = [v for v in p.variables if v in have]
            other = p.df.withColumnRenamed(M, "__m2")
            out = (out.join(other, on) if on else out.crossJoin(other)).withColumn(M, (c(M) * F.col("__m2")).cast(kind)).drop("__m2")
            have |= set(p.variables)
        return out.select(*map(c, self.cq.free), "__v", M)

    def between(self, low: int | Decimal, high: int | Decimal) -> DataFrame:
        """All answers with low <= sum <= high, and their ``sum``; each as often as its multiplicity."""
        return self._copies(self._between(-self._units(-low), self._units(high)))

    def _copies(self, rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("sum", self._value(F.col("__v")))
        return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), c(M).cast("long")))).select(*map(c, self.cq.free), "sum")

    def trim(self, pivot: int | Decimal, below: bool) -> DataFrame:
        """The answers with a sum below (or above) the pivot."""
        low, high = self.bounds() or (0, 0)
        return self._copies(self._between(low, -self._units(-pivot) - 1) if below else self._between(self._units(pivot) + 1, high))

    def select_k(self, k: int, early_stop: int | None = None) -> dict[str, object]:
        """The answer of rank k and its ``sum``; IndexError if there is none."""
        found = self.select_many([k], early_stop)
        if not found:
            raise IndexError(f"no answer of rank {k}")
        return found[k]

    def select_many(self, ks: Iterable[int], early_stop: int | None = None) -> dict[int, dict[str, object]]:
        """The answers of several ranks, each with its ``sum``; none for ranks out of range.

        All ranks share the rounds of counting.  An interval of at most
        ``early_stop`` answers (four times the rows of both sides, unless given) is
        joined as it is; with 0 every interval is narrowed to one sum.
        """
        limits, ks = self.bounds(), [k for k in dict.fromkeys(ks) if k >= 0]
        if limits is None or not ks:
            return {}
        low, high = limits
        total = int(self._counts([high]).first().le)
        enough = 4 * (self.left.count() + self.right.count()) if early_stop is None else early_stop
        open_ = {(low, high, 0, total): [k for k in ks if k < total]}
        out: dict[int, dict[str, object]] = {}
        while open_:
            pivots: dict[tuple[int, int, int, int], list[int]] = {}
            for interval, own in open_.items():
                low, high, before, upto = interval
                if own and (low == high or upto - before <= enough):
                    out |= self._ordered(low, high, before, own)
                elif own:
                    step = max(1, (high - low) // max(4, PIVOTS // len(open_)))
                    pivots[interval] = [*range(low, high, step)][: PIVOTS + 1]
            counts = {int(r.pivot): int(r.le) for r in self._counts([p for ps in pivots.values() for p in ps]).collect()} if pivots else {}
            narrowed: dict[tuple[int, int, int, int], list[int]] = {}
            for (low, high, before, upto), ps in pivots.items():
                ends = [(p, counts[p]) for p in ps] + [(high, upto)]
                for k in open_[low, high, before, upto]:
                    at = next(i for i, (_, n) in enumerate(ends) if n > k)
                    first, done = (ends[at - 1][0] + 1, ends[at - 1][1]) if at else (low, before)
                    narrowed.setdefault((first, *ends[at][:1], done, ends[at][1]), []).append(k)
            open_ = narrowed
        return out

    def _ordered(self, low: int, high: int, before: int, ks: list[int]) -> dict[int, dict[str, object]]:
        """The answers of the ranks ``ks``, which lie in an interval of sums with ``before`` answers below it."""
        rows = prefix_sums(self._between(low, high), [], [("__v", 1), *full_order(self.cq)], M)
        among = rows.sparkSession.createDataFrame([(k - before,) for k in ks], "__r long")
        got = rows.join(F.broadcast(among), (F.col("__start") <= F.col("__r")) & (F.col("__end") > F.col("__r")))
        found = got.withColumn("sum", self._value(F.col("__v"))).select("__r", *map(c, self.cq.free), "sum").collect()
        return {int(r["__r"]) + before: {v: r[v] for v in self.cq.free} | {"sum": r["sum"]} for r in found}
