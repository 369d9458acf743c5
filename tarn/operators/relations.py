"""Row operators on relations: projection, semi-join, weights, prefix sums, sorting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.spec import CQ
from ..sources.scratch import written

M = "__m"  # multiplicity of a tuple
W = "__w"  # answers below a tuple

#: Beyond this many answers arithmetic moves from bigint to decimal(38,0).
BIG = "decimal(38,0)"

#: A side of a join with at most so many rows is sent to all tasks.
SMALL_ROWS = 1 << 18

#: A bucket of more rows is dealt to several tasks.
HOT_ROWS = 1 << 20

#: Of a join in blocks: about how many rows of the large side, and at most how many of the small one, make a block; rows of
#: the large side in a partition (column files keep the dictionary of a column with so few values).
LEFT_ROWS, RIGHT_ROWS, PART_ROWS = 1 << 7, 1 << 8, 1 << 16


def c(name: str) -> Column:
    """A column of just this name, dots included."""
    return F.col(f"`{name}`")


def lex_columns(order: Sequence[tuple[str, int]]) -> list[Column]:
    """Sort keys, nulls last in either direction."""
    return [c(v).asc_nulls_last() if d > 0 else c(v).desc_nulls_last() for v, d in order if d]


def lex_sort(df: DataFrame, order: Sequence[tuple[str, int]]) -> DataFrame:
    return df.orderBy(*lex_columns(order))


def bind(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """``df``'s columns, by place, as variables; a repeated variable is an equality."""
    if len(df.columns) != len(variables):
        raise ValueError(f"{len(df.columns)} columns for {len(variables)} variables")
    df = df.toDF(*[f"__c{i}" for i in range(len(variables))])
    first: dict[str, int] = {}
    for i, v in enumerate(variables):
        if v in first:
            df = df.where(F.col(f"__c{i}") == F.col(f"__c{first[v]}"))
        else:
            first[v] = i
    return df.select(*[F.col(f"__c{i}").alias(v) for v, i in first.items()])


def project_distinct(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    return df.select(*map(c, variables)).distinct()


def project_count(df: DataFrame, variables: Sequence[str], weight: str | None = None, name: str = M) -> DataFrame:
    """Tuples over ``variables`` with how often they occur, or the sum of ``weight``."""
    return df.groupBy(*map(c, variables)).agg((F.sum(c(weight)) if weight else F.count("*")).alias(name))


def semi_join(df: DataFrame, child: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` that have a partner; without join columns, all of them if ``child`` has a row."""
    if on:
        return df.join(child.select(*map(c, on)), list(on), "left_semi")
    return df.crossJoin(F.broadcast(child.limit(1).select(F.lit(1).alias("__one")))).drop("__one")


def same_join(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on columns of the same names, where null equals null: both sides stem from the same tuples."""
    other = other.withColumnsRenamed({v: f"__r{i}" for i, v in enumerate(on)})
    condition = reduce(lambda a, b: a & b, [c(v).eqNullSafe(F.col(f"__r{i}")) for i, v in enumerate(on)])
    return df.join(other, condition).drop(*[f"__r{i}" for i in range(len(on))])


def spread_for(df: DataFrame, other: DataFrame, counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join that may make many more rows than it gets.

    If ``other`` is small it is sent to all tasks and ``df`` is dealt evenly, so
    that few keys don't end in few tasks and nothing that is joined is shuffled.
    ``counted`` has as many rows as ``other`` and is cheaper to count.
    """
    if (other if counted is None else counted).limit(SMALL_ROWS + 1).count() > SMALL_ROWS:
        return df, other
    ways = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(ways, *map(c, df.columns)), F.broadcast(other)


def block_join(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on ``on`` with every pair of rows that match, for results many times as large as the inputs.

    Where ``other`` is small, both sides are cut into blocks under each key, and
    blocks are joined with blocks.  Neighbouring rows then repeat the values of a
    block in the same order, which column files store in a fraction of the space;
    only ``df`` is shuffled, never joined rows.  Otherwise this is a plain join.
    """
    left, right = [v for v in df.columns if v not in on], [v for v in other.columns if v not in on]
    if not (on and left and right) or other.limit(SMALL_ROWS + 1).count() > SMALL_ROWS:
        df, other = spread_for(df, other)
        return df.join(other, list(on)) if on else df.crossJoin(other)
    keys, lefts, rights = [c(v) for v in on], [f"__l{i}" for i in range(len(left))], [f"__r{i}" for i in range(len(right))]
    df, other = df.select(*keys, *map(c, left)).toDF(*on, *lefts), other.select(*keys, *map(c, right)).toDF(*on, *rights)

    sizes = semi_join(df.groupBy(*keys).agg(F.count("*").alias("__rows")), F.broadcast(other), on)
    sizes = written(sizes, "sizes")  # no more rows than other
    rows = sizes.agg(F.sum("__rows")).first()[0] or 0
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))

    def cut(side: DataFrame, by: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
        place = Window.partitionBy(*map(c, by)).orderBy(*order)
        return side.withColumn("__cut", F.floor((F.row_number().over(place) - 1) / most))

    # rows that agree on the first column stay together, at most a block of them
    df = cut(df, [*on, lefts[0]], lefts, LEFT_ROWS).join(F.broadcast(sizes), list(on))
    df = df.withColumn("__block", F.pmod(F.xxhash64(lefts[0], "__cut"), F.ceil(F.col("__rows") / LEFT_ROWS)))
    df = df.repartitionByRange(parts, *keys, "__block")  # few keys, so few values of a column, in a partition
    df = df.groupBy(*keys, "__block").agg(F.sort_array(F.collect_list(F.struct(*lefts))).alias("__left"))
    other = cut(other, on, rights, RIGHT_ROWS).groupBy(*keys, "__cut").agg(F.sort_array(F.collect_list(F.struct(*rights))).alias("__right"))
    pairs = df.join(F.broadcast(other), list(on)).select(*keys, F.inline("__left"), "__right")
    return pairs.select(*keys, *lefts, F.inline("__right")).toDF(*on, *left, *right)


def times(df: DataFrame, child: DataFrame, on: Sequence[str], weight: str, by: str, big: bool = False) -> DataFrame:
    """``df`` with ``weight`` multiplied by the sum of the child's ``by`` over the rows that match; rows without any go.

    Sums travel up instead of joined rows, so the result is never larger than ``df``.
    """
    kind = BIG if big else "long"
    if on:
        sums = child.groupBy(*map(c, on)).agg(F.sum(c(by)).cast(kind).alias("__s"))
        joined = same_join(df, sums, on)
    else:  # one row
        sums = child.agg(F.sum(c(by)).cast(kind).alias("__s")).where("__s > 0")
        joined = df.crossJoin(F.broadcast(sums))
    return joined.withColumn(weight, (c(weight) * F.col("__s")).cast(kind)).drop("__s")


def hot_buckets(df: DataFrame, prefix: Sequence[str], least: int = HOT_ROWS, weight: str = W) -> DataFrame | None:
    """The buckets of more than ``least`` rows, with their total and number of rows; None if there are none.

    At most rows / ``least`` of them exist; they are written, so that the planner
    knows their size.
    """
    sizes = df.groupBy(*map(c, prefix)).agg(F.sum(c(weight)).alias("__total"), F.count("*").alias("__n"))
    hot = written(sizes.where(F.col("__n") > least), "hot")
    return None if hot.isEmpty() else hot


def prefix_sums(df: DataFrame, prefix: Sequence[str], order: Sequence[tuple[str, int]], weight: str = W, hot: DataFrame | None = None) -> DataFrame:
    """``df`` with ``__start``, ``__end`` (running sums of the weight in a bucket) and ``__bucket`` (its total).

    A bucket is what agrees on ``prefix``.  Without a prefix, and in the buckets
    that ``hot`` names, rows are dealt by ranges of the order, so that no task
    sees a whole bucket.  Rows that agree on ``prefix`` and ``order`` follow each
    other in any order.
    """
    if not prefix:
        return _ranged_sums(df, prefix, order, weight)
    if hot is not None:
        named = hot.select(*[c(v).alias(f"__h{i}") for i, v in enumerate(prefix)])
        same = reduce(lambda a, b: a & b, [c(v).eqNullSafe(F.col(f"__h{i}")) for i, v in enumerate(prefix)])
        split = _ranged_sums(df.join(named, same, "left_semi"), prefix, order, weight)
        return prefix_sums(df.join(named, same, "left_anti"), prefix, order, weight).unionByName(split)
    bucket = Window.partitionBy(*map(c, prefix))
    end = F.sum(c(weight)).over(bucket.orderBy(*lex_columns(order)).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(c(weight)).over(bucket)
    return df.withColumn("__end", end).withColumn("__start", F.col("__end") - c(weight)).withColumn("__bucket", total)


def _ranged_sums(df: DataFrame, prefix: Sequence[str], order: Sequence[tuple[str, int]], weight: str) -> DataFrame:
    """Prefix sums by ranges of bucket and order: each range adds what its bucket has in those before it."""
    keys = lex_columns([*((v, 1) for v in prefix), *order])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()), "ranged")
    # one row per range, and one more for each bucket that begins within a range
    sums = ranged.groupBy("__part", *map(c, prefix)).agg(F.sum(c(weight)).alias("__s"))
    bucket = Window.partitionBy(*map(c, prefix))
    before = bucket.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__part", *map(c, prefix), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"), F.sum("__s").over(bucket).alias("__bucket"))
    within = Window.partitionBy("__part", *map(c, prefix)).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    ranged = ranged.withColumn("__run", F.sum(c(weight)).over(within))
    # with a prefix their number follows that of hot buckets: the planner goes by the size of what was written
    joined = same_join(ranged, written(sums, "sums") if prefix else F.broadcast(sums), ["__part", *prefix])
    return joined.withColumn("__end", F.col("__before") + F.col("__run")).withColumn("__start", F.col("__end") - c(weight)).drop("__part", "__run", "__before")


def bucket_weights(df: DataFrame, prefix: Sequence[str], weight: str | None = None) -> DataFrame:
    return project_count(df, prefix, weight, "weight")


def sum_scale(types: Mapping[str, T.DataType], sums: Sequence[tuple[str, int]]) -> int:
    """Digits after the point that a sum needs; ValueError for a variable that is neither integer nor decimal."""
    scale = 0
    for v, _ in sums:
        if isinstance(types[v], T.DecimalType):
            scale = max(scale, types[v].scale)
        elif not isinstance(types[v], T.IntegralType):
            raise ValueError(f"{v} is of type {types[v].simpleString()}; a sum takes integers and decimals")
    return scale


def weighted_sum(sums: Sequence[tuple[str, int]], scale: int = 0) -> Column:
    """The weighted sum of variables times 10 ** ``scale``, as bigint; 0 of none."""
    unit = F.lit(10**scale)
    return reduce(lambda a, b: a + b, [((c(v) * unit) if scale else c(v)).cast("long") * F.lit(k).cast("long") for v, k in sums], F.lit(0).cast("long"))


def instances(cq: CQ, tables: Mapping[str, DataFrame]) -> list[DataFrame]:
    """Each atom's relation over its variables, without rows that are null in a joined variable."""
    count: dict[str, int] = {}
    for a in cq.atoms:
        for v in set(a.variables):
            count[v] = count.get(v, 0) + 1
    out = []
    for a in cq.atoms:
        if a.relation not in tables:
            raise ValueError(f"no table for {a.relation}")
        df = bind(tables[a.relation], a.variables)
        shared = [v for v in dict.fromkeys(a.variables) if count[v] > 1]
        out.append(df.dropna(subset=[f"`{v}`" for v in shared]) if shared else df)
    return out
