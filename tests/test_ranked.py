"""Ranked access held against answers made, sorted and counted in plain Python."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tests.test_plans import ENDS, F1, F2, F3, TRIANGLE, TRIO

from tarn import queries
from tarn.functions import medians, ranks
from tarn.operators import baseline, relations
from tarn.operators.access import LayeredIndex
from tarn.operators.select_lex import Selection
from tarn.operators.select_sum import SumSelection
from tarn.plans.hypergraph import classify
from tarn.plans.spec import CQ, NotTractable
from tarn.sources import files

P = [("y1", "x1"), ("y2", "x3"), ("y1", "x2")]
Q = [("z1", "y2"), ("z3", "y1"), ("z2", "y2")]


def make(spark, cq, data):
    kind = {a.relation: "string" if any(isinstance(x, str) for r in data[a.relation] for x in r) else "long" for a in cq.atoms}
    return {a.relation: spark.createDataFrame(data[a.relation], ", ".join(f"c{i} {kind[a.relation]}" for i in range(len(a.variables)))) for a in cq.atoms}


def brute(cq, data, semantics, order):
    """All answers in order, by trying all combinations of rows."""
    out = []
    for rows in itertools.product(*(data[a.relation] for a in cq.atoms)):
        found = {}
        if all(x is not None and found.setdefault(v, x) == x for a, r in zip(cq.atoms, rows) for v, x in zip(a.variables, r)):
            out.append(tuple(found[v] for v in cq.free))
    if semantics == "set":
        out = list(set(out))
    for v, d in reversed(order):
        out.sort(key=lambda r: r[cq.free.index(v)], reverse=d < 0)
    return out


def test_fixed_answers(spark):
    t = make(spark, F1, {"P": P, "Q": Q})
    i = LayeredIndex(F1, t)
    want = [("x3", "y2", "z1"), ("x3", "y2", "z2"), ("x2", "y1", "z3"), ("x1", "y1", "z3")]
    assert i.count() == 4 and [tuple(i.access(k)[v] for v in "abc") for k in range(4)] == want
    for k in (-1, 4):
        with pytest.raises(IndexError):
            i.access(k)
    s = Selection(F2, t)
    assert [tuple(s.select_k(k)[v] for v in "abc") for k in range(4)] == [("x1", "y1", "z3"), ("x2", "y1", "z3"), ("x3", "y2", "z2"), ("x3", "y2", "z1")]
    for k in (-1, 4):
        with pytest.raises(IndexError):
            s.select_k(k)
    with pytest.raises(NotTractable):
        LayeredIndex(F2, t)


def random_case(rng, atoms, size=7, domain=3):
    return {n: [tuple(rng.randrange(domain) for _ in v) for _ in range(size)] for n, v in atoms}


SHAPES = [
    ([("R", "ab"), ("S", "bc"), ("T", "ad")], "abcd", "abcd"),
    ([("R", "ab"), ("S", "bc"), ("T", "cd")], "abcd", "bcad"),
    ([("R", "abc"), ("S", "b"), ("T", "bc")], "abc", "abc"),
    ([("R", "ab"), ("S", "cd")], "abcd", "acbd"),
    ([("R", "ax"), ("S", "xy"), ("T", "y")], "a", "a"),
    ([("A", "uvx"), ("B", "vwy"), ("C", "xz"), ("D", "pq")], "uvxyz", "uvxyz"),
    ([("W", "abc"), ("X", "abx"), ("Y", "bcy"), ("Z", "acz")], "abc", "cab"),
    ([("R", "aab"), ("S", "b")], "ab", "ba"),
    ([("R", "a")], "a", "a"),
]


@pytest.mark.parametrize("shape", range(len(SHAPES)))
@pytest.mark.parametrize("semantics", ["set", "bag"])
def test_every_rank(spark, shape, semantics):
    atoms, free, order = SHAPES[shape]
    rng = random.Random(shape)
    lex = {v: rng.choice([1, -1]) for v in order}
    cq = CQ.of(atoms, list(free), lex)
    data = random_case(rng, atoms, 5 if len(atoms) > 3 else 7)
    want = brute(cq, data, semantics, list(lex.items()))
    i = LayeredIndex(cq, make(spark, cq, data), semantics, big=shape % 2 == 1)
    assert i.count() == len(want)
    got = sorted((int(r.k), tuple(r[v] for v in free)) for r in i.top(len(want) + 3).collect())
    assert got == list(enumerate(want))


@pytest.mark.parametrize("big", [False, True])
def test_hot_buckets(spark, big):
    """Buckets of more than two rows are split by ranges; nulls are a bucket and a value like others."""
    data = {"R": [(a, a % 2) for a in range(9)], "S": [(b, x) for b in (0, 1) for x in (5, 3, None, 8, 1) if (b, x) != (1, 8)], "T": [(0, y) for y in range(4)] + [(1, 7)]}
    cq = CQ.of([("R", "ab"), ("S", "bc"), ("T", "bd")], list("abcd"), {"b": -1, "a": 1, "c": -1, "d": 1})
    i = LayeredIndex(cq, make(spark, cq, data), big=big, hot_rows=2)
    plain = LayeredIndex(cq, make(spark, cq, data), big=big)
    n = plain.count()
    assert any(h is not None for h in i.hot) and all(h is None for h in plain.hot) and i.count() == n == 5 * 5 * 4 + 4 * 4
    rows = [{int(r.k): (r.a, r.b, r.c, r.d) for r in x.top(n + 2).collect()} for x in (i, plain)]
    assert rows[0] == rows[1] and sorted(rows[0]) == list(range(n))


def test_order_of_atoms_and_completion(spark):
    rng = random.Random(5)
    atoms = [("R", "ab"), ("S", "bc"), ("T", "bd"), ("U", "b")]
    data = random_case(rng, atoms)
    seen = []
    for own in itertools.permutations(atoms):
        cq = CQ.of(own, list("abcd"), {"c": -1})
        i = LayeredIndex(cq, make(spark, cq, data))
        got = [tuple(r[v] for v in "abcd") for r in sorted(i.top(500).collect(), key=lambda r: r.k)]
        assert got == brute(cq, data, "set", i.order)
        seen.append(got)
        if len(seen) == 4:
            break
    assert all(x == seen[0] for x in seen)


@pytest.mark.parametrize(("cq", "semantics"), [(TRIO, "set"), (TRIO, "bag"), (CQ.of([("R", "ab"), ("S", "bc")], None, {"c": -1, "a": 1}), "set"), (CQ.of([("R", "ab"), ("S", "bc"), ("T", "de")], list("abd"), {"d": -1}), "bag")])
def test_selection(spark, cq, semantics):
    data = random_case(random.Random(9), [(a.relation, a.variables) for a in cq.atoms], 4)
    s = Selection(cq, make(spark, cq, data), semantics)
    want = brute(cq, data, semantics, s.order)
    for k in sorted({0, 1, len(want) // 2, len(want) - 1}):
        assert tuple(s.select_k(k)[v] for v in cq.free) == want[k]
    with pytest.raises(IndexError):
        s.select_k(len(want))


SUMS = [
    ({"P": [(1, 2), (3, 2), (5, 2), (0, 1)], "Q": [(2, 3), (2, 4), (1, 7)]}, [("P", "ab"), ("Q", "bc")], {"a": 1, "c": -1}),
    ({"P": [(i, j) for i in range(1, 5) for j in range(1, 5)], "Q": [(i, j) for i in range(2, 6) for j in range(2, 6)]}, [("P", "ab"), ("Q", "bc")], {"a": 1, "b": 1, "c": 1}),
    ({"P": [(1, 5), (2, 6)], "Q": [(3,), (4,), (4,)]}, [("P", "ab"), ("Q", "c")], {"a": 2, "c": 1}),
    ({"P": [(3, 1), (1, 2), (3, 1)]}, [("P", "ab")], {"a": -1, "b": 1}),
    ({"P": [(1, 1), (2, 1)], "Q": [(1, 4), (1, 5)], "R": [(4, 0), (4, 1), (5, 2)]}, [("P", "ab"), ("Q", "bc"), ("R", "cd")], {"a": 1, "c": 3}),
]


@pytest.mark.parametrize("case", range(len(SUMS)))
def test_sums(spark, case):
    data, atoms, weights = SUMS[case]
    cq = CQ.of(atoms, None, {cq_v: 1 for cq_v in sorted({v for _, vs in atoms for v in vs})}, weights)
    s = SumSelection(cq, make(spark, cq, data), "bag")
    rows = [dict(zip(cq.free, r)) for r in brute(cq, data, "bag", list(cq.lex))]
    rows = sorted(({**r, "sum": sum(k * r[v] for v, k in weights.items())} for r in rows), key=lambda r: r["sum"])
    for k in sorted({0, 1, len(rows) // 2, len(rows) - 1}):
        assert s.select_k(k) == rows[k]
    with pytest.raises(IndexError):
        s.select_k(len(rows))
    pivots = sorted({r["sum"] for r in rows})[:3] + [10**6]
    assert {(r.pivot, r.lt, r.le) for r in s.count_below(pivots).collect()} == {(p, sum(r["sum"] < p for r in rows), sum(r["sum"] <= p for r in rows)) for p in pivots}
    hot = SumSelection(cq, make(spark, cq, data), "bag", big=case % 2 == 1, hot_rows=2)
    assert hot.hot is not None and s.hot is None
    assert [(r.pivot, int(r.lt), int(r.le)) for r in hot.count_below(pivots).sort("pivot").collect()] == [(r.pivot, r.lt, r.le) for r in s.count_below(pivots).sort("pivot").collect()]
    assert s.trim(pivots[1], below=True).count() == sum(r["sum"] < pivots[1] for r in rows)
    assert s.trim(pivots[1], below=False).count() == sum(r["sum"] > pivots[1] for r in rows)


@pytest.mark.parametrize("early", [None, 0, 5])
def test_sum_batches(spark, early):
    """Many ranks at once, with and without an early stop, against all answers; ranks out of range give none."""
    rng = random.Random(11)
    data = {"R": [(rng.randrange(4), rng.randrange(-50, 50)) for _ in range(40)], "S": [(rng.randrange(4), rng.randrange(10**6)) for _ in range(30)]}
    cq = CQ.of([("R", "ab"), ("S", "ac")], None, {"a": 1, "b": -1, "c": 1}, {"b": 7, "c": -2, "a": 1})
    rows = [dict(zip(cq.free, r)) for r in brute(cq, data, "bag", list(cq.lex))]
    rows = sorted(({**r, "sum": 7 * r["b"] - 2 * r["c"] + r["a"]} for r in rows), key=lambda r: r["sum"])
    s = SumSelection(cq, make(spark, cq, data), "bag")
    ks = [0, 1, len(rows) // 3, len(rows) - 1, -1, len(rows), 1]
    assert s.select_many(ks, early) == {k: rows[k] for k in {0, 1, len(rows) // 3, len(rows) - 1}}
    assert s.select_many([]) == {} and s.select_many([len(rows)]) == {}


def test_sums_of_decimals(spark):
    from decimal import Decimal

    left = [(1, Decimal("1.25")), (1, Decimal("-3.10")), (2, Decimal("7.00"))]
    right = [(1, Decimal("0.125")), (1, Decimal("10.5")), (2, Decimal("0.001"))]
    t = {"R": spark.createDataFrame(left, "j long, x decimal(10,2)"), "S": spark.createDataFrame(right, "j long, y decimal(10,3)")}
    cq = CQ.of([("R", "jx"), ("S", "jy")], None, ["x"], {"x": 2, "y": -1})
    want = sorted(2 * x - y for a, x in left for b, y in right if a == b)
    s = SumSelection(cq, t)
    assert [s.select_k(k)["sum"] for k in range(len(want))] == want
    pivots = [want[1], want[1] + Decimal("0.0005"), Decimal(100), 3]
    got = [(r.pivot, r.lt, r.le) for r in s.count_below(pivots).sort("pivot").collect()]
    assert got == sorted({(p.quantize(Decimal("0.001"), "ROUND_FLOOR"), sum(w < p.quantize(Decimal("0.001"), "ROUND_FLOOR") for w in want), sum(w <= p for w in want)) for p in map(Decimal, pivots)})
    assert s.trim(want[2], below=True).count() == 2 and s.trim(want[2], below=False).count() == len(want) - 3
    assert sorted(r["sum"] for r in s.between(want[1], want[3]).collect()) == want[1:4]
    assert [r.k for r in baseline.ranked(cq, t).sort("k").collect()] == list(range(len(want)))
    assert baseline.kth(cq, t, 2).first().x * 2 - baseline.kth(cq, t, 2).first().y == want[2]


def test_last_join_of_a_sum_is_by_band(spark):
    """Answers of one sum are joined by key and sum, not by key alone."""
    cq = CQ.of([("R", "ka"), ("S", "kb")], None, ["a"], ["a", "b"])
    t = {"R": spark.range(2000).selectExpr("id % 2 as k", "id as a"), "S": spark.range(2000).selectExpr("id % 2 as k", "id as b")}
    s = SumSelection(cq, t)
    plan = s._between(1000, 1000)._jdf.queryExecution().optimizedPlan().toString()
    (join,) = (line for line in plan.splitlines() if "Join Inner" in line)
    assert "__band" in join and "(k#" in join
    assert s.between(1000, 1000).count() == 1001


def test_batches_of_selection(spark):
    data = random_case(random.Random(3), [(a.relation, a.variables) for a in TRIO.atoms], 6)
    s = Selection(TRIO, make(spark, TRIO, data), "bag")
    want = brute(TRIO, data, "bag", s.order)
    got = s.select_many([*range(len(want)), len(want), -1])
    assert {k: tuple(r[v] for v in TRIO.free) for k, r in got.items()} == dict(enumerate(want))


def test_tree_search():
    from tarn.plans.jointree import join_tree

    edges = [frozenset("ab"), frozenset("bc"), frozenset("cd"), frozenset("bd")][:3]
    tree = join_tree(edges, 0)
    assert tree.find(edges, "a") == tree.find(edges, "b") == 0 and tree.find(edges, "d") == 2 and tree.find(edges, "z") is None


def test_refusals(spark):
    data = {n: [(1, 1)] for n in "RST"}
    for cq in (ENDS, TRIANGLE):
        t = make(spark, cq, data)
        for kind in (LayeredIndex, Selection):
            with pytest.raises(NotTractable):
                kind(cq, t)
        assert baseline.kth(cq, t, 0).count() == 1 and not classify(cq).selection
    far = CQ.of([("R", "ab"), ("S", "bc"), ("T", "cd")], None, None, ["a", "d"])
    with pytest.raises(NotTractable):
        SumSelection(far, make(spark, far, data))
    real = CQ.of([("R", "ab")], None, None, ["a"])
    with pytest.raises(ValueError):
        SumSelection(real, {"R": spark.createDataFrame([(1.5, 2.5)], "a double, b double")})
    with pytest.raises(ValueError):
        LayeredIndex(CQ.of([("R", "kb")], None, ["k"]), {"R": spark.createDataFrame([(1, 2)], "a long, b long")})


def test_nulls_and_empty_tables(spark):
    cq = CQ.of([("R", "ab"), ("S", "bc")], None, ["a", "b", "c"])
    t = {"R": spark.createDataFrame([(None, 1), (2, None), (3, 1)], "x long, y long"), "S": spark.createDataFrame([(1, None), (None, 5), (1, 4)], "y long, x long")}
    got = [tuple(r[v] for v in "abc") for r in sorted(LayeredIndex(cq, t).top(9).collect(), key=lambda r: r.k)]
    assert got == [(3, 1, 4), (3, 1, None), (None, 1, 4), (None, 1, None)]
    assert [tuple(Selection(cq, t).select_k(k)[v] for v in "abc") for k in (1, 3)] == [(3, 1, None), (None, 1, None)]
    empty = {**t, "S": t["S"].limit(0)}
    assert LayeredIndex(cq, empty).count() == 0 and LayeredIndex(cq, empty).top(3).count() == 0
    with pytest.raises(IndexError):
        Selection(cq, empty).select_k(0)
    with pytest.raises(IndexError):
        SumSelection(CQ.of([("R", "ab"), ("S", "bc")], None, None, ["a"]), empty).select_k(0)


def test_f3(spark):
    data = {"A": [("u1", "v1", "x1"), ("u1", "v2", "x1"), ("u2", "v2", "x2"), ("u3", "v1", "x3"), ("u9", "v9", "x9")], "B": [("v1", "w1", "y1"), ("v1", "w2", "y2"), ("v2", "w1", "y3"), ("v2", "w3", "y5"), ("v1", "w3", "y1")], "C": [("x1", "z1"), ("x1", "z5"), ("x2", "z2"), ("x2", "z4"), ("x3", "z3")], "D": [("1", "q"), ("2", "q"), ("3", "r")]}
    i = LayeredIndex(F3, make(spark, F3, data))
    got = [tuple(r[v] for v in "uvxyz") for r in sorted(i.top(100).collect(), key=lambda r: r.k)]
    assert got == brute(F3, data, "set", list(F3.lex)) and len(got) == 14
    assert LayeredIndex(F3, make(spark, F3, {**data, "D": data["D"]}) | {"D": spark.createDataFrame([], "a string, b string")}).count() == 0


def test_medians(spark):
    df = spark.createDataFrame([("g", 2, 1), ("g", 3, 4), ("g", 5, 1), ("h", 9, 3), ("h", 1, 3)], "g string, v long, w long")
    for most in (1 << 20, 1):
        assert {(r.g, r.median) for r in medians.weighted_median(df, "v", "w", ["g"], most).collect()} == {("g", 3), ("h", 9)}
    assert medians.weighted_quickselect(df, "v", "w", 0).first().v == 1
    assert medians.weighted_quickselect(df, "v", "w", 0, descending=True).first().v == 9
    assert medians.weighted_quickselect(df, "v", "w", 12).count() == 0


def test_rank_lists():
    assert ranks.quartile_ranks(100) == [0, 25, 50, 75, 99] and ranks.decade_ranks(1000) == [1, 10, 100, 999]
    assert ranks.rank_lists(0) == {k: [] for k in ("k_list", "k_sql_list", "k_sql_list_ext", "quartile_list", "median_list")}
    assert ranks.decade_ranks(1) == [0] and ranks.median_rank(10) == [4]


@pytest.mark.parametrize("semantics", ["set", "bag"])
def test_all_answers_with_ranks(spark, semantics):
    """From an index and by the plain way; neither sorts or removes repeated rows after the join."""
    data = {"R": [(1, 1), (1, 2), (2, 1), (1, 1), (None, 5), (3, None)], "S": [(1, 7), (1, 8), (2, 7), (1, 7), (None, 7)], "T": [(4,), (5,), (4,)]}
    cq = CQ.of([("R", ("a", "b")), ("S", ("a", "c")), ("T", ("d",))], None, {"a": -1, "c": 1, "b": 1, "d": -1})
    want = brute(cq, data, semantics, list(cq.lex))
    t = make(spark, cq, data)
    got = sorted(tuple(r) for r in LayeredIndex(cq, t, semantics).answers().select("k", *cq.free).collect())
    assert got == [(k, *w) for k, w in enumerate(want)]
    ranked = baseline.ranked(cq, t, semantics)
    assert sorted((r.k, *(r[v] for v in cq.free)) for r in ranked.collect()) == got
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Sort [" not in plan.split("Join", 1)[0] and "rangepartitioning" not in plan


def test_distinct_answers_without_distinct_on_the_join(spark):
    data = {"R": [(1, 1), (1, 2), (2, 1), (1, 1), (None, 5), (3, None)], "S": [(1, 7), (1, 8), (2, 7), (1, 7), (None, 7)]}
    cq = CQ.of([("R", ("a", "b")), ("S", ("a", "c"))])
    got = baseline.answers(cq, make(spark, cq, data))
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute(cq, data, "set", []))
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]


@pytest.mark.parametrize("semantics", ["set", "bag"])
def test_join_in_blocks(spark, monkeypatch, semantics):
    """Blocks of two or three rows; nulls, copies, keys without partners, a value and a key with most rows, dots in names."""
    monkeypatch.setattr(relations, "LEFT_ROWS", 3)
    monkeypatch.setattr(relations, "RIGHT_ROWS", 2)
    monkeypatch.setattr(relations, "PART_ROWS", 4)
    rng = random.Random(5)
    some = lambda n, top: [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([rng.randrange(top), 0, None])) for _ in range(n)]
    data = {"R": [*some(12, 6), (9, 9)], "S": [*[(v, u) for u, v in some(9, 6)], *[(7, 1)] * 7], "T": [*some(9, 4), (8, 8)]}
    cq = CQ.of([("R", ("a.1", "b")), ("S", ("b", "c")), ("T", ("a.1", "d"))], ["d", "a.1", "c", "b"])
    for t in (data["T"], [(1, 1)], [(5, 5)]):
        tables = data | {"T": t}
        got, plain = (Counter(tuple(r) for r in baseline.answers(cq, make(spark, cq, tables), semantics, blocks=b).collect()) for b in (True, False))
        assert got == plain
        whole = Counter({r: n for r, n in got.items() if None not in r})  # brute() leaves out all rows with a null
        assert whole == Counter(brute(cq, tables, semantics, []))
    pair = CQ.of([("R", ("a", "b")), ("S", ("b", "a"))])  # nothing beside the key: a plain join
    assert sorted(map(tuple, baseline.answers(pair, make(spark, pair, data), semantics, blocks=True).collect())) == sorted(brute(pair, data, semantics, []))


def test_files_of_the_natural_join_are_small(spark, tmp_path):
    """4000 orders, 800 suppliers a nation: an answer took more than two bytes where neighbouring orders were of any nations."""
    spark.range(4000).selectExpr("id AS c_custkey", "CAST(pmod(hash(id), 25) AS INT) AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(4000).selectExpr("id AS o_orderkey", "pmod(hash(id, 1), 4000) AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(20_000).selectExpr("id AS s_suppkey", "CAST(id % 25 AS INT) AS s_nationkey").orderBy(F.hash("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    queries.natural_join(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 4000 * 800 and out.agg(F.sum(F.xxhash64("ord", "supp") % 1000)).first() == spark.read.parquet(f"{tmp_path}/orders.parquet").join(spark.read.parquet(f"{tmp_path}/customer.parquet"), F.expr("o_custkey = c_custkey")).join(spark.read.parquet(f"{tmp_path}/supplier.parquet"), F.expr("c_nationkey = s_nationkey")).agg(F.sum(F.xxhash64("o_orderkey", "s_suppkey") % 1000)).first()
    size = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert size < 0.5 * 4000 * 800, f"{size / (4000 * 800):.2f} bytes an answer"


def test_decades_of_the_query_are_those_of_its_sql(spark, tmp_path):
    """More than 10**7 answers: the SQL names ranks up to 10**6 and the last."""
    for table, key in (("customer", "c"), ("supplier", "s")):
        spark.range(4000).selectExpr(f"id AS {key}_{'cust' if key == 'c' else 'supp'}key", f"0 AS {key}_nationkey").write.parquet(f"{tmp_path}/{table}.parquet")
    got = sorted(r.k for r in queries.da_decades(spark, str(tmp_path)).collect())
    assert got == [1, 10, 100, 1000, 10_000, 100_000, 1_000_000, 4000 * 4000 - 1]


def test_in_memory_relations(spark):
    assert files.relation(spark, ["a", "b"], {"b": [1], "a": [2]}).first() == (2, 1)
    assert files.relation(spark, ["a"], []).count() == 0
    for bad in ({"a": [1]}, {"a": [1], "b": []}, [(1,)], "ab"):
        with pytest.raises(ValueError):
            files.relation(spark, ["a", "b"], bad)
