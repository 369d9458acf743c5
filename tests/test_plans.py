from __future__ import annotations

import json

import pytest

from tarn.plans import hypergraph as h
from tarn.plans.jointree import join_tree, layers
from tarn.plans.spec import CQ, NotTractable, load_query, unify

F1 = CQ.of([("P", "ba"), ("Q", "cb")], None, {"a": -1, "b": 1})
F2 = CQ.of([("P", "ba"), ("Q", "cb")], None, {"c": -1, "a": 1})
F3 = CQ.of([("A", "uvx"), ("B", "vwy"), ("C", "xz"), ("D", "pq")], list("uvxyz"), list("uvxyz"))
PATH = [("R", "ab"), ("S", "bc"), ("T", "cd")]
F9, F10 = CQ.of(PATH, None, list("abcd")), CQ.of(PATH, None, ["a"])
F11 = CQ.of([*PATH, ("U", "de")], list("abcd"), list("abcd"))
TRIO = CQ.of([("R", "ab"), ("S", "bc")], None, list("acb"))
ENDS = CQ.of([("R", "ab"), ("S", "bc")], list("ac"), list("ac"))
HUB = CQ.of([("W", "abc"), ("X", "abx"), ("Y", "bcy"), ("Z", "acz")], list("abc"), list("abc"))
TRIANGLE = CQ.of([("R", "ab"), ("S", "bc"), ("T", "ca")], None, list("abc"))


@pytest.mark.parametrize(
    ("cq", "full", "complete", "free_connex", "l_connex", "trios", "access", "selection"),
    [
        (F1, True, False, True, True, [], True, True),
        (F2, True, False, True, False, [], False, True),
        (F3, False, True, True, True, [], True, True),
        (F9, True, True, True, True, [], True, True),
        (F10, True, False, True, True, [], True, True),
        (F11, False, True, True, True, [], True, True),
        (TRIO, True, True, True, True, [("a", "c", "b")], False, True),
        (ENDS, False, True, False, False, [], False, False),
        (HUB, False, True, True, True, [], True, True),
        (TRIANGLE, True, True, False, False, [], False, False),
    ],
)
def test_classification(cq, full, complete, free_connex, l_connex, trios, access, selection):
    c = h.classify(cq)
    assert (c.full, c.complete, c.free_connex, c.l_connex, list(c.trios), c.direct_access, c.selection) == (full, complete, free_connex, l_connex, trios, access, selection)


def test_acyclicity():
    assert h.acyclic([]) and h.acyclic(["a"]) and h.acyclic(["ab", "ab"]) and h.acyclic(["ab", "cd"])
    assert not h.acyclic(["ab", "bc", "ca"]) and not h.acyclic(["ab", "ab", "bc", "ca"])
    assert h.acyclic(["ab", "bc", "ca", "abc"])
    assert not h.acyclic(["ab", "bc", "cd", "da"])


def test_join_trees():
    edges = [frozenset(x) for x in ("ab", "bc", "cd", "be", "xy")]
    for root in range(len(edges)):
        tree = join_tree(edges, root)
        assert tree.root == root and sorted(tree.order) == list(range(5)) and tree.order[-1] == root
        for again in range(len(edges)):
            other = tree.rerooted(again)
            assert other.root == again and all(other.order.index(c) < other.order.index(p) for c, p in other.parent.items())
            assert {frozenset(x) for x in other.parent.items()} == {frozenset(x) for x in tree.parent.items()}
    assert join_tree([frozenset(x) for x in ("ab", "bc", "ca")]) is None
    assert "R" in join_tree(edges, 0).explain(list("RSTUV"))


def test_layers():
    found = layers([frozenset("ab"), frozenset("bc"), frozenset("xc")], [(v, 1) for v in "abcx"])
    assert [(x.variable, x.prefix, x.parent) for x in found] == [("a", (), None), ("b", ("a",), 0), ("c", ("b",), 1), ("x", ("c",), 2)]
    with pytest.raises(ValueError):
        layers([frozenset("ab"), frozenset("bc")], [(v, 1) for v in "acb"])


def test_completion():
    assert [v for v, _ in h.complete_order(F10.edges, F10)] == list("abcd")
    assert h.complete_order(F1.edges, F1) == [("a", -1), ("b", 1), ("c", 1)]


def test_query_files(tmp_path):
    spec = {
        "query": [
            {"relation_name": "R", "relation_schema": ["a", "b"], "file_name": "R.csv"},
            {"relation_name": "S", "relation_schema": ["S.c", "S.d"], "file_name": "S.csv", "join_condition": ["R.b = S.c"]},
            {"relation_name": "T", "relation_schema": ["e"], "file_name": "T.csv", "join_condition": "T.e = S.d"},
        ],
        "free_variables": ["R.a", "S.c", "S.d", "T.e"],
        "lex_order": {"R.a": 1, "S.c": -1},
    }
    path = tmp_path / "q.json"
    path.write_text(json.dumps(spec))
    cq = load_query(path)
    assert [a.variables for a in cq.atoms] == [("R.a", "R.b"), ("R.b", "T.e"), ("T.e",)]
    assert cq.free == ("R.a", "R.b", "T.e") and cq.lex == (("R.a", 1), ("R.b", -1)) and cq.full and cq.partial


def test_errors():
    assert unify(["a", "b", "c"], ["b = a", "c=a"]) == {"a": "c", "b": "c", "c": "c"}
    for bad in ("a", "a = ", "a = z"):
        with pytest.raises(ValueError):
            unify(["a", "b"], [bad])
    for bad in (dict(free=["z"]), dict(lex=["z"]), dict(lex={"a": 2}), dict(free=["a"], lex=["b"])):
        with pytest.raises(ValueError):
            CQ.of([("R", "ab")], **bad)
    with pytest.raises(ValueError):
        CQ.of([("R", "ab"), ("R", "bc")])
    assert issubclass(NotTractable, Exception)
