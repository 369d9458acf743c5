"""Conjunctive queries with a ranking of their answers."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

Order = Mapping[str, int] | Sequence[str]


class NotTractable(Exception):
    """The query or its order has no efficient ranked access."""


@dataclass(frozen=True)
class Atom:
    """A relation whose columns are renamed to variables; a variable may recur."""

    relation: str
    variables: tuple[str, ...]


@dataclass(frozen=True)
class CQ:
    """A natural join of ``atoms``, projected to ``free``, ranked by ``lex`` or by the weighted sum ``sums``.

    ``lex`` maps variables to 1 (ascending) or -1 (descending), in the order of
    their importance.  It may leave out free variables but not name others.
    """

    atoms: tuple[Atom, ...]
    free: tuple[str, ...]
    lex: tuple[tuple[str, int], ...] = ()
    sums: tuple[tuple[str, int], ...] = ()
    files: tuple[Mapping, ...] = field(default=(), compare=False)

    @staticmethod
    def of(atoms: Iterable[tuple[str, Sequence[str]]], free: Sequence[str] | None = None, lex: Order | None = None, sums: Order | None = None) -> CQ:
        made = tuple(Atom(n, tuple(v)) for n, v in atoms)
        if not made:
            raise ValueError("a query needs an atom")
        names = [a.relation for a in made]
        if len(set(names)) < len(names):
            raise ValueError("atoms need different names; register a table under two names for a self-join")
        every = tuple(dict.fromkeys(v for a in made for v in a.variables))
        own = tuple(dict.fromkeys(every if free is None else free))
        if set(own) - set(every):
            raise ValueError(f"not in any atom: {sorted(set(own) - set(every))}")
        return CQ(made, own, _order(lex, own, (1, -1)), _order(sums, own, None))

    @property
    def variables(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(v for a in self.atoms for v in a.variables))

    @property
    def full(self) -> bool:
        return set(self.free) == set(self.variables)

    @property
    def partial(self) -> bool:
        return {v for v, _ in self.lex} != set(self.free)

    @property
    def edges(self) -> list[frozenset[str]]:
        return [frozenset(a.variables) for a in self.atoms]


def _order(order: Order | None, free: Sequence[str], allowed: tuple[int, ...] | None) -> tuple[tuple[str, int], ...]:
    if order is None:
        return ()
    pairs = tuple(order.items()) if isinstance(order, Mapping) else tuple((v, 1) for v in order)
    for v, d in pairs:
        if v not in free:
            raise ValueError(f"ordered by {v}, which is not free")
        if allowed and d not in allowed:
            raise ValueError(f"direction of {v} must be one of {allowed}")
    if len({v for v, _ in pairs}) < len(pairs):
        raise ValueError("a variable is ordered twice")
    return pairs


def unify(attributes: Iterable[str], conditions: Iterable[str]) -> dict[str, str]:
    """The representative of every attribute under equalities ``R.b = S.c``; the left side's wins."""
    parent = {a: a for a in attributes}

    def root(a: str) -> str:
        if a not in parent:
            raise ValueError(f"unknown attribute {a}")
        while parent[a] != a:
            a = parent[a]
        return a

    for condition in conditions:
        left, sign, right = (x.strip() for x in condition.partition("="))
        if sign != "=" or not left or not right:
            raise ValueError(f"not an equality: {condition}")
        a, b = root(left), root(right)
        if a != b:
            parent[b] = a
    return {a: root(a) for a in parent}


def load_query(path: str | Path) -> CQ:
    """A query file: ``query`` (relation_name, relation_schema, file_name, join_condition, has_header, file_sep), ``free_variables``, ``lex_order``, and optionally ``sum_order``."""
    spec = json.loads(Path(path).read_text())
    parts = spec["query"]
    qualified = {p["relation_name"]: [a if "." in a else f"{p['relation_name']}.{a}" for a in p["relation_schema"]] for p in parts}

    def conditions():
        for p in parts:
            c = p.get("join_condition") or []
            yield from [c] if isinstance(c, str) else c

    to = unify((a for own in qualified.values() for a in own), conditions())
    atoms = [(name, [to[a] for a in own]) for name, own in qualified.items()]

    def renamed(order):
        if order is None:
            return None
        return {to[v]: d for v, d in order.items()} if isinstance(order, Mapping) else list(dict.fromkeys(to[v] for v in order))

    free = spec.get("free_variables")
    cq = CQ.of(atoms, None if free is None else [to[v] for v in free], renamed(spec.get("lex_order")), renamed(spec.get("sum_order")))
    return CQ(cq.atoms, cq.free, cq.lex, cq.sums, tuple(parts))
