"""Queries as SQL text, and a runner of that text."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..plans.spec import CQ


def _q(name: str) -> str:
    return f"`{name}`"


def table_statements(cq: CQ, types: Mapping[str, str] | None = None, data_dir: str = ".") -> str:
    """A statement per relation that makes a view of its CSV file; INT where ``types`` has no type of a variable."""
    out = []
    for atom, part in zip(cq.atoms, cq.files):
        columns = ", ".join(f"`c{i}` {(types or {}).get(v, 'INT')}" for i, v in enumerate(atom.variables))
        path = f"{data_dir.rstrip('/')}/{part['file_name'].removeprefix('./')}"
        header = str(bool(part.get("has_header", True))).lower()
        options = f"path '{path}', header '{header}', sep '{part.get('file_sep', ',')}'"
        out.append(f"CREATE OR REPLACE TEMPORARY VIEW {_q(atom.relation)} ({columns})\nUSING csv OPTIONS ({options});")
    return "\n".join(out)


def query_template(cq: CQ, semantics: str = "set", views: Mapping[str, str] | None = None) -> str:
    """SELECT of the free variables with ``OFFSET {k} LIMIT 1``; the columns of a relation are c0, c1 ...

    ``views`` names the views that hold the relations, if not they themselves.
    """
    view = lambda a: f"{_q((views or {}).get(a.relation, a.relation))} AS {_q(a.relation)}" if views else _q(a.relation)
    seen: dict[str, str] = {}
    clauses: list[str] = []
    inside: list[str] = []
    for atom in cq.atoms:
        own: dict[str, str] = {}
        on = []
        for i, v in enumerate(atom.variables):
            place = f"{_q(atom.relation)}.`c{i}`"
            if v in own:
                on.append(f"{place} = {own[v]}")
            elif v in seen:
                on.append(f"{place} = {seen[v]}")
            own.setdefault(v, place)
        if not clauses:
            clauses.append(f"FROM {view(atom)}")
            inside = on
        else:
            clauses.append(f"JOIN {view(atom)} ON {' AND '.join(on)}" if on else f"CROSS JOIN {view(atom)}")
        seen = {**own, **seen}
    columns = ", ".join(f"{seen[v]} AS {_q(v)}" for v in cq.free)
    order = [f"{_q(v)} {'ASC' if d > 0 else 'DESC'} NULLS LAST" for v, d in cq.lex]
    if cq.sums:
        order.insert(0, " + ".join(f"{k} * {_q(v)}" for v, k in cq.sums))
    named = {v for v, _ in cq.lex}
    order += [f"{_q(v)} ASC NULLS LAST" for v in sorted(set(cq.free) - named)]
    where = f"\nWHERE {' AND '.join(inside)}" if inside else ""
    distinct = "DISTINCT " if semantics == "set" else ""
    return f"SELECT {distinct}{columns}\n" + "\n".join(clauses) + where + f"\nORDER BY {', '.join(order)}\nLIMIT 1 OFFSET {{k}}"


def write_sql(cq: CQ, folder: str | Path, semantics: str = "set", data_dir: str = ".") -> list[Path]:
    """create_tables.sql, query_template.sql and explain_template.sql."""
    query = query_template(cq, semantics)
    out = []
    for name, text in (("create_tables.sql", table_statements(cq, data_dir=data_dir)), ("query_template.sql", query + ";"), ("explain_template.sql", f"EXPLAIN FORMATTED\n{query};")):
        path = Path(folder) / name
        path.write_text(text + "\n")
        out.append(path)
    return out


def run_sql(spark: SparkSession, cq: CQ, tables: Mapping[str, DataFrame], k: int, semantics: str = "set") -> DataFrame:
    """The template at rank k over ``tables``; an empty result beyond the last answer.

    The views it reads have names of their own and are dropped, so the session's
    views stay as they are.
    """
    views = {a.relation: f"tarn_{uuid.uuid4().hex}" for a in cq.atoms}
    for relation, view in views.items():
        t = tables[relation]
        t.toDF(*[f"c{i}" for i in range(len(t.columns))]).createOrReplaceTempView(view)
    try:
        return spark.sql(query_template(cq, semantics, views).format(k=int(k)))
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


@dataclass
class Run:
    """One execution of the SQL text: its rows, the plan that ran, and milliseconds of planning and of execution."""

    rows: list
    plan: str
    planning_ms: float
    execution_ms: float


def explain_analyze(spark: SparkSession, cq: CQ, tables: Mapping[str, DataFrame], k: int, semantics: str = "set") -> Run:
    """Runs the template at rank k and keeps the adaptive plan as executed, with its times."""
    began = time.perf_counter()
    df = run_sql(spark, cq, tables, k, semantics)
    plan = df._jdf.queryExecution().executedPlan()
    planned = time.perf_counter()
    rows = df.collect()
    done = time.perf_counter()
    return Run(rows, plan.toString(), round((planned - began) * 1000, 3), round((done - planned) * 1000, 3))
