from __future__ import annotations

import csv
import json

import duckdb
import pytest
from tests.conftest import SMALL

from tarn import cli, queries
from tarn.sources import datagen, files
from tarn.timing import Timer

SPEC = {
    "query": [
        {"relation_name": "R", "relation_schema": ["a", "b"], "file_name": "./R.csv", "has_header": False},
        {"relation_name": "S", "relation_schema": ["c", "d"], "file_name": "S.csv", "join_condition": ["R.b = S.c"], "file_sep": ";"},
    ],
    "free_variables": ["R.a", "R.b", "S.d"],
    "lex_order": {"R.a": 1, "R.b": -1, "S.d": 1},
}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "q.json").write_text(json.dumps(SPEC))
    (tmp_path / "R.csv").write_text("1,2\n1,3\n4,2\nNA,2\n7,\n")
    (tmp_path / "S.csv").write_text("c;d\n2;5\n2;6\n3;5\nnull;9\n")
    return tmp_path


WANT = [(1, 3, 5), (1, 2, 5), (1, 2, 6), (4, 2, 5), (4, 2, 6), (None, 2, 5), (None, 2, 6)]


@pytest.mark.parametrize("command", ["access", "select", "baseline", "sql"])
def test_commands(spark, folder, command):
    out = cli.main([command, "--query_file", f"{folder}/q.json", "--data_dir", str(folder), "--k_list", "0", "3", "6", "7", *["--semantics", "bag"] * (command == "sql"), "--records_file", f"{folder}/r.csv", "--time_data_file", f"{folder}/t.csv", "--exp_id", "e"], spark) if command != "select" else cli.main([command, "--query_file", f"{folder}/q.json", "--data_dir", str(folder), "--k_list", "0", "3", "6"], spark)
    assert [tuple(r["result"][v] for v in ("R.a", "R.b", "S.d")) for r in out] == [WANT[k] for k in (0, 3, 6)]
    if command != "select":
        rows = list(csv.DictReader((folder / "r.csv").open()))
        assert [r["k"] for r in rows] == ["0", "3", "6"] and rows[0]["exp_id"] == "e" and json.loads(rows[0]["result"])["R.b"] == 3
        assert {"LoadQuery"} <= {r["process"] for r in csv.DictReader((folder / "t.csv").open())}


def test_count_and_sql_text(spark, folder):
    assert cli.main(["count", "--query_file", f"{folder}/q.json", "--data_dir", str(folder), "--out_dir", str(folder)], spark)[0]["result"] == {"count": 7}
    assert json.loads((folder / "quartile_list.json").read_text()) == [0, 1, 3, 5, 6]
    assert files.read_ranks(f"{folder}/quartile_list.json") == [0, 1, 3, 5, 6]
    (folder / "k.json").write_text('{"k_list": [3]}')
    assert files.read_ranks(f"{folder}/k.json") == [3]
    cli.main(["write-sql", "--query_file", f"{folder}/q.json", "--data_dir", str(folder), "--out_dir", str(folder), "--semantics", "bag"], spark)
    for statement in (folder / "create_tables.sql").read_text().split(";\n"):
        if statement.strip():
            spark.sql(statement.rstrip(";"))
    text = (folder / "query_template.sql").read_text().strip().rstrip(";")
    assert tuple(spark.sql(text.format(k=0)).first()) == WANT[0]
    assert (folder / "explain_template.sql").read_text().startswith("EXPLAIN")


def test_sum_command(spark, folder):
    spec = {**SPEC, "sum_order": {"R.a": 1, "S.d": -2}}
    (folder / "s.json").write_text(json.dumps(spec))
    (folder / "R.csv").write_text("1,2\n1,3\n4,2\n")
    out = cli.main(["sum", "--query_file", f"{folder}/s.json", "--data_dir", str(folder), "--k_list", "0", "2", "99", "--time_data_file", f"{folder}/t.csv"], spark)
    assert [(r["k"], r["result"]["sum"]) for r in out] == [(0, -11), (2, -9)]
    assert {"PrepareSelection", "SelectK"} <= {r["process"] for r in csv.DictReader((folder / "t.csv").open())}


def test_sql_runner_leaves_views_alone(spark, folder):
    from tarn.sources import sqltext

    spark.range(3).createOrReplaceTempView("R")
    before = {t.name for t in spark.catalog.listTables()}
    cq, tables = files.open_query(spark, f"{folder}/q.json", str(folder))
    run = sqltext.explain_analyze(spark, cq, tables, 3, "bag")
    assert [tuple(r) for r in run.rows] == [WANT[3]] and "AdaptiveSparkPlan" in run.plan and run.execution_ms > 0 and run.planning_ms > 0
    assert sqltext.explain_analyze(spark, cq, tables, 99, "bag").rows == []
    assert {t.name for t in spark.catalog.listTables()} == before and spark.table("R").count() == 3
    spark.catalog.dropTempView("R")


def test_experiment(spark, folder):
    out = cli.main(["experiment", "--query_file", f"{folder}/q.json", "--out_dir", f"{folder}/exp", "--sizes", "4", "9", "--iterations", "1", "--time_data_file", f"{folder}/times.csv"], spark)
    by = {}
    for r in out:
        by.setdefault(r["exp_id"], []).append(r["result"])
    for n in (4, 9):
        assert by[f"access-{n}"] == by[f"select-{n}"] == by[f"baseline-{n}"] == by[f"sql-{n}"] and by[f"count-{n}"][0]["count"] > 0
    assert {"PrepareTree", "Sort", "SelectK"} <= {r["process"] for r in csv.DictReader((folder / "times.csv").open())}


def test_generated(spark, folder):
    for kind, param in (("uniform", None), ("zipf", 1.2), ("normal", None)):
        df = datagen.generate(spark, ["a", "b"], 300, "small", kind, param) if kind != "normal" else datagen.generate(spark, ["a", "b"], 100, "large", kind, param)
        rows = [tuple(r) for r in df.collect()]
        size = datagen.domain_size(300, "small") if kind != "normal" else 100
        assert len(rows) == len(set(rows)) == (300 if kind != "normal" else 100) and all(0 <= x < size for r in rows for x in r)
    again = datagen.generate(spark, ["a", "b"], 300, "small")
    assert sorted(again.collect()) == sorted(datagen.generate(spark, ["a", "b"], 300, "small").collect())
    with pytest.raises(ValueError):
        datagen.generate(spark, ["a"], 300, "small")
    cli.main(["generate", "--query_file", f"{folder}/q.json", "--out_dir", f"{folder}/gen", "--rows", "50", "--domain", "large"], spark)
    assert files.read_relation(spark, f"{folder}/gen/R.csv", header=False).count() == 50


def test_types(spark, folder):
    (folder / "t.csv").write_text("a,b,c\n1,x,1.5\nNA,,2\n")
    df = files.read_relation(spark, f"{folder}/t.csv")
    assert df.dtypes == [("a", "bigint"), ("b", "string"), ("c", "double")] and [tuple(r) for r in df.collect()] == [(1, "x", 1.5), (None, None, 2.0)]
    assert files.read_relation(spark, f"{folder}/t.csv", schema="x int, y string, z double").dtypes[0] == ("x", "int")
    with pytest.raises(ValueError):
        files.read_relation(spark, f"{folder}/t.csv", arity=2)
    files.write_results(df.withColumnRenamed("a", "k"), f"{folder}/results", "e1")
    assert spark.read.option("header", True).csv(f"{folder}/results").columns == ["exp_id", "k", "result"]


def test_timer():
    t = Timer()

    @t.all_methods
    class Work:
        def go(self):
            with t.block("inside"):
                return 3

    with t.context(exp_id="a", k=2), t.phase("outer", trial=1):
        assert Work().go() == 3
    assert [(r["process"], r["exp_id"]) for r in t.records] == [("Work.go", "a"), ("outer", "a")]
    off = Timer(enabled=False)
    with off.phase("x"):
        pass
    assert not off.records


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    rel = con.sql(queries.ORACLES[name])
    columns = sorted(rel.columns)
    assert columns == sorted(df.columns)
    want = sorted((tuple(r[rel.columns.index(c)] for c in columns) for r in rel.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == want
