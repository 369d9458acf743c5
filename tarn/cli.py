"""python -m tarn.cli {access,select,sum,baseline,sql,count,generate,write-sql,experiment}"""

from __future__ import annotations

import argparse
import logging
from pathlib import Path

from pyspark.sql import SparkSession

from .functions.ranks import rank_lists
from .operators.access import LayeredIndex
from .operators.baseline import kth
from .operators.select_lex import Selection
from .operators.select_sum import SumSelection
from .plans.hypergraph import classify
from .plans.spec import load_query
from .sources import datagen, files, sqltext
from .timing import Timer


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tarn", description=__doc__)
    p.add_argument("command", choices=["access", "select", "sum", "baseline", "sql", "count", "generate", "write-sql", "experiment"])
    p.add_argument("--query_file", required=True)
    p.add_argument("--data_dir")
    p.add_argument("--k_file")
    p.add_argument("--k_list", type=int, nargs="*")
    p.add_argument("--semantics", choices=["set", "bag"], default="set")
    p.add_argument("--timer_enabled", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--timer_log")
    p.add_argument("--exp_id", default="default")
    p.add_argument("--trial", type=int, default=0)
    p.add_argument("--time_data_file")
    p.add_argument("--records_file")
    p.add_argument("--out_dir", default=".")
    p.add_argument("--rows", type=int, default=1000)
    p.add_argument("--sizes", type=int, nargs="*", default=[4, 32, 317, 3173, 31623, 316227])
    p.add_argument("--iterations", type=int, default=3)
    p.add_argument("--domain", choices=["large", "small"], default="small")
    p.add_argument("--distribution", choices=["uniform", "zipf", "normal"], default="uniform")
    p.add_argument("--param", type=float)
    p.add_argument("--seed", type=int, default=42)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[dict]:
    """Runs a command; the records of exp_id, k and result."""
    args = parser().parse_args(argv)
    if args.timer_log:
        logging.basicConfig(filename=args.timer_log, level=logging.INFO)
    timer = Timer(args.timer_enabled)
    spark = spark or SparkSession.builder.appName("tarn").getOrCreate()
    records: list[dict] = []
    if args.command == "write-sql":
        sqltext.write_sql(load_query(args.query_file), args.out_dir, args.semantics, args.data_dir or ".")
        return records
    if args.command == "generate":
        cq = load_query(args.query_file)
        for i, (atom, part) in enumerate(zip(cq.atoms, cq.files)):
            df = datagen.generate(spark, [f"c{j}" for j in range(len(atom.variables))], args.rows, args.domain, args.distribution, args.param, args.seed + i)
            df.write.mode("overwrite").option("header", bool(part.get("has_header", True))).option("sep", part.get("file_sep", ",")).csv(f"{args.out_dir}/{part['file_name'].removeprefix('./')}")
        return records
    if args.command == "experiment":
        return experiment(args, spark)
    with timer.context(exp_id=args.exp_id, trial=args.trial):
        with timer.phase("LoadQuery"):
            cq, tables = files.open_query(spark, args.query_file, args.data_dir)
        if args.command == "count":
            with timer.phase("PreprocessBuckets"):
                n = LayeredIndex(cq, tables, args.semantics).count()
            files.write_ranks(args.out_dir, rank_lists(n))
            records.append({"exp_id": args.exp_id, "k": None, "result": {"count": n}})
        else:
            ks = files.read_ranks(args.k_file, args.k_list)
            if args.command == "access":
                with timer.phase("PrepareTree"):
                    classify(cq)
                with timer.phase("BuildTree"):
                    index = LayeredIndex(cq, tables, args.semantics, persist=True)
                with timer.phase("PreprocessBuckets"):
                    index.count()
                with timer.phase("DirectAccess"):
                    found = {r.k: r.asDict() for r in index.access_many(ks).collect()}
                records += [{"exp_id": args.exp_id, "k": k, "result": {v: found[k][v] for v in cq.free}} for k in ks if k in found]
                index.unpersist()
            elif args.command in ("select", "sum"):
                with timer.phase("PrepareSelection"):
                    chosen = (Selection if args.command == "select" else SumSelection)(cq, tables, args.semantics)
                with timer.phase("SelectK"):
                    found = chosen.select_many(ks)
                records += [{"exp_id": args.exp_id, "k": k, "result": found[k]} for k in ks if k in found]
            else:
                for k in ks:
                    with timer.context(k=k):
                        with timer.phase("SmartJoin" if args.command == "baseline" else "Plan"):
                            df = kth(cq, tables, k, args.semantics) if args.command == "baseline" else sqltext.run_sql(spark, cq, tables, k, args.semantics)
                        with timer.phase("Sort"), timer.phase("GetResult"):
                            row = df.first()
                    if row is not None:
                        records.append({"exp_id": args.exp_id, "k": k, "result": row.asDict()})
    if args.time_data_file:
        files.append_timings(args.time_data_file, timer.records)
    if args.records_file:
        files.append_results(args.records_file, records)
    return records


def experiment(args: argparse.Namespace, spark: SparkSession) -> list[dict]:
    """Generates data of each size, counts, and times access, selection and the plain ways at the quartiles, ``iterations`` times."""
    records: list[dict] = []
    for n in args.sizes:
        folder = f"{args.out_dir}/{n}"
        Path(folder).mkdir(parents=True, exist_ok=True)
        same = ["--query_file", args.query_file, "--data_dir", folder, "--semantics", args.semantics]
        main(["generate", *same, "--out_dir", folder, "--rows", str(n), "--domain", args.domain, "--distribution", args.distribution, "--seed", str(args.seed), *["--param", str(args.param)] * (args.param is not None)], spark)
        records += main(["count", *same, "--out_dir", folder, "--exp_id", f"count-{n}"], spark)
        times = ["--time_data_file", args.time_data_file] if args.time_data_file else []
        for trial in range(args.iterations):
            for command in ("access", "select", "baseline", "sql"):
                records += main([command, *same, "--k_file", f"{folder}/quartile_list.json", "--exp_id", f"{command}-{n}", "--trial", str(trial), *times], spark)
    if args.records_file:
        files.append_results(args.records_file, records)
    return records


if __name__ == "__main__":
    for r in main():
        print(r)
