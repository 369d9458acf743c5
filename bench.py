"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

Index build, a batch of ranks and single selections are set against Spark's own
join, sort and skip at the same ranks.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tarn.operators.access import LayeredIndex
from tarn.operators.baseline import kth
from tarn.operators.select_lex import Selection
from tarn.operators.select_sum import SumSelection
from tarn.plans.spec import CQ
from tarn.queries import BRANCH, PAIR, PATH3, tables


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, f):
        began = time.perf_counter()
        out = f()
        times[name] = round(time.perf_counter() - began, 3)
        return out

    for name, atoms, lex in (("path3", PATH3, ["nation", "cust", "ord", "part"]), ("branch", BRANCH, ["nation", "cust", "ord", "supp"])):
        cq, t = CQ.of(atoms, None, lex), tables(spark, sf_dir, atoms)

        def build():
            index = LayeredIndex(cq, t, persist=True)
            return index, index.count()

        build()[0].unpersist()  # compiles code
        index, n = timed(f"{name}_build", build)
        ranks = [0, n // 4, n // 2, 3 * n // 4, n - 1]
        index.access_many(ranks).collect()
        got = timed(f"{name}_access_5", lambda: index.access_many(ranks).collect())
        many = spark.range(0, n, max(1, n // 100_000)).withColumnRenamed("id", "k")
        timed(f"{name}_access_100k", lambda: index.access_many(many).write.format("noop").mode("overwrite").save())
        plain = timed(f"{name}_sort_5", lambda: [kth(cq, t, k).first() for k in ranks])
        want = {k: r.asDict() for k, r in zip(ranks, plain)}
        assert all(want[r.k] == {v: r[v] for v in cq.free} for r in got)
        index.unpersist()

    t = tables(spark, sf_dir, PAIR)
    trio = CQ.of(PAIR, None, ["supp", "cust", "nation"])
    by_sum = CQ.of(PAIR, None, ["cust", "nation", "supp"], ["cust", "supp"])
    n = LayeredIndex(CQ.of(PAIR, None, ["nation", "cust", "supp"]), t).count()
    ranks = [0, n // 4, n // 2, 3 * n // 4, n - 1]
    for name, cq, kind in (("select_lex_trio", trio, Selection), ("select_sum", by_sum, SumSelection)):
        kind(cq, t).select_many([5])  # compiles code
        got = timed(name, lambda: kind(cq, t).select_k(n // 2))
        many = timed(f"{name}_5", lambda: kind(cq, t).select_many(ranks))
        plain = timed(f"{name}_sort_5", lambda: {k: kth(cq, t, k).first().asDict() for k in ranks})
        assert many[n // 2] == got and all({v: many[k][v] for v in cq.free} == plain[k] for k in ranks)
    print(json.dumps({"metric": "ranked access, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
