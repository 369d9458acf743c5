"""CSV relations, rank lists, and the records of experiments."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.spec import CQ, load_query

# The strings that stand for null in a CSV relation.
NULLS = ("", "NA", "null", "NULL")


def read_relation(spark: SparkSession, path: str, header: bool = True, sep: str = ",", schema: StructType | str | None = None, arity: int | None = None) -> DataFrame:
    """A CSV relation.  Null strings become null before types are inferred or cast; columns go by place."""
    reader = spark.read.option("header", header).option("sep", sep).option("encoding", "UTF-8")
    raw = reader.csv(path)
    if arity is not None and len(raw.columns) != arity:
        raise ValueError(f"{path} has {len(raw.columns)} columns, not {arity}")
    text = raw.select(*[F.when(~F.col(f"`{n}`").isin(*NULLS), F.col(f"`{n}`")).alias(n) for n in raw.columns])
    if schema is not None:
        kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if len(kind) != len(raw.columns):
            raise ValueError(f"{path} has {len(raw.columns)} columns, not {len(kind)}")
        return text.select(*[F.col(f"`{n}`").cast(f.dataType).alias(f.name) for n, f in zip(raw.columns, kind)])
    # one pass: whether every value of a column is an integer, or a number
    integer = [F.min(F.col(f"`{n}`").rlike(r"^\s*[-+]?\d{1,18}\s*$").cast("int")).alias(f"i{i}") for i, n in enumerate(text.columns)]
    number = [F.min(F.col(f"`{n}`").try_cast("double").isNotNull() | F.col(f"`{n}`").isNull()).cast("int").alias(f"d{i}") for i, n in enumerate(text.columns)]
    found = text.agg(*integer, *number).first()
    kinds = ["long" if found[f"i{i}"] in (1, None) else "double" if found[f"d{i}"] == 1 else "string" for i in range(len(text.columns))]
    return text.select(*[F.trim(F.col(f"`{n}`")).cast(k).alias(n) if k != "string" else F.col(f"`{n}`") for n, k in zip(text.columns, kinds)])


def load_tables(spark: SparkSession, cq: CQ, data_dir: str | None = None) -> dict[str, DataFrame]:
    """The relations that a loaded query file names."""
    out = {}
    for part, atom in zip(cq.files, cq.atoms):
        name = part["file_name"]
        path = f"{data_dir.rstrip('/')}/{name.removeprefix('./')}" if data_dir else name
        out[atom.relation] = read_relation(spark, path, part.get("has_header", True), part.get("file_sep", ","), part.get("schema"), len(atom.variables))
    return out


def open_query(spark: SparkSession, query_file: str, data_dir: str | None = None) -> tuple[CQ, dict[str, DataFrame]]:
    cq = load_query(query_file)
    return cq, load_tables(spark, cq, data_dir)


def relation(spark: SparkSession, variables: Sequence[str], rows: Sequence[Sequence] | Mapping[str, Sequence], schema: str | None = None) -> DataFrame:
    """A relation from row tuples or from columns, checked against ``variables``."""
    if isinstance(rows, Mapping):
        if set(rows) != set(variables):
            raise ValueError(f"columns {sorted(rows)} are not the variables {sorted(variables)}")
        if len({len(x) for x in rows.values()}) > 1:
            raise ValueError("columns differ in length")
        rows = list(zip(*(rows[v] for v in variables)))
    elif isinstance(rows, (str, bytes)) or not isinstance(rows, Sequence):
        raise ValueError("rows are a list of tuples or a dict of columns")
    if any(len(r) != len(variables) for r in rows):
        raise ValueError(f"a row doesn't have {len(variables)} values")
    if not rows:
        return spark.createDataFrame([], schema or ", ".join(f"`{v}` long" for v in variables))
    return spark.createDataFrame([tuple(r) for r in rows], schema or list(variables))


def read_ranks(k_file: str | None = None, k_list: Iterable[int] | None = None) -> list[int]:
    """Ranks of a JSON file, ``[..]`` or ``{"k_list": [..]}``, or else those given."""
    if k_file:
        found = json.loads(Path(k_file).read_text())
        k_list = found["k_list"] if isinstance(found, Mapping) else found
    if k_list is None:
        raise ValueError("neither a file of ranks nor a list")
    return [int(k) for k in k_list]


def write_ranks(folder: str | Path, lists: Mapping[str, Sequence[int]]) -> list[Path]:
    """One JSON file for each named list."""
    out = []
    for name, ks in lists.items():
        path = Path(folder) / f"{name}.json"
        path.write_text(json.dumps(list(ks)))
        out.append(path)
    return out


def _append(path: str | Path, names: Sequence[str], rows: Iterable[Mapping]) -> None:
    path = Path(path)
    new = not path.exists() or not path.stat().st_size
    with path.open("a", newline="", encoding="utf-8") as f:
        writer = csv.DictWriter(f, names)
        if new:
            writer.writeheader()
        writer.writerows({n: r.get(n) for n in names} for r in rows)


def append_timings(path: str | Path, records: Iterable[Mapping]) -> None:
    _append(path, ("timestamp", "exp_id", "trial", "process", "k", "duration_ms"), records)


def append_results(path: str | Path, records: Iterable[Mapping]) -> None:
    """Records of exp_id, k and result; a result that isn't text is written as JSON."""
    _append(path, ("exp_id", "k", "result"), ({**r, "result": r["result"] if isinstance(r["result"], str) else json.dumps(r["result"], default=str)} for r in records))


def write_results(answers: DataFrame, path: str, exp_id: str) -> None:
    """A whole table of answers by rank as CSV files of exp_id, k, result, written by the executors."""
    columns = [F.col(f"`{n}`") for n in answers.columns if n != "k"]
    answers.select(F.lit(exp_id).alias("exp_id"), "k", F.to_json(F.struct(*columns)).alias("result")).write.mode("append").option("header", True).csv(path)
