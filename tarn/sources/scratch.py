"""Places for intermediate tables that every executor can reach.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, the folder
that the cluster shares, or the session's own checkpoint folder.  Only where
neither is set and the master is local (tests) a fresh temporary folder is used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        found = context._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = context.applicationId
        base = _local.get(app) or _local.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tarn-"))
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    The files survive the loss of executors, and their size gives the planner
    the statistics by which it may choose a broadcast.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes tables that :func:`written` returned (or paths), once nothing that is still to run reads them."""
    for table in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table if isinstance(table, str) else table.scratch_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
