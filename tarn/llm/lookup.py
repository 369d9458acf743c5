"""Tables that tasks look up by key in the shared folder.

Where a scan must be joined with a table keyed by blocks of its own rows, that
table is dealt into files by key, and a task reads only those of its blocks.  The
scanned rows are not shuffled, and a lost task reads the same files again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.scratch import fresh_path

#: Bytes of a row group, the least that a lookup reads.
GROUP_BYTES = 4 << 20


def filesystem(uri: str):
    """The Arrow file system and path of a URI (file, hdfs, s3, gs) or local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":/" in uri else "file://" + uri)


_files: dict[str, dict[int, str]] = {}


@dataclass(frozen=True)
class Lookup:
    path: str
    key: str
    ways: int
    schema: pa.Schema

    def rows(self, key: int) -> pa.Table:
        """The rows of this key."""
        from pyarrow import dataset, fs

        system, place = filesystem(self.path)
        if self.path not in _files:  # a worker process lists a folder once
            if len(_files) > 8:
                _files.clear()
            names = [f.path for f in system.get_file_info(fs.FileSelector(place))]
            _files[self.path] = {int(m[1]): n for n in names if (m := re.search(r"/part-(\d+)-[^/]*\.parquet$", n))}
        name = _files[self.path].get(_way(key, self.ways))
        if name is None:
            return self.schema.empty_table()
        found = dataset.dataset(name, self.schema, format="parquet", filesystem=system)
        return found.to_table(filter=dataset.field(self.key) == key)


def _way(key: int, ways: int) -> int:
    return ((key >> 32) * 31 + (key & 0xFFFFFFFF)) % ways


def deal(df: DataFrame, key: str, name: str, ways: int | None = None) -> Lookup:
    """Writes ``df`` dealt by ``key``, a non-negative long whose high half is a partition and whose low half a number in it.

    There is a file for each of ``ways`` (the shuffle partitions, unless given),
    which its number names, and no folder for it.
    """
    spark = df.sparkSession
    ways = ways or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_path(spark, name)
    way = F.pmod(F.shiftright(key, 32) * 31 + F.col(key).bitwiseAND(0xFFFFFFFF), F.lit(ways)).cast("int")
    df.repartitionById(ways, way).sortWithinPartitions(key).write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    if not back.where(way != F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)-", 1).cast("int")).isEmpty():
        raise RuntimeError(f"rows of {name} lie in files of other numbers")
    return Lookup(path, key, ways, to_arrow_schema(df.schema))
