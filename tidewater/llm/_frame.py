"""Column access by place, shared storage, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Placed:
    """A frame whose columns have private names, so that no name can clash.

    ``df`` has the columns ``__tw0``, ``__tw1``, ...; ``names[c]`` is the private
    name of the wanted column ``c``: the first of that very name, else the first
    that differs only in case. ``restore`` gives the original names back.
    """

    def __init__(self, df: DataFrame, *wanted: str):
        self.original = list(df.columns)
        self.private = [f"__tw{i}" for i in range(len(self.original))]
        self.df = df.toDF(*self.private)
        self.names = {}
        for w in wanted:
            same = [i for i, c in enumerate(self.original) if c == w] or [i for i, c in enumerate(self.original) if c.lower() == w.lower()]
            if not same:
                raise ValueError(f"column {w!r} is missing; there are {self.original}")
            self.names[w] = self.private[same[0]]

    def __getitem__(self, wanted: str) -> str:
        return self.names[wanted]

    def only(self, *wanted: str) -> DataFrame:
        """The wanted columns alone, under their own names."""
        return self.df.select(*[F.col(self.names[w]).alias(w) for w in wanted or self.names])

    def restore(self, df: DataFrame) -> DataFrame:
        return df.select(*self.private).toDF(*self.original)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; on a single machine, where that may be unset, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not root:
        root = getattr(shared_dir, "own", None)
        if root is None:
            root = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="tidewater-")
            import shutil

            atexit.register(shutil.rmtree, root[7:], ignore_errors=True)
    return root.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tidewater-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: the frame as a table in the shared folder, read again. It survives the loss of executors."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_places(df: DataFrame, *wanted: str) -> DataFrame:
    """The wanted columns, and where each row is stored: ``file`` and ``row``, the same whenever it is read.

    A frame that isn't read straight from Parquet is written first.
    """
    p = Placed(df, *wanted)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        return p.df.select(*[F.col(p[w]).alias(w) for w in wanted], *place)
    except AnalysisException:
        return materialise(p.only(*wanted), "rows").select(*wanted, *place)


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it, of a URI or a local path."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def discard(df: DataFrame | None, *paths: str) -> None:
    """Deletes written tables that nothing reads any more: those at ``paths`` and the one that ``df`` reads."""
    for path in [*paths, *({os.path.dirname(f) for f in df.inputFiles()} if df is not None else ())]:
        system, inner = open_path(path)
        if "tidewater-" in inner and system.get_file_info(inner).type != fs.FileType.NotFound:
            system.delete_dir(inner)


def write_keyed(df: DataFrame, key: str, label: str) -> str:
    """Writes a table with a folder for each value of a text column, for tasks that read single keys of it; its path."""
    path = work_path(df.sparkSession, label)
    df.repartition(key).write.partitionBy(key).parquet(path)
    return path


def read_keyed(path: str, key: str, value: str, columns: list[str] | None = None) -> pa.Table | None:
    """The rows under one key of a table of ``write_keyed``; None if there are none."""
    system, inner = open_path(f"{path}/{key}={value}")
    found = [f.path for f in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)) if f.path.endswith(".parquet")]
    parts = [pq.ParquetFile(system.open_input_file(f)).read(columns) for f in sorted(found)]
    return pa.concat_tables(parts) if parts else None


def broadcast_if(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint only for a table of at most ``max_rows`` rows (counted); else Spark's own choice of join."""
    few = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else df
