"""Lineage cuts that survive the loss of an executor.

Intermediate tables go to the folder that the cluster names in ``spark.checkpoint.dir``. Where that is unset, a
local folder is made up, but only if everything runs in one process (tests, a laptop): elsewhere other machines would not see it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder for intermediate tables, one below it for each application."""
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        root = _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="loomlog-"))
    return f"{root.rstrip('/')}/loomlog/{app}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def write_table(df: DataFrame, label: str, parts: int | None = None) -> str:
    """Write ``df``; ``parts``: the most files, for tables whose size is known to be small."""
    path = new_path(df.sparkSession, label)
    (df.coalesce(parts) if parts else df).write.option("compression", "zstd").parquet(path)
    return path


def stage(df: DataFrame, label: str, parts: int | None = None) -> DataFrame:
    """Write ``df`` once and return a reader of the written rows."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, label, parts))


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Staged tables of one operator; on leaving, those go that its result does not read (see ``keep``)."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def stage(self, df: DataFrame, label: str, parts: int | None = None, keep: bool = False) -> DataFrame:
        path = write_table(df, label, parts)
        if not keep:
            self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            remove(self.spark, path)
