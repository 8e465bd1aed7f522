"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a new local one, if all tasks run
    on this machine (tests); on a cluster that is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_skein_dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark._skein_dir = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/skein/{name}-{uuid.uuid4().hex}"


#: With it Spark removes an execution's shuffle files at its end; else they stay until the driver
#: happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> None:
    conf = df.sparkSession.conf
    was = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, was) if was is not None else conf.unset(CLEANUP)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df under the shared folder and read it back: cuts lineage, survives lost executors, and
    leaves no shuffle files."""
    path = shared_path(df.sparkSession, name)
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of an iteration, of which only the last few are needed: a name's table is
    deleted once ``kept`` newer ones of that name are written."""

    def __init__(self, spark: SparkSession, kept: int = 3):
        self.spark, self.kept, self.paths = spark, kept, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        _write(df, path)
        paths = self.paths.setdefault(name, [])
        paths.append(path)
        while len(paths) > self.kept:
            delete(self.spark, paths.pop(0))
        return self.spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a written table, wherever Spark keeps it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
