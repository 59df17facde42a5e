"""Intermediate tables in the shared folder of the cluster.

Long plans are cut by writing a table to the folder named by ``spark.checkpoint.dir`` and reading
it back, so a lost executor costs a re-read and not a re-computation.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_BATCH_KEY, _BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. Only where all run in one process (tests) and the session names none is a local one
    made; on a cluster without that setting this is an error."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {_KEY} to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="sieveworks-")
        spark.conf.set(_KEY, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_parquet(df: DataFrame, path: str, batch_rows: int = _BATCH_ROWS) -> None:
    """Write ``df`` with batches to Python of at most ``batch_rows`` rows, so that long texts fit beside each
    other in a worker. The session's own setting holds again afterwards."""
    conf = df.sparkSession.conf
    before = conf.get(_BATCH_KEY)
    conf.set(_BATCH_KEY, str(min(int(before), batch_rows) if int(before) > 0 else batch_rows))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(_BATCH_KEY, before)


def write_table(df: DataFrame, name: str, batch_rows: int = _BATCH_ROWS) -> str:
    """Write ``df`` as Parquet into the shared folder; returns the path."""
    path = new_path(df.sparkSession, name)
    write_parquet(df, path, batch_rows)
    return path


def stage(df: DataFrame, name: str, batch_rows: int = _BATCH_ROWS) -> DataFrame:
    """Cut the lineage of ``df`` by a written table. The schema is given, so no footer is read."""
    path = write_table(df, name, batch_rows)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Stages:
    """Stages that nothing reads any more once the caller is done, and drops them then."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, name: str, batch_rows: int = _BATCH_ROWS) -> DataFrame:
        self.paths.append(write_table(df, name, batch_rows))
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop(self) -> None:
        for path in self.paths:
            drop_path(self.spark, path)
        self.paths.clear()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table of this module once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
