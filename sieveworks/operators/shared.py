"""Tables in the folder that driver and executors share, and the checks before something is broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS = 16
#: Rows a task, where each costs as much as the parsing of a page does.
TASK_ROWS = 20_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it. Only where all run in one
    process (tests) is a local one made; on a cluster without that setting this is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="sieveworks-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table, so that what follows reads the same rows however often it runs."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_of(df: DataFrame, rows: int) -> int:
    """Parts of about ``rows`` rows of a table, at least one a core."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def spread(df: DataFrame, *keys: str, rows: int = TASK_ROWS) -> DataFrame:
    """``df``, which is counted, exchanged by keys into parts of about ``rows`` rows, at least one a core. A small file
    of many rows is one task otherwise, whatever is done with each; and parts of a fixed number grow with the table."""
    return df.repartition(parts_of(df, rows), *keys)


def lookup(rows: DataFrame, small: DataFrame, on: list[str], spread: Column, most: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``small``. Up to ``most`` rows are broadcast, after they are counted. Beyond that both are
    exchanged, each row of ``rows`` to one of a key's parts by ``spread`` and ``small`` to all of them, so that one
    key may hold a third of the rows."""
    if small.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(small), on, how)
    parts = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(parts, [*on, "_salt"], how).drop("_salt")
