"""Late rows of a stream, kept instead of dropped.

A watermark drops what comes after it without a trace. Here a stateful operator remembers, for each key, the latest
time seen in the micro-batches before, and marks the rows that are older than that by more than a delay. Rows of both
kinds are written in one go to a folder a micro-batch, so a micro-batch that runs again replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType


def marked_late(stream: DataFrame, key: str, at: str, delay_seconds: int, parts: int = 1) -> DataFrame:
    """Adds late: whether a row is more than ``delay_seconds`` older than the latest row of its key in the
    micro-batches before. ``parts`` deals a key's rows over so many states by their content, for keys that hold much
    of a stream; each has a latest time of its own. Rows without a time are late; rows with a null key are a key's.
    State is one number a key and part; a key's rows pass through in batches and are never gathered."""
    part = F.pmod(F.xxhash64(*stream.columns), F.lit(parts)).cast("int") if parts > 1 else F.lit(0)
    schema = StructType([*stream.schema.fields, StructField("late", BooleanType())])

    def mark(_key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (before,) = state.get if state.exists else (None,)
        latest = before
        for pdf in batches:
            times = pd.to_datetime(pdf[at])
            late = times.isna() if before is None else times.isna() | (times < pd.Timestamp(before, unit="us") - pd.Timedelta(seconds=delay_seconds))
            yield pdf.drop(columns=["_part"]).assign(late=late)
            if times.notna().any():
                top = int(times.max().as_unit("us").asm8.astype("int64"))
                latest = top if latest is None else max(latest, top)
        if latest is not None:
            state.update((latest,))

    return stream.withColumn("_part", part).groupBy(key, "_part").applyInPandasWithState(mark, schema, "latest long", "append", GroupStateTimeout.NoTimeout)


def write_both(marked: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Writes a stream with ``late`` below ``path``, a folder a micro-batch and kind."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("late").parquet(f"{path}/batch={number}")

    return marked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_side(spark: SparkSession, path: str, late: bool) -> DataFrame:
    """The rows that were on time, or those for the side table; only that half of the folders is read."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").filter(F.col("late") == late).drop("late")
