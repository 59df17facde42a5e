"""Row numbers of a large order, without one task that holds it.

Rows are exchanged by ranges of bucket and order, sorted within each part and written with their number in the part.
A part's numbers begin where those of the parts before it end; those counts are a row a part and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged


def numbered(df: DataFrame, bucket: str, order: list[Column], name: str = "place") -> DataFrame:
    """Adds ``name``, the row's number within its bucket from 1 in the given order (long). The order should be total;
    rows that are equal in it are numbered in any order. A bucket may hold all rows: it is dealt over parts by the
    order. Rows with a null bucket are a bucket of their own."""
    keys = [F.asc_nulls_first(bucket), *order]
    parted = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # monotonically_increasing_id is the part's number, 2**33 times, and the row's number in the part.
    rows = staged(parted.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_at", 33))
    counts = rows.groupBy(F.col(bucket).alias("_bucket"), "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_bucket").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_bucket", F.col("_part").alias("_p"), "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    met = rows.join(offsets, (F.col("_part") == F.col("_p")) & F.col(bucket).eqNullSafe(F.col("_bucket")))
    return met.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).select(*df.columns, name)
