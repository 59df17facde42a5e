"""Structured Streaming forms of the batch operators that have one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basic import safe_ratio


def ok_rate(samples: DataFrame, late: str = "10 minutes", width: str = "10 minutes") -> DataFrame:
    """``samples``: ts, url, status. Share of good answers by window and url; later rows are dropped by the
    watermark."""
    good = F.avg(F.when(F.col("status").between(200, 399), 1.0).otherwise(0.0))
    return samples.withWatermark("ts", late).groupBy(F.window("ts", width), "url").agg(F.count(F.lit(1)).alias("samples"), good.alias("ok_rate"))


def daily_mean(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Seven-day means by kind, one a day."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "7 days", "1 day"), "event_type").agg(F.avg("value").alias("mean"))


def cross_check(left: DataFrame, right: DataFrame, late: str = "30 minutes", apart: str = "5 minutes") -> DataFrame:
    """Prices of two venues of one symbol within ``apart``: a stream-stream join bounded by time, so state is."""
    a = left.withWatermark("ts", late).select(F.col("symbol").alias("symbol"), F.col("ts").alias("ts_a"), F.col("price").alias("price_a"))
    b = right.withWatermark("ts", late).select(F.col("symbol").alias("symbol_b"), F.col("ts").alias("ts_b"), F.col("price").alias("price_b"))
    near = F.expr(f"symbol = symbol_b AND ts_b BETWEEN ts_a - INTERVAL {apart} AND ts_a + INTERVAL {apart}")
    low, high = F.least("price_a", "price_b"), F.greatest("price_a", "price_b")
    return a.join(b, near).select("symbol", "ts_a", "ts_b", (safe_ratio(high - low, low) * 100.0).alias("spread_pct"))


def fresh_and_late(feed: DataFrame, now: str, most_age: str = "30 minutes") -> tuple[DataFrame, DataFrame]:
    """Rows of a feed that are fresh at ``now``, and the others for a side table."""
    old = F.col("ts") < F.expr(f"TIMESTAMP '{now}' - INTERVAL {most_age}")
    return feed.filter(~old), feed.filter(old)
