"""Points in time and the intervals that hold them, joined by buckets of time.

An interval is put into each bucket of ``width`` that it touches, a point into its own, so the two meet under key and
bucket, and only what shares a bucket is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendars as C
from .shared import lookup

MOST_INTERVALS = 500_000


def _bucket(at: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(at) / F.lit(seconds * 1_000_000)).cast("long")


def within(points: DataFrame, intervals: DataFrame, point: str, key: str, at: str, seconds: int = 3600, most: int = MOST_INTERVALS) -> DataFrame:
    """``points``: the columns ``point`` (an id), ``key`` and ``at`` (timestamp). ``intervals``: ``key``, starts, ends
    (timestamps, the end exclusive) and columns of their own. Each point with each interval of its key that holds it,
    with nulls where there is none: point, at, key, and the interval's columns. Intervals that are empty or have a
    null end hold nothing."""
    parts = intervals.filter(F.col("starts") < F.col("ends")).withColumn("_bucket", F.explode(F.sequence(_bucket(F.col("starts"), seconds), _bucket(F.col("ends") - F.expr("INTERVAL '0.000001' SECOND"), seconds))))
    rows = points.select(point, key, at).withColumn("_bucket", _bucket(F.col(at), seconds))
    met = lookup(rows, parts, [key, "_bucket"], F.col(point), most)
    own = [c for c in intervals.columns if c != key]
    met = met.filter((F.col("starts") <= F.col(at)) & (F.col(at) < F.col("ends"))).select(point, *own)
    return points.select(point, key, at).join(met, point, "left")


def sessions(days: DataFrame) -> DataFrame:
    """``days``: day (local dates). The trading sessions of every market on those of them that are no weekend: market,
    session (from 1), day, starts, ends (UTC). Times are local, so that they move with daylight saving."""
    number: dict[str, int] = {}
    rows = []
    for market, zone, opens, closes in C.SESSIONS:
        number[market] = number.get(market, 0) + 1
        rows.append(F.struct(F.lit(market).alias("market"), F.lit(number[market]).alias("session"), F.lit(zone).alias("zone"), F.lit(opens).alias("o"), F.lit(closes).alias("c")))
    met = days.filter(~C.is_weekend(F.col("day"))).select("day", F.inline(F.array(*rows)))
    at = lambda minute: F.to_utc_timestamp(F.col("day").cast("timestamp") + F.make_dt_interval(mins=minute), F.col("zone"))
    return met.select("market", "session", "day", at(F.col("o")).alias("starts"), at(F.col("c")).alias("ends"))


def event_sessions(events: DataFrame, point: str, at: str = "at", market: str = "market", **options: int) -> DataFrame:
    """``events``: point, market, at (UTC). Each event with the session that is open then, or nulls: point, market,
    session, day, starts, ends. Days are those of the events, and the ones before and after them."""
    rows = events.select(point, market, at)
    near = rows.filter(F.col(at).isNotNull()).select(F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.date_add(F.col(at).cast("date"), k))).alias("day")).distinct()
    open_then = sessions(near).withColumnRenamed("market", market)
    return within(rows, open_then, point, market, at, **options).select(point, market, "session", "day", "starts", "ends")
