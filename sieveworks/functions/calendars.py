"""Lock-in calendars and exchange sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Market, base date, days, event.
LOCKINS = (
    ("IN", "allotment", 30, "half of the anchor shares"), ("IN", "allotment", 90, "rest of the anchor shares"), ("IN", "listing", 179, "holders before the issue, first part"), ("IN", "allotment", 185, "holders before the issue"), ("IN", "listing", 548, "promoters"),
    ("US", "listing", 25, "quiet period"), ("US", "listing", 180, "insiders"), ("HK", "listing", 183, "cornerstones"), ("HK", "listing", 365, "controlling holders"), ("UK", "listing", 180, "directors"),
)
#: Exchange, zone, open, close (minutes of the local day).
SESSIONS = (
    ("US", "America/New_York", 570, 960), ("IN", "Asia/Kolkata", 555, 930), ("UK", "Europe/London", 480, 990), ("JP", "Asia/Tokyo", 540, 690), ("JP", "Asia/Tokyo", 750, 930), ("HK", "Asia/Hong_Kong", 570, 720), ("HK", "Asia/Hong_Kong", 780, 960),
    ("DE", "Europe/Berlin", 540, 1050), ("AU", "Australia/Sydney", 600, 960), ("CA", "America/Toronto", 570, 960), ("SG", "Asia/Singapore", 540, 720), ("SG", "Asia/Singapore", 780, 1020),
)
LOOK_AHEAD = 8


def lockin_events(listings: DataFrame) -> DataFrame:
    """``listings``: id, market, listing, allotment (dates; allotment defaults to listing). One row an event:
    id, event, date, days_from_listing, error. An unknown market, or an allotment after the listing, is an
    error row."""
    rules = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(b).alias("base"), F.lit(d).alias("days"), F.lit(e).alias("event")) for m, b, d, e in LOCKINS))
    rows = listings.withColumn("allotment", F.coalesce("allotment", "listing"))
    own = F.filter(rules, lambda r: r["m"] == F.col("market"))
    bad = F.when(F.size(own) == 0, "unknown market").when(F.col("allotment") > F.col("listing"), "allotment after listing")
    rows = rows.withColumn("error", bad).withColumn("r", F.explode_outer(F.when(F.col("error").isNull(), own)))
    base = F.when(F.col("r.base") == "allotment", F.col("allotment")).otherwise(F.col("listing"))
    rows = rows.withColumn("date", F.date_add(base, F.col("r.days")))
    return rows.select("id", F.col("r.event").alias("event"), "date", F.date_diff("date", "listing").alias("days_from_listing"), "error")


def is_weekend(day: Column) -> Column:
    return F.weekday(day) >= 5


def session_status(instants: DataFrame) -> DataFrame:
    """``instants``: id, market, at (UTC). Adds status (open, before the open, midday break, after the close,
    weekend, unknown market), next_open (UTC) and days_ahead: the earliest start strictly later, within
    eight local days, weekends skipped. Sessions are a literal array, so nothing is joined or shuffled."""
    table = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(z).alias("zone"), F.lit(o).alias("open"), F.lit(c).alias("close")) for m, z, o, c in SESSIONS))
    rows = instants.withColumn("s", F.filter(table, lambda s: s["m"] == F.col("market"))).withColumn("zone", F.get(F.col("s.zone"), F.lit(0)))
    rows = rows.withColumn("local", F.from_utc_timestamp(F.col("at").cast("timestamp"), F.coalesce("zone", F.lit("UTC"))))
    minute = F.hour("local") * 60 + F.minute("local")
    rows = rows.withColumns({"day": F.col("local").cast("date"), "minute": minute})
    inside = F.exists("s", lambda s: (s["open"] <= F.col("minute")) & (F.col("minute") < s["close"]))
    status = (
        F.when(F.size("s") == 0, "unknown market").when(is_weekend(F.col("day")), "weekend").when(inside, "open")
        .when(F.col("minute") < F.array_min("s.open"), "before the open").when(F.col("minute") >= F.array_max("s.close"), "after the close").otherwise("midday break")
    )

    def starts(k: Column) -> Column:
        d = F.date_add(F.col("day"), k)
        return F.transform("s", lambda s: F.when(~is_weekend(d), F.struct(F.to_utc_timestamp(d.cast("timestamp") + F.make_dt_interval(mins=s["open"]), F.col("zone")).alias("t"), k.alias("k"))))

    coming = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LOOK_AHEAD - 1)), starts))
    later = F.array_min(F.filter(coming, lambda x: x.isNotNull() & (x["t"] > F.col("at").cast("timestamp"))))
    return rows.withColumns({"status": status, "n": later}).select(*instants.columns, "status", F.col("n.t").alias("next_open"), F.col("n.k").alias("days_ahead"))


def day_first(texts: Column) -> Column:
    """Whether dates written a/b/year stand day first: true if any first part is over 12, false if any second
    is, null if nothing tells. For use in an aggregate."""
    first, second = F.regexp_extract(texts, r"^(\d{1,2})[/.-](\d{1,2})[/.-]\d{2,4}$", 1).try_cast("int"), F.regexp_extract(texts, r"^(\d{1,2})[/.-](\d{1,2})[/.-]\d{2,4}$", 2).try_cast("int")
    return F.when(F.max(first) > 12, True).when(F.max(second) > 12, False)
