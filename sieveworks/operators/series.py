"""Financial series: ratios by year, growth, and typed flags; unlock schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basic import cagr, free_cash_flow, safe_ratio, truthy


def yearly_ratios(years: DataFrame) -> DataFrame:
    """``years``: id, year, revenue, net_income, cfo, capex, receivables, inventory, debt, equity, shares."""
    c = F.col
    return years.withColumns({
        "fcf": free_cash_flow("cfo", "capex"), "margin": safe_ratio("net_income", "revenue"), "conversion": safe_ratio("cfo", "net_income"),
        "receivable_share": safe_ratio("receivables", "revenue"), "inventory_share": safe_ratio("inventory", "revenue"), "leverage": safe_ratio("debt", "equity"), "fcf_margin": safe_ratio(free_cash_flow("cfo", "capex"), c("revenue")),
    })


def _ends(name: str) -> list[Column]:
    """First and last value, and the first and last that are not null, by year."""
    v, y = F.col(name), F.col("year")
    known = F.when(v.isNotNull(), y)
    return [
        F.min_by(v, y).alias(f"{name}_first"), F.max_by(v, y).alias(f"{name}_last"),
        F.min_by(v, known).alias(f"{name}_first_known"), F.max_by(v, known).alias(f"{name}_last_known"), F.count(v).alias(f"{name}_known"),
    ]


def quality_flags(years: DataFrame) -> DataFrame:
    """id, ord, severity, name: one row a flag. Ids with fewer than two years give ``too few years``.

    One aggregation by id: first and last values are aggregates (min_by, max_by), so no sort is needed."""
    rows = yearly_ratios(years)
    names = ("revenue", "net_income", "cfo", "receivables", "inventory_share", "leverage", "margin", "shares")
    a = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("cfo"), F.lit(0.0)).alias("cfo_sum"), F.coalesce(F.sum("net_income"), F.lit(0.0)).alias("ni_sum"), *[x for n in names for x in _ends(n)])
    c = F.col
    span = c("n") - 1

    def growth(name: str) -> Column:
        return cagr(f"{name}_first", f"{name}_last", span)

    share = F.when(truthy("cfo_sum") & truthy("ni_sum"), c("cfo_sum") / c("ni_sum"))
    four = truthy("net_income_first") & truthy("net_income_last") & truthy("cfo_first") & truthy("cfo_last")
    gap = growth("receivables") - growth("revenue")
    last, first = c("leverage_last_known"), c("leverage_first_known")
    flag = lambda o, s, n: F.struct(F.lit(o).alias("ord"), F.lit(s).alias("severity"), F.lit(n).alias("name"))
    flags = F.array_compact(F.array(
        F.when(share < 0.8, flag(1, "HIGH", "cash conversion")).when(share < 1.0, flag(1, "MEDIUM", "cash conversion")),
        F.when(four & (c("net_income_last") > c("net_income_first")) & (c("cfo_last") < c("cfo_first")), flag(2, "HIGH", "profit up, cash down")),
        F.when(gap > 0.10, flag(3, "HIGH", "receivables")).when(gap > 0.05, flag(3, "MEDIUM", "receivables")),
        F.when((c("inventory_share_known") >= 2) & (c("inventory_share_last_known") > 1.25 * c("inventory_share_first_known")), flag(4, "MEDIUM", "inventory")),
        F.when((c("leverage_known") >= 2) & (last > 2.0), flag(5, "HIGH", "leverage")).when((c("leverage_known") >= 2) & (last > 1.5 * first) & (last > 0.5), flag(5, "MEDIUM", "leverage")),
        F.when((c("margin_known") >= 2) & (c("margin_last_known") < c("margin_first_known") - 0.02), flag(6, "MEDIUM", "margins")),
        F.when(growth("shares") > 0.03, flag(7, "MEDIUM", "dilution")),
    ))
    flags = F.when(c("n") < 2, F.array(flag(0, "ERROR", "too few years"))).otherwise(flags)
    return a.select("id", F.inline(flags))


def growth_rates(years: DataFrame) -> DataFrame:
    a = years.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *[x for n in ("revenue", "net_income", "receivables", "shares") for x in _ends(n)[:2]])
    return a.select("id", *(cagr(f"{n}_first", f"{n}_last", F.col("n") - 1).alias(n) for n in ("revenue", "net_income", "receivables", "shares")))


def unlock_horizons(unlocks: DataFrame, tokens: DataFrame, today: Column) -> DataFrame:
    """``unlocks``: id, date (string), tokens; ``tokens``: id, circulating, price. Tokens and percentage of
    float within 30, 90 and 365 days, nearest and largest cliff of 5 % or more. Dates that don't parse, lie
    in the past or free nothing are left out."""
    days = F.date_diff(F.try_to_date("date"), today)
    rows = unlocks.withColumn("days", days).filter("days >= 0 and tokens > 0").join(tokens, "id")
    pct = safe_ratio(F.col("tokens"), F.col("circulating")) * 100.0
    rows = rows.withColumn("pct", pct)
    cliff = F.when(F.col("pct") >= 5, F.col("days"))
    d = lambda k: F.coalesce(F.sum(F.when(F.col("days") <= k, F.col("tokens"))), F.lit(0.0))
    return rows.groupBy("id").agg(
        *(d(k).alias(f"within_{k}") for k in (30, 90, 365)), F.max("circulating").alias("circulating"),
        F.min(cliff).alias("nearest_cliff"), F.max_by("days", F.when(F.col("pct") >= 5, F.struct("pct", (-F.col("days")).alias("d")))).alias("largest_cliff"),
    ).select("id", "within_30", "within_90", "within_365", *((safe_ratio(f"within_{k}", "circulating") * 100.0).alias(f"pct_{k}") for k in (30, 90, 365)), "nearest_cliff", "largest_cliff")


def first_unlocks(unlocks: DataFrame, k: int = 8) -> DataFrame:
    """The first k unlocks of each id by days, ties by size."""
    place = F.row_number().over(Window.partitionBy("id").orderBy("days", F.desc("tokens"), "pos"))
    return unlocks.withColumn("place", place).filter(F.col("place") <= k)


def rolling_mean(rows: DataFrame, key: str, day: str, value: str, width: int = 7) -> DataFrame:
    """Mean over the last ``width`` calendar days, and its change to the mean ``width`` days before."""
    span = Window.partitionBy(key).orderBy(F.unix_date(day)).rangeBetween(-(width - 1), 0)
    out = rows.withColumn("mean", F.avg(value).over(span))
    before = Window.partitionBy(key).orderBy(F.unix_date(day)).rangeBetween(-width, -width)
    return out.withColumn("before", F.max("mean").over(before)).withColumn("change_pct", safe_ratio(F.col("mean") - F.col("before"), F.col("before")) * 100.0)


def volume_ratio(rows: DataFrame, key: str, order: str, value: str, back: int = 20) -> DataFrame:
    """Value over the mean of the ``back`` rows before it."""
    span = Window.partitionBy(key).orderBy(order).rowsBetween(-back, -1)
    return rows.withColumn("normal", F.avg(value).over(span)).withColumn("ratio", safe_ratio(F.col(value), F.col("normal")))


def top_share(rows: DataFrame, key: str, value: str, tie: str, k: int = 10) -> DataFrame:
    """Share of the k largest holders, and whether it is over half."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(value), tie))
    ranked = rows.withColumn("_k", place)
    out = ranked.groupBy(key).agg(F.sum(F.when(F.col("_k") <= k, F.col(value).cast("decimal(18,4)"))).alias("t"), F.sum(F.col(value).cast("decimal(18,4)")).alias("a"))
    share = safe_ratio(F.col("t").cast("double"), F.col("a").cast("double")) * 100.0
    return out.select(key, share.alias("share_pct"), (share > 50).alias("concentrated"))
