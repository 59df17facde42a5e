"""Gates override scores; of several caps the tightest wins and is named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import finance as N
from ..functions.basic import or_default


def assess_position(profiles: DataFrame) -> DataFrame:
    """``profiles``: id, portfolio, max_loss_usd, max_loss_pct, horizon, emergency, income, existing,
    leverage, needed_within, veteran, tier. Adds gates, warnings, points, band, the caps by loss,
    exposure and concentration, binding, size (0 behind a gate) and error. Null size with an error."""
    zero = F.lit(0.0)
    budget = F.coalesce(F.col("max_loss_usd"), F.col("portfolio") * F.col("max_loss_pct") / 100.0)
    c = F.col
    points = (
        F.when(c("emergency") >= 6, 1).otherwise(0) + F.when(c("income") == "stable", 1).when(c("income") == "none", -1).otherwise(0)
        + F.when(c("horizon") >= 24, 1).otherwise(0) + F.when(c("veteran"), 1).otherwise(0) - F.when(c("leverage"), 1).otherwise(0)
    )
    out = profiles.withColumns({
        "budget": budget, "points": points,
        "gates": F.array_compact(F.array(
            F.when(F.coalesce("emergency", zero) < 3, "emergency fund"), F.when(c("needed_within") <= F.coalesce("horizon", zero), "needed within the horizon"),
            F.when(c("needed_within") <= 12, "needed within a year"),
        )),
        "warnings": F.array_compact(F.array(
            F.when(budget > c("portfolio") * 0.5, "loss over half of the portfolio"), F.when(c("leverage"), "leverage"), F.when(c("income") == "none", "no income"),
        )),
    })
    out = out.withColumn("band", F.when(c("points") >= 3, "resilient").when(c("points") >= 1, "moderate").otherwise("fragile"))
    total = c("portfolio") * N.by_name(c("band"), N.BAND_CAP)
    out = out.withColumns({
        "loss_cap": c("budget") / N.by_name(c("tier"), N.DRAWDOWN),
        "exposure_cap": F.greatest(zero, total - F.coalesce("existing", zero)),
        "concentration_cap": total * N.by_name(c("tier"), N.ASSET_CAP),
    })
    least = F.least("loss_cap", "exposure_cap", "concentration_cap")
    # The first of equal caps gives the name.
    binding = F.when(c("loss_cap") == least, "loss").when(c("exposure_cap") == least, "exposure").otherwise("concentration")
    error = F.when(c("budget").isNull(), "no loss budget").when(N.by_name(c("tier"), N.DRAWDOWN).isNull(), "unknown tier")
    return out.withColumns({"error": error, "binding": F.when(error.isNull(), binding), "size": F.when(error.isNull(), F.when(F.size("gates") > 0, zero).otherwise(least))})


def loss_scenarios(sized: DataFrame) -> DataFrame:
    """Four drops of each position: id, drop, loss, within (its loss budget, with 1e-9 slack)."""
    rows = sized.select("id", "size", "budget", F.explode(F.array(*(F.lit(x) for x in (0.3, 0.5, 0.8, 1.0)))).alias("drop"))
    return rows.select("id", "drop", (F.col("size") * F.col("drop")).alias("loss"), (F.col("size") * F.col("drop") <= F.col("budget") + 1e-9).alias("within"))


def check_feed(feeds: DataFrame, most_age: float = 30.0, warn: float = 1.0, fail: float = 5.0, age_unknown_passes: bool = False) -> DataFrame:
    """``feeds``: id, price, age_min, venues, low, high, turnover. Adds spread, problems, warnings, ok and
    status (0 clean, 2 with warnings, 3 with problems). An unknown age is a problem unless asked otherwise."""
    spread = N.spread_percent(F.col("low"), F.col("high"), F.col("venues"))
    stale = F.col("age_min") > most_age
    out = feeds.withColumn("spread", spread)
    problems = F.array_compact(F.array(F.when(or_default("price", 0.0) == 0, "no price"), F.when(stale if age_unknown_passes else F.coalesce(stale, F.lit(True)), "stale"), F.when(F.col("spread") > fail, "diverging")))
    warnings = F.array_compact(F.array(
        F.when(F.col("spread") > warn, "spread"), F.when(F.coalesce("venues", F.lit(0)) < 2, "no cross-check"), F.when((F.col("turnover") < 0.005) | (F.col("turnover") > 2.0), "turnover"),
    ))
    out = out.withColumns({"problems": problems, "warnings": warnings})
    status = F.when(F.size("problems") > 0, 3).when(F.size("warnings") > 0, 2).otherwise(0)
    return out.withColumns({"ok": F.size("problems") == 0, "status": status})


#: Weights of the six dimensions and the lower bounds of verdicts.
WEIGHTS = {"value_capture": 0.25, "supply": 0.20, "network": 0.20, "security": 0.15, "liquidity": 0.10, "team": 0.10}
VERDICTS = ((8.0, "strong"), (6.5, "good"), (5.0, "mixed"), (3.5, "weak"))
STOCK_VERDICTS = ((8.0, "strong"), (6.5, "good"), (5.0, "mixed"))


def weighted_score() -> Column:
    out = F.lit(0.0)
    for k, w in WEIGHTS.items():
        out = out + F.col(k) * w
    return out


def capped_score(verifiable: Column, terminal: Column) -> Column:
    """The weighted score under its caps; null behind a terminal flag."""
    dims = [F.col(k) for k in WEIGHTS]
    caps = [F.when(F.least(*dims) <= 2, 4.0), F.when(F.col("value_capture") <= 3, 5.0), F.when(~verifiable, 6.0)]
    return F.when(~F.coalesce(terminal, F.lit(False)), F.least(weighted_score(), *caps))


def verdict(score: Column, bands: tuple[tuple[float, str], ...] = VERDICTS) -> Column:
    out = F.when(score.isNull(), "no rating")
    for bound, name in bands:
        out = out.when(score >= bound, name)
    return out.otherwise("avoid")


def vetoed(score: Column, least: Column, veto: float = 2.0, cap: float = 4.0) -> Column:
    """A dimension at or below the veto caps the whole."""
    return F.when(least <= veto, F.least(score, F.lit(cap))).otherwise(score)
