"""Issue, valuation, supply and position arithmetic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .basic import safe_ratio, truthy

#: Drawdown by asset tier, total cap by band, per-asset cap by tier.
DRAWDOWN = {"major": 0.80, "large": 0.85, "mid": 0.90, "small": 0.95, "micro": 1.00}
BAND_CAP = {"resilient": 0.20, "moderate": 0.10, "fragile": 0.05}
ASSET_CAP = {"major": 0.40, "large": 0.25, "mid": 0.15, "small": 0.10, "micro": 0.05}
#: Growth bands of the implied rate, with their lower bounds.
GROWTH_BANDS = ((0.0, "shrinking"), (0.05, "modest"), (0.10, "moderate"), (0.15, "demanding"), (0.25, "very demanding"))


def present_value(fcf: Column, growth: Column, discount: Column, terminal: Column, years: int, fade: bool = False) -> Column:
    """Two-stage value: ``years`` flows at a growth rate (with ``fade``, moving evenly to the terminal rate)
    and a terminal value. A fold over the years; null where discount <= terminal."""
    start = F.struct(fcf.cast("double").alias("f"), F.lit(1.0).cast("double").alias("d"), F.lit(0.0).cast("double").alias("v"))

    def step(acc: Column, t: Column) -> Column:
        g = growth + (terminal - growth) * (t - 1) / float(max(years - 1, 1)) if fade else growth
        f, d = acc["f"] * (1.0 + g), acc["d"] * (1.0 + discount)
        return F.struct(f.alias("f"), d.alias("d"), (acc["v"] + f / d).alias("v"))

    def finish(acc: Column) -> Column:
        return acc["v"] + acc["f"] * (1.0 + terminal) / (discount - terminal) / acc["d"]

    return F.when(discount > terminal, F.aggregate(F.sequence(F.lit(1), F.lit(years)), start, step, finish))


def implied_growth(value: Column, fcf: Column, discount: Column, terminal: Column, years: int, fade: bool = False, low: float = -0.90, high: float = 2.00, steps: int = 60) -> Column:
    """Growth at which present_value is ``value``, by bisection (60 halvings reach double precision) of a batch of
    rows at once; null for inputs without meaning or a value outside the interval."""

    def solved(value: pd.Series, fcf: pd.Series, discount: pd.Series, terminal: pd.Series) -> pd.Series:
        v, f0, d, t = (x.to_numpy(dtype="float64", na_value=np.nan) for x in (value, fcf, discount, terminal))
        ok = (f0 > 0) & (v > 0) & (d > t)
        with np.errstate(all="ignore"):
            factors = [(1.0 + d) ** k for k in range(1, years + 1)]

            def at(g: np.ndarray) -> np.ndarray:
                f, total = f0, 0.0
                for k in range(years):
                    f = f * (1.0 + (g + (t - g) * k / float(max(years - 1, 1)) if fade else g))
                    total = total + f / factors[k]
                return total + f * (1.0 + t) / (d - t) / factors[-1]

            lo, hi = np.full(len(v), low), np.full(len(v), high)
            ok &= (at(lo) <= v) & (at(hi) >= v)
            for _ in range(steps):
                mid = (lo + hi) / 2.0
                below = at(mid) < v
                lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        return pd.Series(np.where(ok, (lo + hi) / 2.0, np.nan))

    return F.pandas_udf(solved, "double")(*(c.cast("double") for c in (value, fcf, discount, terminal)))


def read_growth(growth: Column) -> Column:
    out = F.when(growth.isNull(), F.lit(None).cast("string"))
    for bound, name in GROWTH_BANDS:
        out = out.when(growth < bound, name)
    return out.otherwise("extreme")


def fresh_share(fresh: Column, sale: Column) -> Column:
    """Percentage of an issue that is new money."""
    return safe_ratio(fresh, fresh + sale) * 100.0


def fresh_band(percent: Column) -> Column:
    return F.when(percent.isNull(), F.lit(None).cast("string")).when(percent < 25, "mostly exit").when(percent < 60, "mixed").otherwise("mostly fresh")


def price_to_earnings(price: Column, eps: Column) -> Column:
    """Null where earnings are not positive."""
    return F.when(eps > 0, price / eps)


def band_ends(text: Column) -> tuple[Column, Column]:
    """Both ends of ``100-105`` or ``105``."""
    parts = F.split(text, "-")
    return F.trim(parts[0]).try_cast("double"), F.trim(F.element_at(parts, -1)).try_cast("double")


def fully_diluted(price: Column, circulating: Column, total: Column, most: Column) -> dict[str, Column]:
    """Market capitalisation, fully diluted value, their ratio, float, drag and rise to stand still."""
    full = F.coalesce(F.when(truthy(most), most), F.when(truthy(total), total))
    mcap, fdv = price * circulating, price * full
    ratio = safe_ratio(fdv, mcap)
    return {"mcap": mcap, "fdv": fdv, "ratio": ratio, "float_pct": safe_ratio(circulating, full) * 100.0, "rise_pct": (ratio - 1.0) * 100.0, "drag_pct": (1.0 - safe_ratio(circulating, full)) * 100.0}


def infer_tier(rank: Column, mcap: Column) -> Column:
    return F.when(rank <= 2, "major").when(rank <= 20, "large").when(rank <= 100, "mid").when(mcap < 50e6, "micro").otherwise("small")


def by_name(name: Column, values: dict[str, float]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for k, v in values.items():
        out = out.when(name == k, F.lit(v).cast("double"))
    return out


def spread_percent(low: Column, high: Column, count: Column) -> Column:
    """Relative spread of two or more prices; null where there are fewer, or where the lowest is zero (no price)."""
    return F.when(count >= 2, safe_ratio(high - low, low) * 100.0)


def returns_on_capital(ebit: Column, interest: Column, debt: Column, equity: Column, cash: Column, depreciation: Column, tax: float) -> dict[str, Column]:
    """Return on invested capital, on capital employed and on equity, interest cover, and net debt to EBITDA;
    null where a divisor is zero or missing."""
    return {
        "roic": safe_ratio(ebit * (1.0 - tax), debt + equity - cash), "roce": safe_ratio(ebit, debt + equity), "roe": safe_ratio((ebit - interest) * (1.0 - tax), equity),
        "cover": safe_ratio(ebit, interest), "leverage": safe_ratio(debt - cash, ebit + depreciation),
    }
