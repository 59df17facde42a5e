"""Ratios, defaults and predicates whose null and zero rules matter.

Missing evidence stays missing: an absent input gives null, never a neutral value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def truthy(x: Column | str) -> Column:
    """Neither null nor zero."""
    return col(x).isNotNull() & (col(x) != 0)


def or_default(x: Column | str, default: Column | float) -> Column:
    """``default`` where x is null or zero."""
    return F.when(truthy(x), col(x)).otherwise(default if isinstance(default, Column) else F.lit(default))


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where either is null or b is zero."""
    return F.try_divide(col(a), F.nullif(col(b), F.lit(0.0)))


def free_cash_flow(operating: Column | str, capex: Column | str) -> Column:
    return col(operating) - col(capex)


def clamp(x: Column | str, low: float, high: float) -> Column:
    return F.when(col(x).isNotNull(), F.least(F.greatest(col(x), F.lit(low)), F.lit(high)))


def override(own: Column | str, default: Column | str, fallback: float = 0.0) -> Column:
    """The row's own value where it is not null, zero included."""
    return F.coalesce(col(own), col(default), F.lit(fallback))


def is_sourced(source_url: Column | str, fetched_at: Column | str) -> Column:
    """Provenance: both are given and not empty."""
    return F.nullif(col(source_url), F.lit("")).isNotNull() & F.nullif(col(fetched_at), F.lit("")).isNotNull()


def contains_any(text: Column | str, markers: Sequence[str]) -> Column:
    """Whether the lower-cased text holds one of the markers; a literal array, so no join."""
    blob = F.lower(col(text))
    return F.exists(F.array(*(F.lit(m.lower()) for m in markers)), lambda m: F.contains(blob, m))


def matching(text: Column | str, markers: Sequence[str]) -> Column:
    """The markers that the lower-cased text holds, in the order given."""
    blob = F.lower(col(text))
    return F.filter(F.array(*(F.lit(m.lower()) for m in markers)), lambda m: F.contains(blob, m))


def contains_term(text: Column | str, term: str) -> Column:
    """Whether a term stands in the text with no word character on either side."""
    return F.regexp_like(col(text), F.lit(r"(?U)(?<!\w)\Q" + term + r"\E(?!\w)"))


def cagr(first: Column | str, last: Column | str, periods: Column | str) -> Column:
    """Compound growth per period; null unless both ends are positive and there is a period."""
    ok = (col(first) > 0) & (col(last) > 0) & (col(periods) > 0)
    return F.when(ok, F.pow(col(last) / col(first), 1.0 / col(periods)) - 1)
