"""Confidence bounds, ownership cost and flags of rated products; pricing of metered offers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basic import clamp, col, or_default, override, safe_ratio, truthy

#: Viability limit of the block rate, its clamp, and the ways an offer is priced.
VIABLE_BLOCK_RATE = 0.50
MOST_BLOCK_RATE = 0.99
UNITS = ("per_gb", "per_ip", "per_1k_requests", "per_credit", "flat_monthly", "per_page")


def wilson_lower(share: Column | str, n: Column | str, z: float = 1.96) -> Column:
    """Lower bound of the Wilson interval; 0 without observations, never below 0."""
    p, m = col(share), col(n).cast("double")
    spread = z * F.sqrt(p * (1.0 - p) / m + z * z / (4.0 * m * m))
    bound = (p + z * z / (2.0 * m) - spread) / (1.0 + z * z / m)
    return F.when(m > 0, F.greatest(bound, F.lit(0.0))).otherwise(F.lit(0.0))


def max_one_star_share(rating: Column | str, n: Column | str) -> Column:
    """Greatest share of one-star ratings that a rounded average allows."""
    m = col(n).cast("double")
    return F.when(m > 0, F.greatest(F.floor(m * (5.0 - col(rating) + 0.05) / 4.0).cast("double") / m, F.lit(0.0))).otherwise(F.lit(0.0))


def positive_share(four_five: Column | str, total: Column | str, rating: Column | str) -> Column:
    """Share of four and five stars from a histogram, else (rating - 1) / 4 within [0, 1]."""
    from_stars = F.when(truthy(total), col(four_five) / col(total))
    return F.coalesce(from_stars, clamp((col(rating) - 1.0) / 4.0, 0.0, 1.0))


def star_flags(n: Column, one: Column, middle: Column, five: Column, total: Column, rating: Column) -> Column:
    """Reasons to distrust a rating, as an array of names.

    With a histogram: polarised, near-unanimous, too few one-star, thin and clean. Without: an average
    that leaves almost no room for one star, else a thin count with a high average."""
    has = F.coalesce(total > 0, F.lit(False))
    top, mid, low = five / total, middle / total, one / total
    with_stars = F.array_compact(F.array(
        F.when((top > 0.85) & (mid < 0.12), F.lit("polarised")),
        F.when(top > 0.92, F.lit("near_unanimous")),
        F.when((n >= 200) & (low < 0.01), F.lit("no_one_star")),
        F.when((n > 0) & (n < 100) & (top > 0.85), F.lit("thin_and_clean")),
    ))
    tight = (n > 0) & (max_one_star_share(rating, n) < 0.05)
    without = F.when(tight, F.array(F.lit("no_room_for_one_star"))).when((n > 0) & (n < 200) & (rating >= 4.6), F.array(F.lit("thin_and_high"))).otherwise(F.array().cast("array<string>"))
    return F.when(has, with_stars).otherwise(without)


def total_cost(price: Column, yearly: Column, once: Column, shipping: Column, risk: Column, warranty: Column, resale: Column, years: Column) -> Column:
    """Price, running cost, accessories, shipping and out-of-warranty risk, less resale; null price, null cost."""
    exposed = F.when(F.coalesce(warranty, F.lit(0.0)) < years, F.coalesce(risk, F.lit(0.0))).otherwise(F.lit(0.0))
    zero = F.lit(0.0)
    return price + F.coalesce(yearly, zero) * years + F.coalesce(once, zero) + F.coalesce(shipping, zero) + exposed - F.coalesce(resale, zero)


def value_per_thousand(adjusted: Column, cost: Column) -> Column:
    return F.when(truthy(cost), adjusted / (cost / 1000.0))


def attempts(pages: Column, block_rate: Column) -> Column:
    """Requests needed for so many pages when a share of them is blocked."""
    return pages / (1.0 - clamp(block_rate, 0.0, MOST_BLOCK_RATE))


def unit_price(unit: Column, price: Column, ip_count: Column, tries: Column, gigabytes: Column) -> Column:
    """Monthly price by unit; null for an unknown unit or addresses without a count."""
    return (
        F.when(unit == "per_gb", price * gigabytes)
        .when(unit == "per_ip", price * ip_count)
        .when(unit == "per_1k_requests", price * tries / 1000.0)
        .when(unit == "per_credit", price * tries)
        .when(unit == "flat_monthly", price)
        .when(unit == "per_page", price * tries)
    )


def offer_total(infra: Column, minimum: Column, setup_hours: Column, upkeep_hours: Column, hourly: Column, months: Column) -> Column:
    """Infrastructure with its minimum, set-up once and upkeep each month."""
    monthly = F.greatest(infra, F.coalesce(minimum, F.lit(0.0)))
    return monthly * months + F.coalesce(setup_hours, F.lit(0.0)) * hourly + F.coalesce(upkeep_hours, F.lit(0.0)) * hourly * months


def html_only(gigabytes: Column, share: Column, unit: Column) -> Column:
    """Traffic when only documents are fetched; null where the share is unknown or near one."""
    return F.when((unit == "per_gb") & share.isNotNull() & (share < 0.99), gigabytes * share)


def rounded_requests(size: Column, block: float = 100_000.0) -> Column:
    """Bytes billed when each request is rounded up to a block."""
    return F.ceil(size / block) * block


__all__ = ["attempts", "clamp", "html_only", "max_one_star_share", "offer_total", "or_default", "override", "positive_share", "rounded_requests", "safe_ratio", "star_flags", "total_cost", "unit_price", "value_per_thousand", "wilson_lower"]
