"""Evidence-gated ranking: rows are parted into buckets first, then each bucket has its own order.

A row without provenance or with an error is listed but not ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.basic import is_sourced, or_default, override
from .ordering import numbered


def evaluate_products(products: DataFrame, years: float = 3.0, floor: float = 0.7) -> DataFrame:
    """``products``: id, price, rating, n, star1..star5 (nullable), yearly, once, shipping, risk, warranty,
    resale, source_url, fetched_at. Adds flags, share, adjusted, cost, value, errors and bucket:
    meets, below, suspect or unranked."""
    stars = [F.coalesce(F.col(f"star{k}"), F.lit(0)) for k in range(1, 6)]
    total = stars[0] + stars[1] + stars[2] + stars[3] + stars[4]
    share = S.positive_share(stars[3] + stars[4], total, F.col("rating"))
    errors = F.array_compact(F.array(
        F.when(F.col("rating").isNull() | (or_default("n", 0) == 0), F.lit("no rating or review count")),
        F.when(F.col("price").isNull(), F.lit("no price")),
    ))
    out = products.withColumns({
        "flags": S.star_flags(F.coalesce("n", F.lit(0)), stars[0], stars[1] + stars[2] + stars[3], stars[4], total, F.col("rating")),
        "share": share,
        "adjusted": S.wilson_lower(share, F.coalesce("n", F.lit(0))),
        "cost": S.total_cost(F.col("price"), F.col("yearly"), F.col("once"), F.col("shipping"), F.col("risk"), F.col("warranty"), F.col("resale"), F.lit(years)),
        "errors": errors,
    })
    out = out.withColumn("value", S.value_per_thousand(F.col("adjusted"), F.col("cost")))
    rankable = is_sourced("source_url", "fetched_at") & (F.size("errors") == 0)
    bucket = F.when(~rankable, "unranked").when(F.size("flags") > 0, "suspect").when(F.col("adjusted") >= floor, "meets").otherwise("below")
    return out.withColumn("bucket", bucket)


def rank_products(evaluated: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Adds place: within meets by cost, within below by adjusted from high to low; ties by id. With ``group`` the
    order is each group's own, in a window; without, it is the table's, numbered over ranges of the order."""
    order = F.when(F.col("bucket") == "meets", F.col("cost")).when(F.col("bucket") == "below", -F.col("adjusted"))
    if not group:
        return numbered(evaluated, "bucket", [F.asc_nulls_last(order), F.asc("id")])
    return evaluated.withColumn("place", F.row_number().over(Window.partitionBy(*group, "bucket").orderBy(F.asc_nulls_last(order), "id")))


def with_runner_up(ranked: DataFrame, order: str, score: str, group: list[str]) -> DataFrame:
    """The next row's gap in ``order``, and whether it is a trade-up: dearer but scored higher."""
    by = Window.partitionBy(*group).orderBy(order, "id")
    return ranked.withColumns({"gap": F.lead(order).over(by) - F.col(order), "trade_up": F.lead(score).over(by) > F.col(score)})


def price_offers(offers: DataFrame, months: float = 1.0) -> DataFrame:
    """``offers``: id, unit, price, ip_count, minimum, setup_hours, upkeep_hours, own_block, source_url,
    fetched_at, and of the job: pages, bytes_per_page, html_share, job_block, hourly. Adds tries, gb,
    infra, total, html_total, error and bucket (ranked, unviable, unranked)."""
    block = override("own_block", "job_block")
    out = offers.withColumn("block", block).withColumn("tries", S.attempts(F.col("pages"), F.col("block")))
    out = out.withColumn("gb", F.col("tries") * F.col("bytes_per_page") / 1e9)
    infra = S.unit_price(F.col("unit"), F.col("price"), F.col("ip_count"), F.col("tries"), F.col("gb"))
    lean = S.unit_price(F.col("unit"), F.col("price"), F.col("ip_count"), F.col("tries"), S.html_only(F.col("gb"), F.col("html_share"), F.col("unit")))
    out = out.withColumns({"infra": infra, "lean": lean})

    def total(x: Column) -> Column:
        return S.offer_total(x, F.col("minimum"), F.col("setup_hours"), F.col("upkeep_hours"), F.coalesce("hourly", F.lit(0.0)), F.lit(months))

    error = F.when(~F.col("unit").isin(*S.UNITS), "unknown unit").when(F.col("price").isNull(), "no price").when((F.col("unit") == "per_ip") & F.col("ip_count").isNull(), "no ip count")
    out = out.withColumns({"total": total(F.col("infra")), "html_total": F.when(F.col("lean").isNotNull(), total(F.col("lean"))), "error": error})
    ok = is_sourced("source_url", "fetched_at") & F.col("error").isNull()
    return out.withColumn("bucket", F.when(~ok, "unranked").when(F.col("block") < S.VIABLE_BLOCK_RATE, "ranked").otherwise("unviable"))


def rank_offers(priced: DataFrame) -> DataFrame:
    """Adds place: ranked by total, unviable by block rate from high to low; ties by id. Numbered over ranges of the
    order, so that no task holds a whole bucket."""
    order = F.when(F.col("bucket") == "ranked", F.col("total")).when(F.col("bucket") == "unviable", -F.col("block"))
    return numbered(priced, "bucket", [F.asc_nulls_last(order), F.asc("id")])


def crossover_month(cheap_price: Column, cheap_monthly: Column, dear_price: Column, dear_monthly: Column) -> Column:
    """First month in which the cheaper purchase is the dearer ownership; null if it never is."""
    saving = cheap_monthly - dear_monthly
    return F.when(saving > 0, F.ceil(F.try_divide(dear_price - cheap_price, saving)))
