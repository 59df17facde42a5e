"""Products from part and lineitem, offers from supplier, and the fixture templates of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import basic as B
from ..functions import scoring as S
from ..operators import rank as R
from .common import fixture, fixture_sql, table


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product's stars are the quantities of its lines in steps of ten."""
    star = F.least(F.ceil(F.col("l_quantity") / 10), F.lit(5)).cast("int")
    stars = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), star.alias("star"))
    sums = stars.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("star") == k).alias(f"star{k}") for k in range(1, 6)))
    rating = (F.col("star1") + 2 * F.col("star2") + 3 * F.col("star3") + 4 * F.col("star4") + 5 * F.col("star5")) / F.col("n")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), "p_size", "p_brand")
    d = lambda x: x.cast("double")
    return sums.withColumn("rating", rating).join(part, "id").select(
        "id", "price", "rating", "n", *(f"star{k}" for k in range(1, 6)), "p_brand",
        (d(F.col("p_size")) * 2).alias("yearly"), F.lit(10.0).alias("once"), F.when(F.col("p_size") > 25, 5.0).alias("shipping"),
        (d(F.col("p_size")) * 3).alias("risk"), (d(F.col("id") % 5)).alias("warranty"), (F.col("price") * 0.125).alias("resale"),
        F.when(F.col("id") % 7 != 0, "https://shop.example/item").alias("source_url"), F.when(F.col("id") % 11 != 0, "2026-08-01").otherwise("").alias("fetched_at"),
    )


_PRODUCTS = """(SELECT id, price, rating, n, star1, star2, star3, star4, star5, p_brand, CAST(p_size AS DOUBLE) * 2 AS yearly, 10.0::DOUBLE AS once,
  CASE WHEN p_size > 25 THEN 5.0::DOUBLE END AS shipping, CAST(p_size AS DOUBLE) * 3 AS risk, CAST(id % 5 AS DOUBLE) AS warranty, price * 0.125::DOUBLE AS resale,
  CASE WHEN id % 7 <> 0 THEN 'https://shop.example/item' END AS source_url, CASE WHEN id % 11 <> 0 THEN '2026-08-01' ELSE '' END AS fetched_at
  FROM (SELECT *, CAST(star1 + 2 * star2 + 3 * star3 + 4 * star4 + 5 * star5 AS DOUBLE) / n AS rating FROM (
    SELECT l_partkey AS id, count(*) AS n, count_if(star = 1) AS star1, count_if(star = 2) AS star2, count_if(star = 3) AS star3, count_if(star = 4) AS star4, count_if(star = 5) AS star5
    FROM (SELECT l_partkey, least(CAST(ceil(l_quantity / 10) AS INT), 5) AS star FROM lineitem) GROUP BY 1))
  JOIN (SELECT p_partkey AS id, p_retailprice AS price, p_size, p_brand FROM part) USING (id))"""
_WILSON = "CASE WHEN n > 0 THEN greatest((share + 1.96::DOUBLE * 1.96::DOUBLE / (2.0::DOUBLE * n) - 1.96::DOUBLE * sqrt(share * (1.0::DOUBLE - share) / n + 1.96::DOUBLE * 1.96::DOUBLE / (4.0::DOUBLE * n * n))) / (1.0::DOUBLE + 1.96::DOUBLE * 1.96::DOUBLE / n), 0) ELSE 0 END"
_EVALUATED = f"""(SELECT *, CASE WHEN cost IS NOT NULL AND cost <> 0 THEN adjusted / (cost / 1000.0) END AS value,
    CASE WHEN source_url IS NULL OR source_url = '' OR fetched_at IS NULL OR fetched_at = '' OR price IS NULL THEN 'unranked' WHEN flags <> '' THEN 'suspect' WHEN adjusted >= 0.1 THEN 'meets' ELSE 'below' END AS bucket
  FROM (SELECT *, {_WILSON} AS adjusted,
    price + yearly * 3.0 + once + coalesce(shipping, 0.0) + CASE WHEN warranty < 3.0 THEN risk ELSE 0.0 END - resale AS cost,
    concat_ws(',', CASE WHEN star5::DOUBLE / n > 0.85 AND (star2 + star3 + star4)::DOUBLE / n < 0.12 THEN 'polarised' END, CASE WHEN star5::DOUBLE / n > 0.92 THEN 'near_unanimous' END,
      CASE WHEN n >= 200 AND star1::DOUBLE / n < 0.01 THEN 'no_one_star' END, CASE WHEN n > 0 AND n < 100 AND star5::DOUBLE / n > 0.85 THEN 'thin_and_clean' END) AS flags
  FROM (SELECT *, (star4 + star5)::DOUBLE / n AS share FROM {_PRODUCTS})))"""

_SHORTLIST_COLUMNS = "id, price, rating, n, star1, star2, star3, star4, star5, yearly, once, shipping, risk, warranty, resale, source_url, fetched_at"
_N = "CAST(NULL AS DOUBLE)"
_I = "CAST(NULL AS INT)"
#: A shortlist whose scores are known.
_SHORTLIST = f"""
 (1, CAST(8999 AS DOUBLE), CAST(4.3 AS DOUBLE), 12038, 602, 361, 722, 3010, 7343, CAST(3600 AS DOUBLE), CAST(500 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), {_N}, 'https://a.example', '2026-08-01'),
 (2, CAST(14999 AS DOUBLE), CAST(4.2 AS DOUBLE), 3120, {_I}, {_I}, {_I}, {_I}, {_I}, {_N}, {_N}, {_N}, {_N}, CAST(2 AS DOUBLE), CAST(500 AS DOUBLE), 'https://b.example', '2026-08-01'),
 (3, CAST(2499 AS DOUBLE), CAST(4.8 AS DOUBLE), 74, 1, 0, 1, 3, 69, {_N}, {_N}, {_N}, {_N}, {_N}, {_N}, 'https://c.example', '2026-08-01'),
 (4, {_N}, CAST(4.9 AS DOUBLE), 0, {_I}, {_I}, {_I}, {_I}, {_I}, {_N}, {_N}, {_N}, {_N}, {_N}, {_N}, CAST(NULL AS STRING), '2026-08-01')"""


def agg_hist_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _products(spark, sf_dir)
    return p.select("id", (F.col("star5") / F.col("n")).alias("top"), ((F.col("star2") + F.col("star3") + F.col("star4")) / F.col("n")).alias("middle"), (F.col("star1") / F.col("n")).alias("bottom"))


def m_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _products(spark, sf_dir).withColumn("share", S.positive_share(F.col("star4") + F.col("star5"), F.col("n"), F.col("rating")))
    return p.select("id", "share", S.wilson_lower("share", "n").alias("adjusted"))


def m_max_one_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _products(spark, sf_dir).select("id", S.max_one_star_share("rating", "n").alias("most_one_star"))


def m_tco(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.evaluate_products(_products(spark, sf_dir), floor=0.1).select("id", "cost", "value")


def a_histogram_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.evaluate_products(fixture(spark, _SHORTLIST_COLUMNS, _SHORTLIST)).select("id", F.array_join("flags", ",").alias("flags"), "share", "adjusted")


def rank_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = R.rank_products(R.evaluate_products(_products(spark, sf_dir), floor=0.1), ["p_brand"])
    return ranked.select("p_brand", "bucket", "place", "id", "adjusted", "cost")


def win_runner_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    meets = R.evaluate_products(_products(spark, sf_dir), floor=0.1).filter("bucket = 'meets'")
    return R.with_runner_up(meets, "cost", "adjusted", ["p_brand"]).select("p_brand", "id", "gap", "trade_up")


_UNIT_NAMES = "CASE s_suppkey % 7 WHEN 0 THEN 'per_gb' WHEN 1 THEN 'per_ip' WHEN 2 THEN 'per_1k_requests' WHEN 3 THEN 'per_credit' WHEN 4 THEN 'flat_monthly' WHEN 5 THEN 'per_page' ELSE 'per_month' END"
_OFFER_COLUMNS = f"""s_suppkey AS id, {_UNIT_NAMES} AS unit, CAST(s_suppkey % 40 AS DOUBLE) / 8 + 0.25 AS price, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey AS DOUBLE) END AS ip_count,
 CASE WHEN s_suppkey % 2 = 0 THEN CAST(50 AS DOUBLE) END AS minimum, CAST(s_suppkey % 4 AS DOUBLE) AS setup_hours, CAST(s_suppkey % 3 AS DOUBLE) AS upkeep_hours, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey % 9 AS DOUBLE) / 8 END AS own_block,
 CASE WHEN s_suppkey % 6 <> 0 THEN 'https://v.example' END AS source_url, '2026-08-01' AS fetched_at, CAST(200000 AS DOUBLE) AS pages, CAST(800000 AS DOUBLE) AS bytes_per_page,
 CASE WHEN s_suppkey % 4 <> 0 THEN CAST(0.25 AS DOUBLE) END AS html_share, CAST(0.125 AS DOUBLE) AS job_block, CAST(40 AS DOUBLE) AS hourly"""


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*[x.strip() for x in _split(_OFFER_COLUMNS)])


def _split(text: str) -> list[str]:
    """Commas outside parentheses."""
    out, depth, last = [], 0, 0
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[last:k])
            last = k + 1
    return [*out, text[last:]]


def _infra(gb: str) -> str:
    return f"CASE unit WHEN 'per_gb' THEN price * {gb} WHEN 'per_ip' THEN price * ip_count WHEN 'per_1k_requests' THEN price * tries / 1000.0 WHEN 'per_credit' THEN price * tries WHEN 'flat_monthly' THEN price WHEN 'per_page' THEN price * tries END"


_PRICED = f"""(SELECT *, CASE WHEN source_url IS NULL OR error IS NOT NULL THEN 'unranked' WHEN block < 0.5 THEN 'ranked' ELSE 'unviable' END AS bucket FROM (
  SELECT *, CASE WHEN infra IS NOT NULL OR minimum IS NOT NULL OR true THEN greatest(infra, coalesce(minimum, 0.0)) * 1.0 + setup_hours * hourly + upkeep_hours * hourly * 1.0 END AS total,
    CASE WHEN lean IS NOT NULL THEN greatest(lean, coalesce(minimum, 0.0)) * 1.0 + setup_hours * hourly + upkeep_hours * hourly * 1.0 END AS html_total,
    CASE WHEN unit = 'per_month' THEN 'unknown unit' WHEN unit = 'per_ip' AND ip_count IS NULL THEN 'no ip count' END AS error
  FROM (SELECT *, {_infra('gb')} AS infra, CASE WHEN unit = 'per_gb' THEN CASE WHEN html_share < 0.99 THEN price * (gb * html_share) END ELSE {_infra('gb')} END AS lean
  FROM (SELECT *, tries * bytes_per_page / 1e9::DOUBLE AS gb FROM (SELECT *, pages / (1.0 - least(greatest(block, 0.0), 0.99::DOUBLE)) AS tries FROM (SELECT *, coalesce(own_block, job_block, 0.0) AS block FROM (SELECT {_OFFER_COLUMNS} FROM supplier)))))))"""


def m_unit_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.price_offers(_offers(spark, sf_dir)).select("id", "unit", "block", "tries", "gb", "total", "error", "bucket")


def m_bandwidth_lever(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.price_offers(_offers(spark, sf_dir)).filter("unit = 'per_gb'").select("id", "total", "html_total")


def rank_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rank_offers(R.price_offers(_offers(spark, sf_dir))).select("id", "bucket", "place", "block", "total")


def prj_and_flt(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _offers(spark, sf_dir)
    return o.select("id", B.override("own_block", "job_block").alias("block"), B.clamp("own_block", 0.0, 0.99).alias("clamped"), B.or_default("setup_hours", 3.0).alias("or_default"), B.is_sourced("source_url", "fetched_at").alias("sourced"), B.safe_ratio("price", "upkeep_hours").alias("ratio"))


def m_crossover(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", R.crossover_month(F.col("p_retailprice"), F.col("p_size").cast("double"), F.col("p_retailprice") + 400.0, F.lit(20.0)).cast("long").alias("month"))


def m_bandwidth_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", S.rounded_requests(F.length("html").cast("double"), 1000.0).alias("billed"))


QUERIES = {f.__name__: f for f in (agg_hist_share, m_wilson, m_max_one_star, m_tco, a_histogram_flags, rank_value, win_runner_up, m_unit_price, m_bandwidth_lever, rank_cost, prj_and_flt, m_crossover, m_bandwidth_round)}
_ORDER = "CASE bucket WHEN 'meets' THEN cost WHEN 'below' THEN -adjusted END"
ORACLE_SQL = {
    "agg_hist_share": f"SELECT id, star5::DOUBLE / n AS top, (star2 + star3 + star4)::DOUBLE / n AS middle, star1::DOUBLE / n AS bottom FROM {_PRODUCTS}",
    "m_wilson": f"SELECT id, share, {_WILSON} AS adjusted FROM (SELECT *, (star4 + star5)::DOUBLE / n AS share FROM {_PRODUCTS})",
    "m_max_one_star": f"SELECT id, greatest(floor(n * (5.0::DOUBLE - rating + 0.05::DOUBLE) / 4.0)::DOUBLE / n, 0) AS most_one_star FROM {_PRODUCTS}",
    "m_tco": f"SELECT id, cost, value FROM {_EVALUATED}",
    "rank_value": f"SELECT p_brand, bucket, row_number() OVER (PARTITION BY p_brand, bucket ORDER BY {_ORDER} NULLS LAST, id) AS place, id, adjusted, cost FROM {_EVALUATED}",
    "win_runner_up": f"SELECT p_brand, id, lead(cost) OVER w - cost AS gap, lead(adjusted) OVER w > adjusted AS trade_up FROM {_EVALUATED} WHERE bucket = 'meets' WINDOW w AS (PARTITION BY p_brand ORDER BY cost, id)",
    "m_unit_price": f"SELECT id, unit, block, tries, gb, total, error, bucket FROM {_PRICED}",
    "m_bandwidth_lever": f"SELECT id, total, html_total FROM {_PRICED} WHERE unit = 'per_gb'",
    "rank_cost": f"SELECT id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY CASE bucket WHEN 'ranked' THEN total WHEN 'unviable' THEN -block END NULLS LAST, id) AS place, block, total FROM {_PRICED}",
    "prj_and_flt": f"SELECT id, coalesce(own_block, job_block, 0.0) AS block, CASE WHEN own_block IS NOT NULL THEN least(greatest(own_block, 0.0), 0.99::DOUBLE) END AS clamped, CASE WHEN setup_hours <> 0 THEN setup_hours ELSE 3.0 END AS or_default, coalesce(source_url, '') <> '' AND coalesce(fetched_at, '') <> '' AS sourced, price / nullif(upkeep_hours, 0.0) AS ratio FROM (SELECT {_OFFER_COLUMNS} FROM supplier)",
    "m_crossover": "SELECT p_partkey, CASE WHEN p_size - 20 > 0 THEN CAST(ceil(((p_retailprice + 400.0) - p_retailprice) / (CAST(p_size AS DOUBLE) - 20.0)) AS BIGINT) END AS month FROM part",
    "m_bandwidth_round": "SELECT page_id, ceil(length(html)::DOUBLE / 1000.0) * 1000.0::DOUBLE AS billed FROM pages",
    "a_histogram_flags": f"""SELECT id, CASE WHEN total > 0 THEN concat_ws(',', CASE WHEN t > 0.85 AND m < 0.12 THEN 'polarised' END, CASE WHEN t > 0.92 THEN 'near_unanimous' END, CASE WHEN n >= 200 AND o < 0.01 THEN 'no_one_star' END, CASE WHEN n > 0 AND n < 100 AND t > 0.85 THEN 'thin_and_clean' END)
      ELSE CASE WHEN n > 0 AND greatest(floor(n * (5.0::DOUBLE - rating + 0.05::DOUBLE) / 4.0)::DOUBLE / n, 0) < 0.05 THEN 'no_room_for_one_star' WHEN n > 0 AND n < 200 AND rating >= 4.6 THEN 'thin_and_high' ELSE '' END END AS flags, share, {_WILSON} AS adjusted FROM (
      SELECT *, star5::DOUBLE / nullif(total, 0) AS t, (star2 + star3 + star4)::DOUBLE / nullif(total, 0) AS m, star1::DOUBLE / nullif(total, 0) AS o, coalesce((star4 + star5)::DOUBLE / nullif(total, 0), least(greatest((rating - 1.0) / 4.0, 0.0), 1.0)) AS share FROM (
      SELECT *, coalesce(star1, 0) + coalesce(star2, 0) + coalesce(star3, 0) + coalesce(star4, 0) + coalesce(star5, 0) AS total FROM {fixture_sql(_SHORTLIST_COLUMNS, _SHORTLIST)}))""",
}
