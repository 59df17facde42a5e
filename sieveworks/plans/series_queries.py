"""Series, schedules and valuation over orders and lineitem, and inline cases with known answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import finance as N
from ..functions.basic import cagr
from ..operators import series as S
from .common import spread, table

def _by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly figures of a nation's customers, from orders. Sums are of decimals, so their order is no matter."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("id"), F.year("o_orderdate").alias("year"), "o_totalprice", "o_orderstatus", "o_orderpriority")
    d = lambda cond: F.sum(F.when(cond, F.col("o_totalprice").cast("decimal(18,2)"))).cast("double")
    return rows.groupBy("id", "year").agg(
        d(F.lit(True)).alias("revenue"), d(F.col("o_orderstatus") == "F").alias("net_income"), d(F.col("o_orderstatus") == "O").alias("cfo"), d(F.col("o_orderpriority") == "1-URGENT").alias("capex"),
        d(F.col("o_orderstatus") == "P").alias("receivables"), d(F.col("o_orderpriority") == "2-HIGH").alias("inventory"), d(F.col("o_orderpriority") == "5-LOW").alias("debt"), d(F.col("o_orderpriority") == "3-MEDIUM").alias("equity"), F.count(F.lit(1)).cast("double").alias("shares"),
    )


def _dsum(cond: str) -> str:
    return f"CAST(sum(CASE WHEN {cond} THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE)"


_NATION_SQL = f"""(SELECT c_nationkey AS id, CAST(year(o_orderdate) AS INT) AS year, {_dsum('true')} AS revenue, {_dsum("o_orderstatus = 'F'")} AS net_income, {_dsum("o_orderstatus = 'O'")} AS cfo, {_dsum("o_orderpriority = '1-URGENT'")} AS capex,
 {_dsum("o_orderstatus = 'P'")} AS receivables, {_dsum("o_orderpriority = '2-HIGH'")} AS inventory, {_dsum("o_orderpriority = '5-LOW'")} AS debt, {_dsum("o_orderpriority = '3-MEDIUM'")} AS equity, CAST(count(*) AS DOUBLE) AS shares
 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


_FLAG = {"net_income": "l_returnflag = 'N'", "cfo": "l_returnflag = 'A'", "capex": "l_linenumber = 1", "receivables": "l_returnflag = 'R'", "inventory": "l_linenumber = 2", "debt": "l_quantity > 25", "equity": "l_quantity <= 25"}
_SUM = "CAST(sum(CASE WHEN {0} THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) AS {1}"
_YEAR_SUMS = [_SUM.format("true", "revenue"), *(_SUM.format(c, n) for n, c in _FLAG.items()), "CAST(count(*) AS DOUBLE) AS shares"]
_PART_SQL = f"(SELECT l_partkey AS id, CAST(year(l_shipdate) AS INT) AS year, {', '.join(_YEAR_SUMS)} FROM lineitem GROUP BY 1, 2)"


def _by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly figures of a part, from its lines; sums are of decimals."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id"), F.year("l_shipdate").alias("year")).agg(*map(F.expr, _YEAR_SUMS))


def _flags_sql(source: str) -> str:
    def ends(n: str, expr: str) -> str:
        return f"arg_min({expr}, year) FILTER (WHERE year = ymin) AS {n}_f, arg_max({expr}, year) FILTER (WHERE year = ymax) AS {n}_l, arg_min({expr}, year) FILTER (WHERE ({expr}) IS NOT NULL) AS {n}_fk, arg_max({expr}, year) FILTER (WHERE ({expr}) IS NOT NULL) AS {n}_lk, count({expr}) AS {n}_n"

    def g(n: str) -> str:
        return f"CASE WHEN {n}_f > 0 AND {n}_l > 0 AND n > 1 THEN pow({n}_l / {n}_f, 1.0::DOUBLE / (n - 1)) - 1 END"

    share = "CASE WHEN cs <> 0 AND ns <> 0 THEN cs / ns END"
    agg = f"""(SELECT id, count(*) AS n, coalesce(sum(cfo), 0) AS cs, coalesce(sum(net_income), 0) AS ns, {ends('rev', 'revenue')}, {ends('ni', 'net_income')}, {ends('cf', 'cfo')}, {ends('rec', 'receivables')}, {ends('inv', 'inventory / nullif(revenue, 0)')}, {ends('lev', 'debt / nullif(equity, 0)')}, {ends('mar', 'net_income / nullif(revenue, 0)')}, {ends('sh', 'shares')}
      FROM (SELECT *, min(year) OVER (PARTITION BY id) AS ymin, max(year) OVER (PARTITION BY id) AS ymax FROM {source}) GROUP BY id)"""
    tests = [
        (1, "HIGH", "cash conversion", f"{share} < 0.8"), (1, "MEDIUM", "cash conversion", f"{share} >= 0.8 AND {share} < 1.0"),
        (2, "HIGH", "profit up, cash down", "ni_f <> 0 AND ni_l <> 0 AND cf_f <> 0 AND cf_l <> 0 AND ni_l > ni_f AND cf_l < cf_f"),
        (3, "HIGH", "receivables", f"{g('rec')} - {g('rev')} > 0.10"), (3, "MEDIUM", "receivables", f"{g('rec')} - {g('rev')} > 0.05 AND {g('rec')} - {g('rev')} <= 0.10"),
        (4, "MEDIUM", "inventory", "inv_n >= 2 AND inv_lk > 1.25 * inv_fk"), (5, "HIGH", "leverage", "lev_n >= 2 AND lev_lk > 2.0"), (5, "MEDIUM", "leverage", "lev_n >= 2 AND lev_lk <= 2.0 AND lev_lk > 1.5 * lev_fk AND lev_lk > 0.5"),
        (6, "MEDIUM", "margins", "mar_n >= 2 AND mar_lk < mar_fk - 0.02"), (7, "MEDIUM", "dilution", f"{g('sh')} > 0.03"),
    ]
    parts = [f"SELECT id, {o} AS ord, '{s}' AS severity, '{n}' AS name FROM a WHERE n >= 2 AND {c}" for o, s, n, c in tests]
    return f"WITH a AS {agg} " + " UNION ALL ".join([*parts, "SELECT id, 0, 'ERROR', 'too few years' FROM a WHERE n < 2"])


def ts_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.quality_flags(_by_part(spark, sf_dir))


def ts_quality_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.quality_flags(_by_nation(spark, sf_dir))


def win_yoy_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = S.growth_rates(_by_nation(spark, sf_dir))
    return g.select("id", *(F.round(n, 9).alias(n) for n in ("revenue", "net_income", "receivables", "shares")))


def prj_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.yearly_ratios(_by_nation(spark, sf_dir)).select("id", "year", "fcf", "margin", "conversion", "leverage", "fcf_margin")


def agg_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_part(spark, sf_dir).groupBy("id").agg(F.min_by("inventory", F.when(F.col("inventory").isNotNull(), F.col("year"))).alias("first_known"), F.max_by("revenue", "year").alias("last"), F.coalesce(F.sum("capex"), F.lit(0.0)).alias("capex"))


def ts_unlocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("id"), F.when(F.col("l_linenumber") == 7, "soon").otherwise(F.col("l_shipdate").cast("date").cast("string")).alias("date"), F.col("l_quantity").alias("tokens"))
    tokens = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 50).alias("id")).agg(F.max("p_size").cast("double").alias("circulating"))
    return S.unlock_horizons(li, tokens, F.lit("1997-06-01").cast("date"))


_UNLOCK_SQL = """SELECT id, within_30, within_90, within_365, within_30 / c * 100.0 AS pct_30, within_90 / c * 100.0 AS pct_90, within_365 / c * 100.0 AS pct_365, nearest_cliff, largest_cliff FROM (
 SELECT id, max(c) AS c, coalesce(sum(tokens) FILTER (WHERE days <= 30), 0.0) AS within_30, coalesce(sum(tokens) FILTER (WHERE days <= 90), 0.0) AS within_90, coalesce(sum(tokens) FILTER (WHERE days <= 365), 0.0) AS within_365,
  CAST(min(days) FILTER (WHERE pct >= 5) AS INT) AS nearest_cliff, CAST(arg_max(days, pct * 1000000 - days) FILTER (WHERE pct >= 5) AS INT) AS largest_cliff
 FROM (SELECT *, tokens / nullif(c, 0) * 100.0 AS pct FROM (SELECT l_partkey % 50 AS id, CASE WHEN l_linenumber <> 7 THEN datediff('day', DATE '1997-06-01', CAST(l_shipdate AS DATE)) END AS days, l_quantity AS tokens FROM lineitem)
  JOIN (SELECT p_partkey % 50 AS id, CAST(max(p_size) AS DOUBLE) AS c FROM part GROUP BY 1) USING (id)) WHERE days >= 0 AND tokens > 0 GROUP BY id)"""


def srt_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("id"), F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1997-06-01").cast("date")).alias("days"), F.col("l_quantity").alias("tokens"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return S.first_unlocks(li.filter("days >= 0")).select("id", "place", "days", "tokens")


_TOKEN = ("p_partkey AS id", "p_retailprice AS price", "CAST(p_size AS DOUBLE) AS circ", "CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size * 2 AS DOUBLE) END AS total", "CASE WHEN p_partkey % 4 <> 0 THEN CAST((p_partkey % 4 - 1) * p_size * 3 AS DOUBLE) END AS most")


def m_fdv(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").selectExpr(*_TOKEN)
    found = N.fully_diluted(F.col("price"), F.col("circ"), F.col("total"), F.col("most"))
    return t.select("id", *(v.alias(k) for k, v in found.items()))


def _worth(spark: SparkSession, sf_dir: str, growth: Column) -> DataFrame:
    """Parts that are worth what ten years of growing cash, and growth for ever after, come to."""
    t = spread(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")).otherwise(-5.0).alias("fcf"), F.lit(0.1).alias("discount"), F.lit(0.025).alias("terminal"))
    return t.withColumns({n: N.present_value(F.abs("fcf"), growth, F.col("discount"), F.col("terminal"), 10, fade=fade) for n, fade in (("value", False), ("fading_value", True))})


def fin_reverse_dcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The growth that a part's worth implies is that which it was made with; of negative cash there is none."""
    t = _worth(spark, sf_dir, F.col("size") / 100.0)
    g = N.implied_growth(*(F.col(c) for c in ("value", "fcf", "discount", "terminal")), 10)
    fading = N.implied_growth(*(F.col(c) for c in ("fading_value", "fcf", "discount", "terminal")), 10, fade=True)
    return t.select("id", F.round(g, 6).alias("growth"), F.round(fading, 6).alias("fading"), N.read_growth(F.round(g, 6)).alias("reading"))


def m_dcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 100.0).alias("g"), F.col("p_retailprice").alias("fcf"))
    return p.select("p_partkey", F.round(N.present_value(F.col("fcf"), F.col("g"), F.lit(0.1), F.lit(0.025), 5), 4).alias("value"))


_VALUE = "(" + " + ".join(f"fcf * pow(1 + {{g}}, {t}) / pow(1.1::DOUBLE, {t})" for t in range(1, 11)) + " + fcf * pow(1 + {g}, 10) * 1.025::DOUBLE / (0.1::DOUBLE - 0.025::DOUBLE) / pow(1.1::DOUBLE, 10))"
_POW = " + ".join(f"fcf * pow(1 + g, {t}) / pow(1.1, {t})" for t in range(1, 6))


def m_scenario_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _worth(spark, sf_dir, F.col("size") / 100.0).withColumn("g", F.explode(F.array(*(F.lit(x) for x in (0.03, 0.08, 0.14)))))
    v = N.present_value(F.abs("fcf"), F.col("g"), F.col("discount"), F.col("terminal"), 10)
    return rows.select("id", "g", F.round(v, 2).alias("per_share"), F.round((v / F.col("value") - 1) * 100.0, 2).alias("upside"))


_IPO = ("p_partkey AS id", "CASE p_partkey % 3 WHEN 0 THEN concat(p_size, '-', p_size + 5) WHEN 1 THEN concat(p_size, '') ELSE 'soon' END AS band", "CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS fresh", "CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_partkey % 60 AS DOUBLE) END AS ofs", "CAST(p_partkey % 9 - 2 AS DOUBLE) AS eps", "CASE WHEN p_partkey % 4 <> 0 THEN CAST(20 + p_size AS DOUBLE) END AS peer", "CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size % 11 AS DOUBLE) END AS gmp", "CASE WHEN p_partkey % 8 <> 0 THEN CAST(61 AS DOUBLE) END AS lot")


def m_ipo_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").selectExpr(*_IPO)
    share = N.fresh_share(F.col("fresh"), F.col("ofs"))
    return t.select("id", share.alias("fresh_pct"), N.fresh_band(share).alias("reading"))


def m_ipo_pe(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").selectExpr(*_IPO)
    low, high = N.band_ends(F.col("band"))
    pe = N.price_to_earnings(high, F.col("eps"))
    return t.select("id", low.alias("low"), high.alias("high"), N.price_to_earnings(low, F.col("eps")).alias("pe_low"), pe.alias("pe_high"), ((pe / F.col("peer") - 1) * 100.0).alias("premium"), F.when(F.col("eps") > 0, F.col("eps") * F.col("peer")).alias("at_peer"))


def m_ipo_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").selectExpr(*_IPO)
    _, high = N.band_ends(F.col("band"))
    rows = t.filter("gmp is not null").select("id", high.alias("price"), (high + F.col("gmp")).alias("implied"), "lot", F.explode(F.array(F.col("gmp") / high, F.lit(0.0), F.lit(-0.1), F.lit(-0.2))).alias("move"))
    return rows.select("id", "implied", "move", (F.col("price") * F.col("lot") * F.col("move")).alias("lot_result"))


def win_7day_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return S.rolling_mean(days, "event_type", "day", "n").select("event_type", "day", "mean", "change_pct")


def trend_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = win_7day_avg(spark, sf_dir)
    c = F.col("change_pct")
    return w.select("event_type", "day", F.when(c.isNull(), "not enough data").when(c < -10, "falling fast").when(c < -2, "falling").when(c <= 2, "flat").otherwise("rising").alias("decision"))


def win_volume_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return S.volume_ratio(days, "event_type", "day", "n").select("event_type", "day", "normal", "ratio")


def agg_holder_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_share(table(spark, sf_dir, "customer").filter("c_acctbal > 0"), "c_nationkey", "c_acctbal", "c_custkey")


def m_cagr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(cagr(F.col("p_size").cast("double"), "p_retailprice", F.col("p_size") % 6), 9).alias("cagr"))


_DAYS = "(SELECT event_type, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2)"
_MEANS = f"(SELECT event_type, day, mean, (mean - b) / nullif(b, 0) * 100.0 AS change_pct FROM (SELECT *, max(mean) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 7 DAYS PRECEDING) AS b FROM (SELECT *, avg(n) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS mean FROM {_DAYS})))"
_IPO_SQL = f"(SELECT *, TRY_CAST(trim(split_part(band, '-', 1)) AS DOUBLE) AS low, TRY_CAST(trim(string_split(band, '-')[-1]) AS DOUBLE) AS high FROM (SELECT {', '.join(_IPO)} FROM part))"
_G = {n: f"CASE WHEN {n}_f > 0 AND {n}_l > 0 AND n > 1 THEN round(pow({n}_l / {n}_f, 1.0::DOUBLE / (n - 1)) - 1, 9) END AS {n}" for n in ("revenue", "net_income", "receivables", "shares")}
QUERIES = {f.__name__: f for f in (ts_quality, ts_quality_nations, win_yoy_trend, prj_ratios, agg_first_last, ts_unlocks, srt_days, m_fdv, fin_reverse_dcf, m_dcf, m_scenario_value, m_ipo_issue, m_ipo_pe, m_ipo_listing, win_7day_avg, trend_decision, win_volume_ratio, agg_holder_concentration, m_cagr)}
ORACLE_SQL = {
    "ts_quality": _flags_sql(_PART_SQL),
    "ts_quality_nations": _flags_sql(_NATION_SQL),
    "win_yoy_trend": f"SELECT id, {', '.join(_G.values())} FROM (SELECT id, count(*) AS n, {', '.join(f'max({n}) FILTER (WHERE year = a) AS {n}_f, max({n}) FILTER (WHERE year = b) AS {n}_l' for n in _G)} FROM (SELECT *, min(year) OVER (PARTITION BY id) AS a, max(year) OVER (PARTITION BY id) AS b FROM {_NATION_SQL}) GROUP BY id)",
    "prj_ratios": f"SELECT id, year, cfo - capex AS fcf, net_income / nullif(revenue, 0) AS margin, cfo / nullif(net_income, 0) AS conversion, debt / nullif(equity, 0) AS leverage, (cfo - capex) / nullif(revenue, 0) AS fcf_margin FROM {_NATION_SQL}",
    "agg_first_last": f"SELECT id, arg_min(inventory, year) FILTER (WHERE inventory IS NOT NULL) AS first_known, arg_max(revenue, year) AS last, coalesce(sum(capex), 0) AS capex FROM {_PART_SQL} GROUP BY id",
    "ts_unlocks": _UNLOCK_SQL,
    "srt_days": "SELECT id, place, days, tokens FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY days, tokens DESC, pos) AS place FROM (SELECT l_partkey % 50 AS id, datediff('day', DATE '1997-06-01', CAST(l_shipdate AS DATE)) AS days, l_quantity AS tokens, l_orderkey * 10 + l_linenumber AS pos FROM lineitem) WHERE days >= 0) WHERE place <= 8",
    "m_fdv": f"SELECT id, price * circ AS mcap, price * f AS fdv, (price * f) / nullif(price * circ, 0) AS ratio, circ / nullif(f, 0) * 100.0 AS float_pct, ((price * f) / nullif(price * circ, 0) - 1.0) * 100.0 AS rise_pct, (1.0 - circ / nullif(f, 0)) * 100.0 AS drag_pct FROM (SELECT *, coalesce(nullif(most, 0), nullif(total, 0)) AS f FROM (SELECT {', '.join(_TOKEN)} FROM part))",
    "fin_reverse_dcf": "SELECT id, g AS growth, g AS fading, CASE WHEN g < 0 THEN 'shrinking' WHEN g < 0.05 THEN 'modest' WHEN g < 0.1 THEN 'moderate' WHEN g < 0.15 THEN 'demanding' WHEN g < 0.25 THEN 'very demanding' WHEN g >= 0.25 THEN 'extreme' END AS reading FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN round(p_size / 100.0::DOUBLE, 6) END AS g FROM part)",
    "m_dcf": f"SELECT p_partkey, round({_POW} + fcf * pow(1 + g, 5) * 1.025 / (0.1 - 0.025::DOUBLE) / pow(1.1, 5), 4) AS value FROM (SELECT p_partkey, p_size / 100.0::DOUBLE AS g, p_retailprice AS fcf FROM part)",
    "m_scenario_value": f"SELECT id, g, round({_VALUE.format(g='g')}, 2) AS per_share, round(({_VALUE.format(g='g')} / {_VALUE.format(g='own')} - 1) * 100.0, 2) AS upside FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice ELSE 5.0 END AS fcf, p_size / 100.0::DOUBLE AS own, unnest([0.03::DOUBLE, 0.08, 0.14]) AS g FROM part)",
    "m_ipo_issue": f"SELECT id, p AS fresh_pct, CASE WHEN p IS NULL THEN NULL WHEN p < 25 THEN 'mostly exit' WHEN p < 60 THEN 'mixed' ELSE 'mostly fresh' END AS reading FROM (SELECT id, fresh / nullif(fresh + ofs, 0) * 100.0 AS p FROM {_IPO_SQL})",
    "m_ipo_pe": f"SELECT id, low, high, CASE WHEN eps > 0 THEN low / eps END AS pe_low, CASE WHEN eps > 0 THEN high / eps END AS pe_high, (CASE WHEN eps > 0 THEN high / eps END / peer - 1) * 100.0 AS premium, CASE WHEN eps > 0 THEN eps * peer END AS at_peer FROM {_IPO_SQL}",
    "m_ipo_listing": f"SELECT id, high + gmp AS implied, move, high * lot * move AS lot_result FROM (SELECT *, unnest([gmp / high, 0.0::DOUBLE, -0.1::DOUBLE, -0.2::DOUBLE]) AS move FROM {_IPO_SQL} WHERE gmp IS NOT NULL)",
    "win_7day_avg": f"SELECT * FROM {_MEANS}",
    "trend_decision": f"SELECT event_type, day, CASE WHEN change_pct IS NULL THEN 'not enough data' WHEN change_pct < -10 THEN 'falling fast' WHEN change_pct < -2 THEN 'falling' WHEN change_pct <= 2 THEN 'flat' ELSE 'rising' END AS decision FROM {_MEANS}",
    "win_volume_ratio": f"SELECT event_type, day, normal, n / nullif(normal, 0) AS ratio FROM (SELECT *, avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS normal FROM {_DAYS})",
    "agg_holder_concentration": "SELECT c_nationkey, t / a * 100.0 AS share_pct, t / a * 100.0 > 50 AS concentrated FROM (SELECT c_nationkey, CAST(sum(CAST(c_acctbal AS DECIMAL(18,4))) FILTER (WHERE k <= 10) AS DOUBLE) AS t, CAST(sum(CAST(c_acctbal AS DECIMAL(18,4))) AS DOUBLE) AS a FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer WHERE c_acctbal > 0) GROUP BY 1)",
    "m_cagr": "SELECT p_partkey, CASE WHEN p_size > 0 AND p_retailprice > 0 AND p_size % 6 > 0 THEN round(pow(p_retailprice / p_size, 1.0::DOUBLE / (p_size % 6)) - 1, 9) END AS cagr FROM part",
}
