"""Gates and caps, calendars, nutrition and week plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendars as C
from ..functions import finance as N
from ..operators import gates as G
from ..operators import nutrition as P
from .common import fixture, parts_of, table

_PROFILE_COLUMNS = """c_custkey AS id, c_acctbal * 10 AS portfolio, CASE WHEN c_custkey % 3 = 0 THEN CAST(500 AS DOUBLE) END AS max_loss_usd, CASE WHEN c_custkey % 3 = 1 THEN CAST(8 AS DOUBLE) END AS max_loss_pct,
 CAST(c_custkey % 40 AS DOUBLE) AS horizon, CAST(c_custkey % 9 AS DOUBLE) AS emergency, CASE c_custkey % 4 WHEN 0 THEN 'stable' WHEN 1 THEN 'none' ELSE 'variable' END AS income, CAST(c_custkey % 5 AS DOUBLE) * 100 AS existing, c_custkey % 6 = 0 AS leverage,
 CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 50 AS DOUBLE) END AS needed_within, c_custkey % 2 = 0 AS veteran, CASE c_custkey % 6 WHEN 0 THEN 'major' WHEN 1 THEN 'large' WHEN 2 THEN 'mid' WHEN 3 THEN 'small' WHEN 4 THEN 'micro' ELSE 'odd' END AS tier"""


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rank_queries import _split

    return table(spark, sf_dir, "customer").selectExpr(*[x.strip() for x in _split(_PROFILE_COLUMNS)])


def _case(column: str, values: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in values.items()) + " END"


_ASSESSED = f"""(SELECT *, CASE WHEN budget IS NULL THEN 'no loss budget' WHEN tier = 'odd' THEN 'unknown tier' END AS error,
  CASE WHEN budget IS NOT NULL AND tier <> 'odd' THEN CASE WHEN gates <> '' THEN 0 ELSE least(loss_cap, exposure_cap, concentration_cap) END END AS size,
  CASE WHEN budget IS NOT NULL AND tier <> 'odd' THEN CASE WHEN loss_cap = least(loss_cap, exposure_cap, concentration_cap) THEN 'loss' WHEN exposure_cap = least(loss_cap, exposure_cap, concentration_cap) THEN 'exposure' ELSE 'concentration' END END AS binding
 FROM (SELECT *, budget / {_case('tier', N.DRAWDOWN)} AS loss_cap, greatest(0.0, portfolio * bc - existing) AS exposure_cap, portfolio * bc * {_case('tier', N.ASSET_CAP)} AS concentration_cap
 FROM (SELECT *, {_case('band', N.BAND_CAP)} AS bc FROM (SELECT *, CASE WHEN points >= 3 THEN 'resilient' WHEN points >= 1 THEN 'moderate' ELSE 'fragile' END AS band FROM (
  SELECT *, coalesce(max_loss_usd, portfolio * max_loss_pct / 100.0) AS budget,
   CAST((CASE WHEN emergency >= 6 THEN 1 ELSE 0 END) + (CASE income WHEN 'stable' THEN 1 WHEN 'none' THEN -1 ELSE 0 END) + (CASE WHEN horizon >= 24 THEN 1 ELSE 0 END) + (CASE WHEN veteran THEN 1 ELSE 0 END) - (CASE WHEN leverage THEN 1 ELSE 0 END) AS INT) AS points,
   concat_ws(',', CASE WHEN emergency < 3 THEN 'emergency fund' END, CASE WHEN needed_within <= horizon THEN 'needed within the horizon' END, CASE WHEN needed_within <= 12 THEN 'needed within a year' END) AS gates
  FROM (SELECT {_PROFILE_COLUMNS} FROM customer))))))"""


def gate_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = G.assess_position(_profiles(spark, sf_dir))
    return a.select("id", "points", "band", F.array_join("gates", ",").alias("gates"), "loss_cap", "exposure_cap", "concentration_cap", "binding", "size", "error")


def m_loss_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.loss_scenarios(G.assess_position(_profiles(spark, sf_dir)).filter("error is null"))


def gate_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of a kind are its venues' prices; zero is no price."""
    e = table(spark, sf_dir, "events").withColumn("value", F.nullif("value", F.lit(0.0)))
    f = e.groupBy(F.col("user_id").alias("id")).agg(F.max("value").alias("price"), F.countDistinct(F.when(F.col("value").isNotNull(), F.col("event_type"))).alias("venues"), F.min("value").alias("low"), F.max("value").alias("high"), (F.count(F.lit(1)) / 100.0).alias("turnover"), (F.date_diff(F.lit("2024-01-31").cast("date"), F.max("ts").cast("date")) * 10.0).alias("age_min"))
    c = G.check_feed(f)
    return c.select("id", "spread", F.array_join("problems", ",").alias("problems"), F.array_join("warnings", ",").alias("warnings"), "ok", "status")


def gate_terminal_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any terminal flag among a part's lines ends its rating."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 50)).alias("terminal"), F.avg("l_quantity").alias("score"))
    return li.select("l_partkey", F.when(~F.col("terminal"), F.col("score")).alias("score"), F.when(F.col("terminal"), "no rating").otherwise("rated").alias("verdict"))


def m_infer_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", N.infer_tier(F.col("p_partkey"), F.col("p_retailprice") * 40000.0).alias("tier"))


def cal_lockin(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    market = F.element_at(F.array(*(F.lit(m) for m in ("IN", "US", "HK", "XX"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = o.select(F.col("o_orderkey").alias("id"), market.alias("market"), day.alias("listing"), F.when(F.col("o_orderkey") % 3 == 0, F.date_sub(day, 3)).when(F.col("o_orderkey") % 3 == 1, F.date_add(day, 1)).alias("allotment"))
    return C.lockin_events(rows)


_LOCKS = ", ".join(f"('{m}', '{b}', {d}, '{e}')" for m, b, d, e in C.LOCKINS)
_INSTANTS = """(1, 'IN', TIMESTAMP '2026-07-31 18:00:00'), (2, 'JP', TIMESTAMP '2026-07-29 03:00:00'), (3, 'US', TIMESTAMP '2026-08-01 15:00:00'), (4, 'US', TIMESTAMP '2026-08-03 13:30:00'), (5, 'US', TIMESTAMP '2026-08-03 20:00:00'), (6, 'DE', TIMESTAMP '2026-08-03 05:00:00'), (7, 'XX', TIMESTAMP '2026-08-03 05:00:00'), (8, 'US', TIMESTAMP '2026-03-06 22:00:00')"""


def cal_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.session_status(fixture(spark, "id, market, at", _INSTANTS))
    return s.select("id", "status", F.date_format("next_open", "yyyy-MM-dd HH:mm").alias("next_open"), "days_ahead")


def cal_session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit("IN").alias("market"), F.col("ts").alias("at"))
    s = C.session_status(e)
    return s.groupBy("status", "days_ahead").agg(F.count(F.lit(1)).alias("n"))


def dt_weekend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.max(C.is_weekend(F.col("ts").cast("date"))).alias("weekend"))


_PEOPLE = """(1, 34, 'female', CAST(165 AS DOUBLE), CAST(80 AS DOUBLE), CAST(NULL AS DOUBLE), 'light', CAST(68 AS DOUBLE), false), (2, 34, 'female', CAST(165 AS DOUBLE), CAST(50 AS DOUBLE), NULL, 'light', CAST(44 AS DOUBLE), false), (3, 16, 'male', CAST(170 AS DOUBLE), CAST(70 AS DOUBLE), NULL, 'active', CAST(65 AS DOUBLE), false),
 (4, 40, 'male', CAST(180 AS DOUBLE), CAST(100 AS DOUBLE), CAST(25 AS DOUBLE), 'moderate', CAST(85 AS DOUBLE), false), (5, 30, 'other', CAST(160 AS DOUBLE), CAST(55 AS DOUBLE), NULL, 'sedentary', NULL, NULL)"""
_PERSON = "id, age, sex, height_cm, weight_kg, body_fat_pct, activity, goal_kg, pregnant"


def plan_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.plan_targets(fixture(spark, _PERSON, _PEOPLE))
    return t.select("id", F.round("bmi", 2).alias("bmi"), F.round("bmr", 2).alias("bmr"), F.round("target", 2).alias("target"), "protein", "fat", "carbs", "fibre", "water", F.round("weeks", 2).alias("weeks"), F.array_join("stops", ",").alias("stops"))


#: Items a task: the join's order, and the totals by meal and by day, of an order are made where its lines are.
ITEM_ROWS = 250_000


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders are plans and days, lines are items, line numbers meals."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    parts = parts_of(li, ITEM_ROWS)
    j = li.repartition(parts, "l_orderkey").join(o.repartition(parts, "o_orderkey"), li.l_orderkey == o.o_orderkey)
    return j.select(F.col("o_custkey").alias("plan"), F.col("o_orderkey").alias("day"), (F.col("l_linenumber") % 4).alias("meal"), F.concat(F.lit("Food "), (F.col("l_partkey") % 40).cast("string"), F.lit(", raw")).alias("food"), (F.col("l_quantity") * 10).alias("kcal"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_quantity")).alias("protein"), F.when(F.col("l_returnflag") == "N", F.col("l_quantity") / 4).alias("fibre"), F.col("l_returnflag").alias("section"), F.col("l_quantity").alias("qty"))


_ITEMS = "(SELECT o_custkey AS plan, o_orderkey AS day, l_linenumber % 4 AS meal, 'Food ' || (l_partkey % 40) || ', raw' AS food, l_quantity * 10 AS kcal, CASE WHEN l_suppkey % 5 <> 0 THEN l_quantity END AS protein, CASE WHEN l_returnflag = 'N' THEN l_quantity / 4 END AS fibre, l_returnflag AS section, l_quantity AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def agg_hier_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.day_totals(_items(spark, sf_dir))


def plan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.check_days(P.day_totals(_items(spark, sf_dir)), F.lit(1000.0), F.lit(90.0), F.lit(12.0))
    return d.select("plan", "day", F.array_join("failures", ",").alias("failures"), F.array_join("notices", ",").alias("notices"))


def agg_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.check_week(_items(spark, sf_dir)).select("plan", "days", "foods", F.array_join("notices", ",").alias("notices"))


def agg_shopping_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.shopping_list(_items(spark, sf_dir), 2.0)


def flt_fallback_meal(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _items(spark, sf_dir).groupBy("plan", "day", "meal").agg(F.coalesce(F.sum(F.col("protein").cast("decimal(18,4)")).cast("double"), F.lit(0.0)).alias("protein"), (F.count(F.lit(1)) * 4).alias("minutes"))
    return P.fallback_meals(i)


def m_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", P.protein_density(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("density"))
    return p.withColumn("band", P.density_band(F.col("density")))


def m_fat_from_deficit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", P.fat_from_deficit(F.col("p_retailprice"), F.col("p_size").cast("double"), F.lit(7.0)).alias("kg"), P.swap_portion(F.col("p_size") / 100.0).alias("grams"))


_D = "CAST(coalesce(sum(CAST({0} AS DECIMAL(18,4))), 0) AS DOUBLE) AS {0}"
_DAYS = f"(SELECT plan, day, {', '.join(_D.format(x) for x in ('kcal', 'protein', 'fibre'))}, count(*) AS meals, count_if(protein >= 20) AS protein_meals, max(protein) AS largest_meal FROM (SELECT plan, day, meal, {', '.join(_D.format(x) for x in ('kcal', 'protein', 'fibre'))} FROM {_ITEMS} GROUP BY 1, 2, 3) GROUP BY 1, 2)"
_DAYS = _DAYS.replace("CAST(coalesce(sum(CAST(protein AS DECIMAL(18,4))), 0) AS DOUBLE) AS protein, CAST(coalesce(sum(CAST(fibre AS DECIMAL(18,4))), 0) AS DOUBLE) AS fibre, count(*)", "CAST(sum(CAST(m.protein AS DECIMAL(18,4))) AS DOUBLE) AS protein, CAST(sum(CAST(m.fibre AS DECIMAL(18,4))) AS DOUBLE) AS fibre, count(*)").replace("CAST(coalesce(sum(CAST(kcal AS DECIMAL(18,4))), 0) AS DOUBLE) AS kcal, CAST(sum", "CAST(sum(CAST(m.kcal AS DECIMAL(18,4))) AS DOUBLE) AS kcal, CAST(sum", 1).replace("count_if(protein >= 20)", "count_if(m.protein >= 20)").replace("max(protein)", "max(m.protein)").replace("GROUP BY 1, 2, 3) GROUP BY", "GROUP BY 1, 2, 3) AS m GROUP BY")
QUERIES = {f.__name__: f for f in (gate_position, m_loss_scenarios, gate_live, gate_terminal_flags, m_infer_tier, cal_lockin, cal_session, cal_session_events, dt_weekend, plan_targets, agg_hier_plan, plan_check, agg_distinct, agg_shopping_list, flt_fallback_meal, m_density, m_fat_from_deficit)}
ORACLE_SQL = {
    "gate_position": f"SELECT id, points, band, gates, loss_cap, exposure_cap, concentration_cap, binding, size, error FROM {_ASSESSED}",
    "m_loss_scenarios": f"SELECT id, d AS drop, size * d AS loss, size * d <= budget + 1e-9 AS within FROM {_ASSESSED}, (VALUES (0.3::DOUBLE), (0.5), (0.8), (1.0)) AS v(d) WHERE error IS NULL",
    "gate_live": """SELECT id, spread, problems, warnings, problems = '' AS ok, CAST(CASE WHEN problems <> '' THEN 3 WHEN warnings <> '' THEN 2 ELSE 0 END AS INT) AS status FROM (SELECT *, concat_ws(',', CASE WHEN coalesce(price, 0) = 0 THEN 'no price' END, CASE WHEN age_min > 30 THEN 'stale' END, CASE WHEN spread > 5 THEN 'diverging' END) AS problems,
      concat_ws(',', CASE WHEN spread > 1 THEN 'spread' END, CASE WHEN venues < 2 THEN 'no cross-check' END, CASE WHEN turnover < 0.005 OR turnover > 2.0 THEN 'turnover' END) AS warnings FROM (SELECT *, CASE WHEN venues >= 2 THEN (high - low) / low * 100.0 END AS spread FROM (
      SELECT user_id AS id, max(nullif(value, 0)) AS price, count(DISTINCT event_type) FILTER (value <> 0) AS venues, min(nullif(value, 0)) AS low, max(nullif(value, 0)) AS high, count(*) / 100.0::DOUBLE AS turnover, datediff('day', CAST(max(ts) AS DATE), DATE '2024-01-31') * 10.0 AS age_min FROM events GROUP BY 1)))""",
    "gate_terminal_flags": "SELECT l_partkey, CASE WHEN NOT t THEN s END AS score, CASE WHEN t THEN 'no rating' ELSE 'rated' END AS verdict FROM (SELECT l_partkey, bool_or(l_returnflag = 'R' AND l_quantity >= 50) AS t, avg(l_quantity) AS s FROM lineitem GROUP BY 1)",
    "m_infer_tier": "SELECT p_partkey, CASE WHEN p_partkey <= 2 THEN 'major' WHEN p_partkey <= 20 THEN 'large' WHEN p_partkey <= 100 THEN 'mid' WHEN p_retailprice * 40000.0 < 50e6 THEN 'micro' ELSE 'small' END AS tier FROM part",
    "cal_lockin": f"""WITH l AS (SELECT o_orderkey AS id, ['IN','US','HK','XX'][o_orderkey % 4 + 1] AS market, CAST(o_orderdate AS DATE) AS listing, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderdate AS DATE) - 3 WHEN 1 THEN CAST(o_orderdate AS DATE) + 1 ELSE CAST(o_orderdate AS DATE) END AS allotment FROM orders),
      e AS (SELECT *, CASE WHEN market = 'XX' THEN 'unknown market' WHEN allotment > listing THEN 'allotment after listing' END AS error FROM l)
      SELECT id, event, CASE base WHEN 'allotment' THEN allotment + days ELSE listing + days END AS date, CAST(CASE base WHEN 'allotment' THEN allotment + days ELSE listing + days END - listing AS INT) AS days_from_listing, NULL AS error FROM e JOIN (VALUES {_LOCKS}) AS r(m, base, days, event) ON m = market WHERE error IS NULL
      UNION ALL SELECT id, NULL, NULL, NULL, error FROM e WHERE error IS NOT NULL""",
    "cal_session": "SELECT * FROM (VALUES (1, 'after the close', '2026-08-03 03:45', 3), (2, 'midday break', '2026-07-29 03:30', 0), (3, 'weekend', '2026-08-03 13:30', 2), (4, 'open', '2026-08-04 13:30', 1), (5, 'after the close', '2026-08-04 13:30', 1), (6, 'before the open', '2026-08-03 07:00', 0), (7, 'unknown market', NULL, NULL), (8, 'after the close', '2026-03-09 13:30', 3)) AS t(id, status, next_open, days_ahead)",
    "cal_session_events": """SELECT status, CAST(CASE WHEN wd = 5 THEN CASE WHEN m < 555 THEN 2 ELSE 2 END WHEN wd = 6 THEN 1 WHEN m < 555 THEN 0 WHEN wd = 4 THEN 3 ELSE 1 END AS INT) AS days_ahead, count(*) AS n FROM (SELECT *, CASE WHEN wd >= 5 THEN 'weekend' WHEN m < 555 THEN 'before the open' WHEN m < 930 THEN 'open' ELSE 'after the close' END AS status
      FROM (SELECT isodow(l) - 1 AS wd, hour(l) * 60 + minute(l) AS m FROM (SELECT ts + INTERVAL 330 MINUTES AS l FROM events))) GROUP BY 1, 2""",
    "dt_weekend": "SELECT CAST(ts AS DATE) AS day, isodow(max(ts)) >= 6 AS weekend FROM events GROUP BY 1",
    "plan_targets": "SELECT * FROM (VALUES (1, 29.38::DOUBLE, 1500.25::DOUBLE, 1547.13::DOUBLE, 136::DOUBLE, 41::DOUBLE, 159::DOUBLE, 22::DOUBLE, 2800::DOUBLE, 25.6::DOUBLE, ''), (2, 18.37, 1200.25, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'underweight,goal underweight'), (3, 24.22, 1687.5, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'under age'), (4, 30.86, 1990.0, 2313.38, 165, 51, 299, 32, 3500, 21.4, ''), (5, 21.48, 1239.0, 1200.0, 99, 33, 127, 17, 1900, NULL, '')) AS t(id, bmi, bmr, target, protein, fat, carbs, fibre, water, weeks, stops)",
    "agg_hier_plan": f"SELECT * FROM {_DAYS}",
    "plan_check": f"SELECT plan, day, concat_ws(',', CASE WHEN abs(kcal - 1000) > 100 THEN 'energy' END, CASE WHEN protein < 89.5 THEN 'protein' END) AS failures, concat_ws(',', CASE WHEN protein_meals < 3 THEN 'protein spread' END, CASE WHEN fibre > 0 AND fibre < 0.8 * 12 THEN 'fibre' END, CASE WHEN meals < 3 THEN 'meals' END) AS notices FROM {_DAYS}",
    "agg_distinct": f"SELECT plan, days, foods, concat_ws(',', CASE WHEN days <> 7 THEN 'week size' END, CASE WHEN foods > 22 OR (foods > 0 AND foods < 8) THEN 'variety' END) AS notices FROM (SELECT plan, count(DISTINCT day) AS days, count(DISTINCT lower(trim(split_part(food, ',', 1)))) AS foods FROM {_ITEMS} GROUP BY 1)",
    "agg_shopping_list": f"SELECT section, food, CAST(sum(CAST(qty AS DECIMAL(18,4))) AS DOUBLE) * 2.0 AS qty FROM {_ITEMS} GROUP BY 1, 2",
    "flt_fallback_meal": f"SELECT plan, day, meal, protein, minutes FROM (SELECT plan, day, meal, CAST(coalesce(sum(CAST(i.protein AS DECIMAL(18,4))), 0) AS DOUBLE) AS protein, count(*) * 4 AS minutes FROM {_ITEMS} AS i GROUP BY 1, 2, 3) WHERE minutes <= 10 AND protein >= 30",
    "m_density": "SELECT p_partkey, d AS density, CASE WHEN d IS NULL THEN NULL WHEN d >= 15 THEN 'anchor' WHEN d >= 8 THEN 'strong' WHEN d >= 4 THEN 'supporting' ELSE 'garnish' END AS band FROM (SELECT p_partkey, p_size * 100.0::DOUBLE / nullif(p_retailprice, 0) AS d FROM part)",
    "m_fat_from_deficit": "SELECT p_partkey, (p_retailprice - p_size) * 7.0 / 7700.0 AS kg, 25.0 / nullif(p_size / 100.0::DOUBLE, 0) AS grams FROM part",
}
