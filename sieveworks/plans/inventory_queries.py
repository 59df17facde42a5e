"""The inventory's single steps under their own names, where a composite query holds several of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import basic as B
from ..functions import scoring as S
from ..functions import text as T
from ..functions import web as W
from ..operators import gates as G
from ..operators import nutrition as P
from ..operators import rank as R
from ..operators import series as Y
from . import gate_queries as GQ
from . import rank_queries as RQ
from . import series_queries as SQ
from . import text_queries as TQ
from . import web_queries as WQ
from .common import fixture, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = query
    ORACLE_SQL[name] = sql


def _case(name: str, columns: str, rows: str, result: Callable[[], Column], want: str, kind: str = "r") -> None:
    """A function over inline cases: id and the result as text of JSON-like literals in ``want``."""
    _add(name, lambda s, d: fixture(s, columns, rows).select("id", result().alias(kind)), f"SELECT * FROM (VALUES {want}) AS t(id, {kind})")


# Projections and predicates over suppliers' offers.
_OFFER = f"(SELECT {RQ._OFFER_COLUMNS} FROM supplier)"


def _offer(name: str, result: Callable[[], Column], sql: str) -> None:
    _add(name, lambda s, d: RQ._offers(s, d).select("id", result().alias("r")), f"SELECT id, {sql} AS r FROM {_OFFER}")


_offer("prj_safe_ratio", lambda: B.safe_ratio("price", "upkeep_hours"), "price / nullif(upkeep_hours, 0.0)")
_offer("prj_clamp", lambda: B.clamp("own_block", 0.0, 0.99), "CASE WHEN own_block IS NOT NULL THEN least(greatest(own_block, 0.0), 0.99::DOUBLE) END")
_offer("prj_override", lambda: B.override("own_block", "job_block"), "coalesce(own_block, job_block, 0.0)")
_offer("prj_or_default", lambda: B.or_default("setup_hours", 3.0), "CASE WHEN setup_hours <> 0 THEN setup_hours ELSE 3.0 END")
_offer("flt_sourced", lambda: B.is_sourced("source_url", "fetched_at"), "coalesce(source_url, '') <> '' AND coalesce(fetched_at, '') <> ''")
_offer("flt_viable", lambda: B.override("own_block", "job_block") < S.VIABLE_BLOCK_RATE, "coalesce(own_block, job_block, 0.0) < 0.5")
_offer("m_attempts", lambda: S.attempts(F.col("pages"), F.col("job_block")), "pages / (1.0 - least(greatest(job_block, 0.0), 0.99::DOUBLE))")
_offer("m_html_share", lambda: B.safe_ratio("bytes_per_page", F.col("bytes_per_page") + F.col("pages")), "bytes_per_page / nullif(bytes_per_page + pages, 0.0)")
_add("prj_strip_notes", lambda s, d: table(s, d, "region").withColumn("_notes", F.lit("x")).select("r_regionkey", "r_name"), "SELECT r_regionkey, r_name FROM region")
_add("prj_fcf", lambda s, d: Y.yearly_ratios(SQ._by_nation(s, d)).select("id", "year", "fcf"), f"SELECT id, year, cfo - capex AS fcf FROM {SQ._NATION_SQL}")
_add("join_dim_equi", lambda s, d: RQ._offers(s, d).filter(F.col("unit").isin(*S.UNITS)).groupBy("unit").agg(F.count(F.lit(1)).alias("n")), f"SELECT unit, count(*) AS n FROM {_OFFER} WHERE unit <> 'per_month' GROUP BY 1")
_add("srt_cost_model", lambda s, d: R.rank_offers(R.price_offers(RQ._offers(s, d))).filter("bucket = 'ranked'").select("place", "id"), f"SELECT row_number() OVER (ORDER BY total, id) AS place, id FROM {RQ._PRICED} WHERE bucket = 'ranked'")
_add("win_rank_buckets", lambda s, d: R.rank_offers(R.price_offers(RQ._offers(s, d))).filter("place = 1").select("bucket", "id"), f"SELECT bucket, id FROM (SELECT bucket, id, row_number() OVER (PARTITION BY bucket ORDER BY CASE bucket WHEN 'ranked' THEN total WHEN 'unviable' THEN -block END NULLS LAST, id) AS k FROM {RQ._PRICED}) WHERE k = 1")
_add("set_except_rows", lambda s, d: R.price_offers(RQ._offers(s, d)).filter("bucket = 'unranked'").select("id"), f"SELECT id FROM {RQ._PRICED} WHERE bucket = 'unranked'")

# Products.
_add("agg_positive_share", lambda s, d: RQ._products(s, d).select("id", S.positive_share(F.lit(None).cast("double"), F.lit(None).cast("double"), F.col("rating")).alias("r")), f"SELECT id, least(greatest((rating - 1.0) / 4.0, 0.0), 1.0) AS r FROM {RQ._PRODUCTS}")
_add("flt_floor", lambda s, d: R.evaluate_products(RQ._products(s, d), floor=0.1).filter(F.col("adjusted") >= 0.1).select("id"), f"SELECT id FROM {RQ._EVALUATED} WHERE adjusted >= 0.1")
_add("flt_suspect", lambda s, d: R.evaluate_products(RQ._products(s, d)).filter(F.size("flags") > 0).select("id"), f"SELECT id FROM {RQ._EVALUATED} WHERE flags <> ''")
_add("m_value_per_1k", lambda s, d: R.evaluate_products(RQ._products(s, d)).select("id", "value"), f"SELECT id, value FROM {RQ._EVALUATED}")
_add("srt_value", lambda s, d: R.rank_products(R.evaluate_products(RQ._products(s, d), floor=0.1)).filter("bucket = 'below'").select("place", "id"), f"SELECT row_number() OVER (ORDER BY -adjusted, id) AS place, id FROM {RQ._EVALUATED} WHERE bucket = 'below'")

# Series.
_add("agg_cum_windows", lambda s, d: SQ.ts_unlocks(s, d).select("id", "within_30", "within_90", "within_365"), f"SELECT id, within_30, within_90, within_365 FROM ({SQ._UNLOCK_SQL})")
_add("win_nth_first", lambda s, d: SQ.ts_unlocks(s, d).select("id", "nearest_cliff"), f"SELECT id, nearest_cliff FROM ({SQ._UNLOCK_SQL})")
_add("dt_unlock_days", lambda s, d: table(s, d, "orders").select("o_orderkey", F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).alias("days")), "SELECT o_orderkey, CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS days FROM orders")
_add("m_unlock_row", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2.5).alias("usd"), B.safe_ratio(F.col("l_quantity") * 100.0, "l_extendedprice").alias("pct")), "SELECT l_orderkey, l_linenumber, l_quantity * 2.5::DOUBLE AS usd, l_quantity * 100.0 / nullif(l_extendedprice, 0) AS pct FROM lineitem")
_add("m_inflation", lambda s, d: table(s, d, "part").select("p_partkey", B.safe_ratio(F.col("p_size") * 100.0, "p_retailprice").alias("pct")), "SELECT p_partkey, p_size * 100.0::DOUBLE / nullif(p_retailprice, 0) AS pct FROM part")
_add("m_dcf_solve", lambda s, d: SQ.fin_reverse_dcf(s, d).select("id", F.col("growth").alias("g")), f"SELECT id, growth AS g FROM ({SQ.ORACLE_SQL['fin_reverse_dcf']})")
_add("join_scenarios", lambda s, d: table(s, d, "part").select("p_partkey", F.explode(F.array(F.lit(0.3), F.lit(0.5))).alias("drop")).select("p_partkey", F.col("drop").cast("double").alias("drop")), "SELECT p_partkey, unnest([0.3::DOUBLE, 0.5::DOUBLE]) AS drop FROM part")

# Gates.
_add("m_resilience", lambda s, d: G.assess_position(GQ._profiles(s, d)).select("id", "points", "band"), f"SELECT id, points, band FROM {GQ._ASSESSED}")
_add("m_position_caps", lambda s, d: G.assess_position(GQ._profiles(s, d)).filter("error is null").select("id", "binding"), f"SELECT id, binding FROM {GQ._ASSESSED} WHERE error IS NULL")
_FEED = "(SELECT user_id AS id, count(DISTINCT event_type) FILTER (value <> 0) AS venues, min(nullif(value, 0)) AS low, max(nullif(value, 0)) AS high, count(*) / 100.0::DOUBLE AS turnover FROM events GROUP BY 1)"


def _feed(s: SparkSession, d: str) -> DataFrame:
    """A user's events of a kind are its venues' prices; zero is no price."""
    e = table(s, d, "events").withColumn("value", F.nullif("value", F.lit(0.0)))
    return e.groupBy(F.col("user_id").alias("id")).agg(F.countDistinct(F.when(F.col("value").isNotNull(), F.col("event_type"))).alias("venues"), F.min("value").alias("low"), F.max("value").alias("high"), (F.count(F.lit(1)) / 100.0).alias("turnover"))


_add("m_turnover", lambda s, d: _feed(s, d).select("id", ((F.col("turnover") < 0.005) | (F.col("turnover") > 2.0)).alias("odd")), f"SELECT id, turnover < 0.005 OR turnover > 2.0 AS odd FROM {_FEED}")
_add("dt_age_min", lambda s, d: table(s, d, "events").select("event_id", (F.timestamp_diff("SECOND", F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")) / 60.0).alias("age")), "SELECT event_id, ((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) // 1000000)::DOUBLE / 60.0::DOUBLE AS age FROM events")
_add("snk_exit_code", lambda s, d: GQ.gate_live(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("n")), f"SELECT status, count(*) AS n FROM ({GQ.ORACLE_SQL['gate_live']}) GROUP BY 1")

# Calendars and nutrition.
_add("dt_lockin", lambda s, d: GQ.cal_lockin(s, d).filter("error is null").select("id", "event", "date", F.row_number().over(Window.partitionBy("id").orderBy("date", "event")).alias("k")), f"SELECT id, event, date, row_number() OVER (PARTITION BY id ORDER BY date, event) AS k FROM ({GQ.ORACLE_SQL['cal_lockin']}) WHERE error IS NULL")
_add("dt_lockin_guard", lambda s, d: GQ.cal_lockin(s, d).filter("error is not null").select("id", "error"), f"SELECT id, error FROM ({GQ.ORACLE_SQL['cal_lockin']}) WHERE error IS NOT NULL")
_add("dt_local", lambda s, d: table(s, d, "events").select("event_id", F.hour(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Kolkata")).alias("h")), "SELECT event_id, CAST(hour(ts + INTERVAL 330 MINUTES) AS INT) AS h FROM events")
_add("agg_count_if", lambda s, d: P.day_totals(GQ._items(s, d)).select("plan", "day", "protein_meals"), f"SELECT plan, day, protein_meals FROM {GQ._DAYS}")
_add("agg_max_default", lambda s, d: P.day_totals(GQ._items(s, d)).select("plan", "day", "largest_meal"), f"SELECT plan, day, largest_meal FROM {GQ._DAYS}")
_add("join_targets", lambda s, d: P.day_totals(GQ._items(s, d)).select("plan", "day", (F.col("kcal") - F.lit(1000.0)).alias("gap")), f"SELECT plan, day, kcal - 1000.0 AS gap FROM {GQ._DAYS}")
_add("m_swap_block", lambda s, d: table(s, d, "part").select("p_partkey", P.swap_portion(F.col("p_size") / 100.0).alias("grams")), "SELECT p_partkey, 25.0 / nullif(p_size / 100.0::DOUBLE, 0) AS grams FROM part")

# Pages.
_add("j_lenient", lambda s, d: WQ._product_pages(s, d).select("page_id", W.lenient_json(W.json_ld("html")[0]).isNotNull().alias("ok")), f"SELECT p_partkey AS page_id, true AS ok FROM {WQ._P4}")
_add("flt_substring_any", lambda s, d: table(s, d, "pages").select("page_id", B.contains_any("html", ["<footer", "<form"]).alias("r")), "SELECT page_id, contains(lower(html), '<footer') OR contains(lower(html), '<form') AS r FROM pages")
_add("set_dedup_urls", lambda s, d: table(s, d, "pages").select(WQ._host().alias("host")).dropDuplicates(), f"SELECT DISTINCT {WQ._HOSTQ} AS host FROM pages")

def nodes_of(f: DataFrame) -> DataFrame:
    """``f``: id, j. A list gives its elements, an object itself, a graph wrapper its children: id, pos, v."""
    f = f.withColumn("v", W.lenient_json(F.col("j")))
    graph = F.try_variant_get("v", "$['@graph']", "variant")
    top = F.when(graph.isNotNull(), graph).otherwise(F.col("v"))
    many = F.startswith(F.schema_of_variant(top), F.lit("ARRAY"))
    items = F.when(many, F.expr("CAST(t AS ARRAY<VARIANT>)")).otherwise(F.array("t"))
    return f.withColumn("t", top).select("id", F.posexplode(items).alias("pos", "v"))


def _types(v: str = "v") -> Column:
    one, some = F.try_variant_get(v, "$['@type']", "string"), F.try_variant_get(v, "$['@type']", "array<string>")
    return F.coalesce(some, F.array(one))


_add("topk_keys12", lambda s, d: table(s, d, "events").select("event_id", F.array_join(F.slice(F.array_sort(F.json_object_keys("props")), 1, 12), ",").alias("keys")), "SELECT event_id, array_to_string(list_slice(list_sort(json_keys(props)), 1, 12), ',') AS keys FROM events")

# Text.
_add("str_esc_xml", lambda s, d: table(s, d, "part").select("p_partkey", T.escape_xml(F.concat(F.lit('<"&'), "p_name")).alias("x")), "SELECT p_partkey, '&lt;&quot;&amp;' || p_name AS x FROM part")
_add("str_col_ref", lambda s, d: table(s, d, "nation").select("n_nationkey", T.column_letters(F.col("n_nationkey")).alias("c")), "SELECT n_nationkey, chr(65 + n_nationkey) AS c FROM nation")
_add("str_kebab", lambda s, d: table(s, d, "part").select("p_partkey", T.is_kebab(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("k")), "SELECT p_partkey, regexp_matches(replace(p_name, ' ', '-'), '^[a-z0-9]+(-[a-z0-9]+)*$') AND length(p_name) <= 64 AS k FROM part")
_add("snk_default_name", lambda s, d: table(s, d, "part").select("p_partkey", T.resume_name(F.col("p_name")).alias("f")), "SELECT p_partkey, array_to_string(list_slice(regexp_extract_all(p_name, '[A-Za-z]+'), 1, 3), '_') || '_Resume.docx' AS f FROM part")
_add("agg_proper_set", lambda s, d: TQ.agg_term_freq(s, d).filter("proper").select("item_id", "term"), f"SELECT item_id, term FROM ({TQ.ORACLE_SQL['agg_term_freq']}) WHERE proper")
_add("agg_run_stats", lambda s, d: table(s, d, "benchmark").select("item_id", F.explode(F.split("text", r"\s+")).alias("w")).groupBy("item_id").agg(F.avg(F.length("w")).alias("mean_run"), F.avg(F.when(F.length("w") <= 12, 1.0).otherwise(0.0)).alias("short_share")), r"SELECT item_id, avg(length(w)) AS mean_run, avg(CASE WHEN length(w) <= 12 THEN 1.0::DOUBLE ELSE 0.0 END) AS short_share FROM (SELECT item_id, unnest(string_split_regex(text, '\s+')) AS w FROM benchmark) GROUP BY 1")

# Rows that belong together.
_add("set_union_rows", lambda s, d: table(s, d, "region").select(F.lit("region").alias("source_file"), F.col("r_name").alias("name")).unionByName(table(s, d, "nation").select(F.lit("nation").alias("source_file"), F.col("n_name").alias("name"))), "SELECT 'region' AS source_file, r_name AS name FROM region UNION ALL SELECT 'nation', n_name FROM nation")
_add("join_doc_lines", lambda s, d: table(s, d, "orders").join(table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("lines")), "SELECT o_orderkey, count(*) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
_add("topk_news5", lambda s, d: table(s, d, "events").withColumn("k", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))).filter("k <= 5").select("event_type", "k", "event_id"), "SELECT event_type, k, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 5")
_add("flt_surprise_fresh", lambda s, d: table(s, d, "events").filter((F.col("value") > 100) & (F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz"))).select("event_id"), "SELECT event_id FROM events WHERE value > 100 AND ts >= TIMESTAMP '2024-01-20'")
_add("m_exposure_share", lambda s, d: table(s, d, "part").select("p_partkey", B.safe_ratio(F.when(F.col("p_size") > 10, F.col("p_size").cast("double")), "p_retailprice").alias("r")), "SELECT p_partkey, CASE WHEN p_size > 10 THEN p_size::DOUBLE END / nullif(p_retailprice, 0) AS r FROM part")
