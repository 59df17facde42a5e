"""Single steps of the composite operators, each with its own rows over whole tables and SQL that computes them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import basic as B
from ..functions import calendars as C
from ..functions import finance as N
from ..functions import text as T
from ..functions import web as W
from ..operators import documents as D
from ..operators import json_tree as J
from ..operators import nutrition as P
from . import text_queries as TQ
from . import web_queries as WQ
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _step(sql: str) -> Callable:
    def add(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[query.__name__], ORACLE_SQL[query.__name__] = query, sql
        return query

    return add


# Answers of a host: each page is a sample, its status follows from its number.
_STATUS_SQL = f"(SELECT page_id, {WQ._HOSTQ} AS host, CASE WHEN page_id % 7 = 0 THEN 403 WHEN page_id % 5 = 0 THEN 301 ELSE 200 END AS status FROM pages)"


def _samples(s: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("page_id") % 7 == 0, 403).when(F.col("page_id") % 5 == 0, 301).otherwise(200)
    return table(s, d, "pages").select("page_id", WQ._host().alias("host"), status.alias("status"))


@_step(f"SELECT page_id, status FROM {_STATUS_SQL} WHERE status BETWEEN 200 AND 399")
def flt_ok_status(s: SparkSession, d: str) -> DataFrame:
    return _samples(s, d).filter(F.col("status").between(200, 399)).select("page_id", "status")


def _ok_rate(s: SparkSession, d: str) -> DataFrame:
    return _samples(s, d).groupBy("host").agg(F.avg(F.when(F.col("status").between(200, 399), 1.0).otherwise(0.0)).alias("ok_rate"))


_RATE_SQL = f"(SELECT host, avg(CASE WHEN status BETWEEN 200 AND 399 THEN 1.0::DOUBLE ELSE 0.0 END) AS ok_rate FROM {_STATUS_SQL} GROUP BY 1)"


@_step(f"SELECT * FROM {_RATE_SQL}")
def agg_ok_rate(s: SparkSession, d: str) -> DataFrame:
    return _ok_rate(s, d)


@_step(f"SELECT CASE WHEN ok_rate = 1 THEN 'open' WHEN ok_rate = 0 THEN 'blocked' ELSE 'intermittent' END AS access, count(*) AS hosts FROM {_RATE_SQL} GROUP BY 1")
def agg_access_class(s: SparkSession, d: str) -> DataFrame:
    access = F.when(F.col("ok_rate") == 1, "open").when(F.col("ok_rate") == 0, "blocked").otherwise("intermittent")
    return _ok_rate(s, d).groupBy(access.alias("access")).agg(F.count(F.lit(1)).alias("hosts"))


# JSON leaves.
def _props(s: SparkSession, d: str) -> DataFrame:
    return J.walk(table(s, d, "events").select("event_id", F.try_parse_json("props").alias("v")), "event_id", "v")


def _part_leaves(s: SparkSession, d: str) -> DataFrame:
    return J.walk(WQ._product_pages(s, d).select("page_id", W.lenient_json(W.json_ld("html")[0]).alias("v")), "page_id", "v")


@_step("SELECT p_partkey AS page_id, path FROM part, (VALUES ('.offers[0].price'), ('.offers[0].priceCurrency')) AS l(path)")
def flt_key_match(s: SparkSession, d: str) -> DataFrame:
    return _part_leaves(s, d).filter(J.in_key("PRICE")).select(F.col("id").alias("page_id"), "path")


@_step("SELECT page_id, path FROM (SELECT p_partkey AS page_id, '.name' AS path, p_name AS v FROM part UNION ALL SELECT p_partkey, '.brand.name', p_brand FROM part UNION ALL SELECT p_partkey, '.@type', 'Product' FROM part) WHERE contains(lower(v), 'br')")
def flt_value_match(s: SparkSession, d: str) -> DataFrame:
    leaves = _part_leaves(s, d).filter(F.col("path").isin(".name", ".brand.name", ".@type"))
    return leaves.filter(J.in_value("Br")).select(F.col("id").alias("page_id"), "path")


@_step("SELECT event_id, path, CAST(k AS INT) AS place FROM (SELECT event_id, replace(t.fullkey, '$', '') AS path, row_number() OVER (PARTITION BY event_id ORDER BY replace(t.fullkey, '$', '')) AS k FROM events, json_tree(props) AS t WHERE t.atom IS NOT NULL AND contains(lower(t.key), 'k')) WHERE k <= 2")
def topk_hits(s: SparkSession, d: str) -> DataFrame:
    return J.find(_props(s, d), "K", keys=2).filter("kind = 'key'").select(F.col("id").alias("event_id"), "path", "place")


# Feeds: a user's greatest price at each venue; zero is none.
_VENUE_SQL = "(SELECT user_id AS id, event_type AS venue, max(nullif(value, 0)) AS price FROM events GROUP BY 1, 2 HAVING max(nullif(value, 0)) IS NOT NULL)"


def _venues(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("venue")).agg(F.max(F.nullif("value", F.lit(0.0))).alias("price")).filter("price is not null")


@_step(f"SELECT a.id, b.venue, (b.price - a.price) / a.price * 100.0 AS apart FROM {_VENUE_SQL} AS a JOIN {_VENUE_SQL} AS b ON a.id = b.id AND a.venue = 'view' AND b.venue <> 'view'")
def join_cross_feed(s: SparkSession, d: str) -> DataFrame:
    """The first feed beside each of the others."""
    v = _venues(s, d)
    first = v.filter("venue = 'view'").select("id", F.col("price").alias("first"))
    return v.filter("venue <> 'view'").join(first, "id").select("id", "venue", (B.safe_ratio(F.col("price") - F.col("first"), "first") * 100.0).alias("apart"))


@_step(f"SELECT id, count(*) AS venues, CASE WHEN count(*) >= 2 THEN (max(price) - min(price)) / min(price) * 100.0 END AS spread FROM {_VENUE_SQL} GROUP BY 1")
def agg_spread(s: SparkSession, d: str) -> DataFrame:
    g = _venues(s, d).groupBy("id").agg(F.count(F.lit(1)).alias("venues"), F.min("price").alias("low"), F.max("price").alias("high"))
    return g.select("id", "venues", N.spread_percent(F.col("low"), F.col("high"), F.col("venues")).alias("spread"))


@_step("SELECT event_id, CASE WHEN value <> 0 THEN (greatest(value, 50.0) - least(value, 50.0)) / least(value, 50.0) * 100.0 END AS spread FROM events")
def m_spread(s: SparkSession, d: str) -> DataFrame:
    v = F.nullif("value", F.lit(0.0))
    known = F.when(v.isNotNull(), 2).otherwise(1)
    return table(s, d, "events").select("event_id", N.spread_percent(F.least(v, F.lit(50.0)), F.greatest(v, F.lit(50.0)), known).alias("spread"))


# Calendars.
_LOCK_SQL = "(VALUES " + ", ".join(f"('{m}', '{b}', {n}, '{e}')" for m, b, n, e in C.LOCKINS) + ") AS r(m, base, days, event)"
_MARKETQ = "['IN','US','HK','XX'][o_orderkey % 4 + 1]"


def _listings(s: SparkSession, d: str) -> DataFrame:
    market = F.element_at(F.array(*(F.lit(m) for m in ("IN", "US", "HK", "XX"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), market.alias("market"), F.col("o_orderdate").cast("date").alias("listing"), F.lit(None).cast("date").alias("allotment"))


@_step(f"SELECT m AS market, base, days, count(*) AS listings FROM orders JOIN {_LOCK_SQL} ON m = {_MARKETQ} GROUP BY 1, 2, 3")
def join_rules_x_entity(s: SparkSession, d: str) -> DataFrame:
    """Each listing meets its market's rules; a rule with the listings it applies to."""
    rules = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(b).alias("base"), F.lit(n).alias("days")) for m, b, n, _ in C.LOCKINS))
    met = _listings(s, d).select("market", F.inline(F.filter(rules, lambda r: r["m"] == F.col("market"))))
    return met.groupBy("market", "base", "days").agg(F.count(F.lit(1)).alias("listings"))


@_step(f"SELECT id, event, CAST(row_number() OVER (PARTITION BY id ORDER BY days, event) AS INT) AS place FROM (SELECT o_orderkey AS id, event, days FROM orders JOIN {_LOCK_SQL} ON m = {_MARKETQ})")
def srt_events(s: SparkSession, d: str) -> DataFrame:
    e = C.lockin_events(_listings(s, d)).filter("error is null")
    return e.select("id", "event", F.row_number().over(Window.partitionBy("id").orderBy("date", "event")).alias("place"))


_SESSION_SQL = "(VALUES " + ", ".join(f"('{m}', '{z}', {o}, {c})" for m, z, o, c in C.SESSIONS) + ") AS t(market, zone, o, c)"


@_step(f"SELECT market, min(o)::INT AS opens, max(c)::INT AS closes, count(*) AS sessions FROM {_SESSION_SQL} GROUP BY 1")
def dt_session_bounds(s: SparkSession, d: str) -> DataFrame:
    rows = s.createDataFrame(list(C.SESSIONS), "market string, zone string, o int, c int")
    return rows.groupBy("market").agg(F.min("o").alias("opens"), F.max("c").alias("closes"), F.count(F.lit(1)).alias("sessions"))


def _sessions(s: SparkSession, d: str, market: str) -> DataFrame:
    return C.session_status(table(s, d, "events").select(F.col("event_id").alias("id"), F.lit(market).alias("market"), F.col("ts").alias("at")))


@_step("SELECT event_id AS id, CASE WHEN isodow(l) > 5 THEN 'weekend' WHEN m BETWEEN 540 AND 689 OR m BETWEEN 750 AND 929 THEN 'open' WHEN m < 540 THEN 'before the open' WHEN m >= 930 THEN 'after the close' ELSE 'midday break' END AS status FROM (SELECT event_id, l, hour(l) * 60 + minute(l) AS m FROM (SELECT event_id, ts + INTERVAL 9 HOURS AS l FROM events))")
def dt_session_status(s: SparkSession, d: str) -> DataFrame:
    return _sessions(s, d, "JP").select("id", "status")


@_step("SELECT event_id AS id, strftime(CAST(l AS DATE) + CAST(CASE WHEN isodow(l) = 5 AND m >= 555 THEN 3 WHEN isodow(l) = 6 THEN 2 WHEN isodow(l) = 7 THEN 1 WHEN m >= 555 THEN 1 ELSE 0 END AS INT), '%Y-%m-%d') || ' 03:45' AS next_open FROM (SELECT event_id, l, hour(l) * 60 + minute(l) AS m FROM (SELECT event_id, ts + INTERVAL 330 MINUTES AS l FROM events))")
def dt_next_session(s: SparkSession, d: str) -> DataFrame:
    return _sessions(s, d, "IN").select("id", F.date_format("next_open", "yyyy-MM-dd HH:mm").alias("next_open"))


# Lines, blocks and cells.
@_step("SELECT conv_id, turn, length(lag(text) OVER w) AS before, length(lead(text) OVER w) AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)")
def join_self_neighbour(s: SparkSession, d: str) -> DataFrame:
    """A turn with those beside it."""
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), F.asc_nulls_last("text"))
    return table(s, d, "conversations").select("conv_id", "turn", F.length(F.lag("text").over(w)).cast("long").alias("before"), F.length(F.lead("text").over(w)).cast("long").alias("after"))


@_step("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS opened FROM events")
def win_section_ffill(s: SparkSession, d: str) -> DataFrame:
    """The heading that holds: the last one at or before a row."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(s, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(order).alias("opened"))


def _tables(s: SparkSession, d: str) -> DataFrame:
    return D.layout_tables(D.pages_of(TQ._layout(s, d), "id", "text"))


_CELLS_SQL = "(SELECT s_nationkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS row, s_name AS a, CAST(s_suppkey AS VARCHAR) AS b, CAST(CAST(round(s_acctbal, 0) AS BIGINT) AS VARCHAR) AS c, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)"


@_step(f"SELECT id, CAST(row AS INT) AS row, concat_ws('|', a, b, c) AS cells FROM {_CELLS_SQL} WHERE n >= 3")
def a_block_to_rows(s: SparkSession, d: str) -> DataFrame:
    return _tables(s, d).select("id", F.posexplode("cells").alias("row", "c")).select("id", "row", F.array_join("c", "|").alias("cells"))


@_step(f"SELECT id, col, 1.0::DOUBLE AS fill, max(CASE col WHEN 0 THEN length(a) WHEN 1 THEN length(b) ELSE length(c) END)::INT AS widest FROM {_CELLS_SQL}, (VALUES (0), (1), (2)) AS v(col) WHERE n >= 3 GROUP BY 1, 2")
def agg_fill_stats(s: SparkSession, d: str) -> DataFrame:
    """Share of filled cells and widest cell of each column."""
    cells = _tables(s, d).select("id", F.explode("cells").alias("c")).select("id", F.posexplode("c").alias("col", "cell"))
    return cells.groupBy("id", "col").agg(F.avg(F.when(F.col("cell") != "", 1.0).otherwise(0.0)).alias("fill"), F.max(F.length("cell")).alias("widest"))


# Terms and sets.
@_step(f"SELECT item_id, term, CAST(k AS INT) AS place FROM (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY -(n + CASE WHEN proper THEN 2 ELSE 0 END), words, length(term), term) AS k FROM ({TQ.ORACLE_SQL['agg_term_freq']})) WHERE k <= 8")
def srt_terms(s: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(-(F.col("n") + F.when(F.col("proper"), 2).otherwise(0)), "words", F.length("term"), "term")
    return TQ.agg_term_freq(s, d).withColumn("place", F.row_number().over(order)).filter("place <= 8").select("item_id", "term", "place")


@_step(f"SELECT id, matched, missing FROM ({TQ.ORACLE_SQL['join_wheres_term']})")
def set_matched_missing(s: SparkSession, d: str) -> DataFrame:
    return TQ.join_wheres_term(s, d).select("id", "matched", "missing")


@_step(f"SELECT rate, count(*) AS documents FROM ({TQ.ORACLE_SQL['join_wheres_term']}) GROUP BY 1")
def agg_match_rate(s: SparkSession, d: str) -> DataFrame:
    return TQ.join_wheres_term(s, d).groupBy("rate").agg(F.count(F.lit(1)).alias("documents"))


@_step("SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1")
def set_union_columns(s: SparkSession, d: str) -> DataFrame:
    """All keys of all records, with the records that have them."""
    return table(s, d, "events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


_WORDS_SQL = "(SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part)"


def _word_sets(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", F.array_distinct(F.split(F.lower("p_name"), " ")).alias("a"), F.array_distinct(F.split(F.lower("p_type"), " ")).alias("b"))


@_step(f"SELECT p_partkey, array_to_string(list_sort(list_intersect(a, list_concat(b, ['part', 'red', 'blue']))), ',') AS common FROM {_WORDS_SQL}")
def set_intersect_fonts(s: SparkSession, d: str) -> DataFrame:
    return _word_sets(s, d).select("p_partkey", F.array_join(F.array_sort(F.array_intersect("a", F.concat("b", F.array(F.lit("part"), F.lit("red"), F.lit("blue"))))), ",").alias("common"))


@_step(f"SELECT p_partkey, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS left_over FROM {_WORDS_SQL}")
def set_diff_keys(s: SparkSession, d: str) -> DataFrame:
    return _word_sets(s, d).select("p_partkey", F.array_join(F.array_sort(F.array_except("a", "b")), ",").alias("left_over"))


@_step(f"SELECT p_partkey, list_has_all(a, ['part']) AS has FROM {_WORDS_SQL}")
def set_subset_classes(s: SparkSession, d: str) -> DataFrame:
    return _word_sets(s, d).select("p_partkey", (F.size(F.array_except(F.array(F.lit("part")), "a")) == 0).alias("has"))


@_step("SELECT source, n, CAST(row_number() OVER (ORDER BY n DESC, source NULLS LAST) AS INT) AS place FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def srt_type_count(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), F.asc_nulls_last("source"))))


# Pages.
_SELECTORS = ("div.card span.price", "#root .price", "a[href]", "div > span", "table td", "p.x.y#z")


@_step("SELECT * FROM (VALUES ('div.card span.price', 2, 'span', 'price', true), ('#root .price', 2, '', 'price', true), ('a[href]', NULL, NULL, NULL, false), ('div > span', NULL, NULL, NULL, false), ('table td', 2, 'td', '', true), ('p.x.y#z', 1, 'p', 'x,y', true)) AS t(selector, steps, tag, classes, readable)")
def str_selector_parse(s: SparkSession, d: str) -> DataFrame:
    """Steps of a selector, and tag and classes of the last; null where it can't be read."""
    f = s.createDataFrame([(x,) for x in _SELECTORS], "selector string")
    parts = W.selector_parts(F.col("selector"))
    last = F.element_at("p", -1)
    return f.withColumn("p", parts).select("selector", F.when(F.col("p").isNotNull(), F.size("p")).alias("steps"), last["tag"].alias("tag"), F.array_join(last["classes"], ",").alias("classes"), F.col("p").isNotNull().alias("readable"))


@_step("SELECT kind, CAST(each * (SELECT count(*) FROM part) AS BIGINT) AS n FROM (VALUES ('jsonld', 1), ('meta', 2), ('feeds', 1), ('tables', 1), ('items', 1)) AS t(kind, each)")
def agg_summary_counts(s: SparkSession, d: str) -> DataFrame:
    """What all pages publish, by kind."""
    h = WQ.web_harvest(s, d)
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in ("jsonld", "meta", "feeds", "tables", "items")))
    return h.select(F.inline(kinds)).groupBy("kind").agg(F.sum("n").alias("n"))


@_step("SELECT p_partkey AS page_id, 'https://shop.example/feed/' || p_partkey AS feed FROM part")
def m_feeds(s: SparkSession, d: str) -> DataFrame:
    return WQ._product_pages(s, d).select("page_id", F.explode(F.transform(W.feeds("html"), lambda x: W.resolve(F.col("url"), x))).alias("feed"))


_ASSETS_SQL = rf"""(SELECT DISTINCT host, asset FROM (SELECT {WQ._HOSTQ} AS host, unnest(regexp_extract_all(html, '(?i)\b(?:src|href)="([^"]+)"', 1)) AS asset FROM pages))"""


@_step(f"SELECT host, avg(strlen(asset)) FILTER (WHERE k <= 8) * count(*) AS bytes, count(*) AS assets FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY asset) AS k FROM {_ASSETS_SQL}) GROUP BY 1")
def agg_asset_extrapolate(s: SparkSession, d: str) -> DataFrame:
    """Mean weight of a host's first eight distinct assets times their number; an asset weighs what its link does."""
    links = F.regexp_extract_all("html", F.lit(r'(?i)\b(?:src|href)="([^"]+)"'), F.lit(1))
    assets = table(s, d, "pages").select(WQ._host().alias("host"), F.explode(links).alias("asset")).distinct()
    return W.extrapolated(assets, "host", "asset", F.octet_length("asset"))


@_step(r'''SELECT page_id, strlen(html) / (strlen(html) + 1000.0::DOUBLE * len(list_distinct(regexp_extract_all(html, '(?i)\bhref="([^"]+)"', 1)))) AS share FROM pages''')
def m_html_share(s: SparkSession, d: str) -> DataFrame:
    """What of a page's traffic is the document, with a thousand bytes an asset."""
    assets = 1000.0 * F.size(F.array_distinct(F.regexp_extract_all("html", F.lit(r'(?i)\bhref="([^"]+)"'), F.lit(1))))
    page = F.octet_length("html").cast("double")
    return table(s, d, "pages").select("page_id", B.safe_ratio(page, page + assets).alias("share"))


_SNAPSHOT_SQL = "(SELECT url, CASE WHEN page_id % 3 = 0 THEN length(html) - 1 ELSE length(html) END AS lastmod FROM pages WHERE page_id % 5 <> 0)"


@_step(f"SELECT p.page_id, CASE WHEN contains(url, '?') THEN 'daily' WHEN contains(url, '#') THEN 'weekly' ELSE 'monthly' END AS tier FROM pages AS p WHERE NOT EXISTS (SELECT 1 FROM {_SNAPSHOT_SQL} AS o WHERE o.url = p.url AND o.lastmod = length(p.html))")
def m_refresh_tiers(s: SparkSession, d: str) -> DataFrame:
    """Pages to fetch again: those whose (url, lastmod) is not in the last snapshot, each by its tier."""
    p = table(s, d, "pages").select("page_id", "url", F.length("html").alias("lastmod"))
    known = p.filter("page_id % 5 <> 0").select("url", F.when(F.col("page_id") % 3 == 0, F.col("lastmod") - 1).otherwise(F.col("lastmod")).alias("lastmod"))
    tier = F.when(F.contains("url", F.lit("?")), "daily").when(F.contains("url", F.lit("#")), "weekly").otherwise("monthly")
    return W.changed(p, known).select("page_id", tier.alias("tier"))


# People and companies.
_PEOPLE_SQL = "(SELECT c_custkey AS id, CAST(14 + c_custkey % 60 AS INT) AS age, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex, (150 + c_custkey % 45)::DOUBLE AS h, (42 + c_custkey % 70)::DOUBLE AS w, (40 + c_custkey % 50)::DOUBLE AS g, c_custkey % 11 = 0 AS pregnant FROM customer)"


def _people(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(s, d, "customer").select(
        k.alias("id"), (14 + k % 60).cast("int").alias("age"), F.when(k % 2 == 0, "male").otherwise("female").alias("sex"), (150 + k % 45).cast("double").alias("height_cm"), (42 + k % 70).cast("double").alias("weight_kg"),
        F.lit(None).cast("double").alias("body_fat_pct"), F.lit("light").alias("activity"), (40 + k % 50).cast("double").alias("goal_kg"), (k % 11 == 0).alias("pregnant"),
    )


_STOPS_SQL = "concat_ws(',', CASE WHEN age < 18 THEN 'under age' END, CASE WHEN w / (h / 100.0 * h / 100.0) < 18.5 THEN 'underweight' END, CASE WHEN pregnant THEN 'pregnancy' END, CASE WHEN g / (h / 100.0 * h / 100.0) < 18.5 THEN 'goal underweight' END)"


@_step(f"SELECT id, {_STOPS_SQL} AS stops FROM {_PEOPLE_SQL}")
def m_stop_rules(s: SparkSession, d: str) -> DataFrame:
    return P.plan_targets(_people(s, d)).select("id", F.array_join("stops", ",").alias("stops"))


_TDEE_SQL = "(10.0 * w + 6.25 * h - 5.0 * age + CASE WHEN sex = 'male' THEN 5.0 ELSE -161.0 END)::DOUBLE * 1.375::DOUBLE"


@_step(f"SELECT id, CASE WHEN stops = '' THEN round(greatest(tdee - least(w * CASE WHEN w / (h / 100.0 * h / 100.0) < 22 THEN 0.005::DOUBLE ELSE 0.0075 END * 1100.0::DOUBLE, 0.25::DOUBLE * tdee), CASE WHEN sex = 'male' THEN 1500.0 ELSE 1200.0 END), 6) END AS target FROM (SELECT *, {_TDEE_SQL} AS tdee, {_STOPS_SQL} AS stops FROM {_PEOPLE_SQL})")
def m_targets(s: SparkSession, d: str) -> DataFrame:
    return P.plan_targets(_people(s, d)).select("id", F.round("target", 6).alias("target"))


_BALANCE_SQL = "(SELECT l_orderkey AS id, sum(l_extendedprice) / 10 AS ebit, sum(l_quantity) AS interest, sum(l_extendedprice) / 2 AS debt, sum(l_extendedprice) AS equity, sum(l_quantity * l_discount) * 100 AS cash, sum(l_quantity) * 3 AS da FROM lineitem GROUP BY 1)"


@_step(f"SELECT id, round(ebit * 0.75 / nullif(debt + equity - cash, 0), 9) AS roic, round(ebit / nullif(debt + equity, 0), 9) AS roce, round((ebit - interest) * 0.75 / nullif(equity, 0), 9) AS roe, round(ebit / nullif(interest, 0), 9) AS cover, round((debt - cash) / nullif(ebit + da, 0), 9) AS leverage FROM {_BALANCE_SQL}")
def m_roic(s: SparkSession, d: str) -> DataFrame:
    """Returns on capital, interest cover and net debt to EBITDA."""
    g = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg((F.sum("l_extendedprice") / 10).alias("ebit"), F.sum("l_quantity").alias("interest"), (F.sum("l_extendedprice") / 2).alias("debt"), F.sum("l_extendedprice").alias("equity"), (F.sum(F.col("l_quantity") * F.col("l_discount")) * 100).alias("cash"), (F.sum("l_quantity") * 3).alias("da"))
    found = N.returns_on_capital(*(F.col(c) for c in ("ebit", "interest", "debt", "equity", "cash", "da")), tax=0.25)
    return g.select("id", *(F.round(v, 9).alias(k) for k, v in found.items()))


@_step("SELECT s_nationkey, '  ' || rpad(s_name, 24, ' ') || lpad(CAST(CAST(round(s_acctbal, 0) AS BIGINT) AS VARCHAR), 12, ' ') AS line FROM supplier")
def snk_text_report(s: SparkSession, d: str) -> DataFrame:
    """Lines of a fixed-width report."""
    rows = table(s, d, "supplier").select("s_nationkey", "s_name", F.round("s_acctbal", 0).cast("long").cast("string").alias("amount"))
    return rows.select("s_nationkey", T.report_line((("s_name", 24, False), ("amount", 12, True))).alias("line"))
