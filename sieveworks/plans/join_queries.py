"""Joins, scopes, blocks and orders whose other side is a table: rules, markers, sessions and elements, all made from
the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendars as C
from ..functions import web as W
from ..operators import blocks as L
from ..operators import intervals as I
from ..operators import markers as M
from ..operators import prefix_rules as R
from ..operators import robots
from ..operators import scopes as S
from . import web_queries as WQ
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _step(sql: str) -> Callable:
    def add(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[query.__name__], ORACLE_SQL[query.__name__] = query, sql
        return query

    return add


# Rules: the beginnings of each host's own paths, every second one forbidden.
_PATHQ = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
_PATHS_SQL = f"(SELECT page_id, {WQ._HOSTQ} AS host, {_PATHQ} AS path FROM pages)"
_RULES_SQL = f"(SELECT host, rule, min(page_id) AS pos, CASE WHEN min(page_id) % 2 = 0 THEN 'allow' ELSE 'disallow' END AS kind FROM (SELECT page_id, host, path[1:1 + page_id % 12] AS rule FROM {_PATHS_SQL}) GROUP BY 1, 2)"


def _paths(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", WQ._host().alias("host"), R.path_of("url").alias("path"))


def _rules(s: SparkSession, d: str) -> DataFrame:
    begun = _paths(s, d).select("page_id", "host", F.substring(F.col("path"), F.lit(1), (1 + F.col("page_id") % 12).cast("int")).alias("rule"))
    rules = begun.groupBy("host", "rule").agg(F.min("page_id").alias("pos"))
    return rules.withColumn("kind", F.when(F.col("pos") % 2 == 0, "allow").otherwise("disallow"))


@_step(f"SELECT page_id, pos, rule FROM {_PATHS_SQL} AS p JOIN {_RULES_SQL} AS r ON p.host = r.host AND starts_with(path, rule) WHERE rule <> ''")
def join_longest_prefix(s: SparkSession, d: str) -> DataFrame:
    """All rules of its host that are a prefix of a page's path."""
    return R.matches(_paths(s, d), _rules(s, d), "page_id").select("page_id", "pos", "rule")


@_step(f"SELECT page_id, kind, rule FROM (SELECT page_id, kind, rule, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, kind, pos) AS k FROM {_PATHS_SQL} AS p JOIN {_RULES_SQL} AS r ON p.host = r.host AND starts_with(path, rule) WHERE rule <> '') WHERE k = 1")
def topk_match_longest(s: SparkSession, d: str) -> DataFrame:
    """The longest rule decides; of equal ones the one that allows."""
    return R.longest(_paths(s, d), _rules(s, d), "page_id").select("page_id", "kind", "rule")


# Robots files: one a host, made of its first and last path and its number of pages.
_ROBOTS_SQL = f"(SELECT host, min(path) AS low, max(path) AS high, count(*) AS n FROM {_PATHS_SQL} GROUP BY 1)"


def _files(sites: DataFrame, site: str) -> DataFrame:
    """``sites``: a site's name, host, low, high (paths) and n, as a robots file with a shared group, a comment, a line
    of its own for another group, and a closing ``$``."""
    lines = [F.lit("# made of pages"), F.lit("User-agent: *"), F.lit("User-agent: Other"), F.concat(F.lit("Disallow: "), "low"), F.concat(F.lit("Allow: "), "high"), F.concat(F.lit("Crawl-delay: "), F.col("n").cast("string")), F.concat(F.lit("Sitemap: https://"), "host", F.lit("/sitemap.xml")), F.lit(""), F.lit("user-agent: GPTBot"), F.lit("disallow: /"), F.lit("allow: /en/1$")]
    return sites.select(F.col(site).alias("id"), F.concat_ws("\n", *lines).alias("robots"))


def _robots(s: SparkSession, d: str) -> DataFrame:
    hosts = _paths(s, d).groupBy("host").agg(F.min("path").alias("low"), F.max("path").alias("high"), F.count(F.lit(1)).alias("n"))
    return _files(hosts, "host")


@_step(f"SELECT page_id, CASE WHEN length(high) < length(low) AND starts_with(path, low) THEN false WHEN starts_with(path, high) THEN true WHEN starts_with(path, low) THEN false ELSE true END AS allowed, CASE WHEN length(high) < length(low) AND starts_with(path, low) THEN nullif(low, '') WHEN starts_with(path, high) THEN nullif(high, '') WHEN starts_with(path, low) THEN nullif(low, '') END AS matched_rule FROM {_PATHS_SQL} AS p JOIN {_ROBOTS_SQL} USING (host)".replace("starts_with(path, low)", "(low <> '' AND starts_with(path, low))").replace("starts_with(path, high)", "(high <> '' AND starts_with(path, high))"))
def web_robots(s: SparkSession, d: str) -> DataFrame:
    """Whether its host's robots file allows each page, and the rule that decides."""
    return R.allowed(_paths(s, d), robots.rules_of(_robots(s, d)), "page_id")


_LINES_SQL = "[('user-agent', '*', 1, 1), ('user-agent', 'Other', 2, 1), ('disallow', low, 3, 1), ('allow', high, 4, 1), ('crawl-delay', CAST(n AS VARCHAR), 5, 1), ('sitemap', 'https://' || host || '/sitemap.xml', 6, NULL), ('user-agent', 'GPTBot', 8, 2), ('disallow', '/', 9, 2), ('allow', '/en/1$', 10, 2)]"


@_step(f"SELECT page_id, l[3] AS pos, l[1] AS key, l[2] AS value, CAST(l[4] AS BIGINT) AS grp FROM (SELECT page_id, unnest({_LINES_SQL}) AS l FROM (SELECT page_id, host, path AS low, path || 'x' AS high, length(url) AS n FROM {_PATHS_SQL} JOIN pages USING (page_id)))".replace("[(", "[row(").replace(", (", ", row("))
def win_robots_groups(s: SparkSession, d: str) -> DataFrame:
    """The directives of a robots file a page; agents that follow each other open one group."""
    sites = table(s, d, "pages").select("page_id", WQ._host().alias("host"), R.path_of("url").alias("low"), F.length("url").alias("n")).withColumn("high", F.concat("low", F.lit("x")))
    return robots.directives(_files(sites, "page_id")).select(F.col("id").alias("page_id"), "pos", "key", "value", "grp")


# Markers: what vendors, captchas and frameworks leave in a page, and the hosts of all pages.
_FIXED = tuple(sorted({m for v in W.VENDORS for m in v[5]} | {m for c in W.CAPTCHAS for m in c[1]} | {m for m, _ in W.FRAMEWORKS} | set(W.EMBEDDED) | {"<nav", "<footer", "<form", "track("}))


@_step(f"SELECT page_id, m AS marker FROM pages JOIN (SELECT DISTINCT lower({WQ._HOSTQ}) AS m FROM pages UNION SELECT * FROM (VALUES " + ", ".join(f"('{m}')" for m in _FIXED) + ")) AS v ON m <> '' AND contains(lower(html), m)")
def join_marker_theta(s: SparkSession, d: str) -> DataFrame:
    """Every page with each marker in it."""
    pages = table(s, d, "pages")
    marks = pages.select(WQ._host().alias("marker")).unionByName(pages.limit(1).select(F.explode(F.array(*(F.lit(m) for m in _FIXED))).alias("marker")))
    return M.matching(pages, "page_id", "html", marks)


# Scopes: tokens of tags, folded with a stack of open elements.
_VOIDS = ", ".join(f"'{t}'" for t in sorted(S.VOID))
_TOKENS_SQL = r"""tokens AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) AS i, lower(regexp_extract(t, '^</?([a-zA-Z][^\s/>]*)', 1)) AS tag, starts_with(t, '</') AS closing FROM (SELECT page_id, unnest(r) AS t, generate_subscripts(r, 1) AS k FROM (SELECT page_id, regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)(<(?:script|style)[^>]*>).*?(</(?:script|style))', '\1\2', 'g'), '</?[a-zA-Z][^>]*>') AS r FROM pages)))"""
_STACK_SQL = f"""walk(page_id, i, tag, above, stack) AS (SELECT page_id, 0::BIGINT, NULL::VARCHAR, []::VARCHAR[], []::VARCHAR[] FROM pages UNION ALL
 SELECT w.page_id, t.i, CASE WHEN NOT closing THEN t.tag END, stack, CASE WHEN closing THEN CASE WHEN list_contains(stack, t.tag) THEN stack[1:len(stack) - list_position(list_reverse(stack), t.tag)] ELSE stack END WHEN t.tag IN ({_VOIDS}) THEN stack ELSE list_append(stack, t.tag) END
 FROM walk AS w JOIN tokens AS t ON t.page_id = w.page_id AND t.i = w.i + 1)"""
_SELECTORS = {"in_nav": "nav li a", "in_article": "article p", "in_bold": "b p", "twice": "p p p", "ads": "body div.ad"}


@_step(f"WITH RECURSIVE {_TOKENS_SQL}, {_STACK_SQL} SELECT page_id, count(*) AS elements, max(len(above) + 1)::INT AS deepest, count_if(tag = 'a' AND list_contains(above, 'li') AND list_contains(above[1:list_position(above, 'li')], 'nav')) AS in_nav, count_if(tag = 'p' AND list_contains(above, 'article')) AS in_article, count_if(tag = 'p' AND list_contains(above, 'b')) AS in_bold, count_if(tag = 'p' AND len(list_filter(above, lambda x: x = 'p')) >= 2) AS twice, count_if(tag = 'div' AND list_contains(above, 'body')) AS ads FROM walk WHERE tag IS NOT NULL GROUP BY 1")
def win_scope_stack(s: SparkSession, d: str) -> DataFrame:
    """Elements of each page, its depth, and what lies in whose scope, where tags stay open too."""
    found = S.matching(S.elements(table(s, d, "pages"), "page_id", "html"), "page_id", _SELECTORS)
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("elements"), F.max("depth").alias("deepest"), *(F.count_if(F.col(n)).alias(n) for n in _SELECTORS))


# Blocks of lines.
_ALL_LINES_SQL = r"(SELECT doc_id, unnest(r) AS line, generate_subscripts(r, 1)::INT - 1 AS pos FROM (SELECT doc_id, string_split_regex(replace(text, chr(12), chr(10) || chr(10)), '\r\n|[\r\n]') AS r FROM documents WHERE text IS NOT NULL))"
_BLANKQ = "trim(line, ' ' || chr(9) || chr(11)) = ''"
_BLOCKS_SQL = f"(SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, block) AS n FROM (SELECT doc_id, pos, line, 1 + coalesce(max(CASE WHEN {_BLANKQ} THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos), -1) AS block, {_BLANKQ} AS blank FROM {_ALL_LINES_SQL}) WHERE NOT blank) WHERE n >= 3)"


def _blocks(s: SparkSession, d: str) -> DataFrame:
    return L.text_blocks(L.lines_of(table(s, d, "documents"), "doc_id", "text"), "doc_id")


@_step(f"SELECT doc_id, block::INT AS block, min(pos)::INT AS first, count(*) AS lines FROM {_BLOCKS_SQL} GROUP BY 1, 2")
def win_text_blocks(s: SparkSession, d: str) -> DataFrame:
    """Runs of three lines or more that are not blank."""
    return _blocks(s, d).groupBy("doc_id", "block").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("lines"))


@_step(f"SELECT doc_id, pos, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS seen FROM {_ALL_LINES_SQL} WHERE NOT {_BLANKQ}")
def win_seen_content(s: SparkSession, d: str) -> DataFrame:
    """Which line of content a line is."""
    lines = L.lines_of(table(s, d, "documents"), "doc_id", "text").filter(~F.col("blank"))
    return lines.select("doc_id", "pos", F.row_number().over(L.Window.partitionBy("doc_id").orderBy("pos")).alias("seen"))


_ROW_SQL = "rpad(s_name, 22, ' ') || '   ' || rpad(CAST(s_suppkey AS VARCHAR), 8, ' ') || '   ' || lpad(CAST(CAST(round(s_acctbal, 0) AS BIGINT) AS VARCHAR), 8, ' ') || CASE WHEN s_suppkey % 3 = 0 THEN '    ' || s_nationkey ELSE '' END"
_GAPS_SQL = f"""WITH blocks AS MATERIALIZED (SELECT 'document ' || doc_id AS id, block::INT AS block, line FROM {_BLOCKS_SQL} UNION ALL SELECT 'nation ' || s_nationkey, 0, {_ROW_SQL} FROM supplier),
 wide AS (SELECT id, block, max(length(line)) AS width FROM blocks GROUP BY 1, 2),
 solid AS (SELECT DISTINCT id, block, unnest(list_filter(range(0, length(line)), lambda k: line[k + 1] <> ' ')) AS col FROM blocks),
 edges AS (SELECT id, block, col, lead(col) OVER (PARTITION BY id, block ORDER BY col) AS following, row_number() OVER (PARTITION BY id, block ORDER BY col) AS k FROM solid),
 runs AS (SELECT id, block, col + 1 AS start, coalesce(following, width) AS stop, width FROM edges JOIN wide USING (id, block) UNION ALL SELECT id, block, 0, col, width FROM edges JOIN wide USING (id, block) WHERE k = 1)
 SELECT id, block, start::INT AS start, stop::INT AS stop, width::INT AS width FROM runs WHERE stop - start >= 2"""


@_step(_GAPS_SQL)
def win_blank_runs(s: SparkSession, d: str) -> DataFrame:
    """Runs of two columns or more that are blank in every line of a block: of the blocks of documents, and of one
    block of laid-out rows, of differing width, a nation."""
    text = lambda c: F.col(c).cast("string")
    line = F.concat(F.rpad("s_name", 22, " "), F.lit("   "), F.rpad(text("s_suppkey"), 8, " "), F.lit("   "), F.lpad(F.round("s_acctbal", 0).cast("long").cast("string"), 8, " "), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("    "), text("s_nationkey"))).otherwise(""))
    rows = table(s, d, "supplier").select(F.concat(F.lit("nation "), text("s_nationkey")).alias("id"), F.lit(0).alias("block"), line.alias("line"))
    docs = _blocks(s, d).select(F.concat(F.lit("document "), text("doc_id")).alias("id"), "block", "line")
    return L.column_gaps(docs.unionByName(rows), "id")


# Sessions.
_MARKETS = tuple(dict.fromkeys(m for m, *_ in C.SESSIONS))
_EVENTS_SQL = f"(SELECT event_id, ts AS stamp, [{', '.join(repr(m) for m in (*_MARKETS, 'XX'))}][(user_id % {len(_MARKETS) + 1} + 1)::INT] AS market FROM events)"
_SESSION_NUMBERS = [(m, sum(x[0] == m for x in C.SESSIONS[: k + 1]), z, o, c) for k, (m, z, o, c) in enumerate(C.SESSIONS)]
_OPEN_SQL = f"(SELECT market, session, day, timezone('UTC', timezone(zone, day + to_minutes(o))) AS starts, timezone('UTC', timezone(zone, day + to_minutes(c))) AS ends FROM (SELECT DISTINCT CAST(ts AS DATE) + k AS day FROM events, (VALUES (-1), (0), (1)) AS v(k)), (VALUES {', '.join(str(x) for x in _SESSION_NUMBERS)}) AS t(market, session, zone, o, c) WHERE isodow(day) <= 5)"


@_step(f"SELECT event_id, e.market, session, day, (epoch_us(stamp) - epoch_us(starts)) // 1000000 AS seconds_in FROM {_EVENTS_SQL} AS e LEFT JOIN {_OPEN_SQL} AS o ON o.market = e.market AND stamp >= starts AND stamp < ends")
def join_sessions_x_days(s: SparkSession, d: str) -> DataFrame:
    """Each event with the session of its market that is open at its time, if one is."""
    market = F.element_at(F.array(*(F.lit(m) for m in (*_MARKETS, "XX"))), (F.col("user_id") % (len(_MARKETS) + 1) + 1).cast("int"))
    events = table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"), market.alias("market"))
    found = I.event_sessions(events, "event_id").join(events.select("event_id", "at"), "event_id")
    return found.select("event_id", "market", "session", "day", F.floor((F.unix_micros("at") - F.unix_micros("starts")) / 1_000_000).alias("seconds_in"))
