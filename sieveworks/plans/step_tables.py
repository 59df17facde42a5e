"""Single steps over rows that are made of whole tables: lines of text of customers, cells and records of parts and
orders, and SQL that computes each result from the same columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import basic as B
from ..functions import calendars as C
from ..functions import finance as N
from ..functions import text as T
from ..operators import documents as D
from ..operators import gates as G
from ..operators import nutrition as P
from . import inventory_queries as IQ
from . import series_queries as SQ
from . import step_queries as ST
from . import text_queries as TQ
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, sql


def _pick(values: list, k: Column) -> Column:
    return F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (k % len(values) + 1).cast("int"))


def _pick_sql(values: list[str], k: str) -> str:
    """``values``: SQL expressions."""
    return f"[{', '.join(values)}][({k} % {len(values)} + 1)::INT]"


def _quoted(values: list[str]) -> list[str]:
    return ["'" + v.replace("'", "''") + "'" for v in values]


# Lines of text: what a person's record might say, by its number, name and segment.
_HEADINGS = ["WORK EXPERIENCE", "Experience", "My Journey", "Employment History:", "Technical Skills", "I did this and that", "Education and Training", "Profile"]
_MONTHS, _JOINS = ["Mar ", "", "03/", "May "], [" - ", " – ", " to ", "-"]
_OPENERS = ["• Led ", "• Responsible for ", "- Helped ", "➢ Built ", "Worked on "]
_STARS = ["★", "★★", "★★★", "●●●○", ""]


def _lines(s: SparkSession, d: str) -> DataFrame:
    k, name, segment = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    year = (1990 + k % 30).cast("string")
    until = _pick([F.lit("Present"), (1995 + k % 25).cast("string"), F.lit("19"), F.lit("now")], k % 7)
    lines = [
        name, F.concat(F.lower(F.replace(name, F.lit("#"), F.lit("."))), F.lit("@example.org | https://example.org/"), k.cast("string")), _pick(_HEADINGS, k),
        F.concat(F.lit("Clerk, "), F.initcap(segment), F.lit(" Corp, "), _pick(_MONTHS, k), year, _pick(_JOINS, k), until), F.concat(_pick(_OPENERS, k), segment, F.lit(" ("), F.substring(segment, 1, 3), F.lit(")")), F.concat(F.lit("Python "), _pick(_STARS, k)),
        _pick([F.lit("[Your Name] of [your name]"), F.lit("TBD"), name], k), F.concat(F.lit("“"), name, F.lit("”  –  ‘"), segment, F.lit("’ ﬁne…")), F.concat(F.lit("Core tools: Spark, "), segment, F.lit("; R | dbt")), F.concat(F.regexp_replace(name, "#.*", ""), _pick(["_Doe_Resume.docx", " final2.pdf"], k)),
    ]
    return table(s, d, "customer").select(k.alias("id"), F.posexplode(F.array(*lines)).alias("pos", "line"))


_LINE_LIST = (
    "[c_name, lower(replace(c_name, '#', '.')) || '@example.org | https://example.org/' || c_custkey, " + _pick_sql(_quoted(_HEADINGS), "c_custkey") + ", 'Clerk, ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' Corp, ' || " + _pick_sql(_quoted(_MONTHS), "c_custkey")
    + " || (1990 + c_custkey % 30) || " + _pick_sql(_quoted(_JOINS), "c_custkey") + " || " + _pick_sql(["'Present'", "CAST(1995 + c_custkey % 25 AS VARCHAR)", "'19'", "'now'"], "c_custkey % 7") + ", " + _pick_sql(_quoted(_OPENERS), "c_custkey") + " || c_mktsegment || ' (' || c_mktsegment[1:3] || ')', 'Python ' || " + _pick_sql(_quoted(_STARS), "c_custkey")
    + ", " + _pick_sql(["'[Your Name] of [your name]'", "'TBD'", "c_name"], "c_custkey") + ", '“' || c_name || '”  –  ‘' || c_mktsegment || '’ ﬁne…', 'Core tools: Spark, ' || c_mktsegment || '; R | dbt', regexp_replace(c_name, '#.*', '') || " + _pick_sql(_quoted(["_Doe_Resume.docx", " final2.pdf"]), "c_custkey") + "]"
)
_LINES_SQL = f"(SELECT c_custkey AS id, unnest({_LINE_LIST}) AS line, unnest(range(0, 10))::INT AS pos FROM customer)"


def _line_step(name: str, result: Callable[[Column], Column], sql: str) -> None:
    _add(name, lambda s, d: _lines(s, d).select("id", "pos", result(F.col("line")).alias("r")), f"SELECT id, pos, {sql} AS r FROM {_LINES_SQL}")


def _rx(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_BARE = r"lower(trim(regexp_replace(line, '[:\s]+$', '')))"
_CLASS_SQL = "CASE " + " ".join(f"WHEN regexp_full_match({_BARE}, {_rx(p)}) THEN '{k}'" for k, p in T.SECTIONS) + " END"
_WORDS_SQL = r"string_split_regex(trim(line), '\s+')"
_LETTERS_SQL = r"regexp_replace(line, '[^\pL]', '', 'g')"
_HEADING_SQL = rf"(length(trim(line)) BETWEEN 1 AND 60 AND NOT regexp_matches(trim(line), '^[{T.BULLETS}*-]') AND NOT regexp_matches(trim(line), '[,|@]|:\s*\S|[0-9]{{4}}') AND NOT regexp_matches(trim(line), '(?i)\b{T.MONTH}\s+[0-9]') AND len({_WORDS_SQL}) <= 6 AND ((length({_LETTERS_SQL}) > 0 AND length(regexp_replace({_LETTERS_SQL}, '[^\p{{Lu}}]', '', 'g')) > 0.8 * length({_LETTERS_SQL})) OR len(list_filter({_WORDS_SQL}, lambda w: NOT regexp_full_match(w, '\p{{Lu}}.*|and|of|the|&|in|for'))) = 0))"
_RANGE_SQL = f"regexp_matches(line, {_rx(T.DATE_RANGE)})"
_line_step("str_is_heading", T.is_heading, _HEADING_SQL)
_line_step("str_classify_heading", T.classify_heading, _CLASS_SQL)
_line_step("str_date_range", lambda x: F.regexp_like(x, F.lit(T.DATE_RANGE)), _RANGE_SQL)
_line_step("str_bad_date", lambda x: F.regexp_like(x, F.lit(T.BAD_DATE)), r"regexp_matches(line, '(?i)''\d\d\s*(?:-|–|—|to)\s*''?\d\d|(?:19|20)\d\d\s*[-–—]\s*\d\d(?:\D|$)')")
_line_step("str_date_styles", T.date_styles, rf"CAST(regexp_matches(line, '(?i)\b{T.MONTH}\s+(?:19|20)\d\d') AS INT) + CAST(regexp_matches(line, '\b\d{{1,2}}/(?:19|20)\d\d') AS INT)")
_line_step("str_weak_opener", lambda x: F.regexp_like(F.regexp_replace(x, "^[^A-Za-z]+", ""), F.lit(T.WEAK_OPENER)), f"regexp_matches(regexp_replace(line, '^[^A-Za-z]+', ''), {_rx(T.WEAK_OPENER)})")
_CREATIVE, _RATED, _DECORATED = r"(?i)^(?:my journey|where i.ve been|what i do|my toolbox|superpowers|the story so far)", "[★☆⬤◯●○]{3,}", r"^\s*[➢➤✓✔]"
_line_step("str_creative_heading", lambda x: F.regexp_like(x, F.lit(_CREATIVE)), f"regexp_matches(line, {_rx(_CREATIVE)})")
_line_step("str_rating_graphic", lambda x: F.regexp_like(x, F.lit(_RATED)), f"regexp_matches(line, {_rx(_RATED)})")
_line_step("str_decorative", lambda x: F.regexp_like(x, F.lit(_DECORATED)), f"regexp_matches(line, {_rx(_DECORATED)})")
_line_step("str_acronym_pairs", lambda x: F.array_join(T.acronyms(x), ","), r"array_to_string(list_sort(list_distinct(regexp_extract_all(line, '\b([A-Z]{2,6})\b', 1))), ',')")
_line_step("str_placeholders", lambda x: F.array_join(T.placeholders(x), ","), f"array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(line, {_rx(T.PLACEHOLDER)}), lambda x: lower(x)[1:60]))), ',')")
_FILE = r"(?i)^[A-Za-z]+[_ -][A-Za-z_ -]*resume\.[a-z]+$"
_line_step("str_good_filename", lambda x: F.regexp_like(x, F.lit(_FILE)), f"regexp_matches(line, {_rx(_FILE)})")
_line_step("str_skill_tokens", lambda x: F.array_join(T.tool_tokens(F.array(x)), "/"), r"array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(line, '^\s*(?:\S+\s+){0,3}\S+:\s*', ''), '[,;|•]'), lambda x: trim(x)), lambda x: length(x) > 1), '/')")
_CLEANED_SQL = "line"
for _a, _b in (T.SMART | T.LIGATURES).items():
    _CLEANED_SQL = f"replace({_CLEANED_SQL}, '{_a}', {_rx(_b)})"
_line_step("str_clean", T.clean, rf"trim(regexp_replace({_CLEANED_SQL}, '[ \t]+', ' ', 'g'))")
_add("str_dates", lambda s, d: _lines(s, d).select("id", "pos", F.regexp_like("line", F.lit(T.DATE_RANGE)).alias("range"), T.date_styles(F.col("line")).alias("styles")), f"SELECT r.id, r.pos, r.r AS range, q.r AS styles FROM ({ORACLE_SQL['str_date_range']}) AS r JOIN ({ORACLE_SQL['str_date_styles']}) AS q ON q.id = r.id AND q.pos = r.pos")


def _texts(s: SparkSession, d: str) -> DataFrame:
    """The lines of a person as one text: ten lines each."""
    rows = _lines(s, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return rows.select("id", F.array_join(F.col("l.line"), "\n").alias("text"))


def _person_bullets(s: SparkSession, d: str) -> DataFrame:
    b = T.bullets(T.lines("text"))
    weak = F.filter(b, lambda x: F.regexp_like(F.regexp_replace(x, "^[^A-Za-z]+", ""), F.lit(T.WEAK_OPENER)))
    return _texts(s, d).select("id", F.size(b).cast("long").alias("bullets"), F.size(weak).cast("long").alias("weak"))


_GLYPH_SQL, _DASH_SQL = rf"regexp_matches(line, '^\s*[{T.BULLETS}]')", r"regexp_matches(line, '^\s*[-*]\s+\S')"
_add("str_bullets", _person_bullets, f"SELECT id, CASE WHEN count_if({_GLYPH_SQL}) > 0 THEN count_if({_GLYPH_SQL}) ELSE count_if({_DASH_SQL}) END AS bullets, CASE WHEN count_if({_GLYPH_SQL}) > 0 THEN count_if({_GLYPH_SQL} AND w) ELSE count_if({_DASH_SQL} AND w) END AS weak FROM (SELECT *, regexp_matches(regexp_replace(line, '^[^A-Za-z]+', ''), {_rx(T.WEAK_OPENER)}) AS w FROM {_LINES_SQL}) GROUP BY 1")
_SECTION_SQL = f"(SELECT id, pos, line, coalesce({_CLASS_SQL}, CASE WHEN pos >= 2 AND {_HEADING_SQL} THEN 'other' END) AS opens FROM {_LINES_SQL})"
_add("txt_sections", lambda s, d: D.sections(_texts(s, d), "id", "text").select("id", "pos", "section", "is_heading"), f"SELECT id, pos, coalesce(last_value(opens IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos), 'header') AS section, opens IS NOT NULL AS is_heading FROM {_SECTION_SQL}")
_add("win_neighbour", lambda s, d: D.neighbour_dates(D.sections(_texts(s, d), "id", "text")).filter("near_date").select("id", "pos", "dated"), f"SELECT id, pos, dated FROM (SELECT id, pos, dated, dated OR coalesce(lag(dated) OVER w, false) OR coalesce(lead(dated) OVER w, false) AS near FROM (SELECT id, pos, {_RANGE_SQL} AS dated FROM {_LINES_SQL}) WINDOW w AS (PARTITION BY id ORDER BY pos)) WHERE near")
_add("txt_role_entries", QUERIES["win_neighbour"], ORACLE_SQL["win_neighbour"])

# Cells: a part's price in the ways that cells are written.
_CENTS = "CAST(round(p_retailprice * 100, 0) AS BIGINT)"


def _cells(s: SparkSession, d: str) -> DataFrame:
    cents = F.round(F.col("p_retailprice") * 100, 0).cast("long")
    units, rest = F.floor(cents / 100).cast("long"), F.lpad((cents % 100).cast("string"), 2, "0")
    grouped, dotted = F.format_number(units, 0), F.replace(F.format_number(units, 0), F.lit(","), F.lit("."))
    k = F.col("p_partkey")
    forms = [F.concat(F.lit("("), grouped, F.lit("."), rest, F.lit(")")), F.concat(grouped, F.lit("-")), F.concat(dotted, F.lit(","), rest), F.concat(F.lit(" "), grouped, F.lit("."), rest, F.lit(" ")), F.concat(F.lit("-"), units.cast("string")), F.concat(F.lit("0"), k.cast("string")), F.concat(F.lit("1O"), k.cast("string")), F.lpad(units.cast("string"), 17, "1"), F.col("p_name")]
    return table(s, d, "part").select("p_partkey", _pick(forms, k).alias("cell"))


_GROUPED_SQL = f"format('{{:,}}', {_CENTS} // 100)"
_REST_SQL = f"lpad(CAST({_CENTS} % 100 AS VARCHAR), 2, '0')"
_FORM_SQL = [f"'(' || {_GROUPED_SQL} || '.' || {_REST_SQL} || ')'", f"{_GROUPED_SQL} || '-'", f"replace({_GROUPED_SQL}, ',', '.') || ',' || {_REST_SQL}", f"' ' || {_GROUPED_SQL} || '.' || {_REST_SQL} || ' '", f"'-' || ({_CENTS} // 100)", "'0' || p_partkey", "'1O' || p_partkey", f"lpad(CAST({_CENTS} // 100 AS VARCHAR), 17, '1')", "p_name"]
_CELLS_SQL = f"(SELECT p_partkey, p_partkey % 9 AS form, {_CENTS} AS cents, {_pick_sql(_FORM_SQL, 'p_partkey')} AS cell FROM part)"
_add("a_number_typing", lambda s, d: _cells(s, d).select("p_partkey", T.as_number(F.col("cell")).alias("num"), T.keep_as_text(F.col("cell")).alias("text")), f"SELECT p_partkey, CASE form WHEN 3 THEN cents / 100.0::DOUBLE WHEN 4 THEN -(cents // 100)::DOUBLE END AS num, form = 7 OR (form = 5) OR (form = 8 AND length(trim(cell)) > 15) AS text FROM {_CELLS_SQL}".replace("(form = 5)", "(form = 5 AND regexp_matches(cell, '^-?0[0-9]'))"))
_add("a_neg_numbers", lambda s, d: _cells(s, d).filter("p_partkey % 9 < 5").select("p_partkey", T.signed_number(F.col("cell")).alias("num")), f"SELECT p_partkey, CASE form WHEN 0 THEN -cents / 100.0::DOUBLE WHEN 1 THEN -(cents // 100)::DOUBLE WHEN 4 THEN -(cents // 100)::DOUBLE ELSE cents / 100.0::DOUBLE END AS num FROM {_CELLS_SQL} WHERE form < 5")
_add("flt_confusable_digits", lambda s, d: _cells(s, d).filter(F.regexp_like("cell", F.lit("[0-9]")) & F.regexp_like("cell", F.lit("[OoIlSB]"))).select("p_partkey"), f"SELECT p_partkey FROM {_CELLS_SQL} WHERE regexp_matches(cell, '[0-9]') AND regexp_matches(cell, '[OoIlSB]')")
_add("str_pdf_len", lambda s, d: table(s, d, "part").select("p_partkey", T.pdf_string_length(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("<"), F.hex(F.encode("p_name", "utf-8")), F.lit(">"))).otherwise(F.concat(F.lit("("), "p_name", F.lit("\\)\\101)"))), F.col("p_partkey") % 4 == 0).alias("n")), "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN strlen(p_name) // 2 WHEN p_partkey % 2 = 0 THEN strlen(p_name) ELSE length(p_name) + 2 END::BIGINT AS n FROM part")
_add("str_fmt", lambda s, d: table(s, d, "part").select("p_partkey", T.money(F.round("p_retailprice", 0) * F.pow(F.lit(10.0), (F.col("p_partkey") % 8).cast("double"))).alias("r")), "SELECT p_partkey, CASE WHEN v >= 1e9 THEN '$' || format('{:.1f}', v / 1e9) || 'B' WHEN v >= 1e6 THEN '$' || format('{:.1f}', v / 1e6) || 'M' ELSE '$' || format('{:,}', CAST(v AS BIGINT)) END AS r FROM (SELECT p_partkey, round(p_retailprice, 0) * pow(10.0::DOUBLE, p_partkey % 8) AS v FROM part)")

# Records that a page may embed: an object, a graph and a list.


def _records(s: SparkSession, d: str) -> DataFrame:
    name, brand, k = F.concat(F.lit('"'), F.col("p_name"), F.lit('"')), F.col("p_brand"), F.col("p_partkey")
    one = F.concat(F.lit('{"@type": "Product", "brand": {"name": "'), brand, F.lit('"}, "offers": {"availability": "https://schema.org/'), F.col("p_type"), F.lit('"}}'))
    graph = F.concat(F.lit('{"@graph": [{"@type": ["Article", "NewsArticle"], "headline": '), name, F.lit(', "author": {"name": "'), brand, F.lit('"}}, {"@type": "Person"}]}'))
    many = F.concat(F.lit('[{"@type": "Product", "brand": "'), brand, F.lit('"},]'))
    return table(s, d, "part").select(k.alias("id"), _pick([one, graph, many], k).alias("j"))


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return IQ.nodes_of(_records(s, d))


_NODES_SQL = "(SELECT p_partkey AS id, k, pos, CASE WHEN k = 1 THEN CASE pos WHEN 0 THEN 'Article,NewsArticle' ELSE 'Person' END ELSE 'Product' END AS types, p_name, p_brand, p_type FROM (SELECT *, p_partkey % 3 AS k FROM part), (VALUES (0), (1)) AS v(pos) WHERE pos = 0 OR k = 1)"
_add("j_array_or_one", lambda s, d: _nodes(s, d).groupBy("id").agg(F.count(F.lit(1)).alias("n")), f"SELECT id, count(*) AS n FROM {_NODES_SQL} GROUP BY 1")
_add("j_graph_flatten", lambda s, d: _nodes(s, d).select("id", "pos", F.array_join(IQ._types(), ",").alias("types")), f"SELECT id, pos, types FROM {_NODES_SQL}")
_add("j_of_type", lambda s, d: _nodes(s, d).filter(F.array_contains(IQ._types(), "Product")).select("id"), f"SELECT id FROM {_NODES_SQL} WHERE types = 'Product'")
_add("agg_types_present", lambda s, d: _nodes(s, d).select("id", F.explode(IQ._types()).alias("t")).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("types")), f"SELECT id, string_agg(types, ',' ORDER BY pos) AS types FROM {_NODES_SQL} GROUP BY 1")
_add("j_article", lambda s, d: _nodes(s, d).filter(F.array_contains(IQ._types(), "Article")).select("id", F.try_variant_get("v", "$.headline", "string").alias("headline"), F.try_variant_get("v", "$.author.name", "string").alias("author")), f"SELECT id, p_name AS headline, p_brand AS author FROM {_NODES_SQL} WHERE k = 1 AND pos = 0")
_add("j_as_name", lambda s, d: _nodes(s, d).select("id", "pos", F.coalesce(F.try_variant_get("v", "$.brand.name", "string"), F.try_variant_get("v", "$.brand", "string")).alias("brand")), f"SELECT id, pos, CASE WHEN k <> 1 THEN p_brand END AS brand FROM {_NODES_SQL}")
_add("j_last_segment", lambda s, d: _nodes(s, d).select("id", "pos", F.element_at(F.split(F.try_variant_get("v", "$.offers.availability", "string"), "/"), -1).alias("r")), f"SELECT id, pos, CASE WHEN k = 0 THEN p_type END AS r FROM {_NODES_SQL}")
_add("j_dig", lambda s, d: _nodes(s, d).select("id", "pos", F.when(F.try_variant_get("v", "$.headline", "string").isNull(), "missing: headline").alias("error")), f"SELECT id, pos, CASE WHEN k <> 1 OR pos = 1 THEN 'missing: headline' END AS error FROM {_NODES_SQL}")
_ANCHORS = ("json-ld", "microdata", "id", "class", "text", "position")
_add("doc_anchor_priority", lambda s, d: table(s, d, "part").select("p_partkey", F.array_min(F.transform(F.array(_pick(list(_ANCHORS), F.col("p_partkey")), _pick(list(_ANCHORS), F.col("p_size"))), lambda x: F.array_position(F.array(*(F.lit(k) for k in _ANCHORS)), x))).alias("rank")), "SELECT p_partkey, least(p_partkey % 6, p_size % 6) + 1 AS rank FROM part")

# Series: yearly figures of nations, and of an order's lines.
_add("agg_sum_nonnull", lambda s, d: SQ._by_nation(s, d).groupBy("id").agg(F.round(F.coalesce(F.sum("capex"), F.lit(0.0)), 2).alias("r")), f"SELECT id, round(coalesce(sum(capex), 0), 2) AS r FROM {SQ._NATION_SQL} GROUP BY 1")
_add("agg_conversion", lambda s, d: SQ._by_nation(s, d).groupBy("id").agg(F.round(B.safe_ratio(F.sum("cfo"), F.sum("net_income")), 9).alias("r")), f"SELECT id, round(sum(cfo) / nullif(sum(net_income), 0), 9) AS r FROM {SQ._NATION_SQL} GROUP BY 1")
_add("srt_years", lambda s, d: SQ._by_nation(s, d).select("id", "year", F.row_number().over(Window.partitionBy("id").orderBy("year")).alias("k")), f"SELECT id, year, row_number() OVER (PARTITION BY id ORDER BY year) AS k FROM {SQ._NATION_SQL}")
_add("m_interpret", lambda s, d: table(s, d, "part").select("p_partkey", N.read_growth((F.col("p_size") - 10) / 100.0).alias("r")), "SELECT p_partkey, CASE WHEN g < 0 THEN 'shrinking' WHEN g < 0.05 THEN 'modest' WHEN g < 0.1 THEN 'moderate' WHEN g < 0.15 THEN 'demanding' WHEN g < 0.25 THEN 'very demanding' ELSE 'extreme' END AS r FROM (SELECT p_partkey, (p_size - 10) / 100.0::DOUBLE AS g FROM part)")


def _bands(s: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    text = _pick([F.concat(size, F.lit("-"), (F.col("p_size") + 5).cast("string")), size, F.lit("x")], F.col("p_partkey"))
    return table(s, d, "part").select("p_partkey", N.band_ends(text)[1].alias("r"))


_add("m_parse_band", _bands, "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size + 5 WHEN 1 THEN p_size END::DOUBLE AS r FROM part")


def _issues(s: SparkSession, d: str) -> DataFrame:
    """An order's parts by line as the categories of an issue."""
    rows = table(s, d, "lineitem").groupBy("l_orderkey").agg(*(F.max(F.when(F.col("l_returnflag") == f, F.col("l_quantity") / 10)).alias(c) for c, f in (("QIB", "A"), ("NII", "N"), ("Retail", "R"))))
    return rows.select("l_orderkey", F.when(F.col("QIB").isNull(), "no institutional figure").when((F.col("QIB") < 1) & (F.col("Retail") >= 1), "retail only").otherwise("institutional").alias("reading"))


_add("agg_subscription", _issues, "SELECT l_orderkey, CASE WHEN q IS NULL THEN 'no institutional figure' WHEN q < 1 AND r >= 1 THEN 'retail only' ELSE 'institutional' END AS reading FROM (SELECT l_orderkey, max(l_quantity / 10) FILTER (l_returnflag = 'A') AS q, max(l_quantity / 10) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)")
_BY_LINE = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


def _line_order() -> Window:
    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def _trend(s: SparkSession, d: str) -> DataFrame:
    step = F.col("l_quantity") - F.lag("l_quantity").over(_line_order())
    return table(s, d, "lineitem").select("l_orderkey", F.row_number().over(_line_order()).alias("day"), F.signum(step).cast("int").alias("direction"))


_add("win_gmp_trend", _trend, f"SELECT l_orderkey, row_number() OVER w AS day, CAST(sign(l_quantity - lag(l_quantity) OVER w) AS INT) AS direction FROM lineitem WINDOW w AS ({_BY_LINE})")


def _stitched(s: SparkSession, d: str) -> DataFrame:
    """An order's line numbers as pages, with as many columns as a line's quantity leaves of three."""
    rows = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("page")).agg((F.max("l_quantity") % 3).alias("cols"))
    order = Window.partitionBy("id").orderBy("page")
    new = F.coalesce((F.lag("page").over(order) != F.col("page") - 1) | (F.lag("cols").over(order) != F.col("cols")), F.lit(True))
    rows = rows.withColumn("new", new).withColumn("grp", F.sum(F.col("new").cast("int")).over(order))
    return rows.groupBy("id", "grp").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("pages")).select("id", "first", "pages")


_add("join_page_stitch", _stitched, "SELECT id, min(page) AS first, count(*) AS pages FROM (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY page) AS grp FROM (SELECT *, coalesce(lag(page) OVER w <> page - 1 OR lag(cols) OVER w <> cols, true) AS new FROM (SELECT l_orderkey AS id, l_linenumber AS page, max(l_quantity) % 3 AS cols FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY id ORDER BY page))) GROUP BY id, grp")


def _without_repeats(s: SparkSession, d: str) -> DataFrame:
    """An order's lines as rows of a table whose first row is the header: its repeats go."""
    rows = table(s, d, "lineitem").withColumn("r", F.row_number().over(_line_order())).withColumn("h", F.first("l_returnflag").over(_line_order()))
    return rows.filter((F.col("r") == 1) | (F.col("l_returnflag") != F.col("h"))).select("l_orderkey", "r")


_add("set_repeat_header_drop", _without_repeats, f"SELECT l_orderkey, r FROM (SELECT l_orderkey, l_returnflag, row_number() OVER w AS r, first_value(l_returnflag) OVER w AS h FROM lineitem WINDOW w AS ({_BY_LINE})) WHERE r = 1 OR l_returnflag <> h")


def _merged(s: SparkSession, d: str) -> DataFrame:
    """Lines that begin with a space go on with the record above."""
    own = F.when(F.col("r") % 3 == 1, F.concat(F.col("l_returnflag"), F.lit(" "), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("  "), F.col("l_partkey").cast("string")))
    rows = table(s, d, "lineitem").withColumn("r", F.row_number().over(_line_order())).select(F.col("l_orderkey").alias("id"), F.col("r").alias("pos"), own.alias("l"))
    order = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("rec", F.sum((~F.startswith("l", F.lit(" "))).cast("int")).over(order))
    return rows.groupBy("id", "rec").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim("l").alias("t")))), lambda x: x["t"]), " ").alias("text")).select("id", "rec", "text")


_add("win_record_merge", _merged, f"SELECT id, rec, string_agg(t, ' ' ORDER BY r) AS text FROM (SELECT id, r, (r + 2) // 3 AS rec, CASE WHEN r % 3 = 1 THEN l_returnflag || ' ' || l_partkey ELSE CAST(l_partkey AS VARCHAR) END AS t FROM (SELECT l_orderkey AS id, l_returnflag, l_partkey, row_number() OVER ({_BY_LINE}) AS r FROM lineitem)) GROUP BY 1, 2")
_add("flt_unlock_future", lambda s, d: table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("t"), (F.col("o_orderkey") % 5).alias("n")).filter((F.date_diff(F.try_to_date("t"), F.lit("1996-06-01").cast("date")) >= 0) & (F.col("n") > 0)).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0 AND CAST(o_orderdate AS DATE) >= DATE '1996-06-01' AND o_orderkey % 5 > 0")

# Files, forms and fields.
_add("doc_route", lambda s, d: (lambda t: table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 0, " ").alias("pdftotext"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).otherwise("").alias("plumber"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_type")).alias("pypdf")).select("p_partkey", t[0].alias("text"), t[1].alias("method")))(D.first_text("pdftotext", "plumber", "pypdf")), "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name WHEN p_partkey % 5 <> 0 THEN p_brand WHEN p_partkey % 7 <> 0 THEN p_type END AS text, CASE WHEN p_partkey % 2 = 0 THEN 'pdftotext' WHEN p_partkey % 5 <> 0 THEN 'plumber' WHEN p_partkey % 7 <> 0 THEN 'pypdf' END AS method FROM part")


def _forms(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    body = F.concat(F.lit("/T (name) /V ("), "c_name", F.lit(" \\(x\\)) /T (lost) /T (segment) /V ("), "c_mktsegment", F.lit(")"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" /T (name) /V (again "), F.col("c_custkey").cast("string"), F.lit(")"))).otherwise(""))
    return D.form_fields(c.select(F.col("c_custkey").alias("id"), body.alias("body")))


_FORMS_SQL = "SELECT c_custkey AS id, 'segment' AS name, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 'name', CASE WHEN c_custkey % 2 = 0 THEN 'again ' || c_custkey ELSE c_name || ' (x)' END FROM customer"
_add("src_pdf_form", _forms, _FORMS_SQL)
_add("win_pair_tokens", _forms, _FORMS_SQL)


def _matrix(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    fields = F.map_filter(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.when(k % 2 == 0, F.col("p_type")), F.lit("size"), F.when(k % 3 == 0, F.col("p_size").cast("string"))), lambda _, v: v.isNotNull())
    return D.fields_matrix(table(s, d, "part").select(k.alias("id"), fields.alias("fields")))


_add("a_fields_matrix", _matrix, "SELECT p_partkey AS id, key, CASE key WHEN 'brand' THEN p_brand WHEN 'type' THEN CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END ELSE CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END END AS value FROM part, (VALUES ('brand'), ('type'), ('size')) AS v(key)")
_add("set_ops", lambda s, d: ST._word_sets(s, d).withColumn("b", F.concat("b", F.array(F.lit("ring"), F.lit("small")))).select("p_partkey", F.array_join(F.array_distinct(F.concat("a", "a")), " ").alias("dedup"), F.array_join(F.array_intersect("a", "b"), " ").alias("common"), F.array_join(F.array_except("a", "b"), " ").alias("diff"), (F.size(F.array_except("a", "b")) == 0).alias("subset")), "SELECT p_partkey, array_to_string(a, ' ') AS dedup, array_to_string(list_filter(a, lambda x: list_contains(b, x)), ' ') AS common, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ' ') AS diff, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS subset FROM (SELECT p_partkey, list_sort_by_place(a) AS a, list_concat(b, ['ring', 'small']) AS b FROM (SELECT p_partkey, string_split(lower(p_name), ' ') AS a, string_split(lower(p_type), ' ') AS b FROM part))".replace("list_sort_by_place(a)", "list_filter(a, lambda x, i: list_position(a, x) = i)"))
_add("flt_required", lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_name")).alias("name"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("mail")).select("id", F.explode(F.array_compact(F.array(F.when(F.coalesce("name", F.lit("")) == "", "name"), F.when(F.coalesce("mail", F.lit("")) == "", "mail")))).alias("missing")), "SELECT c_custkey AS id, 'name' AS missing FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey, 'mail' FROM customer WHERE coalesce(CASE WHEN c_acctbal >= 0 THEN c_mktsegment END, '') = ''")
_add("agg_max_gap", lambda s, d: table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, "none").otherwise(F.concat(F.lit("/Count "), F.col("p_size").cast("string"), F.lit(" /Count "), (F.col("p_partkey") % 30).cast("string"))).alias("t")).select("p_partkey", F.coalesce(F.array_max(F.transform(F.regexp_extract_all("t", F.lit(r"/Count (\d+)"), F.lit(1)), lambda x: x.cast("int"))), F.lit(0)).alias("pages")), "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE greatest(p_size, p_partkey % 30) END::INT AS pages FROM part")
_SHEETS = ["Table/1", "table:1", "TABLE*1", "a name that is much longer than thirty-one"]
_add("str_safe_sheet", lambda s, d: D.unique_sheet_names(table(s, d, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("pos"), _pick(_SHEETS, F.col("o_orderkey")).alias("name"))).select("book", "place", "sheet"), "SELECT book, place::INT AS place, CASE WHEN k = 1 THEN n ELSE n[1:31 - length(k::VARCHAR) - 1] || '_' || k END AS sheet FROM (SELECT book, row_number() OVER (PARTITION BY book ORDER BY pos) - 1 AS place, n, row_number() OVER (PARTITION BY book, lower(n) ORDER BY pos) AS k FROM (SELECT o_custkey AS book, o_orderkey AS pos, (" + _pick_sql(_quoted(["Table_1", "table_1", "TABLE_1", "a name that is much longer than thirty-one"]), "o_orderkey") + ")[1:31] AS n FROM orders))")
_add("doc_blockers", lambda s, d: D.triage(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.lit(True).alias("valid"), (F.col("p_partkey") % 4 == 0).alias("encrypted"), F.lit(False).alias("xfa"), F.lit(0).alias("form_fields"), F.lit(2).alias("pages"), (F.col("p_size") % 3).alias("images"), (F.col("p_retailprice") % 1000).alias("est_chars"))).select("id", F.array_join(F.array_compact(F.array(F.when(F.col("type").isin("SCANNED", "MIXED", "NO_TEXT_LAYER"), "ocr"), F.when(F.col("type") == "ENCRYPTED", "decryption"))), ",").alias("needs")), "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'decryption' WHEN per < 50 OR (per < 350 AND share >= 0.5) THEN 'ocr' ELSE '' END AS needs FROM (SELECT p_partkey, p_retailprice % 1000 / 2 AS per, (p_size % 3) / 2.0 AS share FROM part)")

# People and scores.
_add("m_tdee", lambda s, d: P.plan_targets(ST._people(s, d)).select("id", F.round("tdee", 3).alias("tdee")), f"SELECT id, round({ST._TDEE_SQL}, 3) AS tdee FROM {ST._PEOPLE_SQL}")
_add("m_bmr", lambda s, d: ST._people(s, d).select("id", P.bmr(F.col("sex"), F.col("weight_kg"), F.col("height_cm"), F.col("age")).alias("bmr"), P.bmr_lean(F.col("weight_kg") * 0.75).alias("lean_bmr")), f"SELECT id, 10.0::DOUBLE * w + 6.25::DOUBLE * h - 5.0::DOUBLE * age + CASE WHEN sex = 'male' THEN 5.0::DOUBLE ELSE -161.0::DOUBLE END AS bmr, 370.0::DOUBLE + 21.6::DOUBLE * (w * 0.75::DOUBLE) AS lean_bmr FROM {ST._PEOPLE_SQL}")
_KEYS = list(G.WEIGHTS)
_SCORE_EXPR = {k: f"(2.0 + (c_custkey * {p} + c_nationkey) % 15 / 2.0)" for k, p in zip(_KEYS, (1, 3, 5, 7, 11, 13))}


def _scores(s: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    each = [(2.0 + (c * p + F.col("c_nationkey")) % 15 / 2.0).cast("double").alias(k) for k, p in zip(_KEYS, (1, 3, 5, 7, 11, 13))]
    return table(s, d, "customer").select(c.alias("id"), *each, (c % 4 != 0).alias("verifiable"), F.when(c % 9 != 0, c % 10 == 0).alias("terminal"))


_SCORES_SQL = "(SELECT c_custkey AS id, " + ", ".join(f"{e} AS {k}" for k, e in _SCORE_EXPR.items()) + ", c_custkey % 4 <> 0 AS verifiable, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 10 = 0 END AS terminal FROM customer)"
_TOTAL = "(0.25 * value_capture + 0.20 * supply + 0.20 * network + 0.15 * security + 0.10 * liquidity + 0.10 * team)"
_LEAST = "least(value_capture, supply, network, security, liquidity, team)"
_CAPPED = f"CASE WHEN coalesce(terminal, false) THEN NULL ELSE least({_TOTAL}, CASE WHEN {_LEAST} <= 2 THEN 4.0 ELSE 99 END, CASE WHEN value_capture <= 3 THEN 5.0 ELSE 99 END, CASE WHEN NOT verifiable THEN 6.0 ELSE 99 END) END"
_add("gate_score_caps", lambda s, d: (lambda x: _scores(s, d).select("id", F.round(x, 6).alias("score"), G.verdict(F.round(x, 6)).alias("verdict")))(G.capped_score(F.col("verifiable"), F.col("terminal"))), f"SELECT id, s AS score, CASE WHEN s IS NULL THEN 'no rating' WHEN s >= 8.0 THEN 'strong' WHEN s >= 6.5 THEN 'good' WHEN s >= 5.0 THEN 'mixed' WHEN s >= 3.5 THEN 'weak' ELSE 'avoid' END AS verdict FROM (SELECT id, round(CAST({_CAPPED} AS DOUBLE), 6) AS s FROM {_SCORES_SQL})")
_add("agg_weighted_score", lambda s, d: _scores(s, d).select("id", F.round(G.weighted_score(), 6).alias("score")), f"SELECT id, round(CAST({_TOTAL} AS DOUBLE), 6) AS score FROM {_SCORES_SQL}")
_add("gate_veto", lambda s, d: (lambda x: _scores(s, d).select("id", F.round(x, 6).alias("score"), G.verdict(F.round(x, 6), G.STOCK_VERDICTS).alias("verdict")))(G.vetoed(G.weighted_score(), F.least(*(F.col(k) for k in _KEYS)))), f"SELECT id, s AS score, CASE WHEN s >= 8.0 THEN 'strong' WHEN s >= 6.5 THEN 'good' WHEN s >= 5.0 THEN 'mixed' ELSE 'avoid' END AS verdict FROM (SELECT id, round(CAST(CASE WHEN {_LEAST} <= 2 THEN least({_TOTAL}, 4.0) ELSE {_TOTAL} END AS DOUBLE), 6) AS s FROM {_SCORES_SQL})")


def _day_first(s: SparkSession, d: str) -> DataFrame:
    """A customer's dates of orders, written day first by some and month first by others."""
    o = table(s, d, "orders")
    text = F.when(F.col("o_custkey") % 3 == 0, "soon").when(F.col("o_custkey") % 3 == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    return o.select("o_custkey", text.alias("t")).groupBy("o_custkey").agg(C.day_first(F.col("t")).alias("day_first"))


_add("dt_infer_dmy", _day_first, "SELECT o_custkey, CASE WHEN o_custkey % 3 = 1 AND max(day(o_orderdate)) > 12 THEN true WHEN o_custkey % 3 = 2 AND max(day(o_orderdate)) > 12 THEN false END AS day_first FROM orders GROUP BY 1")


# Key terms of the benchmark's items; the list is folded in order, as the operator does.
_ITEM_TERMS_SQL = f"""SELECT item_id, term, words, count(*) AS n, bool_or(proper) AS proper, min(struct_pack(g := g, i := i)) AS first FROM (SELECT item_id, g, i, lower(x) AS term, 1 AS words, proper FROM {TQ._WORDS} WHERE ok
 UNION ALL SELECT a.item_id, a.g, a.i, lower(a.x || ' ' || b.x), 2, a.proper OR b.proper FROM {TQ._WORDS} AS a JOIN {TQ._WORDS} AS b ON a.item_id = b.item_id AND a.g = b.g AND b.i = a.i + 1 WHERE a.ok AND b.ok) GROUP BY 1, 2, 3"""
_KEY_SQL = f"""WITH RECURSIVE ranked AS MATERIALIZED (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY -(n + CASE WHEN proper THEN 2 ELSE 0 END), words, length(term), first, term) AS r FROM ({_ITEM_TERMS_SQL})),
 fold(item_id, r, term, place, covered) AS (SELECT DISTINCT item_id, 0::BIGINT, NULL::VARCHAR, 0, []::VARCHAR[] FROM ranked UNION ALL
 SELECT item_id, n.r, CASE WHEN keep THEN n.term END, place + CASE WHEN keep THEN 1 ELSE 0 END, CASE WHEN keep THEN list_concat(covered, string_split(n.term, ' ')) ELSE covered END FROM (SELECT f.item_id, n.r, n.term, f.place, f.covered, NOT (contains(n.term, ' ') AND len(list_filter(string_split(n.term, ' '), lambda w: NOT list_contains(f.covered, w))) = 0) AS keep FROM fold AS f JOIN ranked AS n ON n.item_id = f.item_id AND n.r = f.r + 1 WHERE f.place < 8) AS n)
 SELECT item_id, place::INT AS place, term FROM fold WHERE term IS NOT NULL"""
_add("txt_keywords", lambda s, d: D.key_terms(D.term_counts(table(s, d, "benchmark"), "item_id", "text"), 8).select(F.col("id").alias("item_id"), "place", "term"), _KEY_SQL)
_add("win_greedy_cover", QUERIES["txt_keywords"], ORACLE_SQL["txt_keywords"])
