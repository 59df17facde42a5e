"""Documents and conversations: lines, sections, terms, audits, layout tables, cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import basic as B
from ..functions import text as T
from ..operators import audit as A
from ..operators import documents as D
from .common import fixture, table


def str_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.norm("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(n).alias("md5"), F.length(n).cast("long").alias("n"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines("text")).alias("pos", "line"))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.trim("line") == "").alias("blank"))


def agg_term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.term_counts(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return c.select(F.col("id").alias("item_id"), "term", "words", "n", "proper")


_RESUME = r"""concat_ws(chr(10), 'Jo Doe', 'jo.doe@example.org | +1 (555) 010-2030 | Berlin, Germany | https://example.org/jo', 'Summary', 'Engineer with ten years of work on data platforms (ETL).', 'Experience', 'Data Engineer, Acme Corp, Mar 2019 - Present', '• Built pipelines that cut cost by half and kept their owners happy every day', '• Led a team of five', 'Analyst at Beta Ltd, 2015 - 2019', '• Wrote reports for the board and for three other groups of readers', 'Education', 'BSc Physics, 2015', 'Skills', 'Languages: Python, SQL, Scala, Java', 'Spark; Kafka; Airflow; dbt; Terraform; Linux; Git')"""
_RESUMES = f"(1, 'Jo_Doe_Resume.docx', {_RESUME}, 0, 1), (2, 'scan.pdf', 'Jo', 2, 1), (3, 'x.txt', concat_ws(chr(10), 'My Journey', 'Responsible for things', 'Married, date of birth 1.1.1990', '[Your name here]', 'Manager, 2015-19'), 0, 2)"


def _resumes(spark: SparkSession) -> DataFrame:
    return fixture(spark, "id, file, text, images, columns", _RESUMES)


def txt_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.audit(_resumes(spark)).filter("id = 1").select("check", F.round("earned", 4).alias("earned"), "possible")


def agg_score_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = A.verdicts(_resumes(spark))
    return v.select("id", F.round("score", 3).alias("score"), F.array_join("blockers", ",").alias("blockers"), "pass")


def chk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.audit(_resumes(spark)).groupBy("grp").agg(F.sum("possible").alias("possible"), F.count(F.lit(1)).alias("rows"))


def flt_regex_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_like(t, F.lit(T.EMAIL)).alias("email"), F.regexp_count(t, F.lit(T.EMAIL)).cast("long").alias("emails"), F.regexp_like(t, F.lit(T.PLACEHOLDER)).alias("placeholder"))


def flt_digits_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.phones(F.coalesce("text", F.lit("")))).cast("long").alias("phones"))


def flt_word_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", B.contains_term("text", "license").alias("has"), B.contains_any("text", ["license", "rights reserved"]).alias("any"))


def join_wheres_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    m = A.match_terms(d, ["the", "der", "license", "absent-term"])
    return m.select("id", F.array_join("matched", ",").alias("matched"), F.array_join("missing", ",").alias("missing"), "rate")


def str_tool_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixture(spark, "id, l", "(1, array('Core tools: Spark, SQL; R', 'Git | dbt')), (2, array('a, bb'))")
    return f.select("id", F.array_join(T.tool_tokens(F.col("l")), "/").alias("tokens"))


def str_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.column_letters(F.col("p_partkey")).alias("col"), T.sheet_name(F.col("p_type")).alias("sheet"), T.escape_xml(F.concat(F.lit('<a & "'), F.col("p_name"))).alias("xml"), T.file_stem(F.col("p_name")).alias("stem"), T.is_kebab(F.lower("p_brand")).alias("kebab"), T.resume_name(F.col("p_name")).alias("file"))


def str_encoding_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(T.mojibake(F.col("text"))).alias("mojibake"), F.count_if(F.regexp_like("text", F.lit("​"))).alias("zero_width"))


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-width lists of a supplier's nation: one table a nation, under a line of prose."""
    s = table(spark, sf_dir, "supplier")
    line = F.concat(F.rpad("s_name", 22, " "), F.lit("   "), F.rpad(F.col("s_suppkey").cast("string"), 8, " "), F.lit("   "), F.lpad(F.round("s_acctbal", 0).cast("long").cast("string"), 8, " "))
    g = s.groupBy(F.col("s_nationkey").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("t"))
    return g.select("id", F.concat(F.lit("a line of prose that stands alone\n\n"), "t", F.lit("\n\nend")).alias("text"))


def doc_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.layout_tables(D.pages_of(_layout(spark, sf_dir), "id", "text"))
    return t.select("id", F.col("page").cast("int").alias("page"), "n_rows", "n_cols", "confidence", "sparse", F.element_at(F.element_at("cells", 1), 1).alias("first_cell"))


def doc_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 11 != 0).alias("valid"), (F.col("p_partkey") % 13 == 0).alias("encrypted"), (F.col("p_partkey") % 17 == 0).alias("xfa"), (F.col("p_partkey") % 3).alias("form_fields"), (F.col("p_size") % 7 + 1).alias("pages"), (F.col("p_size") % 5).alias("images"), (F.col("p_retailprice") * 2).alias("est_chars"))
    return D.triage(f).groupBy("type", "route").agg(F.count(F.lit(1)).alias("n"))


def doc_batch_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 9 == 0, "bad").alias("error"))
    return D.batch_account(r)


def src_page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), "\f").alias("t"))
    p = D.pages_of(d, "conv_id", "t").filter("page BETWEEN 1 AND 2")
    return p.select(F.col("id").alias("conv_id"), F.col("page").cast("int").alias("page"), F.length("text").cast("long").alias("n"))


def agg_count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "event_type")))


def agg_latency_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95)))
    return e.groupBy("event_type").agg(F.avg(F.when(F.col("event_type") != "error", 1.0).otherwise(0.0)).alias("ok"), F.round(p[0], 6).alias("median"), F.round(p[1], 6).alias("p95"))


def agg_dup_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def agg_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's stated total against its lines."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("lines"), F.count(F.lit(1)).alias("n"))
    o = table(spark, sf_dir, "orders")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left").select("o_orderkey", "n", (F.abs(F.col("o_totalprice") - F.col("lines")) < 0.01).alias("agrees"))


_W = r"(SELECT item_id, s, g, regexp_extract_all(s, '([A-Za-z][A-Za-z0-9+#.\-]*)', 1) AS w FROM (SELECT item_id, unnest(string_split_regex(text, '[.;:,\n()\[\]/|•]+')) AS s, generate_subscripts(string_split_regex(text, '[.;:,\n()\[\]/|•]+'), 1) AS g FROM benchmark))"
_STOPS = ", ".join(f"'{x}'" for x in D.STOPWORDS + D.BOILERPLATE)
_WORDS = f"(SELECT item_id, g, i, x, lower(x) NOT IN ({_STOPS}) AND length(x) >= 2 AS ok, i > 1 AND regexp_matches(x, '^[A-Z]|^.+[A-Z]') AS proper FROM (SELECT item_id, g, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM {_W}))"
QUERIES = {f.__name__: f for f in (str_norm, doc_lines, agg_term_freq, txt_audit, agg_score_pct, chk_report, flt_regex_presence, flt_digits_min, flt_word_boundary, join_wheres_term, str_names, str_encoding_checks, doc_tables, doc_triage, doc_batch_account, src_page_range, agg_count_by_type, agg_latency_trial, agg_dup_names, agg_reconcile)}
_UNI = r"[ \t\n\x0B\f\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_HAS = r"regexp_matches(text, '(^|[^\pL\pN\pM_])license([^\pL\pN\pM_]|$)')"
_TERMS = [("the", "the"), ("der", "der"), ("license", "license"), ("absent-term", "absent-term")]
_HIT = {t: rf"regexp_matches(text, '(^|[^\pL\pN\pM_]){t}([^\pL\pN\pM_]|$)')" for t, _ in _TERMS}
QUERIES["str_skill_tokens"] = str_tool_tokens  # the inventory's name of the step
ORACLE_SQL = {
    "str_norm": f"SELECT conv_id, turn, md5(n) AS md5, length(n) AS n FROM (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '{_UNI}', ' ', 'g')) AS n FROM conversations)",
    "doc_lines": r"SELECT doc_id, count(*) AS lines, count_if(trim(line) = '') AS blank FROM (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]')) AS line FROM documents) GROUP BY 1",
    "agg_term_freq": f"""SELECT item_id, term, words, count(*) AS n, bool_or(proper) AS proper FROM (SELECT item_id, lower(x) AS term, 1 AS words, proper FROM {_WORDS} WHERE ok UNION ALL
      SELECT a.item_id, lower(a.x || ' ' || b.x), 2, a.proper OR b.proper FROM {_WORDS} AS a JOIN {_WORDS} AS b ON a.item_id = b.item_id AND a.g = b.g AND b.i = a.i + 1 WHERE a.ok AND b.ok) GROUP BY 1, 2, 3""",
    "chk_report": "SELECT * FROM (VALUES ('contact', 48.0::DOUBLE, 12), ('sections', 54.0, 12), ('entries', 60.0, 6), ('dates', 30.0, 6), ('bullets', 36.0, 9), ('tools', 30.0, 9), ('file', 42.0, 15)) AS t(grp, possible, rows)",
    "flt_regex_presence": rf"SELECT doc_id, regexp_matches(text, '{T.EMAIL}') AS email, len(regexp_extract_all(text, '{T.EMAIL}')) AS emails, regexp_matches(text, '{T.PLACEHOLDER.replace(chr(39), chr(39) * 2)}') AS placeholder FROM documents",
    "flt_digits_min": rf"SELECT doc_id, len(list_filter(regexp_extract_all(text, '{T.PHONE}'), lambda x: length(regexp_replace(x, '\D', '', 'g')) >= 8)) AS phones FROM documents",
    "flt_word_boundary": f"SELECT doc_id, {_HAS} AS has, contains(lower(text), 'license') OR contains(lower(text), 'rights reserved') AS any FROM documents",
    "join_wheres_term": "SELECT doc_id AS id, concat_ws(',', " + ", ".join(f"CASE WHEN {h} THEN '{t}' END" for t, h in _HIT.items()) + ") AS matched, concat_ws(',', " + ", ".join(f"CASE WHEN NOT {h} THEN '{t}' END" for t, h in _HIT.items()) + ") AS missing, (" + " + ".join(f"CAST({h} AS INT)" for h in _HIT.values()) + ") / 4.0::DOUBLE * 100.0 AS rate FROM documents",
    "str_names": r"""SELECT p_partkey, CASE WHEN p_partkey < 26 THEN chr(65 + CAST(p_partkey AS INT)) WHEN p_partkey < 702 THEN chr(65 + CAST((p_partkey - 26) // 26 AS INT)) || chr(65 + CAST((p_partkey - 26) % 26 AS INT)) ELSE chr(65 + CAST((p_partkey - 702) // 676 AS INT)) || chr(65 + CAST((p_partkey - 702) // 26 % 26 AS INT)) || chr(65 + CAST((p_partkey - 702) % 26 AS INT)) END AS col, substr(regexp_replace(p_type, '[\[\]:*?/\\]', '_', 'g'), 1, 31) AS sheet,
      '&lt;a &amp; &quot;' || replace(replace(p_name, '&', '&amp;'), '<', '&lt;') AS xml, substr(regexp_replace(p_name, '[^A-Za-z0-9_.-]+', '_', 'g'), 1, 60) AS stem, regexp_matches(lower(p_brand), '^[a-z0-9]+(-[a-z0-9]+)*$') AS kebab, array_to_string(list_slice(regexp_extract_all(p_name, '[A-Za-z]+'), 1, 3), '_') || '_Resume.docx' AS file FROM part""",
    "str_encoding_checks": "SELECT lang, count_if(regexp_matches(text, 'Ã[\u0080-¿]|â€|Â[\u0080-¿]|�')) AS mojibake, count_if(contains(text, '​')) AS zero_width FROM documents GROUP BY 1",
    "doc_tables": "SELECT s_nationkey AS id, 0::INT AS page, count(*) AS n_rows, 3::INT AS n_cols, 'high' AS confidence, false AS sparse, arg_min(s_name, s_suppkey) AS first_cell FROM supplier GROUP BY 1 HAVING count(*) >= 3",
    "doc_triage": """SELECT type, CASE type WHEN 'SCANNED' THEN 'ocr' WHEN 'NO_TEXT_LAYER' THEN 'ocr' WHEN 'MIXED' THEN 'text and ocr' WHEN 'TEXT' THEN 'text' WHEN 'FORM' THEN 'text' ELSE 'none' END AS route, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 11 = 0 THEN 'NOT_A_PDF' WHEN p_partkey % 13 = 0 THEN 'ENCRYPTED' WHEN p_partkey % 17 = 0 THEN 'XFA_FORM' WHEN per < 50 AND share >= 0.8 THEN 'SCANNED' WHEN per < 50 THEN 'NO_TEXT_LAYER' WHEN per < 350 AND share >= 0.5 THEN 'MIXED' WHEN p_partkey % 3 > 0 THEN 'FORM' ELSE 'TEXT' END AS type
      FROM (SELECT *, p_retailprice * 2 / (p_size % 7 + 1) AS per, (p_size % 5)::DOUBLE / (p_size % 7 + 1) AS share FROM part)) GROUP BY 1, 2""",
    "doc_batch_account": "SELECT count(*) AS inputs, count_if(page_id % 9 <> 0) AS ok, count_if(page_id % 9 = 0) AS failed, true AS reconciled FROM pages",
    "src_page_range": "SELECT conv_id, CAST(page AS INT) AS page, length(text) AS n FROM (SELECT conv_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS page FROM conversations) WHERE page BETWEEN 1 AND 2",
    "agg_count_by_type": "SELECT event_type, n, row_number() OVER (ORDER BY n DESC, event_type) AS place FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)",
    "agg_latency_trial": "SELECT event_type, avg(CASE WHEN event_type <> 'error' THEN 1.0::DOUBLE ELSE 0.0 END) AS ok, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1",
    "agg_dup_names": "SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1",
    "agg_reconcile": "SELECT o_orderkey, n, abs(o_totalprice - lines) < 0.01 AS agrees FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS lines, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey",
}
