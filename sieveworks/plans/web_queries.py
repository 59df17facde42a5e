"""Pages: rendering, harvest, location, access. Pages with structured data are built from part, so the
harvest must give its columns back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import automata as A
from ..functions import web as W
from ..operators import json_tree as J
from ..operators import robots as R
from .common import fixture, fixture_sql, spread, table


def _host() -> Column:
    return F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1)


def _product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "part"), "p_partkey")
    record = F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Product").alias("@type"), F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("name")).alias("brand"), F.array(F.struct(F.col("p_retailprice").alias("price"), F.lit("USD").alias("priceCurrency"))).alias("offers"), F.col("p_size").alias("size")))
    body = F.concat(
        F.lit("<html><head><title> Part "), F.col("p_partkey").cast("string"), F.lit("</title><meta property=\"og:title\" content=\""), F.col("p_name"), F.lit("\"><meta name='description' content='old'><meta name='description' content='"), F.col("p_type"),
        F.lit("'><link rel=\"alternate\" type=\"application/rss+xml\" href=\"/feed/"), F.col("p_partkey").cast("string"), F.lit("\"><script type=\"application/ld+json\">"), F.regexp_replace(record, r"\}$", ",}"), F.lit("</script><script>window.__STATE__ = {\"id\": "), F.col("p_partkey").cast("string"), F.lit(", \"note\": \"a } b\"};</script></head><body id=\"root\"><div class=\"card x\"><span class='price'>"), F.col("p_retailprice").cast("decimal(12,2)").cast("string"),
        F.lit("</span></div><div itemscope itemtype=\"https://schema.org/Product\"><b itemprop=\"name\">"), F.col("p_name"), F.lit("</b><meta itemprop=\"size\" content=\""), F.col("p_size").cast("string"), F.lit("\"></div><table><tr><th>brand</th><th>size</th></tr><tr><td>"), F.col("p_brand"), F.lit("</td><td>"), F.col("p_size").cast("string"), F.lit("</td></tr></table></body></html>"),
    )
    return p.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://shop.example/p/"), F.col("p_partkey").cast("string")).alias("url"), body.alias("html"))


def web_render_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(_host().alias("host"), W.render_verdict("html").alias("verdict"), F.length(W.visible_text("html")).alias("n"))
    return p.groupBy("host", "verdict").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").cast("long").alias("visible"))


def str_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.length(W.visible_text("html")).cast("long").alias("n"), F.md5(W.visible_text("html")).alias("md5"))


def str_styling_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The harvest of a page and of its stripped twin must agree."""
    p = _product_pages(spark, sf_dir)
    return p.select("page_id", (F.length("html") - F.length(W.without_styling("html"))).cast("long").alias("removed"), (A.microdata(W.without_styling("html")) == A.microdata("html")).alias("agree"))


def str_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.try_parse_url(u, F.lit("PROTOCOL")).alias("scheme"), F.try_parse_url(u, F.lit("HOST")).alias("host"), W.resolve(u, F.lit("/a/b")).alias("rooted"), W.resolve(u, F.lit("x.html")).alias("relative"), W.resolve(u, F.lit("//cdn.example/y")).alias("scheme_relative"))


def j_embed_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _product_pages(spark, sf_dir).select("page_id", F.array_join(W.embedded_markers("html"), ",").alias("markers"), W.json_script_count("html").alias("scripts"))


def web_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _product_pages(spark, sf_dir).withColumn("m", W.meta_pairs("html"))
    return p.select("page_id", W.title("html").alias("title"), F.col("m")["og:title"].alias("og_title"), F.col("m")["description"].alias("description"))


def web_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", W.title("html").alias("title"))


def web_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _product_pages(spark, sf_dir)
    return p.select("page_id", F.size(W.json_ld("html")).cast("long").alias("n"), W.resolve(F.col("url"), W.feeds("html")[0]).alias("feed"))


def j_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _product_pages(spark, sf_dir).select("page_id", W.lenient_json(W.json_ld("html")[0]).alias("v"))
    g = lambda path, kind: F.try_variant_get("v", path, kind)
    return v.select("page_id", g("$.name", "string").alias("name"), g("$.brand.name", "string").alias("brand"), g("$.offers[0].price", "double").alias("price"), g("$.size", "int").alias("size"))


def j_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _product_pages(spark, sf_dir).select("page_id", W.lenient_json(W.json_ld("html")[0]).alias("v"))
    return J.walk(v, "page_id", "v").select(F.col("id").alias("page_id"), "path", "leaf")


def j_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _product_pages(spark, sf_dir).select("page_id", W.lenient_json(W.json_ld("html")[0]).alias("v"))
    return J.find(J.walk(v, "page_id", "v"), "PRICE").select(F.col("id").alias("page_id"), "kind", "path", "place")


def agg_path_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _product_pages(spark, sf_dir).select("page_id", W.lenient_json(W.json_ld("html")[0]).alias("v"))
    return J.stable_paths(J.walk(v, "page_id", "v"), 10)


def j_events_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return J.walk(e, "event_id", "v").select(F.col("id").alias("event_id"), "path", "value")


def web_microdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _product_pages(spark, sf_dir).select("page_id", F.from_json(A.microdata("html"), "array<struct<`@type`:string,name:string,size:string>>").alias("m"))
    return m.select("page_id", F.size("m").cast("long").alias("items"), F.col("m")[0]["@type"].alias("type"), F.col("m")[0]["name"].alias("name"), F.col("m")[0]["size"].alias("size"))


def a_table_to_dicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as maps by header; ragged rows are dropped and counted."""
    t = _product_pages(spark, sf_dir).select("page_id", F.from_json(A.tables("html"), A.TABLES_TYPE)[0].alias("t"))
    full = F.filter("t.rows", lambda r: F.size(r) == F.size("t.headers"))
    return t.select("page_id", F.map_from_arrays("t.headers", full[0])["brand"].alias("brand"), (F.size("t.rows") - F.size(full)).cast("long").alias("ragged"))


def web_js_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _product_pages(spark, sf_dir).select("page_id", F.try_parse_json(A.js_state("html")).alias("s"))
    return s.select("page_id", F.try_variant_get("s", "$.__STATE__.id", "long").alias("id"), F.try_variant_get("s", "$.__STATE__.note", "string").alias("note"))


def web_selector_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of each selector on all pages; a page is sent and parsed once for all of them."""
    selectors = F.array(*(F.lit(x) for x in ("div.card span.price", "#root .price", "div.card.x", "ul li", "div > span")))
    p = _product_pages(spark, sf_dir).select(selectors.alias("selector"), A.selector_counts("html", selectors).alias("n"))
    return p.select(F.inline(F.arrays_zip("selector", "n"))).groupBy("selector").agg(F.sum("n").cast("long").alias("hits"))


def web_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything a page publishes, counted."""
    p = _product_pages(spark, sf_dir).withColumn("found", A.items_and_tables_counts("html"))
    return p.select("page_id", F.size(W.json_ld("html")).cast("long").alias("jsonld"), F.size(W.meta_pairs("html")).cast("long").alias("meta"), F.size(W.feeds("html")).cast("long").alias("feeds"), F.col("found.tables").alias("tables"), F.col("found.items").alias("items"))


def str_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with their character references decoded."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(A.unescape(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))).alias("md5"))


#: Answers of all kinds.
_RESPONSES = """(1, 200, 'server: nginx', '<html><body>all fine</body></html>'), (2, 403, 'cf-ray: 1', 'Access Denied'), (3, 503, 'server: cloudflare', 'Checking your browser <script src="/cdn-cgi/challenge-platform/x.js">'), (4, 200, 'x-datadome: protected', '<div class="g-recaptcha"></div> captcha-delivery.com'),
 (5, 429, '', 'slow down'), (6, CAST(NULL AS INT), '', CAST(NULL AS STRING)), (7, 301, 'location: /x', ''), (8, 404, 'cf-ray: 2', 'not here'), (9, 200, 'x-px-block: 1', 'recaptcha/api.js?render=abc'), (10, 401, '', 'sign in'), (11, 500, '', 'oops'),
 (12, 200, concat_ws(chr(10), 'x-vercel-id: 1', 'set-cookie: __cf_bm=1'), 'fine'), (13, 200, concat_ws(chr(10), 'set-cookie: BIGipServerpool=1', 'x-served-by: c'), 'fine'), (14, 403, 'Set-Cookie: KP_UIDz=1', ''), (15, 200, 'x-amz-cf-id: 1', 'awswaf.com h-captcha')"""


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's host answers in one of these ways, and names the page in the body."""
    ways = fixture(spark, "way, status, headers, body", _RESPONSES)
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", (F.col("page_id") % 15 + 1).alias("way")).join(F.broadcast(ways), "way")
    return rows.select("id", "status", "headers", F.concat("body", F.lit(" "), "url").alias("body"))


def web_access_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, b = F.col("status"), F.col("body")
    return _responses(spark, sf_dir).select("id", W.looks_blocked(s, b).alias("looks_blocked"), W.looks_like_block_page(s, b).alias("block_page"), W.classify_response(s, b).alias("class"))


def web_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _responses(spark, sf_dir).select("id", F.inline(W.vendor_evidence(F.col("headers"), F.col("body"))))
    return r.select("id", "vendor", "engaged", "difficulty")


def web_captcha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _responses(spark, sf_dir).select("id", F.array_join(W.captchas(F.col("body")), ",").alias("captchas"))


def web_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, b = F.col("status"), F.col("body")
    return _responses(spark, sf_dir).select("id", W.access_tier(W.vendor_evidence(F.col("headers"), b), W.captchas(b), F.coalesce(W.looks_blocked(s, b), F.lit(False)), W.render_verdict("body")).alias("tier"))


def web_repair_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What broke a scraper of each page, by what was seen of it and the text it has."""
    k = F.col("page_id")
    hits = F.when(k % 4 > 0, (k % 4 - 1).cast("int"))
    found = F.when(k % 3 > 0, k % 3 == 1)
    return table(spark, sf_dir, "pages").select("page_id", W.repair_class(F.when(k % 13 == 0, "dns"), k % 5 == 0, k % 10 == 0, k % 7 == 0, hits, found, F.size(W.embedded_markers("html")) + k % 6 == 0, F.length(W.visible_text("html")) * F.when(k % 2 == 0, 1).otherwise(0)).alias("class"))


#: Robots files with shared groups, ties, comments and empty rules.
_ROBOTS = r"""(1, concat_ws(chr(10), 'User-agent: *', 'User-agent: Other', 'Disallow: /private', 'Allow: /private/open', 'Crawl-delay: 2.5', 'Sitemap: https://a.example/s.xml')), (2, concat_ws(chr(10), '# nothing', 'User-agent: GPTBot', 'User-agent: CCBot', 'Disallow: /', '', 'User-agent: *', 'Disallow:')),
 (3, concat_ws(chr(10), 'user-agent: *', 'disallow: /private/open', 'allow: /private/open', 'crawl-delay: soon')), (4, ''), (5, concat_ws(chr(10), 'User-agent: x', 'Disallow: /', 'Sitemap: https://b.example/1', 'Sitemap: https://b.example/2', 'User-agent: *', 'Disallow: /private/open$'))"""


def web_probe_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a host: share of good answers, weight and what access that means."""
    p = table(spark, sf_dir, "pages").select(_host().alias("host"), F.when(F.col("page_id") % 7 == 0, 403).when(F.col("page_id") % 5 == 0, 301).otherwise(200).alias("status"), F.length("html").alias("n"))
    ok = F.avg(F.when(F.col("status").between(200, 399), 1.0).otherwise(0.0))
    return p.groupBy("host").agg(F.count(F.lit(1)).alias("samples"), ok.alias("ok_rate"), F.max("n").cast("long").alias("heaviest")).withColumn("access", F.when(F.col("ok_rate") == 1, "open").when(F.col("ok_rate") == 0, "blocked").otherwise("intermittent"))


def web_probe_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What robots forbid is never looked at."""
    facts = R.robots_facts(fixture(spark, "id, robots", _ROBOTS), "/private/open/x").select(F.col("id").alias("k"), "allowed")
    p = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 5 + 1).alias("k"), "html")
    gated = p.join(facts, "k")
    return gated.select("page_id", F.when(F.col("allowed"), W.render_verdict("html")).otherwise("unknown").alias("tier"))


def agg_cardinality_assert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").groupBy(_host().alias("host")).agg(F.count(F.lit(1)).alias("n"))
    return p.filter("n <> 5")


def doc_source_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field from the first source that has it, and which one that was."""
    p = _product_pages(spark, sf_dir).withColumn("v", W.lenient_json(W.json_ld("html")[0])).withColumn("m", W.meta_pairs("html"))
    ld = F.when(F.col("page_id") % 8 == 0, F.try_variant_get("v", "$.name", "string"))
    og = F.col("m")["og:title"]
    return p.select("page_id", F.coalesce(ld, og).alias("name"), F.when(ld.isNotNull(), "json-ld").when(og.isNotNull(), "open graph").alias("source"))


def join_positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists by position, as long as the shorter: a part's words and the characters of its type."""
    f = table(spark, sf_dir, "part")
    left = f.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "title"))
    right = f.select("p_partkey", F.posexplode(F.slice(F.split("p_type", ""), F.lit(1), (F.col("p_partkey") % 4).cast("int"))).alias("pos", "letter"))
    return left.join(right, ["p_partkey", "pos"])


_P4 = "part"
_VT = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript\s*>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"
_PHRASE = " OR ".join(f"contains(b, '{p}')" for p in W.BLOCK_PHRASES)
_MARK = " OR ".join(f"contains(lower(html), '{m}')" for m in W.EMBEDDED)
_FRAME = " OR ".join(f"contains(lower(html), '{m}')" for m, _ in W.FRAMEWORKS)
_VERDICT = f"CASE WHEN {_MARK} THEN 'embedded data' WHEN length({_VT}) < 800 AND ({_FRAME}) THEN 'client-rendered' WHEN length({_VT}) < 800 THEN 'thin' ELSE 'server-rendered' END"
_HOSTQ = "regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)"
_ANSWERS = f"(SELECT *, lower(coalesce(body, '')) AS b, list_transform(string_split(lower(coalesce(headers, '')), chr(10)), lambda x: trim(x)) AS h FROM (SELECT page_id AS id, status, headers, body || ' ' || url AS body FROM pages JOIN {fixture_sql('way, status, headers, body', _RESPONSES)} ON way = page_id % 15 + 1))"
_VENDOR_MARKS = ", ".join(f"('{v[0]}', '{place}', {active}, '{m}', '{v[6]}')" for v in W.VENDORS for place, active, marks in (("h", "false", v[1]), ("c", "false", v[2]), ("h", "true", v[3]), ("c", "true", v[4]), ("b", "true", v[5])) for m in marks)
_EVIDENCE = f"(SELECT a.id, vendor, active, difficulty FROM {_ANSWERS} AS a JOIN (VALUES {_VENDOR_MARKS}) AS v(vendor, place, active, mark, difficulty) ON CASE place WHEN 'b' THEN contains(b, mark) WHEN 'h' THEN contains(array_to_string(list_transform(h, lambda x: split_part(x, ':', 1)), ' '), mark) ELSE contains(array_to_string(list_transform(list_filter(h, lambda x: starts_with(x, 'set-cookie:')), lambda x: split_part(trim(x[12:]), '=', 1)), ' '), mark) END)"
_CAPTCHA_LIST = "concat_ws(',', " + ", ".join("CASE WHEN (" + " OR ".join(f"contains(b, '{m}')" for m in marks) + ")" + "".join(f" AND NOT contains(b, '{m}')" for m in without) + f" THEN '{name}' END" for name, marks, without, _ in W.CAPTCHAS) + ")"
QUERIES = {f.__name__: f for f in (web_render_verdict, str_visible_text, str_styling_strip, str_domain, j_embed_detect, web_meta, web_title, web_scripts, j_product, j_walk, j_find, agg_path_stability, j_events_walk, web_microdata, a_table_to_dicts, web_js_state, web_selector_count, web_harvest, str_decode, web_access_block, web_vendor, web_captcha, web_tier, web_repair_class, web_probe_site, web_probe_gate, agg_cardinality_assert, doc_source_precedence, join_positional_zip)}
_LEAVES = "(VALUES ('.@context', '@context'), ('.@type', '@type'), ('.name', 'name'), ('.brand.name', 'name'), ('.offers[0].price', 'price'), ('.offers[0].priceCurrency', 'priceCurrency'), ('.size', 'size')) AS l(path, leaf)"
ORACLE_SQL = {
    "web_render_verdict": f"SELECT host, verdict, count(*) AS pages, CAST(sum(n) AS BIGINT) AS visible FROM (SELECT {_HOSTQ} AS host, {_VERDICT} AS verdict, length({_VT}) AS n FROM pages) GROUP BY 1, 2",
    "str_visible_text": f"SELECT page_id, length({_VT}) AS n, md5({_VT}) AS md5 FROM pages",
    "str_styling_strip": f"SELECT p_partkey AS page_id, {len(' id=' + chr(34) + 'root' + chr(34)) + len(' class=' + chr(34) + 'card x' + chr(34)) + len(' class=' + chr(39) + 'price' + chr(39))}::BIGINT AS removed, true AS agree FROM {_P4}",
    "str_domain": r"SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/a/b' AS rooted, regexp_replace(url, '[^/]*$', '') || 'x.html' AS relative, regexp_extract(url, '^([a-z]+:)', 1) || '//cdn.example/y' AS scheme_relative FROM pages",
    "j_embed_detect": f"SELECT p_partkey AS page_id, 'application/ld+json,itemscope' AS markers, 1::INT AS scripts FROM {_P4}",
    "web_meta": f"SELECT p_partkey AS page_id, 'Part ' || p_partkey AS title, p_name AS og_title, p_type AS description FROM {_P4}",
    "web_title": r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages",
    "web_scripts": f"SELECT p_partkey AS page_id, 1::BIGINT AS n, 'https://shop.example/feed/' || p_partkey AS feed FROM {_P4}",
    "j_product": f"SELECT p_partkey AS page_id, p_name AS name, p_brand AS brand, p_retailprice AS price, p_size AS size FROM {_P4}",
    "j_walk": f"SELECT p_partkey AS page_id, path, leaf FROM {_P4}, {_LEAVES}",
    "j_find": f"SELECT p_partkey AS page_id, 'key' AS kind, path, place FROM {_P4}, (VALUES ('.offers[0].price', 1), ('.offers[0].priceCurrency', 2)) AS l(path, place)",
    "agg_path_stability": f"SELECT replace(path, '[0]', '[]') AS path, count(*) AS pages FROM {_P4}, {_LEAVES} GROUP BY 1",
    "j_events_walk": "SELECT event_id, replace(t.fullkey, '$', '') AS path, CAST(t.atom AS VARCHAR) AS value FROM events, json_tree(props) AS t WHERE t.atom IS NOT NULL",
    "web_microdata": f"SELECT p_partkey AS page_id, 1::BIGINT AS items, 'Product' AS type, p_name AS name, CAST(p_size AS VARCHAR) AS size FROM {_P4}",
    "a_table_to_dicts": f"SELECT p_partkey AS page_id, p_brand AS brand, 0::BIGINT AS ragged FROM {_P4}",
    "web_js_state": f"SELECT p_partkey AS page_id, p_partkey AS id, 'a }} b' AS note FROM {_P4}",
    "web_selector_count": f"SELECT s AS selector, CASE WHEN w >= 0 THEN w * count(*) END AS hits FROM {_P4}, (VALUES ('div.card span.price', 1), ('#root .price', 1), ('div.card.x', 1), ('ul li', 0), ('div > span', -1)) AS v(s, w) GROUP BY s, w",
    "web_harvest": f"SELECT p_partkey AS page_id, 1::BIGINT AS jsonld, 2::BIGINT AS meta, 1::BIGINT AS feeds, 1::BIGINT AS tables, 1::BIGINT AS items FROM {_P4}",
    "str_decode": "SELECT page_id, md5(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')) AS md5 FROM pages",
    "web_access_block": f"""SELECT id, CASE WHEN status IN (401,403,407,429,503) OR {_PHRASE} THEN true WHEN status IS NULL THEN NULL ELSE false END AS looks_blocked, CASE WHEN status IN (401,403,407,429,503) OR {_PHRASE} OR (length(b) < 20000 AND {_CAPTCHA_LIST} <> '' AND (SELECT count(*) FROM {_EVIDENCE} AS e WHERE e.id = a.id AND active AND contains(b, 'captcha-delivery.com') OR e.id = a.id AND contains(b, 'awswaf.com')) > 0) THEN true WHEN status IS NULL THEN NULL ELSE false END AS block_page,
      CASE WHEN status IS NULL THEN 'unreachable' WHEN status IN (401,403,407) THEN 'blocked' WHEN status = 429 THEN 'rate_limited' WHEN {_PHRASE} THEN 'challenged' WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN status BETWEEN 300 AND 399 THEN 'redirect' ELSE 'http_' || status END AS class FROM {_ANSWERS} AS a""",
    "web_vendor": f"SELECT id, vendor, bool_or(active) AS engaged, CASE WHEN bool_or(active) THEN any_value(difficulty) END AS difficulty FROM {_EVIDENCE} GROUP BY 1, 2",
    "web_captcha": f"SELECT id, {_CAPTCHA_LIST} AS captchas FROM {_ANSWERS}",
    "web_tier": f"""SELECT id, ['trivial', 'easy', 'moderate', 'hard', 'very hard'][1 + greatest(level, CASE WHEN regexp_matches(found, 'v2|hCaptcha|Turnstile|Arkose|GeeTest|DataDome') THEN 3 ELSE 0 END, CASE WHEN coalesce(refused, false) THEN 3 ELSE 0 END, CASE WHEN thin THEN 2 ELSE 0 END)] AS tier FROM (
      SELECT r.id, coalesce(max(CASE WHEN active THEN CASE difficulty WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END END), 0) AS level, any_value({_CAPTCHA_LIST.replace('b,', 'r.b,')}) AS found, any_value(status IN (401,403,407,429,503) OR {_PHRASE.replace('(b,', '(r.b,')}) AS refused, any_value(({_FRAME.replace('lower(html)', 'r.b')}) AND NOT ({_MARK.replace('lower(html)', 'r.b')})) AS thin FROM {_ANSWERS} AS r LEFT JOIN {_EVIDENCE} AS e ON e.id = r.id GROUP BY 1)""",
    "web_repair_class": f"SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'transport' WHEN page_id % 10 = 0 THEN 'header-level filtering' WHEN page_id % 5 = 0 THEN 'blocked' WHEN page_id % 7 = 0 THEN 'routing changed' WHEN hits = 0 AND found THEN 'selectors stale' WHEN hits = 0 AND embedded THEN 'content moved into data' WHEN hits = 0 AND n < 800 THEN 'client-rendered' WHEN hits = 0 THEN 'selectors stale' WHEN NOT found AND embedded THEN 'content moved into data' WHEN NOT found AND n < 800 THEN 'client-rendered' WHEN NOT found THEN 'content changed or removed' WHEN hits > 0 THEN 'target intact' ELSE 'no fault reproduced' END AS class FROM (SELECT page_id, CASE WHEN page_id % 4 > 0 THEN page_id % 4 - 1 END AS hits, CASE WHEN page_id % 3 > 0 THEN page_id % 3 = 1 END AS found, page_id % 6 = 0 AND NOT ({_MARK}) AS embedded, CASE WHEN page_id % 2 = 0 THEN length({_VT}) ELSE 0 END AS n FROM pages)",
    "web_probe_site": f"SELECT *, CASE WHEN ok_rate = 1 THEN 'open' WHEN ok_rate = 0 THEN 'blocked' ELSE 'intermittent' END AS access FROM (SELECT {_HOSTQ} AS host, count(*) AS samples, avg(CASE WHEN page_id % 7 = 0 THEN 0.0::DOUBLE ELSE 1.0 END) AS ok_rate, max(length(html)) AS heaviest FROM pages GROUP BY 1)",
    "web_probe_gate": f"SELECT page_id, CASE WHEN page_id % 5 + 1 = 5 THEN 'unknown' ELSE {_VERDICT} END AS tier FROM pages",
    "agg_cardinality_assert": f"SELECT {_HOSTQ} AS host, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) <> 5",
    "doc_source_precedence": f"SELECT p_partkey AS page_id, p_name AS name, CASE WHEN p_partkey % 8 = 0 THEN 'json-ld' ELSE 'open graph' END AS source FROM {_P4}",
    "join_positional_zip": "SELECT p_partkey, pos::INT AS pos, title, letter FROM (SELECT p_partkey, unnest(range(0, least(len(a), p_partkey % 4, length(p_type)))) AS pos, a, p_type FROM (SELECT *, string_split(p_name, ' ') AS a FROM part)), LATERAL (SELECT a[pos + 1] AS title, p_type[(pos + 1)::INT] AS letter)",
}
