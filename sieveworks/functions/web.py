"""Text, markers and structured data of web pages, as expressions over an html column.

HTML nesting needs an automaton; what needs none is here. Script and style bodies are raw text in HTML,
so patterns find them exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .basic import col

#: Client-side frameworks' marks in a page, and marks of data embedded in it.
FRAMEWORKS = (
    ("__next", "Next.js"), ("data-reactroot", "React"), ("id=\"root\"", "React"), ("ng-version", "Angular"), ("ng-app", "AngularJS"), ("data-v-app", "Vue"), ("id=\"app\"", "Vue"), ("__nuxt", "Nuxt"), ("data-svelte", "Svelte"),
)
EMBEDDED = ("application/ld+json", "__next_data__", "__nuxt__", "__initial_state__", "__apollo_state__", "__preloaded_state__", "application/json", "itemscope")
#: Phrases and statuses of refusals.
BLOCK_PHRASES = ("access denied", "request blocked", "are you a robot", "unusual traffic", "verify you are human", "checking your browser", "enable javascript and cookies", "attention required", "pardon our interruption", "captcha")
BLOCK_STATUS = (401, 403, 407, 429, 503)
#: Vendor; beginnings of headers and cookies seen with it passively; beginnings of headers and of
#: cookies, and marks in a body, of an active decision; difficulty.
VENDORS = (
    ("Cloudflare", ("cf-ray", "cf-cache-status"), ("__cflb", "__cfruid"), ("cf-mitigated",), ("__cf_bm", "cf_clearance"), ("/cdn-cgi/challenge-platform/", "cf-browser-verification"), "high"),
    ("Akamai Bot Manager", ("x-akamai-transformed",), ("akacd_", "ak_bmsc"), ("akamai-grn",), ("_abck", "bm_sz", "bm_sv"), ("akam-sw.js", "/akam/"), "high"),
    ("DataDome", (), (), ("x-datadome", "x-dd-b"), ("datadome",), ("captcha.datadome.co", "js.datadome.co", "captcha-delivery.com"), "high"),
    ("HUMAN Security (PerimeterX)", (), (), ("x-px",), ("_px3", "_px2", "_pxhd", "_pxvid", "_pxde"), ("px-cloud.net", "perimeterx", "/px/captcha"), "high"),
    ("Kasada", (), (), ("x-kpsdk-ct", "x-kpsdk-cd", "x-kpsdk-r"), ("kp_uidz", "kp_uidzskip"), ("kpsdk",), "very high"),
    ("Imperva (Incapsula)", ("x-cdn",), (), ("x-iinfo",), ("incap_ses_", "visid_incap_", "nlbi_"), ("_incapsula_resource",), "high"),
    ("AWS WAF Bot Control", ("x-amz-cf-id", "x-amz-cf-pop"), (), ("x-amzn-waf-action",), ("aws-waf-token",), ("awswaf.com",), "medium"),
    ("F5 / BIG-IP ASM", (), ("bigipserver",), ("x-f5-", "x-waf-"), ("ts01", "tspd_101"), ("/tspd/", "/tsbd/"), "medium"),
    ("Sucuri", ("x-sucuri-id", "x-sucuri-cache"), (), (), ("sucuri_cloudproxy_uuid",), ("sucuri_cloudproxy_js",), "low"),
    ("Fastly", ("x-served-by", "x-fastly", "fastly-restarts"), (), (), (), (), "low"),
    ("Vercel", ("x-vercel-id", "x-vercel-cache"), (), (), (), (), "low"),
)
#: Captcha, marks in a page, marks that rule it out, kind.
CAPTCHAS = (
    ("reCAPTCHA v2", ("g-recaptcha", "google.com/recaptcha/api.js", "g-recaptcha-response"), ("render=",), "interactive challenge"),
    ("reCAPTCHA v3", ("recaptcha/api.js?render=", "grecaptcha.execute"), (), "invisible score"),
    ("hCaptcha", ("hcaptcha.com/1/api.js", "h-captcha", "h-captcha-response"), (), "interactive challenge"),
    ("Cloudflare Turnstile", ("challenges.cloudflare.com/turnstile", "cf-turnstile"), (), "invisible or interactive"),
    ("Arkose Labs (FunCaptcha)", ("arkoselabs.com", "funcaptcha", "fc-token"), (), "interactive puzzle"),
    ("GeeTest", ("/gt.js", "geetest", "gt_captcha"), (), "slider puzzle"),
    ("DataDome CAPTCHA", ("captcha-delivery.com", "geo.captcha", "dd_cookie", "datadome captcha"), (), "slider puzzle"),
)
DIFFICULTY = {"low": 1, "medium": 2, "high": 3, "very high": 4}
TIERS = ("trivial", "easy", "moderate", "hard", "very hard")
THIN = 800


def visible_text(html: Column | str) -> Column:
    """Text without the bodies of script, style and noscript, without tags, white space collapsed."""
    bare = F.regexp_replace(col(html), r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]+>", " "), r"\s+", " "))


def without_styling(html: Column | str) -> Column:
    """The page without class, id and style attributes: what durable extraction may rely on."""
    return F.regexp_replace(col(html), r"""(?i)\s(?:class|id|style)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""", "")


def embedded_markers(html: Column | str) -> Column:
    blob = F.lower(col(html))
    return F.filter(F.array(*(F.lit(m) for m in EMBEDDED)), lambda m: F.contains(blob, m))


def json_script_count(html: Column | str) -> Column:
    return F.regexp_count(col(html), F.lit(r"(?i)<script[^>]*type=[\"']application/(?:ld\+)?json[\"']")).cast("int")


def frameworks(html: Column | str) -> Column:
    blob = F.lower(col(html))
    return F.array_distinct(F.array_compact(F.array(*(F.when(F.contains(blob, F.lit(m)), n) for m, n in FRAMEWORKS))))


def render_verdict(html: Column | str) -> Column:
    """Embedded data, else client-rendered (thin and a framework), thin, or server-rendered."""
    thin = F.length(visible_text(html)) < THIN
    return F.when(F.size(embedded_markers(html)) > 0, "embedded data").when(thin & (F.size(frameworks(html)) > 0), "client-rendered").when(thin, "thin").otherwise("server-rendered")


def title(html: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(col(html), r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def meta_pairs(html: Column | str) -> Column:
    """Map of meta name or property (lower case) to content; the last of equal names holds."""
    tags = F.regexp_extract_all(col(html), F.lit(r"(?is)(<meta\b[^>]*>)"), F.lit(1))

    def attribute(tag: Column, names: str) -> Column:
        return F.nullif(F.regexp_extract(tag, rf"""(?is)\b(?:{names})\s*=\s*["']([^"']*)["']""", 1), F.lit(""))

    pairs = F.transform(tags, lambda t: F.struct(F.lower(attribute(t, "property|name")).alias("k"), attribute(t, "content").alias("v")))
    pairs = F.filter(pairs, lambda p: p["k"].isNotNull() & p["v"].isNotNull())
    last = F.aggregate(pairs, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))
    return last


def json_ld(html: Column | str) -> Column:
    """Raw bodies of JSON-LD scripts."""
    return F.regexp_extract_all(col(html), F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))


def lenient_json(raw: Column) -> Column:
    """Variant of a JSON text; trailing commas are forgiven, anything else that doesn't parse is null."""
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(F.regexp_replace(raw, r",\s*([}\]])", "$1")))


def feeds(html: Column | str) -> Column:
    return F.regexp_extract_all(col(html), F.lit(r"(?is)<link\b[^>]*type=[\"']application/(?:rss|atom)\+xml[\"'][^>]*href=[\"']([^\"']*)[\"']"), F.lit(1))


def resolve(base: Column, link: Column) -> Column:
    """A link against its page: absolute, scheme-relative, root-relative or relative."""
    origin = F.concat(F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), F.lit("//"), F.regexp_extract(base, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    folder = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "(?<=[^/])/[^/]*$", "")
    return (
        F.when(F.regexp_like(link, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*:")), link).when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), link))
        .when(F.startswith(link, F.lit("/")), F.concat(origin, link)).otherwise(F.concat(folder, F.lit("/"), link))
    )


def looks_blocked(status: Column, body: Column) -> Column:
    """A refusing status, or a refusal's phrase in the first 20,000 characters."""
    return status.isin(*BLOCK_STATUS) | _phrases(F.substring(body, 1, 20_000))


def looks_like_block_page(status: Column, body: Column) -> Column:
    """As before over the whole body, or a small body with a captcha and a vendor's mark."""
    small = (F.length(body) < 20_000) & (F.size(captchas(body)) > 0) & (F.size(vendors_in(body)) > 0)
    return status.isin(*BLOCK_STATUS) | _phrases(body) | small


def classify_response(status: Column, body: Column) -> Column:
    """unreachable, blocked, rate_limited, challenged, ok, redirect or http_<code>."""
    marked = _phrases(F.substring(body, 1, 200_000))
    return (
        F.when(status.isNull(), "unreachable").when(status.isin(401, 403, 407), "blocked").when(status == 429, "rate_limited").when(status.isin(503, 520, 521, 522) & marked, "challenged")
        .when(marked & (F.length(body) < 60_000), "challenged").when(status.between(200, 299), "ok").when(status.between(300, 399), "redirect").otherwise(F.concat(F.lit("http_"), status.cast("string")))
    )


def _phrases(body: Column) -> Column:
    blob = F.lower(F.coalesce(body, F.lit("")))
    return F.exists(F.array(*(F.lit(p) for p in BLOCK_PHRASES)), lambda p: F.contains(blob, p))


def _has(blob: Column, marks: Sequence[str]) -> Column:
    return F.exists(any_of(marks), lambda m: F.contains(blob, m)) if marks else F.lit(False)


def captchas(body: Column) -> Column:
    """Names of captchas in a page; a mark that rules one out holds over those that speak for it."""
    blob = F.lower(F.coalesce(body, F.lit("")))
    return F.array_compact(F.array(*(F.when(_has(blob, marks) & ~_has(blob, without), name) for name, marks, without, _ in CAPTCHAS)))


def vendors_in(body: Column) -> Column:
    blob = F.lower(F.coalesce(body, F.lit("")))
    return F.array_compact(F.array(*(F.when(_has(blob, v[5]), v[0]) for v in VENDORS)))


def vendor_evidence(headers: Column, body: Column, exact: bool = False) -> Column:
    """array<struct<vendor, engaged, difficulty>>: a vendor is engaged, and so difficult, only by active
    evidence. ``headers`` is one text of lines; cookies are its set-cookie lines. A mark may stand anywhere in the
    joined names of headers, or of cookies; with ``exact`` a name has to begin with it."""
    blob = F.lower(F.coalesce(body, F.lit("")))
    lines = F.transform(F.split(F.lower(F.coalesce(headers, F.lit(""))), "\n"), lambda x: F.trim(x))
    set_cookie = "set-cookie:"
    cookies = F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(set_cookie))), lambda x: F.substring_index(F.trim(F.substring(x, F.lit(len(set_cookie) + 1), F.length(x))), "=", 1))
    names = F.transform(lines, lambda x: F.substring_index(x, ":", 1))

    def begins(texts: Column, marks: Sequence[str]) -> Column:
        if not marks:
            return F.lit(False)
        if exact:
            return F.exists(texts, lambda x: F.exists(any_of(marks), lambda m: F.startswith(x, m)))
        return F.exists(any_of(marks), lambda m: F.contains(F.array_join(texts, " "), m))

    lines = names
    found = []
    for name, headers_seen, cookies_seen, headers_active, cookies_active, marks, difficulty in VENDORS:
        engaged = begins(lines, headers_active) | begins(cookies, cookies_active) | _has(blob, marks)
        seen = begins(lines, headers_seen) | begins(cookies, cookies_seen)
        found.append(F.when(seen | engaged, F.struct(F.lit(name).alias("vendor"), engaged.alias("engaged"), F.when(engaged, F.lit(difficulty)).alias("difficulty"))))
    return F.array_compact(F.array(*found))


def access_tier(vendors: Column, found_captchas: Column, blocked: Column, verdict: Column) -> Column:
    """The hardest of what was found."""
    rank = F.lit(0)
    for name, level in DIFFICULTY.items():
        rank = F.greatest(rank, F.when(F.exists(F.transform(vendors, lambda v: v["difficulty"]), _is(name)), level).otherwise(0))
    scored = F.size(F.filter(found_captchas, lambda c: c != "reCAPTCHA v3")) > 0
    level = F.greatest(rank, F.when(scored, 3).otherwise(0), F.when(blocked, 3).otherwise(0), F.when(verdict == "client-rendered", 2).otherwise(0))
    return F.element_at(F.array(*(F.lit(t) for t in TIERS)), level + 1)


def _is(name: str):
    return lambda x: x == F.lit(name)


def repair_class(transport: Column, blocked: Column, browser_ok: Column, redirected: Column, hits: Column, expected_found: Column, embedded: Column, text_length: Column) -> Column:
    """What broke a scraper, first match wins. A null hit count is a selector that could not be read; a null
    expected_found is that nothing was expected."""
    thin = text_length < THIN
    none, gone = F.coalesce(hits == 0, F.lit(False)), F.coalesce(~expected_found, F.lit(False))
    return (
        F.when(transport.isNotNull(), "transport").when(blocked & browser_ok, "header-level filtering").when(blocked, "blocked").when(redirected, "routing changed")
        .when(none & F.coalesce(expected_found, F.lit(False)), "selectors stale").when(none & embedded, "content moved into data").when(none & thin, "client-rendered").when(none, "selectors stale")
        .when(gone & embedded, "content moved into data").when(gone & thin, "client-rendered").when(gone, "content changed or removed")
        .when(F.coalesce(hits > 0, F.lit(False)), "target intact").otherwise("no fault reproduced")
    )


def any_of(values: Sequence[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def selector_parts(selector: Column) -> Column:
    """array<struct<tag, id, classes>> of a selector's steps, from tags, ids, classes and descent; null where it
    holds anything else."""
    step = F.regexp_like(selector, F.lit(r"^\s*[\w-]*(?:[.#][\w-]+)*(?:\s+[\w-]*(?:[.#][\w-]+)*)*\s*$")) & (F.trim(selector) != "")
    parts = F.transform(F.split(F.trim(selector), r"\s+"), lambda x: F.struct(
        F.regexp_extract(x, r"^([\w-]*)", 1).alias("tag"), F.regexp_extract(x, r"#([\w-]+)", 1).alias("id"), F.regexp_extract_all(x, F.lit(r"\.([\w-]+)"), F.lit(1)).alias("classes"),
    ))
    return F.when(step, parts)


def extrapolated(assets: DataFrame, key: str, order: str, size: Column, sample: int = 8) -> DataFrame:
    """``assets``: distinct rows. Mean size of the first ``sample`` of a key times their number: key, bytes, assets."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    rows = assets.select(key, size.alias("_size"), place.alias("_k"))
    return rows.groupBy(key).agg((F.avg(F.when(F.col("_k") <= sample, F.col("_size"))) * F.count(F.lit(1))).alias("bytes"), F.count(F.lit(1)).alias("assets"))


def changed(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Pages whose (url, lastmod) the last snapshot does not hold."""
    return pages.join(known, ["url", "lastmod"], "left_anti")
