"""Resume audit: 23 checks worth 100 points as rows, blockers, and job-description matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.basic import contains_term

PASS_MARK = 90.0
#: Check, group and points.
CHECKS = (
    ("email", "contact", 5), ("phone", "contact", 4), ("location", "contact", 3), ("links", "contact", 4), ("experience section", "sections", 7), ("education section", "sections", 5), ("skills section", "sections", 4), ("standard headings", "sections", 2),
    ("dated roles", "entries", 10), ("title and employer", "entries", 10), ("resolvable dates", "dates", 6), ("consistent dates", "dates", 4), ("bullets", "bullets", 4), ("standard glyph", "bullets", 3), ("active openers", "bullets", 5), ("skills list", "tools", 6),
    ("no rating graphics", "tools", 2), ("acronyms paired", "tools", 2), ("file format", "file", 4), ("file name", "file", 2), ("no images", "file", 3), ("no personal details", "file", 3), ("no declaration", "file", 2),
)
CREATIVE = r"(?i)^(?:my journey|where i.ve been|what i do|my toolbox|superpowers|the story so far)"
PERSONAL = (r"(?i)\bdate of birth\b|\bdob\b", r"(?i)\bmarital status\b|\bmarried\b", r"(?i)\breligion\b|\bnationality\b")
DECLARATION = r"(?i)\bi hereby declare\b"
ROLE = r"(?i)\b(?:engineer|manager|developer|analyst|director|lead|consultant|designer|intern|officer|specialist|architect)\b"


def audit(resumes: DataFrame) -> DataFrame:
    """``resumes``: id, file, text, images, columns. One row a check: id, ord, check, grp, earned, possible."""
    c = F.col
    lines = T.lines("text")
    r = resumes.withColumns({"lines": F.filter(lines, lambda x: F.trim(x) != ""), "text": F.coalesce("text", F.lit(""))})
    # Sections by a fold over the lines: the key in force, and the lines of the three sections that are read.
    named = F.transform("lines", lambda x: F.struct(x.alias("l"), T.classify_heading(x).alias("k")))
    none = F.array().cast("array<string>")
    start = F.struct(F.lit("header").alias("k"), none.alias("experience"), none.alias("education"), none.alias("skills"))

    def step(acc: Column, x: Column) -> Column:
        key = F.coalesce(x["k"], acc["k"])
        own = lambda n: F.when((key == n) & x["k"].isNull(), F.concat(acc[n], F.array(x["l"]))).otherwise(acc[n]).alias(n)
        return F.struct(key.alias("k"), own("experience"), own("education"), own("skills"))

    r = r.withColumn("s", F.aggregate(named, start, step))
    bullets = T.bullets(c("lines"))
    r = r.withColumn("bullets", bullets).withColumn("exp", F.filter("s.experience", lambda x: ~F.array_contains(c("bullets"), x)))
    r = r.withColumns({"dated": F.filter("exp", lambda x: F.regexp_like(x, F.lit(T.DATE_RANGE))), "roles": F.filter("exp", lambda x: F.regexp_like(x, F.lit(ROLE)) & ~F.regexp_like(x, F.lit(T.DATE_RANGE))), "skills": T.tool_tokens(c("s.skills")), "bad": F.array_distinct(F.regexp_extract_all("text", F.lit(f"({T.BAD_DATE})"), F.lit(1)))})
    n_dated, n_roles = F.size("dated"), F.size("roles")
    titled = F.aggregate("dated", F.lit(0.0), lambda s, x: s + F.when(F.regexp_like(x, F.lit(ROLE)) & F.regexp_like(x, F.lit(r",|\||\bat\b")), 1.0).otherwise(0.5))
    any_date = F.regexp_like("text", F.lit(T.DATE_RANGE))
    weak = F.size(F.filter("bullets", lambda x: F.regexp_like(F.regexp_replace(x, rf"^[\s{T.BULLETS}*-]+", ""), F.lit(T.WEAK_OPENER)))) / F.greatest(F.size("bullets"), F.lit(1))
    full = lambda cond, points: F.when(cond, float(points)).otherwise(0.0)
    head = F.array_join(F.slice("lines", 1, 12), "\n")
    suffix = F.lower(F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1))
    earned = {
        "email": full(F.regexp_like("text", F.lit(T.EMAIL)), 5), "phone": full(F.size(T.phones(c("text"))) > 0, 4), "location": full(F.regexp_like(head, F.lit(r"[A-Z][a-z]+,\s*[A-Z]")), 3),
        "links": F.when(F.regexp_like("text", F.lit(T.LINK)), 4.0).when(F.regexp_like(F.lower("text"), F.lit("linkedin|github|portfolio")), 1.0).otherwise(0.0),
        "experience section": full(F.size("s.experience") > 0, 7), "education section": full(F.size("s.education") > 0, 5), "skills section": full(F.size("s.skills") > 0, 4), "standard headings": full(~F.exists("lines", lambda x: F.regexp_like(F.trim(x), F.lit(CREATIVE))), 2),
        "dated roles": F.when(n_dated + n_roles > 0, 10.0 * n_dated / (n_dated + n_roles)).otherwise(0.0), "title and employer": F.when(n_dated > 0, 10.0 * titled / n_dated).otherwise(0.0),
        "resolvable dates": F.when(any_date, F.greatest(6.0 - 2.0 * F.size("bad"), F.lit(0.0))).otherwise(0.0), "consistent dates": F.when(~any_date, 0.0).when(T.date_styles(c("text")) > 1, 2.0).otherwise(4.0),
        "bullets": full(F.size("bullets") > 0, 4), "standard glyph": full((F.size("bullets") > 0) & ~F.exists("bullets", lambda x: F.regexp_like(x, F.lit(r"^\s*[➢➤✓✔]"))), 3), "active openers": F.when(F.size("bullets") > 0, 5.0 * (1.0 - F.least(F.lit(1.0), 2.0 * weak))).otherwise(0.0),
        "skills list": F.least(F.lit(6.0), F.size("skills") / 2.0), "no rating graphics": full(~F.regexp_like("text", F.lit("[★☆⬤◯●○]{3,}")), 2), "acronyms paired": F.when(F.regexp_like("text", F.lit(r"\([A-Z]{2,6}\)")), 2.0).otherwise(1.0),
        "file format": F.when(suffix == "docx", 4.0).when(suffix == "pdf", 3.0).otherwise(1.0), "file name": full(F.regexp_like("file", F.lit(r"(?i)^[A-Za-z]+[_ -][A-Za-z_ -]*resume|cv\.[a-z]+$")), 2), "no images": full(F.coalesce("images", F.lit(0)) == 0, 3),
        "no personal details": F.lit(3.0) - F.regexp_like("text", F.lit(PERSONAL[0])).cast("double") - F.regexp_like("text", F.lit(PERSONAL[1])).cast("double") - F.regexp_like("text", F.lit(PERSONAL[2])).cast("double"), "no declaration": full(~F.regexp_like("text", F.lit(DECLARATION)), 2),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(n).alias("check"), F.lit(g).alias("grp"), earned[n].cast("double").alias("earned"), F.lit(float(p)).alias("possible")) for k, (n, g, p) in enumerate(CHECKS)))
    return r.select("id", F.inline(rows))


def blockers(resumes: DataFrame) -> DataFrame:
    """id and the reasons that fail a resume whatever its score."""
    c = F.col
    text = F.coalesce("text", F.lit(""))
    found = F.array_compact(F.array(
        F.when(F.length(F.trim(text)) < 300, "too little text"), F.when(F.coalesce("columns", F.lit(1)) > 1, "columns"), F.when(F.size(T.placeholders(text)) > 0, "placeholders"),
        F.when((F.coalesce("images", F.lit(0)) > 0) & (F.length(F.trim(text)) < 200), "image only"),
    ))
    return resumes.select(c("id"), found.alias("blockers"))


def score(checks: DataFrame) -> DataFrame:
    """Percentage of the points; a denominator of one where there are no checks."""
    return checks.groupBy("id").agg((100.0 * F.sum("earned") / F.greatest(F.sum("possible"), F.lit(1.0))).alias("score"))


def verdicts(resumes: DataFrame) -> DataFrame:
    s = score(audit(resumes)).join(blockers(resumes), "id")
    return s.withColumn("pass", (F.col("score") >= PASS_MARK) & (F.size("blockers") == 0))


def match_terms(docs: DataFrame, terms: list[str]) -> DataFrame:
    """``docs``: id, text. matched and missing terms and the rate, whole terms only; literal patterns, no join."""
    hits = F.array_compact(F.array(*(F.when(contains_term("text", t), t) for t in terms)))
    return docs.select("id", hits.alias("matched"), F.array_except(F.array(*(F.lit(t) for t in terms)), hits).alias("missing"), (F.size(hits) / float(len(terms)) * 100.0).alias("rate"))
