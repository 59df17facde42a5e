"""Lines, headings, dates, bullets and terms of documents.

Patterns are Unicode-aware (``(?U)``) where word characters and spaces of any script count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basic import col

#: Section keys and the headings that name them (one key is a heading's plain word), first match wins.
SECTIONS = (
    ("summary", r"(professional |executive |career )?(summary|profile)|about( me)?|objective"),
    ("experience", r"(work |professional |relevant )?experience|employment( history)?|work history|career history"),
    ("education", r"education( and training)?|academic (background|qualifications)|qualifications"),
    ("skills", r"(technical |core |key )?skills|competencies|core competencies|technologies|tools"),
    ("projects", r"(personal |selected |key )?projects|portfolio"),
    ("certifications", r"certifications?|licen[cs]es( and certifications)?|courses|awards"),
)
MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
DATE_RANGE = rf"(?i)(?:{MONTH}\s+)?(?:19|20)\d\d\s*(?:-|–|—|to)\s*(?:(?:{MONTH}\s+)?(?:19|20)\d\d|present|current|now)"
BAD_DATE = r"(?i)'\d\d\s*(?:-|–|—|to)\s*'?\d\d|(?:19|20)\d\d\s*[-–—]\s*\d\d(?!\d)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?\d[\d ().-]{6,}\d"
LINK = r"https?://[^\s]+|(?:www\.|linkedin\.com/|github\.com/)[^\s]+"
PLACEHOLDER = r"(?i)\[(?:your|insert|add)[^\]]*\]|lorem ipsum|xx+@xx+|your name here|tbd\b"
BULLETS = "•◦▪‣●○■□➢➤✓✔"
WEAK_OPENER = r"(?i)^(?:responsible for|worked on|helped|assisted|involved in|participated in|tasked with|duties included)\b"
SMART = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", " ": " ", "•": "-", "…": "..."}
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff"}


def norm(text: Column | str) -> Column:
    """White space collapsed to single spaces, trimmed; null gives the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?U)\s+", " "))


def clean(text: Column | str) -> Column:
    """Typographic characters in plain ASCII, zero-width ones gone, blanks collapsed."""
    out = F.regexp_replace(col(text), "[​‌‍﻿]", "")
    for a, b in (SMART | LIGATURES).items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, "[ \t]+", " "))


def lines(text: Column | str) -> Column:
    return F.split(F.coalesce(col(text), F.lit("")), r"\r\n|[\n\r\u000B\f\u001C\u001D\u001E\u0085  ]")


def classify_heading(line: Column) -> Column:
    bare = F.lower(F.trim(F.regexp_replace(line, r"[:\s]+$", "")))
    out = F.when(F.lit(False), "")
    for key, pattern in SECTIONS:
        out = out.when(F.regexp_like(bare, F.lit(f"^(?:{pattern})$")), key)
    return out


def is_heading(line: Column) -> Column:
    """Short, no bullet, no sentence marks or figures, few words, mostly upper or title case."""
    t = F.trim(line)
    words = F.split(t, r"\s+")
    letters = F.regexp_replace(t, r"(?U)[^\p{L}]", "")
    upper = F.length(F.regexp_replace(letters, r"(?U)[^\p{Lu}]", ""))
    titled = F.forall(words, lambda w: F.regexp_like(w, F.lit(r"(?U)^(?:\p{Lu}.*|and|of|the|&|in|for)$")))
    ok = (F.length(t) > 0) & (F.length(t) <= 60) & ~F.regexp_like(t, F.lit(f"^[{BULLETS}*-]")) & ~F.regexp_like(t, F.lit(r"[,|@]|:\s*\S|\d{4}")) & ~F.regexp_like(t, F.lit(rf"(?i)\b{MONTH}\s+\d"))
    return F.coalesce(ok & (F.size(words) <= 6) & (((F.length(letters) > 0) & (upper > 0.8 * F.length(letters))) | titled), F.lit(False))


def bullets(all_lines: Column) -> Column:
    """Lines that begin with a glyph; if there are none, those that begin with a dash or star."""
    glyphs = F.filter(all_lines, lambda x: F.regexp_like(x, F.lit(rf"^\s*[{BULLETS}]")))
    dashes = F.filter(all_lines, lambda x: F.regexp_like(x, F.lit(r"^\s*[-*]\s+\S")))
    return F.when(F.size(glyphs) > 0, glyphs).otherwise(dashes)


def phones(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"({PHONE})"), F.lit(1))
    return F.filter(found, lambda p: F.length(F.regexp_replace(p, r"\D", "")) >= 8)


def placeholders(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"({PLACEHOLDER})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.substring(F.lower(x), 1, 60))))


def date_styles(text: Column) -> Column:
    """How many of the two date styles (month names, numbers) a text uses."""
    named = F.regexp_like(text, F.lit(rf"(?i)\b{MONTH}\s+(?:19|20)\d\d"))
    numeric = F.regexp_like(text, F.lit(r"\b\d{1,2}/(?:19|20)\d\d"))
    return named.cast("int") + numeric.cast("int")


def tool_tokens(section_lines: Column) -> Column:
    """Terms of a list section: labels before a colon dropped, split at marks."""
    bare = F.transform(section_lines, lambda x: F.regexp_replace(x, r"^\s*(?:\S+\s+){0,3}\S+:\s*", ""))
    parts = F.flatten(F.transform(bare, lambda x: F.split(x, r"[,;|•]")))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) > 1)


def acronyms(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z]{2,6})\b"), F.lit(1))))


def escape_xml(text: Column) -> Column:
    out = F.regexp_replace(text, "[\u0000-\u0008\u000b\u000c\u000e-\u001f]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def column_letters(n: Column) -> Column:
    """0 is A, 26 is AA: a fold over base 26 without a zero."""
    letter = lambda k: F.char(F.lit(65) + k)
    start = F.struct((n + 1).cast("long").alias("n"), F.lit("").alias("s"))

    def step(acc: Column, _: Column) -> Column:
        k = acc["n"] - 1
        on = acc["n"] > 0
        return F.struct(F.when(on, F.floor(k / 26)).otherwise(acc["n"]).cast("long").alias("n"), F.when(on, F.concat(letter(F.pmod(k, F.lit(26))), acc["s"])).otherwise(acc["s"]).alias("s"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, step, lambda acc: acc["s"])


def sheet_name(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, r"[\[\]:*?/\\]", "_"), 1, 31)


def is_number(cell: Column) -> Column:
    return F.regexp_like(F.trim(cell), F.lit(r"^-?\d{1,3}(?:,\d{3})+(?:\.\d+)?$|^-?\d+(?:\.\d+)?$"))


def keep_as_text(cell: Column) -> Column:
    """Codes that numbers would spoil: more than 15 characters, or a leading zero."""
    t = F.trim(cell)
    return (F.length(t) > 15) | F.regexp_like(t, F.lit(r"^-?0\d"))


def as_number(cell: Column) -> Column:
    return F.when(is_number(cell) & ~keep_as_text(cell), F.replace(F.trim(cell), F.lit(","), F.lit("")).try_cast("double"))


def signed_number(cell: Column) -> Column:
    """(1,234), 1,234- and 1.234,56 as numbers."""
    t = F.trim(cell)
    negative = F.regexp_like(t, F.lit(r"^\(.*\)$|-$|^-"))
    bare = F.regexp_replace(t, r"[()\s-]", "")
    comma = F.regexp_like(bare, F.lit(r"^\d{1,3}(?:\.\d{3})+,\d+$|^\d+,\d{1,2}$"))
    plain = F.when(comma, F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(bare, F.lit(","), F.lit("")))
    return plain.try_cast("double") * F.when(negative, -1.0).otherwise(1.0)


def money(x: Column) -> Column:
    return (
        F.when(x.isNull(), F.lit(None).cast("string")).when(F.abs(x) >= 1e9, F.concat(F.lit("$"), F.format_number(x / 1e9, 1), F.lit("B")))
        .when(F.abs(x) >= 1e6, F.concat(F.lit("$"), F.format_number(x / 1e6, 1), F.lit("M"))).otherwise(F.concat(F.lit("$"), F.format_number(x, 0)))
    )


def file_stem(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, "[^A-Za-z0-9_.-]+", "_"), 1, 60)


def resume_name(name: Column) -> Column:
    return F.concat(F.array_join(F.slice(F.regexp_extract_all(name, F.lit("([A-Za-z]+)"), F.lit(1)), 1, 3), "_"), F.lit("_Resume.docx"))


def is_kebab(name: Column) -> Column:
    return F.regexp_like(name, F.lit("^[a-z0-9]+(?:-[a-z0-9]+)*$")) & (F.length(name) <= 64)


def mojibake(text: Column) -> Column:
    return F.regexp_like(text, F.lit("Ã[\u0080-¿]|â€|Â[\u0080-¿]|�"))


def pdf_string_length(token: Column, two_byte: Column) -> Column:
    """Glyphs of a PDF string: hex digits by two (four if glyphs are two bytes), escapes as one."""
    hexes = F.regexp_like(token, F.lit("^<.*>$"))
    body = F.substring(token, F.lit(2), F.length(token) - 2)
    digits = F.length(F.regexp_replace(body, "[^0-9A-Fa-f]", ""))
    literal = F.length(F.regexp_replace(body, r"(?s)\\(?:[0-7]{1,3}|.)", "x"))
    return F.when(hexes, F.floor(digits / F.when(two_byte, 4).otherwise(2))).otherwise(literal).cast("long")


def report_line(columns: Sequence[tuple[str, int, bool]]) -> Column:
    """A line of a fixed-width report: name, width and whether it stands to the right."""
    return F.concat(F.lit("  "), *(F.lpad(F.col(c), n, " ") if right else F.rpad(F.col(c), n, " ") for c, n, right in columns))
