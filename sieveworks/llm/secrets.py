"""Secret scans: patterns, and sliding-window entropy over candidate strings.

Everything is DataFrame expressions over one text at a time; nothing is shuffled.

Spans. The matches of a pattern and the gaps between them (from split by the same pattern) alternate, so
running sums of their lengths give positions in code points.

Entropy. Candidates are runs of letters, digits and ``+/_=-`` of 16 characters or more. Over each, a
window of 20 characters (of the whole run if it is shorter) slides with counts of its characters; when one character
enters and one leaves, only their two terms c * log2(c) change. A window is suspicious if its entropy reaches the
limit of the run's character class, in bits; runs of fewer than 20 characters have limits of their own:

    class                                              20 or more    fewer
    hex: 0-9a-f or 0-9A-F, letters and digits          3.0           3.0
    lower, upper case and digits                       3.6           3.75
    the same with one of + / _ - =                     3.7           -
    upper case and digits                              3.6           3.75
    lower case and digits                              3.9           3.9
    lower and upper case                               4.1           -

Other runs are words, paths and names. A window that holds an allowed stretch is suppressed, not the run: a word for
examples that has no letter beside it, or a run of the alphabet or of digits. UUIDs are suppressed whole. Suspicious
windows of a candidate make one span, from the first to the last, unless it meets a pattern's span.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = rf"""({"|".join(_any_case(w) for w in ("password", "passwd", "secret", "token"))}|{_any_case("api")}_?{_any_case("key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # the same spans as [0-9a-f]+ of 16 or more: a run is matched whole or not at all
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: Words that stand in examples, and stretches that are no secret; UUIDs.
EXAMPLES = r"(?i)[^a-z](?:example|sample|dummy|placeholder|changeme|your)[^a-z]"
STRETCHES = r"(?i)xxxx|0123456789|123456789|abcdefgh"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
SHORTEST = 16


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<start, kind, end, body>> of all matches, leftmost and not overlapping."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,body:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        end = start + F.length(x["m"])
        row = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("body"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    folded = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.regexp_like(text, F.lit(pattern)), folded).otherwise(empty)


def _class_limit(body: Column) -> Column:
    """The limit of a candidate's class; null for runs that are no candidates."""
    lower, upper, digit = (F.regexp_like(body, F.lit(p)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
    hexes = F.regexp_like(body, F.lit("^([0-9a-f]+|[0-9A-F]+)$")) & digit & (lower | upper)
    marks, long = F.regexp_like(body, F.lit("[+/_=-]")), F.length(body) >= WINDOW
    return (
        F.when(hexes, 3.0).when(lower & upper & digit & marks, F.when(long, 3.7)).when(marks, F.lit(None).cast("double")).when(lower & upper & digit, F.when(long, 3.6).otherwise(3.75))
        .when(upper & digit, F.when(long, 3.6).otherwise(3.75)).when(lower & digit, 3.9).when(lower & upper, F.when(long, 4.1))
    )


def window_entropy_span(body: Column, limit: Column) -> Column:
    """struct<first, last>: first character of the first window at or above the limit that holds no allowed stretch,
    end (exclusive) of the last; null if there is none. Positions count from 0."""
    width = F.least(F.lit(WINDOW), F.length(body))
    most = F.element_at(F.array(*(F.lit(math.log2(n)) for n in range(SHORTEST, WINDOW + 1))), width - (SHORTEST - 1))
    around = F.concat(F.lit(" "), body, F.lit(" "))
    terms = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)))
    start = F.struct(F.array_repeat(F.lit(0), 128).alias("n"), F.lit(0.0).alias("s"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def term(counts: Column, code: Column, delta: int) -> Column:
        now = F.element_at(counts, code + 1)
        return F.element_at(terms, now + delta + 1) - F.element_at(terms, now + 1)

    def bump(counts: Column, code: Column, delta: int) -> Column:
        return F.concat(F.slice(counts, F.lit(1), code), F.array(F.element_at(counts, code + 1) + delta), F.slice(counts, code + 2, F.lit(128)))

    def step(acc: Column, i: Column) -> Column:
        out, into = F.ascii(F.substring(body, i - width, F.lit(1))), F.ascii(F.substring(body, i, F.lit(1)))
        full = i > width
        left = F.when(full, bump(acc["n"], out, -1)).otherwise(acc["n"])
        s = acc["s"] + F.when(full, term(acc["n"], out, -1)).otherwise(F.lit(0.0)) + term(left, into, 1)
        allowed = F.regexp_like(F.substring(around, i - width + 1, width + 2), F.lit(EXAMPLES)) | F.regexp_like(F.substring(body, i - width + 1, width), F.lit(STRETCHES))
        high = F.when((i >= width) & (most - s / width >= limit), ~allowed).otherwise(False)
        return F.struct(
            bump(left, into, 1).alias("n"), s.alias("s"),
            F.when(high & (acc["first"] < 0), i - width).otherwise(acc["first"]).alias("first"), F.when(high, i).otherwise(acc["last"]).alias("last"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.length(body)), start, step, lambda acc: F.when(acc["first"] >= 0, F.struct(acc["first"].alias("first"), acc["last"].alias("last"))))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: arrays of struct<start, kind, end> (kind as a place in KINDS) in order of
    start, then kind. base holds the patterns' spans, spans also those found by entropy.

    A null text is empty and has no spans; a very long one is scanned whole. An empty table gives an empty
    result. Each row is scanned on its own, so ties, repeated rows and rows
    with a null doc_id give their own results. Only doc_id and text are read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    rows = rows.withColumns({
        "assign": F.filter(_spans(text, ASSIGN, 0), lambda x: F.length(F.regexp_extract(x["body"], ASSIGN, 2)) >= 12),
        "access": F.filter(_spans(text, ACCESS, 1), lambda x: F.length(x["body"]) >= 18),
        "hex": _spans(text, HEX, 2),
        "cand": F.filter(_spans(text, CANDIDATE, 3), lambda x: _class_limit(x["body"]).isNotNull() & ~F.regexp_like(x["body"], F.lit(UUID))),
    })
    plain = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    rows = rows.withColumn("base", F.array_sort(F.concat(plain("assign"), plain("access"), plain("hex"))))

    def judged(x: Column) -> Column:
        hit = window_entropy_span(x["body"], _class_limit(x["body"]))
        return F.struct((x["start"] + hit["first"]).alias("start"), x["kind"].alias("kind"), (x["start"] + hit["last"]).alias("end"))

    high = F.filter(F.transform("cand", judged), lambda x: x["start"].isNotNull())
    new = F.filter(high, lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    rows = rows.withColumn("added", F.when(F.size("cand") > 0, new).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>")))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", "added")).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    one = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def digests(found: DataFrame) -> DataFrame:
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
