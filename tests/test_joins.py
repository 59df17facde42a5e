"""Rules, markers, scopes, blocks, orders and sessions against brute force, with hostile inputs."""

from __future__ import annotations

import datetime
import random
import re
from zoneinfo import ZoneInfo

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sieveworks.functions import automata, calendars
from sieveworks.operators import blocks, intervals, markers, ordering, prefix_rules, robots, scopes


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_ten_thousand_rules_meet_paths_by_equality(spark, most):
    rng = random.Random(3)
    part = lambda: "/" + "".join(rng.choice("abé") for _ in range(rng.randrange(1, 4)))
    rules = [("h%d" % (k % 3), rng.choice(["allow", "disallow"]), "".join(part() for _ in range(rng.randrange(1, 5)))[: rng.randrange(1, 20)], k) for k in range(10_000)]
    rules += [("h0", "allow", "", 10_001), ("h0", "allow", None, 10_002), (None, "allow", "/", 10_003)]
    paths = [(k, "h0" if k % 2 else f"h{k % 4}", "".join(part() for _ in range(rng.randrange(0, 7)))) for k in range(300)] + [(900, None, "/a"), (901, "h0", None), (902, "h1", "")]
    r = spark.createDataFrame(rules, "host string, kind string, rule string, pos long")
    p = spark.createDataFrame(paths, "id long, host string, path string")
    found = prefix_rules.matches(p, r, "id", most)
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    fits = {i: [x for x in rules if h is not None and x[0] == h and x[2] and path is not None and path.startswith(x[2])] for i, h, path in paths}
    assert sorted((x.id, x.pos) for x in found.collect()) == sorted((i, x[3]) for i, own in fits.items() for x in own)
    for tie, rank in (("allow", lambda x: (-len(x[2]), x[1] != "allow", x[3])), ("file_order", lambda x: (-len(x[2]), x[3]))):
        got = {x.id: x.pos for x in prefix_rules.longest(p, r, "id", tie, most).collect()}
        assert got == {i: min(own, key=rank)[3] for i, own in fits.items() if own}
    assert {x.id: x.allowed for x in prefix_rules.allowed(p, r, "id", most=most).collect()}[901] is True


def test_rules_of_a_file_are_those_of_the_agent(spark):
    text = "User-agent: *\nUser-agent: x\nDisallow: /a$ # end\nAllow:\nSitemap: s\nUser-agent: Y\nDisallow: /\n\nUSER-AGENT: *\nAllow: /a/b"
    rows = robots.rules_of(spark.createDataFrame([("h", text), ("i", None), ("j", "")], "id string, robots string")).collect()
    assert sorted((r.host, r.kind, r.rule, r.value) for r in rows) == [("h", "allow", "/a/b", "/a/b"), ("h", "disallow", "/a", "/a$")]


@pytest.mark.parametrize("most", [16 << 20, 9_000])
def test_five_thousand_markers_in_one_pass(spark, most):
    rng = random.Random(1)
    marks = ["".join(rng.choice("abcdÄé .") for _ in range(rng.randrange(1, 9))) for _ in range(5_000)] + ["", None, "ABC", "İx"]
    texts = [(k, "".join(rng.choice("abcdABÄé .xİ") for _ in range(rng.randrange(0, 200)))) for k in range(60)] + [(100, None), (101, ""), (102, "a" * 200_000)]
    m = spark.createDataFrame([(x,) for x in marks], "marker string")
    t = spark.createDataFrame(texts, "id long, body string")
    got = sorted(tuple(r) for r in markers.matching(t, "id", "body", m, most_bytes=most).collect())
    want = t.join(m.select(F.lower("marker").alias("marker")).filter("marker <> ''").distinct(), F.contains(F.lower("body"), F.col("marker"))).select("id", "marker")
    assert got == sorted(tuple(r) for r in want.collect()) and len(got) > 1_000


def test_scopes_are_those_of_a_stack(spark):
    rng = random.Random(5)
    tokens = ["<div class='a b'>", "<div>", "</div>", "<p id=x>", "<p class=a>", "</p>", "<span class='b c'>", "</span>", "<br>", "<img class=a/>", "</br>", "t&amp;", "<!-- <p> -->", "<script>var s='</div><p>';</script>", "<ul><li>", "</ul>", "<li"]
    pages = [(k, "".join(rng.choice(tokens) for _ in range(rng.randrange(1, 80)))) for k in range(80)] + [(200, "<div>" * 3_000 + "<p class=a>" + "</p>" * 5), (201, None), (202, "no tag")]
    wanted = {"s1": "div p", "s2": ".a .b", "s3": "div.a span.c", "s4": "div div p.a", "s5": "#x span", "s6": "p", "s7": "div > p", "s8": "ul li li"}
    df = spark.createDataFrame(pages, "id long, html string")
    got = {r.id: r for r in scopes.counts(scopes.elements(df, "id", "html"), "id", wanted).collect()}
    for i, html in pages:
        for name, selector in wanted.items():
            hits = automata._selector_count(pd.Series([html]), pd.Series([selector])).iloc[0]
            hits = None if pd.isna(hits) else int(hits)
            assert (got[i][name] if i in got else (None if hits is None else 0)) == hits, (i, name, html)
    deep = scopes.elements(df, "id", "html").filter("id = 200").agg(F.max("depth"), F.count_if("closed")).first()
    assert tuple(deep) == (3_001, 1)


def gaps(lines, least=2):
    width = max(map(len, lines))
    blank = [all(len(x) <= k or x[k] == " " for x in lines) for k in range(width)]
    return [(m.start(), m.end(), width) for m in re.finditer("1{%d,}" % least, "".join("1" if b else "0" for b in blank))]


def test_blank_runs_of_blocks_of_differing_width(spark):
    rng = random.Random(8)
    texts = [(-1, None), (-2, ""), (-3, "\n\n"), (-4, "a  b\nc  d"), (-5, "x  y\r\nz  w\rv  u\f" + "q\n" * 3)]
    for k in range(40):
        lines = []
        for _ in range(rng.randrange(1, 14)):
            cells = [rng.choice(["", "é", "word", "two words", "1,234.50"]) for _ in range(rng.randrange(1, 14))]
            lines.append(rng.choice(["", "  "]) + "".join(c.ljust(14) for c in cells) if rng.random() > 0.15 else rng.choice(["", " \t"]))
        texts.append((k, rng.choice(["\n", "\r\n"]).join(lines)))
    texts.append((99, "\n".join(("a" + " " * 5_000 + "b").ljust(n) for n in (5_002, 5_010, 6_000))))
    df = spark.createDataFrame(texts, "id long, text string")
    want, begun = [], []
    for i, text in texts:
        block, first = [], 0
        for pos, line in enumerate([*re.split("\r\n|\r|\n", (text or "").replace("\f", "\n\n")), ""]):
            if line.strip(" \t\x0b"):
                first = first if block else pos
                block.append(line)
                continue
            if len(block) >= 3:
                begun.append((i, first, len(block)))
                want += [(i, first, *g) for g in gaps(block)]
            block = []
    lines = blocks.text_blocks(blocks.lines_of(df, "id", "text"), "id")
    assert sorted(tuple(r) for r in lines.groupBy("id", "block").count().collect()) == sorted(begun)
    assert sorted(tuple(r) for r in blocks.column_gaps(lines, "id").collect()) == sorted(want) and len(want) > 30


def test_numbers_of_a_large_order(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, 1.0, 2.5, -3.0])) for k in range(5_000)]
    df = spark.createDataFrame(rows, "id long, bucket string, v double")
    found = ordering.numbered(df, "bucket", [F.asc_nulls_last("v"), F.asc("id")])
    plan = plan_of(found)
    assert "SinglePartition" not in plan.split("== Physical Plan ==")[1]
    got = {r.id: r.place for r in found.collect()}
    for b in ("hot", "b", None):
        own = sorted((r for r in rows if r[1] == b), key=lambda r: (r[2] is None, r[2] or 0, r[0]))
        assert [got[r[0]] for r in own] == list(range(1, len(own) + 1))
    assert ordering.numbered(df.filter("false"), "bucket", [F.asc("id")]).collect() == []


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_each_event_has_its_session_or_none(spark, most):
    rng = random.Random(9)
    begin = [datetime.datetime(2024, 3, 8), datetime.datetime(2024, 3, 29), datetime.datetime(2024, 11, 1), datetime.datetime(2024, 4, 5)]
    zones = {m: z for m, z, *_ in calendars.SESSIONS}
    events = [(k, rng.choice([*zones, "XX", None]), rng.choice(begin) + datetime.timedelta(seconds=rng.randrange(5 * 86_400))) for k in range(1_500)]
    events += [(5_000 + k, m, datetime.datetime(2024, 3, 11, 9, 30, tzinfo=ZoneInfo(z)).astimezone(datetime.timezone.utc).replace(tzinfo=None) + datetime.timedelta(minutes=o - 570)) for k, (m, z, o, _) in enumerate(calendars.SESSIONS)] + [(9_000, "US", None)]
    df = spark.createDataFrame(events, "id long, market string, at timestamp")
    got = {r.id: r.session for r in intervals.event_sessions(df, "id", most=most).collect()}
    assert len(got) == len(events)
    for i, market, at in events:
        want = None
        if at is not None and market in zones:
            local = at.replace(tzinfo=datetime.timezone.utc).astimezone(ZoneInfo(zones[market]))
            minute = local.hour * 60 + local.minute
            own = [(o, c) for m, _, o, c in calendars.SESSIONS if m == market]
            want = next((n for n, (o, c) in enumerate(own, 1) if o <= minute < c and local.weekday() < 5), None)
        assert got[i] == want, (i, market, at)
