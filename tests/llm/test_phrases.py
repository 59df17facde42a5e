"""Collocations against brute force and against their SQL."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from sieveworks.llm import phrases


def brute(rows, longest=4, support=30, percent=80, most=2000):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang in f:
        cand = {p: a for p, a in f[lang].items() if len(p) > 1 and a >= support}
        inside = defaultdict(int)
        for p, a in cand.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i : i + size]] = max(inside[p[i : i + size]], a)
        scored = []
        for p, a in cand.items():
            if 100 * inside[p] >= percent * a and p in inside:
                continue
            score, k = min((2000000 * a // (f[lang][p[:k]] + f[lang][p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[lang][p[:k]], f[lang][p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out)


def corpus(seed=0, n=160):
    rng = random.Random(seed)
    words = ["New", "york", "city", "Hall", "é", "ÀB", "a", "b", "the", "x y", "1,000", " "]
    texts = [(None, "en"), ("", "en"), (" \t\n", None), ("a b", None), ("A" * 3000 + " b", "de"), ("a b " * 4000, "fr")]
    for k in range(n):
        own = []
        for _ in range(rng.randrange(1, 60)):
            own += ["new", "York", "city"] if rng.random() < 0.1 else [rng.choice(words)]
        seps = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\x0b", "\x0c", "\r\n", "!?"]
        texts.append(("".join(w + rng.choice(seps) for w in own), rng.choice(["en", "en", "de", None, "und", "x y"])))
    return texts + texts[:20]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, lang, "s", 1, 1, "c", 1.5) for k, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string, cnt long, f long, phrase string, w double")


@pytest.mark.parametrize("options", [{}, {"part_bytes": 200, "bits": 16}])
def test_collocations_are_those_of_brute_force(spark, options):
    rows = corpus()
    got = sorted(tuple(r) for r in phrases.collocations(frame(spark, rows), **options).collect())
    assert got == brute(rows) and {r[0] for r in got} == {"de", "en", "fr", "und", "x y"}


def test_other_parameters(spark):
    rows = corpus(3, 60)
    got = phrases.collocations(frame(spark, rows), longest=3, support=4, percent=50, most=25).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 3, 4, 50, 25)
    got = phrases.collocations(frame(spark, rows), longest=2, support=2).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 2, 2)


def test_empty_and_frequent_only(spark):
    assert phrases.collocations(frame(spark, [])).collect() == []
    assert phrases.collocations(frame(spark, [("a. " * 50, "en"), (None, None)])).collect() == []
    with pytest.raises(ValueError):
        phrases.collocations(frame(spark, []), support=300)


def test_sql_says_the_same(spark):
    rows = corpus(7, 90)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(phrases.collocations_sql()).fetchall()) == brute(rows)


def test_buckets_only_prune_and_stay_bounded(spark):
    assert phrases.bucket_bits(0, 30) == 16 and phrases.bucket_bits(10**15, 30) == 27
    rows = corpus(2, 40)
    one = phrases._Words([t.encode().translate(phrases._FOLD) for t, _ in rows if t], [lang or "und" for t, lang in rows if t])
    assert len(one.hash) == len(one.ids) and one.whole(2).sum() < one.whole(1).sum()
