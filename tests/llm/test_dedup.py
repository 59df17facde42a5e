"""Substring dedup, near duplicates, embeddings and components, each against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from sieveworks.llm import components, embed_dup, near_dup, substring

DOC = "doc_id long, text string, text2 string, n long, value long, rep long"


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "clash", 1, 2, 3) for k, t in texts], DOC)


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["Ünï", "ß,", "x y"]
    passage = [rng.choice(words) for _ in range(45)]
    base = [rng.choice(words) for _ in range(90)]
    texts = [(0, None), (1, ""), (2, " \t\n "), (3, "one two"), (4, "ONE  two"), (5, "x")]
    for k in range(6, n):
        kind = rng.randrange(5)
        own = [rng.choice(words) for _ in range(rng.randrange(5, 120))]
        if kind == 0:
            at = rng.randrange(len(own))
            own[at:at] = passage[rng.randrange(10) :]
        elif kind == 1:
            own = list(base)
            for _ in range(rng.randrange(8)):
                own[rng.randrange(len(own))] = rng.choice(words)
        elif kind == 2:
            own = own + own
        texts.append((k, rng.choice([" ", "\n", "  "]).join(own)))
    return texts + [(k + n, t) for k, t in texts[:20]]


def removed(texts, length=20):
    seen, out = set(), {}
    for doc, text in sorted(texts, key=lambda x: x[0]):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - length + 1):
            w = tuple(words[k : k + length])
            if w in seen:
                gone[k : k + length] = [True] * length
            seen.add(w)
        kept = [w for w, g in zip(words, gone) if not g]
        out[doc] = (len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("options", [{}, {"group": 40, "anchor": 3, "chunk_bytes": 400}])
def test_substring_dedup_is_brute_force(spark, options):
    texts = corpus(1)
    got = substring.digests(substring.substring_dedup(frame(spark, texts), **options)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == removed(texts)


def test_substring_dedup_long_text_repeats_and_empty_table(spark):
    long = " ".join(f"v{k % 5000}" for k in range(150_000)) + " " + "y" * 1_500_000
    texts = [(2, long), (1, "a b c"), (7, long)]
    got = substring.digests(substring.substring_dedup(frame(spark, texts))).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == removed(texts)
    for parts in (1, 2):  # rows that repeat a doc_id meet in one batch, or in two
        twice = substring.substring_dedup(frame(spark, [(1, long), (1, long)]).repartition(parts)).collect()
        assert len(twice) == 2 and twice[0].n_removed == twice[1].n_removed == removed([(1, long)])[1][1]
        once = " ".join(f"u{k}" for k in range(30))
        twice = substring.substring_dedup(frame(spark, [(1, once), (1, once)]).repartition(parts)).collect()
        assert [(r.n_words, r.n_removed) for r in twice] == [(30, 0)] * 2
    assert substring.substring_dedup(frame(spark, [])).collect() == []


def test_a_hot_passage_in_many_batches_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(substring, "_BATCH_BYTES", 2_000)
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(70))
    texts = [(k, " ".join(f"w{rng.randrange(10_000)}" for _ in range(40)) + (f" {passage}" if k % 3 else "") + f" z{k}") for k in range(400)]
    got = substring.digests(substring.substring_dedup(frame(spark, texts), group=60, chunk_bytes=300)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == removed(texts)


@pytest.mark.parametrize("parts", [1, 3])
def test_texts_that_repeat_themselves_and_large_ids(spark, parts):
    rng = random.Random(11)
    texts = [(2**60 + k, " ".join([f"p{j}" for j in range(k % 9 + 1)] * (50 // (k % 9 + 1) + k))) for k in range(40)]
    texts += [(2**60 + 100 + k, " ".join(rng.choice("ab") for _ in range(rng.randrange(15, 90)))) for k in range(60)]
    got = substring.digests(substring.substring_dedup(frame(spark, texts).repartition(parts))).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == removed(texts)


def test_prefixes_are_longer_where_suffixes_are_many():
    counts = np.array([10, 5_000, 0, 90])
    plan = substring.Prefixes.plan(counts, 100, 7)
    assert plan.depth.tolist() == [2, 2 + 6, 2, 2]
    path = np.random.default_rng(0).integers(0, 2**64, 4_000, dtype=np.uint64)
    group, part = plan.of(path)
    for k in range(0, 4_000, 37):
        depth = int(plan.depth[int(path[k] >> np.uint64(62))])
        assert int(group[k]) & (2**64 - 1) == int(path[k]) >> (64 - depth) << (64 - depth)
    order = np.argsort(path)
    assert part.min() >= 0 and part.max() == 6 and (np.diff(part[order]) >= 0).all()
    assert all(len(set(part[group == g])) == 1 for g in set(group.tolist()))


def test_equal_hashes_do_not_make_windows_equal():
    codes = np.array([0, 1, 2, 0, 1, 3, 0, 1, 2])
    members, node = substring.deep_nodes(codes, np.array([0, 3, 6]), np.zeros(9, dtype=np.uint64), 3)
    assert sorted(members.tolist()) == [0, 2] and len(set(node.tolist())) == 1


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(ids, linked):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def expected(texts):
    sets = {d: shingles(t) for d, t in texts}
    ids = sorted(sets)
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    g = groups(ids, linked)
    return {d: (len(sets[d]), g[d], g[d] == d) for d in ids}


@pytest.mark.parametrize("short,block", [(48, 384), (2, 3), (1, 1)])
def test_near_duplicates_are_brute_force(spark, monkeypatch, short, block):
    monkeypatch.setattr(near_dup, "_SHORT_LIST", short)
    monkeypatch.setattr(near_dup, "_BLOCK", block)
    texts = corpus(2, 80)
    got = near_dup.near_duplicates(frame(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == expected(texts)


def test_near_duplicates_of_odd_tables(spark):
    assert near_dup.near_duplicates(frame(spark, [])).collect() == []
    got = near_dup.near_duplicates(frame(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A b c d e f"), (None, "a b c d e f")])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(3, 3, True), (5, 3, False), (5, 3, False)]
    kept = near_dup.keep_one_of_each(frame(spark, [(5, "a b c d e f"), (3, "A b c d e f"), (9, None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 9] and kept.columns[1] == "text"


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 30)] + [(100, k) for k in range(101, 140)] + [(5, 5), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(31)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_embeddings_are_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    near = base[rng.integers(0, 30, 150)] + rng.normal(scale=0.09, size=(150, 16))
    x = [v.tolist() for v in np.concatenate([base, near, near[:40], near[:10] * 3.5])]
    x += [None, [0.0] * 16, [float("nan")] * 16, [1.0, None] + [0.0] * 14, [1e300] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], []]
    frame = spark.createDataFrame([(k, v, 0, 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int, n long")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dup.near_duplicates(frame, tile=32).collect()}

    def ok(v):
        return v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)

    unit = {k: np.array(v) / np.abs(v).max() for k, v in enumerate(x) if ok(v)}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    linked = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    g = groups(range(len(x)), linked)
    n = {k: sum(k in p for p in linked) for k in g}
    assert got == {k: (n[k], g[k], g[k] == k) for k in g}
    assert embed_dup.near_duplicates(frame.limit(0)).collect() == []


def test_repeated_and_missing_vector_ids(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [-4.0, 3.0, -2.0, 1.0]
    rows = [(1, a), (1, a), (1, b), (2, b), (None, a), (3, None), (3, [0.0] * 4)]
    frame = spark.createDataFrame([(k, [float(np.float32(c)) for c in v] if v else None) for k, v in rows], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dup.near_duplicates(frame).collect())
    # Rows of one vec_id are vectors of their own in counts, and one node in components.
    assert [x[:2] for x in got] == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 0), (3, 0)]
    assert all(x[2] == 1 for x in got[:4]) and all(x[2] == 3 for x in got[4:])


def test_a_very_long_text_has_its_copy(spark):
    long = " ".join(f"v{k}" for k in range(200_000))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(frame(spark, [(4, long), (2, long + " end"), (3, "y" * 1_000_000)])).collect()}
    assert got == {4: (199_996, 2), 2: (199_997, 2), 3: (1, 3)}


def test_workers_are_given_few_whole_texts_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "shingle_sets", lambda texts: (np.arange(len(texts)) for _ in texts))  # a set as large as the batch
    docs = spark.range(1_500).selectExpr("id AS doc_id", "concat('text ', id) AS text").coalesce(1)
    assert near_dup.near_duplicates(docs).agg({"n_shingles": "max"}).first()[0] <= 256


def test_quantisation_bound_holds():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(200, 48)) * rng.lognormal(size=(200, 1))
    u = embed_dup._unit(a)
    q, s, back, err = embed_dup._quantised(u)
    near = (q @ q.T).astype(float) * s[:, None] * s[None, :]
    assert (np.abs(near - u @ u.T) <= back[:, None] * err[None, :] + err[:, None] + 1e-9).all()
