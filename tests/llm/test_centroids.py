"""Centroid clustering against brute force in Python integers."""

from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from sieveworks.llm import centroids


def brute(rows, k=8, rounds=10, dim=64, scale=1024):
    kept = [(i, [math.floor(Fraction(c) * scale) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    centres = [x for _, x in order[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    for r in range(rounds + 1):
        near = [min(range(len(centres)), key=lambda c: (far(x, centres[c]), c)) for _, x in kept]
        if r < rounds:
            for c in range(len(centres)):
                own = [x for (_, x), n in zip(kept, near) if n == c]
                if own:
                    centres[c] = [sum(col) // len(own) for col in zip(*own)]
    d = [far(x, centres[c]) for (_, x), c in zip(kept, near)]
    each = {c: sum(v for v, n in zip(d, near) if n == c) for c in set(near)}
    long = lambda v: v if v < 1 << 63 else None
    whole = lambda part: long(sum(part)) if all(v < 1 << 63 for v in part) else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, long(v), whole([w for w, n in zip(d, near) if n == c]), whole(d), digest[c]) for (i, _), c, v in zip(kept, near, d)), key=repr) if each else []


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows], "vec_id long, embedding array<double>, cluster int, block string, n double")
    return sorted((tuple(r)[:6] for r in centroids.cluster(frame, **options).collect()), key=repr)


def test_clusters_are_those_of_brute_force(spark):
    rng = random.Random(5)
    at = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.4) for c in at[i % 5]]) for i in range(240)]
    rows += [(500 + i, list(rows[3][1])) for i in range(60)] + [(7, rows[9][1]), (7, rows[10][1]), (None, rows[11][1])]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [None] + [1.0] * 63), (904, [math.nan] + [0.0] * 63), (905, [math.inf] + [0.0] * 63), (906, [0.0] * 64), (907, [-0.0005] * 64)]
    got = run(spark, rows)
    assert got == brute(rows) and len(got) == 305


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5] * 64), (2, [0.5] * 64)], [(k, [float(k % 3 - 1)] * 64) for k in range(40)], [(k, [(-1) ** k * 10.0 ** (k * 7 % 300)] * 64) for k in range(30)]])
def test_few_equal_and_wide_vectors(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_other_sizes(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 0.25, 1.0]) for _ in range(3)]) for i in range(90)]
    assert run(spark, rows, k=1, rounds=2, dim=3) == brute(rows, 1, 2, 3)
    assert run(spark, rows, k=20, rounds=3, dim=3) == brute(rows, 20, 3, 3)


def test_bounds_skip_scans_and_never_change_a_cluster():
    rng = np.random.default_rng(0)
    at = rng.integers(-900, 900, (8, 64))
    x = (at[rng.integers(0, 8, 4000)] + rng.integers(-60, 60, (4000, 64))).astype(np.int64)
    centres = [list(map(int, c)) for c in at]
    near, upper, lower = centroids.scan(x, centres)
    for step in range(6):
        new = [[v + int(d) for v, d in zip(c, rng.integers(-8, 9, 64) // (step + 1))] for c in centres]
        drift, half = centroids._geometry(centres, new)
        scanned = centroids.reassign(x, near, upper, lower, new, drift, half)
        want = np.stack([((x - np.array(c)) ** 2).sum(1) for c in new])
        assert (near == want.argmin(0)).all() and scanned.mean() < 0.05
        assert (upper**2 >= want.min(0)).all() and (lower**2 * np.sign(lower) <= np.sort(want, 0)[1]).all()
        centres = new
