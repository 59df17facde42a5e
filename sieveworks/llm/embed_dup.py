"""Near-duplicate vectors by int8 tile products.

Equal vectors are one class with a count, so copies are not compared with each other. Classes are dealt
to pivots (fitted on a bounded sample; as many as there are tiles, up to a bound) and, per pivot, to tiles
of bounded size. A pivot's cone is as wide as its furthest member. A vector whose angle to a pivot exceeds
that by more than the threshold's angle cannot have a link there, so it is not sent to that pivot's
tiles; it meets all others. How many those are is the data's: few for clustered vectors, most of them
for vectors that point anywhere. Vectors travel in the precision they are given in.

In a pair of tiles, unit vectors u are quantised to u = s q + e with int8 q. Products of q are exact
integers, and

    |u.w - s_u s_w q_u.q_w| <= |s_u q_u| |e_w| + |e_u| |w|

bounds the error of each pair from two norms per vector. Pairs that may reach the threshold by that bound
are computed again in double precision; only those decide. A task emits the number of links of each
vector and a spanning forest, so a group of n similar vectors costs about n rows and not n * n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .components import components
from .store import stage
from .words import mix64

_TILE = 1024
_SAMPLE, _PIVOTS, _MOST_PIVOTS = 8192, 48, 1024


def clean_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (array<double>), usable: not null, finite in every component and not all zero."""
    v = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.coalesce(usable, F.lit(False)).alias("usable"))


def fit_pivots(classes: DataFrame, sample: int = _SAMPLE, pivots: int = _PIVOTS, seed: int = 3) -> dict[int, np.ndarray]:
    """By dimension: unit pivots from a few rounds of spherical k-means over at most ``sample`` classes."""
    rows = classes.orderBy(F.xxhash64(F.lit(seed), "rep"), "rep").limit(sample).select("v").toPandas()
    found = {}
    for dim, group in rows.groupby(rows.v.map(len)):
        x = np.array(group.v.tolist(), dtype=float)
        x = x / np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        rng = np.random.default_rng(seed)
        centres = x[rng.permutation(len(x))[:pivots]]
        for _ in range(8):
            near = (x @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            norm = np.linalg.norm(sums, axis=1)
            centres = np.where(norm[:, None] > 1e-9, sums / np.maximum(norm, 1e-9)[:, None], centres)
        found[int(dim)] = centres
    return found


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit rows; scaled by the largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """q (as float32, for exact products), scale, norm of s q, norm of the error."""
    scale = np.abs(u).max(1) / 127
    q = np.rint(u / scale[:, None])
    back = q * scale[:, None]
    return q.astype(np.float32 if u.shape[1] <= 1024 else np.float64), scale, np.linalg.norm(back, axis=1), np.linalg.norm(u - back, axis=1)


def tile_links(a: np.ndarray, b: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of linked pairs between tiles, or within one tile (i < j) if b is None."""
    ua = _unit(a)
    ub = ua if b is None else _unit(b)
    qa, sa, na, ea = _quantised(ua)
    qb, sb, _, eb = (qa, sa, na, ea) if b is None else _quantised(ub)
    near = (qa @ qb.T).astype(np.float64) * sa[:, None] * sb[None, :]
    maybe = near + (na[:, None] * eb[None, :] + ea[:, None] * (1 + 1e-12) + 1e-9) >= threshold
    if b is None:
        maybe = np.triu(maybe, 1)
    i, j = np.nonzero(maybe)
    keep = [np.einsum("kd,kd->k", ua[i[lo : lo + 50_000]], ub[j[lo : lo + 50_000]]) >= threshold for lo in range(0, len(i), 50_000)]
    keep = np.concatenate(keep) if keep else np.zeros(0, dtype=bool)
    return i[keep], j[keep]


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of links between nodes 0..n-1, by hooking smaller labels until nothing moves."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[label]
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    return [(k, r) for k, r in enumerate(label.tolist()) if k != r]


def _angles(u: np.ndarray, pivots: np.ndarray | None) -> np.ndarray:
    return np.zeros((len(u), 1)) if pivots is None else np.arccos(np.clip(u @ pivots.T, -1, 1))


def _deal(pivots: dict[int, np.ndarray], kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, group in pdf.groupby(pdf.v.map(len)):
                x = np.array(group.v.tolist(), dtype=float)
                angle = _angles(_unit(x), pivots.get(int(dim)))
                yield pd.DataFrame({"rep": group.rep, "n": group.n, "dim": dim, "pivot": angle.argmin(1), "angle": angle.min(1), "v": [r.tobytes() for r in x.astype(kind)]})

    return run


def _send(pivots: dict[int, np.ndarray], cones: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], reach: float, kind: str):
    """Adds tile, and mates, the tiles whose members a vector may link with. ``cones``: by dimension, each pivot's
    widest angle, number of tiles and first tile."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, group in pdf.groupby("dim"):
                wide, tiles, first = cones[int(dim)]
                x = np.frombuffer(b"".join(group.v), dtype=kind).reshape(len(group), int(dim)).astype(float)
                near = (_angles(_unit(x), pivots.get(int(dim))) <= wide[None, :] + reach) & (tiles > 0)[None, :]
                pivot = group["pivot"].to_numpy()
                own = first[pivot] + (mix64(group.rep.to_numpy().view(np.uint64)) % tiles[pivot].astype(np.uint64)).astype(np.int64)
                of_pivot = np.repeat(np.arange(len(tiles)), tiles)
                yield pd.DataFrame({"dim": dim, "tile": own, "mates": [np.flatnonzero(row).astype(np.int32) for row in near[:, of_pivot]], "rep": group.rep, "n": group.n, "v": group.v})

    return run


def _compare(threshold: float, kind: str):
    """Rows sorted by (dim, ta, tb). Emits rep, links, other: links counts a vector's links in this pair of
    tiles; other, where it is not null, is a link of the forest."""

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        side = (group.tile != key[1]).to_numpy() if key[1] != key[2] else np.zeros(len(group), dtype=bool)
        x = np.frombuffer(b"".join(group.v), dtype=kind).reshape(len(group), key[0]).astype(float)
        rep, n = group.rep.to_numpy(), group.n.to_numpy()
        if key[1] == key[2]:
            i, j = tile_links(x, None, threshold)
        else:
            left, right = np.flatnonzero(~side), np.flatnonzero(side)
            if not len(left) or not len(right):
                return pd.DataFrame({"rep": [], "links": [], "other": []})
            i, j = tile_links(x[left], x[right], threshold)
            i, j = left[i], right[j]
        count = np.bincount(i, n[j], len(x)) + np.bincount(j, n[i], len(x))
        some = np.flatnonzero(count)
        tree = _forest(i, j, len(x))
        return pd.DataFrame({
            "rep": np.concatenate([rep[some], rep[[k for k, _ in tree]]]) if len(some) else [],
            "links": np.concatenate([count[some], np.zeros(len(tree))]) if len(some) else [],
            "other": pd.array([None] * len(some) + [int(rep[r]) for _, r in tree], dtype="Int64"),
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        key = None
        for pdf in batches:
            for k, group in pdf.groupby(["dim", "ta", "tb"], sort=False):
                if key is not None and k != key:
                    out = one(key, pd.concat(held))
                    if len(out):
                        yield out.astype({"rep": "int64", "links": "int64"})
                    held = []
                key = k
                held.append(group)
        if held:
            out = one(key, pd.concat(held))
            if len(out):
                yield out.astype({"rep": "int64", "links": "int64"})

    return run


def near_duplicates(embeddings: DataFrame, threshold: float = 0.95, tile: int = _TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Of equal vectors the smallest vec_id stands for all. Vectors that are null, zero or hold null or non-finite components, and vectors of other lengths, link
    with nothing. Rows that repeat a vec_id are vectors of their own in counts and one node in
    components. Rows with a null vec_id are left out. An empty table gives an empty result. Columns
    other than vec_id and embedding are not read.
    """
    spark = embeddings.sparkSession
    rows = clean_vectors(embeddings).filter("vec_id is not null")
    classes = stage(rows.filter("usable").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "vectors")
    kind = "<f4" if isinstance(embeddings.schema["embedding"].dataType.elementType, FloatType) else "<f8"
    pivots = fit_pivots(classes, pivots=min(_MOST_PIVOTS, max(_PIVOTS, classes.count() // tile)))
    dealt = stage(classes.mapInPandas(_deal(pivots, kind), "rep long, n long, dim int, pivot int, angle double, v binary"), "dealt")

    # At most (dimensions) x 1,024 rows: how many classes a pivot has, and how wide its cone is.
    counted = dealt.groupBy("dim", "pivot").agg(F.count(F.lit(1)).alias("m"), F.max("angle").alias("angle")).toPandas()
    cones = {}
    for dim, own in counted.groupby("dim"):
        size = len(pivots[int(dim)]) if int(dim) in pivots else 1
        wide, tiles = np.zeros(size), np.zeros(size, dtype=np.int64)
        wide[own["pivot"]], tiles[own["pivot"]] = own["angle"], np.ceil(own["m"] / tile)
        cones[int(dim)] = (wide, tiles, np.cumsum(tiles) - tiles)
    sent = dealt.mapInPandas(_send(pivots, cones, float(np.arccos(threshold)) + 1e-6, kind), "dim int, tile int, mates array<int>, rep long, n long, v binary")
    met = sent.withColumn("mate", F.explode("mates"))
    met = met.select("dim", F.least("tile", "mate").alias("ta"), F.greatest("tile", "mate").alias("tb"), "tile", "rep", "n", "v").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "dim", "ta", "tb")
    found = stage(met.sortWithinPartitions("dim", "ta", "tb").mapInPandas(_compare(threshold, kind), "rep long, links long, other long"), "vector-links")

    comp = components(found.filter("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = classes.select("v", "rep", "n").join(counts, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    labels = stage(labels.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "vector-labels")
    out = rows.select("vec_id", F.when(F.col("usable"), F.col("v")).alias("v")).join(labels, "v", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
