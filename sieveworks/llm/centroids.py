"""Centroid clustering in exact integers, with Hamerly's bounds.

Vectors are packed once into blocks of 1,024 and written as a table bucketed by block. What changes from round to
round is kept apart, bucketed alike, so the two meet without an exchange: of each vector its cluster, an upper bound
of the distance to its centroid and a lower bound of the distance to the second nearest. After a round the upper
bound grows by the drift of the own centroid, the lower one shrinks by the largest drift of the others. A vector
whose upper bound lies strictly below its lower bound, or below half the distance from its centroid to the nearest
other one, keeps its cluster; the others are ambiguous and are compared with all centroids in integers, ties to the
smaller number. Bounds are rounded outwards, so they never decide a tie.

Only vectors that change their cluster change sums: a block writes what each cluster wins and loses beside its
bounds, so a task that runs again cannot count twice. The driver holds k centroids and their sums, and reads at most
k rows of each of 32 partial sums a round.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import drop_path, new_path, write_table

_BLOCK, _BUCKET_ROWS, _PARTS = 1024, 1 << 18, 32
_NARROW = 1 << 27
_OUT = 1 + 1e-12
_BLOCKS = "block long, ids array<long>, kind string, x binary"
_BOUNDS = "block long, cluster binary, upper binary, lower binary, moves array<struct<cluster:int,n:long,sums:array<string>>>"
_MOVES = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))]))


def kept_vectors(embeddings: DataFrame, dim: int) -> DataFrame:
    """vec_id, v: vectors of ``dim`` components, none of them null, NaN or infinite."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter((F.size("v") == dim) & ~bad)


def _integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64, or as Python integers where one is too wide for exact 64-bit distances."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not np.size(y) or np.abs(y).max() < _NARROW:
        return y.astype(np.int64)
    exact = [int(b) if abs(b) < 2**62 else int(a) * scale for a, b in zip(x.ravel().tolist(), y.ravel().tolist())]
    return np.array(exact, dtype=object).reshape(x.shape)


def _packed(x: np.ndarray) -> tuple[str, bytes]:
    if x.dtype == object:
        return "text", ",".join(map(str, x.ravel())).encode()
    kind = "<i2" if not x.size or np.abs(x).max() < 1 << 15 else "<i4"
    return kind, x.astype(kind).tobytes()


def _unpacked(kind: str, data: bytes, dim: int) -> np.ndarray:
    if kind == "text":
        return np.array([int(t) for t in data.decode().split(",")], dtype=object).reshape(-1, dim)
    return np.frombuffer(data, dtype=kind).astype(np.int64).reshape(-1, dim)


def _pack(dim: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            values = batch.column("v")
            x = _integers(values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale)
            ids = batch.column("vec_id")
            for at in range(0, len(x), _BLOCK):
                part = x[at : at + _BLOCK]
                kind, data = _packed(part)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids[at : at + _BLOCK].to_pylist()], pa.list_(pa.int64())), pa.array([kind]), pa.array([data], pa.binary())], names=["block", "ids", "kind", "x"])
                number += 1

    return run


def squared(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """Exact squared distances to a centroid; Python integers where 64 bits may not hold them."""
    wide = x.dtype == object or max(map(abs, centre)) >= _NARROW
    gap = x.astype(object) - np.array(centre, dtype=object) if wide else x - np.array(centre, dtype=np.int64)
    return (gap * gap).sum(1)


def _root(d: np.ndarray, up: bool) -> np.ndarray:
    """The square root as float, rounded up or down."""
    r = np.array([_wide_root(v) for v in d]) if d.dtype == object else np.sqrt(d.astype(np.float64))
    return r * _OUT if up else r / _OUT


def _wide_root(v: int) -> float:
    shift = max(0, v.bit_length() - 1000) // 2 * 2
    return float(v >> shift) ** 0.5 * 2.0 ** (shift // 2) * (1 + 1e-14)


def scan(x: np.ndarray, centres: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), upper and second-nearest lower bound of every vector."""
    each = [squared(x, c) for c in centres]
    d = np.stack([e.astype(object) for e in each]) if any(e.dtype == object for e in each) else np.stack(each)
    near = np.argmin(d, axis=0)
    rows = np.arange(len(x))
    upper = _root(d[near, rows], up=True)
    if len(centres) == 1:
        return near, upper, np.full(len(x), np.inf)
    rest = d.copy()
    rest[near, rows] = d.max() + 1 if d.dtype == object else np.iinfo(np.int64).max
    return near, upper, _root(rest.min(0), up=False)


def reassign(x: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray, centres: list[list[int]], drift: list[float], half: list[float]) -> np.ndarray:
    """Loosens the bounds by ``drift``, scans the ambiguous vectors and writes near, upper and lower in place.
    Returns which were scanned."""
    drift, half = np.array(drift), np.array(half)
    if len(drift) > 1:
        first = int(drift.argmax())
        second = float(np.delete(drift, first).max())
        others = np.where(near == first, second, drift[first])
    else:
        others = np.zeros(len(near))
    upper[:] = (upper + drift[near]) * _OUT
    lower[:] = lower - others * _OUT - np.abs(lower) * 1e-12 if len(drift) > 1 else lower
    doubtful = ~(upper < np.maximum(lower, half[near]))
    if doubtful.any():
        near[doubtful], upper[doubtful], lower[doubtful] = scan(x[doubtful], centres)
    return doubtful


def _moves(x: np.ndarray, before: np.ndarray | None, after: np.ndarray, k: int) -> list[dict]:
    """What each cluster wins, less what it loses."""
    found = []
    for c in range(k):
        come = after == c if before is None else (after == c) & (before != c)
        go = np.zeros(len(x), dtype=bool) if before is None else (before == c) & (after != c)
        if come.any() or go.any():
            found.append({"cluster": c, "n": int(come.sum()) - int(go.sum()), "sums": [str(a - b) for a, b in zip(x[come].sum(0).tolist(), x[go].sum(0).tolist())] if go.any() and come.any() else [str(v) for v in (x[come].sum(0) if come.any() else -x[go].sum(0)).tolist()]})
    return found


def _round(dim: int, centres: list[list[int]], drift: list[float] | None, half: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = _unpacked(row["kind"], row["x"], dim)
                if drift is None:
                    before, (near, upper, lower) = None, scan(x, centres)
                else:
                    before = np.frombuffer(row["cluster"], dtype="<i2").astype(np.int64)
                    near, upper, lower = before.copy(), np.frombuffer(row["upper"], dtype="<f8").copy(), np.frombuffer(row["lower"], dtype="<f8").copy()
                    reassign(x, near, upper, lower, centres, drift, half)
                data = [near.astype("<i2").tobytes(), upper.astype("<f8").tobytes(), lower.astype("<f8").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), *[pa.array([d], pa.binary()) for d in data], pa.array([_moves(x, before, near, len(centres))], _MOVES)], names=["block", "cluster", "upper", "lower", "moves"])

    return run


def _last(dim: int, centres: list[list[int]], drift: list[float] | None, half: list[float]):
    """Assigns once more; a row a vector with its exact distance, null where it is no long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = _unpacked(row["kind"], row["x"], dim)
                if drift is None:
                    near = scan(x, centres)[0]
                else:
                    near = np.frombuffer(row["cluster"], dtype="<i2").astype(np.int64).copy()
                    reassign(x, near, np.frombuffer(row["upper"], dtype="<f8").copy(), np.frombuffer(row["lower"], dtype="<f8").copy(), centres, drift, half)
                far: list[int | None] = [None] * len(x)
                for c in range(len(centres)):
                    for i, d in zip(np.flatnonzero(near == c).tolist(), squared(x[near == c], centres[c]).tolist()):
                        far[i] = d if d < 1 << 63 else None
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(near, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a cluster and task; applied twice, so that few rows reach the driver."""
    n: dict[int, int] = {}
    sums: dict[int, list[int]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            c, own = row["cluster"], list(map(int, row["sums"]))
            n[c] = n.get(c, 0) + row["n"]
            sums[c] = [a + b for a, b in zip(sums[c], own)] if c in sums else own
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64()), pa.array([list(map(str, sums[c])) for c in n], pa.list_(pa.string()))], names=["cluster", "n", "sums"])


class _Bucketed:
    """Tables bucketed by block in the shared folder, under names of their own in the session's catalogue."""

    def __init__(self, spark: SparkSession, buckets: int) -> None:
        self.spark, self.buckets = spark, buckets

    def write(self, df: DataFrame, name: str) -> tuple[str, str]:
        path, table = new_path(self.spark, name), f"sieveworks_{name}_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "block").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
        return table, path

    def drop(self, made: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {made[0]}")
        drop_path(self.spark, made[1])


def _start(vectors: DataFrame, k: int, scale: int, seed: int) -> list[list[int]]:
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.filter("vec_id IS NOT NULL").select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return [_integers(np.array([r.v], dtype=float), scale)[0].tolist() for r in rows]


def _geometry(old: list[list[int]] | None, new: list[list[int]]) -> tuple[list[float] | None, list[float]]:
    """Drift of each centroid, rounded up, and half the distance to its nearest other one, rounded down."""
    far = lambda a, b: _wide_root(sum((x - y) ** 2 for x, y in zip(a, b)))
    drift = None if old is None else [far(a, b) * _OUT for a, b in zip(old, new)]
    half = [min((far(a, b) for j, b in enumerate(new) if j != i), default=float("inf")) / 2 / _OUT / _OUT for i, a in enumerate(new)]
    return drift, half


def cluster(embeddings: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, and n, the cluster's size.

    Vectors that are null, of another length, or hold a null, NaN or infinite component are left out. Rows with a null
    vec_id are clustered but start no centroid; repeated vec_ids are vectors of their own, and of several such that
    start a centroid the smaller components come first. With fewer than ``k`` vectors that can start a centroid there
    are so many centroids; with none, and for an empty table, the result is empty. Components of any size are exact;
    a distance or sum that is no 64-bit number is null. Other columns are ignored."""
    spark = embeddings.sparkSession
    vectors = kept_vectors(embeddings, dim)
    centres = _start(vectors, k, scale, seed)
    if not centres:
        return vectors.limit(0).select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"), ("n", "long"))])
    conf, batch_key = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(batch_key)
    rows, parts = embeddings.count(), min(_PARTS, int(conf.get("spark.sql.shuffle.partitions")))
    bucketed = _Bucketed(spark, max(rows // _BUCKET_ROWS, min(rows // (4 * _BLOCK), spark.sparkContext.defaultParallelism), 1))
    packed = bucketed.write(vectors.mapInArrow(_pack(dim, scale), _BLOCKS), "vectors")
    bounds, old = None, None
    n, sums = [0] * len(centres), [[0] * dim for _ in centres]
    try:
        conf.set(batch_key, "64")
        for _ in range(rounds):
            drift, half = _geometry(old, centres)
            made = bucketed.write(_beside(spark, packed, bounds).mapInArrow(_round(dim, centres, drift, half), _BOUNDS), "bounds")
            if bounds:
                bucketed.drop(bounds)
            bounds, old = made, centres
            moved = spark.table(bounds[0]).select(F.inline("moves"))
            kind = "cluster int, n long, sums array<string>"
            for r in moved.mapInArrow(_totals, kind).repartition(parts).mapInArrow(_totals, kind).collect():
                n[r.cluster] += r.n
                sums[r.cluster] = [a + int(b) for a, b in zip(sums[r.cluster], r.sums)]
            centres = [[s // n[c] for s in sums[c]] if n[c] else centres[c] for c in range(len(centres))]
        drift, half = _geometry(old, centres)
        path = write_table(_beside(spark, packed, bounds).mapInArrow(_last(dim, centres, drift, half), "vec_id long, cluster int, distance long"), "clusters", 64)
    finally:
        conf.set(batch_key, before)
        for made in (packed, bounds):
            if made:
                bucketed.drop(made)
    found = spark.read.schema("vec_id long, cluster int, distance long").parquet(path)
    return found.join(F.broadcast(_summary(found, centres)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n")


def _beside(spark: SparkSession, packed: tuple[str, str], bounds: tuple[str, str] | None) -> DataFrame:
    """Blocks with their bounds; both are bucketed by block, so nothing is exchanged."""
    blocks = spark.table(packed[0])
    return blocks if bounds is None else blocks.join(spark.table(bounds[0]).drop("moves").hint("shuffle_hash"), "block")


def _summary(found: DataFrame, centres: list[list[int]]) -> DataFrame:
    """A row a cluster, k at most: sums are null if they, or a distance in them, are no 64-bit number."""
    rows = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count("distance").alias("known"), F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()
    total = lambda part: (lambda s: s if s < 1 << 63 else None)(sum(int(r.s) for r in part)) if all(r.known == r.n for r in part) else None
    digest = lambda c: hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()
    return found.sparkSession.createDataFrame([(r.cluster, total([r]), total(rows), digest(r.cluster), r.n) for r in rows], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, n long")


def cluster_sql(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same rows in the dialect of the checking engine, for components within 64 bits."""
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda c: CAST(floor({scale} * c) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS c, x AS m FROM kept WHERE vec_id IS NOT NULL ORDER BY c LIMIT {k})",
    ]
    distance = "CAST(list_sum(list_transform(list_zip(x, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT i, min(struct_pack(d := d, c := c)) AS best FROM (SELECT i, c, {distance} AS d FROM kept, c{r}) GROUP BY i)")
        if r < rounds:
            steps.append(f"s{r} AS MATERIALIZED (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS m FROM (SELECT best.c AS c, p, sum(x[p]) AS s, count(*) AS n FROM a{r} JOIN kept USING (i), range(1, {dim + 1}) AS t(p) GROUP BY 1, 2) GROUP BY c)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(s{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN s{r} USING (c))")
    last = f"SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256, count(*) OVER (PARTITION BY best.c) AS n FROM a{rounds} JOIN kept USING (i) JOIN c{rounds} ON c{rounds}.c = best.c"
    return "WITH " + ",\n ".join(steps) + "\n " + last
