"""Centroid clustering by Yinyang grouping, in exact whole numbers.

Vectors become points of whole numbers, floor(scale * component), so sums, means and
squared distances are exact whatever the order of work. Centroids are put into groups
once. Every point keeps, from round to round in a written table, its centroid, an upper
bound of the distance to it and one lower bound per group for all other centroids there:

1. after a move the upper bound grows by its own centroid's step, each lower bound
   shrinks by its group's longest step; a point whose upper bound stays below all lower
   bounds keeps its centroid without a distance (global filter);
2. else its upper bound is made exact, and only groups whose lower bound does not exceed
   it are left (group filter);
3. centroids of those groups are scanned exactly; equal distances go to the smaller number.

Bounds are rounded outwards, so rounding never skips a centroid that is nearer or as near.
The driver holds k centroids and k sums, nothing of the size of the data.

Vectors that are null, of another length or with a null or non-finite component are left out.
Repeated vectors and ids stay rows of their own; a null id counts as empty text in the hash
and stays null. With fewer than k vectors there are as many centroids as vectors; none give an
empty result. Other columns are ignored. A component of 2^26 or more in size after scaling
raises an error: its squared distances would not fit 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch, remove, table, tune

STATE = "vec_id long, point array<int>, cluster int, distance long, upper double, lower array<double>, scanned long"
SUMS = "cluster int, dim int, total long, n long"
RESULT = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
LARGEST = 1 << 26
#: Relative slack of bounds: far above rounding, far below a distance of one.
SLACK = 1e-9


def points(vectors: DataFrame, dims: int, scale: int, column: str = "embedding") -> DataFrame:
    """(vec_id, point) of the vectors that are whole."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    too_large = F.exists("point", lambda x: F.abs(x) >= LARGEST)
    kept = vectors.where((F.size(column) == dims) & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(column, lambda x: F.floor(scale * x.cast("double"))).alias("point"))
    checked = F.when(too_large, F.raise_error(F.lit("a component is too large for exact distances"))).otherwise(F.col("point"))
    return kept.select("vec_id", checked.cast("array<int>").alias("point"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k points whose id has the smallest hash, in its order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    got = rows.orderBy(key, "vec_id", "point").limit(k).select("point").collect()
    return np.array([r[0] for r in got], np.int64)


def group_centroids(centroids: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """Group number of each centroid, by a few plain rounds over the centroids alone."""
    c = centroids.astype(float)
    groups = min(groups, len(c))
    middle = c[np.linspace(0, len(c) - 1, groups).astype(int)]
    for _ in range(rounds):
        of = ((c[:, None] - middle[None]) ** 2).sum(2).argmin(1)
        middle = np.array([c[of == g].mean(0) if (of == g).any() else middle[g] for g in range(groups)])
    return np.unique(of, return_inverse=True)[1]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all x to all c; one floating-point product where it is exact, else whole numbers."""
    if not len(x) or x.shape[1] * max(int(np.abs(x).max()), int(np.abs(c).max()), 1) ** 2 * 4 < 1 << 53:
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def _smallest(dist: np.ndarray, of: np.ndarray, best: np.ndarray, groups: int) -> np.ndarray:
    """Lower bound of each group: its nearest centroid but the point's own."""
    d = np.sqrt(dist.astype(float)) * (1 - SLACK)
    d[np.arange(len(d)), best] = np.inf
    return np.stack([d[:, of == g].min(1) for g in range(groups)], 1)


def scan_all(x: np.ndarray, centroids: np.ndarray, of: np.ndarray):
    """(cluster, distance, upper, lower, distances computed) without bounds."""
    dist = squared(x, centroids)
    best = dist.argmin(1)
    own = dist[np.arange(len(x)), best]
    return best, own, np.sqrt(own.astype(float)) * (1 + SLACK), _smallest(dist, of, best, int(of.max()) + 1), np.full(len(x), len(centroids))


def scan_left(x, cluster, upper, lower, centroids: np.ndarray, of: np.ndarray, steps: np.ndarray):
    """The same from last round's bounds; steps: how far each centroid has moved. Distances are exact only where the bounds were not enough."""
    groups, n = int(of.max()) + 1, len(x)
    cluster, scanned = cluster.copy(), np.zeros(n, np.int64)
    upper = (upper + steps[cluster]) * (1 + SLACK)
    longest = np.array([steps[of == g].max() for g in range(groups)])
    lower = np.where(np.isinf(lower), lower, (lower - longest) * np.where(lower > longest, 1 - SLACK, 1 + SLACK))
    left = np.flatnonzero(upper >= lower.min(1))
    old = cluster[left]
    own = ((x[left] - centroids[old]) ** 2).sum(1)
    scanned[left] += 1
    upper[left] = np.sqrt(own.astype(float)) * (1 + SLACK)
    keep = upper[left] >= lower[left].min(1)
    left, old, own = left[keep], old[keep], own[keep]
    best, near = old.copy(), own.copy()
    open_ = lower[left] <= upper[left][:, None]
    seen = np.full((len(left), len(centroids)), -1, np.int64)
    for g in range(groups):
        rows, members = np.flatnonzero(open_[:, g]), np.flatnonzero(of == g)
        if len(rows):
            seen[rows[:, None], members] = dist = squared(x[left[rows]], centroids[members])
            scanned[left[rows]] += len(members)
            pick = dist.argmin(1)
            d, c = dist[np.arange(len(rows)), pick], members[pick]
            wins = (d < near[rows]) | ((d == near[rows]) & (c < best[rows]))
            best[rows[wins]], near[rows[wins]] = c[wins], d[wins]
    for g in range(groups):
        members = np.flatnonzero(of == g)
        d = np.where(seen[:, members] < 0, np.inf, np.sqrt(np.maximum(seen[:, members], 0).astype(float))) * (1 - SLACK)
        d[best[:, None] == members[None]] = np.inf
        exact = open_[:, g]
        lower[left[exact], g] = d[exact].min(1)
        # a group that was not scanned gets back the centroid that the point has left
        gone = ~exact & (of[old] == g) & (best != old)
        lower[left[gone], g] = np.minimum(lower[left[gone], g], np.sqrt(own[gone].astype(float)) * (1 - SLACK))
    cluster[left] = best
    upper[left] = np.sqrt(near.astype(float)) * (1 + SLACK)
    return cluster, upper, lower, scanned


def _lists(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _assign(centroids: np.ndarray, of: np.ndarray, steps: np.ndarray | None, last: bool):
    """Next state of each row; distances are filled in at the end alone."""
    dims, groups = centroids.shape[1], int(of.max()) + 1
    schema = pa.schema([("vec_id", pa.int64()), ("point", pa.list_(pa.int32())), ("cluster", pa.int32()), ("distance", pa.int64()), ("upper", pa.float64()), ("lower", pa.list_(pa.float64())), ("scanned", pa.int64())])

    def run(batches):
        for b in batches:
            x = _lists(b.column("point"), dims, np.int64)
            if steps is None:
                cluster, _, upper, lower, scanned = scan_all(x, centroids, of)
            else:
                cluster, upper, lower, scanned = scan_left(x, b.column("cluster").to_numpy(), b.column("upper").to_numpy(), _lists(b.column("lower"), groups, float), centroids, of, steps)
                scanned = scanned + b.column("scanned").to_numpy()
            distance = ((x - centroids[cluster]) ** 2).sum(1) if last else np.zeros(len(x), np.int64)
            low = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * groups, pa.int32()), pa.array(lower.ravel()))
            yield batch(schema, b.column("vec_id"), b.column("point"), cluster, distance, upper, low, scanned)

    return run


def _sums(k: int, dims: int):
    schema = arrow_schema(SUMS)

    def run(batches):
        total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            x, c = _lists(b.column("point"), dims, np.int64), b.column("cluster").to_numpy()
            for j in np.unique(c).tolist():
                total[j] += x[c == j].sum(0)
            n += np.bincount(c, minlength=k)
        there = np.flatnonzero(n)
        yield batch(schema, np.repeat(there, dims), np.tile(np.arange(dims), len(there)), total[there].ravel(), np.repeat(n[there], dims))

    return run


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of every centroid that has points; the others stay."""
    k, dims = centroids.shape
    rows = state.select("point", "cluster").mapInArrow(_sums(k, dims), SUMS).groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    out = centroids.copy()
    for r in rows:
        out[r["cluster"], r["dim"]] = r["total"] // r["n"]
    return out


def assigned(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, groups: int | None = None, column: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(written state of every kept vector after `rounds` moves and a last assignment, final centroids). `scanned`: exact distances
    that the vector has cost, against k * (rounds + 1) without bounds. groups: a quarter of k if not given; it changes speed, no result."""
    tune(vectors.sparkSession)
    rows = table(points(vectors, dims, scale, column))
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], STATE), centroids
    of, steps, state = group_centroids(centroids, groups or max(1, len(centroids) // 4)), None, rows
    for at in range(rounds + 1):
        new = table(state.mapInArrow(_assign(centroids, of, steps, at == rounds), STATE))
        if state is not rows:
            remove(state)  # the new state holds all that is needed
        state = new
        if at < rounds:
            after = moved(state, centroids)
            steps, centroids = np.sqrt(((after - centroids) ** 2).sum(1).astype(float)) * (1 + SLACK), after
    return state, centroids


def clustered(vectors: DataFrame, **how) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector; how: as `assigned`."""
    spark = vectors.sparkSession
    state, centroids = assigned(vectors, **how)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    per = {r["cluster"]: r["d"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    known = [(c, d, sum(per.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in per.items()]
    facts = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select(RESULT)
