"""Centroid clustering with Hamerly's bounds over integer vectors (operator 11).

Every vector carries one upper bound of the distance to its own centroid and one lower bound of the distance to the
second-nearest. After an update the upper bound grows by its centroid's drift and the lower one shrinks by the largest
drift of the others. A vector whose upper bound lies under the lower one, or under half the way from its centroid to the
next one, keeps its cluster unseen; where that fails, the distance to its own centroid is taken anew, and where it still
fails, the vector is ambiguous and gets an exact scan of all centroids. Bounds are rounded outwards, all comparisons that
decide are between integers, so the result is that of full scans, ties included.

The state (vector, cluster, bounds) is a table in the shared folder, written once a round. Sums of clusters follow from
the vectors that moved: each task sends one row for each cluster and sign. The driver holds centroids and sums alone
(k times dims integers, both parameters).

Vectors of another length, null ones and ones with a null or non-finite component are left out. floor(scale * x) beyond
LIMIT in magnitude saturates there, as squared distances of larger ones don't fit a long; sums that don't fit are put
out as the largest long. Repeated rows are vectors of their own, a null vec_id hashes like an empty one, and equal
hashes are ordered by components. With fewer than k vectors there are as many centroids; an empty table has no rows.
Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import dropped, written

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
LIMIT = 1 << 27
TOP = (1 << 63) - 1
_SLACK = 1e-12  # relative; bounds are rounded outwards by it after each step
STATE = "vec_id long, v array<int>, cluster int, was int, upper double, lower double, distance long, scans int"
_FIELDS = ["vec_id", "v", "cluster", "was", "upper", "lower", "distance", "scans"]


def integers(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors that count, as integers."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where((F.size("x") == dims) & F.forall("x", fine))
    whole = lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))).cast("int")
    return own.select("vec_id", F.transform("x", whole).alias("v"))


def first_centroids(own: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest hashes of their ids, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in own.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()], np.int64)


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of v to all rows of c."""
    top = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0)))
    if v.shape[1] * top * top < 1 << 53:  # then every partial sum is exact in doubles too
        dot = (v.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    else:
        dot = v @ c.T
    return (v * v).sum(1)[:, None] - 2 * dot + (c * c).sum(1)[None, :]


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + _SLACK)


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(x * (1 - _SLACK), 0)


@dataclass
class Step:
    """What tasks need of one update: the centroids, how far each drifted, and half the way to the next one."""

    centroids: np.ndarray
    drift: np.ndarray
    others_drift: np.ndarray
    half_gap: np.ndarray

    @classmethod
    def between(cls, old: np.ndarray, new: np.ndarray) -> Step:
        drift = _up(np.sqrt(((new - old) ** 2).sum(1).astype(np.float64)))
        others = np.array([np.delete(drift, j).max(initial=0.0) for j in range(len(new))])
        between = distances(new, new).astype(np.float64)
        np.fill_diagonal(between, np.inf)
        return cls(new, drift, others, _down(np.sqrt(between.min(1)) / 2))


def nearest(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, lower bound of the second distance) by full scans; ties go to the smaller number."""
    d = distances(v, c)
    best = d.argmin(1)
    own = d[np.arange(len(v)), best]
    if len(c) == 1:
        return best, own, np.full(len(v), np.inf)
    d[np.arange(len(v)), best] = np.iinfo(np.int64).max
    return best, own, _down(np.sqrt(d.min(1).astype(np.float64)))


def reassigned(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, step: Step) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower, scanned) after an update of the centroids."""
    upper = _up(upper + step.drift[cluster])
    lower = _down(lower - step.others_drift[cluster])
    bound = np.maximum(lower, step.half_gap[cluster])
    cluster, scanned = cluster.copy(), np.zeros(len(v), bool)
    near = np.flatnonzero(upper >= bound)
    own = ((v[near] - step.centroids[cluster[near]]) ** 2).sum(1)
    upper[near] = _up(np.sqrt(own.astype(np.float64)))
    far = near[upper[near] >= bound[near]]
    if len(far):
        cluster[far], own, lower[far] = nearest(v[far], step.centroids)
        upper[far] = _up(np.sqrt(own.astype(np.float64)))
        scanned[far] = True
    return cluster, upper, lower, scanned


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def _batch(vec_id: pa.Array, v: pa.Array, cluster, was, upper, lower, distance, scans) -> pa.RecordBatch:
    cols = [vec_id, v, pa.array(cluster.astype(np.int32)), pa.array(was.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(distance), pa.array(scans.astype(np.int32))]
    return pa.RecordBatch.from_arrays(cols, _FIELDS)


def _first(own: DataFrame, centroids: np.ndarray, dims: int) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                best, d, low = nearest(_matrix(b.column(1), dims), centroids)
                yield _batch(b.column(0), b.column(1), best, np.full(len(best), -1), _up(np.sqrt(d.astype(np.float64))), low, d, np.ones(len(best)))

    return own.mapInArrow(run, STATE)


def _next(state: DataFrame, step: Step, dims: int) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                was, upper, lower = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 4, 5))
                v = _matrix(b.column(1), dims)
                cluster, upper, lower, scanned = reassigned(v, was, upper, lower, step)
                d = ((v - step.centroids[cluster]) ** 2).sum(1)
                yield _batch(b.column(0), b.column(1), cluster, was, upper, lower, d, b.column(7).to_numpy(zero_copy_only=False) + scanned)

    return state.mapInArrow(run, STATE)


def moved_sums(state: DataFrame, k: int, dims: int) -> list[tuple[int, int, list[int]]]:
    """(cluster, vectors gained, their sum by component), from the vectors that moved in the last assignment."""

    def run(batches):
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            v, to, out = _matrix(b.column(0), dims), *(b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            np.add.at(total, to, v)
            np.add.at(count, to, 1)
            old = out >= 0
            np.subtract.at(total, out[old], v[old])
            np.subtract.at(count, out[old], 1)
        some = np.flatnonzero(np.abs(total).any(1) | (count != 0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = state.where("cluster <> was").select("v", "cluster", "was").mapInArrow(run, "cluster int, n long, total array<long>")
    sums = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    return [(r[0], r[1], [int(x) for x in r[2:]]) for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect()]


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, scans) of every vector that counts, as a written table, and the final centroids.

    scans is the number of full scans, of rounds + 1 assignments, that the vector needed.
    """
    own = integers(vectors, dims, scale)
    now = first_centroids(own, k, seed)
    if not len(now):
        return own.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0 AS scans").where("false"), []
    state = written(_first(own, now, dims), "bounds")
    totals, counts = [[0] * dims for _ in now], [0] * len(now)
    for _ in range(rounds):
        for j, n, total in moved_sums(state, len(now), dims):
            counts[j] += n
            totals[j] = [a + b for a, b in zip(totals[j], total, strict=True)]
        new = np.array([[x // n for x in t] if n else c.tolist() for t, n, c in zip(totals, counts, now, strict=True)], np.int64)
        state = written(_next(state, Step.between(now, new), dims), "bounds", state)
        now = new
    out = written(state.select("vec_id", "cluster", "distance", "scans"), "clusters", state)
    return out, now.tolist()


def inertias(assigned: DataFrame) -> dict[int, int]:
    """Sum of distances of each cluster."""
    return {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}


def clustered(vectors: DataFrame, **options) -> DataFrame:
    """Every vector with its cluster, distance, the inertia of its cluster and of all, and its centroid's components."""
    assigned, centroids = cluster(vectors, **options)
    by = inertias(assigned)
    total = sum(by.values())
    rows = [(j, min(s, TOP), min(total, TOP), centroids[j]) for j, s in sorted(by.items())]
    side = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return assigned.join(F.broadcast(side), "cluster")  # one row for each centroid


__all__ = ["cluster", "clustered", "dropped", "first_centroids", "integers", "nearest", "reassigned"]
