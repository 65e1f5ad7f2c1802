"""Centroid clustering with Drake's adaptive bounds, exact to the integer.

Each vector keeps, beside an upper bound of the distance from its own centroid, lower
bounds of those from its several nearest centroids, each with the centroid's number, and one bound for
all the rest. When centroids move, bounds move with them. Where the upper bound is
below all others, the vector stays without a distance; else the shortest run of
its nearest centroids that the bounds after it certify is measured and put in order
again; else all centroids are rescanned. Bounds are rounded outwards and have to be strictly apart, and
what is measured are integer squared distances, so ties go to the smaller number and
results are those of a search without bounds. The number of bounds shrinks to
what the last round needed.

A round writes vectors and bounds as a table in the shared folder and deletes
the one before. Centroids move by exact sums over the vectors that changed, made
by Spark; only centroids and their sums, bounded by the parameters, are on the driver.

Defined cases: see docloom.llm.vectors for what goes; of rows that share an id, the
one with the smaller vector comes first; rows without an id are clustered but start no
centroid; fewer vectors than centroids make fewer centroids; an empty cluster's
centroid stays; without a vector with an id there are no rows; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import discard, materialise
from docloom.llm.vectors import LIMIT, above, below, floored, matrix, squared


@dataclass(frozen=True)
class Clusters:
    """scale: of components before they are floored; width: of vectors (64 components at most, see docloom.llm.vectors); k: centroids (they are held on the driver); rounds: of assignments with updates; seed: names the order of first centroids; most, least: nearest centroids with a bound of their own, the vector's own included, as a share of all."""

    scale: int = 256
    width: int = 64
    k: int = 40
    rounds: int = 5
    seed: int = 2
    most: float = 1 / 4
    least: float = 1 / 8

    def __post_init__(self) -> None:
        if self.width > 64 or not 0 < self.k <= 65536:
            raise ValueError("vectors have 64 components at most, and there are 1 to 65536 centroids")


@dataclass
class Bounds:
    """Of some vectors: ids of their nearest centroids (their own first), an upper bound of its distance, lower bounds of all of ids (that of the first is not used) and of the rest, and how many of ids had to be looked at (one more than there are: all centroids)."""

    ids: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    rest: np.ndarray
    looked: np.ndarray


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances. Small integers are multiplied as doubles, in which all sums are exact."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= 1 << 21:
        x, centroids = x.astype(np.float64), centroids.astype(np.float64)
    out = (x * x).sum(axis=1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(axis=1)
    return out.astype(np.int64)


def scan(x: np.ndarray, centroids: np.ndarray, n: int) -> Bounds:
    """Exact bounds with n nearest centroids, from all distances."""
    d = distances(x, centroids)
    order = np.argsort(d, axis=1, kind="stable")[:, : n + 1]
    near = np.take_along_axis(d, order, axis=1)
    rest = below(near[:, n]) if near.shape[1] > n else np.full(len(x), np.inf)
    return Bounds(order[:, :n].astype(np.int32), above(near[:, 0]), below(near[:, :n]), rest, np.full(len(x), n + 1, dtype=np.int32))


def moved(b: Bounds, steps: np.ndarray, n: int) -> Bounds:
    """The bounds after each centroid has moved by at most its step, with n of them kept."""
    rest = b.rest if b.lower.shape[1] <= n else np.minimum(b.rest, b.lower[:, n:].min(axis=1))
    ids, lower = b.ids[:, :n].copy(), b.lower[:, :n]
    # the dropped bounds moved by no more than the longest step
    return Bounds(ids, np.nextafter(b.upper + steps[ids[:, 0]], np.inf), np.nextafter(lower - steps[ids], -np.inf), np.nextafter(rest - steps.max(initial=0), -np.inf), np.ones(len(ids), dtype=np.int32))


def reassign(x: np.ndarray, centroids: np.ndarray, b: Bounds) -> Bounds:
    """The bounds with the nearest centroid first; distances are measured only where bounds don't certify it."""
    n = b.ids.shape[1]

    def certified(rows: np.ndarray) -> np.ndarray:
        """How many of the first ids certainly have the nearest centroid among them; n + 1: not even all."""
        after = np.concatenate((b.lower[rows], b.rest[rows, None]), axis=1)
        least = np.minimum.accumulate(after[:, ::-1], axis=1)[:, ::-1]  # of what begins at each place
        safe = b.upper[rows, None] < least[:, 1:]
        return np.where(safe.any(axis=1), safe.argmax(axis=1) + 1, n + 1)

    rows = np.arange(len(x))
    rows = rows[certified(rows) > 1]
    b.upper[rows] = above(squared(x[rows], centroids[b.ids[rows, 0]]))  # its own distance, exactly
    need = certified(rows)
    b.looked[rows] = need
    for z in range(2, n + 1):
        own = rows[need == z]
        if len(own):
            ids = b.ids[own, :z]
            d = squared(x[own, None, :], centroids[ids])
            order = np.lexsort((ids, d))
            d = np.take_along_axis(d, order, axis=1)
            b.ids[own, :z], b.lower[own, :z], b.upper[own] = np.take_along_axis(ids, order, axis=1), below(d), above(d[:, 0])
    own = rows[need > n]
    if len(own):
        every = scan(x[own], centroids, n)
        b.ids[own], b.lower[own], b.upper[own], b.rest[own] = every.ids, every.lower, every.upper, every.rest
    return b


STATE = "id long, x array<long>, cluster int, before int, ids binary, bounds binary, looked int"


def _round(centroids: np.ndarray, steps: np.ndarray | None, n: int, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One assignment; without steps the first one."""
    for batch in batches:
        x = matrix(batch, width)
        if steps is None:
            b, before = scan(x, centroids, n), np.full(len(x), -1, dtype=np.int32)
        else:
            ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype=np.int32).reshape(len(x), -1)
            bounds = np.frombuffer(b"".join(batch.column("bounds").to_pylist()), dtype=np.float64).reshape(len(x), -1)
            before = ids[:, 0].copy()
            b = reassign(x, centroids, moved(Bounds(ids, bounds[:, 0], bounds[:, 2:], bounds[:, 1], before), steps, n))
        packed = np.concatenate((b.upper[:, None], b.rest[:, None], b.lower), axis=1)
        columns = [batch.column("id"), batch.column("x"), pa.array(b.ids[:, 0]), pa.array(before), pa.array([r.tobytes() for r in b.ids], pa.binary()), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(b.looked)]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "x", "cluster", "before", "ids", "bounds", "looked"])


def _changes(k: int, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What vectors that changed add to the sums of clusters; place: of the component, and after them all the count."""
    sums = np.zeros((k, width + 1), dtype=np.int64)
    for batch in batches:
        x = matrix(batch, width)
        x = np.concatenate((x, np.ones((len(x), 1), dtype=np.int64)), axis=1)
        for column, sign in (("cluster", 1), ("before", -1)):
            of = batch.column(column).to_numpy()
            for c in np.unique(of[of >= 0]):
                sums[c] += sign * x[of == c].sum(axis=0)
    cluster, place = np.nonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(place, pa.int32()), pa.array(sums[cluster, place])], names=["cluster", "place", "total"])


def first_centroids(vectors: DataFrame, p: Clusters) -> np.ndarray:
    """The vectors (id, x) with the smallest hashes of seed and id, in that order."""
    hashed = vectors.where(F.col("id").isNotNull()).withColumn("hash", F.sha2(F.concat(F.lit(f"{p.seed}:"), F.col("id").cast("string")), 256))
    return np.array([r["x"] for r in hashed.orderBy("hash", "x").limit(p.k).collect()], dtype=np.int64).reshape(-1, p.width)  # k rows


def cluster(rows: DataFrame, p: Clusters | None = None, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256, looked) of each vector; looked: at how many of its nearest centroids the last assignment had to look (1: at none but by bounds)."""
    p = p or Clusters()
    vectors = materialise(floored(rows, p.scale, p.width, {"id": F.col(id_column).cast("long")}, vector_column), "vectors")
    centroids = first_centroids(vectors, p)
    if np.abs(centroids).max(initial=0) > LIMIT:
        raise ValueError(f"a component is beyond {LIMIT} as an integer")
    k = len(centroids)
    n, fewest = max(1, -(-k * p.most // 1)), max(1, -(-k * p.least // 1))
    n, fewest = int(n), int(fewest)
    state, steps = vectors if k else vectors.limit(0), None
    totals = np.zeros((k, p.width + 1), dtype=object)
    for r in range(p.rounds + 1):
        made = materialise(state.mapInArrow(partial(_round, centroids, steps, n, p.width), STATE), "clusters")
        discard(state if r else vectors)
        state = made
        if r == p.rounds or not k:
            break
        changed = state.where(F.col("cluster") != F.col("before")).select("x", "cluster", "before").mapInArrow(partial(_changes, k, p.width), "cluster int, place int, total long")
        for x in changed.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():  # as many as centroids have components, at most
            totals[x["cluster"], x["place"]] += int(x["total"])
        new = np.array([[int(s) // int(t[-1]) for s in t[:-1]] if t[-1] else c for t, c in zip(totals, centroids, strict=True)], dtype=np.int64)
        steps = above(squared(new, centroids))
        centroids = new
        if r:  # the first assignment looks at all
            n = min(n, max(fewest, state.agg(F.max(F.when(F.col("looked") <= n, F.col("looked")))).first()[0] or 1))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("cluster").to_numpy()
            d = squared(matrix(batch, p.width), centroids[own])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cluster"), pa.array(d), batch.column("looked")], names=["id", "cluster", "distance", "looked"])

    measured = materialise(state.mapInArrow(measure, "id long, cluster int, distance long, looked int"), "measured")
    inertia = {r["cluster"]: int(r["total"]) for r in measured.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(c, inertia.get(c, 0), sum(inertia.values()), d) for c, d in enumerate(digests)]
    about = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = measured.join(F.broadcast(about), "cluster")  # k rows
    return out.select(F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "looked")
