"""A vector index on disk: cells with centroids and rings, and a search that stays exact.

build() fits centroids to a bounded sample of unit vectors, places every vector with the
nearest one, in a ring by its angle to it, and writes a table partitioned by these cells, beside one of the
cells: centroid, vectors, and the least and largest angle between the centroid and a vector of the cell. So
vectors that are far from all centroids widen none but their own rings. A build is a new version;
readers take the newest complete one, so that an index is replaced at once.

search() reads cells only. Angles obey the triangle inequality, so no vector of a cell is nearer
to a query than the cell's ring allows. Each query first looks into its nearest cells, which gives
a k-th similarity, and then into those others whose ring may hold one as near (a little more, for
rounding); no other file is read, and the result is that of a search through all. With probes the
second step is left out, which is quicker and not exact.

Queries go out in blocks of bounded size, made of queries with the same nearest cells, so that a
block reads few cells.

Defined cases: vectors that are null, have another width than the first or hold null or
non-finite components are left out; a zero vector has similarity 0 to all and a cell of
its own; equal similarities (to six places) are ordered by a seeded hash of the id; an empty
index gives no rows; queries without a vector find nothing.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

from docloom.sources.shared import materialise

#: Of a block of queries, of the centroids, and of scores at a time.
BLOCK_BYTES = 64 << 20
#: More than the rounding error of an angle, and of a similarity of six places.
ANGLE_SLACK, SIMILARITY_SLACK = 1e-7, 1e-6
ZERO_CELL = -1


@dataclass(frozen=True)
class IndexPlan:
    """centroids, rings: cells are as many as their product, at most; sample: vectors that centroids are fitted to, the first ones by a seeded hash of their id; rounds: of fitting."""

    centroids: int = 64
    rings: int = 12
    sample: int = 16384
    rounds: int = 10
    seed: int = 42


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def angles(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centroids.T, -1, 1))


def fit_centroids(x: np.ndarray, p: IndexPlan) -> np.ndarray:
    """Spherical k-means from some of the vectors."""
    centroids = x[np.random.default_rng(p.seed).permutation(len(x))[: p.centroids]]
    for _ in range(p.rounds):
        of = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, x)
        moved = np.linalg.norm(sums, axis=1) > 1e-9
        centroids = np.where(moved[:, None], unit(sums), centroids)
    return centroids


def _matrix(batch: pa.RecordBatch, width: int, column: str = "vector") -> np.ndarray:
    return np.asarray(batch.column(column).flatten()).astype(np.float64).reshape(-1, width)


def _whole(vectors: DataFrame, width: int) -> DataFrame:
    finite = F.forall("vector", lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    return vectors.where(F.coalesce((F.size("vector") == width) & finite, F.lit(False)))


def _placed(vectors: DataFrame, centroids: np.ndarray, rings: int) -> DataFrame:
    """vectors with cell (the centroid's number, and within it the ring's), and angle to the centroid."""
    schema = reduce(lambda s, f: s.add(f), vectors.schema.fields, StructType()).add("cell", IntegerType()).add("angle", DoubleType())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, centroids.shape[1])
            none = ~x.any(axis=1)
            to = angles(unit(x), centroids)
            near = to.argmin(axis=1)
            angle = to[np.arange(len(x)), near]
            cell = (near * rings + np.minimum(angle / (np.pi / 2) * rings, rings - 1).astype(np.int64)).astype(np.int32)
            cell[none], angle[none] = ZERO_CELL, 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=schema.names)

    return vectors.mapInArrow(place, schema)


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop, hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[str]:
    """The complete versions under a path, oldest first: a version's cells are written last."""
    hadoop, fs = _files(spark, path)
    if not fs.exists(hadoop(path)):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(hadoop(path)) if s.isDirectory())
    return [n for n in names if fs.exists(hadoop(f"{path}/{n}/cells/_SUCCESS"))]


@dataclass
class VectorIndex:
    """table: the vectors with their other columns, partitioned by cell; numbers, centroids, counts, nearest, farthest: of the cells in order of their numbers, that of the zero vectors first, whether it has any or not; visited: for each block that was searched, the cells it read."""

    table: DataFrame
    numbers: np.ndarray
    centroids: np.ndarray
    counts: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray
    visited: list[set[int]] = field(default_factory=list)


def build(vectors: DataFrame, path: str, p: IndexPlan | None = None, keep: int = 1) -> VectorIndex:
    """An index of vectors (chunk_id, vector, any others) as the newest version under path; of older ones all but the last keep - 1 are deleted. Texts are no part of an index."""
    p, spark = p or IndexPlan(), vectors.sparkSession
    vectors = vectors.drop("text", "chunk_text", "masked_text", "cell", "angle")
    first = vectors.where(F.size("vector") > 0).select(F.size("vector").alias("n")).first()
    width = first["n"] if first else 1
    if p.centroids * p.rings * width * 8 > BLOCK_BYTES or p.sample * width * 8 > 4 * BLOCK_BYTES:
        raise ValueError("centroids and sample are held on the driver; both must be small")
    whole = _whole(vectors, width)
    some = whole.where(F.exists("vector", lambda v: v != 0)).orderBy(F.xxhash64(F.lit(p.seed), "chunk_id")).limit(p.sample).select("vector").collect()  # a sample: bounded
    centroids = fit_centroids(unit(np.array([r["vector"] for r in some], dtype=np.float64)), p) if some else np.zeros((1, width))
    version = f"{path}/v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    _placed(whole, centroids, p.rings).hint("rebalance", "cell").sortWithinPartitions("cell", "angle").write.partitionBy("cell").parquet(f"{version}/vectors")
    table = spark.read.schema(whole.schema.add("angle", DoubleType()).add("cell", IntegerType())).parquet(f"{version}/vectors")
    of = F.element_at(F.lit(centroids.tolist()).cast("array<array<double>>"), F.greatest(F.floor(F.col("cell") / p.rings), F.lit(0)).cast("int") + 1)
    facts = table.groupBy("cell").agg(F.count("*").alias("vectors"), F.min("angle").alias("nearest"), F.max("angle").alias("farthest"))
    facts.withColumn("centroid", of).coalesce(1).write.parquet(f"{version}/cells")
    hadoop, fs = _files(spark, path)
    for old in versions(spark, path)[:-keep]:
        fs.delete(hadoop(f"{path}/{old}"), True)
    return load(spark, path)


def load(spark: SparkSession, path: str) -> VectorIndex:
    """The newest complete version."""
    known = versions(spark, path)
    if not known:
        raise ValueError(f"{path} has no index")
    cells = spark.read.parquet(f"{path}/{known[-1]}/cells").orderBy("cell").collect()  # bounded by the plan
    cells = [(r["cell"], r["centroid"], r["vectors"], r["nearest"], r["farthest"]) for r in cells]
    if not cells or cells[0][0] != ZERO_CELL:
        cells.insert(0, (ZERO_CELL, cells[0][1] if cells else [0.0], 0, 0.0, 0.0))
    numbers, centroids, counts, low, high = (np.array(c) for c in zip(*cells, strict=True))
    files = f"{path}/{known[-1]}/vectors"
    hadoop, fs = _files(spark, path)
    parts = [s.getPath().getName() for s in fs.listStatus(hadoop(files))]
    if not any(n.startswith("cell=") for n in parts):  # no vectors: no schema either
        return VectorIndex(spark.createDataFrame([], "chunk_id string, vector array<double>, angle double, cell int"), numbers, centroids, counts, low, high)
    return VectorIndex(spark.read.parquet(files), numbers, centroids, counts, low, high)


def _looked(index: VectorIndex, ids: list, q: np.ndarray, wanted: np.ndarray, floor: np.ndarray, k: int, seed: int, columns: list[str], kind: str) -> DataFrame:
    """(query_id, similarity, order_key, columns): of each partition and query the k best of the cells that the query wants (a row of wanted), if they reach its floor."""
    cells, numbers = index.numbers[wanted.any(axis=0)].tolist(), index.numbers
    shared = index.table.sparkSession.sparkContext.broadcast((ids, q, wanted, floor))
    source = index.table.where(F.col("cell").isin(cells)).select("vector", "cell", *columns)
    schema = StructType.fromDDL(f"query_id {kind}, similarity double, order_key string")
    for c in columns:
        schema = schema.add(index.table.schema[c])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        ids, q, wanted, floor = shared.value
        kept: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, cell = unit(_matrix(batch, q.shape[1])), np.asarray(batch.column("cell"))
            rows, of, similarity = [], [], []
            for c in np.unique(cell):
                own, asking = np.flatnonzero(cell == c), np.flatnonzero(wanted[:, np.searchsorted(numbers, c)])
                some = max(1, BLOCK_BYTES // (8 * len(own)))
                for at in range(0, len(asking), some):
                    a = asking[at : at + some]
                    found = np.round(x[own] @ q[a].T, 6) + 0.0
                    least = np.maximum(np.partition(found, -min(k, len(own)), axis=0)[-min(k, len(own))], floor[a])
                    r, j = np.nonzero(found >= least)
                    rows.append(own[r])
                    of.append(a[j])
                    similarity.append(found[r, j])
            row = np.concatenate([np.empty(0, np.int64), *rows])
            names = batch.column("chunk_id").take(pa.array(row)).to_pylist()
            made = pa.table([pa.array(np.concatenate([np.empty(0, np.int64), *of])), pa.array(np.concatenate([np.empty(0), *similarity])), pa.array([hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() for i in names], pa.string()), *(batch.column(c).take(pa.array(row)) for c in columns)], names=["query", "similarity", "order_key", *columns])
            kept = made if kept is None else pa.concat_tables([kept, made])
            kept = kept.sort_by([("query", "ascending"), ("similarity", "descending"), ("order_key", "ascending")])
            query = np.asarray(kept.column("query"))
            place = np.arange(len(query)) - np.searchsorted(query, query)
            kept = kept.filter(pa.array(place < k))
        if kept is not None and kept.num_rows:
            who = pa.array([ids[i] for i in kept.column("query").to_pylist()])
            yield from kept.drop_columns(["query"]).add_column(0, "query_id", who).to_batches()

    return source.mapInArrow(look, schema)


def search(index: VectorIndex, queries: DataFrame, k: int = 20, seed: int = 42, columns: list[str] | None = None, probes: int | None = None) -> DataFrame:
    """(query_id, chunk_id, similarity, place, columns): the k nearest by cosine of each query (query_id, vector); columns: others of the index. probes: look into so many nearest cells only."""
    spark, width = queries.sparkSession, index.centroids.shape[1]
    columns = ["chunk_id", *(c for c in columns or [] if c != "chunk_id")]
    kind = queries.schema["query_id"].dataType.simpleString()
    per_block = max(1, BLOCK_BYTES // (8 * (width + len(index.counts))))
    asked = materialise(_placed(_whole(queries.select("query_id", "vector"), width), index.centroids, 1), "queries")
    # consecutive cells make a block, and a cell with many queries several
    sizes = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # bounded by the cells
    order = sorted(sizes)
    blocks: list[tuple[list[int], int]] = []
    room = 0
    for c in order:
        if sizes[c] > room or len(blocks[-1][0]) >= 16:
            blocks.append(([], -(-sizes[c] // per_block)))
            room = per_block
        blocks[-1][0].append(c)
        room -= sizes[c]
    out = []
    for cells, parts in blocks:
        for part in range(parts):
            own = asked.where(F.col("cell").isin(cells) & (F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)).select("query_id", "vector").collect()  # a block: bounded
            if own:
                out += _searched(index, [r["query_id"] for r in own], np.array([r["vector"] for r in own], dtype=np.float64).reshape(len(own), width), k, seed, columns, kind, probes)
    if not out:
        empty = StructType.fromDDL(f"query_id {kind}, chunk_id string, similarity double, place int")
        return spark.createDataFrame([], reduce(lambda s, c: s.add(index.table.schema[c]), columns[1:], empty))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "order_key"))
    rows = reduce(DataFrame.unionByName, out)
    return rows.withColumn("place", place).where(F.col("place") <= k).select("query_id", "chunk_id", "similarity", "place", *columns[1:])


def _searched(index: VectorIndex, ids: list, vectors: np.ndarray, k: int, seed: int, columns: list[str], kind: str, probes: int | None) -> list[DataFrame]:
    """The candidates of a block: those of the nearest cells, and those of others that may be as near."""
    q = unit(vectors)
    to = angles(q, index.centroids)
    least = np.maximum(np.maximum(to - index.farthest, index.nearest - to), 0) - ANGLE_SLACK
    least[:, 0] = np.pi / 2 - ANGLE_SLACK  # zero vectors are as far from all
    zero = ~vectors.any(axis=1)
    least[zero] = 0
    has = index.counts > 0
    # by the centroid's angle, and of its rings those first that pass by the query
    order = np.argsort(np.where(has, to + 1e-3 * least, np.inf), axis=1, kind="stable")
    before = np.cumsum(index.counts[order], axis=1) - index.counts[order]
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
    enough = np.zeros_like(has[None] & (to > 0))
    np.put_along_axis(enough, order, before < k, axis=1)
    first = has & (enough if probes is None else rank < probes)
    floor = np.full(len(ids), -np.inf)
    near = _looked(index, ids, q, first, floor, k, seed, columns, kind)
    visited = first.any(axis=0)
    out = [near]
    if probes is None:
        near = out[0] = materialise(near, "near")
        place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity")))
        kth = near.select("query_id", "similarity", place.alias("place")).where(F.col("place") == k).select("query_id", "similarity").collect()  # a row a query of the block
        at = {r["query_id"]: r["similarity"] for r in kth}
        floor = np.array([at.get(i, -1.0) for i in ids])  # with fewer than k all are of use
        reach = np.where(floor > -1, np.arccos(np.clip(floor - SIMILARITY_SLACK, -1, 1)), np.inf)
        more = has & ~first & (least <= reach[:, None])
        if more.any():
            out.append(_looked(index, ids, q, more, floor, k, seed, columns, kind))
            visited |= more.any(axis=0)
    index.visited.append(set(index.numbers[visited].tolist()))
    return out


def report(index: VectorIndex) -> DataFrame:
    """Vectors, chunk ids, and widths of an index."""
    width = F.size("vector")
    return index.table.agg(F.count("*").alias("vectors"), F.count_distinct("chunk_id").alias("chunks"), F.min(width).alias("least_width"), F.max(width).alias("most_width"))
