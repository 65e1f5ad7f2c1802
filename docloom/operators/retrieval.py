"""Nearest neighbours, diversified selection and retrieval diagnostics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The query block that is sent to all executors is at most this large.
BLOCK_BYTES = 64 << 20
#: So is what a task keeps of a block, at so many bytes a row; rows of the corpus that it compares at a time; queries that leave it at a time.
KEPT_BYTES, KEPT_ROW_BYTES, FRAME_ROWS, OUT_QUERIES = 64 << 20, 112, 2048, 512


def _keep(kept: tuple[np.ndarray, np.ndarray, np.ndarray], sizes: np.ndarray, q: np.ndarray, similarity: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> None:
    """Takes rows of queries q into what is kept of each query (similarity, order among equals, id: a line of k places, of which sizes are taken), best first."""
    if not len(q):
        return
    k, of = kept[0].shape[1], np.unique(q)
    line, place = np.nonzero(np.arange(k) < sizes[of, None])
    line = of[line]
    q, similarity, keys, ids = (np.concatenate(x) for x in ((line, q), (kept[0][line, place], similarity), (kept[1][line, place], keys), (kept[2][line, place], ids)))
    order = np.lexsort((keys, -similarity, q))
    q = q[order]
    first = np.searchsorted(q, of)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    q, place, order = q[place < k], place[place < k], order[place < k]
    for to, values in zip(kept, (similarity, keys, ids), strict=True):
        to[q, place] = values[order]
    sizes[of] = np.minimum(np.diff(np.append(first, len(ids))), k)


def nearest(corpus: DataFrame, queries: DataFrame, k: int = 20, seed: int = 42) -> DataFrame:
    """(query_id, chunk_id, similarity, place): exact cosine top k. Both have an id and a vector (chunk_id, vector; query_id, vector).

    Queries go out in blocks of bounded size, and what a partition of the corpus keeps of a block, its own k best of every query,
    is bounded too; only partitions times k rows a query are shuffled. Equal similarities (to six places) are ordered by a seeded hash."""
    first = queries.select(F.size("vector").alias("n")).first()
    width = first["n"] if first else 0
    per_block = max(1, min(BLOCK_BYTES // (8 * max(1, width)), KEPT_BYTES // (KEPT_ROW_BYTES * k)))
    count = queries.count()
    parts = []
    for b in range(max(1, -(-count // per_block))):
        block = queries if count <= per_block else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-count // per_block))) == b)
        rows = block.select("query_id", "vector").toPandas()  # a block: bounded, see BLOCK_BYTES
        ids = rows["query_id"].to_numpy()
        matrix = np.array([np.asarray(v, dtype=np.float64) for v in rows["vector"]]).reshape(len(rows), width)
        matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        shared = corpus.sparkSession.sparkContext.broadcast((ids, matrix))
        kind = corpus.schema["chunk_id"].dataType.simpleString()
        kind_q = queries.schema["query_id"].dataType.simpleString()

        def best(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            import hashlib

            own_ids, own = shared.value
            # of each query the rows kept: similarity, the order among equals, id; and how many
            kept = np.full((len(own_ids), k), -np.inf), np.full((len(own_ids), k), b"", dtype="S32"), np.full((len(own_ids), k), None, dtype=object)
            sizes = np.zeros(len(own_ids), dtype=np.int64)
            for whole in frames:
                for at_row in range(0, len(whole), FRAME_ROWS):
                    frame = whole.iloc[at_row : at_row + FRAME_ROWS]
                    vectors = np.array([np.asarray(v, dtype=np.float64) for v in frame["vector"]])
                    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
                    keys = np.array([hashlib.sha256(f"{seed}:{c}".encode()).digest() for c in frame["chunk_id"]], dtype="S32")
                    chunk_ids = frame["chunk_id"].to_numpy(dtype=object)
                    # so many queries at a time that their scores take a part of a block
                    some = max(1, BLOCK_BYTES // (64 * len(frame)))
                    for at in range(0, len(own_ids), some):
                        found = np.round(vectors @ own[at : at + some].T, 6) + 0.0
                        # all that are as near as the k-th here and the k-th kept; ties are ordered below
                        least = np.maximum(np.partition(found, -min(k, len(found)), axis=0)[-min(k, len(found))], kept[0][at : at + some].min(axis=1))
                        row, q = np.nonzero(found >= least)
                        _keep(kept, sizes, at + q, found[row, q], keys[row], chunk_ids[row])
            for at in range(0, len(own_ids), OUT_QUERIES):
                q, place = np.nonzero(np.arange(k) < sizes[at : at + OUT_QUERIES, None])
                if len(q):
                    yield pd.DataFrame({"query_id": own_ids[at + q], "chunk_id": kept[2][at + q, place], "similarity": kept[0][at + q, place], "order_key": [x.ljust(32, b"\0").hex() for x in kept[1][at + q, place].tolist()]})

        parts.append(corpus.select("chunk_id", "vector").mapInPandas(best, f"query_id {kind_q}, chunk_id {kind}, similarity double, order_key string"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "order_key"))
    return rows.withColumn("place", place).where(F.col("place") <= k).drop("order_key")


def diversified(candidates: DataFrame, k: int = 5, per_parent: int = 2, per_family: int = 2) -> DataFrame:
    """(query_id, chunk_id, new_place) from (query_id, place, chunk_id, parent, family, text_hash), greedily in order. What one limit turns away does not count towards another, so this is a fold over a query's candidates (a bounded pool)."""
    kind = "array<struct<place:int,chunk_id:string,parent:string,family:string,text_hash:string>>"
    item = F.struct(F.col("place").cast("int").alias("place"), *(F.col(c).cast("string").alias(c) for c in ("chunk_id", "parent", "family", "text_hash")))
    pool = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("pool"))

    def step(done: Column, c: Column) -> Column:
        same = lambda f: F.size(F.filter(done, lambda d: d[f] == c[f]))
        fits = (F.size(done) < k) & (same("parent") < per_parent) & (same("family") < per_family) & (same("text_hash") == 0)
        return F.when(fits, F.concat(done, F.array(c))).otherwise(done)

    chosen = F.aggregate("pool", F.array().cast(kind), step)
    return pool.select("query_id", F.posexplode(chosen).alias("at", "c")).select("query_id", "c.chunk_id", (F.col("at") + 1).cast("int").alias("new_place"), F.col("c.place").alias("old_place"))


def diagnostics(retrieved: DataFrame, k: int = 5) -> DataFrame:
    """Per condition, from (condition, query_id, place, similarity, relevant, text_hash): hit rate, mean reciprocal rank, similarity, short answers, repeats."""
    by_query = retrieved.groupBy("condition", "query_id").agg(
        F.min(F.when(F.col("relevant"), F.col("place"))).alias("first_hit"),
        F.count("*").alias("n"),
        F.sum("similarity").alias("s"),
        F.sum(F.col("similarity") * F.col("similarity")).alias("s2"),
        (1.0 - F.count_distinct("text_hash") / F.count("*")).alias("repeats"),
    )
    mean = F.sum("s") / F.sum("n")
    return by_query.groupBy("condition").agg(
        F.count("*").alias("queries"),
        F.round(100.0 * F.avg(F.col("first_hit").isNotNull().cast("double")), 6).alias("hit_rate"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0))), 6).alias("mrr"),
        F.round(mean, 6).alias("mean_similarity"),
        F.round(F.sqrt(F.greatest(F.sum("s2") / F.sum("n") - mean * mean, F.lit(0.0))), 4).alias("std_similarity"),
        F.round(100.0 * F.avg((F.col("n") < k).cast("double")), 6).alias("fewer_than_k"),
        F.round(F.avg("repeats"), 6).alias("mean_repeats"),
    )
