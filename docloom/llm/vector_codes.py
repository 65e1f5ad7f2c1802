"""Compression of vectors to codes: one codebook for each part position, searched through vantage-point trees.

Vectors become integers and are cut into equal parts. Each round every part is
assigned to the nearest entry of its codebook, and each entry moves to the floor of
the mean of its parts. The search is metric branch-and-bound: a node of the tree
is an entry, and its other entries are halved by their distance from it; a half is
visited unless the triangle inequality shows that all of it is farther than the best entry so far. Radii are rounded
outwards, halves at exactly the best distance are visited too, and entries are
compared by integer squared distances (equal ones by index), so results are exact.

Sums of parts are exact decimals made by Spark; only codebooks, whose size the
parameters bound, are on the driver.

Defined cases: see docloom.llm.vectors for what goes; of rows that share an id, the
one with the smaller vector comes first; rows without an id are coded but start no
entry; fewer vectors than entries make fewer entries; an entry that is never
nearest stays; a table without vectors with an id to start from gives no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialise
from docloom.llm.vectors import above, below, floored, matrix, squared


@dataclass(frozen=True)
class Codes:
    """scale: of components before they are floored; width: of vectors; parts, entries: of codebooks (256 entries at most, as a code has two digits for each); rounds: of assignments with updates; leaf: entries that a node's half may have without being halved itself."""

    scale: int = 4096
    width: int = 64
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    leaf: int = 2

    def __post_init__(self) -> None:
        if self.width % self.parts or not 0 < self.entries <= 256:
            raise ValueError("parts must divide the width, and codebooks have 1 to 256 entries")


@dataclass
class Half:
    """Entries of a vantage point whose distances from it lie between low and high."""

    low: float
    high: float
    tree: Tree


@dataclass
class Tree:
    """A vantage point (or, in a leaf, some entries) and its halves."""

    points: list[int]
    halves: list[Half]


def build(entries: np.ndarray, leaf: int, members: np.ndarray | None = None) -> Tree:
    """The vantage-point tree of a codebook. The vantage point is the member that is farthest from the first one, so that distances from it spread."""
    members = np.arange(len(entries)) if members is None else members
    if len(members) <= leaf:
        return Tree(members.tolist(), [])
    vantage = members[np.argmax(squared(entries[members], entries[members[0]]))]
    rest = members[members != vantage]
    from_vantage = squared(entries[rest], entries[vantage])
    order = np.argsort(from_vantage, kind="stable")
    halves = [Half(float(below(from_vantage[o]).min()), float(above(from_vantage[o]).max()), build(entries, leaf, rest[o])) for o in np.array_split(order, 2) if len(o)]
    return Tree([int(vantage)], halves)


def nearest(tree: Tree, entries: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each point; of equally near ones the smaller index."""
    best = np.full(len(points), np.iinfo(np.int64).max)
    index = np.full(len(points), len(entries))

    def visit(node: Tree, rows: np.ndarray) -> None:
        for e in node.points:
            d = squared(points[rows], entries[e])
            better = (d < best[rows]) | ((d == best[rows]) & (e < index[rows]))
            best[rows[better]], index[rows[better]] = d[better], e
        if not node.halves:
            return
        low, high = below(d), above(d)
        bounds = [np.maximum(np.maximum(low - h.high, h.low - high), 0) for h in node.halves]
        first = np.argmin(bounds, axis=0)  # each point goes to the nearer half first
        for own in range(len(node.halves)):
            at = np.flatnonzero(first == own)
            for k in sorted(range(len(node.halves)), key=lambda k: k != own):
                go = at[bounds[k][at] <= above(best[rows[at]])]
                if len(go):
                    visit(node.halves[k].tree, rows[go])

    if len(points):
        visit(tree, np.arange(len(points)))
    return index, best


def _coded(books: list[np.ndarray], p: Codes, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, its values, entries, squared distances) for each part of the vectors."""
    size = p.width // p.parts
    for k, book in enumerate(books):
        values = x[:, k * size : (k + 1) * size]
        yield k, values, *nearest(build(book, p.leaf), book, values)


def _updated(books: list[np.ndarray], p: Codes, vectors: DataFrame) -> list[np.ndarray]:
    """The codebooks after a round."""
    size, kinds = p.width // p.parts, pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("total", pa.int64())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of a partition; place: within the part, and after them all the count."""
        sums = np.zeros((p.parts, len(books[0]), size + 1), dtype=np.int64)
        for batch in batches:
            for k, values, entry, _ in _coded(books, p, matrix(batch, p.width)):
                for e in np.unique(entry):
                    own = values[entry == e]
                    sums[k, e, :size] += own.sum(axis=0)
                    sums[k, e, size] += len(own)
        part, entry, place = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(place, pa.int32()), pa.array(sums[part, entry, place])], schema=kinds)

    partial = vectors.select("x").mapInArrow(add, "part int, entry int, place int, total long")
    totals = {(r["part"], r["entry"], r["place"]): int(r["total"]) for r in partial.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}  # as many as codebooks have components, at most
    out = []
    for k, book in enumerate(books):
        n = [totals.get((k, e, size), 0) for e in range(len(book))]
        out.append(np.array([[totals.get((k, e, i), 0) // n[e] for i in range(size)] if n[e] else book[e] for e in range(len(book))], dtype=np.int64))
    return out


def codebooks(vectors: DataFrame, p: Codes) -> list[np.ndarray]:
    """The final codebooks, one for each part position, from (id, x)."""
    size = p.width // p.parts
    first = vectors.where(F.col("id").isNotNull()).orderBy("id", "x").limit(p.entries).collect()  # a codebook: bounded
    start = np.array([r["x"] for r in first], dtype=np.int64).reshape(-1, p.width)
    books = [start[:, k * size : (k + 1) * size].copy() for k in range(p.parts)]
    for _ in range(p.rounds if first else 0):
        books = _updated(books, p, vectors)
    return books


def compress(rows: DataFrame, p: Codes | None = None, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(id, label, code, error, codebooks_sha256) of each vector; code: two hexadecimal digits a part; error: the squared distance from what the code stands for."""
    p = p or Codes()
    vectors = materialise(floored(rows, p.scale, p.width, {"id": F.col(id_column).cast("long"), "label": F.col(label_column)}, vector_column), "vectors")
    books = codebooks(vectors, p)
    digest = hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()
    kinds = pa.schema([("at", pa.int64()), ("code", pa.string()), ("error", pa.int64())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digits, error = np.empty((batch.num_rows, p.parts), dtype=np.uint8), np.zeros(batch.num_rows, dtype=np.int64)
            for k, _, entry, d in _coded(books, p, matrix(batch, p.width)):
                digits[:, k] = entry
                error += d
            codes = [r.tobytes().hex() for r in digits]
            columns = [batch.column("id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", *kinds.names[1:]])

    label = vectors.schema["label"].dataType.simpleString()
    made = (vectors if len(books[0]) else vectors.limit(0)).mapInArrow(code, f"id long, label {label}, code string, error long")
    return made.select(F.col("id").alias(id_column), F.col("label").alias(label_column), "code", "error", F.lit(digest).alias("codebooks_sha256"))


def with_label_errors(coded: DataFrame, label_column: str = "label") -> DataFrame:
    """coded with label_error: the sum of error over equal labels, nulls counting as equal. Labels are summed before they are joined."""
    kept = materialise(coded, "coded")
    sums = materialise(kept.groupBy(F.col(label_column).alias("of label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return kept.join(sums, kept[label_column].eqNullSafe(sums["of label"])).drop("of label")
